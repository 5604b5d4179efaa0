"""The salvage reader on archives that other writers make: several records a member, plain records, long headers."""

from __future__ import annotations

import hashlib
import io

import pytest

from quillstream.llm.warc import gzip_member, record, salvage

PAYLOADS = [b"<p>%d</p>" % i + b"x" * (50 * i) for i in range(12)]
RECORDS = [record(i, None, p, len(p), hashlib.sha1(p).hexdigest(), None) for i, p in enumerate(PAYLOADS)]


def read(raw: bytes) -> tuple[list[bytes], list[tuple]]:
    """Payloads of the sound records, and (offset, bytes, inner offset, inner bytes) of the gaps."""
    rows = list(salvage(io.BytesIO(raw), len(raw)))
    return [r[5].partition(b"\r\n\r\n")[2] for r in rows if r[4] is not None], [r[:4] for r in rows if r[4] is None]


@pytest.mark.parametrize("raw", [b"".join(RECORDS), gzip_member(b"".join(RECORDS)), b"".join(map(gzip_member, RECORDS)), b"".join(RECORDS[:5]) + gzip_member(b"".join(RECORDS[5:]))])
def test_sound_archives(raw):
    assert read(raw) == (PAYLOADS, [])


def test_one_bad_record_of_a_member_costs_that_record_alone():
    bad = RECORDS[4].replace(b"xxx", b"yyy", 1)
    raw = gzip_member(b"".join([*RECORDS[:4], bad, *RECORDS[5:]])) + gzip_member(RECORDS[0])
    payloads, gaps = read(raw)
    at = sum(map(len, RECORDS[:4]))
    assert payloads == PAYLOADS[:4] + PAYLOADS[5:] + PAYLOADS[:1]
    assert gaps == [(0, None, at, len(bad))]


def test_member_cut_off_or_with_a_bad_trailer_keeps_what_its_digests_confirm():
    whole = gzip_member(b"".join(RECORDS))
    payloads, gaps = read(whole[:-3])
    assert payloads == PAYLOADS and [g[0] for g in gaps] == [0]
    payloads, gaps = read(whole[:-8] + b"\0" * 8 + gzip_member(RECORDS[3]))
    assert payloads == [*PAYLOADS, PAYLOADS[3]] and gaps == [(0, len(whole), None, None)]


def test_plain_records_with_damage_and_a_long_header():
    long = RECORDS[2].replace(b"\r\n", b"\r\nX-Note: " + b"n" * 3_000_000 + b"\r\n", 1)
    assert read(RECORDS[0] + long + RECORDS[1]) == ([PAYLOADS[0], PAYLOADS[2], PAYLOADS[1]], [])
    payloads, gaps = read(RECORDS[0] + b"noise" * 40_000 + RECORDS[1] + RECORDS[5][:-30] + RECORDS[6])
    assert payloads == [PAYLOADS[0], PAYLOADS[1], PAYLOADS[6]]
    assert [g[:2] for g in gaps] == [(len(RECORDS[0]), 200_000), (len(RECORDS[0] + RECORDS[1]) + 200_000, len(RECORDS[5]) - 30)]


def test_damage_at_every_byte_of_a_short_archive():
    raw = b"".join(map(gzip_member, RECORDS[:3]))
    second = len(gzip_member(RECORDS[0])), len(gzip_member(RECORDS[0])) + len(gzip_member(RECORDS[1]))
    for i in range(*second):
        damaged = bytearray(raw)
        damaged[i] ^= 0x55
        payloads, _ = read(bytes(damaged))
        assert payloads[0] == PAYLOADS[0] and payloads[-1] == PAYLOADS[2]
        assert all(p in PAYLOADS for p in payloads)


def test_empty_archive():
    assert read(b"") == ([], [])
