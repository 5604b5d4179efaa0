"""The registered queries against brute-force versions, on whole small tables and on awkward rows."""

from __future__ import annotations

import hashlib
import random
import re

import brute
import pytest
from pyspark.sql import functions as F

from quillstream.llm import queries as Q
from quillstream.llm.ngram_join import ngram_components, one_of_each
from quillstream.llm.packing import pack
from quillstream.llm.quality import NOTICE_WORDS, NOTICES, quality
from quillstream.llm.suffix_dedup import suffix_dedup
from quillstream.llm.token_counts import token_counts
from quillstream.llm.warc import archive_round_trip, read_warc, write_warc

DOCS = "doc_id long, text string, lang string, source string, n_chars int, cls long, token string"


@pytest.fixture(scope="module")
def rows(spark, small):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]


def odd_rows() -> list[tuple]:
    """Nulls, empty and long texts, ties, repeated rows and columns with clashing names."""
    rng = random.Random(7)
    base = " ".join(rng.choice(("alpha", "beta", "gamma", "delta", "épsilon", "zeta")) + str(rng.randrange(40)) for _ in range(400))
    texts = [None, "", " \t\n", "one", "one two", base, base, base.upper(), base + " tail", "x" * 300_000, "y " * 60_000, base[:900] + " middle " + base[:900], "  two  spaces  ", "<s>a</s> <|endoftext|> b", "日本語 テキスト。\n\n日本語 テキスト。"]
    return [(i, t, "en", None, None, 5, "t") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS)


@pytest.fixture(scope="module")
def odd_texts():
    return [(r[0], r[1]) for r in odd_rows()]


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_token_counts(spark, small, rows, odd, odd_texts, none):
    for df, texts in ((Q.op1_token_counts(spark, small), rows), (token_counts(odd), odd_texts)):
        want = brute.piece_counts(texts)
        assert {(r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in df.collect()} == {(i, len((t or "").encode()), want[i], want[i] > 4096) for i, t in texts}
    assert token_counts(none).count() == 0


def test_ngram_components(spark, small, rows, odd, odd_texts, none):
    for df, texts, k, percent in ((Q.op2_ngram_join(spark, small), rows, 3, 90), (ngram_components(odd, 3, 90), odd_texts, 3, 90), (ngram_components(odd), odd_texts, 5, 80)):
        want = brute.components(texts, k, percent)
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()} == want
    assert ngram_components(none).count() == 0


def test_ngram_components_of_a_family_of_edits(spark):
    """Copies of one text with up to five edits each: few link with each other, most with the plain copy."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(140)]
    texts = []
    for i in range(400):
        own = list(base)
        for _ in range(rng.randrange(6)):
            own[rng.randrange(140)] = f"e{rng.randrange(10**6)}"
        texts.append((i, " ".join(own)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_components(spark.createDataFrame(texts, "doc_id long, text string"), 3, 90).collect()}
    assert got == brute.components(texts, 3, 90)


def test_one_of_each_group_stays(spark, odd, odd_texts):
    kept = one_of_each(odd)
    assert kept.columns == odd.columns
    want = brute.components(odd_texts, 5, 80)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, (_, c) in want.items() if i == c)


def test_quality_base(spark, small, rows, odd, odd_texts, none):
    for df, texts in ((Q.op3_quality_rules(spark, small), rows), (quality(odd), odd_texts)):
        got = df.collect()
        assert {r["doc_id"]: tuple(r[c] for c in brute.quality_base("")) for r in got} == {i: tuple(brute.quality_base(t).values()) for i, t in texts}
        assert not any(r["kept"] and r["base_failed"] for r in got)
    assert quality(none).count() == 0


def test_quality_is_native(spark, small):
    plan = Q.op3_quality_rules(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def _packs(df, texts):
    ids, seen, places = brute.packed_ids(texts), {}, set()
    for r in sorted(df.collect(), key=lambda r: (r["doc_id"], r["start"])):
        raw = ids[r["doc_id"]]
        assert r["doc_tokens"] * 4 == len(raw) and r["start"] == seen.get(r["doc_id"], 0)
        assert r["ids_crc32"] == brute.crc(raw[4 * r["start"] : 4 * (r["start"] + r["length"])])
        assert r["length"] <= 2048 and r["length"] & (r["length"] - 1) == 0 and r["offset"] == 0
        seen[r["doc_id"]] = r["start"] + r["length"]
        places.add(r["sequence_id"])
    assert seen == {i: len(raw) // 4 for i, raw in ids.items()}
    assert places == set(range(len(places)))


def test_packing(spark, small, rows, odd, odd_texts, none):
    _packs(Q.op5_packing(spark, small), rows)
    _packs(pack(odd), odd_texts)
    assert pack(none).count() == 0


def test_suffix_dedup(spark, small, rows, odd, odd_texts, none):
    for df, texts in ((Q.op8_suffix_dedup(spark, small), rows), (suffix_dedup(odd), odd_texts)):
        got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect()]
        assert sorted(got) == sorted(brute.covered(texts, 200))
    assert suffix_dedup(none).count() == 0


def _pages(texts):
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) as the contract says."""
    raw = {i: (h or "").encode() for i, h in texts}
    last: dict = {}
    for i, b in raw.items():
        last[b] = max(i, last.get(b, i))
    return sorted(((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if len(b) >= 1000 and last[b] != i else "response", last[b] if len(b) >= 1000 and last[b] != i else None) for i, b in raw.items()), key=repr)


def test_warc(spark, small):
    pages = [(r["page_id"], r["html"]) for r in spark.read.parquet(f"{small}/pages.parquet").collect()]
    got = [tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in Q.op10_warc(spark, small).collect()]
    assert sorted(got, key=repr) == _pages(pages)


def test_warc_salvages_what_follows_damage(spark, tmp_path):
    texts = [(0, None), (1, ""), *((i, f"<p>{i % 4}</p>" + "é" * 700) for i in range(2, 40)), (40, "z" * 3_000_000)]
    pages = spark.createDataFrame([(i, None if i == 3 else f"http://h/{i}", h, 1) for i, h in texts], "page_id long, url string, html string, name int").coalesce(1)
    folder = f"file://{tmp_path}/warc"
    files = write_warc(pages, folder)
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    whole = read_warc(files, folder)
    assert sorted((tuple(r) for r in whole.select(cols).collect()), key=repr) == _pages(texts)
    assert {r["page_id"]: bytes(r["payload"]) for r in whole.filter("record_type = 'response'").collect()}[40] == b"z" * 3_000_000
    places = {r["page_id"]: (r["offset"], r["bytes"]) for r in whole.collect()}
    (name,) = [r["name"] for r in files.collect()]
    path = tmp_path / "warc" / name
    raw = bytearray(path.read_bytes())
    at, size = places[10]
    raw[at + 2 : at + size // 2] = b"\0" * (size // 2 - 2)
    path.write_bytes(bytes(raw))
    again = read_warc(files, folder)
    assert {r["page_id"] for r in again.filter("gap_reason is null").collect()} == set(places) - {10}
    (gap,) = again.filter("gap_reason is not null").collect()
    assert (gap["offset"], gap["bytes"]) == (at, size)
    path.write_bytes(bytes(raw[: places[38][0] + 7]))
    assert read_warc(files, folder).filter("gap_reason is not null").agg(F.max("offset")).first()[0] == places[38][0]


def test_token_counts_of_random_texts(spark):
    """Runs of spaces and the character that spells a space in the model, beside letters of several scripts."""
    rng = random.Random(5)
    parts = (" ", "  ", "\u2581", "\u2581\u2581", "日", "a", "the", "é", "\n", "\t", ".", "word")
    texts = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(12)))) for i in range(4000)]
    want = brute.piece_counts(texts)
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts(spark.createDataFrame(texts, "doc_id long, text string")).collect()} == want


def _fails(line):
    """The line rules of the quality operator, plainly."""
    words = line.split()
    if not words:
        return False
    marks = sum(line.count(c) for c in "|»›•")
    shouted = len(re.findall(r"[#*$%&<>!]{2,}", line))
    ended = re.search(r"[.!?…。！？:;][\"'”’»)\]]*(\s|$)", line)
    notice = len(words) <= NOTICE_WORDS and any(n in line.lower() for n in NOTICES)
    return 3 * marks >= max(len(words), 6) or 2 * shouted >= len(words) or not ended or notice


def test_quality_verdict(spark, small, rows):
    got = {r["doc_id"]: (r["kept"], r["n_lines_removed"], r["chars_removed"]) for r in Q.op3_quality_rules(spark, small).collect()}
    for i, text in rows:
        base = brute.quality_base(text)
        gone = [x for x in (text or "").split("\n") if _fails(x)]
        chars = sum(len("".join(x.split())) for x in gone)
        assert got[i] == (not base["base_failed"] and 100 * chars <= 30 * base["word_chars"], len(gone), chars)
    assert sum(k for k, *_ in got.values()) > 0.5 * len(got)


def test_repeated_rows_null_ids_and_clashing_columns(spark):
    """Every operator on rows that repeat, that share an id, that have none, and that bring columns of the operators' own names."""
    rng = random.Random(9)
    long = " ".join(f"w{rng.randrange(500)}" for _ in range(120))
    other = " ".join(f"v{rng.randrange(500)}" for _ in range(120))
    texts = [(1, long), (1, long), (1, other), (None, long), (None, None), (2, "a"), (2, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    for name in ("n_bytes", "n_tokens", "kept", "uid", "key", "u", "cls", "n", "row", "length", "offset", "spans", "component_id", "h"):
        docs = docs.withColumn(name, F.lit("own"))
    tokens = brute.piece_counts(list(enumerate(t for _, t in texts)))
    count = lambda df, *c: sorted((tuple(r[x] for x in c) for r in df.collect()), key=repr)
    assert count(token_counts(docs), "doc_id", "n_tokens") == sorted(((i, tokens[k]) for k, (i, _) in enumerate(texts)), key=repr)
    n = len(set(zip(long.split(), long.split()[1:], long.split()[2:])))
    m = len(set(zip(other.split(), other.split()[1:], other.split()[2:])))
    assert count(ngram_components(docs, 3, 90), "doc_id", "n_shingles", "component_id") == sorted([(1, n, 1), (1, n, 1), (1, m, 1), (None, n, None), (None, 0, None), (2, 1, 2), (2, 0, 2)], key=repr)
    assert count(quality(docs), "doc_id", "n_words") == sorted(((i, len((t or "").split())) for i, t in texts), key=repr)
    want = brute.covered(texts, 200)
    assert count(suffix_dedup(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(want, key=repr)
    ids = [len(brute.packed_ids([(0, t)])[0]) // 4 for _, t in texts]
    packed = pack(docs)
    assert packed.agg(F.sum("length")).first()[0] == sum(ids) and packed.select("sequence_id").distinct().count() == packed.count()
    pages = spark.createDataFrame([(7, "u", long * 3), (7, "u", long * 3), (8, None, long * 3), (None, "u", long * 3), (9, "u", None)], "page_id long, url string, html string").withColumn("digest", F.lit("own"))
    got = count(archive_round_trip(pages), "page_id", "record_type", "refers_to")
    assert got == sorted([(7, "revisit", 8), (7, "revisit", 8), (8, "response", None), (None, "response", None), (9, "response", None)], key=repr)
    assert archive_round_trip(pages.limit(0)).count() == 0
