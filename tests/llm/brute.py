"""Plain versions of the operators' contracts, for small tables."""

from __future__ import annotations

import hashlib
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def lowered(text: str | None) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text: str | None, k: int) -> frozenset:
    w = words(lowered(text))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def components(docs: list[tuple[int, str | None]], k: int, percent: int) -> dict[int, tuple[int, int]]:
    """doc_id -> (set size, component)."""
    sets = {i: shingles(t, k) for i, t in docs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holders: dict = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    shared: dict = {}
    for own in holders.values():
        for n, a in enumerate(own):
            for b in own[n + 1 :]:
                shared[a, b] = shared.get((a, b), 0) + 1
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def quality_base(text: str | None) -> dict:
    w = words(text)
    windows: dict = {}
    for i in range(len(w) - 2):
        windows.setdefault(tuple(w[i : i + 3]), []).append(i)
    again = {j for at in windows.values() if len(at) > 1 for i in at for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return {
        "n_words": len(w),
        "word_chars": sum(map(len, w)),
        "n_symbols": sum(len(re.findall(r"[#*$%&|<>]", x)) for x in w),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(again),
        "base_failed": len(w) < 50 or 100 * len(again) > 50 * len(w),
    }


def covered(docs: list[tuple[int, str | None]], length: int) -> list[tuple]:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each row."""
    raw = [(i, (t or "").encode()) for i, t in docs]
    seen: dict[bytes, int] = {}
    for _, b in raw:
        for a in range(len(b) - length + 1):
            h = b[a : a + length]
            seen[h] = seen.get(h, 0) + 1
    out = []
    for i, b in raw:
        gone = bytearray(len(b))
        for a in range(len(b) - length + 1):
            if seen[b[a : a + length]] > 1:
                gone[a : a + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def packed_ids(docs: list[tuple[int, str | None]], end: int = 1) -> dict[int, bytes]:
    """doc_id -> its ids as little-endian unsigned 32-bit."""
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = False
    return {i: b"".join(x.to_bytes(4, "little") for x in [*t.encode(x or "", add_special_tokens=False).ids, end]) for i, x in docs}


def piece_counts(docs: list[tuple[int, str | None]]) -> dict[int, int]:
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor

    m = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    return {i: len(m.encode(t or "")) for i, t in docs}


def crc(raw: bytes) -> int:
    return zlib.crc32(raw)
