"""Subword ids and counts with the public tokenizer files, by pre-token and with worker caches.

Both tokenizers used here split a text before a run of spaces' last space
(byte-level) or before each run of spaces (piece) and never join across it, so
the ids of a text are those of its chunks in order. The caches only save time:
a chunk that is not cached is encoded by the library.
"""

from __future__ import annotations

import base64
import itertools
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Entries of a worker's cache; beyond it, new chunks are encoded without being kept.
CACHE = 150_000


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class ByteIds:
    """Ids of the byte-level BPE, as the ``tokenizers`` library gives them without added special tokens.

    Chunks that are not cached are encoded by that library, but for plain words:
    Latin letters with at most one mark behind are the same two pre-tokens in
    any Unicode version, and their merges come from the same vocabulary as
    ranks, which ``tiktoken`` applies several times faster.
    """

    plain = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+[.,|:;!?]?")

    def __init__(self, path: str, ranks: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(ranks, "rb") as f:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ranked = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=merges, special_tokens={})
        self.width = np.zeros(max(merges.values()) + 1, np.int64)
        self.width[list(merges.values())] = list(map(len, merges))
        self.code: dict[str, int] = {}
        self.start, self.size = np.empty(CACHE, np.int64), np.empty(CACHE, np.int64)
        self.pool, self.filled = np.empty(CACHE, np.uint32), 0

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks " word" in turn, and how many each has."""
        easy = [bool(self.plain.fullmatch(w)) for w in words]
        plain = [w for w, e in zip(words, easy, strict=True) if e]
        ids = np.array(self.ranked.encode_ordinary("".join([" " + w for w in plain])), np.uint32)
        at = np.cumsum(self.width[ids]) - self.width[ids]
        chars = np.fromiter((len(w.encode()) + 1 for w in plain), np.int64, len(plain))
        first = np.searchsorted(at, np.cumsum(chars) - chars)
        size = np.empty(len(words), np.int64)
        easy = np.array(easy, bool)
        size[easy] = np.diff(np.append(first, len(ids)))
        if easy.all():
            return ids, size
        rest = [e.ids for e in self.whole.encode_batch_fast([" " + words[i] for i in np.flatnonzero(~easy)], add_special_tokens=False)]
        size[~easy] = list(map(len, rest))
        out = np.empty(size.sum(), np.uint32)
        from_plain = np.repeat(easy, size)
        out[from_plain] = ids
        out[~from_plain] = [x for r in rest for x in r]
        return out, size

    def _look_up(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A pool of ids, and where in it each chunk " word" starts and how many it has."""
        codes = np.fromiter(map(self.code.get, words, itertools.repeat(-1)), np.int64, len(words))
        missed = np.flatnonzero(codes < 0)
        start, size = self.start[codes], self.size[codes]
        if not len(missed):
            return self.pool, start, size
        new = [words[i] for i in missed]
        ids, n = self._encode(new)
        at = np.cumsum(n) - n
        start[missed], size[missed] = self.filled + at, n
        if self.filled + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.filled], np.empty(len(self.pool) + len(ids), np.uint32)])
        self.pool[self.filled : self.filled + len(ids)] = ids
        keep = min(len(new), CACHE - len(self.code))
        if keep and max(map(len, new[:keep])) < 1000:
            have = len(self.code)
            self.start[have : have + keep], self.size[have : have + keep] = self.filled + at[:keep], n[:keep]
            self.code.update(zip(new[:keep], range(have, have + keep), strict=True))
            self.filled += int(n[:keep].sum())
        return self.pool, start, size

    def batch(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text (null: none) as unsigned 32-bit."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring(texts, "  ").to_numpy(zero_copy_only=False)
        split = pc.split_pattern(pc.if_else(pa.array(odd), "", texts), " ")
        words = split.values.dictionary_encode()
        pool, start, size = self._look_up(words.dictionary.to_pylist())
        code = words.indices.to_numpy(zero_copy_only=False)
        bounds = split.offsets.to_numpy()
        heads = self.whole.encode_batch_fast(pc.list_element(split, 0).to_pylist() if len(split) else [], add_special_tokens=False)
        out = []
        for i in range(len(texts)):
            if odd[i]:
                out.append(np.array(self.whole.encode(texts[i].as_py(), add_special_tokens=False).ids, np.uint32))
                continue
            own = code[bounds[i] + 1 : bounds[i + 1]]
            n = size[own]
            at = np.repeat(start[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            out.append(np.concatenate([np.array(heads[i].ids, np.uint32), pool[at]]))
        return out


class PieceCounts:
    """Token counts of the piece BPE: a given table of frequent pre-tokens first, then a worker's cache, then the library.

    A pre-token is a run of spaces and what follows up to the next space. But for
    pieces of spaces alone, none has a space behind another character, so no token
    crosses two pre-tokens and the counts add up. The model spells a space as
    U+2581; a text that holds that character itself goes to the library whole, as
    the two may meet in one piece.
    """

    def __init__(self, path: str, frequent: dict[str, int]):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.frequent = frequent
        self.cache: dict[str, int] = {}

    def batch(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text (null: none)."""
        texts = pc.fill_null(texts, "")
        odd = pc.or_(pc.match_substring(texts, "  "), pc.starts_with(texts, " "))
        odd = pc.or_(odd, pc.or_(pc.ends_with(texts, " "), pc.match_substring(texts, "\u2581"))).to_numpy(zero_copy_only=False)
        split = pc.split_pattern(pc.if_else(pa.array(odd), "", texts), " ")
        words = split.values.dictionary_encode()
        listed = words.dictionary.to_pylist()
        frequent, cache = self.frequent, self.cache
        count = [frequent.get(w) or cache.get(w) for w in listed]
        missed = [i for i, n in enumerate(count) if n is None]
        for i, ids in zip(missed, self.model.encode([listed[i] for i in missed], num_threads=1), strict=True):
            count[i] = len(ids)
            if len(cache) < CACHE and len(listed[i]) < 100:
                cache[listed[i]] = len(ids)
        per_word = np.array(count, np.int64)[words.indices.to_numpy(zero_copy_only=False)] if listed else np.empty(0, np.int64)
        ends = np.concatenate([[0], np.cumsum(per_word)])
        bounds = split.offsets.to_numpy()
        out = ends[bounds[1:]] - ends[bounds[:-1]]
        for i in np.flatnonzero(odd):
            out[i] = len(self.model.encode(texts[int(i)].as_py()))
        return out


@lru_cache(maxsize=2)
def byte_ids(path: str) -> ByteIds:
    import public_tokenizers

    return ByteIds(path, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


_COUNTS: dict[str, PieceCounts] = {}


def piece_counts(path: str, frequent: dict[str, int]) -> PieceCounts:
    if path not in _COUNTS:
        _COUNTS[path] = PieceCounts(path, frequent)
    return _COUNTS[path]
