"""Decontamination finds every match that its threshold allows."""

from __future__ import annotations

import random
import re
from itertools import combinations

import numpy as np
import pytest

from quillstream.llm import queries as Q
from quillstream.llm.decontaminate import Seeds, leaks, masks, without_leaks
from quillstream.llm.substring_dedup import letter_words


def _hashed(words):
    return letter_words(np.frombuffer(" ".join(words).encode(), np.uint8))[0]


@pytest.mark.parametrize("n", range(1, 21))
def test_every_substitution_pattern_leaves_a_mask(n):
    """All placements of the words that may differ: recall is 1 at the threshold itself."""
    allowed = n - -(-80 * n // 100)
    for gone in combinations(range(n), allowed):
        assert any(not {at + i for i in mask} & set(gone) for mask in masks(n, 80) for at in range(n - mask[-1]))


def test_masks_are_spaced():
    assert all(len(m) < m[-1] + 1 for m in masks(20, 80))
    assert masks(30, 50) == (tuple(range(1)),) and masks(4, 80) == (tuple(range(4)),)


@pytest.mark.parametrize("n", [5, 10, 13, 16, 17, 20])
def test_every_substitution_pattern_is_found(n):
    item = [f"w{i}" for i in range(n)]
    seeds = Seeds([(7, " ".join(item))])
    allowed = n - -(-80 * n // 100)
    for gone in combinations(range(n), allowed):
        text = ["before", "it", *(f"x{i}" if i in gone else w for i, w in enumerate(item)), "after"]
        assert seeds.leaks(_hashed(text)) == [(7, 2, 0, n, n - allowed)]
    assert seeds.leaks(_hashed(["x"] * (allowed + 1) + item[allowed + 1 :])) == []


def _brute(docs, items):
    lower = {c: c + 32 for c in range(65, 91)}
    cut = re.compile(r"[0-9A-Za-z\u0080-\U0010ffff]+")
    code: dict = {}
    split = [[(i, np.array([code.setdefault(w.translate(lower), len(code)) for w in cut.findall(t or "")], np.int64)) for i, t in side] for side in (docs, items)]
    out = set()
    for i, text in split[0]:
        for j, item in split[1]:
            n, best = min(20, len(item)), None
            for own in range(len(item) - n + 1):
                if 0 < n <= len(text):
                    equal = (np.lib.stride_tricks.sliding_window_view(text, n) == item[own : own + n]).sum(1)
                    at = int(equal.argmax())
                    if 100 * equal[at] >= 80 * n:
                        found = (-int(equal[at]), at, own, n)
                        best = min(best or found, found)
            if best:
                out.add((i, j, best[1], best[2], best[3], -best[0]))
    return out


def test_query_against_brute(spark, small):
    docs, items = ([tuple(r) for r in spark.read.parquet(f"{small}/{t}.parquet").select(key, "text").collect()] for t, key in (("documents", "doc_id"), ("benchmark", "item_id")))
    got = [tuple(r) for r in Q.op7_decontamination(spark, small).collect()]
    assert len(got) == len(set(got))
    assert set(got) == _brute(docs, items)


def test_long_items_against_brute():
    rng = random.Random(4)
    items = [(i, " ".join(f"v{rng.randrange(9)}" for _ in range(rng.randrange(1, 60)))) for i in range(30)]
    docs = [(i, " ".join(f"v{rng.randrange(9)}" for _ in range(80)) + " " + rng.choice(items)[1]) for i in range(20)]
    seeds = Seeds(items)
    assert {(i, *hit) for i, t in docs for hit in seeds.leaks(_hashed(t.split()))} == _brute(docs, items)


def test_odd_rows(spark):
    """Nulls, empty and long texts, ties, repeated rows and ids, a null id, empty tables, clashing columns."""
    item = " ".join(f"w{i}" for i in range(20))
    texts = [(1, None), (2, ""), (3, item), (3, item), (3, "other"), (None, item), (4, "x " * 200_000 + item + " y" * 100_000), (5, f"{item} {item}"), (6, "w1 w2 w3")]
    docs = spark.createDataFrame([(i, t, 7, 8) for i, t in texts], "doc_id long, text string, item_id int, n_equal int")
    items = spark.createDataFrame([(1, item, 0), (2, None, 0), (3, "", 0), (None, item, 0)], "item_id long, text string, doc_id int")
    got = [(r["doc_id"], r["item_id"], r["word"]) for r in leaks(docs, items).collect()]
    want = [(3, 0), (3, 0), (None, 0), (4, 200_000), (5, 0)]
    assert sorted(got, key=repr) == sorted([(i, j, at) for i, at in want for j in (1, None)], key=repr)
    kept = without_leaks(docs, items)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect() if r["text"]) == [(3, "other"), (6, "w1 w2 w3")] and kept.count() == 4
    none = spark.createDataFrame([], docs.schema)
    assert leaks(none, items).count() == without_leaks(none, items).count() == 0
    assert leaks(docs, items.limit(0)).count() == 0 and without_leaks(docs, items.limit(0)).count() == len(texts)


def test_short_items_and_many_blocks(spark, monkeypatch):
    """Items of few words are no leak; many blocks of items, one after another, give what one gives."""
    rng = random.Random(8)
    items = [(i, " ".join(f"v{rng.randrange(30)}" for _ in range(rng.randrange(1, 40)))) for i in range(40)] + [(99, "yes"), (98, "the answer")]
    docs = [(i, " ".join(f"v{rng.randrange(30)}" for _ in range(40)) + " yes the answer " + rng.choice(items)[1]) for i in range(60)]
    d, t = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = _brute(docs, [x for x in items if len(x[1].split()) >= 8])
    one = {tuple(r) for r in leaks(d, t).collect()}
    kept = {r["doc_id"] for r in without_leaks(d, t).collect()}
    assert one == want and kept == {i for i, _ in docs} - {i for i, *_ in want} and 0 < len(kept) < 60
    monkeypatch.setattr("quillstream.llm.decontaminate.BLOCK_CHARS", 900)
    assert {tuple(r) for r in leaks(d, t).collect()} == want
    assert {r["doc_id"] for r in without_leaks(d, t).collect()} == kept
