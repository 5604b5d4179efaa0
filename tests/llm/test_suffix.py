"""Suffix dedup of texts of several chunks, and of a long periodic text."""

from __future__ import annotations

import random
import string

import brute

from quillstream.llm.suffix_dedup import repeat_groups, suffix_dedup


def _got(spark, texts):
    df = suffix_dedup(spark.createDataFrame(texts, "doc_id long, text string"))
    return sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect())


def test_nothing_of_a_long_unique_text_goes(spark):
    text = "".join(random.Random(1).choices(string.ascii_letters + " ", k=(2 << 20) + 5000))
    ((_, size, removed, spans, _),) = _got(spark, [(0, text)])
    assert (size, removed, spans) == (len(text), 0, 0)


def test_repetition_at_a_chunk_boundary_goes(spark):
    text = "".join(random.Random(2).choices(string.ascii_letters + " ", k=(1 << 20) + 5000))
    at = (1 << 20) - 300
    ((i, _, removed, spans, _), (j, *other)) = _got(spark, [(0, text), (1, text[at : at + 500])])
    assert (i, removed, spans) == (0, 500, 1)
    assert (j, other[:3]) == (1, [500, 500, 1])


def test_periodic_text(spark):
    texts = [(10, "y " * 60_000)]
    assert _got(spark, texts) == sorted(brute.covered(texts, 200))


def test_groups_hold_all_occurrences_and_explain_what_goes(spark):
    """Each group is one string with every place it starts at, differing on both sides within reach; together they cover what is removed."""
    rng = random.Random(6)
    base = "".join(rng.choices("ab c", k=900))
    texts = []
    for i in range(14):
        own = list(base)
        for _ in range(rng.randrange(4)):
            own[rng.randrange(900)] = rng.choice("xyz")
        texts.append((i, "".join(own)[rng.randrange(200) :]))
    groups: dict = {}
    for r in repeat_groups(spark.createDataFrame(texts, "uid long, text string"), 200).collect():
        groups.setdefault(r["repeat"], set()).add((r["uid"], r["start"], r["length"]))
    raw = dict(texts)
    strings = set()
    for own in groups.values():
        held = {raw[u][a : a + n] for u, a, n in own}
        assert len(held) == 1 and len(own) >= 2
        (string,) = held
        assert len(string) >= 200 and string not in strings
        strings.add(string)
        assert {(u, a) for u, a, _ in own} == {(u, a) for u, t in texts for a in range(len(t) - len(string) + 1) if t.startswith(string, a)}
    for (i, _, removed, *_), (u, t) in zip(sorted(brute.covered(texts, 200)), texts, strict=True):
        gone = {b for own in groups.values() for v, a, n in own if v == u for b in range(a, a + n)}
        assert (i, removed) == (u, len(gone))
