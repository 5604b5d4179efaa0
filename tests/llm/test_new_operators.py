"""Periodic runs, filter audit and sharding against brute-force versions, on whole small tables and on awkward rows."""

from __future__ import annotations

import bisect
import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from compare import duck_rows, spark_rows
from pyspark.sql import functions as F

from quillstream.llm import kd_shards as K
from quillstream.llm import queries as Q
from quillstream.llm.filter_audit import audit
from quillstream.llm.kd_shards import kd_shards
from quillstream.llm.periodic_runs import find_runs, periodic_runs, run_digests, with_planted_runs

DOCS = "doc_id long, text string, lang string, source string, n_chars int, runs string, mask string, key string, shard int"


def brute_runs(w, least=6, times=4):
    """(start, length, period) of every run, trying every period at every place."""
    out = []
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            u = w[i : j + q]
            if len(u) >= max(least, times * q) and not any(u[p:] == u[:-p] for p in range(1, q)):
                out.append((i, len(u), q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted(i, text):
    w = brute.words(text)
    n, h = len(w), zlib.crc32(str(i).encode())
    g = h // 10
    if i is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[x] if x < a else w[a + (x - a) % p] for x in range(n)]
    return w


def digests(i, text):
    """The row of the contract."""
    w = planted(i, text)
    runs = brute_runs(w)
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    gone = {x for s, m, q in runs for x in range(s + q, s + m)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (i, len(runs), *(top or (None, None, None)), top and 1000 * top[1] // top[2], sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


DIGESTS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def odd_rows():
    """Nulls, empty and long texts, ties, repeated rows and columns with clashing names."""
    rng = random.Random(4)
    base = " ".join(rng.choice("abc") for _ in range(700))
    loop = " ".join(["x y z w"] * 9)
    texts = [None, "", " \t\n", "one", "a a a a a", "a a a a a a", "a  a\ta\na a a a", loop, loop + " q " + loop, base, base, base.upper() + " #", "y " * 20_000, " ".join(["é ü"] * 5), (loop + " ") * 30, "A" * 50 + " " + base]
    rows = [(i, t, "en", None if i % 3 else f"s{i % 2}", None, "own", "own", "own", 7) for i, t in enumerate(texts)]
    return rows + [rows[9], rows[9], (None, base, None, "", 1, "o", "o", "o", 1), (None, base, None, "s1", 1, "o", "o", "o", 1), (-5, "tail", "fr", "s1", 1, "o", "o", "o", 1)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS)


def test_runs_of_random_sequences():
    rng = random.Random(1)
    for k in range(4000):
        few = lambda n, m: [rng.randrange(m) for _ in range(rng.randrange(n))]
        a, b = few(4, 2), few(4, 2)
        u = a * rng.randrange(1, 6) + b * rng.randrange(1, 6)
        w = [few(120, rng.choice((1, 2, 3))), few(9, 5) + few(20, 3) * rng.randrange(1, 8) + few(9, 5), (u * rng.randrange(1, 6) + a * 3) * rng.randrange(1, 3), sum((few(5, 3) * rng.randrange(1, 9) for _ in range(5)), []) * rng.randrange(1, 4)][k % 4][:260]
        assert find_runs(np.array(w, np.int32)) == brute_runs(w), w


def test_runs_need_four_copies():
    with pytest.raises(ValueError):
        find_runs(np.zeros(9, np.int32), times=3)


def test_periodic_runs(spark, small, odd):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = Q.op11_periodic_runs(spark, small)
    want = [digests(i, t) for i, t in rows]
    assert sorted(tuple(r[c] for c in DIGESTS) for r in got.collect()) == sorted(want)
    assert sum(w[1] > 0 for w in want) > 10
    some = [(i, t) for i, t, *_ in odd_rows() if not t or len(t) < 9000]
    got = run_digests(periodic_runs(with_planted_runs(odd.filter("text is null or length(text) < 9000"))))
    assert sorted((tuple(r[c] for c in DIGESTS) for r in got.collect()), key=repr) == sorted((digests(i, t) for i, t in some), key=repr)
    assert run_digests(periodic_runs(with_planted_runs(odd.limit(0)))).count() == 0


def test_periodic_runs_collapse_texts(odd):
    got = {r["doc_id"]: r for r in periodic_runs(odd).collect()}
    assert got[12]["runs"] == [(0, 20_000, 1)] and got[12]["collapsed"] == "y"
    assert got[8]["collapsed"] == "x y z w q x y z w" and got[1]["collapsed"] == "" and got[4]["runs"] == []
    assert got[6]["collapsed"] == "a" and got[6]["n_words"] == 7


def brute_audit(docs, labels):
    """{(part, order, step): figures}, each order applied document by document."""
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, x in labels if x == 1}
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    fails = []
    for i, t, source in docs:
        w, t = brute.words(t), t or ""
        mask = {x for x, y in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), bool(set(t) & set("#$%&*|")), i is not None and i > first[t]), strict=True) if y}
        fails.append((source or "", mask, i in good, i in toxic))
    out, shapley = defaultdict(Counter), Counter()
    orders = ["".join(p) for p in itertools.permutations("ABCDE")]
    for part, mask, g, x in fails:
        for order in orders:
            gone = False
            for step, f in enumerate(order, 1):
                c = out[part, order, step]
                here = not gone and f in mask
                c.update(removed=here, redundant=gone and f in mask, unique_fails=mask == {f}, good_lost=here and g, toxic_lost=here and x)
                gone |= here
                c["kept"] += not gone
                shapley[part, f] += here
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    return {(p, o, s): (*(c[n] for n in names), shapley[p, o[s - 1]]) for (p, o, s), c in out.items()}


def figures(df):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in df.collect()}


def test_audit_of_odd_rows(spark, odd):
    labels = [(1, 1, 0), (1, 0, 1), (9, 1, None), (10, None, 1), (12, 0, 0), (99, 1, 1), (None, 1, 1), (15, 1, 1)]
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("mask", F.lit("own"))
    docs = [(r[0], r[1], r[3]) for r in odd_rows()]
    assert figures(audit(odd, said)) == brute_audit(docs, [x for x in labels if x[0] is not None])
    assert {k[0] for k in figures(audit(odd, said.limit(0)))} == {"", "s0", "s1"}
    assert audit(odd.limit(0), said).count() == 0


def test_audit_of_random_rows(spark):
    rng = random.Random(6)
    texts = ["", "x" * 30, "A b", " ".join(f"w{i}" for i in range(220)), " ".join("no yes".split() * 110), "# " + " ".join(f"v{i}" for i in range(230)), "C" + " D" * 250]
    docs = [(rng.randrange(-50, 200), rng.choice(texts), rng.choice(("p", "q", None))) for _ in range(400)]
    labels = [(i, rng.randrange(2), rng.randrange(2)) for i in range(-50, 150)]
    got = audit(spark.createDataFrame(docs, "doc_id long, text string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert figures(got) == brute_audit(docs, labels)


def test_audit_equals_sql(spark, duck, medium):
    assert spark_rows(Q.op12_filter_audit(spark, medium)) == duck_rows(duck, Q.oracle_sql()["op12_filter_audit"])


def brute_tree(rows, shards, axes, first=0):
    """{row: shard}: sorted by the widest axis and cut after the document that comes nearest to the share of bytes."""
    if shards == 1 or not rows:
        return {r["row"]: first for r in rows}
    axis = max(range(axes), key=lambda i: (max(r[f"k{i}"] >> K.OWN for r in rows) - min(r[f"k{i}"] >> K.OWN for r in rows), -i))
    rows = sorted(rows, key=lambda r: r[f"k{axis}"])
    upto = np.cumsum([r["size"] for r in rows])
    half = shards // 2
    goal = upto[-1] * half / shards
    at = bisect.bisect_left(upto.tolist(), goal)
    before = int(upto[at - 1]) if at else 0
    cut = at if goal - before <= upto[at] - goal else at + 1
    return brute_tree(rows[:cut], half, axes, first) | brute_tree(rows[cut:], shards - half, axes, first + half)


def test_tree_is_that_of_exact_medians(spark, small, monkeypatch):
    monkeypatch.setattr(K, "CLOSE", 0)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    _, rows = K.metadata(docs, ("source", "lang"), ("doc_id",))
    own = [r.asDict() for r in rows.collect()]
    tree = K.grow(rows, 4, 24)
    got = rows.select("row", K.place_in(tree, lambda leaf: F.lit(leaf.first)).alias("shard")).collect()
    assert {r["row"]: r["shard"] for r in got} == brute_tree(own, 24, 4)


def laid_out(df, texts, shards=24):
    got = df.collect()
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in got if r["doc_id"] is not None) == sorted((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in texts if i is not None)
    assert len(got) == len(texts) and all(r["law"] == "bytes" and r["grown_shard"] is None for r in got)
    slots, size = defaultdict(list), Counter({k: 0 for k in range(shards)})
    for r in got:
        slots[r["shard"]].append(r["slot"])
        size[r["shard"]] += r["size"]
    assert set(slots) <= set(range(shards)) and all(sorted(x) == list(range(len(x))) for x in slots.values())
    return size


def test_sharding(spark, medium, odd):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{medium}/documents.parquet").collect()]
    size = laid_out(Q.op13_sharding(spark, medium), texts)
    assert max(size.values()) - min(size.values()) <= max(len((t or "").encode()) for _, t in texts)
    laid_out(kd_shards(odd, 5), [(r[0], r[1]) for r in odd_rows()], 5)
    assert kd_shards(odd.limit(0)).count() == 0


def test_one_text_and_one_id_in_most_rows_are_split(spark):
    """A third of the rows are one text, another third one row over and over."""
    texts = [(i, "t" * 300, "s", "en") for i in range(900)] + [(7, "same " * 60, "s", "en")] * 900 + [(5000 + i, f"{i} " * 75, "s", "de") for i in range(900)]
    size = laid_out(kd_shards(spark.createDataFrame(texts, "doc_id long, text string, source string, lang string")), [t[:2] for t in texts])
    assert max(size.values()) <= 1.02 * sum(size.values()) / 24 and min(size.values()) >= 0.98 * sum(size.values()) / 24


def test_sharding_is_native(spark, small):
    plan = Q.op13_sharding(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
