"""Audit of how filters interact, by Walsh-Hadamard sums.

Each document gets a mask with one bit per filter that it fails. For each part
and label class, 2**f signed parity sums are aggregated (f filters; the sum of
(-1)**popcount(mask & s) for every s): plain sums, folded map-side. Their inverse
transform gives back exactly how many documents have each mask, and from these
cells every order of the filters and the Shapley shares follow: among the f!
orders, a filter is the first that a document fails in f! / (number of filters
that it fails) of them.

The last filter asks whether a smaller doc_id has the same text, in the whole
table. Texts are named by SHA-256; rows are counted for each text, part and class
before texts meet, so that a text of very many copies is a few rows. Nothing but
narrow rows (ids, masks, names) is shuffled.

Nulls: a null text is empty, a null part the empty string; a null doc_id has no
label and is neither a copy nor what others are copies of. Repeated rows count
each; rows of one doc_id are not copies of each other. Of repeated labels, any
that says 1 counts. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_SPACE = "[\\\\x20\\\\x09-\\\\x0D]+"

#: Letter and failure condition, over words, text and the columns of ``marked``; the filter of copies comes after these.
FILTERS = (
    ("A", "size(words) < 200"),
    ("B", "100 * size(array_distinct(words)) < 50 * size(words)"),
    ("C", "100 * (length(text) - length(regexp_replace(text, '[A-Z]+', ''))) > 2 * length(text)"),
    ("D", "text rlike '[#$%&*|]'"),
)
COPY = "E"


def marked(docs: DataFrame, filters: tuple = FILTERS) -> DataFrame:
    """Per row: doc_id, part, key (names the text) and mask, of the given filters."""
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "coalesce(source, '') part", "coalesce(text, '') text")
    rows = rows.selectExpr("doc_id", "part", "text", f"filter(split(text, '{_SPACE}'), w -> w != '') words")
    mask = " + ".join(f"if({condition}, {1 << bit}, 0)" for bit, (_, condition) in enumerate(filters))
    return rows.selectExpr("doc_id", "part", "unhex(sha2(text, 256)) key", f"{mask} mask")


def masked_counts(rows: DataFrame, labels: DataFrame, copy_bit: int) -> DataFrame:
    """part, good, toxic, mask (with the bit of copies), n: documents counted for each text, part and class."""
    said = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.expr("int(quality <=> 1)")).alias("good"), F.max(F.expr("int(toxic <=> 1)")).alias("toxic")
    )
    of = ["key", "part", "mask", "good", "toxic"]
    rows = rows.join(said, "doc_id", "left").fillna(0, ["good", "toxic"])
    ids = rows.groupBy("doc_id", *of).agg(F.count(F.lit(1)).alias("n"))  # lies by doc_id already
    texts = ids.groupBy(*of).agg(
        F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("n_least"),
        F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("n_null"),
    )
    texts = texts.withColumn("first", F.min("least").over(Window.partitionBy("key")))
    plain = "n_null + if(least = first, n_least, 0)"
    texts = texts.selectExpr("part", "good", "toxic", "mask", "n", f"coalesce({plain}, n_null) as n_first")
    both = texts.selectExpr("part", "good", "toxic", f"inline(array(struct(mask, n_first as n), struct(mask + {1 << copy_bit} as mask, n - n_first as n)))")
    return both.filter("n > 0")


def parity_sums(counts: DataFrame, filters: int) -> DataFrame:
    """part, good, toxic, sums: the 2**filters signed parity sums of the masks."""
    sums = [F.expr(f"sum(n * (1 - 2 * (bit_count(mask & {s}) % 2)))") for s in range(1 << filters)]
    return counts.groupBy("part", "good", "toxic").agg(F.array(*sums).alias("sums"))


def cells(sums: DataFrame, filters: int) -> DataFrame:
    """part, cells: of each mask the number of documents, of good and of toxic ones, by the inverse transform."""
    last = (1 << filters) - 1
    sign = "(1 - 2 * (bit_count(m & s) % 2))"
    inverse = f"transform(sequence(0, {last}), m -> aggregate(sequence(0, {last}), 0L, (t, s) -> t + sums[s] * {sign}) div {last + 1})"
    each = sums.selectExpr("part", "good", "toxic", f"posexplode({inverse}) as (m, n)").filter("n != 0")
    each = each.groupBy("part", "m").agg(F.sum("n").alias("n"), F.sum(F.expr("n * good")).alias("good"), F.sum(F.expr("n * toxic")).alias("toxic"))
    return each.groupBy("part").agg(F.collect_list(F.struct("m", "n", "good", "toxic")).alias("cells"))


def audit(docs: DataFrame, labels: DataFrame, filters: tuple = FILTERS) -> DataFrame:
    """Per part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    letters = [x for x, _ in filters] + [COPY]
    f = len(letters)
    counts = masked_counts(marked(docs, filters), labels, f - 1)
    rows = cells(parity_sums(counts, f), f)
    orders = ",".join(map("".join, itertools.permutations(letters)))
    rows = rows.selectExpr("part", "cells", f"explode(split('{orders}', ',')) filter_order")
    rows = rows.selectExpr("part", "cells", "filter_order", f"explode(sequence(1, {f})) step")
    bit = f"cast(shiftleft(1, instr('{''.join(letters)}', {{}}) - 1) as int)"
    rows = rows.withColumn("own", F.expr(bit.format("substr(filter_order, step, 1)")))
    rows = rows.withColumn("before", F.expr(f"aggregate(slice(split(filter_order, ''), 1, step - 1), 0, (b, c) -> b | {bit.format('c')})"))
    fails, earlier = "x.m & own != 0", "x.m & before != 0"
    total = lambda what, where: f"aggregate(filter(cells, x -> {where}), 0L, (t, x) -> t + {what})"
    return rows.selectExpr(
        "part", "filter_order", "step",
        f"{total('x.n', f'x.m & (before | own) = 0')} kept",
        f"{total('x.n', f'{fails} and not {earlier}')} removed",
        f"{total('x.n', f'{fails} and {earlier}')} redundant",
        f"{total('x.n', 'x.m = own')} unique_fails",
        f"{total('x.good', f'{fails} and not {earlier}')} good_lost",
        f"{total('x.toxic', f'{fails} and not {earlier}')} toxic_lost",
        f"{total(f'x.n * ({math.factorial(f)} div bit_count(x.m))', fails)} shapley",
    )


#: The same figures without the transform, for the registered query.
SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first
  FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         (len(ws) < 200)::INT AS a, (100 * len(list_distinct(ws)) < 50 * len(ws))::INT AS b,
         (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t))::INT AS c,
         regexp_matches(t, '[#$%&*|]')::INT AS d, coalesce(d.doc_id > first, false)::INT AS e
  FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
cell AS (
  SELECT part, a + 2 * b + 4 * c + 8 * d + 16 * e AS m, a + b + c + d + e AS fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic
  FROM m GROUP BY ALL),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(x, bit)),
o AS (
  SELECT p.x || q.x || r.x || s.x || t.x AS filter_order, [p.bit, q.bit, r.bit, s.bit, t.bit] AS bits
  FROM f p, f q, f r, f s, f t WHERE p.bit + q.bit + r.bit + s.bit + t.bit = 31 AND (p.bit | q.bit | r.bit | s.bit | t.bit) = 31),
k AS (SELECT filter_order, step::INT AS step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM o, range(1, 6) g(step))
SELECT part, filter_order, step,
       sum(CASE WHEN m & (own | before) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
       sum(CASE WHEN m & own <> 0 AND m & before = 0 THEN n ELSE 0 END)::BIGINT AS removed,
       sum(CASE WHEN m & own <> 0 AND m & before <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
       sum(CASE WHEN m = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
       sum(CASE WHEN m & own <> 0 AND m & before = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
       sum(CASE WHEN m & own <> 0 AND m & before = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost,
       sum(CASE WHEN m & own <> 0 THEN n * 120 // fails ELSE 0 END)::BIGINT AS shapley
FROM cell, k GROUP BY part, filter_order, step
"""
