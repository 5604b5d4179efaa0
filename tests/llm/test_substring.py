"""Substring dedup against a plain version: short sentences, whole lines, scripts without spaces, passages inside a sentence."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from quillstream.llm import queries as Q
from quillstream.llm.substring_dedup import WINDOW, cut_rows, substring_dedup

WORD = re.compile(r"[0-9A-Za-z\u0080-\U0010ffff]+")


def _units(text: str) -> list[tuple[int, int]]:
    cuts = {0} | {m.end() for m in re.finditer(r"\n", text)} | {m.end() for m in re.finditer(r"[.!?][ \t-\r]+(?=[^ \t-\r])", text)} | {m.end() for m in re.finditer("[。！？](?=[^ \t-\r])", text)}
    cuts = sorted(c for c in cuts if c < len(text)) + [len(text)]
    return [(a, b) for a, b in zip(cuts, cuts[1:]) if a < b]


def _size(word: str) -> float:
    worth = sum(0.5 if "　" <= c <= "鿿" else 0.25 if "฀" <= c <= "໿" else 0 for c in word)
    return max(1, worth)


def _passages(text: str, least: int, line: int = 8):
    """(words, first word, start, end) in characters."""
    inside = [(a, b, list(WORD.finditer(text, a, b))) for a, b in _units(text)]
    inside = [u for u in inside if u[2]]
    groups = set()
    for i in range(len(inside)):
        for j in range(i, len(inside)):  # the shortest run from i, and to j
            total = sum(_size(m.group()) for u in inside[i : j + 1] for m in u[2])
            if total >= least:
                groups.add((i, j))
                break
    for j in range(len(inside)):
        for i in range(j, -1, -1):
            if sum(_size(m.group()) for u in inside[i : j + 1] for m in u[2]) >= least:
                groups.add((i, j))
                break
    for pattern in (r"[^\n]*\n?", r"(?:[^\n]*[^ \t-\r][^\n]*(?:\n|$))+"):
        for m in re.finditer(pattern, text):
            own = [i for i, u in enumerate(inside) if m.start() <= u[0] < m.end()]
            if own and sum(_size(w.group()) for i in own for w in inside[i][2]) >= line:
                groups.add((own[0], own[-1]))
    out = set()
    for i, j in groups:
        ws = [m for u in inside[i : j + 1] for m in u[2]]
        out.add((tuple(m.group().translate({c: c + 32 for c in range(65, 91)}) for m in ws), ws[0].start(), inside[i][0], inside[j][1]))
    for a, b, ws in inside:
        for k in range(len(ws) - WINDOW + 1):
            own = ws[k : k + WINDOW]
            out.add((tuple(m.group().translate({c: c + 32 for c in range(65, 91)}) for m in own), own[0].start(), a if k == 0 else own[0].start(), b if k + WINDOW == len(ws) else own[-1].end()))
    return out


def brute(docs, least: int = 8):
    first: dict = {}
    found = [(i, t or "", _passages(t or "", least)) for i, t in docs]
    for i, _, own in found:
        for words, place, *_ in own:
            first[words] = min(first.get(words, (i, place)), (i, place))
    out = {}
    for i, text, own in found:
        gone = [False] * len(text)
        for words, place, a, b in own:
            if first[words] != (i, place):
                gone[a:b] = [True] * (b - a)
        at = [k for k, g in enumerate(gone) if g]
        for x, y in zip(at, at[1:]):
            if y > x + 1 and not WORD.search(text[x + 1 : y]):
                gone[x + 1 : y] = [True] * (y - x - 1)
        kept = "".join(c for c, g in zip(text, gone) if not g)
        out[i] = "" if at and not WORD.search(kept) else kept
    return out


def _check(df, docs, least=8):
    got, want = df.collect(), brute(docs, least)
    for r in got:
        assert r["kept_sha256"] == hashlib.sha256(want[r["doc_id"]].encode()).hexdigest(), r["doc_id"]
    assert len(got) == len(docs)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)

    def words(n):
        return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))

    short = "Go on. Stop now. Run to me. Take it all."  # 11 words, none of 8 in a sentence
    pasted = "One two. Three four five. Six seven. " + words(12) + ". Eight nine."
    inner = words(50)
    cjk = "日本語の文章は空白なしで書かれています"
    thai = "ภาษาไทยเขียนโดยไม่มีช่องว่างระหว่างคำ"
    para = "Short one.\nAnother short.\nYet more words here.\nAnd last."
    return {
        "line": [f"{words(9)}.\n{short}\n{words(9)}.", f"{words(10)}.\n{short}\n{words(8)}."],
        "passage": [f"{words(9)}. {pasted} {words(9)}.", f"{words(5)}. {pasted} {words(9)}."],
        "inner": [f"{words(9)} {inner} {words(9)}.", f"{words(20)} {inner} {words(3)}."],
        "cjk": [f"前の行\n{cjk}\n", f"別の行です\n{cjk}\n後"],
        "cjk_sentence": ["初めに。" + cjk + "。終わり", "次。" + cjk + "。了"],
        "thai": [f"ก\n{thai}\nข", f"ค\n{thai}\nง"],
        "para": [f"{words(9)}.\n\n{para}\n\n{words(9)}.", f"{words(9)}.\n \n{para}\n\n{words(9)}."],
        "same_length": [f"{words(8)}. Ab cd. {'x ' * 8}end.", "none"],
    }


@pytest.mark.parametrize("name", ["line", "passage", "inner", "cjk", "cjk_sentence", "thai", "para"])
def test_repeated_passage_goes(spark, texts, name):
    docs = list(enumerate(texts[name]))
    df = substring_dedup(spark.createDataFrame(docs, "doc_id long, text string"), 8)
    assert [r["n_removed"] > 0 for r in df.orderBy("doc_id").collect()] == [False, True]
    _check(df, docs)


def test_all_against_brute(spark, small, texts):
    rng = random.Random(5)
    docs = [t for pair in texts.values() for t in pair] + [None, "", "\n\n", "a b. " * 40, "y " * 300]
    parts = [s for t in docs if t for s in re.split(r"(?<=[.\n])", t)]
    docs += ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    docs = list(enumerate(docs))
    _check(substring_dedup(spark.createDataFrame(docs, "doc_id long, text string"), 8), docs)


def test_query_against_brute(spark, small):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    _check(Q.op6_substring_dedup(spark, small), docs, 25)


def test_rows_of_one_id_and_clashing_columns(spark):
    """Rows that share a doc_id lose their own bytes only; a repeated row, a null id, nulls and the caller's columns stay."""
    rng = random.Random(2)
    one, two = (" ".join(f"{c}{rng.randrange(10**6)}" for _ in range(30)) + ". " for c in "ab")
    long = " ".join(f"z{rng.randrange(10**6)}" for _ in range(60_000)) + "."
    rows = [(1, one), (1, two + one), (1, ""), (1, None), (2, two), (2, two), (None, one), (3, long), (4, long)]
    docs = spark.createDataFrame([(i, t, 5, "s", "m") for i, t in rows], "doc_id long, text string, n_bytes int, spans string, row string")
    out = cut_rows(docs).select("row.*", F.col("removal.text").alias("left"), F.col("removal.n_removed").alias("gone")).collect()
    assert len(out) == len(rows) and all((r["n_bytes"], r["spans"], r["row"]) == (5, "s", "m") for r in out)
    left = {}
    for r in out:
        left.setdefault((r["doc_id"], r["text"]), []).append(r["left"])
    assert left[None, one] == [one] and left[1, ""] == [""] and left[1, None] == [None]
    assert left[3, long] == [long] and left[4, long] == [""]
    kept = [x for (i, _), y in left.items() if i is not None for x in y if x]
    assert "".join(kept).count(one.strip()) == 1 and "".join(kept).count(two.strip()) in (1, 2)
    assert left[2, two] in ([""] * 2, [two] * 2)
    none = spark.createDataFrame([], docs.schema)
    assert substring_dedup(none).count() == 0


def test_short_lines_go_but_once_and_single_sentences_stay(spark):
    """With the default sizes a whole line of 8 words or more that comes again is a copy, a sentence within a line is not."""
    rng = random.Random(12)
    own = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    line, brief, sentence = own(9), own(7), own(12) + "."
    docs = [(i, f"{own(12)}\n{line}\n{brief}\n{own(11)}. {sentence} {own(10)}.\n\n{own(30)}") for i in range(6)]
    got = {r["doc_id"]: r["text"] for r in substring_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [line in got[i] for i in range(6)] == [True] + [False] * 5
    assert all(brief in t and sentence in t for t in got.values())
    _check(substring_dedup(spark.createDataFrame(docs, "doc_id long, text string")), docs, 25)
