"""Spans of regular expressions with positions in code points, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillcast.llm.common import WS, let

SPAN = "array<struct<s: int, e: int, t: string>>"


SPAN_IN_CONTEXT = "array<struct<s: int, e: int, t: string, l2: string, l1: string, r: string>>"


def find_spans(text: Column, pattern: str, context: bool = False) -> Column:
    """Leftmost, non-overlapping matches as an array of (s, e, t): start, end (exclusive), matched text.

    The text between matches comes from split() with the same pattern, so running lengths give places. With
    `context` come l2 and l1, the two whole words before the word in which the match begins, and r, the one after the
    word in which it ends; null where the text or another match comes first."""
    kind = SPAN_IN_CONTEXT if context else SPAN

    def place(found: Column) -> Column:
        def step(acc: Column, p: Column) -> Column:
            s = acc["pos"] + F.length(p["gap"])
            e = s + F.length(p["hit"])
            own = [s.alias("s"), e.alias("e"), p["hit"].alias("t"), *(p[c].alias(c) for c in ("l2", "l1", "r") if context)]
            return F.struct(e.alias("pos"), F.concat(acc["out"], F.array(F.struct(*own))).alias("out"))

        start = F.struct(F.lit(0).alias("pos"), F.array().cast(kind).alias("out"))
        gaps = F.split(text, pattern, -1)
        if context:
            gaps = let(F.transform(gaps, lambda g: F.regexp_replace(F.lower(g), rf"[{WS}]+", " ")), lambda n: F.transform(gaps, lambda g, i: around(g, F.get(n, i), F.get(n, i + 1))))
            pairs = F.zip_with(gaps, found, lambda g, hit: F.struct(g["gap"].alias("gap"), hit.alias("hit"), g["l2"].alias("l2"), g["l1"].alias("l1"), g["r"].alias("r")))
        else:
            pairs = F.arrays_zip(gaps.alias("gap"), found.alias("hit"))
        return F.aggregate(F.filter(pairs, lambda p: p["hit"].isNotNull()), start, step, lambda acc: acc["out"])

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) == 0, F.array().cast(kind)).otherwise(place(m)))


def around(gap: Column, before: Column, after: Column) -> Column:
    """(gap, l2, l1, r) for a gap, its own text and that of the next gap in words of one blank between."""
    word = lambda c: F.nullif(c, F.lit(""))
    last = F.split(F.substring_index(before, " ", -3), " ")
    r = F.get(F.split(F.substring_index(after, " ", 2), " "), 1)
    return F.struct(gap.alias("gap"), word(F.get(last, F.size(last) - 3)).alias("l2"), word(F.get(last, F.size(last) - 2)).alias("l1"), word(r).alias("r"))


def tagged(kind: int, spans: Column) -> Column:
    """(s, kind, e) for sorting by start, then kind."""
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(kind).alias("k"), x["e"].alias("e")))


def digest(spans: Column, kinds: list[str]) -> Column:
    """kind:start:end of sorted (s, k, e), comma-joined."""
    names = F.array(*(F.lit(k) for k in kinds))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")
