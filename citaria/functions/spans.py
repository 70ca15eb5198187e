"""Interval arithmetic and greedy folds on arrays of spans, as Column expressions.

A span is a struct with `inicio` and `fim`, code points, half-open. Folds run over the
spans of one text, an array that the text's length bounds.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citaria.functions.text import chunked, let, slice_of

#: Overlap that makes two spans the same, and share inside a match that makes a span part of it.
SAME_SPAN, PART_OF_MATCH = 0.5, 0.9


def intersection(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0))


def iou(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Intersection over union; 0 for disjoint or empty spans."""
    both = intersection(a0, a1, b0, b1)
    return F.when(both > 0, both / ((a1 - a0) + (b1 - b0) - both).cast("double")).otherwise(F.lit(0.0))


def same_span(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """IoU of a half or more, in whole numbers."""
    both = intersection(a0, a1, b0, b1)
    return (both > 0) & (2 * both >= (a1 - a0) + (b1 - b0) - both)


def contained(p0: Column, p1: Column, g0: Column, g1: Column) -> Column:
    """Whether nine tenths of span p lie in span g."""
    return (p1 > p0) & (10 * intersection(p0, p1, g0, g1) >= 9 * (p1 - p0))


def keep_first(spans: Column, kind: str, by_position: bool = False) -> Column:
    """Greedy suppression: in array order, drop a span that overlaps a kept one by half or more.

    kind: the DDL of the array's element type. by_position: the array is sorted by inicio, so
    that a span is compared with the kept ones that reach beyond its beginning only.
    """
    same = lambda kept, x: F.exists(kept, lambda k: same_span(k["inicio"], k["fim"], x["inicio"], x["fim"]))
    none = F.array().cast(f"array<{kind}>")
    if not by_position:
        return F.aggregate(spans, none, lambda kept, x: F.when(same(kept, x), kept).otherwise(F.concat(kept, F.array(x))))

    def step(s: Column, x: Column) -> Column:
        live = F.filter(s["live"], lambda k: k["fim"] > x["inicio"])
        return F.when(same(s["live"], x), s).otherwise(F.struct(F.concat(s["kept"], F.array(x)).alias("kept"), F.concat(live, F.array(x)).alias("live")))

    return F.aggregate(spans, F.struct(none.alias("kept"), none.alias("live")), step, lambda s: s["kept"])


def disjoint(spans: Column, length: Column) -> Column:
    """Spans of an array sorted by position that are in range, not empty and don't overlap the one kept before."""
    kind = "array<struct<inicio:int,fim:int>>"
    return F.aggregate(
        spans,
        F.struct(F.lit(0).alias("cursor"), F.array().cast(kind).alias("kept")),
        lambda s, x: F.when(
            (x["inicio"] < s["cursor"]) | (x["fim"] > length) | (x["inicio"] >= x["fim"]), s
        ).otherwise(F.struct(x["fim"].alias("cursor"), F.concat(s["kept"], F.array(F.struct(x["inicio"].cast("int").alias("inicio"), x["fim"].cast("int").alias("fim")))).alias("kept"))),
        lambda s: s["kept"],
    )


def before(spans: Column, i: Column) -> Column:
    """Where the span before the i-th ends; 0 for the first."""
    return F.when(i == 0, F.lit(0)).otherwise(F.get(spans, i - 1)["fim"])


def mark(text: Column, spans: Column) -> Column:
    """The text with <start> and <end> around disjoint spans in order."""
    def pieces(chunks: Column) -> Column:
        each = F.transform(spans, lambda x, i: F.concat(slice_of(chunks, before(spans, i), x["inicio"] - before(spans, i)), F.lit("<start>"), slice_of(chunks, x["inicio"], x["fim"] - x["inicio"]), F.lit("<end>")))
        rest = before(spans, F.size(spans))
        return F.concat(F.array_join(each, ""), slice_of(chunks, rest, F.length(text) - rest))

    return let(chunked(text), pieces)


def greedy_pairs(candidates: Column) -> Column:
    """One-to-one pairs of (gi, pi) taken greedily from an array sorted by preference."""
    kind = "array<struct<gi:int,pi:int>>"
    return F.aggregate(
        candidates,
        F.array().cast(kind),
        lambda kept, x: F.when(F.exists(kept, lambda k: (k["gi"] == x["gi"]) | (k["pi"] == x["pi"])), kept).otherwise(F.concat(kept, F.array(F.struct(x["gi"].alias("gi"), x["pi"].alias("pi"))))),
    )


def segments(text: Column, spans: Column) -> Column:
    """The text as fixed parts (the spans) and free parts (between them), in order."""
    part = lambda tipo, t: F.struct(F.lit(tipo).alias("tipo"), t.alias("trecho"))

    def parts(chunks: Column) -> Column:
        two = F.transform(spans, lambda x, i: F.array(part("livre", slice_of(chunks, before(spans, i), x["inicio"] - before(spans, i))), part("fixo", slice_of(chunks, x["inicio"], x["fim"] - x["inicio"]))))
        rest = before(spans, F.size(spans))
        return F.concat(F.flatten(two), F.array(part("livre", slice_of(chunks, rest, F.length(text) - rest))))

    return let(chunked(text), parts)
