"""Spans that a marked text points at: tags parsed, offsets recovered, repeats dropped.

Native folds on arrays a text; no shuffle. The needle of a tag is looked for from the end
of the one before, then from the start; where it isn't found as it is, white space may
differ. Needles that can't be found are dropped. Null text or answer: null, no spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citaria.functions.spans import disjoint, keep_first, mark
from citaria.functions.text import citation_type, let
from citaria.operators.windows import at_edge

TAG = r"(?is)<start\b[^>]*>(.*?)<end>"
SPAN = "struct<inicio:int,fim:int>"


def trim_lines(c: Column) -> Column:
    return F.regexp_replace(c, r"^\n+|\n+$", "")


def locate_loose(text: Column, needle: Column) -> Column:
    """(inicio, fim) of a needle whose white space may differ; null for none."""
    words = F.filter(F.split(needle, r"(?U)\s+"), lambda w: w != "")
    pattern = F.array_join(F.transform(words, lambda w: F.concat(F.lit(r"\Q"), F.replace(w, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))), r"\s+")
    extract = lambda p, g: F.call_function("regexp_extract", text, p, F.lit(g))
    head = extract(F.concat(F.lit("(?sU)^(.*?)("), pattern, F.lit(")")), 1)
    found = extract(F.concat(F.lit("(?sU)^(.*?)("), pattern, F.lit(")")), 2)
    return F.when((F.size(words) > 0) & (F.length(found) > 0), F.struct(F.length(head).alias("inicio"), (F.length(head) + F.length(found)).alias("fim")))


def locate(text: Column, needle: Column) -> Column:
    """(inicio, fim) of a needle in a text, exactly or else loosely; null for none or an empty needle."""

    def find(n: Column) -> Column:
        at = F.position(n, text)
        exact = F.when(at > 0, F.struct((at - 1).alias("inicio"), (at - 1 + F.length(n)).alias("fim")))
        return F.when(F.length(n) > 0, F.when(at > 0, exact).otherwise(locate_loose(text, n)))

    return let(trim_lines(needle), find)


def tag_spans(text: Column, marked: Column) -> Column:
    """ARRAY<STRUCT<inicio, fim>> of the tags of a marked text, by position, repeats dropped."""
    needles = F.filter(F.transform(F.regexp_extract_all(marked, F.lit(TAG), F.lit(1)), trim_lines), lambda n: n != "")

    def step(s: Column, needle: Column) -> Column:
        ahead = locate(F.substr(text, s["cursor"] + 1), needle)
        moved = F.struct((ahead["inicio"] + s["cursor"]).alias("inicio"), (ahead["fim"] + s["cursor"]).alias("fim"))
        hit = F.when(ahead.isNotNull(), moved).otherwise(locate(text, needle)).cast(SPAN)
        return let(hit, lambda h: F.when(h.isNotNull(), F.struct(h["fim"].alias("cursor"), F.concat(s["out"], F.array(h)).alias("out"))).otherwise(s))

    start = F.struct(F.lit(0).alias("cursor"), F.array().cast(f"array<{SPAN}>").alias("out"))
    return keep_first(F.array_sort(F.aggregate(needles, start, step, lambda s: s["out"])), SPAN, by_position=True)


def citations_of_windows(rows: DataFrame, keys: list[str], overlap: int) -> DataFrame:
    """(keys..., citacoes ARRAY<STRUCT<inicio, fim, trecho, tipo>>) of documents from windows with answers.

    rows: keys, inicio, fim, n_texto, texto (the window) and raw (its answer). Spans inside
    a window win over those that reach into its overlap. Windows without citations leave no row.
    """
    kind = "struct<borda:boolean,inicio:int,fim:int,trecho:string>"
    local = rows.select(*keys, F.col("inicio").alias("_a"), F.col("fim").alias("_b"), "n_texto", "texto", F.explode_outer(tag_spans(F.col("texto"), F.col("raw"))).alias("s")).where("s is not null")
    a, b = F.col("s.inicio") + F.col("_a"), F.col("s.fim") + F.col("_a")
    made = local.select(*keys, F.struct(at_edge(a, b, F.col("_a"), F.col("_b"), F.col("n_texto"), overlap).alias("borda"), a.alias("inicio"), b.alias("fim"), F.substring(F.col("texto"), F.col("s.inicio") + 1, F.col("s.fim") - F.col("s.inicio")).alias("trecho")).alias("c"))
    merged = made.groupBy(*keys).agg(keep_first(F.array_sort(F.collect_list("c")), kind).alias("c"))
    final = F.transform("c", lambda x: F.struct(x["inicio"].alias("inicio"), x["fim"].alias("fim"), x["trecho"].alias("trecho"), citation_type(x["trecho"]).alias("tipo")))
    return merged.select(*keys, F.array_sort(final).alias("citacoes"))


def accepted_mark(text: Column, spans: Column) -> Column:
    """The marked window if parsing it gives the same spans again, else null. spans: sorted by position."""
    return let(
        F.struct(text.alias("t"), disjoint(spans, F.length(text)).alias("s")),
        lambda x: let(mark(x["t"], x["s"]), lambda m: F.when(tag_spans(x["t"], m) == x["s"], m)),
    )
