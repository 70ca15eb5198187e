"""Overlapping text windows, cut at the last natural separator in the second half of each.

Native: one fold a text, no shuffle, no Python, linear in the text's length (windows are
read from its chunks, and the text isn't carried along with them). Null text has no
windows, empty text one empty window. A window ends at the last blank line, line end or space (in this order of
preference) at or after max(overlap + 1, half its length), else at the budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citaria.functions.text import chunked, let, slice_of

SEPARATORS = ("\n\n", "\n", " ")
KIND = "array<struct<inicio:int,fim:int>>"
#: Characters of text in a window, and shared by two, for the default model.
DEFAULT_BUDGET, DEFAULT_OVERLAP = 1830, 200


def last_at(reversed_piece: Column, length: Column, separator: str) -> Column:
    """Index of the last occurrence in a piece given reversed; negative for none."""
    at = F.locate(separator[::-1], reversed_piece)
    return F.when(at > 0, length - at - len(separator) + 1).otherwise(-1)


def window_spans(text: Column, budget: int, overlap: int) -> Column:
    """ARRAY<STRUCT<inicio, fim>> of the windows of a text."""
    return F.when(text.isNotNull(), let(chunked(text), lambda chunks: spans_of_chunks(chunks, F.length(text), budget, overlap)))


def spans_of_chunks(chunks: Column, n: Column, budget: int, overlap: int) -> Column:
    """The same of a chunked text of n code points."""
    if budget <= overlap:
        raise ValueError("the budget must be larger than the overlap")

    def step(s: Column, _: Column) -> Column:
        end = F.least(s["start"] + budget, n)

        def cut(back: Column) -> Column:
            size = end - s["start"]
            least = F.greatest(F.lit(overlap + 1), F.floor(size / 2).cast("int"))
            way = None
            for sep in SEPARATORS:
                at = last_at(back, size, sep)
                way = F.when(at >= least, at) if way is None else way.when(at >= least, at)
            return s["start"] + way.otherwise(size)

        fim = F.when(end < n, let(F.reverse(slice_of(chunks, s["start"], end - s["start"])), cut)).otherwise(end).cast("int")
        made = let(fim, lambda f: F.struct(F.greatest(f - overlap, s["start"] + 1).alias("start"), (f >= n).alias("done"), F.concat(s["out"], F.array(F.struct(s["start"].alias("inicio"), f.alias("fim")))).alias("out")))
        return F.when(s["done"], s).otherwise(made)

    steps = F.when(n <= budget, F.lit(1)).otherwise(F.ceil(n / max(1, budget // 2 - overlap)).cast("int") + 1)
    start = F.struct(F.lit(0).alias("start"), F.lit(False).alias("done"), F.array().cast(KIND).alias("out"))
    return F.aggregate(F.sequence(F.lit(1), steps), start, step, lambda s: s["out"])


def windows(docs: DataFrame, keys: list[str], text: str = "text", budget: int = DEFAULT_BUDGET, overlap: int = DEFAULT_OVERLAP) -> DataFrame:
    """(keys..., janela INT from 0, inicio, fim, n_texto, texto): one row a window."""
    n = F.length(text)

    def cut(chunks: Column) -> Column:
        return F.transform(spans_of_chunks(chunks, n, budget, overlap), lambda w: F.struct(w["inicio"].alias("inicio"), w["fim"].alias("fim"), slice_of(chunks, w["inicio"], w["fim"] - w["inicio"]).alias("texto")))

    made = F.when(F.col(text).isNotNull(), let(chunked(F.col(text)), cut))
    # the outer form: the plain one infers a filter that computes the windows a second time, under any exchange
    rows = docs.select(*keys, n.alias("n_texto"), F.posexplode_outer(made).alias("janela", "_w")).where("janela is not null")
    return rows.select(*keys, "janela", "_w.inicio", "_w.fim", "n_texto", "_w.texto")


def at_edge(start: Column, end: Column, window_start: Column, window_end: Column, n: Column, overlap: int = DEFAULT_OVERLAP) -> Column:
    """Whether a span reaches into the overlap with a neighbouring window."""
    return ((window_start > 0) & (start < window_start + overlap)) | ((window_end < n) & (end > window_end - overlap))
