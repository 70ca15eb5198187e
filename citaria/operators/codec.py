"""Cells that hold citations: encoding, decoding and validation, native.

Submission cell: `inicio,fim,classe,id,confianca` parted by |, "-" for a missing id or
confidence and for a cell without citations. Golden cell: `inicio,fim,classe,ids` with
ids parted by a colon. Errors come out as a column, the first one of each cell in this
order of pieces and rules; `strict` raises instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citaria.functions.spans import keep_first
from citaria.functions.text import let, norm_id

CLASSES = ["real", "inventada", "incompleta"]
INTEGER, NUMBER = r"^[+-]?[0-9]+(_[0-9]+)*$", r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def encode_cell(citations: Column) -> Column:
    """Cell of an ARRAY<STRUCT<inicio, fim, classificacao, confianca, id_canonico>>; "-" for none or null."""

    def piece(c: Column) -> Column:
        id_ = F.coalesce(F.nullif(F.trim(F.coalesce(c["id_canonico"], F.lit(""))), F.lit("")), F.lit("-"))
        return F.concat_ws(",", c["inicio"].cast("string"), c["fim"].cast("string"), c["classificacao"], id_, F.coalesce(F.when(c["confianca"].isNotNull(), F.format_string("%.4f", c["confianca"])), F.lit("-")))

    cell = F.array_join(F.transform(citations, piece), "|")
    return F.coalesce(F.nullif(cell, F.lit("")), F.lit("-"))


def pieces(cell: Column) -> Column:
    """The non-blank pieces of a cell, trimmed; none for null, empty and "-"."""
    bare = F.trim(F.coalesce(cell, F.lit("")))
    return F.filter(F.transform(F.split(F.when(bare == "-", "").otherwise(bare), r"\|"), lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", "")), lambda p: p != "")


def fields(piece: Column) -> Column:
    return F.transform(F.split(piece, ","), lambda f: F.regexp_replace(f, r"(?U)^\s+|\s+$", ""))


def _int(c: Column) -> Column:
    return F.when(c.rlike(INTEGER), F.replace(c, F.lit("_"), F.lit(""))).try_cast("bigint")


def _number(c: Column) -> Column:
    return F.when(c.rlike(NUMBER), c).try_cast("double")


def piece_error(f: Column) -> Column:
    """Name of the first rule that the fields of a submission piece break; null for none."""
    start, end = _int(F.get(f, F.lit(0))), _int(F.get(f, F.lit(1)))
    kind, id_, conf = F.lower(F.get(f, F.lit(2))), F.get(f, F.lit(3)), F.get(f, F.lit(4))
    value = _number(conf)
    return (
        F.when(F.size(f) != 5, "campos")
        .when(start.isNull(), "inicio")
        .when(end.isNull(), "fim")
        .when((start < 0) | (end <= start), "span")
        .when(~kind.isin(CLASSES), "classe")
        .when((kind == "real") & id_.isin("", "-"), "id_ausente")
        .when((kind == "real") & ~id_.rlike(r"^[0-9]+$"), "id_digitos")
        .when(~conf.isin("", "-") & value.isNull(), "confianca")
        .when(~conf.isin("", "-") & ~value.between(0.0, 1.0), "confianca_faixa")
    )


def decoded(f: Column) -> Column:
    kind, id_, conf = F.lower(F.get(f, F.lit(2))), F.get(f, F.lit(3)), F.get(f, F.lit(4))
    return F.struct(
        _int(F.get(f, F.lit(0))).cast("int").alias("inicio"),
        _int(F.get(f, F.lit(1))).cast("int").alias("fim"),
        kind.alias("classe"),
        F.when(~id_.isin("", "-"), norm_id(id_)).alias("id_canonico"),
        F.when(~conf.isin("", "-"), _number(conf)).alias("confianca"),
    )


def in_order(spans: Column) -> Column:
    """The bounds of the spans that aren't empty, by position."""
    return F.array_sort(F.transform(F.filter(spans, lambda s: s["fim"] > s["inicio"]), lambda s: F.struct(s["inicio"].alias("inicio"), s["fim"].alias("fim"))))


def repeated(spans: Column) -> Column:
    """Whether two spans of an array overlap by half or more: then one of them is suppressed."""
    return let(in_order(spans), lambda s: F.size(keep_first(s, "struct<inicio:int,fim:int>", by_position=True)) < F.size(s))


def crossing(spans: Column) -> Column:
    """Whether two spans of an array overlap: by position, some span then overlaps the one before it."""
    return let(in_order(spans), lambda s: F.exists(F.transform(s, lambda x, i: (i > 0) & (x["inicio"] < F.get(s, i - 1)["fim"])), lambda hit: hit))


def decode_submission(df: DataFrame, keys: list[str], cell: str, strict: bool = False) -> DataFrame:
    """(keys..., citacoes ARRAY<STRUCT>, erro STRING): erro is "rule" or null; citacoes is null with an error."""
    f = df.select(*keys, F.transform(pieces(F.col(cell)), fields).alias("_f"))
    f = f.withColumn("_e", F.try_element_at(F.filter(F.transform("_f", piece_error), lambda e: e.isNotNull()), F.lit(1)))
    f = f.withColumn("_d", F.when(F.col("_e").isNull(), F.transform("_f", decoded)))
    f = f.withColumn("erro", F.coalesce("_e", F.when(repeated(F.col("_d")), "duplicata")))
    if strict:
        f = f.withColumn("erro", F.when(F.col("erro").isNotNull(), F.raise_error(F.concat(F.lit("invalid submission cell: "), F.col("erro")))))
    return f.select(*keys, F.when(F.col("erro").isNull(), F.col("_d")).alias("citacoes"), "erro")


def decode_golden(df: DataFrame, keys: list[str], cell: str) -> DataFrame:
    """(keys..., citacoes ARRAY<STRUCT<inicio, fim, classe, ids>>, erro): the defects are "real_sem_ids" and "sobreposicao"."""
    f = df.select(*keys, F.transform(pieces(F.col(cell)), fields).alias("_f"))

    def one(p: Column) -> Column:
        ids = F.filter(F.split(F.coalesce(F.get(p, F.lit(3)), F.lit("")), ":"), lambda x: ~F.trim(x).isin("", "-"))
        return F.struct(_int(F.get(p, F.lit(0))).cast("int").alias("inicio"), _int(F.get(p, F.lit(1))).cast("int").alias("fim"), F.lower(F.get(p, F.lit(2))).alias("classe"), F.array_distinct(F.transform(ids, norm_id)).alias("ids"))

    f = f.withColumn("_d", F.transform("_f", one))
    bare = F.exists("_d", lambda c: (c["classe"] == "real") & (F.size(c["ids"]) == 0))
    f = f.withColumn("erro", F.when(bare, "real_sem_ids").when(crossing(F.col("_d")), "sobreposicao"))
    return f.select(*keys, F.when(F.col("erro").isNull(), F.col("_d")).alias("citacoes"), "erro")


def golden_cells(golden: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys..., nivel, citacoes STRING): the rows of a text as one cell in input order; the level of the last row.

    The rows of one text are few (its spans don't overlap), so a cell is bounded by the text.
    golden: keys, nivel, inicio, fim, classificacao, ids ARRAY<STRING> and the order column.
    """
    kind = F.lower(F.trim("classificacao"))
    ids = F.when((kind == "real") & (F.size("ids") > 0), F.array_join("ids", ":")).otherwise("-")
    cell = F.concat_ws(",", F.col("inicio").cast("string"), F.col("fim").cast("string"), kind, ids)
    rows = golden.select(*keys, "nivel", F.col(order).alias("_o"), cell.alias("_c"))
    made = rows.groupBy(*keys).agg(F.max_by("nivel", "_o").alias("nivel"), F.array_sort(F.collect_list(F.struct("_o", "_c"))).alias("_l"))
    return made.select(*keys, "nivel", F.array_join(F.transform("_l", lambda x: x["_c"]), "|").alias("citacoes"))
