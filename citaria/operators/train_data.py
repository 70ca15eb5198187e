"""Training examples from marked windows: building, filtering, label masks, leakage guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citaria.functions.chat import prompt
from citaria.operators.tags import accepted_mark

# Limits of accepted generated texts, length of a training sequence, label of what isn't learnt.
MIN_MARKS, MIN_CHARS, MAX_CHARS, MAX_TOKENS, IGNORED = 4, 800, 4500, 2048, -100


def silver_examples(windows: DataFrame, citations: DataFrame, keys: list[str], system: str) -> DataFrame:
    """(keys..., inicio, n_spans, messages): windows whose marked text parses back to the same spans.

    windows: keys, inicio, fim, texto; citations: keys, inicio, fim (document offsets).
    Citations are joined to the windows that hold them as a whole; a window without any
    is an example too. Spans of a window are a group that its length bounds.
    """
    w = windows.select(*keys, F.col("inicio").alias("w0"), F.col("fim").alias("w1"), "texto")
    c = citations.select(*keys, F.col("inicio").alias("c0"), F.col("fim").alias("c1")).distinct()
    cond = [w[k] == c[k] for k in keys] + [c["c0"] >= w["w0"], c["c1"] <= w["w1"]]
    inside = w.join(c, cond).select(*(w[k] for k in keys), "w0", F.struct((F.col("c0") - F.col("w0")).alias("inicio"), (F.col("c1") - F.col("w0")).alias("fim")).alias("_s"))
    spans = inside.groupBy(*keys, "w0").agg(F.array_sort(F.collect_list("_s")).alias("spans"))
    rows = w.join(spans, [*keys, "w0"], "left").withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<inicio:int,fim:int>>")))
    made = rows.withColumn("marcado", F.explode_outer(F.array(accepted_mark(F.col("texto"), F.col("spans"))))).where("marcado is not null")
    doc = F.concat_ws("#", *(F.col(k).cast("string") for k in keys))
    messages = F.concat(prompt(system, doc, F.col("texto")), F.array(F.struct(F.lit("assistant").alias("role"), F.col("marcado").alias("content"))))
    return made.select(*keys, F.col("w0").alias("inicio"), F.size("spans").alias("n_spans"), messages.alias("messages"))


def cleaned(raw: Column) -> Column:
    """STRUCT<plano, marcado> of a generated text, or null if it isn't acceptable.

    Code fences are taken off; tags must be balanced, not nested, MIN_MARKS at least, and
    the plain text between MIN_CHARS and MAX_CHARS characters.
    """
    trim = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    marked = trim(F.regexp_replace(trim(raw), r"^```[a-zA-Z]*\n?|\n?```$", ""))
    starts, ends = F.regexp_count(marked, F.lit("<start>")), F.regexp_count(marked, F.lit("<end>"))
    pairs = F.regexp_count(marked, F.lit(r"(?s)<start>(?:(?!<start>|<end>).)*<end>"))
    plain = F.regexp_replace(marked, r"(?s)<start>((?:(?!<start>|<end>).)*)<end>", "$1")
    good = (starts == ends) & (pairs == starts) & (pairs >= MIN_MARKS) & F.length(plain).between(MIN_CHARS, MAX_CHARS)
    return F.when(good, F.struct(plain.alias("plano"), marked.alias("marcado")))


def masked(ids: Column, starts: Column, answer_at: Column, limit: int = MAX_TOKENS) -> Column:
    """STRUCT<input_ids, attention_mask, labels> of a token list: labels before the answer are masked, the tail is
    kept; null if nothing is left to learn. starts: character at which each token starts."""
    labels = F.zip_with(ids, starts, lambda t, s: F.when(s >= answer_at, t).otherwise(F.lit(IGNORED)))
    tail = lambda a: F.when(F.size(a) > limit, F.slice(a, -limit, limit)).otherwise(a)
    made = F.struct(tail(ids).alias("input_ids"), F.transform(tail(ids), lambda _: F.lit(1)).alias("attention_mask"), tail(labels).alias("labels"))
    return F.when(F.exists(made["labels"], lambda x: x != IGNORED), made)


def without(df: DataFrame, blocked: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't among the blocked ones; null keys stay."""
    return df.join(blocked.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def stems(paths: Column) -> Column:
    """File names without folder and last extension."""
    return F.regexp_replace(F.regexp_replace(paths, r"^.*/", ""), r"(?<=.)\.[^.]*$", "")
