"""Long texts: windows, marks, segments and suppression take time in proportion to the length."""

import time

from pyspark.sql import functions as F

from citaria.functions import spans, text
from citaria.operators import windows

WORD = "palavra é "  # ten code points


def timed(df):
    began = time.time()
    rows = df.collect()
    return rows, time.time() - began


def test_windows_of_ten_million_characters(spark):
    df = spark.range(1).select("id", F.repeat(F.lit(WORD), 1_000_000).alias("text"))
    windows.windows(spark.range(1).select("id", F.lit(WORD * 500).alias("text")), ["id"]).collect()
    rows, took = timed(windows.windows(df, ["id"]).select("inicio", "fim", F.length("texto").alias("n")))
    assert took < 60 and rows[-1].fim == 10_000_000 and all(r.n == r.fim - r.inicio <= windows.DEFAULT_BUDGET for r in rows)
    assert all(b.inicio == a.fim - windows.DEFAULT_OVERLAP for a, b in zip(rows, rows[1:]))


def test_marks_and_segments_of_a_million_characters(spark):
    own = "array<struct<inicio:int,fim:int>>"
    df = spark.range(1).select(F.repeat(F.lit(WORD), 100_000).alias("t"), F.transform(F.sequence(F.lit(0), F.lit(9_999)), lambda k: F.struct((k * 100).cast("int").alias("inicio"), (k * 100 + 7).cast("int").alias("fim"))).cast(own).alias("s"))
    rows, took = timed(df.select(spans.mark(F.col("t"), F.col("s")).alias("m"), F.size(spans.segments(F.col("t"), F.col("s"))).alias("n")))
    assert took < 40 and rows[0].n == 20_001 and rows[0].m.count("<start>palavra<end> é ") == 10_000 and len(rows[0].m) == 1_000_000 + 12 * 10_000
    rows, took = timed(df.select(F.size(spans.keep_first(F.col("s"), "struct<inicio:int,fim:int>", by_position=True)).alias("n")))
    assert took < 40 and rows[0].n == 10_000


def test_slices_against_python(spark):
    whole = "".join(chr(97 + k % 26) if k % 5 else "😀" for k in range(3 * text.CHUNK + 7))
    at = [(0, 5), (text.CHUNK - 2, 4), (text.CHUNK, 1), (2 * text.CHUNK - 1, text.CHUNK + 2), (3 * text.CHUNK, 100), (3 * text.CHUNK + 7, 3), (10 * text.CHUNK, 3), (5, 0), (5, -3)]
    df = spark.createDataFrame([(whole, a, n) for a, n in at], "t string, a int, n int")
    got = [r[0] for r in df.select(text.let(text.chunked(F.col("t")), lambda c: text.slice_of(c, F.col("a"), F.col("n")))).collect()]
    assert got == [whole[a : a + max(n, 0)] for a, n in at]


def test_sorted_suppression_is_the_same(spark):
    import random

    rng, kind = random.Random(5), "struct<inicio:int,fim:int>"
    rows = [(sorted((a, a + rng.randint(1, 12)) for a in (rng.randint(0, 60) for _ in range(25))),) for _ in range(40)]
    df = spark.createDataFrame(rows, f"s array<{kind}>")
    for r in df.select(spans.keep_first(F.col("s"), kind).alias("a"), spans.keep_first(F.col("s"), kind, by_position=True).alias("b")).collect():
        assert r.a == r.b
