"""The default budget of a mix doesn't hang on its scarcest source."""

from citaria.llm import mixing


def test_a_scarce_source_falls_short_and_does_not_shrink_the_mix(spark):
    rows = [(i, "a" if i % 2 else "b", "palavra " * 20) for i in range(400)] + [(1000, "c", "palavra")]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    mix = spark.createDataFrame([("a", 0.5, 3), ("b", 0.48, 3), ("c", 0.02, 2)], "source string, peso double, max_repeticoes int")
    report = {r.source: r for r in mixing.shares(docs, mix).collect()}
    at_hand, sent = (sum(r[c] for r in report.values()) for c in ("tokens_disponiveis", "tokens"))
    assert 0.98 * at_hand <= sent <= at_hand
    assert report["c"].repeticoes == 2 and report["c"].tokens == 2 * report["c"].tokens_disponiveis and report["c"].desvio < -0.01
    assert abs(report["a"].tokens / report["b"].tokens - 50 / 48) < 0.02


def test_many_sources_give_the_same_mix(spark):
    from pyspark.sql import functions as F

    from citaria.llm import mixing
    from citaria.session import shared_checkpoints

    shared_checkpoints(spark)
    counted = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 25).alias("source"), (F.col("id") % 7 + 1).cast("bigint").alias("n_tokens"), F.xxhash64("id").alias("_h"))
    mix = spark.createDataFrame([(f"s{k}", (k % 4 + 1) / 60, k % 3 + 1) for k in range(25)], "source string, peso double, max_repeticoes int")
    for budget in (None, 0, 500, 10**9):
        few, many = (sorted(map(tuple, mixing.mixed(counted, mix, budget, max_sources=n).collect())) for n in (100, 3))
        assert few == many and (budget == 0) == (not few)
