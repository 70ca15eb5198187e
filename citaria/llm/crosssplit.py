"""Problem 3: same or nearly the same examples in the training and an evaluation split.

Method: similarity-hash bit fingerprints (see fingerprints.py). The code of each distinct
text is cut into slices; slices are joined by equality across splits, pairs whose codes
lie within the Hamming radius are kept, and their texts are verified; results are counted
by split and source.

Scale: exact copies are one representative (the digest of their text); slices that occur
on one side only are dropped by a pre-aggregated count before any pairs are made. A slice
with many texts (a stock passage) is cut into a grid of salted sub-blocks, so that no task
holds it as a whole; every pair of it meets in one cell, so that the pairs found don't
depend on how many texts share a slice. The radius is part of the join condition, so that
pairs beyond it are never emitted.

Defined results: examples without messages, without a user message, or of fewer than
three words after its first line have no sequences and are in no pair; other or null
splits and null ids are ignored; copies are pairs like any others; column `messages` alone is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citaria.llm.fingerprints import RADIUS, hamming, keyed, sketch, slice_rows, unpacked, user_text, verified
from citaria.session import shared_checkpoints

TRAIN, EVALUATION = "treino", ("validacao", "teste")
#: Rows of a side of a block that go to one sub-block.
SIDE_ROWS = 2_000


def members(examples: DataFrame) -> DataFrame:
    """(exemplo_id, treino BOOLEAN, sig, text) of the examples of both sides that have a text."""
    used = examples.where(F.col("exemplo_id").isNotNull() & F.col("divisao").isin(TRAIN, *EVALUATION)).select("exemplo_id", (F.col("divisao") == TRAIN).alias("treino"), user_text().alias("_t"))
    return keyed(used, ["exemplo_id", "treino"], "_t")


def representatives(rows: DataFrame, width: int) -> DataFrame:
    """(sig, in_train, in_eval, code): one row for each distinct text, written once. Texts are read where they lie; only codes are shuffled."""
    shared_checkpoints(rows.sparkSession)
    coded = sketch(rows, ["sig", "treino"], "text", width)
    return coded.groupBy("sig").agg(F.max("treino").alias("in_train"), F.max(~F.col("treino")).alias("in_eval"), F.first("code").alias("code")).checkpoint()


def sides(members: DataFrame) -> DataFrame:
    """(block, _t, _e) of the blocks that hold a text of either side, and not a single text only."""
    counts = members.groupBy("block").agg(F.count_if("in_train").alias("_t"), F.count_if("in_eval").alias("_e"), F.count(F.lit(1)).alias("_n"))
    return counts.where("_t > 0 and _e > 0 and _n > 1").drop("_n")


def blocks(reps: DataFrame) -> DataFrame:
    """(sig, in_train, in_eval, k, block, _t, _e): texts by the slices of their codes that both sides share, however many share one."""
    rows = slice_rows(reps, ["sig", "in_train", "in_eval"])
    return rows.join(sides(rows).checkpoint(), "block")


def candidate_pairs(reps: DataFrame, radius: int, side_rows: int = SIDE_ROWS) -> DataFrame:
    """(sig_t, sig_e): pairs of different texts that share a slice and lie within the radius; side_rows only cuts the work."""
    members = blocks(reps).withColumns({"_nt": F.ceil(F.col("_t") / side_rows).cast("int"), "_ne": F.ceil(F.col("_e") / side_rows).cast("int")})
    h = F.xxhash64("sig")
    t = members.where("in_train").select("block", F.col("sig").alias("sig_t"), F.pmod(h, F.col("_nt")).cast("int").alias("_i"), F.explode(F.sequence(F.lit(0), F.col("_ne") - 1)).alias("_j"))
    e = members.where("in_eval").select("block", F.col("sig").alias("sig_e"), F.explode(F.sequence(F.lit(0), F.col("_nt") - 1)).alias("_i"), F.pmod(h, F.col("_ne")).cast("int").alias("_j"))
    t = t.join(reps.select(F.col("sig").alias("sig_t"), *unpacked("code", "t")), "sig_t")
    e = e.join(reps.select(F.col("sig").alias("sig_e"), *unpacked("code", "e")), "sig_e")
    near = t.alias("t").join(e.alias("e"), (F.col("t.block") == F.col("e.block")) & (F.col("t._i") == F.col("e._i")) & (F.col("t._j") == F.col("e._j")) & (F.col("sig_t") != F.col("sig_e")) & (hamming("t", "e") <= radius))
    return near.select("sig_t", "sig_e").distinct()


def near_classes(rows: DataFrame, similarity: float, width: int, radius: int, side_rows: int = SIDE_ROWS) -> DataFrame:
    """(sig_t, sig_e, similaridade): verified pairs of texts, those that occur on both sides included."""
    reps = representatives(rows, width)
    near = verified(candidate_pairs(reps, radius, side_rows), "sig_t", "sig_e", rows, similarity, width)
    same = reps.where("in_train and in_eval").select(F.col("sig").alias("sig_t"), F.col("sig").alias("sig_e"), F.lit(1.0).alias("similaridade"))
    return near.unionByName(same)


def cross_split_pairs(examples: DataFrame, similarity: float = 0.6, width: int = 3, radius: int = RADIUS, side_rows: int = SIDE_ROWS) -> DataFrame:
    """(exemplo_id_a, exemplo_id_b, similaridade): pairs of a training and an evaluation example, smaller id first."""
    rows = members(examples)
    near = near_classes(rows, similarity, width, radius, side_rows)
    t = rows.where("treino").select(F.col("exemplo_id").alias("_x"), F.col("sig").alias("sig_t"))
    e = rows.where("not treino").select(F.col("exemplo_id").alias("_y"), F.col("sig").alias("sig_e"))
    pairs = near.join(t, "sig_t").join(e, "sig_e")
    return pairs.select(F.least("_x", "_y").alias("exemplo_id_a"), F.greatest("_x", "_y").alias("exemplo_id_b"), "similaridade")


def leak_report(examples: DataFrame, similarity: float = 0.6, width: int = 3, radius: int = RADIUS) -> DataFrame:
    """(divisao, origem, exemplos, vazados, pares_de_textos): evaluation examples of each split and source that
    training holds too, exactly or nearly."""
    rows = members(examples)
    near = near_classes(rows, similarity, width, radius)
    links = near.groupBy("sig_e").agg(F.count(F.lit(1)).alias("_links"))
    hit = rows.where("not treino").select("exemplo_id", F.col("sig").alias("sig_e")).join(links, "sig_e").select("exemplo_id", "_links")
    held = examples.where(F.col("divisao").isin(*EVALUATION)).select("exemplo_id", "divisao", "origem").join(hit, "exemplo_id", "left")
    return held.groupBy("divisao", "origem").agg(F.count(F.lit(1)).alias("exemplos"), F.count("_links").alias("vazados"), F.coalesce(F.sum("_links"), F.lit(0)).alias("pares_de_textos"))
