"""Connected components of a table of links, by alternating star operations.

Large star: every vertex links its larger neighbours to its smallest one; small star:
every vertex links its smaller neighbours, and itself, to the smallest. Both keep the
components; in a logarithmic number of rounds only stars are left. Smallest neighbours
are pre-aggregated minima, so a hub is a row, not a collected list; each round is cut by
a checkpoint in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citaria.session import shared_checkpoints

MAX_ROUNDS = 60


def large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(id, grupo): each linked id with the smallest id of its component."""
    shared_checkpoints(links.sparkSession)
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct().checkpoint()
    stamp = None
    for _ in range(MAX_ROUNDS):
        edges = small_star(large_star(edges)).checkpoint()
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == stamp:
            break
        stamp = now
    else:
        raise RuntimeError(f"components: not settled after {MAX_ROUNDS} rounds")
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("grupo")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("grupo")).unionByName(roots)
