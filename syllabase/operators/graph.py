"""Groups of linked rows, each named by its lowest id."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint


def star_edges(rows: DataFrame, key: str, node: str) -> DataFrame:
    """(u, v) from every row to the lowest id of its key; a group of n rows gives n-1 edges."""
    rows = rows.select(F.col(key).alias("k"), F.col(node).alias("u")).dropna().distinct()
    hubs = rows.groupBy("k").agg(F.min("u").alias("v"))
    return rows.join(hubs, "k").filter("u <> v").select("u", "v").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.filter("v > u").join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v), root being the lowest id it reaches.

    Alternates large-star and small-star steps until the edges stand still. Each
    round is a grouped minimum and an equi-join; the lineage is cut by a reliable
    checkpoint, so a lost executor does not replay earlier rounds.
    """
    now = checkpoint(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == seen:
            break
        seen = mark
        now = checkpoint(_small_star(_large_star(now)))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("root"))
    ).distinct()
