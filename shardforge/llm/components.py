"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardforge.llm.common import written
from shardforge.session import shuffles_freed


def _digest(edges: DataFrame) -> tuple:
    with shuffles_freed(edges.sparkSession):
        return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (node, comp): the smallest node of each component, for every
    node that has an edge. Each round links every node to the smallest
    neighbour it has (first for larger, then for smaller neighbours) and is
    written to the checkpoint folder; a component of n nodes takes about
    log n rounds, and no row of neighbours is ever gathered."""
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = _digest(e)
    while seen[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("x"), F.col("m").alias("b")).where("x <> b").withColumnRenamed("x", "a")
        e = written(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        now = _digest(e)
        if now == seen:
            break
        seen = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())
