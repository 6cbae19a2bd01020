"""Global positions over an ordered table without a single-partition
window (A6 worker merge, and the building block of C6 and F3).

A global ``row_number()`` with no PARTITION BY moves every row into one
task, and ``row_number()`` per worker puts a hot worker (which may hold a
third of the rows) into one task. Instead:

1. range-partition on the order key (hot keys are split because the full
   order key, not just the group, drives the ranges) and sort each part;
2. number rows inside each part (``monotonically_increasing_id`` minus the
   partition offset it encodes) and write the numbered rows once to the
   checkpoint folder. Two evaluations of a range exchange may sample other
   bounds, so counts and numbers must come from the same written rows;
3. count rows per part — one small row per part — take prefix sums over that
   bounded table and broadcast it (size = number of parts, a proven bound).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shardforge.session import estimated_bytes, reliable_checkpoint


FEW_GROUPS = 1 << 14     # first positions of so many groups are broadcast


def global_positions(df: DataFrame, order_cols: list[str], out_col: str = "position",
                     num_partitions: int | None = None) -> DataFrame:
    """0-based position of every row in the order of ``order_cols`` (which
    should be unique, a total order). The numbered rows are written once to
    ``spark.checkpoint.dir``; counts and positions both read them there."""
    spark = df.sparkSession
    # parts of about 64 MB by the optimiser's size estimate, and never fewer
    # than the shuffle width; independent of the cluster at hand
    n = num_partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")),
                              estimated_bytes(df) // (64 << 20))
    tagged = (df.repartitionByRange(n, *order_cols)
              .sortWithinPartitions(*order_cols)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_mid", F.monotonically_increasing_id()))
    tagged = reliable_checkpoint(tagged)
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    local = F.col("_mid") - F.shiftleft(F.col("_pid").cast("bigint"), 33)
    return (tagged.join(F.broadcast(offsets), "_pid")
            .withColumn(out_col, (F.col("_off") + local).cast("bigint"))
            .drop("_pid", "_mid", "_off"))


def positions_in_group(df: DataFrame, group_cols: list[str], order_cols: list[str],
                       out_col: str = "pos_in_group", num_partitions: int | None = None) -> DataFrame:
    """0-based position inside each group in the given order; skew-safe
    (the group offset is one aggregate row per group; those of few or of
    large groups, a bounded number, are broadcast, so that no task reads a
    group's rows). Null groups count as a group."""
    g = global_positions(df, group_cols + order_cols, "_gpos", num_partitions)
    g = g.withColumn("_gkey", F.struct(*group_cols))
    first = reliable_checkpoint(g.groupBy("_gkey").agg(F.min("_gpos").alias("_gfirst"), F.count(F.lit(1)).alias("_gsize")))
    # a join by few groups would bring each group's rows to one task
    few = first.limit(FEW_GROUPS + 1).count() <= FEW_GROUPS
    small = first.select("_gkey", "_gfirst")
    if few:
        g = g.join(F.broadcast(small), "_gkey")
    else:
        # the large groups are few, too: at most that many have so many rows
        n_rows = first.agg(F.sum("_gsize")).first()[0]
        large = F.col("_gsize") > n_rows // FEW_GROUPS
        held = F.broadcast(first.where(large).select("_gkey", F.col("_gfirst").alias("_glarge")))
        g = g.join(held, "_gkey", "left")
        whole = g.where("_glarge is not null").withColumnRenamed("_glarge", "_gfirst")
        rest = g.where("_glarge is null").drop("_glarge").join(small, "_gkey")
        g = whole.unionByName(rest)
    return (g.withColumn(out_col, F.col("_gpos") - F.col("_gfirst"))
            .drop("_gpos", "_gfirst", "_gkey"))


def worker_merge(parts: list[DataFrame], order_cols: list[str], out_col: str = "index",
                 worker_col: str = "worker") -> DataFrame:
    """Gather per-worker outputs into one table with global positions:
    worker-major, then the given order inside a worker (the reference's
    flatten of (worker, batch) followed by index = i + running total)."""
    tagged = [p.withColumn(worker_col, F.lit(i)) for i, p in enumerate(parts)]
    merged = tagged[0]
    for p in tagged[1:]:
        merged = merged.unionByName(p)
    return global_positions(merged, [worker_col] + order_cols, out_col)


def merge_planned(df: DataFrame, iteration_col: str, worker_col: str, slot_col: str,
                  batch: int, workers: int, out_col: str = "index") -> DataFrame:
    """When rows carry their plan columns the global index is arithmetic:
    (iteration * workers + worker) * batch + slot — no shuffle at all."""
    return df.withColumn(out_col, ((F.col(iteration_col) * F.lit(workers) + F.col(worker_col))
                                   * F.lit(batch) + F.col(slot_col)).cast("bigint"))
