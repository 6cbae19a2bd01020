"""Run metrics (A7): rows and bytes per shard with running totals, and
run-level counters gathered by an Observation during the write action
(no extra pass over the data)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F


def observe_run(df: DataFrame, size_col: str, name: str = "run") -> tuple[DataFrame, Observation]:
    """Attach run counters (rows, bytes, max record size) that are filled in
    by whatever action consumes the returned DataFrame."""
    obs = Observation(name)
    observed = df.observe(obs, F.count(F.lit(1)).alias("rows"),
                          F.sum(F.col(size_col)).cast("bigint").alias("bytes"),
                          F.max(F.col(size_col)).cast("bigint").alias("max_record_bytes"))
    return observed, obs


def run_metrics(df: DataFrame, shard_col: str = "shard", size_col: str = "size") -> DataFrame:
    """Per shard: rows, bytes, and the running totals in shard order.

    The aggregation is partial (map-side) and leaves one row per shard; the
    running total is a window over that per-shard table only, whose size is
    the shard count (rows / rows-per-shard), not the data."""
    per = df.groupBy(shard_col).agg(F.count(F.lit(1)).alias("rows"),
                                    F.sum(F.col(size_col)).cast("bigint").alias("bytes"))
    w = Window.orderBy(shard_col).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (per.withColumn("total_rows", F.sum("rows").over(w).cast("bigint"))
            .withColumn("total_bytes", F.sum("bytes").over(w).cast("bigint")))
