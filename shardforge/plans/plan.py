"""Sample planning (A1) and restart planning (F8).

The plan is pure integer arithmetic on the sample id: no window, no sort,
no shuffle, so it is partition-independent and free at any scale."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def plan_columns(sample_id: Column, batch: int, workers: int,
                 per_shard: int | None = None) -> dict[str, Column]:
    """Plan columns for a global sample id.

    Samples are produced ``batch`` per worker per iteration and flattened
    worker-major inside an iteration, so id = (iteration * workers + worker)
    * batch + slot. Each worker writes its own shards, numbered from the
    worker index and advancing by the worker count; a shard holds
    ``per_shard`` of the worker's samples (whole iterations)."""
    if batch <= 0 or workers <= 0:
        raise ValueError("batch and workers must be positive")
    per_iter = batch * workers
    iteration = F.floor(sample_id / F.lit(per_iter)).cast("bigint")
    within = F.pmod(sample_id, F.lit(per_iter))
    worker = F.floor(within / F.lit(batch)).cast("int")
    slot = F.pmod(within, F.lit(batch)).cast("int")
    cols = {"worker": worker, "iteration": iteration, "slot": slot}
    if per_shard is not None:
        if per_shard % batch != 0:
            raise ValueError(f"per_shard ({per_shard}) must be a multiple of the "
                             f"per-worker batch ({batch})")
        iters_per_shard = per_shard // batch
        cols["shard"] = (F.floor(iteration / F.lit(iters_per_shard)) * F.lit(workers)
                         + worker).cast("bigint")
    return cols


def assign_plan(df: DataFrame, id_col: str, batch: int, workers: int,
                per_shard: int | None = None) -> DataFrame:
    """Add worker / iteration / slot / shard columns to rows keyed by a dense
    sample id."""
    cols = plan_columns(F.col(id_col), batch, workers, per_shard)
    return df.withColumns(cols)


def iterations(n: int, batch: int, workers: int) -> int:
    return math.ceil(n / (batch * workers))


def sample_plan(spark: SparkSession, n: int, batch: int, workers: int,
                per_shard: int | None = None, pad_to_batch: bool = False,
                num_partitions: int | None = None) -> DataFrame:
    """Work list of ``n`` samples. ``pad_to_batch`` keeps the surplus of the
    last iteration (iterations * batch * workers rows), as the reference
    does; by default exactly ``n`` rows."""
    total = iterations(n, batch, workers) * batch * workers if pad_to_batch else n
    base = spark.range(0, total, 1, num_partitions).withColumnRenamed("id", "sample_id")
    return assign_plan(base, "sample_id", batch, workers, per_shard)


def resume_plan(plan: DataFrame, progress: DataFrame, on: str | list[str] = "shard") -> DataFrame:
    """Work still to do after a restart: plan rows whose shard has no
    committed progress row (NOT EXISTS as a left anti join)."""
    keys = [on] if isinstance(on, str) else list(on)
    done = progress.select(*keys).dropDuplicates(keys)
    return plan.join(done, on=keys, how="left_anti")


def resume_from_shards(plan: DataFrame, spark: SparkSession, shard_path: str, run_id: str | None = None,
                       on: str = "shard") -> DataFrame:
    """Remaining plan rows after a stop: the progress records that the
    ``tarshards`` writer commits with every shard are the completed work."""
    from shardforge.sources.tarshards import read_progress
    progress = read_progress(spark, shard_path)
    if run_id is not None:
        progress = progress.filter(F.col("run_id") == run_id)
    return resume_plan(plan, progress.select(F.col("shard").alias(on)), on)
