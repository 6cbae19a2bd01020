"""The flagship job: plan -> seeded labels and latents -> guided sampling
(model path, Arrow batches) -> quantise -> tar shards (write, commit, read
back) -> per-shard report.

One lazy plan up to the write; the only shuffle before it is the shard
repartition. Reads the ``embeddings`` table for the sample ids, so the
work grows with the table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardforge.functions.arrays import binary_to_pixels, pixels_to_binary, quantise
from shardforge.functions.rng import seeded_normal, seeded_randint
from shardforge.operators.trajectory import np_affine_velocity, sample_batch_arrow
from shardforge.plans.plan import assign_plan
from shardforge.session import scratch_path, table
from shardforge.sources.tarshards import read_shards, write_shards


def generate_samples(spark: SparkSession, sf_dir: str, seed: int = 0, num_steps: int = 20,
                     batch: int = 16, workers: int = 4, per_shard: int = 64,
                     num_classes: int = 10) -> DataFrame:
    ids = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample_id"))
    plan = assign_plan(ids, "sample_id", batch, workers, per_shard)
    sid = F.col("sample_id")
    samples = plan.withColumn("label", seeded_randint(seed, "label", sid, 0, num_classes)) \
        .withColumn("latent", seeded_normal(seed, "latent", sid, 64))
    # the model path: a NumPy velocity over Arrow batches (a real model would
    # sit here); same hashed noise stream as the Column path
    out = sample_batch_arrow(samples, np_affine_velocity(), num_steps=num_steps, seed=seed)
    return out.select("shard", F.format_string("%010d", "sample_id").alias("key"),
                      pixels_to_binary(quantise("sample")).alias("img"), F.col("label").alias("cls"))


def shard_report(spark: SparkSession, path: str) -> DataFrame:
    """Rows, distinct keys and mean pixel per shard, in one pass over the
    shard files (per-record pixel sums first, then one aggregation)."""
    back = read_shards(spark, path, "shard bigint, key string, img binary, cls int")
    per = back.select("shard", "key", F.aggregate(binary_to_pixels("img"), F.lit(0).cast("bigint"),
                                                  lambda acc, p: acc + p).alias("psum"),
                      F.length("img").alias("pn"))
    return per.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"),
                                    F.count_distinct("key").alias("distinct_keys"),
                                    F.round(F.sum("psum") / F.sum("pn"), 6).alias("mean_pixel"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "flagship-shards")
    write_shards(generate_samples(spark, sf_dir), path, run_id="flagship")
    return shard_report(spark, path)
