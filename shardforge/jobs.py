"""The shard-generation job end to end, restartable: plan the samples, drop
the shards whose progress records are already committed, sample, quantise,
write through the commit protocol, then publish all but the newest shards
of every worker.

Everything up to the write is one lazy plan; the only shuffle is the shard
repartition of the writer. A rerun after a stop only computes the missing
shards, and because every draw is keyed by (seed, sample id), a resumed
run writes byte-for-byte the shards an uninterrupted run would have."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardforge import constants as K
from shardforge.functions.arrays import pixels_to_binary, quantise
from shardforge.functions.counter import counter_normals
from shardforge.functions.rng import seeded_normal, seeded_randint
from shardforge.operators.trajectory import np_affine_velocity, sample_batch_arrow
from shardforge.plans.plan import assign_plan, resume_plan


def _sampled(ids: DataFrame, seed: int, latent_dim: int, num_classes: int, num_steps: int, velocity_np,
             noise: str) -> DataFrame:
    """Labels, latents and samples of every ``sample_id``. Latents and noise
    are keyed by (seed, sample id): counter-based, all rows of a batch at once
    ("hashed" reproduces the Column path exactly)."""
    sid = F.col("sample_id")
    samples = ids.withColumn("label", seeded_randint(seed, "label", sid, 0, num_classes))
    if noise == "counter":
        samples = counter_normals(samples, seed, "latent", "sample_id", latent_dim, "latent")
    else:
        samples = samples.withColumn("latent", seeded_normal(seed, "latent", sid, latent_dim))
    return sample_batch_arrow(samples, velocity_np or np_affine_velocity(), num_steps=num_steps, seed=seed,
                              noise=noise)


def run_params(**values) -> str:
    """A digest of a run's parameters. A model or decoder counts by its name
    and its ``version`` attribute, if it has one."""
    def plain(v):
        if callable(v):
            return [getattr(v, "__module__", ""), getattr(v, "__qualname__", type(v).__name__), str(getattr(v, "version", ""))]
        return v
    return hashlib.sha256(json.dumps({k: plain(v) for k, v in values.items()}, sort_keys=True).encode()).hexdigest()


def intact_shards(spark: SparkSession, out_path: str, params: str | None = None) -> DataFrame:
    """(shard, rows) of the shards whose file has the size and SHA-256 of its
    newest record, and whose record has these ``params`` (None: any). Files are
    read in blocks, each by one task."""
    from shardforge.session import ship_package
    from shardforge.sources.storage import storage
    from shardforge.sources.tarshards import read_progress
    ship_package(spark)
    store = storage(spark, out_path)
    newest = (read_progress(spark, out_path).groupBy("shard")
              .agg(F.max_by(F.struct("file", "size", "sha256", "params", "rows"), "seq").alias("r")).select("shard", "r.*"))
    if params is not None:
        newest = newest.where(F.col("params") == params)

    def verify(batches):
        import pyarrow as pa
        for b in batches:
            good = []
            for name, size, sha in zip(b.column("file").to_pylist(), b.column("size").to_pylist(), b.column("sha256").to_pylist()):
                ok = name is not None and store.size(name) == size
                if ok:
                    h = hashlib.sha256()
                    for block in store.blocks(name):
                        h.update(block)
                    ok = h.hexdigest() == sha
                good.append(ok)
            yield pa.RecordBatch.from_arrays([b.column("shard"), b.column("rows")], ["shard", "rows"]).filter(pa.array(good, pa.bool_()))

    return newest.mapInArrow(verify, "shard bigint, rows bigint")


def generate_shards(spark: SparkSession, ids: DataFrame, out_path: str, *, seed: int = 0,
                    batch: int = K.BATCH_PER_DEVICE, workers: int = 4, per_shard: int = K.ROWS_PER_SHARD,
                    latent_dim: int = 64, num_classes: int = K.LABEL_HIGH, num_steps: int = 20,
                    velocity_np=None, decode=None, run_id: str = "run", resume: bool = True,
                    shard_filter=None, noise: str = "counter") -> DataFrame:
    """Write the shards of the samples in ``ids`` (column ``sample_id``) and
    return the committed progress records of this run. ``shard_filter``
    restricts the plan (for example to the shards of one stage of a larger
    run); ``noise`` is "counter" (default), "philox" or "hashed".

    The progress records carry a digest of what the shards were made with and
    one of each file. A resumed run takes a shard as done only if its newest
    record has the same parameters and as many rows as planned, and the file
    still has the recorded digest: shards of another seed, damaged, missing and
    partial ones are written again."""
    from shardforge.sources.tarshards import read_progress, write_shards

    params = run_params(seed=seed, batch=batch, workers=workers, per_shard=per_shard, latent_dim=latent_dim,
                        num_classes=num_classes, num_steps=num_steps, noise=noise, velocity=velocity_np, decode=decode)
    plan = assign_plan(ids.select("sample_id"), "sample_id", batch, workers, per_shard)
    if shard_filter is not None:
        plan = plan.filter(shard_filter)
    if resume:
        planned = plan.groupBy("shard").agg(F.count(F.lit(1)).alias("planned"))
        done = intact_shards(spark, out_path, params).join(planned, "shard").filter("rows = planned").select("shard")
        plan = resume_plan(plan, done, "shard")
    out = _sampled(plan, seed, latent_dim, num_classes, num_steps, velocity_np, noise)
    records = out.select("shard", F.format_string(K.KEY_FORMAT, "sample_id").alias("key"),
                         pixels_to_binary(quantise("sample", decode=decode)).alias("img"),
                         F.col("label").alias("cls"))
    write_shards(records, out_path, run_id=run_id, params=params)
    return read_progress(spark, out_path).filter(F.col("run_id") == run_id)


def generate_pack(spark: SparkSession, ids: DataFrame, num: int, path: str, shape: tuple, *, seed: int = 0,
                  num_classes: int = K.LABEL_HIGH, num_steps: int = 20, velocity_np=None, decode=None,
                  noise: str = "counter", rows_per_part: int | None = None) -> DataFrame:
    """The samples ``sample_id`` = 0..num-1 as one ordered uint8 pack of
    ``shape`` (H, W, C): plan, sample, quantise and pack, each sample computed
    once. Returns the manifest; incomplete packs are an error."""
    from shardforge.operators.pack import pack_tensor

    h, w, c = shape
    out = _sampled(ids.select("sample_id"), seed, h * w * c, num_classes, num_steps, velocity_np, noise)
    rows = out.select(F.col("sample_id").alias("index"), F.lit(h).alias("h"), F.lit(w).alias("w"), F.lit(c).alias("c"),
                      pixels_to_binary(quantise("sample", decode=decode)).alias("pixels"))
    return pack_tensor(rows, num, path, rows_per_part=rows_per_part, shape=shape)


def publish_shards(spark: SparkSession, out_path: str, dest: str, workers: int,
                   keep: int = K.KEEP_FILES_RUNNING) -> DataFrame:
    """Ship all but the newest ``keep`` shards of every worker (the worker
    of a shard is its number mod the worker count); keep = 0 ships all."""
    from shardforge.operators.publish import publish, shard_listing
    return publish(shard_listing(spark, out_path, workers=workers), dest, keep)
