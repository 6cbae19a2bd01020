"""Retention split and publication (F6).

The newest ``keep`` files of each worker stay (they may still be
written); all others ship to the destination and are removed at the
source. keep = 0 ships everything. An empty listing is an error."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shardforge import constants as K
from shardforge.session import reliable_checkpoint, ship_package
from shardforge.sources.storage import Storage, schemes_of, storage
from shardforge.sources.tarshards import committed_files


def shard_listing(spark: SparkSession, path: str, pattern: str = K.SHARD_NAME,
                  workers: int | None = None) -> DataFrame:
    """(path, created, length, shard, worker) of the committed shards in a
    folder of any store, one small row per file. With ``workers``, the worker
    is shard number mod workers (interleaved numbering); otherwise 0."""
    store = storage(spark, path)
    rows = [(store.uri(f.name), f.modified, f.size, f.shard) for f in committed_files(store, pattern)]
    files = spark.createDataFrame(rows, "path string, created double, length bigint, shard bigint")
    worker = F.pmod("shard", F.lit(workers)) if workers else F.lit(0)
    return files.select("path", F.timestamp_seconds("created").alias("created"), "length", "shard", worker.cast("bigint").alias("worker"))


def retention_split(listing: DataFrame, keep: int, worker_col: str = "worker",
                    created_col: str = "created", path_col: str = "path",
                    check_empty: bool = True) -> DataFrame:
    """Label each file 'keep' (among the newest ``keep`` of its worker) or
    'ship'. The top-k is a ``row_number() <= keep`` window; Spark plans it
    with a partial group limit before the shuffle, so a worker owning most
    files still sends only ``keep`` rows per map task to its reducer. Ties
    on the creation time are broken by the path (larger = newer)."""
    if check_empty and listing.isEmpty():
        raise ValueError("no shards to publish: the listing is empty")
    if keep <= 0:
        return listing.withColumn("action", F.lit("ship"))
    w = Window.partitionBy(worker_col).orderBy(F.col(created_col).desc(), F.col(path_col).desc())
    kept = (listing.select(worker_col, created_col, path_col)
            .withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= keep)
            .select(path_col, F.lit(True).alias("_kept")))
    return (listing.join(kept, path_col, "left")
            .withColumn("action", F.when(F.col("_kept"), F.lit("keep")).otherwise(F.lit("ship")))
            .drop("_kept"))


def publish(listing: DataFrame, dest: str, keep: int) -> DataFrame:
    """Copy every 'ship' file to ``dest`` and return the report (src, dst,
    bytes, ok) per file. Source and destination may be different stores. The
    copy runs now, once, in the executors; the report is written to the
    checkpoint folder, and only then a second pass deletes the sources whose
    copy has the right length, so no attempt of a task can lose a file that
    another one still copies. A source that is gone counts as shipped if the
    destination has its file. Two sources with the same base name are an error
    before anything is copied."""
    spark = listing.sparkSession
    split = retention_split(listing, keep)
    base = F.regexp_extract("path", r"([^/]+)$", 1)
    same = split.filter(F.col("action") == "ship").groupBy(base.alias("file")).count().filter("count > 1").limit(5).collect()
    if same:
        raise ValueError(f"several sources would be published under one name: {[r['file'] for r in same]}")
    ships = split.filter(F.col("action") == "ship").select("path", "length")
    schemes, target = schemes_of(spark), storage(spark, dest)

    def copy(batches):
        import pyarrow as pa
        for b in batches:
            out = []
            for src, length in zip(b.column("path").to_pylist(), b.column("length").to_pylist()):
                folder, name = src.rsplit("/", 1)
                n = 0
                try:
                    n = Storage(folder, schemes).copy_to(name, target, name)
                except FileNotFoundError:
                    pass     # shipped by an earlier run
                there = target.size(name)
                out.append((src, target.uri(name), length if there == length else n, there == length))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.string(), pa.int64(), pa.bool_()))],
                                             ["src", "dst", "bytes", "ok"])

    def delete(batches):
        for b in batches:
            for src in b.column("src").to_pylist():
                folder, name = src.rsplit("/", 1)
                Storage(folder, schemes).delete(name)
            yield b

    ship_package(spark)
    # few files: one task each
    n = max(1, min(ships.count(), 1000))
    report = reliable_checkpoint(ships.repartition(n).mapInArrow(copy, "src string, dst string, bytes bigint, ok boolean"))
    report.where("ok").select("src").mapInArrow(delete, "src string").write.format("noop").mode("overwrite").save()
    return report
