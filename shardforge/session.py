"""Session helpers: building a session for tests/bench, the shared checkpoint
folder, shipping this package to Python workers and loading the input tables."""

from __future__ import annotations

import io
import os
import tempfile
import threading
import uuid
import zipfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_PKG_DIR = os.path.dirname(os.path.abspath(__file__))
_SHIP_LOCK = threading.Lock()
_SHIPPED: set[str] = set()

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "shardforge") -> SparkSession:
    """Session used by tests and the bench. On a cluster the caller builds its
    own session; nothing in the library depends on these settings."""
    spark = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    Read from the session (``spark.checkpoint.dir``); a folder of our own is
    only set when the setting is absent, as in local tests."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        conf = tempfile.mkdtemp(prefix="shardforge-ckpt-")
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder (never machine-local
    on a cluster), for tables and files a job writes and reads back."""
    base = checkpoint_dir(spark)
    if base.startswith("file:"):
        base = base[len("file:"):]
    return os.path.join(base, "shardforge", f"{name}-{uuid.uuid4().hex[:12]}")


def ship_package(spark: SparkSession) -> None:
    """Make ``shardforge`` importable on Python workers (Arrow/pandas
    operators and the Python data sources) by adding it as a zip py-file."""
    key = spark.sparkContext.applicationId
    with _SHIP_LOCK:
        if key in _SHIPPED:
            return
        buf = io.BytesIO()
        with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as zf:
            for root, _dirs, files in os.walk(_PKG_DIR):
                if "__pycache__" in root:
                    continue
                for f in files:
                    if f.endswith(".py"):
                        full = os.path.join(root, f)
                        arc = os.path.relpath(full, os.path.dirname(_PKG_DIR))
                        zf.write(full, arc)
        path = os.path.join(tempfile.mkdtemp(prefix="shardforge-pkg-"), "shardforge.zip")
        with open(path, "wb") as fh:
            fh.write(buf.getvalue())
        spark.sparkContext.addPyFile(path)
        _SHIPPED.add(key)


def register_sources(spark: SparkSession) -> None:
    """Register the Python data sources (tar shards, image folder)."""
    ship_package(spark)
    from shardforge.sources.imagefolder import ImageFolderDataSource
    from shardforge.sources.tarshards import TarShardsDataSource

    spark.dataSource.register(TarShardsDataSource)
    spark.dataSource.register(ImageFolderDataSource)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def ensure_parallelism(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Spread rows over at least one partition per core before CPU-bound
    per-row work (hashing, trajectories, matrix products). A table read from
    few large row groups arrives in very few partitions; where the estimated
    size gives as many splits as cores this is a no-op. Only the speed
    depends on it, no result does."""
    spark = df.sparkSession
    want = min_partitions or spark.sparkContext.defaultParallelism
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    if estimated_bytes(df) // split < want:
        return df.repartition(want)
    return df


def estimated_bytes(df: DataFrame) -> int:
    """The optimiser's size estimate of ``df``, without running anything;
    0 when it has none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


@contextmanager
def batch_rows(spark: SparkSession, row_bytes: int, batch_bytes: int = 16 << 20):
    """Jobs run inside hand Python workers Arrow batches of about
    ``batch_bytes``, where rows of ``row_bytes`` are so large that the
    session's number of rows a batch is too many. No result depends on it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(key))
    most = max(1, batch_bytes // max(1, row_bytes))
    spark.conf.set(key, str(min(before, most) if before > 0 else most))
    try:
        yield
    finally:
        spark.conf.set(key, str(before))


@contextmanager
def shuffles_freed(spark: SparkSession):
    """Shuffle files of the queries run inside are removed when the query ends
    and not when the driver next happens to collect garbage, so that steps that
    end in files of their own don't add up on the executors' disks. A lost file
    is computed again as ever; no result depends on it."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def reliable_checkpoint(df: DataFrame, persist_first: bool = False) -> DataFrame:
    """Cut lineage with a reliable checkpoint in ``spark.checkpoint.dir``.

    An eager checkpoint computes the plan and writes the files in one job,
    and later reads and task retries use the files. ``persist_first`` also
    caches the data while it is written; that only pays off when the same
    DataFrame object is read again before the checkpoint is used, so it is
    off by default (measured: the cache costs more than it saves here)."""
    from pyspark import StorageLevel
    checkpoint_dir(df.sparkSession)
    if not persist_first:
        return df.checkpoint(eager=True)
    cached = df.persist(StorageLevel.MEMORY_AND_DISK)
    out = cached.checkpoint(eager=True)
    cached.unpersist()
    return out
