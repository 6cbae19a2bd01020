"""Continuous shard production (F7): a Structured Streaming query whose
``foreachBatch`` writes shards through the ``tarshards`` commit protocol.

Shard numbers come from the rows and the stream's own state, not from a
driver counter, so a replayed epoch rewrites the same shard names instead of
adding new ones. There are two ways to end a shard:

* by default every micro-batch ends with a partial shard per writer;
* with ``keep_open`` a writer's unfinished shard is carried over. The open
  rows and the number of finished shards of each writer are state of
  ``transformWithStateInPandas`` in Spark's RocksDB state store: versioned with
  the stream's checkpoint, restored after a stop or a lost executor, and
  appended to rather than rewritten while a shard fills. ``flush_open_shards``
  reads them back through the ``statestore`` source and writes the unfinished
  shards; with ``flush_after`` a timer closes a shard that got no rows for that
  long.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from shardforge.operators.positions import positions_in_group
from shardforge.sources.storage import storage
from shardforge.sources.tarshards import NAME_PATTERN, write_shards

EPOCH_BITS = 32  # shard numbers of an epoch: its number above 32 bits of its own
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
LAYOUT = "open-shards.json"    # beside the checkpoint: what flush_open_shards needs to know
EMIT_ROWS = 10000


def shard_batch(batch: DataFrame, epoch: int, per_shard: int, writers: int) -> DataFrame:
    """Shard numbers inside one micro-batch. Rows go to ``writers`` by a hash
    of their key (as the reference deals them to its workers); each fills
    shards of ``per_shard`` in key order, the last one partial (the flush),
    and writer w of W writes shards w, w + W, w + 2W, ... of the epoch. The
    numbers depend on the rows and ``writers`` only, so a replay on a cluster
    of any size rewrites the same names. Positions come from a range partition,
    so a writer's rows are numbered in several tasks."""
    members = [c for c in batch.columns if c != "key"]
    tagged = batch.withColumns({"_writer": F.pmod(F.xxhash64("key"), F.lit(writers)), "_tie": F.xxhash64("key", *members)})
    pos = positions_in_group(tagged, ["_writer"], ["key", "_tie"], "_pos")
    shard = F.lit(epoch << EPOCH_BITS) + F.col("_writer") + F.floor(F.col("_pos") / F.lit(per_shard)) * F.lit(writers)
    return pos.withColumn("shard", shard.cast("bigint")).drop("_writer", "_tie", "_pos")


class OpenShards(StatefulProcessor):
    """State of one writer: ``open``, the rows of its unfinished shard in
    order, and ``done``, how many shards it has finished. Rows of an epoch come
    in key order behind the open ones; a task holds one epoch's rows of one
    writer and an open shard, so the source's rate limit
    (``maxFilesPerTrigger`` and its like) and ``writers`` set its size."""

    def __init__(self, per_shard: int, writers: int, flush_after_ms: int | None = None):
        self.per_shard, self.writers, self.flush_after_ms = per_shard, writers, flush_after_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "key string, row string")
        self.done = handle.getValueState("done", "shards bigint, pending bigint")

    def _counts(self) -> tuple[int, int]:
        return tuple(int(v) for v in self.done.get()) if self.done.exists() else (0, 0)

    def _frames(self, writer: int, first: int, rows: list) -> Iterator[pd.DataFrame]:
        for lo in range(0, len(rows), EMIT_ROWS):
            part = rows[lo:lo + EMIT_ROWS]
            shards = [writer + (first + (lo + i) // self.per_shard) * self.writers for i in range(len(part))]
            yield pd.DataFrame({"shard": shards, "key": [r[0] for r in part], "row": [r[1] for r in part]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = sorted(p for pdf in rows for p in zip(pdf["key"].tolist(), pdf["row"].tolist()))
        done, pending = self._counts()
        full, rest = divmod(pending + len(new), self.per_shard)
        if full:
            queue = [tuple(r) for r in self.open.get()] if pending else []
            queue += new
            cut = full * self.per_shard
            self.open.clear()
            if rest:
                self.open.put(queue[cut:])
            yield from self._frames(int(key[0]), done, queue[:cut])
        elif new:
            self.open.appendList(new)
        self.done.update((done + full, rest))
        if self.flush_after_ms is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
            if rest:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.flush_after_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        done, pending = self._counts()
        if pending:
            rows = [tuple(r) for r in self.open.get()]
            self.open.clear()
            self.done.update((done + 1, 0))
            yield from self._frames(int(key[0]), done, rows)

    def close(self) -> None:
        pass


def _unpacked(rows: DataFrame, members: T.StructType) -> DataFrame:
    """The members travel through the state as one JSON text."""
    return rows.select("shard", "key", F.from_json("row", members).alias("m")).select("shard", "key", "m.*")


def flush_open_shards(spark: SparkSession, out_path: str, checkpoint: str, writers: int = 8,
                      run_id: str = "stream", pattern: str = NAME_PATTERN) -> None:
    """Write the unfinished shard of every writer, after the query stopped,
    from the newest committed version of its state. When the stream goes on
    later, the shard is filled up and written again under the same number."""
    store = storage(spark, checkpoint)
    if not store.exists(LAYOUT):
        return
    layout = json.loads(store.read(LAYOUT))

    def state(name: str) -> DataFrame:
        return spark.read.format("statestore").option("stateVarName", name).load(checkpoint)
    done = state("done").select(F.col("key._writer").alias("_writer"), F.col("value.shards").alias("_done"))
    rows = state("open").select(F.col("key._writer").alias("_writer"), F.col("list_element.key").alias("key"), F.col("list_element.row").alias("row"))
    shard = F.col("_writer") + F.col("_done") * F.lit(writers)
    write_shards(_unpacked(rows.join(done, "_writer").withColumn("shard", shard), T.StructType.fromJson(layout["members"])), out_path, run_id=f"{run_id}-flush", pattern=pattern)


def stream_shards(stream: DataFrame, out_path: str, checkpoint: str, per_shard: int,
                  key_col: str, member_cols: dict[str, object], available_now: bool = True,
                  run_id: str = "stream", writers: int = 8, keep_open: bool = False,
                  writer: Column | None = None, flush_after: float | None = None, pattern: str = NAME_PATTERN):
    """Start the query. ``member_cols`` maps tar extensions to columns or
    expressions; ``writers`` is part of the shard numbering and must stay the
    same for one stream. With ``keep_open`` all shards are full until
    ``flush_open_shards`` or, with ``flush_after`` (seconds), until a writer
    got no rows for that long; ``writer`` (an expression over key and members,
    0..writers-1) then chooses the writer, by default a hash of the key.
    ``pattern`` names the files; with one that ends in ``.gz`` they are
    compressed, which records of short values need (a member of a few bytes
    takes 1,024 in a plain shard). It must stay the same for one stream, too.
    Returns the StreamingQuery."""
    from shardforge.session import ship_package
    spark = stream.sparkSession
    rows = stream.select(F.col(key_col).alias("key"),
                         *[(F.col(v) if isinstance(v, str) else v).alias(k) for k, v in member_cols.items()])
    members = list(member_cols)
    if keep_open:
        ship_package(spark)
        layout = rows.select(*members).schema
        storage(spark, checkpoint).put(LAYOUT, json.dumps({"members": layout.jsonValue()}).encode())
        writer = F.pmod(F.xxhash64("key"), F.lit(writers)) if writer is None else writer
        packed = rows.select(writer.cast("bigint").alias("_writer"), F.col("key").cast("string").alias("key"),
                             F.to_json(F.struct(*members)).alias("row"))
        flush_ms = None if flush_after is None else int(flush_after * 1000)
        out = packed.groupBy("_writer").transformWithStateInPandas(
            OpenShards(per_shard, writers, flush_ms), "shard bigint, key string, row string", "append",
            "none" if flush_after is None else "processingTime")
    else:
        out = rows

    def each(batch: DataFrame, epoch: int):
        if keep_open:
            batch = _unpacked(batch, layout)
        elif batch.isEmpty():
            return
        else:
            batch = shard_batch(batch, epoch, per_shard, writers)
        write_shards(batch.select("shard", "key", *members), out_path, run_id=f"{run_id}-{epoch}",
                     pattern=pattern)

    w = out.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 second" if flush_after is not None else "10 seconds")
    # the query copies the session's settings when it starts
    before = spark.conf.get(PROVIDER, None)
    if keep_open:
        spark.conf.set(PROVIDER, ROCKSDB)
    try:
        return w.start()
    finally:
        if keep_open:
            spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)
