"""Registered queries: shards, packs and publication (F1-F7) and the
flagship sample-to-shard job."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from shardforge import sqltwins as S
from shardforge.catalog import register
from shardforge.session import scratch_path, table

_PIXEL = f"CAST(trunc(least(greatest((CAST(embedding[i + 1] AS DOUBLE) / {S.d(0.18215)} + 1.0) / 2.0 * 255.0, 0.0), 255.0)) AS INTEGER)"
_HEX = f"array_to_string(list_transform(range(64), lambda i: lpad(hex({_PIXEL}), 2, '0')), '')"


def _quantised(spark, sf):
    from shardforge.functions.arrays import pixels_to_binary, quantise
    return table(spark, sf, "embeddings").select(
        "vec_id", "label", pixels_to_binary(quantise("embedding")).alias("img"))


@register("tarshards_roundtrip", f"""
SELECT CAST(floor(floor(vec_id / 64) / 2) * 4 + floor((vec_id % 64) / 16) AS BIGINT) AS shard,
       lpad(CAST(vec_id AS VARCHAR), 10, '0') AS key, label AS cls,
       {_HEX} AS img_hex
FROM embeddings""")
def q_tarshards_roundtrip(spark, sf):
    from shardforge.plans.plan import assign_plan
    from shardforge.sources.tarshards import read_shards, write_shards
    q = assign_plan(_quantised(spark, sf), "vec_id", batch=16, workers=4, per_shard=32)
    path = scratch_path(spark, "tarshards")
    write_shards(q.select("shard", F.format_string("%010d", "vec_id").alias("key"), "img",
                          F.col("label").alias("cls")), path)
    back = read_shards(spark, path, "shard bigint, key string, img binary, cls int")
    return back.select("shard", "key", "cls", F.hex("img").alias("img_hex"))


@register("assign_shards_count", """
SELECT doc_id, CAST(doc_id % 4 AS BIGINT) AS worker, CAST(p AS BIGINT) AS pos_in_worker,
       CAST(doc_id % 4 + (p // 100) * 4 AS BIGINT) AS shard, text
FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id % 4 ORDER BY doc_id) - 1 AS p FROM documents)""")
def q_assign_shards_count(spark, sf):
    from shardforge.operators.shards import assign_shards_count
    d = table(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 4).alias("worker"), "text")
    return assign_shards_count(d, "worker", ["doc_id"], 100, 4).select("doc_id", "worker", "pos_in_worker", "shard", "text")


@register("image_folder_roundtrip", f"""
SELECT vec_id AS "index", 8 AS h, 8 AS w, 1 AS c, {_HEX} AS pixels_hex FROM embeddings""")
def q_image_folder_roundtrip(spark, sf):
    from shardforge.sources.imagefolder import read_image_folder, write_image_folder
    q = _quantised(spark, sf).select(F.col("vec_id").alias("index"), F.lit(8).alias("h"), F.lit(8).alias("w"),
                                     F.lit(1).alias("c"), F.col("img").alias("pixels"))
    path = scratch_path(spark, "pngs")
    write_image_folder(q, path)
    back = read_image_folder(spark, path)
    return back.select("index", "h", "w", "c", F.hex("pixels").alias("pixels_hex"))


@register("pack_tensor", f"""
SELECT vec_id AS "index", 8 AS h, 8 AS w, 1 AS c, {_HEX} AS pixels_hex FROM embeddings""")
def q_pack_tensor(spark, sf):
    from shardforge.operators.pack import pack_tensor, read_pack
    q = _quantised(spark, sf).select(F.col("vec_id").alias("index"), F.lit(8).alias("h"), F.lit(8).alias("w"),
                                     F.lit(1).alias("c"), F.col("img").alias("pixels"))
    num = table(spark, sf, "embeddings").count()
    manifest = pack_tensor(q, num, scratch_path(spark, "pack"), rows_per_part=128)
    back = read_pack(spark, manifest)
    return back.select("index", "h", "w", "c", F.hex("pixels").alias("pixels_hex"))


@register("pack_completeness", """
SELECT CAST(count(*) + 3 AS BIGINT) AS n_expected, count(*) AS n_present, CAST(3 AS BIGINT) AS n_missing,
       CAST(0 AS BIGINT) AS n_duplicate, CAST(0 AS BIGINT) AS n_out_of_range, CAST(1 AS BIGINT) AS n_shapes
FROM embeddings""")
def q_pack_completeness(spark, sf):
    from shardforge.operators.pack import pack_report
    q = table(spark, sf, "embeddings").select(F.col("vec_id").alias("index"), F.lit(8).alias("h"),
                                                F.lit(8).alias("w"), F.lit(1).alias("c"))
    num = q.count() + 3
    return pack_report(q, num)


@register("retention_split", """
SELECT lpad(CAST(event_id AS VARCHAR), 10, '0') AS path, user_id AS worker,
       CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, lpad(CAST(event_id AS VARCHAR), 10, '0') DESC) <= 3
            THEN 'keep' ELSE 'ship' END AS action
FROM events""")
def q_retention_split(spark, sf):
    from shardforge.operators.publish import retention_split
    ev = table(spark, sf, "events").select(F.format_string("%010d", "event_id").alias("path"),
                                           F.col("user_id").alias("worker"), F.col("ts").alias("created"))
    return retention_split(ev, 3).select("path", "worker", "action")


@register("stream_shards", """
SELECT lpad(CAST(event_id AS VARCHAR), 10, '0') AS key, event_type AS type, value FROM events""")
def q_stream_shards(spark, sf):
    """Records of a few bytes: plain shards would take 2,068 bytes for each."""
    from shardforge.constants import SHARD_NAME_GZ
    from shardforge.sources.tarshards import read_shards
    from shardforge.streaming.stream_shards import stream_shards
    schema = table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).parquet(os.path.join(sf, "events*.parquet"))
    out = scratch_path(spark, "stream-shards")
    keyed = stream.withColumn("key", F.format_string("%010d", "event_id"))
    q = stream_shards(keyed, out, out + "-checkpoint", per_shard=1000, key_col="key",
                      member_cols={"type": "event_type", "value": F.col("value").cast("string")}, pattern=SHARD_NAME_GZ)
    q.awaitTermination()
    back = read_shards(spark, out, "shard bigint, key string, type string, value double", pattern=SHARD_NAME_GZ)
    return back.select("key", "type", "value")


@register("stream_shards_open", """
SELECT key, type, CAST(w + 4 * (p // 150) AS BIGINT) AS shard
FROM (SELECT lpad(CAST(event_id AS VARCHAR), 10, '0') AS key, event_type AS type, event_id % 4 AS w,
             row_number() OVER (PARTITION BY event_id % 4 ORDER BY event_id) - 1 AS p FROM events)""")
def q_stream_shards_open(spark, sf):
    """Two epochs with unfinished shards carried over: the lower half of the
    events first, then the rest, so shards fill in key order across epochs."""
    from shardforge.sources.tarshards import read_shards
    from shardforge.streaming.stream_shards import flush_open_shards, stream_shards
    ev = table(spark, sf, "events").select("event_id", "event_type")
    mid = ev.agg(F.avg("event_id")).first()[0]
    src, out, ckpt = (scratch_path(spark, n) for n in ("open-in", "open-out", "open-checkpoint"))
    for part in (ev.where(F.col("event_id") <= mid), ev.where(F.col("event_id") > mid)):
        part.write.mode("append").parquet(src)
        stream = spark.readStream.schema(ev.schema).parquet(src)
        stream_shards(stream.withColumn("key", F.format_string("%010d", "event_id")), out, ckpt, per_shard=150,
                      key_col="key", member_cols={"type": "event_type"}, writers=4, keep_open=True,
                      writer=F.pmod(F.col("key").cast("bigint"), F.lit(4))).awaitTermination()
    flush_open_shards(spark, out, ckpt, writers=4)
    return read_shards(spark, out, "shard bigint, key string, type string").select("key", "type", "shard")


@register("pack_job", """
SELECT vec_id AS "index", 8 AS h, 8 AS w, 1 AS c, 64 AS n_bytes FROM embeddings""")
def q_pack_job(spark, sf):
    """Plan, sample, quantise and pack in one job, read back from the parts."""
    from shardforge.jobs import generate_pack
    from shardforge.operators.pack import read_pack
    ids = table(spark, sf, "embeddings").select(F.col("vec_id").alias("sample_id"))
    manifest = generate_pack(spark, ids, ids.count(), scratch_path(spark, "pack-job"), (8, 8, 1), rows_per_part=128)
    return read_pack(spark, manifest).select("index", "h", "w", "c", F.length("pixels").alias("n_bytes"))


@register("assign_shards_bytes", """
WITH RECURSIVE d AS (
  SELECT doc_id, worker, CAST(n_chars AS DOUBLE) AS size, row_number() OVER (PARTITION BY worker ORDER BY doc_id) - 1 AS p
  FROM (SELECT *, CASE WHEN doc_id % 7 > 0 THEN doc_id % 4 END AS worker FROM documents)),
r(worker, p, doc_id, idx, cnt, sz) AS (
  SELECT worker, p, doc_id, 0, 1, size FROM d WHERE p = 0
  UNION ALL
  SELECT d.worker, d.p, d.doc_id,
         CASE WHEN r.cnt >= 100 OR r.sz >= 50000 THEN r.idx + 1 ELSE r.idx END,
         CASE WHEN r.cnt >= 100 OR r.sz >= 50000 THEN 1 ELSE r.cnt + 1 END,
         CASE WHEN r.cnt >= 100 OR r.sz >= 50000 THEN d.size ELSE r.sz + d.size END
  FROM r JOIN d ON d.worker IS NOT DISTINCT FROM r.worker AND d.p = r.p + 1)
SELECT doc_id, CAST(worker AS BIGINT) AS worker, CAST(p AS BIGINT) AS pos_in_worker,
       CAST(worker + idx * 4 AS BIGINT) AS shard FROM r""")
def q_assign_shards_bytes(spark, sf):
    from shardforge.operators.shards import assign_shards_bytes
    # some records have no worker: they are kept, without a shard
    d = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 7 > 0, F.col("doc_id") % 4).alias("worker"), "n_chars")
    # chunks of 128 positions so that the chunked roll-over and its
    # resolution across chunks both run on this small table
    return assign_shards_bytes(d, "worker", ["doc_id"], "n_chars", 100, 50000, 4, chunk_rows=128).select(
        "doc_id", "worker", "pos_in_worker", "shard")


@register("shard_job", f"""
SELECT CAST(floor(floor(vec_id / 64) / 2) * 4 + floor((vec_id % 64) / 16) AS BIGINT) AS shard,
       count(*) AS rows,
       CAST(sum(64 + length(CAST({S.randint(0, 'label', 'vec_id', 0, 999)} AS VARCHAR))) AS BIGINT) AS bytes
FROM embeddings GROUP BY 1""")
def q_shard_job(spark, sf):
    """The restartable job end to end (plan, seeded labels and latents,
    model-path sampling, quantise, committed tar shards); the committed
    progress records are the result."""
    from shardforge.jobs import generate_shards
    ids = table(spark, sf, "embeddings").select(F.col("vec_id").alias("sample_id"))
    prog = generate_shards(spark, ids, scratch_path(spark, "shard-job"), batch=16, workers=4, per_shard=32,
                           latent_dim=64, num_steps=20, run_id="job")
    return prog.select("shard", "rows", "bytes")


@register("publish_shards", """
SELECT 'shards-' || lpad(CAST(shard AS VARCHAR), 5, '0') || '.tar' AS file, TRUE AS ok
FROM (SELECT shard, row_number() OVER (PARTITION BY shard % 4 ORDER BY shard DESC) AS rn
      FROM (SELECT DISTINCT event_id // 100 AS shard FROM events))
WHERE rn > 3""")
def q_publish_shards(spark, sf):
    """F6 end to end: shards written from events, listed from the folder
    (creation order = shard number, so the result is deterministic), all
    but the newest 3 of every worker (shard mod 4) shipped and removed."""
    from shardforge.operators.publish import publish, shard_listing
    from shardforge.sources.tarshards import write_shards
    ev = table(spark, sf, "events")
    src, dst = scratch_path(spark, "publish-src"), scratch_path(spark, "publish-dst")
    write_shards(ev.select(F.floor(F.col("event_id") / 100).cast("bigint").alias("shard"),
                           F.format_string("%010d", "event_id").alias("key"),
                           F.col("event_type").alias("type")), src)
    listing = shard_listing(spark, src, workers=4)
    listing = listing.withColumn("created", F.regexp_extract("path", r"(\d+)\.tar$", 1).cast("bigint"))
    shipped = publish(listing, dst, keep=3)
    return shipped.select(F.regexp_extract("dst", r"([^/]+)$", 1).alias("file"), "ok")
