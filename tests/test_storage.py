"""Shards, images, packs and publication on a local folder and on a store
without renames; typed members, indexes, digests and the dense pack file."""

import hashlib
import os
import zlib
from datetime import date, datetime, timezone
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests import objectstore
from tests.conftest import SF_SMALL


@pytest.fixture(params=["file", objectstore.SCHEME])
def place(request, spark, tmp_path):
    """A function from a folder name to its URI in one of the two stores."""
    objectstore.use(spark)
    return (lambda name: str(tmp_path / name)) if request.param == "file" else (lambda name: objectstore.uri(tmp_path / name))


def _simple(spark, n=80, shards=8):
    return spark.range(n).select((F.col("id") % shards).alias("shard"), F.format_string("%06d", "id").alias("key"),
                                 F.col("id").alias("v"), F.lit(b"abc").alias("b"))


def _images(spark, ids):
    return spark.createDataFrame([(i, 2, 3, 1) for i in ids], "index bigint, h int, w int, c int").withColumn(
        "pixels", F.unhex(F.lpad(F.hex("index"), 12, "0")))


def test_shards_on_both_stores(spark, place):
    from shardforge.jobs import intact_shards
    from shardforge.sources.storage import storage
    from shardforge.sources.tarshards import committed_files, read_progress, read_shards, write_shards
    out, schema = place("s"), "shard bigint, key string, v bigint, b binary"
    want = sorted(map(tuple, _simple(spark).collect()))
    write_shards(_simple(spark), out, run_id="a")
    assert sorted(map(tuple, read_shards(spark, out, schema).collect())) == want
    bad = _simple(spark).withColumn("v", F.when(F.col("key") == "000077", F.raise_error(F.lit("boom"))).otherwise(F.col("v") + 1))
    with pytest.raises(Exception, match="boom"):
        write_shards(bad, out, run_id="b")
    assert sorted(map(tuple, read_shards(spark, out, schema).collect())) == want       # the failed job changed nothing
    write_shards(_simple(spark).where("shard = 2").withColumn("v", F.col("v") + 1000), out, run_id="c")
    assert {r["v"] // 1000 for r in read_shards(spark, out, schema, shards=[2]).collect()} == {1}
    assert intact_shards(spark, out).count() == 8
    write_shards(_simple(spark).where("shard = 3"), out, mode="overwrite")
    assert [r["shard"] for r in read_progress(spark, out).collect()] == [3]
    assert {r["shard"] for r in read_shards(spark, out).collect()} == {3}
    assert len(committed_files(storage(spark, out))) == 1


def test_images_overwrite_on_both_stores(spark, place):
    from shardforge.sources.imagefolder import read_image_folder, write_image_folder
    out = place("img")
    write_image_folder(_images(spark, range(5)), out)
    write_image_folder(_images(spark, [3, 9]), out)
    assert sorted(r["index"] for r in read_image_folder(spark, out).collect()) == [0, 1, 2, 3, 4, 9]
    write_image_folder(_images(spark, [7, 8]), out, mode="overwrite")
    got = read_image_folder(spark, out).collect()
    assert sorted((r["index"], r["h"], r["w"], r["c"], bytes(r["pixels"])) for r in got) == [(i, 2, 3, 1, i.to_bytes(6, "big")) for i in (7, 8)]


def test_pack_on_both_stores(spark, place, tmp_path):
    from shardforge.operators.pack import dense_pack, merge_pack, pack_tensor, read_pack
    m = pack_tensor(_images(spark, range(100)), 100, place("p"), rows_per_part=16)
    assert sorted((r["index"], bytes(r["pixels"])) for r in read_pack(spark, m).collect()) == [(i, i.to_bytes(6, "big")) for i in range(100)]
    whole, placed = str(tmp_path / "whole.npz"), str(tmp_path / "placed.npz")
    merge_pack(m, whole)
    dense_pack(m, placed)
    assert open(whole, "rb").read() == open(placed, "rb").read()
    assert np.load(placed)["arr_0"].shape == (100, 2, 3, 1)
    assert not [n for n in os.listdir(tmp_path) if n.endswith(".tmp")]
    with pytest.raises(ValueError, match="not one tensor"):
        dense_pack(m.where("part <> 2"), str(tmp_path / "hole.npz"))
    with pytest.raises(Exception, match="in places"):
        dense_pack(m, objectstore.uri(tmp_path / "x.npz"))


def test_crc_join():
    from shardforge.operators.pack import crc32_join
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 63, 64, 65, 100_003):
        a, b = rng.bytes(41), rng.bytes(n)
        assert crc32_join(zlib.crc32(a), zlib.crc32(b), n) == zlib.crc32(a + b)


def test_publish_between_stores(spark, place, tmp_path):
    from shardforge.jobs import publish_shards
    from shardforge.sources.tarshards import read_shards, write_shards
    src = place("src")
    write_shards(_simple(spark), src)
    for dst in (str(tmp_path / "d1"), objectstore.uri(tmp_path / "d2")):
        write_shards(_simple(spark), src, mode="overwrite")
        report = publish_shards(spark, src, dst, workers=2, keep=1).collect()
        assert len(report) == 6 and all(r["ok"] for r in report)
        left = {r["shard"] for r in read_shards(spark, src).collect()}
        assert sorted(k % 2 for k in left) == [0, 1]          # the newest of each worker
        shipped = sorted(os.listdir(tmp_path / dst.rsplit("/", 1)[1]))
        assert shipped == [f"shards-{k:05d}.tar" for k in range(8) if k not in left]
    # what was published is read like any folder of shards
    assert read_shards(spark, str(tmp_path / "d1"), "shard bigint, key string, v bigint").count() == 60


TYPED = ("shard bigint, key string, bo boolean, de decimal(20,4), da date, ts timestamp, tn timestamp_ntz, by byte, fl float, db double, "
         "st string, bi binary, it int")


def test_typed_members_and_long_keys(spark, tmp_path):
    from shardforge.sources.tarshards import read_shards, write_shards
    t = datetime(2024, 2, 29, 23, 59, 59, 123456)
    rows = [(0, "k" * 300, True, Decimal("12345678.9012"), date(1999, 1, 2), t.replace(tzinfo=timezone.utc), t, -5, 1.5, float("inf"), "ä\n", b"\0\1", 7),
            (0, "ü/x.y%" + "z" * 120, False, Decimal("-0.0001"), date(1, 1, 1), None, None, None, None, 1e300, "", b"", None),
            (1, "all null", *[None] * 11)]
    df = spark.createDataFrame(rows, TYPED)
    out = str(tmp_path / "t")
    write_shards(df, out)
    assert sorted(map(tuple, read_shards(spark, out, TYPED).collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    with pytest.raises(Exception, match="cast it first"):
        write_shards(df.withColumn("a", F.array("it")), out)


def test_equal_and_null_keys_are_errors(spark, tmp_path):
    from shardforge.sources.tarshards import read_shards, write_shards
    for keys, message in ((["k", "k", "m"], "occurs twice"), (["k", None], "null shard or key")):
        out = str(tmp_path / str(len(keys)))
        df = spark.createDataFrame([(0, k, "v") for k in keys], "shard bigint, key string, t string")
        with pytest.raises(Exception, match=message):
            write_shards(df, out)
        assert read_shards(spark, out).count() == 0


def test_one_large_shard_is_read_by_many_tasks(spark, place):
    from shardforge.sources.storage import storage
    from shardforge.sources.tarshards import ShardFileWriter, committed_files, ranges_of, read_index, read_shards, write_shards
    out, schema = place("big"), "shard bigint, key string, v bigint, b binary"
    df = spark.range(500).select(F.lit(0).cast("bigint").alias("shard"), F.when(F.col("id") % 7 == 0, F.concat(F.lit("long" * 40), "id")).otherwise(
        F.col("id").cast("string")).alias("key"), F.when(F.col("id") % 5 > 0, F.col("id")).alias("v"), F.expr("unhex(repeat('61', cast(id % 900 as int)))").alias("b"))
    write_shards(df, out)
    store = storage(spark, out)
    f = committed_files(store)[0]
    ranges = ranges_of(store, f, 100_000)
    assert len(ranges) >= 7 and ranges[0].start == 0 and all(a.end == b.start for a, b in zip(ranges, ranges[1:]))
    got = read_shards(spark, out, schema, split_bytes=100_000)
    assert got.rdd.getNumPartitions() == len(ranges)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, df.collect()))
    assert sorted(map(tuple, read_shards(spark, out, split_bytes=30_000).collect())) == sorted(map(tuple, read_shards(spark, out).collect()))
    assert read_shards(spark, out, schema, split_bytes=1).count() == 500      # one row per task
    # a tar without the index is read by one task
    plain = place("plain")
    index = read_index(store, f.name, f.size)
    raw = store.read(f.name)[:f.size - 16 - 8 * len(index)]
    storage(spark, plain).write("shards-00000.tar", raw)
    other = read_shards(spark, plain, schema, split_bytes=1)
    assert other.rdd.getNumPartitions() == 1 and sorted(map(tuple, other.collect())) == sorted(map(tuple, df.collect()))
    assert ShardFileWriter is not None


def test_archive_readers_stop_before_the_index(spark, tmp_path):
    import tarfile

    from shardforge.sources.tarshards import write_shards
    write_shards(_simple(spark, 20, 1), str(tmp_path / "x"))
    with tarfile.open(tmp_path / "x" / "shards-00000.tar") as t:
        assert len(t.getnames()) == 40


def test_resume_knows_seed_and_damage(spark, tmp_path):
    from shardforge.jobs import generate_shards, intact_shards
    ids = spark.range(64).withColumnRenamed("id", "sample_id")
    kw = dict(batch=4, workers=2, per_shard=8, latent_dim=4, num_steps=3)
    a, b = str(tmp_path / "a"), str(tmp_path / "b")

    def digests(p):
        return {n: hashlib.sha256(open(os.path.join(p, n), "rb").read()).hexdigest() for n in os.listdir(p) if n.startswith("shards-")}
    generate_shards(spark, ids, a, seed=1, **kw)
    generate_shards(spark, ids, b, seed=2, **kw)
    want = digests(b)
    assert generate_shards(spark, ids, b, run_id="again", seed=2, **kw).count() == 0        # nothing to do
    for n in ("shards-00001.tar", "shards-00004.tar"):
        with open(os.path.join(b, n), "r+b") as f:       # damage that keeps the size
            f.seek(700)
            f.write(b"\xff\xfe")
    assert {r["shard"] for r in intact_shards(spark, b).collect()} == set(range(8)) - {1, 4}
    mended = generate_shards(spark, ids, b, run_id="mend", seed=2, **kw)
    assert {r["shard"] for r in mended.collect()} == {1, 4} and digests(b) == want
    # the shards of seed 1 don't count for seed 2
    assert generate_shards(spark, ids, a, run_id="other", seed=2, **kw).count() == 8 and digests(a) == want
    assert generate_shards(spark, ids, a, run_id="steps", seed=2, **{**kw, "num_steps": 4}).count() == 8


def test_open_shards_survive_a_stop_in_an_epoch(spark, tmp_path):
    """A stop after the state was committed but before the epoch was: the
    restarted query writes byte-identical shards."""
    from shardforge.sources.tarshards import read_shards
    from shardforge.streaming.stream_shards import flush_open_shards, stream_shards
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet").select("event_id", "event_type", "value", F.lit(None).cast("int").alias("none"))

    def run(root, fail):
        src, out, ckpt = (os.path.join(root, n) for n in ("in", "out", "ckpt"))
        for k in range(2):
            ev.where(F.col("event_id") % 2 == k).write.mode("append").parquet(src)
            for attempt in range(2):
                stop = fail and k == 1 and attempt == 0
                stream = spark.readStream.schema(ev.schema).parquet(src).withColumn("key", F.format_string("%010d", "event_id"))
                value = F.when(F.lit(stop) & (F.col("event_id") == 101), F.raise_error(F.lit("stop"))).otherwise(F.col("value")).cast("double")
                q = stream_shards(stream, out, ckpt, per_shard=70, key_col="key", member_cols={"type": "event_type", "value": value, "none": "none"},
                                  writers=3, keep_open=True)
                if stop:
                    with pytest.raises(Exception, match="stop"):
                        q.awaitTermination()
                else:
                    q.awaitTermination()
                    break
        flush_open_shards(spark, out, ckpt, writers=3)
        files = {n: open(os.path.join(out, n), "rb").read() for n in os.listdir(out) if n.startswith("shards-")}
        return files, read_shards(spark, out, "shard bigint, key string, type string, value double, none int").collect()
    files, rows = run(str(tmp_path / "a"), False)
    again, _ = run(str(tmp_path / "b"), True)
    assert files == again
    assert sorted((r["key"], r["type"], r["value"], r["none"]) for r in rows) == sorted(
        (f"{r['event_id']:010d}", r["event_type"], float(r["value"]), None) for r in ev.collect())


def test_idle_shards_are_closed_by_a_timer(spark, tmp_path):
    import time

    from shardforge.sources.tarshards import read_shards
    from shardforge.streaming.stream_shards import stream_shards
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet").select("event_id", "event_type").limit(100)
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    ev.write.parquet(src)
    stream = spark.readStream.schema(ev.schema).parquet(src).withColumn("key", F.format_string("%010d", "event_id"))
    q = stream_shards(stream, out, str(tmp_path / "ckpt"), per_shard=30, key_col="key", member_cols={"type": "event_type"}, writers=2,
                      keep_open=True, available_now=False, flush_after=1)
    deadline = time.time() + 120
    try:
        while time.time() < deadline and q.exception() is None:
            if os.path.isdir(out) and read_shards(spark, out, "shard bigint, key string, type string").count() == 100:
                break
            time.sleep(1)
    finally:
        q.stop()
    sizes = {r["shard"]: r["count"] for r in read_shards(spark, out, "shard bigint, key string, type string").groupBy("shard").count().collect()}
    assert sum(sizes.values()) == 100 and max(sizes.values()) == 30


def test_tiles_are_skipped_and_the_result_is_exact(spark):
    """Clustered vectors: most tiles can't matter, and the top k equals all pairs."""
    from shardforge.operators.similarity import cosine_tiles
    rng = np.random.default_rng(4)
    centres = np.eye(16) * 10
    x = np.concatenate([c + rng.normal(size=(40, 16)) * 0.3 for c in centres])
    rng.shuffle(x)
    ids = np.arange(len(x)) * 7
    df = spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(ids, x)], "i long, v array<double>")
    df = df.unionByName(spark.createDataFrame([(1, None), (None, [1.0] * 16)], "i long, v array<double>"))
    some = df.where("i % 2 = 0")
    got = cosine_tiles(df, some, "i", "i", "v", 0.0, 4, block_rows=32)
    assert got.tiles > 500 and got.computed < got.tiles * 0.5
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    logits = u @ u[ids % 2 == 0].T
    other = ids[ids % 2 == 0]
    want = {("a2b", int(i)): [int(v) for v in other[np.lexsort((other, -np.round(r, 12)))[:4]]] for i, r in zip(ids, logits)}
    want |= {("b2a", int(i)): [int(v) for v in ids[np.lexsort((ids, -np.round(r, 12)))[:4]]] for i, r in zip(other, logits.T)}
    have = {}
    for r in got.rows.orderBy("rank").collect():
        have.setdefault((r["direction"], r["row_id"]), []).append(r["other_id"])
    assert have == want
    assert cosine_tiles(df.limit(0), some, "i", "i", "v", 0.0, 4).rows.count() == 0
    assert cosine_tiles(df, some.limit(0), "i", "i", "v", 0.0, 4).rows.count() == 0


def test_similarity_writes_no_more_than_rows_and_results(spark):
    """Four times the rows have sixteen times the tiles; what is written in
    between must not follow the tiles."""
    from shardforge.operators.similarity import cosine_topk
    from shardforge.session import checkpoint_dir

    def written():
        top = checkpoint_dir(spark).removeprefix("file:")
        return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(top) for f in names)
    rng = np.random.default_rng(8)
    sizes = []
    for n in (300, 1200):
        df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(rng.normal(size=(n, 8)))], "i long, v array<double>")
        before = written()
        assert cosine_topk(df, df, "i", "i", "v", 0.0, 3, block_rows=4).count() == 6 * n
        sizes.append(written() - before)
    assert sizes[1] < 6 * sizes[0]
