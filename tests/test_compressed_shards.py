"""Shards written through gzip: the disk that records of short values take,
blocks of whole rows, ranges, other readers and both kinds of store."""

import gzip
import io
import os
import tarfile

import pytest
from pyspark.sql import functions as F

from shardforge.constants import SHARD_NAME_GZ
from tests import objectstore

WIDE = "shard bigint, key string, v bigint, b binary"


@pytest.fixture(params=["file", objectstore.SCHEME])
def place(request, spark, tmp_path):
    objectstore.use(spark)
    return (lambda name: str(tmp_path / name)) if request.param == "file" else (lambda name: objectstore.uri(tmp_path / name))


def _rows(spark, n=500, shards=1):
    """Nulls, rows without members, keys with dots, slashes and of some length, payloads of 0 to 898 bytes."""
    key = F.when(F.col("id") % 7 == 0, F.concat(F.lit("long/er." * 20), "id")).otherwise(F.col("id").cast("string"))
    payload = F.when(F.col("id") % 5 < 3, F.expr("unhex(repeat('61', cast(id % 900 as int)))"))
    return spark.range(n).select((F.col("id") % shards).alias("shard"), key.alias("key"), F.when(F.col("id") % 5 > 0, F.col("id")).alias("v"),
                                 F.when(F.col("id") % 5 > 0, payload).alias("b"))


def _sorted(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_the_streams_shards_take_little_more_than_the_records(spark, tmp_path, monkeypatch):
    """Plain shards take 2,068 bytes for an event; 36 million of them 74 GB."""
    from __spark_entry__ import queries

    from shardforge import catalog_shards
    n = 5000
    ev = spark.range(n).select(F.col("id").alias("event_id"), F.lit("click").alias("event_type"),
                               F.round(F.rand(3) * 500, 2).alias("value"))
    ev.write.parquet(str(tmp_path / "sf" / "events.parquet"))
    monkeypatch.setattr(catalog_shards, "scratch_path", lambda spark, name: str(tmp_path / name))
    back = queries()["stream_shards"](spark, str(tmp_path / "sf"))
    assert _sorted(back) == _sorted(spark.read.parquet(str(tmp_path / "sf" / "events.parquet")).select(
        F.format_string("%010d", "event_id"), "event_type", "value"))
    out = tmp_path / "stream-shards"
    files = [out / f for f in os.listdir(out) if f.startswith("shards-")]
    assert sum(os.path.getsize(f) for f in files) < 100 * n
    names = [m for f in files for m in tarfile.open(f).getnames()]      # any tar reader opens them
    assert len(names) == 2 * n and {x.split(".", 1)[1] for x in names} == {"type", "value"}


def test_a_compressed_shard_holds_the_plain_archive(spark, tmp_path):
    from shardforge.sources.storage import storage
    from shardforge.sources.tarshards import read_index, read_progress, write_shards
    write_shards(_rows(spark), str(tmp_path / "plain"))
    write_shards(_rows(spark), str(tmp_path / "gz"), pattern=SHARD_NAME_GZ)
    store = storage(spark, str(tmp_path / "plain"))
    raw = store.read("shards-00000.tar")
    archive = raw[:len(raw) - 16 - 8 * len(read_index(store, "shards-00000.tar", len(raw)))]
    packed = (tmp_path / "gz" / "shards-00000.tar.gz").read_bytes()
    assert gzip.decompress(packed).startswith(archive) and len(packed) < len(raw) / 5
    plain, gz = (read_progress(spark, str(tmp_path / n)).first() for n in ("plain", "gz"))
    assert (gz["rows"], gz["bytes"], gz["size"]) == (plain["rows"], plain["bytes"], len(packed)) and gz["rows"] == 500
    with tarfile.open(tmp_path / "gz" / "shards-00000.tar.gz", mode="r|*") as t:      # as webdataset reads
        assert t.getnames() == tarfile.open(fileobj=io.BytesIO(archive)).getnames()
    write_shards(_rows(spark), str(tmp_path / "again"), pattern=SHARD_NAME_GZ)
    assert (tmp_path / "again" / "shards-00000.tar.gz").read_bytes() == packed


def test_compressed_shards_on_both_stores(spark, place):
    from shardforge.jobs import intact_shards
    from shardforge.sources.storage import storage
    from shardforge.sources.tarshards import read_shards, write_shards
    out, want = place("s"), _sorted(_rows(spark, 300, 4))
    write_shards(_rows(spark, 300, 4), out, pattern=SHARD_NAME_GZ)
    assert _sorted(read_shards(spark, out, WIDE, pattern=SHARD_NAME_GZ)) == want
    assert {r["shard"] for r in intact_shards(spark, out).collect()} == {0, 1, 2, 3}
    assert read_shards(spark, out, WIDE, shards=[2], pattern=SHARD_NAME_GZ).count() == 75
    long = place("long")
    write_shards(_rows(spark, 300, 4), long)
    assert _sorted(read_shards(spark, out, pattern=SHARD_NAME_GZ)) == _sorted(read_shards(spark, long))
    # a copy has the same bytes: nothing is compressed for its name
    store = storage(spark, place("copy"))
    store.write("x.gz", b"abc" * 1000)
    assert store.read("x.gz") == b"abc" * 1000


def test_a_large_compressed_shard_is_read_in_ranges(spark, tmp_path, monkeypatch):
    from pyspark.sql.types import _parse_datatype_string

    from shardforge.sources import tarshards
    from shardforge.sources.storage import storage
    monkeypatch.setattr(tarshards, "GZIP_BLOCK", 20_000)
    rows = _rows(spark).sort("key").collect()
    store = storage(spark, str(tmp_path / "big"))
    w = tarshards.ShardFileWriter(store.open_write("shards-00000.tar.gz"), compress=True)
    for r in rows:
        w.add(r["key"], {m: tarshards.member_bytes(r[m]) for m in ("v", "b") if r[m] is not None})
    w.add("z", {"b": bytes(50_000)})      # more than a block
    w.add("zz", {"v": b"1"})
    w.close()
    assert w.rows == 502
    f = tarshards.committed_files(store, SHARD_NAME_GZ)[0]
    index = tarshards.read_index(store, f.name, f.size)
    assert len(index) > 20 and index[0] == 0
    ranges = tarshards.ranges_of(store, f, 2000)
    assert len(ranges) >= 5 and ranges[0].start == 0 and ranges[-1].end == index[-1]
    assert all(a.end == b.start for a, b in zip(ranges, ranges[1:]))
    schema = _parse_datatype_string(WIDE)
    reader = tarshards.TarShardsReader({"path": str(tmp_path / "big"), "pattern": SHARD_NAME_GZ, "split_bytes": "2000"}, schema)
    got = [list(reader.read(p)) for p in reader.partitions()]
    assert len(got) >= 5 and all(got)
    want = [tuple(r) for r in rows] + [(0, "z", None, bytes(50_000)), (0, "zz", 1, None)]
    assert [x for part in got for x in part] == want
    # each block by itself, and the whole file by one task
    one = tarshards.TarShardsReader({"path": str(tmp_path / "big"), "pattern": SHARD_NAME_GZ, "split_bytes": "1"}, schema)
    assert len(one.partitions()) == len(index) - 1 and [x for p in one.partitions() for x in one.read(p)] == want
    all_ = tarshards.TarShardsReader({"path": str(tmp_path / "big"), "pattern": SHARD_NAME_GZ}, schema)
    assert [x for p in all_.partitions() for x in all_.read(p)] == want


def test_a_compressed_shard_from_elsewhere_is_read_by_one_task(spark, tmp_path):
    from shardforge.sources.tarshards import read_shards
    os.mkdir(tmp_path / "x")
    for shard, mode in ((0, "w:gz"), (1, "w")):      # the name says nothing: a plain archive is read as well
        with tarfile.open(tmp_path / "x" / f"shards-{shard:05d}.tar.gz", mode) as t:
            for i in range(50):
                info = tarfile.TarInfo(f"{i:03d}.v")
                info.size = len(str(i))
                t.addfile(info, io.BytesIO(str(i).encode()))
    got = read_shards(spark, str(tmp_path / "x"), "shard bigint, key string, v bigint", split_bytes=1, pattern=SHARD_NAME_GZ)
    assert got.rdd.getNumPartitions() == 2
    assert _sorted(got) == _sorted(spark.createDataFrame([(s, f"{i:03d}", i) for s in (0, 1) for i in range(50)], "s long, k string, v long"))


def test_a_cut_compressed_shard_is_an_error(spark, tmp_path):
    from shardforge.sources.tarshards import read_shards, write_shards
    write_shards(_rows(spark), str(tmp_path / "x"), pattern=SHARD_NAME_GZ)
    name = tmp_path / "x" / "shards-00000.tar.gz"
    name.write_bytes(name.read_bytes()[:2000])
    with pytest.raises(Exception, match="EOFError|ended before|unexpected end"):
        read_shards(spark, str(tmp_path / "x"), WIDE, pattern=SHARD_NAME_GZ).count()


def test_open_shards_can_be_compressed(spark, tmp_path):
    from shardforge.sources.tarshards import read_shards
    from shardforge.streaming.stream_shards import flush_open_shards, stream_shards
    src, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    for part in (range(0, 120), range(120, 250)):
        ev = spark.createDataFrame([(f"{i:05d}", f"t{i % 3}") for i in part], "key string, type string")
        ev.write.mode("append").parquet(src)
        stream_shards(spark.readStream.schema(ev.schema).parquet(src), out, ckpt, per_shard=40, key_col="key",
                      member_cols={"type": "type"}, writers=2, keep_open=True, pattern=SHARD_NAME_GZ).awaitTermination()
    flush_open_shards(spark, out, ckpt, writers=2, pattern=SHARD_NAME_GZ)
    assert all(n.endswith(".tar.gz") for n in os.listdir(out) if n.startswith("shards-"))
    back = read_shards(spark, out, "shard bigint, key string, type string", pattern=SHARD_NAME_GZ)
    assert sorted((r["key"], r["type"]) for r in back.collect()) == [(f"{i:05d}", f"t{i % 3}") for i in range(250)]
