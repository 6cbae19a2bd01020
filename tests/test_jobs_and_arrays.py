"""Packs, streams with open shards, image folders and large arrays."""

import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL


def _pack_rows(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "index bigint").select(
        "index", F.lit(1).alias("h"), F.lit(2).alias("w"), F.lit(1).alias("c"),
        F.unhex(F.lpad(F.hex(F.col("index") % 256), 4, "0")).alias("pixels"))


def test_pack_computes_each_row_once(spark, tmp_path):
    from shardforge.operators.pack import pack_tensor, read_pack
    seen = spark.sparkContext.accumulator(0)

    def model(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    rows = _pack_rows(spark, range(500)).repartition(5)
    m = pack_tensor(rows.mapInArrow(model, rows.schema), 500, str(tmp_path), rows_per_part=64)
    assert seen.value == 500
    assert [(r["first_index"], r["rows"]) for r in m.orderBy("part").collect()] == [
        (i, min(64, 500 - i)) for i in range(0, 500, 64)]
    assert [r["index"] for r in read_pack(spark, m).orderBy("index").collect()] == list(range(500))


def test_pack_with_holes_and_repeats(spark, tmp_path):
    from shardforge.operators.pack import pack_tensor, read_pack
    ids = [i for i in range(100) if i not in (7, 8, 64)]
    m = pack_tensor(_pack_rows(spark, ids), 100, str(tmp_path / "a"), rows_per_part=32, check=False)
    got = read_pack(spark, m).select("index", F.hex("pixels")).orderBy("index").collect()
    assert [tuple(r) for r in got] == [(i, f"{i:04X}") for i in ids]
    for wrong in (ids, [*range(100), 5], [*range(100), 100], [*range(99), -1]):
        with pytest.raises(ValueError):
            pack_tensor(_pack_rows(spark, wrong), 100, str(tmp_path / "b"), rows_per_part=32)
    assert os.listdir(tmp_path / "b") == []
    assert pack_tensor(_pack_rows(spark, [0]).limit(0), 0, str(tmp_path / "c")).count() == 0


def test_pack_job_matches_shard_job(spark, tmp_path):
    from shardforge.jobs import generate_pack, generate_shards
    from shardforge.operators.pack import read_pack
    from shardforge.sources.tarshards import read_shards
    ids = spark.range(40).withColumnRenamed("id", "sample_id")
    generate_shards(spark, ids, str(tmp_path / "s"), batch=4, workers=2, per_shard=8, latent_dim=16, num_steps=3)
    m = generate_pack(spark, ids, 40, str(tmp_path / "p"), (4, 4, 1), num_steps=3, rows_per_part=16)
    a = read_shards(spark, str(tmp_path / "s"), "shard bigint, key string, img binary, cls int")
    a = sorted((int("".join(ch for ch in r["key"] if ch.isdigit())), bytes(r["img"])) for r in a.collect())
    assert a == sorted((r["index"], bytes(r["pixels"])) for r in read_pack(spark, m).collect())


def _open_stream(spark, root, width):
    from shardforge.sources.tarshards import read_shards
    from shardforge.streaming.stream_shards import flush_open_shards, stream_shards
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet").select("event_id", "event_type")
    src, out, ckpt = (os.path.join(root, n) for n in ("in", "out", "ckpt"))
    for k in range(3):
        ev.where(F.col("event_id") % 3 == k).repartition(width).write.mode("append").parquet(src)
        stream = spark.readStream.schema(ev.schema).parquet(src).withColumn("key", F.format_string("%010d", "event_id"))
        stream_shards(stream, out, ckpt, per_shard=70, key_col="key", member_cols={"type": "event_type"}, writers=3,
                      keep_open=True).awaitTermination()
    flush_open_shards(spark, out, ckpt, writers=3)
    return ev, read_shards(spark, out, "shard bigint, key string, type string").collect()


def test_open_shards_are_full_but_for_the_last(spark):
    ev, rows = _open_stream(spark, tempfile.mkdtemp(), 2)
    assert sorted((r["key"], r["type"]) for r in rows) == sorted(
        (f"{r['event_id']:010d}", r["event_type"]) for r in ev.collect())
    for w in range(3):
        sizes = {}
        for r in rows:
            if r["shard"] % 3 == w:
                sizes[r["shard"]] = sizes.get(r["shard"], 0) + 1
        assert sorted(sizes) == [w + 3 * k for k in range(len(sizes))]
        assert all(sizes[s] == 70 for s in sorted(sizes)[:-1]) and sizes[max(sizes)] <= 70
    _, again = _open_stream(spark, tempfile.mkdtemp(), 5)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_image_folder_leaves_no_temporary_files(spark, tmp_path):
    from shardforge.sources.imagefolder import write_image_folder
    write_image_folder(_pack_rows(spark, range(30)), str(tmp_path / "img"))
    names = sorted(os.listdir(tmp_path / "img"))
    assert [n for n in names if n.endswith(".png")] == [f"{i:06d}.png" for i in range(30)]
    assert [n for n in names if not n.endswith(".png")] == ["_SUCCESS"]
    bad = _pack_rows(spark, range(30, 60)).withColumn("h", F.when(F.col("index") == 59, 9).otherwise(1)).coalesce(1)
    with pytest.raises(Exception, match="bytes for shape"):
        write_image_folder(bad, str(tmp_path / "bad"))
    assert not [n for n in os.listdir(tmp_path / "bad") if n.endswith(".png")]


def test_large_forms_equal_the_expression_forms(spark):
    from shardforge.functions import ndarrays as N
    from shardforge.functions.arrays import binary_to_pixels, permute_axes, quantise
    from shardforge.operators.grids import grid_resample, patchify
    rng = np.random.default_rng(3)
    data = [(i, [float(x) for x in rng.normal(size=48)]) for i in range(9)] + [(9, None)]
    df = spark.createDataFrame(data, "i int, x array<double>")
    pairs = [
        (permute_axes("x", (3, 4, 4), (1, 2, 0)), N.permute_axes_np(df, "x", "y", (3, 4, 4), (1, 2, 0))),
        (F.flatten(patchify("x", (3, 4, 4), 2)), N.patchify_np(df, "x", "y", (3, 4, 4), 2)),
        (grid_resample("x", 3, 4, 4, 6, 2), N.grid_resample_np(df, "x", "y", 3, 4, 4, 6, 2)),
        (quantise("x"), N.quantise_np(df, "x", "b", 48).select("i", binary_to_pixels("b").alias("y"))),
    ]
    for want, got in pairs:
        a = {r[0]: r[1] for r in df.where("x is not null").select("i", want).collect()}
        b = {r["i"]: r["y"] for r in got.collect()}
        assert b.pop(9) is None and a.keys() == b.keys()
        assert all(np.allclose(a[k], b[k], atol=1e-12) for k in a)
    with pytest.raises(Exception, match="were stated"):
        N.patchify_np(df, "x", "y", (4, 4, 4), 2).collect()


def test_features_of_repeated_ids_and_null_texts(spark):
    from shardforge.operators.features import extract_features, punct_counts
    df = spark.createDataFrame([("a", "x y x"), ("a", None), ("b", ""), ("c", "one")], "k string, t string")
    got = extract_features(df, "k", "t", "hash-bow-7,hash-bigram-5,punct-count-2", {"punct-count": punct_counts}).collect()
    total = {}
    for r in got:
        total[(r["k"], r["encoder"])] = total.get((r["k"], r["encoder"]), 0) + r["value"]
    assert total == {("a", "hash-bow-7"): 3, ("a", "hash-bigram-5"): 2, ("b", "hash-bow-7"): 1, ("c", "hash-bow-7"): 1,
                     ("a", "punct-count-2"): 2, ("b", "punct-count-2"): 0, ("c", "punct-count-2"): 0}
