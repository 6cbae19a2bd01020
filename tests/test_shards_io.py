"""Shard writer commit protocol, publication and image round trips."""

import os

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL


def _records(spark):
    from shardforge.functions.arrays import pixels_to_binary, quantise
    e = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    return e.select((F.col("vec_id") / 64).cast("bigint").alias("shard"),
                    F.format_string("%010d", "vec_id").alias("key"),
                    pixels_to_binary(quantise("embedding")).alias("img"), F.col("label").alias("cls"))


def test_failed_task_leaves_no_shard(spark, tmp_path):
    from shardforge.sources.tarshards import write_shards
    recs = _records(spark)
    boom = recs.withColumn("cls", F.when(F.col("key") == "0000000300",
                                         F.raise_error(F.lit("boom"))).otherwise(F.col("cls")))
    out = str(tmp_path / "shards")
    with pytest.raises(Exception):
        write_shards(boom, out)
    assert not os.path.exists(out) or not [n for n in os.listdir(out) if n.startswith("shards-")]
    write_shards(recs, out)
    first = sorted(n for n in os.listdir(out) if n.startswith("shards-"))
    write_shards(recs, out, mode="overwrite")
    assert sorted(n for n in os.listdir(out) if n.startswith("shards-")) == first
    assert not [n for n in os.listdir(out) if n.startswith(".tmp-")]


def test_reader_prunes_shards_and_members(spark, tmp_path):
    from shardforge.sources.tarshards import read_shards, read_progress, write_shards
    out = str(tmp_path / "s")
    write_shards(_records(spark), out, run_id="r1")
    assert read_shards(spark, out, shards=[1, 2]).select("shard").distinct().count() == 2
    n = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").count()
    assert read_shards(spark, out, exts=["cls"]).count() == n
    prog = read_progress(spark, out)
    assert prog.agg(F.sum("rows")).first()[0] == n


def test_publish_keeps_newest_and_moves_the_rest(spark, tmp_path):
    from shardforge.operators.publish import publish, shard_listing
    from shardforge.sources.tarshards import write_shards
    src, dst = str(tmp_path / "src"), str(tmp_path / "dst")
    write_shards(_records(spark), src)
    listing = shard_listing(spark, src, workers=1)
    n_files = listing.count()
    res = publish(listing, dst, keep=1).collect()
    assert len(res) == n_files - 1 and all(r["ok"] for r in res)
    assert len([n for n in os.listdir(src) if n.endswith(".tar")]) == 1
    assert len(os.listdir(dst)) == n_files - 1


def test_png_codec_round_trip():
    import numpy as np

    from shardforge.sources.imagefolder import decode_png, encode_png
    a = (np.arange(5 * 7 * 3) % 256).astype(np.uint8).reshape(5, 7, 3)
    assert (decode_png(encode_png(a)) == a).all()


def test_pack_merge(spark, tmp_path):
    import numpy as np

    from shardforge.operators.pack import merge_pack, pack_tensor
    e = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").filter(F.col("vec_id") < 200).select(
        F.col("vec_id").alias("index"), F.lit(1).alias("h"), F.lit(2).alias("w"), F.lit(1).alias("c"),
        F.unhex(F.lpad(F.hex((F.col("vec_id") % 256).cast("int")), 4, "0")).alias("pixels"))
    m = pack_tensor(e, 200, str(tmp_path / "pack"), rows_per_part=64)
    assert m.count() == 4
    path = merge_pack(m, str(tmp_path / "pack.npz"))
    arr = np.load(path)["arr_0"]
    assert arr.shape == (200, 1, 2, 1)
    assert int(arr[199, 0, 1, 0]) == 199


def test_resume_from_committed_progress(spark, tmp_path):
    from shardforge.plans.plan import resume_from_shards, sample_plan
    from shardforge.sources.tarshards import write_shards
    plan = sample_plan(spark, 256, batch=8, workers=2, per_shard=32)
    out = str(tmp_path / "run")
    first_half = plan.filter(F.col("shard") < 4).select(
        "shard", F.format_string("%010d", "sample_id").alias("key"), F.col("worker").alias("cls"))
    write_shards(first_half, out, run_id="r")
    rest = resume_from_shards(plan, spark, out, run_id="r")
    assert rest.count() == 256 - first_half.count()
    assert rest.filter(F.col("shard") < 4).count() == 0


def test_parity_counts_shape_mismatch(spark):
    from shardforge.operators.keytable import parity
    a = spark.createDataFrame([(1, 1.0, "2x2"), (2, 2.0, "3"), (3, 3.0, "1")], "k long, v double, s string")
    b = spark.createDataFrame([(1, 1.0, "2x2"), (2, 2.5, "4"), (4, 0.0, "1")], "k long, v double, s string")
    r = parity(a, b, ["k"], "v", 6, shape_col="s").collect()[0]
    assert (r["n_common"], r["n_only_a"], r["n_only_b"], r["n_beyond"], r["worst_key"], r["n_shape_mismatch"]) == \
        (2, 1, 1, 1, 2, 1)


def test_run_counters_filled_by_the_write(spark, tmp_path):
    from shardforge.operators.metrics import observe_run
    from shardforge.sources.tarshards import write_shards
    recs = _records(spark).withColumn("size", F.length("img"))
    observed, obs = observe_run(recs, "size")
    write_shards(observed.drop("size"), str(tmp_path / "o"))
    got = obs.get
    n = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").count()
    assert got["rows"] == n and got["bytes"] == 64 * n and got["max_record_bytes"] == 64


def test_png_members_round_trip(spark, tmp_path):
    from shardforge.sources.imagefolder import decode_png, with_png
    from shardforge.sources.tarshards import read_shards, write_shards
    recs = with_png(_records(spark), "img", 8, 8, 1, "png")
    out = str(tmp_path / "png")
    write_shards(recs.select("shard", "key", "png", "cls"), out)
    back = {r["key"]: r["png"] for r in read_shards(spark, out, "shard bigint, key string, png binary, cls int").collect()}
    raw = {r["key"]: r["img"] for r in _records(spark).collect()}
    assert back.keys() == raw.keys()
    for k in list(raw)[:50]:
        assert decode_png(back[k]).tobytes() == bytes(raw[k])


def test_resumed_job_writes_the_same_shards(spark, tmp_path):
    import hashlib

    from shardforge.jobs import generate_shards, publish_shards
    ids = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").select(F.col("vec_id").alias("sample_id"))
    kw = dict(batch=8, workers=2, per_shard=32, latent_dim=16, num_steps=5)
    full, part = str(tmp_path / "full"), str(tmp_path / "part")
    generate_shards(spark, ids, full, run_id="a", **kw)
    # a run that stopped after the first shards, then a resume of the rest
    generate_shards(spark, ids, part, run_id="a", shard_filter=F.col("shard") < 5, **kw)
    resumed = generate_shards(spark, ids, part, run_id="b", **kw)
    assert resumed.agg(F.min("shard")).first()[0] >= 5

    def digests(p):
        return {n: hashlib.md5(open(os.path.join(p, n), "rb").read()).hexdigest()
                for n in os.listdir(p) if n.startswith("shards-")}
    assert digests(full) == digests(part)
    shipped = publish_shards(spark, full, str(tmp_path / "pub"), workers=2, keep=1).collect()
    assert all(r["ok"] for r in shipped)
    assert len([n for n in os.listdir(full) if n.startswith("shards-")]) == 2  # newest per worker
