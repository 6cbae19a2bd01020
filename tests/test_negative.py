"""Invalid inputs fail loudly."""

import tempfile

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL


def test_tile_not_divisible(spark):
    from shardforge.operators.grids import tile_mean
    with pytest.raises(ValueError):
        tile_mean(F.col("x"), (1, 8, 8), 3)
    with pytest.raises(ValueError):
        tile_mean(F.col("x"), (8, 8), 2)


def test_pack_with_missing_index_fails(spark):
    from shardforge.operators.pack import missing_indexes, pack_tensor
    e = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").filter(F.col("vec_id") != 7).select(
        F.col("vec_id").alias("index"), F.lit(1).alias("h"), F.lit(1).alias("w"), F.lit(1).alias("c"),
        F.unhex(F.lit("00")).alias("pixels"))
    with pytest.raises(ValueError):
        pack_tensor(e, 500, tempfile.mkdtemp())
    assert [r["index"] for r in missing_indexes(e, 500).collect()] == [7]


def test_duplicate_after_rewrite_is_reported(spark):
    from shardforge.operators.keytable import assert_no_collisions, key_collisions, rewrite_keys
    df = spark.createDataFrame([(0, "a.norm13"), (0, "a.norm1")], "snapshot int, key string")
    rw = rewrite_keys(df, [{"kind": "replace_if", "cond": "norm13", "pattern": "norm13", "replacement": "norm1"}])
    assert key_collisions(rw, ["snapshot"]).count() == 1
    with pytest.raises(ValueError):
        assert_no_collisions(rw, ["snapshot"])


def test_empty_listing_raises(spark):
    from shardforge.operators.publish import retention_split
    empty = spark.createDataFrame([], "path string, worker bigint, created timestamp, length bigint")
    with pytest.raises(ValueError):
        retention_split(empty, 3)


def test_unknown_path_type(spark):
    from shardforge.operators.trajectory import score_from_velocity
    with pytest.raises(ValueError):
        score_from_velocity(F.col("v"), F.col("x"), F.col("t"), "sigmoid")


def test_malformed_encoder_spec():
    from shardforge.operators.features import parse_encoder_spec
    with pytest.raises(ValueError):
        parse_encoder_spec("hash-bow")
    assert parse_encoder_spec("hash-bow-8,hash-bigram-4") == [("hash", "bow", "8"), ("hash", "bigram", "4")]


def test_non_square_token_count_fails(spark):
    from shardforge.operators.grids import unpatchify
    df = spark.createDataFrame([([[1.0] * 4] * 3,)], "t array<array<double>>")
    with pytest.raises(Exception):
        df.select(unpatchify("t", 1, 2)).collect()


def test_strict_match_fails_on_request(spark):
    from shardforge.operators.keytable import strict_match
    a = spark.createDataFrame([(1,), (2,)], "k long")
    b = spark.createDataFrame([(2,), (3,)], "k long")
    got = {(r["k"], r["kind"]) for r in strict_match(a, b, ["k"]).collect()}
    assert got == {(1, "missing"), (3, "unexpected")}
    with pytest.raises(ValueError):
        strict_match(a, b, ["k"], fail=True)
    assert strict_match(a, a, ["k"], fail=True).count() == 0


def test_shard_numbers_start_after_an_offset(spark):
    from shardforge.operators.shards import assign_shards_count
    d = spark.createDataFrame([(i, i % 2) for i in range(10)], "k long, worker int")
    got = {r["k"]: r["shard"] for r in assign_shards_count(d, "worker", ["k"], 2, 2, start=100).collect()}
    # worker 0 holds 0,2,4,6,8 -> shards 100,100,102,102,104; worker 1 -> 101,...
    assert [got[k] for k in (0, 2, 4, 6, 8)] == [100, 100, 102, 102, 104]
    assert [got[k] for k in (1, 3, 5, 7, 9)] == [101, 101, 103, 103, 105]
