"""Counter-based normals and the sampler's weights, noise and precision."""

import pickle

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from shardforge.functions import counter
from tests.conftest import SF_SMALL


@pytest.mark.parametrize("words,key,want", [      # the published known answers
    ((0, 0, 0, 0), (0, 0), (0x6627e8d5, 0xe169c58d, 0xbc57ac4c, 0x9b00dbd8)),
    ((0xffffffff,) * 4, (0xffffffff, 0xffffffff), (0x408f276d, 0x41c83b0e, 0xa20bc7c6, 0x6d5451fd)),
    ((0x243f6a88, 0x85a308d3, 0x13198a2e, 0x03707344), (0xa4093822, 0x299f31d0), (0xd16cfe09, 0x94fdcceb, 0x5001e420, 0x24126ea1))])
def test_known_answers(words, key, want):
    got = counter.philox(*[np.array([w], np.uint64) for w in words], key)
    assert tuple(int(w[0]) for w in got) == want


def one(seed, stream, key, j):
    """One element, with Python integers only."""
    import hashlib
    import math
    k = int.from_bytes(hashlib.sha256(f"{seed}:{stream}".encode()).digest()[:8], "little")
    k0, k1, m, key = k & 0xffffffff, k >> 32, j // 2, key % 2 ** 64
    c = [m & 0xffffffff, m >> 32, key & 0xffffffff, key >> 32]
    for _ in range(10):
        p0, p1 = 0xD2511F53 * c[0], 0xCD9E8D57 * c[2]
        c = [(p1 >> 32) ^ c[1] ^ k0, p1 & 0xffffffff, (p0 >> 32) ^ c[3] ^ k1, p0 & 0xffffffff]
        k0, k1 = (k0 + 0x9E3779B9) & 0xffffffff, (k1 + 0xBB67AE85) & 0xffffffff
    u1, u2 = (((a >> 5) * 2 ** 26 + (b >> 6) + 0.5) / 2 ** 53 for a, b in ((c[0], c[1]), (c[2], c[3])))
    return math.sqrt(-2 * math.log(u1)) * (math.cos if j % 2 == 0 else math.sin)(2 * math.pi * u2)


def test_latents_of_orders_at_any_partitioning(spark):
    o = spark.read.parquet(f"{SF_SMALL}/orders.parquet").select("o_orderkey")
    n = 4 * 32 * 32
    rows = [counter.counter_normals(o.repartition(p), 3, "latent", "o_orderkey", n, "z").select(
        "o_orderkey", F.slice("z", 1, 3).alias("head"), F.slice("z", n - 2, 3).alias("tail"), F.size("z").alias("n")).orderBy("o_orderkey").collect()
        for p in (1, 7)]
    assert rows[0] == rows[1] and {r["n"] for r in rows[0]} == {n}
    for r in rows[0][::97]:
        assert np.allclose(r["head"] + r["tail"], [one(3, "latent", r["o_orderkey"], j) for j in (0, 1, 2, n - 3, n - 2, n - 1)], atol=1e-12)
    for start, dim in ((0, 1), (1, 5), (7, 8), (2 ** 33 + 1, 3)):
        part = counter.counter_normals(o.limit(3), 3, "latent", "o_orderkey", dim, "z", start=start).collect()
        for r in part:
            assert np.allclose(r["z"], [one(3, "latent", r["o_orderkey"], start + j) for j in range(dim)], atol=1e-12)


def test_moments_nulls_and_float():
    z = counter.normals(1, "s", np.arange(-200, 200), 0, 1000)
    assert abs(z.mean()) < 0.01 and abs(z.std() - 1) < 0.01 and abs((z ** 3).mean()) < 0.03
    assert len(np.unique(z)) == z.size and abs(np.corrcoef(z[:-1].ravel(), z[1:].ravel())[0, 1]) < 0.01


def test_null_keys_and_float_values(spark):
    df = spark.createDataFrame([(1,), (None,), (-5,)], "k long")
    got = {r["k"]: r["z"] for r in counter.counter_normals(df, 1, "s", "k", 4, "z", precision="float").collect()}
    assert got[None] is None and got[-5] == [float(np.float32(one(1, "s", -5, j))) for j in range(4)]
    assert counter.counter_normals(df.limit(0), 1, "s", "k", 4, "z").count() == 0


@pytest.mark.parametrize("precision", ["double", "float"])
def test_arrow_path_equals_column_path(spark, precision):
    from shardforge.operators.trajectory import affine_velocity, np_affine_velocity, sample_batch, sample_batch_arrow
    e = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").limit(60).select(
        F.col("vec_id").alias("sample_id"), "label", F.slice(F.col("embedding").cast("array<double>"), 1, 8).alias("latent"))
    a = {r["sample_id"]: r["sample"] for r in sample_batch(e, affine_velocity(), num_steps=6, seed=1, precision=precision, latent_dim=8).collect()}
    b = {r["sample_id"]: r["sample"] for r in sample_batch_arrow(e, np_affine_velocity(), num_steps=6, seed=1, precision=precision).collect()}
    assert a.keys() == b.keys() and all(np.allclose(a[k], b[k], rtol=1e-5 if precision == "float" else 1e-10) for k in a)
    if precision == "float":
        assert all(x == float(np.float32(x)) for v in b.values() for x in v)


def test_weights_are_broadcast(spark, monkeypatch):
    from shardforge.operators.trajectory import sample_batch_arrow
    e = spark.range(200).select(F.col("id").alias("sample_id"), F.lit(1).alias("label"), F.expr("array(1d, 2d, 3d, 4d)").alias("latent")).repartition(4)
    big = {"w": np.full((1000, 1000), 0.25)}

    def model(x, t, y, w):
        return x * w["w"][0, 0]
    got = sample_batch_arrow(e, model, num_steps=5, seed=2, noise="counter", weights=big)
    want = sample_batch_arrow(e, lambda x, t, y: x * 0.25, num_steps=5, seed=2, noise="counter")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    # what the tasks carry: the function that mapInArrow gets
    sent = []
    monkeypatch.setattr(type(e), "mapInArrow", lambda self, func, *_: sent.append(len(cloudpickle.dumps(func))))
    sample_batch_arrow(e, model, num_steps=5, seed=2, noise="counter", weights=big)
    assert sent and sent[-1] < 50_000 < len(pickle.dumps(big))
    with pytest.raises(ValueError, match="max_weight_bytes"):
        sample_batch_arrow(e, model, weights=big, max_weight_bytes=1000)
