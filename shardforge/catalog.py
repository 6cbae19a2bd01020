"""Registered queries: one per operator of the inventory, each over the
driver's tables, with its DuckDB oracle SQL where one exists.

Column names are aliased identically on both sides; floats are rounded last
(6 places) on both sides."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardforge import sqltwins as S
from shardforge.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SEED = 0


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def r6(c):
    return F.round(c, 6)


# --------------------------------------------------------------------------
# A. planning and seeded columns
# --------------------------------------------------------------------------

@register("sample_plan", """
SELECT o_orderkey AS sample_id,
       CAST(floor((o_orderkey % 256) / 64) AS INTEGER) AS worker,
       CAST(floor(o_orderkey / 256) AS BIGINT) AS iteration,
       CAST(o_orderkey % 64 AS INTEGER) AS slot,
       CAST(floor(floor(o_orderkey / 256) / 4) * 4 + floor((o_orderkey % 256) / 64) AS BIGINT) AS shard
FROM orders""")
def q_sample_plan(spark, sf):
    from shardforge.plans.plan import assign_plan
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("sample_id"))
    return assign_plan(o, "sample_id", batch=64, workers=4, per_shard=256)


@register("seeded_uniform", f"""
SELECT o_orderkey, round({S.u(SEED, 'init', 'o_orderkey')}, 6) AS u,
       round(-0.5 + {S.u(SEED, 'init', 'o_orderkey', '1')}, 6) AS u_centered,
       {S.randint(SEED, 'label', 'o_orderkey', 0, 999)} AS label
FROM orders""")
def q_seeded_uniform(spark, sf):
    from shardforge.functions.rng import seeded_randint, seeded_uniform
    o = table(spark, sf, "orders").select("o_orderkey")
    k = F.col("o_orderkey")
    return o.select("o_orderkey", r6(seeded_uniform(SEED, "init", k)).alias("u"),
                    r6(seeded_uniform(SEED, "init", k, 1, -0.5, 0.5)).alias("u_centered"),
                    seeded_randint(SEED, "label", k, 0, 999).alias("label"))


@register("seeded_normal", f"""
SELECT o_orderkey, CAST(j AS INTEGER) AS j, round({S.normal(SEED, 'latent', 'o_orderkey', 'j')}, 6) AS z
FROM orders, range(8) t(j)""")
def q_seeded_normal(spark, sf):
    from shardforge.functions.rng import seeded_normal
    from shardforge.session import ensure_parallelism
    o = ensure_parallelism(table(spark, sf, "orders").select("o_orderkey"))
    z = o.select("o_orderkey", seeded_normal(SEED, "latent", F.col("o_orderkey"), 8).alias("z"))
    return z.select("o_orderkey", F.posexplode_outer("z").alias("j", "z")).select("o_orderkey", "j", r6(F.col("z")).alias("z"))


LATENT = 4 * 32 * 32


@register("counter_normals", f"""
WITH b AS ({S.counter_normal_pairs(SEED, 'latent', 'c_custkey', 'm', f'(SELECT c_custkey, m FROM customer, range({LATENT // 2}) r(m))')})
SELECT c_custkey, CAST({LATENT} AS INTEGER) AS n, round(any_value(z0) FILTER (m = 0), 6) AS z_first, round(any_value(z1) FILTER (m = 1023), 6) AS z_2047,
       round(any_value(z1) FILTER (m = {LATENT // 2 - 1}), 6) AS z_last, round(sum(z0 + z1), 4) AS total, round(sum(z0 * z0 + z1 * z1), 4) AS squares
FROM b GROUP BY c_custkey""")
def q_counter_normals(spark, sf):
    """A3 at the reference's latent size: a 4 x 32 x 32 latent of every
    customer, and the same sequence read from its middle on."""
    from shardforge.functions.counter import counter_normals
    from shardforge.session import ensure_parallelism
    c = ensure_parallelism(table(spark, sf, "customer").select("c_custkey"))
    z = counter_normals(c, SEED, "latent", "c_custkey", LATENT, "z")
    z = counter_normals(z, SEED, "latent", "c_custkey", 1, "mid", start=2047)

    def added(f):
        return F.round(F.aggregate("z", F.lit(0.0), lambda s, v: s + f(v)), 4)
    return z.select("c_custkey", F.size("z").alias("n"), r6(F.get("z", F.lit(0))).alias("z_first"), r6(F.get("mid", F.lit(0))).alias("z_2047"),
                    r6(F.get("z", F.lit(LATENT - 1))).alias("z_last"), added(lambda v: v).alias("total"), added(lambda v: v * v).alias("squares"))


@register("seeded_trunc_normal", f"""
SELECT c_custkey,
       round({S.trunc_normal(SEED, 'trunc', 'c_custkey')}, 6) AS v,
       round({S.trunc_normal(SEED, 'trunc02', 'c_custkey', 0.0, 0.02, -0.04, 0.04)}, 6) AS v_small
FROM customer""")
def q_seeded_trunc_normal(spark, sf):
    from shardforge.functions.rng import seeded_trunc_normal
    c = table(spark, sf, "customer").select("c_custkey")
    k = F.col("c_custkey")
    return c.select("c_custkey", r6(seeded_trunc_normal(SEED, "trunc", k)).alias("v"),
                    r6(seeded_trunc_normal(SEED, "trunc02", k, 0.0, 0.02, -0.04, 0.04)).alias("v_small"))


@register("label_dropout", f"""
SELECT vec_id, label,
       CASE WHEN {S.u(SEED, 'drop', 'vec_id')} < {S.d(0.1)} THEN 1000 ELSE label END AS label_in,
       CASE WHEN vec_id % 7 = 0 THEN 1000 ELSE label END AS label_forced
FROM embeddings""")
def q_label_dropout(spark, sf):
    from shardforge.operators.labels import label_dropout
    e = table(spark, sf, "embeddings").select("vec_id", "label")
    force = F.when(F.col("vec_id") % 7 == 0, F.lit(1)).otherwise(F.lit(0))
    return e.select("vec_id", "label",
                    label_dropout(F.col("label"), F.col("vec_id"), 0.1, 1000, SEED).alias("label_in"),
                    label_dropout(F.col("label"), F.col("vec_id"), 0.1, 1000, SEED, force=force).alias("label_forced"))


# --------------------------------------------------------------------------
# B. schedule and trajectory
# --------------------------------------------------------------------------

def _t_sql(i: str, n: int, t0=1.0, t1=0.04) -> str:
    delta = (t1 - t0) / (n - 1)
    return (f"(CASE WHEN {i} >= {n} THEN 0.0 WHEN {i} = {n - 1} THEN {S.d(t1)} "
            f"ELSE {S.d(t0)} + CAST({i} AS DOUBLE) * {S.d(delta)} END)")


def _steps_sql(n: int) -> str:
    t_cur = _t_sql("step", n)
    t_next = _t_sql("step + 1", n)
    guided = f"(round({t_cur}, 9) >= 0.0 AND round({t_cur}, 9) <= {S.d(0.7)})"
    return f"""
SELECT vec_id AS sample_id, CAST(step AS INTEGER) AS step,
       {t_cur} AS t_cur, {t_next} AS t_next, {t_next} - {t_cur} AS dt,
       2.0 * {t_cur} AS g, step = {n - 1} AS is_final,
       CASE WHEN step = {n - 1} THEN 0.0 ELSE sqrt(2.0 * {t_cur}) * sqrt(abs({t_next} - {t_cur})) END AS noise_scale,
       CASE WHEN step = {n - 1} THEN TRUE ELSE {guided} END AS guided
FROM embeddings, range({n}) s(step)"""


@register("step_plan", f"""
SELECT sample_id, step, round(t_cur, 6) AS t_cur, round(t_next, 6) AS t_next, round(dt, 6) AS dt,
       round(g, 6) AS g, is_final, round(noise_scale, 6) AS noise_scale, guided,
       CASE WHEN guided THEN 2 ELSE 1 END AS model_rows
FROM ({_steps_sql(50)})""")
def q_step_plan(spark, sf):
    from shardforge.plans.schedule import step_plan
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("sample_id"))
    s = step_plan(e, 50)
    return s.select("sample_id", "step", *[r6(F.col(c)).alias(c) for c in ("t_cur", "t_next", "dt", "g")],
                    "is_final", r6(F.col("noise_scale")).alias("noise_scale"), "guided", "model_rows")


@register("step_cost", f"""
SELECT guided, count(*) AS n_steps, CAST(sum(CASE WHEN guided THEN 2 ELSE 1 END) AS BIGINT) AS model_rows
FROM ({_steps_sql(250)}) GROUP BY ROLLUP (guided)""")
def q_step_cost(spark, sf):
    from shardforge.plans.schedule import step_cost, step_plan
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("sample_id"))
    return step_cost(step_plan(e, 250))


def _coef_sql(t: str, path: str):
    if path == "linear":
        return f"(({t} - 1.0) / {t})", f"(-1.0 / {t})"
    h = S.d(math.pi / 2)
    alpha, sigma = f"cos({t} * {h})", f"sin({t} * {h})"
    d_alpha, d_sigma = f"(-{h} * sin({t} * {h}))", f"({h} * cos({t} * {h}))"
    ratio = f"({alpha} / {d_alpha})"
    var = f"({sigma} * {sigma} - {ratio} * {d_sigma} * {sigma})"
    return f"({ratio} / {var})", f"(-1.0 / {var})"


def _drift_sql(v: str, x: str, t: str, path: str = "linear") -> str:
    a, b = _coef_sql(t, path)
    return f"({v} - {t} * ({a} * {v} + {b} * {x}))"


_T_ROW = "(0.05 + CAST(vec_id % 19 AS DOUBLE) * 0.05)"
_VC = "((0.1 * CAST(label AS DOUBLE)) * x + 0.05)"
_VU = "(0.5 * x)"


def _score_sql():
    al, bl = _coef_sql("t", "linear")
    ac, bc = _coef_sql("t", "cosine")
    return f"""
SELECT vec_id, j, round({al} * v + {bl} * x, 6) AS score_linear, round({ac} * v + {bc} * x, 6) AS score_cosine
FROM (SELECT vec_id, CAST(j AS INTEGER) AS j, x, {_T_ROW} AS t, {_VC} AS v
      FROM (SELECT vec_id, label, j, CAST(embedding[j + 1] AS DOUBLE) AS x FROM embeddings, range(64) r(j)))"""


def _t_row_col():
    return F.lit(0.05) + (F.col("vec_id") % 19).cast("double") * F.lit(0.05)


@register("score_from_velocity", _score_sql())
def q_score_from_velocity(spark, sf):
    from shardforge.operators.trajectory import affine_velocity, score_from_velocity
    e = table(spark, sf, "embeddings")
    x = F.col("embedding").cast("array<double>")
    t = _t_row_col()
    v = affine_velocity()(x, t, F.col("label"))
    s = e.select("vec_id", score_from_velocity(v, x, t, "linear").alias("sl"),
                 score_from_velocity(v, x, t, "cosine").alias("sc"))
    return (s.select("vec_id", F.posexplode_outer(F.arrays_zip("sl", "sc")).alias("j", "z"))
            .select("vec_id", "j", r6(F.col("z.sl")).alias("score_linear"), r6(F.col("z.sc")).alias("score_cosine")))


@register("guidance_combine", f"""
SELECT vec_id, j, round(du + 1.8 * (dc - du), 6) AS d
FROM (SELECT vec_id, CAST(j AS INTEGER) AS j, {_drift_sql(_VC, 'x', 't')} AS dc, {_drift_sql(_VU, 'x', 't')} AS du
      FROM (SELECT vec_id, label, j, CAST(embedding[j + 1] AS DOUBLE) AS x, {_T_ROW} AS t
            FROM embeddings, range(64) r(j)))""")
def q_guidance_combine(spark, sf):
    from shardforge.operators.trajectory import (affine_velocity, drift, guidance_combine,
                                                 stack_guidance)
    e = table(spark, sf, "embeddings")
    x = F.col("embedding").cast("array<double>")
    t = _t_row_col()
    vel = affine_velocity()
    ds = F.transform(stack_guidance(F.col("label")), lambda lbl: drift(vel(x, t, lbl), x, t))
    d = e.select("vec_id", guidance_combine(ds[0], ds[1], 1.8).alias("d"))
    return d.select("vec_id", F.posexplode_outer("d").alias("j", "d")).select("vec_id", "j", r6(F.col("d")).alias("d"))


def _sample_batch_sql(n: int = 20, dim: int = 8, cfg: float = 1.8, counter: bool = False) -> str:
    t = _t_sql("step", n)
    tn = _t_sql("step + 1", n)
    guided = f"(round({t}, 9) >= 0.0 AND round({t}, 9) <= {S.d(0.7)})"
    dc = _drift_sql(_VC, "x", t)
    du = _drift_sql(_VU, "x", t)
    d = f"(CASE WHEN {guided} THEN {du} + {cfg} * ({dc} - {du}) ELSE {dc} END)"
    eps, noise, join = S.normal(SEED, "noise", "sample_id", f"(step * {dim} + e)"), "", ""
    if counter:
        pairs = S.counter_normal_pairs(SEED, "noise", "vec_id", "m", f"(SELECT vec_id, m FROM embeddings, range({dim * (n - 1) // 2}) r(m))")
        noise = (f"pairs AS ({pairs}), eps AS MATERIALIZED (SELECT vec_id, 2 * m AS i, z0 AS z FROM pairs "
                 "UNION ALL SELECT vec_id, 2 * m + 1, z1 FROM pairs), ")
        eps, join = "z", f" JOIN eps ON eps.vec_id = sample_id AND eps.i = step * {dim} + e"
    step_sql = f"x + {d} * ({tn} - {t}) + sqrt(2.0 * {t}) * sqrt(abs({tn} - {t})) * {eps}"
    tf = S.d(0.04)
    dcf = _drift_sql(_VC, "x", tf)
    duf = _drift_sql(_VU, "x", tf)
    final = f"x + (0.0 - {tf}) * ({duf} + {cfg} * ({dcf} - {duf}))"
    return f"""
WITH RECURSIVE {noise}traj(sample_id, label, e, step, x) AS (
  SELECT vec_id, label, CAST(e AS INTEGER), 0, CAST(embedding[e + 1] AS DOUBLE) FROM embeddings, range({dim}) r(e)
  UNION ALL
  SELECT sample_id, label, e, step + 1, {step_sql} FROM traj{join} WHERE step < {n - 1}
)
SELECT sample_id, e, round({final}, 6) AS x FROM traj WHERE step = {n - 1}"""


@register("sample_batch", _sample_batch_sql(dim=64))
def q_sample_batch(spark, sf):
    from shardforge.operators.trajectory import affine_velocity, sample_batch
    # the whole 64-value embedding is the 4x4x4 latent
    e = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("sample_id"), "label", F.col("embedding").alias("latent"))
    s = sample_batch(e, affine_velocity(), num_steps=20, seed=SEED, latent_dim=64)
    return (s.select("sample_id", F.posexplode_outer("sample").alias("e", "x"))
            .select("sample_id", "e", r6(F.col("x")).alias("x")))


@register("sample_batch_arrow", _sample_batch_sql(dim=64))
def q_sample_batch_arrow(spark, sf):
    """B4 through the model path: a NumPy velocity callable over Arrow
    batches, same hashed noise stream, so the same oracle applies."""
    from shardforge.operators.trajectory import np_affine_velocity, sample_batch_arrow
    e = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("sample_id"), "label", F.col("embedding").cast("array<double>").alias("latent"))
    s = sample_batch_arrow(e, np_affine_velocity(), num_steps=20, seed=SEED)
    return (s.select("sample_id", F.posexplode_outer("sample").alias("e", "x"))
            .select("sample_id", "e", r6(F.col("x")).alias("x")))


def _affine_weights(x, t, y, w):
    """The affine model with its numbers as weights."""
    import numpy as np
    cond = (w["cond_slope"] * y.astype(np.float64))[:, None] * x + w["cond_shift"]
    return np.where((y == w["null_class"])[:, None], w["null_slope"] * x, cond)


@register("sample_batch_weights", _sample_batch_sql(dim=64, counter=True))
def q_sample_batch_weights(spark, sf):
    """B4 with a model whose weights are a broadcast, and counter-based noise."""
    import numpy as np

    from shardforge import constants as K
    from shardforge.operators.trajectory import sample_batch_arrow
    e = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("sample_id"), "label", F.col("embedding").cast("array<double>").alias("latent"))
    weights = {"cond_slope": np.float64(0.1), "cond_shift": np.float64(0.05), "null_slope": np.float64(0.5), "null_class": np.int64(K.NULL_CLASS)}
    s = sample_batch_arrow(e, _affine_weights, num_steps=20, seed=SEED, noise="counter", weights=weights)
    return (s.select("sample_id", F.posexplode_outer("sample").alias("e", "x"))
            .select("sample_id", "e", r6(F.col("x")).alias("x")))


# --------------------------------------------------------------------------
# F8. resume
# --------------------------------------------------------------------------

@register("resume_plan", """
SELECT o_orderkey AS shard, o_custkey, o_totalprice FROM orders o
WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)""")
def q_resume_plan(spark, sf):
    from shardforge.plans.plan import resume_plan
    plan = table(spark, sf, "orders").select(F.col("o_orderkey").alias("shard"), "o_custkey", "o_totalprice")
    progress = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("shard"))
    return resume_plan(plan, progress, "shard")


def _import_all():
    # further query groups register themselves on import
    from shardforge import catalog_arrays, catalog_features, catalog_keys, catalog_large, catalog_shards  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _import_all()
    return dict(QUERIES)


def positive_zero_rounding(sql: str) -> str:
    """Wrap every ``round(...)`` as ``(round(...) + 0.0)``. DuckDB rounds a
    tiny negative value to -0.0 where Spark gives 0.0; adding +0.0 turns
    -0.0 into 0.0 and changes nothing else."""
    out, i, low = [], 0, sql.lower()
    while True:
        j = low.find("round(", i)
        if j < 0 or (j > 0 and (low[j - 1].isalnum() or low[j - 1] == "_")):
            if j < 0:
                out.append(sql[i:])
                return "".join(out)
            out.append(sql[i:j + 6])
            i = j + 6
            continue
        depth, k = 0, j + 5
        while True:
            if sql[k] == "(":
                depth += 1
            elif sql[k] == ")":
                depth -= 1
                if depth == 0:
                    break
            k += 1
        inner = positive_zero_rounding(sql[j + 6:k])
        out.append(sql[i:j] + "(round(" + inner + ") + 0.0)")
        i = k + 1


def oracle_sql() -> dict[str, str]:
    _import_all()
    return {name: positive_zero_rounding(sql) for name, sql in ORACLES.items()}

