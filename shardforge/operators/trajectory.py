"""Velocity -> score -> drift (B2), classifier-free guidance (B3) and the
whole sampling trajectory per row (B4).

Two execution paths for B4:

* ``sample_batch``: the loop is ``aggregate(sequence(steps), x0, step)`` on
  an array column, with the velocity given as a Column-building function.
  Rows are independent: no shuffle, no Python.
* ``sample_batch_arrow``: the velocity is any NumPy callable (a model);
  ``mapInArrow`` hands it Arrow batches of rows and the step loop runs in
  NumPy per batch, the same way the reference runs one device batch.

Both draw the noise of element e at step i from the seeded normal stream
("noise", sample_id, i * dim + e), so they agree with each other and with
any partitioning.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardforge.functions.counter import normals
from shardforge.functions.rng import normal_block
from shardforge.functions.vectors import let
from shardforge.plans.schedule import guided_flag, schedule_array, t_at
from shardforge import constants as K

VelocityFn = Callable[[Column, Column, Column], Column]


def path_coefficients(t: Column, path: str = "linear") -> tuple[Column, Column]:
    """score = A * v + B * x for the interpolation path at time t."""
    if path == "linear":
        # alpha = 1 - t, alpha' = -1, sigma = t, sigma' = 1: ratio = t - 1, var = t
        return (t - F.lit(1.0)) / t, F.lit(-1.0) / t
    if path == "cosine":
        h = F.lit(math.pi / 2.0)
        alpha, sigma = F.cos(t * h), F.sin(t * h)
        d_alpha, d_sigma = -h * F.sin(t * h), h * F.cos(t * h)
        ratio = alpha / d_alpha
        var = sigma * sigma - ratio * d_sigma * sigma
        return ratio / var, F.lit(-1.0) / var
    raise ValueError(f"unknown path type {path!r}")


def score_from_velocity(v: Column, x: Column, t: Column, path: str = "linear") -> Column:
    """Element-wise score of an array column from the velocity prediction."""
    a, b = path_coefficients(t, path)
    return F.zip_with(v, x, lambda ve, xe: a * ve + b * xe)


def drift(v: Column, x: Column, t: Column, path: str = "linear") -> Column:
    """d = v - 0.5 * g * score with diffusion g = 2t."""
    a, b = path_coefficients(t, path)
    half_g = t  # 0.5 * (2 t)
    return F.zip_with(v, x, lambda ve, xe: ve - half_g * (a * ve + b * xe))


def stack_guidance(label: Column, null_class: int = K.NULL_CLASS) -> Column:
    """The doubled batch of a guided step, as a 2-element label array
    [y, null]; the model is applied to both entries of the same row."""
    return F.array(label.cast("int"), F.lit(null_class))


def guidance_combine(d_cond: Column, d_uncond: Column, scale: float) -> Column:
    """d_u + s * (d_c - d_u), element-wise."""
    s = F.lit(float(scale))
    return F.zip_with(d_cond, d_uncond, lambda c, u: u + s * (c - u))


def affine_velocity(null_class: int = K.NULL_CLASS, cond_slope: float = 0.1, cond_shift: float = 0.05,
                    null_slope: float = 0.5) -> VelocityFn:
    """A small stand-in model: v = (cond_slope * y) * x + cond_shift for a
    class y, v = null_slope * x for the null class."""
    def v(x: Column, t: Column, y: Column) -> Column:
        slope = F.when(y == F.lit(null_class), F.lit(null_slope)).otherwise(F.lit(cond_slope) * y.cast("double"))
        shift = F.when(y == F.lit(null_class), F.lit(0.0)).otherwise(F.lit(cond_shift))
        return F.transform(x, lambda e: slope * e + shift)
    return v


def _guided_drift(velocity: VelocityFn, x: Column, t: Column, y: Column, cfg: float,
                  null_class: int, path: str) -> Column:
    d_c = drift(velocity(x, t, y), x, t, path)
    d_u = drift(velocity(x, t, F.lit(null_class)), x, t, path)
    return guidance_combine(d_c, d_u, cfg)


def sample_batch(df: DataFrame, velocity: VelocityFn, latent_col: str = "latent",
                 label_col: str = "label", id_col: str = "sample_id", num_steps: int = 20,
                 cfg: float = K.CFG_SCALE, low: float = K.GUIDANCE_LOW, high: float = K.GUIDANCE_HIGH,
                 path: str = "linear", final_guidance: str = "always", seed: int = 0,
                 null_class: int = K.NULL_CLASS, t0: float = K.T_START, t1: float = K.T_END, precision: str = "double",
                 out_col: str = "sample", latent_dim: int | None = None,
                 noise_key: str = "sample") -> DataFrame:
    """Euler-Maruyama with classifier-free guidance over an array column.

    Steps 0..n-2 are noisy (x + d dt + sqrt(g) eps sqrt|dt|), guided when
    t_cur lies in [low, high] (and cfg > 1); the last step is the
    deterministic x + dt d, guided always ("always", as in the reference's
    production sampler) or by the same interval test ("interval").
    ``precision="float"`` rounds the state to float32 after every step;
    ``noise_key="shared"`` gives every sample the same noise per step."""
    n = num_steps
    if n < 2:
        raise ValueError("need at least 2 steps")
    y = F.col(label_col)
    if noise_key not in ("sample", "shared"):
        raise ValueError("noise_key must be 'sample' or 'shared'")
    # "shared": every sample sees the same noise at a step (the earlier
    # sampler variants), "sample": noise keyed by the sample id
    sid = F.col(id_col) if noise_key == "sample" else F.lit(0).cast("bigint")
    dim = latent_dim or len(df.select(latent_col).first()[0])

    def to_prec(arr: Column) -> Column:
        if precision == "float":
            return F.transform(arr, lambda e: e.cast("float").cast("double"))
        return arr

    def step(x: Column, i: Column) -> Column:
        t = t_at(i, n, t0, t1)
        t_next = t_at(i + 1, n, t0, t1)
        dt = t_next - t
        g = F.lit(2.0) * t
        # the conditioned drift is computed once and reused by the guided branch
        d = let(drift(velocity(x, t, y), x, t, path), lambda d_c: F.when(
            guided_flag(t, cfg, low, high),
            guidance_combine(d_c, drift(velocity(x, t, F.lit(null_class)), x, t, path), cfg)
        ).otherwise(d_c))
        noise_scale = F.sqrt(g) * F.sqrt(F.abs(dt))
        moved = F.zip_with(x, d, lambda xe, de: xe + de * dt)
        eps = normal_block(seed, "noise", sid, i.cast("bigint") * F.lit(dim), dim)
        return to_prec(F.zip_with(moved, eps, lambda me, ee: me + noise_scale * ee))

    x0 = to_prec(F.col(latent_col).cast("array<double>"))
    x_last = F.aggregate(F.sequence(F.lit(0), F.lit(n - 2)), x0, step)

    def final(x: Column) -> Column:
        t = F.lit(float(t1))
        dt = F.lit(0.0 - float(t1))
        if final_guidance == "always":
            d = _guided_drift(velocity, x, t, y, cfg, null_class, path)
        else:
            d = F.when(guided_flag(t, cfg, low, high),
                       _guided_drift(velocity, x, t, y, cfg, null_class, path)
                       ).otherwise(drift(velocity(x, t, y), x, t, path))
        return to_prec(F.zip_with(x, d, lambda xe, de: xe + dt * de))

    # the loop result is bound once, then the final step reads it
    from shardforge.session import ensure_parallelism
    tmp = "_x_loop"
    return ensure_parallelism(df).withColumn(tmp, x_last).withColumn(out_col, final(F.col(tmp))).drop(tmp)


# --------------------------------------------------------------------------
# Arrow / NumPy path
# --------------------------------------------------------------------------

MAX_WEIGHT_BYTES = 2 << 30

def np_hashed_normals(seed, stream: str, keys: np.ndarray, idx: np.ndarray) -> np.ndarray:
    """The same seeded normal stream as ``normal_block``, computed in the
    Python task: result[r, k] = normal(seed, stream, keys[r], idx[k]) with
    one md5 per Box-Muller pair."""
    import hashlib

    idx = np.asarray(idx, dtype=np.int64)
    pairs = np.unique(idx // 2)
    pos = np.searchsorted(pairs, idx // 2)
    cos_side = (idx % 2) == 0
    prefix = f"{seed}:{stream}:"
    out = np.empty((len(keys), len(idx)), dtype=np.float64)
    md5 = hashlib.md5
    for r, key in enumerate(keys):
        base = f"{prefix}{int(key)}:"
        digests = [md5(f"{base}{m}".encode()).hexdigest() for m in pairs.tolist()]
        u1 = (np.array([int(h[:13], 16) for h in digests], dtype=np.float64) + 0.5) / 4503599627370496.0
        u2 = (np.array([int(h[16:29], 16) for h in digests], dtype=np.float64) + 0.5) / 4503599627370496.0
        rad = np.sqrt(-2.0 * np.log(u1))[pos]
        th = (2.0 * math.pi * u2)[pos]
        out[r] = np.where(cos_side, rad * np.cos(th), rad * np.sin(th))
    return out


def np_drift(v: np.ndarray, x: np.ndarray, t: float, path: str) -> np.ndarray:
    if path == "linear":
        a, b = (t - 1.0) / t, -1.0 / t
    else:
        h = math.pi / 2
        alpha, sigma = math.cos(t * h), math.sin(t * h)
        ratio = alpha / (-h * math.sin(t * h))
        var = sigma * sigma - ratio * (h * math.cos(t * h)) * sigma
        a, b = ratio / var, -1.0 / var
    return v - t * (a * v + b * x)


def np_affine_velocity(null_class: int = K.NULL_CLASS, cond_slope=0.1, cond_shift=0.05, null_slope=0.5):
    def v(x: np.ndarray, t: float, y: np.ndarray) -> np.ndarray:
        is_null = (y == null_class)[:, None]
        cond = (cond_slope * y.astype(np.float64))[:, None] * x + cond_shift
        return np.where(is_null, null_slope * x, cond)
    return v


def sample_batch_arrow(df: DataFrame, velocity_np, latent_col: str = "latent",
                       label_col: str = "label", id_col: str = "sample_id", num_steps: int = 20,
                       cfg: float = K.CFG_SCALE, low: float = K.GUIDANCE_LOW,
                       high: float = K.GUIDANCE_HIGH, path: str = "linear",
                       final_guidance: str = "always", seed: int = 0, null_class: int = K.NULL_CLASS,
                       t0: float = K.T_START, t1: float = K.T_END, noise: str = "hashed",
                       out_col: str = "sample", batch_rows: int = 1024,
                       noise_key: str = "sample", precision: str = "double", weights: dict | None = None,
                       max_weight_bytes: int = MAX_WEIGHT_BYTES) -> DataFrame:
    """Same trajectory with a NumPy velocity callable ``velocity_np(x, t, y)``
    (x: (rows, dim) float64, y: (rows,) int) applied per Arrow batch.

    ``noise="hashed"`` reproduces the Column path exactly (md5 per element,
    fine for small latents); ``noise="counter"`` draws all rows of a batch at
    once from ``functions.counter`` (element i * dim + e of the sample's
    sequence at step i), for large latents; ``noise="philox"`` has a NumPy
    generator for each (seed, sample_id). Each is a stream of its own.
    ``precision="float"`` rounds the state to float32 after every step, as the
    Column path does.

    ``weights`` (named arrays) go to the executors as one broadcast, unpacked
    once in each worker, and ``velocity_np(x, t, y, weights)`` gets them; they
    are no part of the tasks' closure. Their size is checked first."""
    from shardforge.session import ensure_parallelism, ship_package
    ship_package(df.sparkSession)
    if noise not in ("hashed", "counter", "philox") or precision not in ("double", "float"):
        raise ValueError(f"noise {noise!r} or precision {precision!r} is unknown")
    model = velocity_np
    if weights is not None:
        size = sum(np.asarray(w).nbytes for w in weights.values())
        if size > max_weight_bytes:
            raise ValueError(f"weights of {size} bytes are more than max_weight_bytes ({max_weight_bytes})")
        sent = df.sparkSession.sparkContext.broadcast({k: np.asarray(w) for k, w in weights.items()})

        def model(x, t, y):
            return velocity_np(x, t, y, sent.value)

    def rounded(x):
        return x.astype(np.float32).astype(np.float64) if precision == "float" else x
    df = ensure_parallelism(df)
    grid = schedule_array(num_steps, t0, t1)
    n = num_steps

    def guided(t: float) -> bool:
        return cfg > 1.0 and low <= round(t, 9) <= high

    def run(batches):
        for whole in batches:
            # bounded working memory: the step loop runs on slices of at most
            # ``batch_rows`` rows (the device batch of the reference)
            for off in range(0, whole.num_rows, batch_rows):
                yield from run_slice(whole.slice(off, batch_rows))

    def run_slice(batch):
        if batch.num_rows == 0:
            return
        from shardforge.functions.arrowbatch import from_matrix, to_matrix
        keys = batch.column(id_col).to_numpy().astype(np.int64)
        if noise_key == "shared":
            keys = np.zeros_like(keys)
        ys = batch.column(label_col).to_numpy().astype(np.int64)
        x = rounded(to_matrix(batch.column(latent_col)))
        dim = x.shape[1]
        rngs = None
        if noise == "philox":
            rngs = [np.random.Generator(np.random.Philox(key=[seed, int(k)])) for k in keys]
        null = np.full_like(ys, null_class)
        for i in range(n - 1):
            t, tn = grid[i], grid[i + 1]
            dt = tn - t
            if guided(t):
                dc = np_drift(model(x, t, ys), x, t, path)
                du = np_drift(model(x, t, null), x, t, path)
                d = du + cfg * (dc - du)
            else:
                d = np_drift(model(x, t, ys), x, t, path)
            if noise == "philox":
                eps = np.stack([g.standard_normal(dim) for g in rngs])
            elif noise == "counter":
                eps = normals(seed, "noise", keys, i * dim, dim)
            else:
                eps = np_hashed_normals(seed, "noise", keys, np.arange(dim) + i * dim)
            x = rounded(x + d * dt + math.sqrt(2.0 * t) * eps * math.sqrt(abs(dt)))
        t = grid[n - 1]
        dt = grid[n] - t
        if final_guidance == "always" or guided(t):
            dc = np_drift(model(x, t, ys), x, t, path)
            du = np_drift(model(x, t, null), x, t, path)
            d = du + cfg * (dc - du)
        else:
            d = np_drift(model(x, t, ys), x, t, path)
        x = rounded(x + dt * d)
        yield batch.append_column(out_col, from_matrix(x))

    from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType
    schema = StructType(list(df.schema.fields) + [StructField(out_col, ArrayType(DoubleType()))])
    return df.mapInArrow(run, schema)
