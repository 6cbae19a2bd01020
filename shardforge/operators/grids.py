"""Grid and token layout operators (C3-C8).

Array form first: one row per sample holds its whole grid or token list, and
each operator is a ``transform`` over a static index table — no shuffle.
Long-form twins (one row per element or token) are given where the
operation is a relational one (gather by a mask table, token union)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardforge.functions.arrays import gather, gather_reduce_mean, gather_weighted_sum
from shardforge.functions.rng import seeded_uniform
from shardforge.functions.vectors import let, position_features, vec_add
from shardforge.operators.positions import global_positions
from shardforge import constants as K


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


# -- C3 tile mean ----------------------------------------------------------

def tile_groups(shape, p: int) -> list[list[int]]:
    """Index groups of the p x p tiles of a (C, H, W) grid, ordered tile
    major then channel (the (tokens, channels) layout)."""
    if len(shape) != 3:
        raise ValueError("tile_mean needs a (C, H, W) shape")
    c, h, w = shape
    if h % p or w % p:
        raise ValueError(f"grid of {h} x {w} cannot be cut into {p} x {p} tiles")
    th, tw = h // p, w // p
    groups = []
    for ty in range(th):
        for tx in range(tw):
            for ch in range(c):
                groups.append([ch * h * w + (ty * p + dy) * w + tx * p + dx
                               for dy in range(p) for dx in range(p)])
    return groups


def tile_mean(arr, shape, p: int) -> Column:
    """Mean over p x p tiles: flat (tile, channel) array of length
    (H/p)(W/p)C."""
    return gather_reduce_mean(arr, tile_groups(shape, p))


def tile_mean_long(df: DataFrame, sample_col: str, c_col: str, y_col: str, x_col: str,
                   value_col: str, p: int, width: int, height: int) -> DataFrame:
    """Long-form twin: group by (sample, tile, channel) and average."""
    if height % p or width % p:
        raise ValueError(f"grid of {height} x {width} cannot be cut into {p} x {p} tiles")
    tile = F.floor(F.col(y_col) / p) * (width // p) + F.floor(F.col(x_col) / p)
    return (df.groupBy(F.col(sample_col), tile.cast("int").alias("tile"), F.col(c_col))
            .agg(F.avg(value_col).alias("mean")))


# -- C4 patchify / unpatchify ---------------------------------------------

def patch_index(shape, p: int) -> list[int]:
    """Source pixel for each (token, feature) of the patchified grid: token
    t = hi * (W/p) + wi, feature f = (pi * p + qi) * C + ci."""
    c, h, w = shape
    if h % p or w % p:
        raise ValueError("grid size must be divisible by the patch size")
    ht, wt = h // p, w // p
    idx = []
    for hi in range(ht):
        for wi in range(wt):
            for pi in range(p):
                for qi in range(p):
                    for ci in range(c):
                        idx.append(ci * h * w + (hi * p + pi) * w + wi * p + qi)
    return idx


def patchify(arr, shape, p: int) -> Column:
    """(C, H, W) -> tokens: ARRAY<ARRAY<DOUBLE>> of (H/p)(W/p) tokens, each
    p*p*C values."""
    c, h, w = shape
    k = p * p * c
    n_tok = (h // p) * (w // p)
    return let(gather(arr, patch_index(shape, p)), lambda flat: F.transform(
        F.sequence(F.lit(0), F.lit(n_tok - 1)), lambda t: F.slice(flat, t * k + 1, k)))


def unpatchify(tokens, channels: int, p: int) -> Column:
    """Tokens -> flat (C, H, W) grid; the token count must be a square."""
    tokens = _c(tokens)
    # the token count is data; check it per row and fail loudly
    n_tok = F.size(tokens)
    side = F.sqrt(n_tok).cast("int")
    ok = side * side == n_tok
    # inverse index: pixel (ci, y, x) <- token (y//p)*side + x//p, feature ((y%p)*p + x%p)*C + ci
    h = side * p
    k = p * p * channels
    npix = h * h * channels

    def src(i):
        ci = F.floor(i / (h * h))
        rem = i - ci * h * h
        y = F.floor(rem / h)
        x = rem - y * h
        tok = F.floor(y / p) * side + F.floor(x / p)
        feat = (F.pmod(y, F.lit(p)) * p + F.pmod(x, F.lit(p))) * channels + ci
        return (tok * k + feat).cast("int")

    body = let(F.flatten(tokens), lambda flat: F.transform(
        F.sequence(F.lit(0), (npix - 1).cast("int")), lambda i: flat[src(i)]))
    return F.when(ok, body).otherwise(F.raise_error(F.lit("token count is not a square")))


# -- C5 gather tokens --------------------------------------------------------

def random_masks(samples: DataFrame, id_col: str, n_tokens: int, n_masks: int,
                 keep: float, seed: int = 0) -> DataFrame:
    """Per sample and mask, the kept positions (seeded), as an ordered
    ARRAY<INT> column ``positions`` — one row per (mask_id, sample)."""
    pos = F.sequence(F.lit(0), F.lit(n_tokens - 1))
    rows = []
    for m in range(n_masks):
        key = F.col(id_col) * F.lit(n_tokens)
        kept = F.filter(pos, lambda q: seeded_uniform(seed, f"mask{m}", key + q) < F.lit(keep))
        rows.append(samples.select(F.lit(m).alias("mask_id"), F.col(id_col), kept.alias("positions")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def gather_tokens(tokens, positions) -> Column:
    """Keep the listed token positions of one sample, in list order."""
    return let(_c(tokens), lambda toks: F.transform(_c(positions), lambda q: toks[q]))


def gather_tokens_long(tokens: DataFrame, masks: DataFrame, id_col: str = "sample_id") -> DataFrame:
    """Long-form gather: tokens (sample, pos, vec) joined with mask rows
    (mask_id, sample, ord, pos); the concatenation over masks is the union
    of the mask ids. An equi-join on (sample, pos): both sides grow with
    the data, so the optimizer picks the strategy (AQE may broadcast a
    small mask table at runtime)."""
    return tokens.join(masks, [id_col, "pos"]).select("mask_id", id_col, "ord", "pos", *[
        c for c in tokens.columns if c not in (id_col, "pos")])


def drop_first(arr) -> Column:
    arr = _c(arr)
    return F.slice(arr, 2, F.size(arr) - 1)


def tail(arr, k: int) -> Column:
    return F.slice(_c(arr), -k, k)


# -- C6 repeat interleave ----------------------------------------------------

def repeat_interleave(df: DataFrame, position_col: str, batch: int, k: int,
                      out_col: str = "out_position", tile: bool = False) -> DataFrame:
    """Each consecutive batch of ``batch`` rows repeated ``k`` times,
    batch-major: input position p = i*B + j goes to i*B*k + r*B + j for
    r < k. ``tile`` repeats the whole sequence instead (position r*N + p,
    N = rows). A partial last batch is repeated as it is (no row dropped)."""
    p = F.col(position_col)
    rep = F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("repeat")
    out = df.select("*", rep)
    if tile:
        n = df.count()
        return out.withColumn(out_col, (F.col("repeat") * F.lit(n) + p).cast("bigint"))
    i = F.floor(p / F.lit(batch))
    j = F.pmod(p, F.lit(batch))
    return out.withColumn(out_col, (i * F.lit(batch * k) + F.col("repeat") * F.lit(batch) + j).cast("bigint"))


def repeat_interleave_ordered(df: DataFrame, order_cols: list[str], batch: int, k: int,
                              out_col: str = "out_position") -> DataFrame:
    """Same, for a table given by an order rather than a position column."""
    pos = global_positions(df, order_cols, "_in_position")
    return repeat_interleave(pos, "_in_position", batch, k, out_col).withColumnRenamed(
        "_in_position", "in_position")


# -- C7 concat tokens ----------------------------------------------------------

def concat_tokens(tokens, prefix: list[list[float]] | None = None,
                  suffix: list[list[float]] | None = None,
                  pos_dim: int | None = None, pos_variant: str = "1d", grid_w: int = 1) -> Column:
    """Prefix (class) and suffix (mask) tokens around a token list; with
    ``pos_dim`` the fixed position vector of each slot is added, the prefix
    slots getting the zero vector."""
    tokens = _c(tokens)
    parts = []
    if prefix:
        parts.append(F.array(*[F.array(*[F.lit(float(v)) for v in t]) for t in prefix]))
    parts.append(tokens)
    if suffix:
        parts.append(F.array(*[F.array(*[F.lit(float(v)) for v in t]) for t in suffix]))
    seq = F.concat(*parts) if len(parts) > 1 else tokens
    if pos_dim is None:
        return seq
    n_extra = len(prefix or [])
    return F.transform(seq, lambda tok, q: vec_add(
        tok, position_features(q, pos_dim, grid_w, pos_variant, n_extra=n_extra)))


def concat_token_rows(a: DataFrame, b: DataFrame, offset: int, pos_col: str = "pos") -> DataFrame:
    """Long-form twin: rows of ``b`` appended after ``a`` with positions
    shifted by ``offset``."""
    return a.unionByName(b.withColumn(pos_col, F.col(pos_col) + F.lit(offset)))


# -- C8 grid resample ---------------------------------------------------------

def _cubic(x: float, a: float = K.BICUBIC_A) -> float:
    x = abs(x)
    if x <= 1.0:
        return ((a + 2.0) * x - (a + 3.0)) * x * x + 1.0
    if x < 2.0:
        return ((a * x - 5.0 * a) * x + 8.0 * a) * x - 4.0 * a
    return 0.0


def bicubic_weights(n_in: int, n_out: int) -> list[list[tuple[int, float]]]:
    """Per output index, the 4 (input index, weight) taps of bicubic
    resampling with half-pixel centres (align_corners off), edges clamped."""
    scale = n_in / n_out
    taps = []
    for o in range(n_out):
        src = (o + 0.5) * scale - 0.5
        i0 = math.floor(src)
        t = src - i0
        row = []
        for k in range(4):
            idx = min(max(i0 - 1 + k, 0), n_in - 1)
            row.append((idx, _cubic(t - (k - 1))))
        taps.append(row)
    return taps


def grid_resample(arr, channels: int, h: int, w: int, h2: int, w2: int, n_extra: int = 0) -> Column:
    """Resize every row's (extra tokens + C x H x W) grid to H2 x W2 with the
    bicubic kernel, keeping the extra (class) entries in front. No-op when
    the sizes agree. The separable weight table is a static literal."""
    arr = _c(arr)
    if (h, w) == (h2, w2):
        return arr
    wy, wx = bicubic_weights(h, h2), bicubic_weights(w, w2)
    taps = []
    for c in range(channels):
        for oy in range(h2):
            for ox in range(w2):
                taps.append([(n_extra + c * h * w + iy * w + ix, vy * vx)
                             for iy, vy in wy[oy] for ix, vx in wx[ox]])
    body = gather_weighted_sum(arr, taps)
    if n_extra:
        return F.concat(F.slice(arr, 1, n_extra), body)
    return body


def resample_weight_table(spark, n_in: int, n_out: int) -> DataFrame:
    """The 1-D weight table (out, in, w) as a DataFrame, for long-form use."""
    rows = [(o, i, wgt) for o, t in enumerate(bicubic_weights(n_in, n_out)) for i, wgt in t]
    return spark.createDataFrame(rows, "out int, in int, w double")

