"""Array-column layout helpers (C1, C2 and the index tables behind C3, C4,
C8). Shapes are static, so every layout change is a precomputed index
literal applied with ``transform``: a narrow, shuffle-free projection."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from shardforge.functions.vectors import let
from shardforge import constants as K


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def quantise(x, scale: float = K.LATENT_SCALE, decode=None) -> Column:
    """Latent -> uint8 pixel values as ARRAY<INT>: x / scale, then the
    (pluggable, default identity) decoder, then (img + 1) / 2 * 255 clipped
    to [0, 255] and truncated toward zero (not rounded)."""
    x = _c(x).cast("array<double>")
    latent = F.transform(x, lambda e: e / F.lit(scale))
    img = decode(latent) if decode is not None else latent
    return F.transform(img, lambda e: F.least(F.greatest((e + F.lit(1.0)) / F.lit(2.0) * F.lit(255.0),
                                                          F.lit(0.0)), F.lit(255.0)).cast("int"))


def pixels_to_binary(pixels) -> Column:
    """ARRAY<INT> of 0..255 -> BINARY (one unsigned byte per value)."""
    return F.unhex(F.concat_ws("", F.transform(_c(pixels), lambda p: F.lpad(F.hex(p), 2, "0"))))


def binary_to_pixels(b) -> Column:
    """BINARY -> ARRAY<INT> of unsigned byte values."""
    # one pass over the hex text; cutting it by position would rescan it for
    # every byte
    return F.transform(F.regexp_extract_all(F.hex(_c(b)), F.lit("(..)"), F.lit(1)),
                       lambda h: F.conv(h, 16, 10).cast("int"))


def permutation_index(shape, order) -> list[int]:
    """Source flat index for each flat position of the permuted array
    (row-major on both sides)."""
    shape = tuple(int(s) for s in shape)
    order = tuple(int(o) for o in order)
    if sorted(order) != list(range(len(shape))):
        raise ValueError(f"order {order} is not a permutation of {len(shape)} axes")
    return np.arange(math.prod(shape)).reshape(shape).transpose(order).ravel().tolist()


def gather(arr, index: list[int]) -> Column:
    """arr[index[0]], arr[index[1]], ... as a new array (0-based)."""
    lit = F.array(*[F.lit(int(i)) for i in index])
    return let(_c(arr), lambda a: F.transform(lit, lambda i: a[i]))


def permute_axes(arr, shape, order) -> Column:
    """Transpose a flattened array of the given shape (e.g. NCHW -> NHWC is
    order (1, 2, 0) on one sample's (C, H, W))."""
    if math.prod(shape) == 0:
        raise ValueError("empty shape")
    return gather(arr, permutation_index(shape, order))


# The axis orders of the layout rules named in the checkpoint
# conversion and sampling code (copy, 2-D transpose, NCHW<->NHWC, OIHW->HWIO).
RULE_ORDERS = {
    "copy": None,
    "transpose": (1, 0),
    "nchw_to_nhwc": (1, 2, 0),
    "nhwc_to_nchw": (2, 0, 1),
    "oihw_to_hwio": (2, 3, 1, 0),
}


def permute_by_rule(arr, rule: Column, rules: dict[str, tuple]) -> Column:
    """Layout change chosen per row by a rule column. ``rules`` maps a rule
    value to (rule kind, shape); kinds are those of RULE_ORDERS."""
    arr = _c(arr)
    out = None
    for value, (kind, shape) in rules.items():
        order = RULE_ORDERS[kind]
        expr = arr if order is None else permute_axes(arr, shape, order)
        out = F.when(rule == F.lit(value), expr) if out is None else out.when(rule == F.lit(value), expr)
    return out.otherwise(F.lit(None))


def gather_reduce_mean(arr, groups: list[list[int]]) -> Column:
    """For each index group, the mean of arr over the group's indices."""
    lit = F.array(*[F.array(*[F.lit(int(i)) for i in g]) for g in groups])
    return let(_c(arr), lambda a: F.transform(
        lit, lambda g: F.aggregate(g, F.lit(0.0), lambda acc, i: acc + a[i]) / F.size(g)))


def gather_weighted_sum(arr, taps: list[list[tuple[int, float]]]) -> Column:
    """For each output, sum of weight * arr[index] over its taps."""
    idx = F.array(*[F.array(*[F.lit(int(i)) for i, _ in t]) for t in taps])
    wts = F.array(*[F.array(*[F.lit(float(w)) for _, w in t]) for t in taps])
    # iterate the literal tables (zip_with) rather than index them per output
    return let(_c(arr), lambda a: F.zip_with(idx, wts, lambda ii, ww: F.aggregate(
        F.zip_with(ii, ww, lambda i, w: w * a[i]), F.lit(0.0), lambda acc, v: acc + v)))
