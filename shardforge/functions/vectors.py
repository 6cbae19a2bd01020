"""Array-column vector functions (D1, D5 and helpers), built from Spark
higher-order functions so they run JVM-side with no Python per row."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from shardforge import constants as K


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def let(value: Column, fn) -> Column:
    """Evaluate ``value`` once per row and pass it to ``fn`` (a one-element
    ``transform``). Lambdas that refer to an outer expression re-evaluate
    it for every element; binding it first keeps per-element work O(1)."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def vec_add(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x + y)


def vec_sub(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x - y)


def vec_scale(a, s) -> Column:
    s = s if isinstance(s, Column) else F.lit(float(s))
    return F.transform(_c(a), lambda x: x * s)


def vec_sum(a) -> Column:
    return F.aggregate(_c(a), F.lit(0.0), lambda acc, x: acc + x)


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0),
                       lambda acc, x: acc + x)


def l2norm(a) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalize(a, eps: float = 0.0) -> Column:
    def body(arr):
        n = l2norm(arr)
        if eps:
            n = F.greatest(n, F.lit(eps))
        return let(n, lambda nv: F.transform(arr, lambda x: x / nv))
    return let(_c(a), body)


def vec_mean(a) -> Column:
    a = _c(a)
    return vec_sum(a) / F.size(a)


def layer_norm(a, eps: float = K.LAYER_NORM_EPS) -> Column:
    """(x - mean) / sqrt(var + eps), no affine part; var is the biased
    variance computed around the mean."""
    def body(arr):
        return let(vec_mean(arr), lambda mean: let(
            F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + (x - mean) * (x - mean)) / F.size(arr),
            lambda var: F.transform(arr, lambda x: (x - mean) / F.sqrt(var + F.lit(eps)))))
    return let(_c(a), body)


def softmax(a) -> Column:
    def body(arr):
        return let(F.array_max(arr), lambda m: let(
            F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + F.exp(x - m)),
            lambda s: F.transform(arr, lambda x: F.exp(x - m) / s)))
    return let(_c(a), body)


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def act(name: str, x: Column) -> Column:
    """Scalar activation by name."""
    if name == "relu":
        return F.greatest(x, F.lit(0.0))
    if name in ("silu", "swish"):
        return x * sigmoid(x)
    if name in ("gelu_tanh", "gelu"):
        k = math.sqrt(2.0 / math.pi)
        return F.lit(0.5) * x * (F.lit(1.0) + F.tanh(F.lit(k) * (x + F.lit(K.GELU_TANH_C) * x * x * x)))
    if name == "quick_gelu":
        return x * sigmoid(F.lit(K.QUICK_GELU_C) * x)
    if name == "tanh":
        return F.tanh(x)
    if name in ("identity", "none", None):
        return x
    raise ValueError(f"unknown activation {name!r}")


def vec_act(name: str, a) -> Column:
    return F.transform(_c(a), lambda x: act(name, x))


def sinusoid_features(t, dim: int, max_period: float = K.MAX_PERIOD) -> Column:
    """Timestep features: cos(t*f_k) for k < half, then sin(t*f_k), then a
    zero when dim is odd; f_k = exp(-ln(max_period) * k / half)."""
    t = _c(t).cast("double")
    half = dim // 2
    c = -math.log(max_period) / half

    def freq(k):
        return F.exp(F.lit(c) * k.cast("double"))

    ks = F.sequence(F.lit(0), F.lit(half - 1))
    parts = [F.transform(ks, lambda k: F.cos(t * freq(k))),
             F.transform(ks, lambda k: F.sin(t * freq(k)))]
    if dim % 2:
        parts.append(F.array(F.lit(0.0)))
    return F.concat(*parts)


def sincos_1d(pos: Column, dim: int, temperature: float = K.SINCOS_TEMPERATURE) -> list[Column]:
    """[sin(pos*w_k), cos(pos*w_k)] parts with w_k = temperature^(-k/(dim/2)),
    k < dim/2 (MAE convention); returns the two arrays."""
    half = dim // 2
    ks = F.sequence(F.lit(0), F.lit(half - 1))
    lt = math.log(temperature)

    def w(k):
        return F.exp(F.lit(-lt / half) * k.cast("double"))

    p = pos.cast("double")
    return [F.transform(ks, lambda k: F.sin(p * w(k))), F.transform(ks, lambda k: F.cos(p * w(k)))]


def position_features(pos: Column, dim: int, grid_w: int, variant: str = "half",
                      n_extra: int = 0, temperature: float = K.SINCOS_TEMPERATURE) -> Column:
    """Fixed 2-D sin-cos position vector for token ``pos`` of a grid of width
    ``grid_w``. ``n_extra`` leading tokens (class tokens) get a zero vector.

    variant "half": [sin(x w), cos(x w), sin(y w), cos(y w)] with x the
    column, y the row (xy meshgrid). variant "quarter": the same layout with
    the row first, then the column (ij meshgrid). "1d": [sin(p w), cos(p w)]
    over dim/2 frequencies."""
    p = pos - F.lit(n_extra)
    if variant == "1d":
        if dim % 2:
            raise ValueError("dim must be even for 1-D sin-cos features")
        vec = F.concat(*sincos_1d(p, dim, temperature))
    else:
        if dim % 4:
            raise ValueError("dim must be divisible by 4 for 2-D sin-cos features")
        row = F.floor(p / F.lit(grid_w))
        col = F.pmod(p, F.lit(grid_w))
        first, second = (col, row) if variant == "half" else (row, col)
        if variant not in ("half", "quarter"):
            raise ValueError(f"unknown variant {variant!r}")
        vec = F.concat(*sincos_1d(first, dim // 2, temperature), *sincos_1d(second, dim // 2, temperature))
    if n_extra:
        zeros = F.array_repeat(F.lit(0.0), dim)
        return F.when(pos < F.lit(n_extra), zeros).otherwise(vec)
    return vec
