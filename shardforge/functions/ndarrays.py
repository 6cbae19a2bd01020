"""Layout and quantise functions for large arrays (C1, C2, C4, C8): one Arrow
pass each that adds a column, working on a (rows, elements) NumPy matrix per batch. The expression
forms in ``arrays`` and ``operators.grids`` carry one literal per element,
which suits some hundred values; these carry the shape only. Null rows give
null; the other rows of a batch must have the stated length."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, DataType, DoubleType, StructField, StructType

from shardforge import constants as K
from shardforge.functions.arrays import RULE_ORDERS, permutation_index
from shardforge.functions.arrowbatch import from_matrix, to_matrix


DOUBLES = ArrayType(DoubleType())


def _add(df: DataFrame, arr: str, out: str, n_in: int, fn, to_arrow, out_type: DataType) -> DataFrame:
    """``df`` and the column ``out``: ``fn`` (matrix -> matrix) over the
    non-null rows of the array column ``arr``."""
    from shardforge.session import ship_package
    ship_package(df.sparkSession)

    def apply(col):
        given = col.drop_null()
        if len(given) == 0:
            return pa.nulls(len(col), to_arrow(fn(np.zeros((1, n_in)))).type)
        mat = to_matrix(given)
        if mat.shape[1] != n_in:
            raise ValueError(f"array of {mat.shape[1]} values where {n_in} were stated")
        res = to_arrow(fn(mat))
        valid = col.is_valid().to_numpy(zero_copy_only=False)
        return res if valid.all() else res.take(pa.array(np.cumsum(valid) - 1, mask=~valid))

    def run(batches):
        for b in batches:
            yield b.append_column(out, apply(b.column(arr)))

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(out, out_type)]))


def permute_axes_np(df: DataFrame, arr: str, out: str, shape, order) -> DataFrame:
    """``permute_axes`` for large arrays."""
    shape, order = tuple(shape), tuple(order)
    permutation_index((1,) * len(shape), order)  # the order is a permutation
    n = int(np.prod(shape))
    return _add(df, arr, out, n, lambda m: m.reshape(-1, *shape).transpose(0, *[o + 1 for o in order]).reshape(-1, n),
                   from_matrix, DOUBLES)


def permute_by_kind_np(df: DataFrame, arr: str, out: str, kind: str, shape) -> DataFrame:
    """One of the named layout rules (``RULE_ORDERS``)."""
    order = RULE_ORDERS[kind]
    return permute_axes_np(df, arr, out, shape, order if order is not None else range(len(shape)))


def patchify_np(df: DataFrame, arr: str, out: str, shape, p: int) -> DataFrame:
    """(C, H, W) values -> the tokens one after another, each p * p * C
    values with the channel last, as one flat array."""
    c, h, w = shape
    if h % p or w % p:
        raise ValueError(f"grid {h} x {w} does not split into tiles of {p}")
    return _add(df, arr, out, c * h * w, lambda m: m.reshape(-1, c, h // p, p, w // p, p).transpose(0, 2, 4, 3, 5, 1)
                   .reshape(-1, c * h * w), from_matrix, DOUBLES)


def grid_resample_np(df: DataFrame, arr: str, out: str, channels: int, h: int, w: int, h2: int, w2: int,
                     n_extra: int = 0) -> DataFrame:
    """``grid_resample`` for large grids: one small weight matrix per axis."""
    from shardforge.operators.grids import bicubic_weights

    def weights(n_in, n_out):
        m = np.zeros((n_out, n_in))
        for o, taps in enumerate(bicubic_weights(n_in, n_out)):
            for i, v in taps:
                m[o, i] += v
        return m

    wy, wx = weights(h, h2), weights(w, w2)

    def run(m):
        grid = m[:, n_extra:].reshape(-1, channels, h, w)
        return np.concatenate([m[:, :n_extra], (wy @ grid @ wx.T).reshape(len(m), -1)], axis=1)

    return _add(df, arr, out, n_extra + channels * h * w, run, from_matrix, DOUBLES)


def quantise_np(df: DataFrame, arr: str, out: str, n: int, scale: float = K.LATENT_SCALE, decode=None) -> DataFrame:
    """``quantise`` to BINARY, one unsigned byte a value, with a NumPy decoder
    ((rows, n) latents -> (rows, values) images) between scale and clip."""
    def run(m):
        img = m / scale
        img = decode(img) if decode is not None else img
        return np.clip((img + 1.0) / 2.0 * 255.0, 0.0, 255.0).astype(np.uint8)

    return _add(df, arr, out, n, run, lambda m: pa.array([r.tobytes() for r in m], pa.binary()), BinaryType())
