"""Registered queries: layout functions on 4 x 32 x 32 arrays, tiled from the
embeddings (C1, C2, C4, C8). Each gives weighted sums per row of the result."""

from __future__ import annotations

from pyspark.sql import functions as F

from shardforge import sqltwins as S
from shardforge.catalog import register
from shardforge.catalog_arrays import _cubic_sql
from shardforge.session import table

_N = 4096
# element i of the tiled array: the embedding 64 times, raised by 1/64 a round
_AT = "(CAST(embedding[({i}) % 64 + 1] AS DOUBLE) + (({i}) // 64) / 64.0)"


def _tiled(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    x = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.transform("e", lambda v: v + k / F.lit(64.0))))
    return e.select("vec_id", x.alias("x"))


def _row_sums(df, width: int):
    """Sum of value * (position in the row + 1) per row of ``width`` values."""
    long = df.select("vec_id", F.posexplode_outer("y").alias("j", "v"))
    return (long.groupBy("vec_id", F.floor(F.col("j") / width).cast("int").alias("row"))
            .agg(F.round(F.sum(F.col("v") * (F.col("j") % width + 1)), 3).alias("weighted")))


def _sum_sql(src: str, width: int) -> str:
    return f"""SELECT vec_id, CAST(j // {width} AS INTEGER) AS row,
       round(sum({_AT.format(i=src)} * (j % {width} + 1)), 3) AS weighted
FROM embeddings, range({_N}) r(j) GROUP BY 1, 2"""


@register("permute_axes_large", _sum_sql("(j % 4) * 1024 + j // 4", 128))
def q_permute_axes_large(spark, sf):
    from shardforge.functions.ndarrays import permute_by_kind_np
    return _row_sums(permute_by_kind_np(_tiled(spark, sf), "x", "y", "nchw_to_nhwc", (4, 32, 32)), 128)


@register("patchify_large", _sum_sql(
    "(j % 4) * 1024 + ((j // 16) // 16 * 2 + (j % 16) // 8) * 32 + (j // 16) % 16 * 2 + (j // 4) % 2", 16))
def q_patchify_large(spark, sf):
    from shardforge.functions.ndarrays import patchify_np
    return _row_sums(patchify_np(_tiled(spark, sf), "x", "y", (4, 32, 32), 2), 16)


@register("grid_resample_large", f"""
WITH wts AS (SELECT o, least(greatest(CAST(floor((o + 0.5) * 2.0 - 0.5) AS INTEGER) - 1 + k, 0), 31) AS idx,
       {_cubic_sql('abs(((o + 0.5) * 2.0 - 0.5 - floor((o + 0.5) * 2.0 - 0.5)) - (k - 1))')} AS w
FROM range(16) a(o), range(4) b(k)),
inner_rows AS (SELECT vec_id, c, wx.o AS ox, y, sum(wx.w * {_AT.format(i='c * 1024 + y * 32 + wx.idx')}) AS v
FROM embeddings, range(4) d(c), range(32) f(y), wts wx GROUP BY ALL),
outer_rows AS (SELECT vec_id, c, wy.o AS oy, ox, sum(wy.w * v) AS v FROM inner_rows JOIN wts wy ON wy.idx = y GROUP BY ALL)
SELECT vec_id, CAST(c * 16 + oy AS INTEGER) AS row, round(sum(v * (ox + 1)), 3) AS weighted
FROM outer_rows GROUP BY ALL""")
def q_grid_resample_large(spark, sf):
    from shardforge.functions.ndarrays import grid_resample_np
    return _row_sums(grid_resample_np(_tiled(spark, sf), "x", "y", 4, 32, 32, 16, 16), 16)


@register("quantise_large", f"""
SELECT vec_id, CAST(j // 64 AS INTEGER) AS row,
       CAST(sum(CAST(trunc(least(greatest((1.0 - {_AT.format(i='j')} / {S.d(0.18215)}) / 2.0 * 255.0, 0.0), 255.0)) AS INTEGER)
                * (j % 64 + 1)) AS BIGINT) AS weighted
FROM embeddings, range({_N}) r(j) GROUP BY 1, 2""")
def q_quantise_large(spark, sf):
    """With a NumPy decoder (here the sign change) between scale and clip."""
    import numpy as np

    from shardforge.functions.arrays import binary_to_pixels
    from shardforge.functions.ndarrays import quantise_np
    q = quantise_np(_tiled(spark, sf), "x", "b", _N, decode=np.negative)
    long = q.select("vec_id", F.posexplode_outer(binary_to_pixels("b")).alias("j", "v"))
    return (long.groupBy("vec_id", F.floor(F.col("j") / 64).cast("int").alias("row"))
            .agg(F.sum(F.col("v") * (F.col("j") % 64 + 1)).cast("bigint").alias("weighted")))
