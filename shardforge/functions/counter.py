"""Counter-based normals (A3 for large latents): the Philox 4x32-10 block
function of Salmon et al. (2011) over whole arrays of counters.

Element j of a row's sequence is a function of (seed, stream, key, j) alone:

* the 64-bit generator key is the first 8 bytes (little endian) of
  SHA-256("seed:stream");
* block m = j div 2 of row key k has the counter words (m low, m high, k low,
  k high) and gives four 32-bit words w0..w3;
* u1 = ((w0 >> 5) * 2^26 + (w1 >> 6) + 0.5) / 2^53, u2 likewise from w2, w3;
* Box-Muller: element 2m is sqrt(-2 ln u1) cos(2 pi u2), 2m+1 the same with sin.

So any slice of any row is addressable, all rows of a batch are drawn at once,
and the result doesn't depend on partitions, batches or retries."""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame

# fixed values of Philox 4x32: multipliers, key increments, rounds
PHILOX_M = (0xD2511F53, 0xCD9E8D57)
PHILOX_W = (0x9E3779B9, 0xBB67AE85)
PHILOX_ROUNDS = 10
_LOW = np.uint64(0xFFFFFFFF)
_CHUNK = 1 << 19     # counters worked on at a time


def stream_key(seed, stream: str) -> tuple[int, int]:
    """The two key words of a stream."""
    k = int.from_bytes(hashlib.sha256(f"{seed}:{stream}".encode()).digest()[:8], "little")
    return k & 0xFFFFFFFF, k >> 32


def philox(c0, c1, c2, c3, key: tuple[int, int]) -> tuple[np.ndarray, ...]:
    """The block function on arrays of counter words (held in uint64)."""
    k0, k1 = key
    s = np.uint64(32)
    m0, m1 = (np.uint64(m) for m in PHILOX_M)
    for _ in range(PHILOX_ROUNDS):
        p0, p1 = m0 * c0, m1 * c2
        c0, c1, c2, c3 = (p1 >> s) ^ c1 ^ np.uint64(k0), p1 & _LOW, (p0 >> s) ^ c3 ^ np.uint64(k1), p0 & _LOW
        k0, k1 = (k0 + PHILOX_W[0]) & 0xFFFFFFFF, (k1 + PHILOX_W[1]) & 0xFFFFFFFF
    return c0, c1, c2, c3


def _uniform(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a >> np.uint64(5)) * np.float64(1 << 26) + (b >> np.uint64(6)) + 0.5) / np.float64(1 << 53)


def normals(seed, stream: str, keys: np.ndarray, start: int, dim: int) -> np.ndarray:
    """Elements start .. start+dim-1 of each key's sequence, (rows, dim)."""
    keys = np.asarray(keys, np.int64).view(np.uint64)
    first, last = start // 2, (start + dim - 1) // 2
    blocks = np.arange(first, last + 1, dtype=np.uint64)
    out = np.empty((len(keys), 2 * len(blocks)))
    step = max(1, _CHUNK // max(1, len(blocks)))
    key = stream_key(seed, stream)
    s = np.uint64(32)
    for lo in range(0, len(keys), step):
        k = np.repeat(keys[lo:lo + step], len(blocks))
        m = np.tile(blocks, len(keys[lo:lo + step]))
        w = philox(m & _LOW, m >> s, k & _LOW, k >> s, key)
        radius, angle = np.sqrt(-2.0 * np.log(_uniform(w[0], w[1]))), 2.0 * math.pi * _uniform(w[2], w[3])
        part = out[lo:lo + step].reshape(-1, 2)
        part[:, 0], part[:, 1] = radius * np.cos(angle), radius * np.sin(angle)
    skip = start - 2 * first
    return out[:, skip:skip + dim]


def counter_normals(df: DataFrame, seed, stream: str, key_col: str, dim: int, out_col: str = "latent", start: int = 0,
                    precision: str = "double") -> DataFrame:
    """``df`` with ``out_col``: the ``dim`` normals of each row's integer key,
    from element ``start`` on, as ARRAY<DOUBLE> or, with
    ``precision="float"``, ARRAY<FLOAT>. A null key gives null."""
    import pyarrow as pa
    from pyspark.sql.types import ArrayType, DoubleType, FloatType, StructField, StructType

    from shardforge.session import ship_package
    ship_package(df.sparkSession)
    if precision not in ("double", "float"):
        raise ValueError("precision must be 'double' or 'float'")
    kind, arrow = (FloatType(), pa.float32()) if precision == "float" else (DoubleType(), pa.float64())
    rows = max(1, (1 << 22) // max(1, dim))

    def draw(batches):
        from shardforge.functions.arrowbatch import from_matrix
        for whole in batches:
            for lo in range(0, whole.num_rows, rows):
                b = whole.slice(lo, rows)
                col = b.column(key_col)
                mat = normals(seed, stream, col.fill_null(0).cast(pa.int64()).to_numpy(), start, dim)
                values = from_matrix(mat if precision == "double" else mat.astype(np.float32), arrow)
                if col.null_count:
                    values = pa.compute.if_else(col.is_valid(), values, pa.scalar(None, values.type))
                yield pa.RecordBatch.from_arrays([*b.columns, values], names=[*b.schema.names, out_col])

    schema = StructType([*df.schema.fields, StructField(out_col, ArrayType(kind))])
    return df.mapInArrow(draw, schema)


def philox_sql(m: str, key: str, words: tuple[int, int], source: str) -> str:
    """SELECT of ``source``'s columns and w0..w3 for block ``m`` and row key
    ``key``: the same function as SQL text, for the oracles."""
    sql = (f"SELECT *, CAST({m} AS UBIGINT) & 4294967295 AS w0, CAST({m} AS UBIGINT) >> 32 AS w1, "
           f"CAST({key} AS UBIGINT) & 4294967295 AS w2, CAST({key} AS UBIGINT) >> 32 AS w3 FROM {source}")
    k0, k1 = words
    for _ in range(PHILOX_ROUNDS):
        p0, p1 = f"({PHILOX_M[0]}::UBIGINT * w0)", f"({PHILOX_M[1]}::UBIGINT * w2)"
        sql = (f"SELECT * REPLACE (xor(xor({p1} >> 32, w1), {k0}::UBIGINT) AS w0, {p1} & 4294967295 AS w1, "
               f"xor(xor({p0} >> 32, w3), {k1}::UBIGINT) AS w2, {p0} & 4294967295 AS w3) FROM ({sql})")
        k0, k1 = (k0 + PHILOX_W[0]) & 0xFFFFFFFF, (k1 + PHILOX_W[1]) & 0xFFFFFFFF
    return sql
