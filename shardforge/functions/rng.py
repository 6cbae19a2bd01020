"""Seeded random columns (A2, A3, A4).

Every draw is a pure function of ``(seed, stream, key, i)``, so a row gets
the same value whatever the partitioning, the task that computes it or a
retry after a lost executor. The contract:

* ``h`` = the first 13 hex digits (52 bits) of ``md5("seed:stream:key:i")``;
* ``u`` = (h + 0.5) / 2^52, strictly inside (0, 1) and exact in a double;
* normals come in Box-Muller pairs: pair m uses one md5 of
  ``seed:stream:key:m``, u1 from hex digits 1-13 and u2 from digits 17-29;
  element 2m = sqrt(-2 ln u1) cos(2 pi u2), element 2m+1 the same with sin.

Everything stays a built-in expression (md5, conv, log, cos) inside whole
stage codegen; no Python runs per row.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_POW_52 = 4503599627370496.0


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def hash_bits(seed, stream: str, key, i=0) -> Column:
    """52-bit non-negative integer from md5 of ``seed:stream:key:i``."""
    text = F.concat_ws(":", _c(seed).cast("string"), F.lit(stream),
                       _c(key).cast("string"), _c(i).cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")


def seeded_uniform(seed, stream: str, key, i=0, lo: float = 0.0, hi: float = 1.0) -> Column:
    """Uniform double in (lo, hi)."""
    u = (hash_bits(seed, stream, key, i).cast("double") + F.lit(0.5)) / F.lit(TWO_POW_52)
    if lo == 0.0 and hi == 1.0:
        return u
    return F.lit(float(lo)) + u * F.lit(float(hi - lo))


def seeded_randint(seed, stream: str, key, lo: int, hi: int, i=0) -> Column:
    """Integer in [lo, hi) (exclusive upper bound, like the reference's label
    draw, which uses 999 and so never yields class 999)."""
    u = seeded_uniform(seed, stream, key, i)
    return F.floor(F.lit(float(lo)) + u * F.lit(float(hi - lo))).cast("int")


def _uniform_pair(seed, stream: str, key, m) -> Column:
    """Two uniforms from one md5: hex digits 1-13 and 17-29 of the digest of
    ``seed:stream:key:m``, each (h + 0.5) / 2^52."""
    text = F.concat_ws(":", _c(seed).cast("string"), F.lit(stream),
                       _c(key).cast("string"), _c(m).cast("string"))

    def halves(h):
        a = F.conv(F.substring(h, 1, 13), 16, 10).cast("bigint").cast("double")
        b = F.conv(F.substring(h, 17, 13), 16, 10).cast("bigint").cast("double")
        return F.array((a + F.lit(0.5)) / F.lit(TWO_POW_52), (b + F.lit(0.5)) / F.lit(TWO_POW_52))
    return F.element_at(F.transform(F.array(F.md5(text)), halves), 1)


def normal_pair(seed, stream: str, key, m) -> Column:
    """Box-Muller pair m: [r cos(2 pi u2), r sin(2 pi u2)], r = sqrt(-2 ln u1),
    elements 2m and 2m+1 of the (seed, stream, key) normal sequence."""
    def bm(uu):
        r = F.sqrt(F.lit(-2.0) * F.log(uu[0]))
        th = F.lit(2.0 * math.pi) * uu[1]
        return F.array(r * F.cos(th), r * F.sin(th))
    return F.element_at(F.transform(F.array(_uniform_pair(seed, stream, key, m)), bm), 1)


def normal_at(seed, stream: str, key, j) -> Column:
    """Standard normal element ``j`` of the (seed, stream, key) sequence."""
    j = _c(j)
    return normal_pair(seed, stream, key, F.floor(j / 2).cast("bigint"))[F.pmod(j, F.lit(2)).cast("int")]


def normal_block(seed, stream: str, key, start, dim: int) -> Column:
    """Elements start .. start+dim-1 of the normal sequence as an array, one
    md5 per pair of elements."""
    start = _c(start).cast("bigint")
    first = F.floor(start / 2)
    last = F.floor((start + F.lit(dim - 1)) / 2)
    pairs = F.transform(F.sequence(first, last), lambda m: normal_pair(seed, stream, key, m))
    return F.slice(F.flatten(pairs), (F.pmod(start, F.lit(2)) + F.lit(1)).cast("int"), dim)


def seeded_normal(seed, stream: str, key, dim: int) -> Column:
    """ARRAY<DOUBLE> of ``dim`` standard normals per row."""
    return normal_block(seed, stream, key, F.lit(0), dim)


# Coefficients of Acklam's rational approximation of the
# inverse standard normal CDF (relative error below 1.15e-9).
ACKLAM_A = (-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
            1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00)
ACKLAM_B = (-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
            6.680131188771972e+01, -1.328068155288572e+01)
ACKLAM_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
            -2.549671010114591e+00, 4.374664141464968e+00, 2.938163982698783e+00)
ACKLAM_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00,
            3.754408661907416e+00)
ACKLAM_P_LOW = 0.02425


def _horner(coeffs, x: Column, tail_one: bool = False) -> Column:
    acc = F.lit(coeffs[0])
    for c in coeffs[1:]:
        acc = acc * x + F.lit(c)
    if tail_one:
        acc = acc * x + F.lit(1.0)
    return acc


def inv_norm_cdf(p: Column) -> Column:
    """Inverse standard normal CDF as a column expression (Spark has no
    erfinv). Three regions: lower tail, centre, upper tail."""
    q_lo = F.sqrt(F.lit(-2.0) * F.log(p))
    lower = _horner(ACKLAM_C, q_lo) / _horner(ACKLAM_D, q_lo, tail_one=True)
    q_hi = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - p))
    upper = -_horner(ACKLAM_C, q_hi) / _horner(ACKLAM_D, q_hi, tail_one=True)
    q = p - F.lit(0.5)
    r = q * q
    centre = _horner(ACKLAM_A, r) * q / _horner(ACKLAM_B, r, tail_one=True)
    return (F.when(p < F.lit(ACKLAM_P_LOW), lower)
            .when(p > F.lit(1.0 - ACKLAM_P_LOW), upper)
            .otherwise(centre))


def norm_cdf(x: float) -> float:
    return (1.0 + math.erf(x / math.sqrt(2.0))) / 2.0


def trunc_normal_bounds(mean: float, std: float, a: float, b: float) -> tuple[float, float, bool]:
    """CDF bounds (l, u) of the truncation interval, and whether the mean is
    more than 2 std outside [a, b] (the case the reference warns about)."""
    warn = mean < a - 2 * std or mean > b + 2 * std
    return norm_cdf((a - mean) / std), norm_cdf((b - mean) / std), warn


def seeded_trunc_normal(seed, stream: str, key, mean: float = 0.0, std: float = 1.0,
                        a: float = -2.0, b: float = 2.0, i=0) -> Column:
    """Truncated normal by inverse CDF: p uniform in [Phi(a'), Phi(b')],
    value = mean + std * Phi^-1(p), clamped to [a, b]."""
    lo, hi, warn = trunc_normal_bounds(mean, std, a, b)
    if warn:
        import warnings
        warnings.warn(f"seeded_trunc_normal: [{a}, {b}] lies far in a tail of the normal ({mean}, {std}); "
                      "inverse-CDF draws lose precision there", stacklevel=2)
    p = F.lit(lo) + seeded_uniform(seed, stream, key, i) * F.lit(hi - lo)
    v = F.lit(float(mean)) + F.lit(float(std)) * inv_norm_cdf(p)
    return F.least(F.greatest(v, F.lit(float(a))), F.lit(float(b)))


# -- driver-side twins (for small parameter tables built on the driver) ----

def py_uniform(seed, stream: str, key, i=0) -> float:
    h = int(hashlib.md5(f"{seed}:{stream}:{key}:{i}".encode()).hexdigest()[:13], 16)
    return (h + 0.5) / TWO_POW_52


def py_normal(seed, stream: str, key, j: int) -> float:
    h = hashlib.md5(f"{seed}:{stream}:{key}:{j // 2}".encode()).hexdigest()
    u1 = (int(h[:13], 16) + 0.5) / TWO_POW_52
    u2 = (int(h[16:29], 16) + 0.5) / TWO_POW_52
    r = math.sqrt(-2.0 * math.log(u1))
    return r * (math.cos(2.0 * math.pi * u2) if j % 2 == 0 else math.sin(2.0 * math.pi * u2))
