"""ANSI/DuckDB SQL text for the same formulas as the column functions, used
to build the oracle queries that check each operator independently of Spark."""

from __future__ import annotations

import math

from shardforge.functions.counter import philox_sql, stream_key
from shardforge.functions.rng import (ACKLAM_A, ACKLAM_B, ACKLAM_C, ACKLAM_D,
                                      ACKLAM_P_LOW, TWO_POW_52, trunc_normal_bounds)


def d(x: float) -> str:
    """A double literal (a bare 0.96 is DECIMAL in DuckDB)."""
    return f"CAST({float(x)!r} AS DOUBLE)"


def u(seed, stream: str, key: str, i: str = "0") -> str:
    text = (f"concat_ws(':', '{seed}', '{stream}', CAST({key} AS VARCHAR), "
            f"CAST({i} AS VARCHAR))")
    return f"((('0x' || substr(md5({text}), 1, 13))::BIGINT + 0.5) / {TWO_POW_52!r})"


def randint(seed, stream: str, key: str, lo: int, hi: int, i: str = "0") -> str:
    return f"CAST(floor({d(lo)} + {u(seed, stream, key, i)} * {d(hi - lo)}) AS INTEGER)"


def normal(seed, stream: str, key: str, j: str) -> str:
    m = f"((({j})) // 2)"
    text = (f"concat_ws(':', '{seed}', '{stream}', CAST({key} AS VARCHAR), CAST({m} AS VARCHAR))")
    h = f"md5({text})"
    u1 = f"((('0x' || substr({h}, 1, 13))::BIGINT + 0.5) / {TWO_POW_52!r})"
    u2 = f"((('0x' || substr({h}, 17, 13))::BIGINT + 0.5) / {TWO_POW_52!r})"
    th = f"({d(2 * math.pi)} * {u2})"
    return f"(sqrt(-2.0 * ln({u1})) * CASE WHEN (({j})) % 2 = 0 THEN cos({th}) ELSE sin({th}) END)"


def _horner(coeffs, x: str, tail_one: bool = False) -> str:
    acc = d(coeffs[0])
    for c in coeffs[1:]:
        acc = f"({acc} * {x} + {d(c)})"
    if tail_one:
        acc = f"({acc} * {x} + 1.0)"
    return acc


def inv_norm_cdf(p: str) -> str:
    qlo = f"sqrt(-2.0 * ln({p}))"
    qhi = f"sqrt(-2.0 * ln(1.0 - {p}))"
    q = f"({p} - 0.5)"
    r = f"({q} * {q})"
    lower = f"({_horner(ACKLAM_C, qlo)} / {_horner(ACKLAM_D, qlo, True)})"
    upper = f"(-{_horner(ACKLAM_C, qhi)} / {_horner(ACKLAM_D, qhi, True)})"
    centre = f"({_horner(ACKLAM_A, r)} * {q} / {_horner(ACKLAM_B, r, True)})"
    return (f"(CASE WHEN {p} < {d(ACKLAM_P_LOW)} THEN {lower} "
            f"WHEN {p} > {d(1 - ACKLAM_P_LOW)} THEN {upper} ELSE {centre} END)")


def counter_normal_pairs(seed, stream: str, key: str, block: str, source: str) -> str:
    """SELECT of ``source``'s columns with z0 and z1, elements 2 * block and
    2 * block + 1 of the counter-based sequence of row key ``key``."""
    def uniform(a: str, b: str) -> str:
        return f"((({a} >> 5) * {d(1 << 26)} + ({b} >> 6) + 0.5) / {d(1 << 53)})"
    words = philox_sql(block, key, stream_key(seed, stream), source)
    u1, u2 = uniform("w0", "w1"), uniform("w2", "w3")
    th = f"({d(2 * math.pi)} * {u2})"
    return (f"SELECT * EXCLUDE (w0, w1, w2, w3), sqrt(-2.0 * ln({u1})) * cos({th}) AS z0, sqrt(-2.0 * ln({u1})) * sin({th}) AS z1 FROM ({words})")


def trunc_normal(seed, stream: str, key: str, mean=0.0, std=1.0, a=-2.0, b=2.0) -> str:
    lo, hi, _ = trunc_normal_bounds(mean, std, a, b)
    p = f"({d(lo)} + {u(seed, stream, key)} * {d(hi - lo)})"
    v = f"({d(mean)} + {d(std)} * {inv_norm_cdf(p)})"
    return f"least(greatest({v}, {d(a)}), {d(b)})"
