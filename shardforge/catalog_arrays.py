"""Registered queries: planning merge/metrics (A6, A7) and array / grid
layout (C1-C8)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from shardforge import sqltwins as S
from shardforge.catalog import SEED, r6, register
from shardforge.functions.rng import py_normal
from shardforge.session import table


def _emb(spark, sf):
    return table(spark, sf, "embeddings")


def _x():
    return F.col("embedding").cast("array<double>")


@register("worker_merge", """
SELECT event_id, CAST(user_id % 4 AS INTEGER) AS worker,
       CAST(row_number() OVER (ORDER BY user_id % 4, event_id) - 1 AS BIGINT) AS "index", event_type
FROM events""")
def q_worker_merge(spark, sf):
    from shardforge.operators.positions import worker_merge
    ev = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    parts = [ev.filter(F.col("user_id") % 4 == w).select("event_id", "event_type") for w in range(4)]
    return worker_merge(parts, ["event_id"], "index").select("event_id", "worker", "index", "event_type")


@register("run_metrics", """
SELECT shard, rows, bytes,
       CAST(sum(rows) OVER (ORDER BY shard) AS BIGINT) AS total_rows,
       CAST(sum(bytes) OVER (ORDER BY shard) AS BIGINT) AS total_bytes
FROM (SELECT doc_id // 100 AS shard, count(*) AS rows, CAST(sum(n_chars) AS BIGINT) AS bytes
      FROM documents GROUP BY 1)""")
def q_run_metrics(spark, sf):
    from shardforge.operators.metrics import run_metrics
    d = table(spark, sf, "documents").select(
        F.floor(F.col("doc_id") / 100).cast("bigint").alias("shard"), F.col("n_chars").alias("size"))
    return run_metrics(d, "shard", "size")


@register("quantise", f"""
SELECT vec_id, CAST(i AS INTEGER) AS i,
       CAST(trunc(least(greatest((CAST(embedding[i + 1] AS DOUBLE) / {S.d(0.18215)} + 1.0) / 2.0 * 255.0, 0.0), 255.0)) AS INTEGER) AS pixel
FROM embeddings, range(64) r(i)""")
def q_quantise(spark, sf):
    from shardforge.functions.arrays import quantise
    q = _emb(spark, sf).select("vec_id", quantise("embedding").alias("px"))
    return q.select("vec_id", F.posexplode_outer("px").alias("i", "pixel"))


@register("permute_axes", """
SELECT vec_id, rule, CAST(j AS INTEGER) AS j, round(CAST(embedding[src + 1] AS DOUBLE), 6) AS value
FROM (SELECT vec_id, embedding, label % 4 AS rule, j,
             CASE label % 4
               WHEN 0 THEN (j % 4) * 16 + (j // 16) * 4 + (j // 4) % 4
               WHEN 1 THEN (j % 8) * 8 + j // 8
               WHEN 2 THEN (j % 2) * 32 + ((j // 2) % 2) * 16 + (j // 16) * 4 + (j // 4) % 4
               ELSE j END AS src
      FROM embeddings, range(64) r(j))""")
def q_permute_axes(spark, sf):
    from shardforge.functions.arrays import permute_by_rule
    rules = {0: ("nchw_to_nhwc", (4, 4, 4)), 1: ("transpose", (8, 8)),
             2: ("oihw_to_hwio", (2, 2, 4, 4)), 3: ("copy", (64,))}
    e = _emb(spark, sf).select("vec_id", (F.col("label") % 4).alias("rule"), _x().alias("x"))
    p = e.select("vec_id", "rule", permute_by_rule(F.col("x"), F.col("rule"), rules).alias("y"))
    return p.select("vec_id", "rule", F.posexplode_outer("y").alias("j", "value")).select(
        "vec_id", "rule", "j", r6(F.col("value")).alias("value"))


@register("tile_mean", """
SELECT vec_id, CAST(tile AS INTEGER) AS tile, 0 AS c, round(avg(x), 6) AS mean
FROM (SELECT vec_id, ((i // 8) // 2) * 4 + (i % 8) // 2 AS tile, CAST(embedding[i + 1] AS DOUBLE) AS x
      FROM embeddings, range(64) r(i))
GROUP BY vec_id, tile""")
def q_tile_mean(spark, sf):
    from shardforge.operators.grids import tile_mean
    t = _emb(spark, sf).select("vec_id", tile_mean(_x(), (1, 8, 8), 2).alias("m"))
    return t.select("vec_id", F.posexplode_outer("m").alias("tile", "mean")).select(
        "vec_id", "tile", F.lit(0).alias("c"), r6(F.col("mean")).alias("mean"))


@register("patchify", """
SELECT vec_id, CAST(t AS INTEGER) AS token, CAST(f AS INTEGER) AS f,
       round(CAST(embedding[(f % 4) * 16 + ((t // 2) * 2 + f // 8) * 4 + (t % 2) * 2 + (f // 4) % 2 + 1] AS DOUBLE), 6) AS value,
       TRUE AS roundtrip_ok
FROM embeddings, range(4) a(t), range(16) b(f)""")
def q_patchify(spark, sf):
    from shardforge.operators.grids import patchify, unpatchify
    e = _emb(spark, sf).select("vec_id", _x().alias("x"))
    p = e.select("vec_id", "x", patchify(F.col("x"), (4, 4, 4), 2).alias("tok"))
    p = p.withColumn("roundtrip_ok", unpatchify(F.col("tok"), 4, 2) == F.col("x"))
    return (p.select("vec_id", "roundtrip_ok", F.posexplode_outer("tok").alias("token", "vec"))
            .select("vec_id", "token", "roundtrip_ok", F.posexplode_outer("vec").alias("f", "value"))
            .select("vec_id", "token", "f", r6(F.col("value")).alias("value"), "roundtrip_ok"))


def _rows8(x):
    return F.transform(F.sequence(F.lit(0), F.lit(7)), lambda y: F.slice(x, y * 8 + 1, 8))


def _mask_sql(m: int) -> str:
    return f"""SELECT {m} AS mask_id, vec_id, pos,
       row_number() OVER (PARTITION BY vec_id ORDER BY pos) - 1 AS ord
FROM embeddings, range(8) r(pos)
WHERE {S.u(SEED, f'mask{m}', '(vec_id * 8 + pos)')} < 0.5"""


@register("gather_tokens", f"""
WITH masks AS ({_mask_sql(0)} UNION ALL {_mask_sql(1)})
SELECT m.mask_id, m.vec_id, CAST(m.ord AS INTEGER) AS ord, CAST(j AS INTEGER) AS j,
       round(CAST(e.embedding[m.pos * 8 + j + 1] AS DOUBLE), 6) AS value
FROM masks m JOIN embeddings e ON e.vec_id = m.vec_id, range(8) r(j)""")
def q_gather_tokens(spark, sf):
    from shardforge.operators.grids import gather_tokens
    e = _emb(spark, sf).select("vec_id", _rows8(_x()).alias("tokens"))
    key = F.col("vec_id") * 8
    pos = F.sequence(F.lit(0), F.lit(7))
    from shardforge.functions.rng import seeded_uniform
    def kept(m):
        return F.filter(pos, lambda q: seeded_uniform(SEED, f"mask{m}", key + q) < F.lit(0.5))

    masks = F.array(*[F.struct(F.lit(m).alias("mask_id"), kept(m).alias("positions")) for m in range(2)])
    g = (e.select("vec_id", "tokens", F.explode(masks).alias("mk"))
         .select(F.col("mk.mask_id").alias("mask_id"), "vec_id",
                 gather_tokens(F.col("tokens"), F.col("mk.positions")).alias("kept")))
    # a mask may keep no position: outer explode, then drop the empty-list
    # row (an inner explode would push a size filter, and the mask draw,
    # below the scan)
    return (g.select("mask_id", "vec_id", F.posexplode_outer("kept").alias("ord", "vec"))
            .filter(F.col("vec").isNotNull())
            .select("mask_id", "vec_id", "ord", F.posexplode_outer("vec").alias("j", "value"))
            .select("mask_id", "vec_id", "ord", "j", r6(F.col("value")).alias("value")))


@register("repeat_interleave", """
SELECT conv_id, turn, CAST(r AS INTEGER) AS "repeat", CAST(p AS BIGINT) AS in_position,
       CAST((p // 4) * 12 + r * 4 + p % 4 AS BIGINT) AS out_position
FROM (SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) - 1 AS p FROM conversations), range(3) t(r)""")
def q_repeat_interleave(spark, sf):
    from shardforge.operators.grids import repeat_interleave_ordered
    c = table(spark, sf, "conversations").select("conv_id", "turn")
    return repeat_interleave_ordered(c, ["conv_id", "turn"], 4, 3).select(
        "conv_id", "turn", "repeat", "in_position", "out_position")


CLS = [0.02 * py_normal(SEED, "cls", 0, j) for j in range(8)]
MASK_TOK = [0.02 * py_normal(SEED, "mask_token", 0, j) for j in range(8)]


def _pe_sql(q: str, j: str) -> str:
    c = -math.log(10000.0) / 4
    return (f"(CASE WHEN {j} < 4 THEN sin({q} * exp({S.d(c)} * CAST({j} AS DOUBLE))) "
            f"ELSE cos({q} * exp({S.d(c)} * CAST({j} - 4 AS DOUBLE))) END)")


def _lit_list(vals):
    return "[" + ", ".join(S.d(v) for v in vals) + "]"


@register("concat_tokens", f"""
SELECT vec_id, 0 AS pos, CAST(j AS INTEGER) AS j, round({_lit_list(CLS)}[j + 1], 6) AS value
FROM embeddings, range(8) r(j)
UNION ALL
SELECT vec_id, CAST(y + 1 AS INTEGER), CAST(j AS INTEGER),
       round(CAST(embedding[y * 8 + j + 1] AS DOUBLE) + {_pe_sql('CAST(y AS DOUBLE)', 'j')}, 6)
FROM embeddings, range(8) a(y), range(8) r(j)
UNION ALL
SELECT vec_id, CAST(9 + m AS INTEGER), CAST(j AS INTEGER),
       round({_lit_list(MASK_TOK)}[j + 1] + {_pe_sql('CAST(8 + m AS DOUBLE)', 'j')}, 6)
FROM embeddings, range(2) b(m), range(8) r(j)""")
def q_concat_tokens(spark, sf):
    from shardforge.operators.grids import concat_tokens
    e = _emb(spark, sf).select("vec_id", _rows8(_x()).alias("tokens"))
    seq = concat_tokens(F.col("tokens"), prefix=[CLS], suffix=[MASK_TOK, MASK_TOK], pos_dim=8, pos_variant="1d")
    t = e.select("vec_id", seq.alias("seq"))
    return (t.select("vec_id", F.posexplode_outer("seq").alias("pos", "vec"))
            .select("vec_id", "pos", F.posexplode_outer("vec").alias("j", "value"))
            .select("vec_id", "pos", "j", r6(F.col("value")).alias("value")))


def _cubic_sql(dist: str, a: float = -0.75) -> str:
    return (f"(CASE WHEN {dist} <= 1.0 THEN (({a + 2.0}) * {dist} - ({a + 3.0})) * {dist} * {dist} + 1.0 "
            f"WHEN {dist} < 2.0 THEN (({a} * {dist} - {5.0 * a}) * {dist} + {8.0 * a}) * {dist} - {4.0 * a} "
            f"ELSE 0.0 END)")


_WTS = f"""SELECT o, k, least(greatest(CAST(floor((o + 0.5) * 2.0 - 0.5) AS INTEGER) - 1 + k, 0), 7) AS idx,
       {_cubic_sql('abs(((o + 0.5) * 2.0 - 0.5 - floor((o + 0.5) * 2.0 - 0.5)) - (k - 1))')} AS w
FROM range(4) a(o), range(4) b(k)"""


@register("grid_resample", f"""
WITH wts AS ({_WTS})
SELECT e.vec_id, CAST(wy.o * 4 + wx.o AS INTEGER) AS k,
       round(sum(wy.w * wx.w * CAST(e.embedding[wy.idx * 8 + wx.idx + 1] AS DOUBLE)), 6) AS value
FROM embeddings e, wts wy, wts wx
GROUP BY e.vec_id, wy.o, wx.o""")
def q_grid_resample(spark, sf):
    from shardforge.operators.grids import grid_resample
    g = _emb(spark, sf).select("vec_id", grid_resample(_x(), 1, 8, 8, 4, 4).alias("g"))
    return g.select("vec_id", F.posexplode_outer("g").alias("k", "value")).select(
        "vec_id", "k", r6(F.col("value")).alias("value"))


@register("token_slices", """
SELECT vec_id, 'drop_first' AS part, CAST(pos - 1 AS INTEGER) AS pos, CAST(j AS INTEGER) AS j,
       round(CAST(embedding[pos * 8 + j + 1] AS DOUBLE), 6) AS value
FROM embeddings, range(1, 8) a(pos), range(8) b(j)
UNION ALL
SELECT vec_id, 'tail3' AS part, CAST(pos - 5 AS INTEGER) AS pos, CAST(j AS INTEGER) AS j,
       round(CAST(embedding[pos * 8 + j + 1] AS DOUBLE), 6) AS value
FROM embeddings, range(5, 8) a(pos), range(8) b(j)""")
def q_token_slices(spark, sf):
    """C5's fixed-range forms: drop the first (class) token, keep the last k."""
    from shardforge.operators.grids import drop_first, tail
    e = _emb(spark, sf).select("vec_id", _rows8(_x()).alias("tokens"))
    parts = e.select("vec_id", F.array(
        F.struct(F.lit("drop_first").alias("part"), drop_first("tokens").alias("toks")),
        F.struct(F.lit("tail3").alias("part"), tail("tokens", 3).alias("toks"))).alias("p"))
    t = parts.select("vec_id", F.explode_outer("p").alias("p")).select("vec_id", "p.part", "p.toks")
    t = t.select("vec_id", "part", F.posexplode_outer("toks").alias("pos", "vec"))
    return (t.select("vec_id", "part", "pos", F.posexplode_outer("vec").alias("j", "value"))
            .select("vec_id", "part", "pos", "j", r6(F.col("value")).alias("value")))


@register("repeat_tile", """
SELECT conv_id, turn, CAST(r AS INTEGER) AS "repeat", CAST(p AS BIGINT) AS in_position,
       CAST(r * n + p AS BIGINT) AS out_position
FROM (SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) - 1 AS p, count(*) OVER () AS n
      FROM conversations), range(3) t(r)""")
def q_repeat_tile(spark, sf):
    """C6's plain tile option: the whole sequence repeated k times."""
    from shardforge.operators.grids import repeat_interleave
    from shardforge.operators.positions import global_positions
    c = table(spark, sf, "conversations").select("conv_id", "turn")
    pos = global_positions(c, ["conv_id", "turn"], "in_position")
    return repeat_interleave(pos, "in_position", 4, 3, tile=True).select(
        "conv_id", "turn", "repeat", "in_position", "out_position")



def _sql_of(name: str) -> str:
    from shardforge.catalog import ORACLES
    return ORACLES[name]


@register("tile_mean_long", _sql_of("tile_mean"))
def q_tile_mean_long(spark, sf):
    """C3 long form: one row per element, group by (sample, tile, channel)."""
    from shardforge.operators.grids import tile_mean_long
    e = _emb(spark, sf).select("vec_id", F.posexplode_outer(_x()).alias("i", "value"))
    long = e.select("vec_id", F.lit(0).alias("c"), F.floor(F.col("i") / 8).alias("y"), (F.col("i") % 8).alias("x"),
                    "value")
    t = tile_mean_long(long, "vec_id", "c", "y", "x", "value", 2, 8, 8)
    return t.select("vec_id", "tile", "c", r6(F.col("mean")).alias("mean"))


@register("gather_tokens_long", _sql_of("gather_tokens"))
def q_gather_tokens_long(spark, sf):
    """C5 long form: token rows joined with mask rows on (sample, pos)."""
    from shardforge.functions.rng import seeded_uniform
    from shardforge.operators.grids import gather_tokens_long
    e = _emb(spark, sf)
    tokens = (e.select("vec_id", F.posexplode_outer(_rows8(_x())).alias("pos", "vec")))
    pos = F.sequence(F.lit(0), F.lit(7))
    key = F.col("vec_id") * 8

    def kept(m):
        return F.filter(pos, lambda q: seeded_uniform(SEED, f"mask{m}", key + q) < F.lit(0.5))

    masks = None
    for m in range(2):
        part = (e.select(F.lit(m).alias("mask_id"), "vec_id", kept(m).alias("positions"))
                .select("mask_id", "vec_id", F.posexplode("positions").alias("ord", "pos")))
        masks = part if masks is None else masks.unionByName(part)
    g = gather_tokens_long(tokens, masks, "vec_id")
    return (g.select("mask_id", "vec_id", "ord", F.posexplode_outer("vec").alias("j", "value"))
            .select("mask_id", "vec_id", "ord", "j", r6(F.col("value")).alias("value")))


@register("concat_tokens_long", _sql_of("concat_tokens"))
def q_concat_tokens_long(spark, sf):
    """C7 long form: token rows, a class-token row in front and mask-token
    rows after, unioned with shifted positions, then position vectors."""
    from shardforge.functions.vectors import position_features, vec_add
    from shardforge.operators.grids import concat_token_rows
    e = _emb(spark, sf)
    toks = e.select("vec_id", F.posexplode_outer(_rows8(_x())).alias("pos", "vec"))
    cls = e.select("vec_id", F.lit(0).alias("pos"), F.array(*[F.lit(v) for v in CLS]).alias("vec"))
    masks = e.select("vec_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("pos"),
                     F.array(*[F.lit(v) for v in MASK_TOK]).alias("vec"))
    seq = concat_token_rows(concat_token_rows(cls, toks, 1), masks, 9)
    seq = seq.withColumn("vec", vec_add("vec", position_features(F.col("pos"), 8, 1, "1d", n_extra=1)))
    return (seq.select("vec_id", "pos", F.posexplode_outer("vec").alias("j", "value"))
            .select("vec_id", "pos", "j", r6(F.col("value")).alias("value")))
