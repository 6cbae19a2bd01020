"""Registered queries: vector features (D1-D9)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from shardforge import sqltwins as S
from shardforge.catalog import SEED, r6, register
from shardforge.functions.rng import py_uniform
from shardforge.session import table


def _emb(spark, sf):
    return table(spark, sf, "embeddings")


def _x():
    return F.col("embedding").cast("array<double>")


def _rows8(x):
    return F.transform(F.sequence(F.lit(0), F.lit(7)), lambda y: F.slice(x, y * 8 + 1, 8))


def _long(df, keys, arr, idx="j", val="value", digits=6):
    return (df.select(*keys, F.posexplode_outer(arr).alias(idx, val))
            .select(*keys, idx, F.round(F.col(val), digits).alias(val)))


# -- D1 ------------------------------------------------------------------------------

def _sin_sql(t: str, j: str, dim: int, period: float = 10000.0) -> str:
    half = dim // 2
    c = -math.log(period) / half
    return (f"(CASE WHEN {j} < {half} THEN cos({t} * exp({S.d(c)} * CAST({j} AS DOUBLE))) "
            f"WHEN {j} < {2 * half} THEN sin({t} * exp({S.d(c)} * CAST({j} - {half} AS DOUBLE))) ELSE 0.0 END)")


@register("sinusoid_features", f"""
SELECT event_id, CAST(j AS INTEGER) AS j, round({_sin_sql('value', 'j', 7)}, 6) AS value
FROM events, range(7) r(j)""")
def q_sinusoid_features(spark, sf):
    from shardforge.functions.vectors import sinusoid_features
    ev = table(spark, sf, "events").select("event_id", "value")
    return _long(ev.select("event_id", sinusoid_features("value", 7).alias("f")), ["event_id"], "f")


# -- D2 ------------------------------------------------------------------------------

def _pe2_sql(q: str, j: str, variant: str) -> str:
    p = f"({q} - 1)"
    row, col = f"({p} // 4)", f"({p} % 4)"
    first, second = (col, row) if variant == "half" else (row, col)
    c = -math.log(10000.0) / 2
    coord = f"(CASE WHEN {j} < 4 THEN {first} ELSE {second} END)"
    r = f"({j} % 4)"
    k = f"({r} % 2)"
    arg = f"(CAST({coord} AS DOUBLE) * exp({S.d(c)} * CAST({k} AS DOUBLE)))"
    return f"(CASE WHEN {q} = 0 THEN 0.0 WHEN {r} < 2 THEN sin({arg}) ELSE cos({arg}) END)"


@register("position_features", f"""
SELECT vec_id, CAST(q AS INTEGER) AS pos, CAST(j AS INTEGER) AS j,
       round(x + {_pe2_sql('q', 'j', 'half')}, 6) AS v_half,
       round(x + {_pe2_sql('q', 'j', 'quarter')}, 6) AS v_quarter
FROM (SELECT vec_id, q, j, CASE WHEN q = 0 THEN 0.0 ELSE CAST(embedding[(q - 1) * 8 + j + 1] AS DOUBLE) END AS x
      FROM embeddings, range(9) a(q), range(8) b(j))""")
def q_position_features(spark, sf):
    from shardforge.functions.vectors import position_features
    e = _emb(spark, sf).select("vec_id", F.concat(F.array(F.array_repeat(F.lit(0.0), 8)), _rows8(_x())).alias("tok"))

    def add(variant):
        return F.transform("tok", lambda t, q: F.zip_with(
            t, position_features(q, 8, 4, variant, n_extra=1), lambda a, b: a + b))

    t = e.select("vec_id", F.arrays_zip(add("half").alias("h"), add("quarter").alias("q")).alias("z"))
    t = t.select("vec_id", F.posexplode_outer("z").alias("pos", "zz"))
    t = t.select("vec_id", "pos", F.posexplode_outer(F.arrays_zip(F.col("zz.h").alias("h"), F.col("zz.q").alias("q")))
                 .alias("j", "e"))
    return t.select("vec_id", "pos", "j", r6(F.col("e.h")).alias("v_half"), r6(F.col("e.q")).alias("v_quarter"))


# -- D3 ------------------------------------------------------------------------------

_T3 = "(CAST(vec_id % 100 AS DOUBLE) / 100.0)"


@register("label_lookup", f"""
WITH ex AS (SELECT vec_id, label, j, CAST(embedding[j + 1] AS DOUBLE) AS x FROM embeddings, range(64) r(j)),
tbl AS (SELECT label, j, avg(x) AS v FROM ex GROUP BY label, j
        UNION ALL SELECT 1000 AS label, j, avg(x) AS v FROM ex GROUP BY j),
s AS (SELECT vec_id, CASE WHEN {S.u(SEED, 'drop', 'vec_id')} < {S.d(0.1)} THEN 1000 ELSE label END AS y FROM embeddings)
SELECT s.vec_id, s.y AS label_in, CAST(r.j AS INTEGER) AS j,
       round({_sin_sql(_T3.replace('vec_id', 's.vec_id'), 'r.j', 64)} + tbl.v, 6) AS cond, TRUE AS lookup_ok
FROM s, range(64) r(j), tbl WHERE tbl.label = s.y AND tbl.j = r.j""")
def q_label_lookup(spark, sf):
    from shardforge.functions.vectors import sinusoid_features
    from shardforge.operators.features import class_table
    from shardforge.operators.labels import label_dropout, label_lookup
    e = _emb(spark, sf)
    tbl = class_table(e, "label", "embedding", null_class=1000)
    s = e.select("vec_id", label_dropout(F.col("label"), F.col("vec_id"), 0.1, 1000, SEED).alias("label_in"),
                 sinusoid_features((F.col("vec_id") % 100).cast("double") / 100.0, 64).alias("t_emb"))
    out = label_lookup(s, tbl, "label_in", "label", "vec", add_col="t_emb", out_col="cond")
    return _long(out.select("vec_id", "label_in", "lookup_ok", "cond"), ["vec_id", "label_in", "lookup_ok"], "cond",
                 val="cond").select("vec_id", "label_in", "j", "cond", "lookup_ok")


# -- D4 ------------------------------------------------------------------------------

def _param_sql(k: str) -> str:
    return f"(0.1 * {S.normal(SEED, 'adaln', 'label', k)})"


@register("modulate", f"""
SELECT vec_id, CAST(pos AS INTEGER) AS pos, CAST(j AS INTEGER) AS j, round(m, 6) AS modulated,
       round(x + g * m, 6) AS gated
FROM (SELECT vec_id, pos, j, x, {_param_sql('(16 + j)')} AS g,
             x * (1.0 + {_param_sql('(8 + j)')}) + {_param_sql('j')} AS m
      FROM (SELECT vec_id, label, pos, j, CAST(embedding[pos * 8 + j + 1] AS DOUBLE) AS x
            FROM embeddings, range(8) a(pos), range(8) b(j)))""")
def q_modulate(spark, sf):
    from shardforge.functions.rng import seeded_normal
    from shardforge.operators.features import modulate_tokens
    e = _emb(spark, sf).select("vec_id", "label", _rows8(_x()).alias("tokens"))
    params = (_emb(spark, sf).select("label").distinct()
              .select("label", F.transform(seeded_normal(SEED, "adaln", F.col("label"), 48),
                                           lambda v: v * F.lit(0.1)).alias("params")))
    m = modulate_tokens(e, params, "label", "tokens", "params", 8)
    t = m.select("vec_id", F.posexplode_outer(F.arrays_zip(F.col("modulated").alias("m"), F.col("gated").alias("g")))
                 .alias("pos", "z"))
    t = t.select("vec_id", "pos", F.posexplode_outer(F.arrays_zip(F.col("z.m").alias("m"), F.col("z.g").alias("g")))
                 .alias("j", "e"))
    return t.select("vec_id", "pos", "j", r6(F.col("e.m")).alias("modulated"), r6(F.col("e.g")).alias("gated"))


# -- D5 ------------------------------------------------------------------------------

@register("vector_functions", f"""
WITH ex AS (SELECT vec_id, CAST(j AS INTEGER) AS j, CAST(embedding[j + 1] AS DOUBLE) AS x FROM embeddings, range(64) r(j)),
st AS (SELECT vec_id, avg(x) AS mu, sum(x * x) AS ss, max(x) AS mx FROM ex GROUP BY vec_id),
st2 AS (SELECT ex.vec_id, avg((x - mu) * (x - mu)) AS var, sum(exp(x - mx)) AS se
        FROM ex JOIN st USING (vec_id) GROUP BY ex.vec_id)
SELECT ex.vec_id, ex.j,
       round((x - mu) / sqrt(var + {S.d(1e-6)}), 6) AS layer_norm,
       round(x / sqrt(ss), 6) AS l2,
       round(exp(x - mx) / se, 6) AS softmax,
       round(x * (1.0 / (1.0 + exp(-x))), 6) AS silu,
       round(0.5 * x * (1.0 + tanh({S.d(math.sqrt(2 / math.pi))} * (x + {S.d(0.044715)} * x * x * x))), 6) AS gelu_tanh,
       round(x * (1.0 / (1.0 + exp(-({S.d(1.702)} * x)))), 6) AS quick_gelu,
       round(greatest(x, 0.0), 6) AS relu,
       round(ss, 6) AS self_dot
FROM ex JOIN st USING (vec_id) JOIN st2 USING (vec_id)""")
def q_vector_functions(spark, sf):
    from shardforge.functions import vectors as V
    e = _emb(spark, sf).select("vec_id", _x().alias("x"))
    cols = {"layer_norm": V.layer_norm("x", 1e-6), "l2": V.l2_normalize("x"), "softmax": V.softmax("x"),
            "silu": V.vec_act("silu", "x"), "gelu_tanh": V.vec_act("gelu_tanh", "x"),
            "quick_gelu": V.vec_act("quick_gelu", "x"), "relu": V.vec_act("relu", "x")}
    z = e.select("vec_id", V.dot("x", "x").alias("self_dot"), F.arrays_zip(*[c.alias(n) for n, c in cols.items()]).alias("z"))
    t = z.select("vec_id", "self_dot", F.posexplode_outer("z").alias("j", "e"))
    return t.select("vec_id", "j", *[r6(F.col(f"e.{n}")).alias(n) for n in cols], r6(F.col("self_dot")).alias("self_dot"))


# -- D6 ------------------------------------------------------------------------------

def mlp_weights(dims=(64, 16, 4), seed=SEED):
    """Hash-made weights: W_l[i, o] = (u(seed, 'w{l}', i * out + o) - 0.5) * 0.4,
    b_l[o] = (u(seed, 'b{l}', o) - 0.5) * 0.2 — parameters, not data."""
    layers = []
    for li, (n_in, n_out) in enumerate(zip(dims[:-1], dims[1:])):
        w = np.array([[(py_uniform(seed, f"w{li}", i * n_out + o) - 0.5) * 0.4 for o in range(n_out)]
                      for i in range(n_in)])
        b = np.array([(py_uniform(seed, f"b{li}", o) - 0.5) * 0.2 for o in range(n_out)])
        layers.append((w, b))
    return layers


def _mlp_sql(dims=(64, 16, 4)) -> str:
    k = math.sqrt(2 / math.pi)
    w = lambda li, n_out: f"(({S.u(SEED, f'w{li}', f'(i * {n_out} + o)')} - 0.5) * 0.4)"
    b = lambda li: f"(({S.u(SEED, f'b{li}', 'o')} - 0.5) * 0.2)"
    return f"""
WITH x0 AS (SELECT vec_id, CAST(i AS INTEGER) AS i, CAST(embedding[i + 1] AS DOUBLE) AS x FROM embeddings, range({dims[0]}) r(i)),
h AS (SELECT vec_id, o AS i, sum(x * {w(0, dims[1])}) + {b(0)} AS z
      FROM x0, range({dims[1]}) r(o) GROUP BY vec_id, o),
a AS (SELECT vec_id, i, 0.5 * z * (1.0 + tanh({S.d(k)} * (z + {S.d(0.044715)} * z * z * z))) AS x FROM h)
SELECT vec_id, CAST(o AS INTEGER) AS o, round(sum(x * {w(1, dims[2])}) + {b(1)}, 6) AS score
FROM a, range({dims[2]}) r(o) GROUP BY vec_id, o"""


@register("dense_score", _mlp_sql())
def q_dense_score(spark, sf):
    from shardforge.operators.features import dense_score
    e = _emb(spark, sf).select("vec_id", _x().alias("x"))
    s = dense_score(e, "x", mlp_weights(), "gelu_tanh", "score")
    return _long(s.select("vec_id", "score"), ["vec_id"], "score", idx="o", val="score")


# -- D7 ------------------------------------------------------------------------------

def _attn_sql(causal: bool) -> str:
    cond = "AND k.vec_id <= q.vec_id" if causal else ""
    return f"""
WITH t AS (SELECT vec_id, label, vec_id // 50 AS grp, embedding FROM embeddings),
s AS (SELECT q.vec_id AS qid, k.vec_id AS kid, list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(k.embedding AS DOUBLE[])) / 8.0 AS sc
      FROM t q JOIN t k ON q.label = k.label AND q.grp = k.grp {cond}),
w AS (SELECT qid, kid, exp(sc - max(sc) OVER (PARTITION BY qid)) AS e FROM s),
n AS (SELECT qid, kid, e / sum(e) OVER (PARTITION BY qid) AS p FROM w)
SELECT n.qid AS vec_id, CAST(j AS INTEGER) AS j, round(sum(n.p * CAST(t.embedding[j + 1] AS DOUBLE)), 6) AS value
FROM n JOIN t ON t.vec_id = n.kid, range(64) r(j)
GROUP BY n.qid, j"""


def _attn_query(causal: bool):
    def q(spark, sf):
        from shardforge.operators.features import group_attention
        e = _emb(spark, sf).select("vec_id", "label", (F.col("vec_id") / 50).cast("bigint").alias("grp"), "embedding")
        a = group_attention(e, ["label", "grp"], "vec_id", "vec_id", "embedding", causal=causal, block_rows=2)
        return _long(a.select("vec_id", "attn"), ["vec_id"], "attn")
    return q


register("group_attention", _attn_sql(False))(_attn_query(False))
register("group_attention_causal", _attn_sql(True))(_attn_query(True))


def _positions_sql(causal: bool) -> str:
    """Tokens named by their position in the sequence, as models do: the same
    ids come back in every group."""
    cond = "AND k.pos <= q.pos" if causal else ""
    return f"""
WITH t AS (SELECT vec_id // 10 AS seq, vec_id % 10 AS pos, embedding FROM embeddings),
s AS (SELECT q.seq, q.pos, k.pos AS kpos, list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(k.embedding AS DOUBLE[])) / 8.0 AS sc
      FROM t q JOIN t k ON q.seq = k.seq {cond}),
w AS (SELECT seq, pos, kpos, exp(sc - max(sc) OVER (PARTITION BY seq, pos)) AS e FROM s),
n AS (SELECT seq, pos, kpos, e / sum(e) OVER (PARTITION BY seq, pos) AS p FROM w)
SELECT n.seq, n.pos, CAST(j AS INTEGER) AS j, round(sum(n.p * CAST(t.embedding[j + 1] AS DOUBLE)), 6) AS value
FROM n JOIN t ON t.seq = n.seq AND t.pos = n.kpos, range(64) r(j)
GROUP BY n.seq, n.pos, j"""


def _sequences(spark, sf):
    return _emb(spark, sf).select((F.col("vec_id") / 10).cast("bigint").alias("seq"),
                                  (F.col("vec_id") % 10).alias("pos"), "embedding")


@register("group_attention_positions", _positions_sql(False))
def q_group_attention_positions(spark, sf):
    from shardforge.operators.features import group_attention
    a = group_attention(_sequences(spark, sf), ["seq"], "pos", "pos", "embedding", block_rows=4)
    return _long(a.select("seq", "pos", "attn"), ["seq", "pos"], "attn")


def _sequence_query(causal: bool):
    def q(spark, sf):
        from shardforge.operators.features import sequence_attention
        s = (_sequences(spark, sf).groupBy("seq").agg(F.sort_array(F.collect_list(F.struct("pos", F.col("embedding").cast("array<double>").alias("v")))).alias("t"))
             .select("seq", F.col("t.pos").alias("at"), F.col("t.v").alias("vecs")))
        a = sequence_attention(s, "vecs", causal=causal, block=4)
        rows = a.select("seq", F.explode(F.arrays_zip("at", "attn")).alias("z")).select("seq", F.col("z.at").alias("pos"), F.col("z.attn").alias("attn"))
        return _long(rows, ["seq", "pos"], "attn")
    return q


register("sequence_attention", _positions_sql(False))(_sequence_query(False))
register("sequence_attention_causal", _positions_sql(True))(_sequence_query(True))


@register("attention_pool", """
WITH t AS (SELECT nullif(label, 3) AS label, nullif(vec_id // 50, 1) AS grp, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
ex AS (SELECT label, grp, j, v[j + 1] AS x FROM t, range(64) r(j)),
mu AS (SELECT label, grp, list(avg_x ORDER BY j) AS q FROM
        (SELECT label, grp, j, avg(x) AS avg_x FROM ex GROUP BY label, grp, j) GROUP BY label, grp),
tok AS (SELECT label, grp, v FROM t UNION ALL SELECT label, grp, q AS v FROM mu),
sc AS (SELECT tok.label, tok.grp, tok.v, list_dot_product(tok.v, mu.q) / 8.0 AS s
       FROM tok JOIN mu ON tok.label IS NOT DISTINCT FROM mu.label AND tok.grp IS NOT DISTINCT FROM mu.grp),
w AS (SELECT label, grp, v, exp(s - max(s) OVER (PARTITION BY label, grp)) AS e FROM sc),
p AS (SELECT label, grp, v, e / sum(e) OVER (PARTITION BY label, grp) AS pr FROM w)
SELECT label, CAST(grp AS BIGINT) AS grp, CAST(j AS INTEGER) AS j, round(sum(pr * v[j + 1]), 6) AS value
FROM p, range(64) r(j) GROUP BY label, grp, j""")
def q_attention_pool(spark, sf):
    from shardforge.operators.features import attention_pool
    # one label and one range of ids are null: null groups are pooled too
    e = _emb(spark, sf).select(F.nullif("label", F.lit(3)).alias("label"),
                               F.nullif((F.col("vec_id") / 50).cast("bigint"), F.lit(1)).alias("grp"), "embedding")
    p = attention_pool(e, ["label", "grp"], "embedding")
    return _long(p, ["label", "grp"], "pooled")


# -- D8 ------------------------------------------------------------------------------

LOGIT_SCALE = math.log(1 / 0.07)


@register("cosine_topk", f"""
WITH t AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
n AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM t),
l AS (SELECT a.vec_id AS row_id, b.vec_id AS other_id, {S.d(math.exp(LOGIT_SCALE))} * list_dot_product(a.u, b.u) AS logit
      FROM n a, n b),
r AS (SELECT 'a2b' AS direction, row_id, other_id, logit FROM l
      UNION ALL SELECT 'b2a' AS direction, other_id AS row_id, row_id AS other_id, logit FROM l),
k AS (SELECT direction, row_id, other_id, logit,
             row_number() OVER (PARTITION BY direction, row_id ORDER BY round(logit, 9) DESC, other_id) AS rank FROM r)
SELECT direction, row_id, CAST(rank AS INTEGER) AS rank, other_id, round(logit, 4) AS logit FROM k WHERE rank <= 5""")
def q_cosine_topk(spark, sf):
    from shardforge.operators.features import cosine_topk
    e = _emb(spark, sf)
    # blocks of 512 rows: several tiles on this small table
    r = cosine_topk(e, e, "vec_id", "vec_id", "embedding", LOGIT_SCALE, 5, block_rows=512)
    return r.select("direction", "row_id", "rank", "other_id", F.round("logit", 4).alias("logit"))


# -- D9 ------------------------------------------------------------------------------

def _bucket_sql(w: str, dim: int) -> str:
    return f"((('0x' || substr(md5({w}), 1, 8))::BIGINT) % {dim})"


def _punct_sql(k: int) -> str:
    chars = ["' '", "chr(10)", "'.'", "','"]
    return "\nUNION ALL\n".join(
        f"SELECT doc_id, 'punct-count-{k}' AS encoder, CAST({i} AS BIGINT) AS bucket, "
        f"CAST(length(text) - length(replace(text, {ch}, '')) AS DOUBLE) AS value FROM documents"
        for i, ch in enumerate(chars[:k]))


@register("extract_features", f"""
WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) AS i
           FROM documents),
bg AS (SELECT a.doc_id, a.word || ' ' || b.word AS word FROM w a JOIN w b ON a.doc_id = b.doc_id AND b.i = a.i + 1)
SELECT doc_id, 'hash-bow-32' AS encoder, {_bucket_sql('word', 32)} AS bucket, CAST(count(*) AS DOUBLE) AS value
FROM w GROUP BY doc_id, bucket
UNION ALL
SELECT doc_id, 'hash-bigram-16' AS encoder, {_bucket_sql('word', 16)} AS bucket, CAST(count(*) AS DOUBLE) AS value
FROM bg GROUP BY doc_id, bucket
UNION ALL
{_punct_sql(4)}""")
def q_extract_features(spark, sf):
    """Built-in hashing encoders (Spark expressions) and a registry encoder
    (NumPy callable, one mapInArrow pass) from one spec string."""
    from shardforge.operators.features import extract_features, punct_counts
    d = table(spark, sf, "documents").select("doc_id", "text")
    return extract_features(d, "doc_id", "text", "hash-bow-32,hash-bigram-16,punct-count-4",
                            registry={"punct-count": punct_counts}).select("doc_id", "encoder", "bucket", "value")


@register("argmax_pick", f"""
SELECT doc_id, CAST(len(ids) AS INTEGER) AS n_tokens, CAST(list_position(ids, list_max(ids)) - 1 AS INTEGER) AS argmax_pos,
       list_max(ids) AS max_id
FROM (SELECT doc_id, list_transform(string_split(text, ' '), lambda w: {_bucket_sql('w', 49408)}) AS ids FROM documents)""")
def q_argmax_pick(spark, sf):
    from shardforge.operators.features import argmax_pick, word_bucket
    from shardforge.session import ensure_parallelism
    d = ensure_parallelism(table(spark, sf, "documents")).select(
        "doc_id", F.transform(F.split("text", " "), lambda w: word_bucket(w, 49408)).alias("ids"))
    return d.select("doc_id", F.size("ids").alias("n_tokens"), argmax_pick("ids").alias("argmax_pos"),
                    F.array_max("ids").alias("max_id"))


@register("dense_score_expr", _mlp_sql())
def q_dense_score_expr(spark, sf):
    """D6 as a Column expression (weights as literals, no Python): the path
    for small layers; same numbers as the Arrow path."""
    from shardforge.operators.features import dense_layer
    (w1, b1), (w2, b2) = mlp_weights()
    e = _emb(spark, sf).select("vec_id", _x().alias("x"))
    s = e.select("vec_id", dense_layer(dense_layer("x", w1, b1, "gelu_tanh"), w2, b2).alias("score"))
    return _long(s, ["vec_id"], "score", idx="o", val="score")
