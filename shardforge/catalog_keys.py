"""Registered queries: key-table migration and parity (E1-E5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from shardforge import sqltwins as S
from shardforge.catalog import register
from shardforge.session import table

# The parameter-name parts and the rename rules of the
# self-supervised encoder checkpoint fix-up (a prefix keep, prefix strip,
# four misnamed norm/fc keys in blocks 13 and 14, head and fc drops) and
# the legacy decoder-block shift.
PART_BY_EVENT = {"click": "attn.qkv", "view": "mlp.fc1", "signup": "norm1",
                 "error": "mlp.fc2", "purchase": "norm2"}
ODD_PARTS = {(13, "norm1"): "norm13", (13, "mlp.fc1"): "mlp.fc13",
             (14, "norm2"): "norm14", (14, "mlp.fc2"): "mlp.fc14"}
ENCODER_DEPTH = 15
REWRITE_RULES = [
    {"ord": 0, "kind": "keep_prefix", "pattern": "module.base_encoder"},
    {"ord": 1, "kind": "strip_prefix", "pattern": "module.base_encoder."},
    {"ord": 2, "kind": "replace_if", "cond": "blocks.13.norm13", "pattern": "norm13", "replacement": "norm1"},
    {"ord": 3, "kind": "replace_if", "cond": "blocks.13.mlp.fc13", "pattern": "fc13", "replacement": "fc1"},
    {"ord": 4, "kind": "replace_if", "cond": "blocks.14.norm14", "pattern": "norm14", "replacement": "norm2"},
    {"ord": 5, "kind": "replace_if", "cond": "blocks.14.mlp.fc14", "pattern": "fc14", "replacement": "fc2"},
    {"ord": 6, "kind": "drop_contains", "pattern": "head"},
    {"ord": 7, "kind": "drop_first_segment", "pattern": "fc"},
    {"ord": 8, "kind": "shift_segment", "pattern": "decoder_blocks", "replacement": "blocks",
     "amount": ENCODER_DEPTH},
]


def key_table(spark, sf):
    """(snapshot, key, pos, value) built from events: one stored value per
    event, dotted parameter names with a few odd names so that every rule
    fires."""
    ev = table(spark, sf, "events")
    b = (F.col("user_id") % 15).cast("int")
    et = F.col("event_type")
    part = None
    for (blk, p), odd in ODD_PARTS.items():
        ev_type = [k for k, v in PART_BY_EVENT.items() if v == p][0]
        cond = (b == blk) & (et == ev_type)
        part = F.when(cond, F.lit(odd)) if part is None else part.when(cond, F.lit(odd))
    for ev_type, p in PART_BY_EVENT.items():
        part = part.when(et == ev_type, F.lit(p))
    part = part.otherwise(et)
    bs = b.cast("string")
    uid = F.col("user_id")
    key = (F.when(uid % 11 == 0, F.concat(F.lit("module.base_encoder.head."), part, F.lit(".weight")))
           .when(uid % 13 == 0, F.concat(F.lit("module.base_encoder.fc."), bs, F.lit(".bias")))
           .when(uid % 17 == 0, F.concat(F.lit("module.momentum_encoder.blocks."), bs, F.lit("."), part,
                                         F.lit(".weight")))
           .when(uid % 19 == 0, F.concat(F.lit("module.base_encoder.decoder_blocks."), bs, F.lit("."),
                                         part, F.lit(".weight")))
           .otherwise(F.concat(F.lit("module.base_encoder.blocks."), bs, F.lit("."), part, F.lit(".weight"))))
    return ev.select((F.col("event_id") % 3).cast("int").alias("snapshot"), key.alias("key"),
                     F.col("event_id").alias("pos"), "value")


def _part_sql():
    cases = " ".join(f"WHEN event_type = '{et}' THEN '{p}'" for et, p in PART_BY_EVENT.items())
    base = f"(CASE {cases} ELSE event_type END)"
    odd = " ".join(f"WHEN user_id % 15 = {blk} AND {base} = '{p}' THEN '{o}'" for (blk, p), o in ODD_PARTS.items())
    return f"(CASE {odd} ELSE {base} END)"


KEYS_SQL = f"""SELECT CAST(event_id % 3 AS INTEGER) AS snapshot,
  CASE WHEN user_id % 11 = 0 THEN 'module.base_encoder.head.' || {_part_sql()} || '.weight'
       WHEN user_id % 13 = 0 THEN 'module.base_encoder.fc.' || CAST(user_id % 15 AS VARCHAR) || '.bias'
       WHEN user_id % 17 = 0 THEN 'module.momentum_encoder.blocks.' || CAST(user_id % 15 AS VARCHAR) || '.' || {_part_sql()} || '.weight'
       WHEN user_id % 19 = 0 THEN 'module.base_encoder.decoder_blocks.' || CAST(user_id % 15 AS VARCHAR) || '.' || {_part_sql()} || '.weight'
       ELSE 'module.base_encoder.blocks.' || CAST(user_id % 15 AS VARCHAR) || '.' || {_part_sql()} || '.weight' END AS key,
  event_id AS pos, value
FROM events"""


@register("flatten_keys", f"""
SELECT snapshot, key, count(*) AS n_values,
       CAST(len(string_split(key, '.')) AS INTEGER) AS depth,
       string_split(key, '.')[-1] AS leaf,
       regexp_replace(key, '\\.[^.]*$', '') AS parent,
       string_split(key, '.')[1] AS level_0, string_split(key, '.')[3] AS level_2
FROM ({KEYS_SQL}) GROUP BY snapshot, key""")
def q_flatten_keys(spark, sf):
    from shardforge.operators.keytable import key_inventory
    from shardforge.operators.keytable import unflatten_keys
    inv = key_inventory(key_table(spark, sf), ["snapshot"], "key")
    inv = unflatten_keys(inv.drop("depth", "leaf", "parent"), "key", max_levels=3)
    return inv.select("snapshot", "key", "n_values", "depth", "leaf", "parent", "level_0", "level_2")


def _rewrite_sql():
    """Kept (snapshot, key, new_key) rows, one subquery per rule step."""
    q = (f"SELECT snapshot, key, CASE WHEN starts_with(key, 'module.base_encoder.') "
         f"THEN substr(key, {len('module.base_encoder.') + 1}) ELSE key END AS k "
         f"FROM ({KEYS_SQL}) WHERE starts_with(key, 'module.base_encoder')")
    for r in REWRITE_RULES[2:6]:
        q = (f"SELECT snapshot, key, CASE WHEN contains(k, '{r['cond']}') THEN "
             f"replace(k, '{r['pattern']}', '{r['replacement']}') ELSE k END AS k FROM ({q})")
    q = f"SELECT snapshot, key, k FROM ({q}) WHERE NOT contains(k, 'head') AND split_part(k, '.', 1) <> 'fc'"
    parts = "string_split(k, '.')"
    shifted = (f"('blocks.' || CAST(CAST({parts}[2] AS INTEGER) + {ENCODER_DEPTH} AS VARCHAR) || '.' || "
               f"array_to_string({parts}[3:], '.'))")
    return (f"SELECT snapshot, key, CASE WHEN contains(k, 'decoder_blocks') THEN {shifted} ELSE k END AS new_key "
            f"FROM ({q})")


@register("rewrite_keys", f"""
WITH m AS (
  SELECT snapshot, key, new_key, count(*) AS n_values
  FROM ({_rewrite_sql()}) GROUP BY snapshot, key, new_key)
SELECT m.snapshot, m.key, m.new_key, m.n_values, c.n_src > 1 AS collision
FROM m JOIN (SELECT snapshot, new_key, count(*) AS n_src FROM m GROUP BY 1, 2) c
  ON m.snapshot = c.snapshot AND m.new_key = c.new_key""")
def q_rewrite_keys(spark, sf):
    from shardforge.operators.keytable import rewrite_keys
    kt = key_table(spark, sf)
    rw = rewrite_keys(kt, REWRITE_RULES, "key", "new_key")
    m = rw.groupBy("snapshot", "key", "new_key").agg(F.count(F.lit(1)).alias("n_values"))
    c = m.groupBy("snapshot", "new_key").agg(F.count(F.lit(1)).alias("n_src"))
    return m.join(c, ["snapshot", "new_key"]).select(
        "snapshot", "key", "new_key", "n_values", (F.col("n_src") > 1).alias("collision"))


_PFX = "module.base_encoder.blocks."


@register("profile_keys", f"""
SELECT snapshot, count(*) AS n_keys,
       count(DISTINCT CASE WHEN starts_with(key, '{_PFX}') THEN split_part(key, '.', 3) END) AS n_layers,
       count(CASE WHEN starts_with(key, '{_PFX}') AND ends_with(key, '.attn.qkv.weight') THEN 1 END) AS n_attn,
       max(contains(key, 'decoder_blocks')) AS has_decoder,
       max(contains(key, 'head')) AS has_head,
       CAST(max(CASE WHEN key = '{_PFX}0.norm1.weight' THEN n END) AS BIGINT) AS width
FROM (SELECT snapshot, key, count(*) AS n FROM ({KEYS_SQL}) GROUP BY 1, 2) GROUP BY snapshot""")
def q_profile_keys(spark, sf):
    from shardforge.operators.keytable import profile_keys
    return profile_keys(key_table(spark, sf), "snapshot", "key",
                        segment_counts={"n_layers": (_PFX, 2)},
                        suffix_counts={"n_attn": (_PFX, ".attn.qkv.weight")},
                        presence={"has_decoder": "decoder_blocks", "has_head": "head"},
                        sizes={"width": f"{_PFX}0.norm1.weight"})


@register("strict_match", """
SELECT doc_id, 'missing' AS kind FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)
UNION ALL
SELECT doc_id, 'unexpected' AS kind FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)""")
def q_strict_match(spark, sf):
    from shardforge.operators.keytable import strict_match
    return strict_match(table(spark, sf, "documents"), table(spark, sf, "labels"), ["doc_id"]).select(
        "doc_id", "kind")


def perturbed_orders(spark, sf):
    """Copy of orders: +1e-4 on o_totalprice where key % 97 = 0, rows with
    key % 101 = 0 removed, key shifted by 10,000,000 where key % 103 = 0."""
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    return (o.filter(k % 101 != 0)
            .select(F.when(k % 103 == 0, k + F.lit(10_000_000)).otherwise(k).alias("o_orderkey"),
                    F.when(k % 97 == 0, F.col("o_totalprice") + F.lit(1e-4)).otherwise(F.col("o_totalprice"))
                    .alias("o_totalprice")))


@register("parity", f"""
WITH b AS (
  SELECT CASE WHEN o_orderkey % 103 = 0 THEN o_orderkey + 10000000 ELSE o_orderkey END AS o_orderkey,
         CASE WHEN o_orderkey % 89 = 0 THEN NULL WHEN o_orderkey % 97 = 0 THEN o_totalprice + {S.d(1e-4)} ELSE o_totalprice END AS o_totalprice
  FROM orders WHERE o_orderkey % 101 <> 0),
j AS (SELECT coalesce(a.o_orderkey, b.o_orderkey) AS k, a.o_totalprice AS va, b.o_totalprice AS vb,
             a.o_orderkey IS NOT NULL AS pa, b.o_orderkey IS NOT NULL AS pb
      FROM orders a FULL OUTER JOIN b ON a.o_orderkey = b.o_orderkey)
SELECT count(CASE WHEN pa AND pb THEN 1 END) AS n_common,
       count(CASE WHEN NOT pb THEN 1 END) AS n_only_a,
       count(CASE WHEN NOT pa THEN 1 END) AS n_only_b,
       round(max(CASE WHEN va IS NOT NULL AND vb IS NOT NULL THEN abs(va - vb) END), 9) AS max_abs_diff,
       count(CASE WHEN pa AND pb AND (abs(va - vb) >= {S.d(1.5e-6)} OR (va IS NULL) <> (vb IS NULL)) THEN 1 END) AS n_beyond,
       -max(CASE WHEN va IS NOT NULL AND vb IS NOT NULL THEN {{'d': abs(va - vb), 'nk': -k}} END)['nk'] AS worst_key
FROM j""")
def q_parity(spark, sf):
    from shardforge.operators.keytable import parity
    b = perturbed_orders(spark, sf)
    key = F.when(F.col("o_orderkey") > 10000000, F.col("o_orderkey") - 10000000).otherwise(F.col("o_orderkey"))
    b = b.withColumn("o_totalprice", F.when(key % 89 != 0, F.col("o_totalprice")))      # lost values count as beyond
    p = parity(table(spark, sf, "orders"), b, ["o_orderkey"], "o_totalprice", 6)
    return p.withColumn("max_abs_diff", F.round("max_abs_diff", 9))


# --- migration as one job and comparison by digests ------------------------------

MIGRATION = [("module.base_encoder.blocks.*", "blocks_{0}", "keep"),
             ("module.base_encoder.blocks.*.attn.qkv.weight", "blocks_{0}.attn.qkv.kernel", "linear"),
             ("module.base_encoder.blocks.*.mlp.fc1.weight", "blocks_{0}.mlp.fc1.kernel", "linear"),
             ("module.base_encoder.blocks.*.mlp.fc2.weight", "blocks_{0}.mlp.fc2.kernel", "conv"),
             ("module.base_encoder.blocks.13.norm13", "blocks_13.norm1", "keep"),
             ("module.base_encoder.blocks.13.mlp.fc13.weight", "blocks_13.mlp.fc1.kernel", "linear"),
             ("module.base_encoder.blocks.14.norm14", "blocks_14.norm2", "keep"),
             ("module.base_encoder.blocks.14.mlp.fc14.weight", "blocks_14.mlp.fc1.kernel", "conv"),
             ("module.base_encoder.decoder_blocks.*", "blocks_{0+15}", "keep"),
             ("module.base_encoder.decoder_blocks.*.mlp.fc2.weight", "blocks_{0+15}.mlp.fc2.kernel", "conv"),
             ("module.base_encoder.head", None, "keep"), ("module.base_encoder.fc", None, "keep"), ("module.momentum_encoder", None, "keep")]


def array_table(spark, sf):
    """One array per snapshot and key: its values in order, as rows of two
    where their number is even, and with a kernel of 1 x 2 where four divide it."""
    n = F.size("values")
    rows = key_table(spark, sf).groupBy("snapshot", "key").agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("v"))
    rows = rows.select("snapshot", "key", F.transform("v", lambda x: x["value"].cast("double")).alias("values"))
    conv = F.col("key").endswith("fc2.weight") | F.col("key").endswith("fc14.weight")
    shape = (F.when(conv & (n % 4 == 0), F.array((n / 4).cast("int"), F.lit(2), F.lit(1), F.lit(2)))
             .when(~conv & (n % 2 == 0), F.array((n / 2).cast("int"), F.lit(2))).otherwise(F.array(n)))
    return rows.select("snapshot", "key", shape.alias("shape"), "values")


def _migration_sql() -> str:
    def lead(pattern: str) -> str:
        return pattern.replace(".", "\\.").replace("*", "([^.]+)")
    # the deepest rule first, names before *
    order = sorted(MIGRATION, key=lambda r: (-len(r[0].split(".")), "*" in r[0]))
    found, names, layouts = [], [], []
    for source, target, layout in order:
        rx, n = lead(source), source.count("*")
        test = f"regexp_matches(key, '^{rx}(\\.|$)')"
        if target is None:
            name = "NULL"
        else:
            star = f"regexp_extract(key, '^{rx}', 1)" if n else "''"
            number = f"CAST(CAST({star} AS INTEGER) + 15 AS VARCHAR)" if "+15" in target else star
            head, _, tail = target.partition("{0+15}" if "+15" in target else "{0}") if n else (target, "", "")
            name = f"'{head}' || {number} || '{tail}' || regexp_replace(key, '^{rx}', '')" if n else f"'{head}' || regexp_replace(key, '^{rx}', '')"
        found.append(test)
        names.append(f"WHEN {test} THEN {name}")
        layouts.append(f"WHEN {test} THEN '{layout}'")
    return f"""SELECT *, CASE {' '.join(names)} ELSE key END AS new_key, CASE {' '.join(layouts)} ELSE 'keep' END AS layout
FROM (SELECT snapshot, key, n, pos, value, key LIKE '%fc2.weight' OR key LIKE '%fc14.weight' AS conv FROM
      (SELECT snapshot, key, CAST(value AS DOUBLE) AS value, count(*) OVER (PARTITION BY snapshot, key) AS n,
              row_number() OVER (PARTITION BY snapshot, key ORDER BY pos) - 1 AS pos FROM ({KEYS_SQL})))"""


@register("migrate_keys", f"""
WITH m AS ({_migration_sql()}),
p AS (SELECT snapshot, key, new_key, n, value,
        CASE WHEN layout = 'linear' AND NOT conv AND n % 2 = 0 THEN (pos % 2) * (n // 2) + pos // 2
             WHEN layout = 'conv' AND conv AND n % 4 = 0
             THEN (pos % 2) * 2 * (n // 4) + ((pos // 2) % 2) * (n // 4) + pos // 4
             ELSE pos END AS idx,
        CASE WHEN conv AND n % 4 = 0 THEN CASE WHEN layout = 'conv' THEN '1,2,2,' || n // 4 ELSE n // 4 || ',2,1,2' END
             WHEN NOT conv AND n % 2 = 0 THEN CASE WHEN layout = 'linear' THEN '2,' || n // 2 ELSE n // 2 || ',2' END
             ELSE CAST(n AS VARCHAR) END AS shape
      FROM m WHERE new_key IS NOT NULL),
c AS (SELECT snapshot, new_key, count(DISTINCT key) AS n_sources FROM p GROUP BY ALL)
SELECT p.snapshot, p.key, p.new_key, shape, CAST(idx AS INTEGER) AS idx, value, n_sources > 1 AS collides
FROM p JOIN c ON c.snapshot = p.snapshot AND c.new_key = p.new_key""")
def q_migrate_keys(spark, sf):
    """Names and layouts of every array changed in one pass; new names that
    several arrays took are marked."""
    from shardforge.operators.migrate import migrate, migration_collisions
    rules = spark.createDataFrame([{"source": s, "target": t, "layout": x} for s, t, x in MIGRATION], "source string, target string, layout string")
    m = migrate(array_table(spark, sf), rules)
    bad = migration_collisions(m, ["snapshot"]).select("snapshot", "new_key", F.lit(True).alias("bad"))
    m = m.join(bad, ["snapshot", "new_key"], "left")
    return m.select("snapshot", "key", "new_key", F.array_join(F.transform("shape", lambda x: x.cast("string")), ",").alias("shape"),
                    F.coalesce("bad", F.lit(False)).alias("collides"), F.posexplode_outer("values").alias("idx", "value"))


def _perturbed_keys_sql() -> str:
    inside = "key LIKE 'module.base_encoder.blocks.3.%'"
    return f"""SELECT key, pos, CASE WHEN {inside} AND pos % 7 = 0 THEN NULL WHEN {inside} AND pos % 5 = 0 THEN value + {S.d(1e-4)} ELSE value END AS value
FROM k WHERE NOT ({inside} AND pos % 11 = 0)"""


@register("tree_parity", f"""
WITH k AS (SELECT key, pos, CAST(value AS DOUBLE) AS value FROM ({KEYS_SQL})), b AS ({_perturbed_keys_sql()}),
j AS (SELECT coalesce(k.key, b.key) AS key, coalesce(k.pos, b.pos) AS pos, k.value AS va, b.value AS vb,
        k.key IS NOT NULL AND b.key IS NOT NULL AS common, b.key IS NULL AS a_only, k.key IS NULL AS b_only
      FROM k FULL OUTER JOIN b ON k.key = b.key AND k.pos = b.pos),
e AS (SELECT key, bool_and(common AND va IS NOT DISTINCT FROM vb) AS same FROM j GROUP BY key)
SELECT count(*) FILTER (common) AS n_common, count(*) FILTER (a_only) AS n_only_a, count(*) FILTER (b_only) AS n_only_b,
       round(max(abs(va - vb)) FILTER (common), 9) AS max_abs_diff,
       count(*) FILTER (common AND (abs(va - vb) >= {S.d(1.5e-6)} OR (va IS NULL) <> (vb IS NULL))) AS n_beyond,
       (arg_min(key || '@' || pos, {{'d': -abs(va - vb), 'k': key, 'p': pos}}) FILTER (common AND va IS NOT NULL AND vb IS NOT NULL)) AS worst_key,
       CAST(sum(CASE WHEN same THEN 1 ELSE 0 END) AS BIGINT) AS n_skipped
FROM j JOIN e USING (key)""")
def q_tree_parity(spark, sf):
    """The key table against a copy with lost, changed and missing values in
    one block: values of all other blocks are compared by digests only."""
    from shardforge.operators.hashtree import tree_parity
    a = key_table(spark, sf).select("key", "pos", F.col("value").cast("double").alias("value"))
    inside = F.col("key").startswith("module.base_encoder.blocks.3.")
    value = (F.when(inside & (F.col("pos") % 7 == 0), None).when(inside & (F.col("pos") % 5 == 0), F.col("value") + F.lit(1e-4)).otherwise(F.col("value")))
    b = a.where(~(inside & (F.col("pos") % 11 == 0))).withColumn("value", value)
    p = tree_parity(a, b, "key", "pos", "value")
    return p.withColumns({"max_abs_diff": F.round("max_abs_diff", 9),
                          "worst_key": F.concat("worst_key.path", F.lit("@"), F.col("worst_key.pos").cast("string"))})
