"""Key-table migration and parity (E1-E5).

A key table holds one row per stored value: (snapshot, key, pos, value) or
any table keyed by a dotted name. Rewrites are ordered rule lists turned
into one chain of built-in string expressions (no UDF); checks are joins
and partial aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from shardforge import constants as K


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


# -- E1 ---------------------------------------------------------------------

def key_path(key, sep: str = ".") -> Column:
    """Dotted key -> ARRAY<STRING> path (literal separator)."""
    import re
    return F.split(_c(key), re.escape(sep))


def flatten_path(path, sep: str = ".") -> Column:
    return F.concat_ws(sep, _c(path))


def unflatten_keys(df: DataFrame, key_col: str = "key", sep: str = ".", max_levels: int = 0) -> DataFrame:
    """Add the path array, its depth, the leaf and parent names and, when
    ``max_levels`` is given, one column per level (NULL past the depth)."""
    path = key_path(key_col, sep)
    out = (df.withColumn("path", path)
           .withColumn("depth", F.size("path"))
           .withColumn("leaf", F.element_at("path", -1))
           .withColumn("parent", flatten_path(F.slice("path", 1, F.size("path") - 1), sep)))
    for i in range(max_levels):
        out = out.withColumn(f"level_{i}", F.col("path")[i])
    return out


def key_inventory(df: DataFrame, by: list[str], key_col: str = "key", sep: str = ".") -> DataFrame:
    """One row per (by..., key): depth, leaf, parent and the value count
    (the size of the stored tensor)."""
    per = df.groupBy(*by, key_col).agg(F.count(F.lit(1)).alias("n_values"))
    return unflatten_keys(per, key_col, sep).drop("path")


# -- E2 ---------------------------------------------------------------------

RULE_KINDS = ("keep_prefix", "strip_prefix", "strip_chars", "replace_if", "replace",
              "drop_contains", "drop_first_segment", "shift_segment")


def _rules_list(rules) -> list[dict]:
    if isinstance(rules, DataFrame):
        # a rule table is configuration (a handful of rows), read once
        rows = rules.orderBy("ord").collect()
        return [r.asDict() for r in rows]
    return list(rules)


def _let(value: Column, fn) -> Column:
    """Bind ``value`` once and use it several times in ``fn`` (a
    one-element ``transform``), so that chained steps do not repeat the
    whole previous expression when the optimizer inlines projections."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def _rule_step(key: Column, keep: Column, r: dict, sep: str) -> tuple[Column, Column]:
    import re
    kind = r["kind"]
    pat = r.get("pattern")
    rep = r.get("replacement")
    if kind == "keep_prefix":
        keep = keep & key.startswith(pat)
    elif kind == "strip_prefix":
        key = _let(key, lambda k: F.when(k.startswith(pat), F.substring(k, len(pat) + 1, 1 << 30)).otherwise(k))
    elif kind == "strip_chars":
        key = F.substring(key, int(r["amount"]) + 1, 1 << 30)
    elif kind == "replace_if":
        cond = r.get("cond") or pat
        key = _let(key, lambda k: F.when(k.contains(cond), F.replace(k, F.lit(pat), F.lit(rep))).otherwise(k))
    elif kind == "replace":
        key = F.replace(key, F.lit(pat), F.lit(rep))
    elif kind == "drop_contains":
        keep = keep & ~key.contains(pat)
    elif kind == "drop_first_segment":
        keep = keep & (F.split_part(key, F.lit(sep), F.lit(1)) != F.lit(pat))
    elif kind == "shift_segment":
        def shift(k):
            parts = F.split(k, re.escape(sep))
            shifted = F.concat_ws(sep, F.concat(
                F.array(F.lit(rep), (parts[1].cast("int") + F.lit(int(r["amount"]))).cast("string")),
                F.slice(parts, 3, F.size(parts) - 2)))
            return F.when(k.contains(pat), shifted).otherwise(k)
        key = _let(key, shift)
    else:
        raise ValueError(f"unknown rule kind {kind!r}")
    return key, keep


def rewrite_keys(df: DataFrame, rules, key_col: str = "key", out_col: str = "new_key",
                 sep: str = ".") -> DataFrame:
    """Kept rows with their rewritten key.

    Rules apply in order. kinds: keep_prefix(pattern) keeps keys starting
    with it; strip_prefix(pattern) removes it where present;
    strip_chars(amount) removes the first n characters; replace_if(cond,
    pattern, replacement) replaces all occurrences where the key contains
    cond; replace(pattern, replacement) everywhere; drop_contains(pattern);
    drop_first_segment(pattern) drops keys whose first segment equals it;
    shift_segment(pattern, replacement, amount): where the key contains
    pattern, segment 0 becomes replacement and segment 1 (an integer) is
    shifted by amount.

    Each rule is one projection step over the running key, so the
    expression stays linear in the number of rules (a single nested
    expression would repeat the key once per reference at every level)."""
    out = df.withColumn("_k", F.col(key_col)).withColumn("_keep", F.lit(True))
    for r in _rules_list(rules):
        k, keep = _rule_step(F.col("_k"), F.col("_keep"), r, sep)
        out = out.withColumn("_k", k).withColumn("_keep", keep)
    return out.filter("_keep").drop("_keep").withColumnRenamed("_k", out_col)


def key_collisions(rewritten: DataFrame, by: list[str], old_col: str = "key",
                   new_col: str = "new_key") -> DataFrame:
    """New keys that two or more distinct old keys map to."""
    return (rewritten.select(*by, old_col, new_col).dropDuplicates()
            .groupBy(*by, new_col).agg(F.count(F.lit(1)).alias("n_sources"),
                                       F.min(old_col).alias("first_source"),
                                       F.max(old_col).alias("last_source"))
            .filter(F.col("n_sources") > 1))


def assert_no_collisions(rewritten: DataFrame, by: list[str], old_col="key", new_col="new_key"):
    bad = key_collisions(rewritten, by, old_col, new_col).limit(5).collect()
    if bad:
        raise ValueError(f"key rewrite maps several keys to one: {[r.asDict() for r in bad]}")


# -- E3 ---------------------------------------------------------------------

def profile_keys(df: DataFrame, by: str, key_col: str = "key",
                 segment_counts: dict[str, tuple[str, int]] | None = None,
                 suffix_counts: dict[str, tuple[str, str]] | None = None,
                 presence: dict[str, str] | None = None,
                 sizes: dict[str, str] | None = None, sep: str = ".") -> DataFrame:
    """Per snapshot: distinct key count, distinct values of segment n under
    a prefix (layer counts), distinct keys with a prefix and suffix, key
    presence flags (architecture branches) and the value count of named
    keys (shape-derived widths).

    Two partial aggregations: (snapshot, key) sizes first, then per
    snapshot — so a snapshot holding most rows is still combined map-side."""
    per_key = df.groupBy(by, key_col).agg(F.count(F.lit(1)).alias("_n"))
    key = F.col(key_col)
    aggs = [F.count(F.lit(1)).alias("n_keys")]
    for name, (prefix, seg) in (segment_counts or {}).items():
        aggs.append(F.count_distinct(F.when(key.startswith(prefix),
                                            F.split_part(key, F.lit(sep), F.lit(seg + 1)))).alias(name))
    for name, (prefix, suffix) in (suffix_counts or {}).items():
        aggs.append(F.count(F.when(key.startswith(prefix) & key.endswith(suffix), F.lit(1))).alias(name))
    for name, sub in (presence or {}).items():
        aggs.append(F.max(key.contains(sub)).alias(name))
    for name, exact in (sizes or {}).items():
        aggs.append(F.max(F.when(key == F.lit(exact), F.col("_n"))).cast("bigint").alias(name))
    return per_key.groupBy(by).agg(*aggs)


# -- E4 ---------------------------------------------------------------------

def strict_match(expected: DataFrame, actual: DataFrame, keys: list[str], fail: bool = False) -> DataFrame:
    """Missing (expected, not present) and unexpected (present, not
    expected) keys, tagged — EXCEPT both ways as two anti joins."""
    e = expected.select(*keys).dropDuplicates()
    a = actual.select(*keys).dropDuplicates()
    missing = e.join(a, keys, "left_anti").withColumn("kind", F.lit("missing"))
    unexpected = a.join(e, keys, "left_anti").withColumn("kind", F.lit("unexpected"))
    out = missing.unionByName(unexpected)
    if fail:
        bad = out.limit(10).collect()
        if bad:
            raise ValueError(f"strict key match failed: {[r.asDict() for r in bad]}")
    return out


# -- E5 ---------------------------------------------------------------------

def parity(a: DataFrame, b: DataFrame, keys: list[str], value_col: str, decimals: int = K.PARITY_DECIMALS,
           b_value_col: str | None = None, shape_col: str | None = None) -> DataFrame:
    """One summary row: common / one-sided key counts, max absolute
    difference, how many differ by 1.5 * 10^-decimals or more (the
    almost-equal criterion; NULL against a number always does, NULL against
    NULL never), the worst key (largest difference, smallest key on ties) and, with ``shape_col``, how many common keys differ in shape.
    One full outer join on the key and one aggregation."""
    if len(keys) != 1:
        a = a.withColumn("_k", F.struct(*keys))
        b = b.withColumn("_k", F.struct(*keys))
        key = "_k"
    else:
        key = keys[0]
    bv = b_value_col or value_col
    extra_a = [F.col(shape_col).alias("_sa")] if shape_col else []
    extra_b = [F.col(shape_col).alias("_sb")] if shape_col else []
    j = (a.select(key, F.col(value_col).alias("_va"), F.lit(True).alias("_pa"), *extra_a)
         .join(b.select(key, F.col(bv).alias("_vb"), F.lit(True).alias("_pb"), *extra_b), key, "full_outer"))
    diff = F.abs(F.col("_va") - F.col("_vb"))
    thr = K.PARITY_FACTOR * 10 ** (-decimals)
    both = F.col("_pa").isNotNull() & F.col("_pb").isNotNull()
    # the least (-difference, key): works for keys of any orderable type
    worst = F.min(F.when(both & diff.isNotNull(), F.struct((-diff).alias("nd"), F.col(key).alias("k"))))
    aggs = [
        F.count(F.when(both, F.lit(1))).alias("n_common"),
        F.count(F.when(F.col("_pb").isNull(), F.lit(1))).alias("n_only_a"),
        F.count(F.when(F.col("_pa").isNull(), F.lit(1))).alias("n_only_b"),
        F.max(F.when(both, diff)).alias("max_abs_diff"),
        F.count(F.when(both & ((diff >= F.lit(thr)) | (F.col("_va").isNull() != F.col("_vb").isNull())), F.lit(1))).alias("n_beyond"),
        worst.alias("_worst"),
    ]
    if shape_col:
        aggs.append(F.count(F.when(both & ~F.col("_sa").eqNullSafe(F.col("_sb")), F.lit(1))).alias("n_shape_mismatch"))
    return j.agg(*aggs).withColumn("worst_key", F.col("_worst.k")).drop("_worst")
