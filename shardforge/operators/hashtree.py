"""Comparison of two key tables by a tree of digests (E4 / E5).

Every value row (path, position, value) is hashed to 128 bits; the digest of a
path is the XOR over its rows, and that of every prefix of the path the XOR over
the paths below, each bound to its name. All of it is partial aggregation: values
are reduced where they are read, and what moves is one row per path. Two
subtrees with equal digests and counts hold the same rows.

``tree_parity`` gives what ``keytable.parity`` gives, but only the values of
paths that differ are joined; for the others their counts are enough. The paths
that differ are a small table as a rule, which Spark then sends to the scans, so
the values of equal subtrees move nowhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardforge import constants as K
from shardforge.operators.keytable import parity
from shardforge.session import reliable_checkpoint


def _digests(*cols: Column) -> list[Column]:
    return [F.bit_xor(F.xxhash64(F.lit(i), *cols)).alias(f"d{i}") for i in (1, 2)]


def path_digests(df: DataFrame, path_col: str, pos_col: str, value_col: str) -> DataFrame:
    """path, n (rows), n_null, d1, d2, least (smallest position with a value)."""
    path, pos, value = (F.col(f"`{c}`") for c in (path_col, pos_col, value_col))
    rows = df.select(path.alias("path"), pos.alias("pos"), value.alias("value"))
    return rows.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("value").isNull(), 1)).alias("n_null"),
                                    *_digests(F.col("pos"), F.col("value"), F.col("value").isNull()),
                                    F.min(F.when(F.col("value").isNotNull(), F.col("pos"))).alias("least"))


def tree_digests(paths: DataFrame, sep: str = ".") -> DataFrame:
    """node, depth, n_paths, n, d1, d2 for every prefix of a path; the root is
    the empty prefix."""
    segments = F.split("path", f"\\Q{sep}\\E")
    nodes = F.transform(F.sequence(F.lit(0), F.size(segments)), lambda k: F.struct(
        k.alias("depth"), F.array_join(F.slice(segments, 1, k), sep).alias("node")))
    return (paths.withColumn("s", F.explode(nodes)).groupBy(F.col("s.node").alias("node"), F.col("s.depth").alias("depth"))
            .agg(F.count(F.lit(1)).alias("n_paths"), F.sum("n").alias("n"), *_digests(F.col("path"), F.col("n"), F.col("d1"), F.col("d2"))))


def differing_subtrees(a: DataFrame, b: DataFrame, sep: str = ".") -> DataFrame:
    """Where two trees (``tree_digests``) part: node, depth, kind, n (rows of
    a, else of b). ``equal``: an equal subtree below a differing node, as large
    as possible; ``only_a`` / ``only_b``: a whole subtree of one side;
    ``differs``: nodes on the way."""
    cols = ["n_paths", "n", "d1", "d2"]
    both = (a.select("node", "depth", F.struct(*cols).alias("x")).join(b.select("node", "depth", F.struct(*cols).alias("y")), ["node", "depth"], "full_outer"))
    kind = (F.when(F.col("y").isNull(), "only_a").when(F.col("x").isNull(), "only_b")
            .when(F.col("x") == F.col("y"), "equal").otherwise("differs"))
    up = F.when(F.col("depth") > 1, F.array_join(F.slice(F.split("node", f"\\Q{sep}\\E"), F.lit(1), F.col("depth") - 1), sep)).otherwise("")
    nodes = reliable_checkpoint(both.select("node", "depth", kind.alias("kind"), F.coalesce("x.n", "y.n").alias("n"),
                                            up.alias("parent"), (F.col("depth") - 1).alias("above")))
    parents = nodes.select(F.col("node").alias("parent"), F.col("depth").alias("above"), F.col("kind").alias("parent_kind"))
    return (nodes.join(parents, ["parent", "above"], "left")
            .where("kind = 'differs' or parent_kind is null or parent_kind = 'differs'")
            .select("node", "depth", "kind", "n"))


def tree_parity(a: DataFrame, b: DataFrame, path_col: str, pos_col: str, value_col: str,
                decimals: int = K.PARITY_DECIMALS) -> DataFrame:
    """One row as of ``parity`` on (path, position), and n_skipped: the common
    rows that weren't compared by value as their paths are equal. Rows are
    unique by (path, position), and neither is null."""
    x, y = (reliable_checkpoint(path_digests(d, path_col, pos_col, value_col)) for d in (a, b))
    same = x.join(y, ["path", "n", "n_null", "d1", "d2"], "left_semi")
    differs = (x.join(same, "path", "left_anti").select("path")
               .unionByName(y.join(same, "path", "left_anti").select("path")).distinct())
    differs = reliable_checkpoint(differs)

    def some(d):
        rows = d.select(F.col(f"`{path_col}`").alias("path"), F.col(f"`{pos_col}`").alias("pos"), F.col(f"`{value_col}`").alias("value"))
        return rows.join(differs, "path", "left_semi")
    joined = parity(some(a), some(b), ["path", "pos"], "value", decimals)
    skipped = same.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_skipped"), F.coalesce(F.sum(F.col("n") - F.col("n_null")), F.lit(0)).alias("n_equal"),
                       F.min(F.when(F.col("least").isNotNull(), F.struct(F.col("path"), F.col("least").alias("pos")))).alias("first"))
    both = joined.unionByName(skipped, allowMissingColumns=True)      # two rows, made one
    both = both.agg(*[F.first(c, ignorenulls=True).alias(c) for c in both.columns])
    known = F.col("n_equal") > 0
    largest = F.when(known, F.greatest(F.coalesce("max_abs_diff", F.lit(0.0)), F.lit(0.0))).otherwise(F.col("max_abs_diff"))
    # equal rows have difference 0: they name the worst key only if nothing is larger
    worst = F.when(F.coalesce(F.col("max_abs_diff") > 0, F.lit(False)), F.col("worst_key")).when(
        F.col("worst_key").isNull() | (F.col("first") < F.col("worst_key")), F.coalesce("first", "worst_key")).otherwise(F.col("worst_key"))
    return both.select((F.col("n_common") + F.col("n_skipped")).alias("n_common"), "n_only_a", "n_only_b", largest.alias("max_abs_diff"),
                       "n_beyond", worst.alias("worst_key"), "n_skipped")
