"""Merkle manifest of a dataset: checkpoint levels and recompute the rest.

Every row is a leaf, the SHA-256 of its fields, each written with its length.
Per part (a language) the leaves, in id order, form a tree: runs of eight
consecutive nodes become the hash of their hex digests (the last run may have
fewer, even one) until one node remains, the subroot. The subroots, ordered by
part, form a tree of the same kind over all parts; its top is the root.

Only the leaves and every fourth level (``every``) are stored. A stored node
stands for an aligned subtree of up to 8 ** every stored descendants, and such
subtrees are the unit of work in both directions:

* up: a task hashes the descendants of one subtree to its top, which is stored;
  the levels between are dropped;
* down: a proof holds the siblings on the way to the root. From the top level
  on, a task gets the stored descendants of one subtree and the path above its
  top, hashes the missing levels again, emits each descendant's path, and
  drops them. The paths of one stored level are the input of the one below.

A subtree never holds more than 8 ** every rows, so a part with a third of all
rows is many subtrees. Positions inside a part come from one range partition of
digests and ids (texts move through no shuffle). Both trees use the same code,
so many parts are no special case.

``verify`` folds a leaf with its proof alone (and its place in the runs) to a
root; a leaf of a changed row gives another root.

Defined results: a null field is ``-``; null parts are one part, the first;
null ids come first in their part; rows with equal ids are ordered by their
leaves, rows that are equal in all fields have equal leaves and each a place of
its own; an empty table gives an empty result. Columns that aren't fields are
ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardforge.llm.common import prepared, written
from shardforge.operators.positions import global_positions

ARITY = 8
EVERY = 4
PARTS_A_TASK = 1 << 18
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

NODE = "part string, n bigint, pos bigint, digest binary"
ABOVE = "root string, subroot string, part_pos bigint, n_parts bigint"
PATH = f"part string, n bigint, pos bigint, name string, digest binary, path string, {ABOVE}"
PROOF = f"row bigint, candidate binary, folded string, {PATH}"


# --- hashing -----------------------------------------------------------------


def encoded(c: Column) -> Column:
    """``-`` for null, else byte length, colon, value."""
    s = c.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf_digest(fields: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[encoded(c) for c in fields]).cast("binary"), 256))


def node_hash(children: str) -> str:
    return sha256(children.encode("ascii")).hexdigest()


def height(n: int) -> int:
    """Levels above ``n`` leaves."""
    h = 0
    while n > 1:
        n = -(-n // ARITY)
        h += 1
    return h


def places(n: int, pos: int) -> list[tuple[int, int]]:
    """Of leaf ``pos`` of ``n``: at each level its place in its run and the
    number of siblings there."""
    out = []
    while n > 1:
        at = pos % ARITY
        out.append((at, min(ARITY, n - (pos - at)) - 1))
        n, pos = -(-n // ARITY), pos // ARITY
    return out


def fold(leaf: str, path: str, steps: list[tuple[int, int]]) -> str:
    """The root that a leaf and the siblings on its way give."""
    here, a = leaf, 0
    for at, siblings in steps:
        b = a + 64 * siblings
        cut = a + 64 * at
        here = node_hash(path[a:cut] + here + path[cut:b])
        a = b
    return here


def _up(nodes: list[str]) -> list[str]:
    return [node_hash("".join(nodes[i:i + ARITY])) for i in range(0, len(nodes), ARITY)]


def subtree(nodes: list[str], levels: int) -> list[list[str]]:
    """The given nodes and the levels above them, up to the top one."""
    out = [nodes]
    for _ in range(levels):
        out.append(_up(out[-1]))
    return out


def paths_below(levels: list[list[str]], above: str) -> list[str]:
    """For each node of the lowest level the siblings on its way, level by
    level, followed by ``above``, the path of the subtree's top."""
    paths = [above]
    for nodes in reversed(levels[:-1]):
        nxt = []
        for i, _ in enumerate(nodes):
            a = i - i % ARITY
            nxt.append("".join(nodes[a:i]) + "".join(nodes[i + 1:a + ARITY]) + paths[i // ARITY])
        paths = nxt
    return paths


# --- tasks -------------------------------------------------------------------


def _sorted_nodes(t: pa.Table) -> tuple[pa.Table, list[str]]:
    t = t.take(pa.array(np.argsort(t["pos"].to_numpy(), kind="stable")))
    return t, [d.hex() for d in t["digest"].to_pylist()]


def _rises(n: int, level: int, every: int) -> int:
    return min(every, height(n) - level)


def raiser(level: int, every: int):
    """Task: the top of one aligned subtree."""
    def run(t: pa.Table) -> pa.Table:
        t, nodes = _sorted_nodes(t)
        n = t["n"][0].as_py()
        top = subtree(nodes, _rises(n, level, every))[-1]
        assert len(top) == 1
        return pa.table({"part": [t["part"][0].as_py()], "n": [n], "pos": [t["pos"][0].as_py() // ARITY ** every],
                         "digest": pa.array([bytes.fromhex(top[0])], pa.binary())})
    return run


def descender(level: int, every: int, verify: bool):
    """Task: the paths of one subtree's descendants; at the lowest level of
    the rows' trees also the root that each candidate leaf folds to."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or right.num_rows != 1:
            raise ValueError("a subtree without its path, or a path without its subtree")
        left, nodes = _sorted_nodes(left)
        n, above = left["n"][0].as_py(), right.to_pylist()[0]
        levels = subtree(nodes, _rises(n, level, every))
        out = {c: left[c] for c in ("part", "n", "pos", "name", "digest")}
        out["path"] = paths = paths_below(levels, above["path"])
        for c, ty in (("root", pa.string()), ("subroot", pa.string()), ("part_pos", pa.int64()), ("n_parts", pa.int64())):
            out[c] = pa.array([above[c]] * len(nodes), ty)
        if verify:
            top = places(above["n_parts"], above["part_pos"])
            folded = [fold(c.hex(), p, places(n, pos) + top)
                      for c, p, pos in zip(left["candidate"].to_pylist(), paths, left["pos"].to_pylist())]
            out = {"row": left["row"], "candidate": left["candidate"], "folded": folded, **out}
        return pa.table(out)
    return run


# --- trees -------------------------------------------------------------------


@dataclass
class Tree:
    """Trees of one kind, one per part: the stored levels, lowest first."""
    levels: list[tuple[int, DataFrame]]
    every: int

    def tops(self) -> DataFrame:
        """part, n, digest: the top of each part's tree."""
        out = None
        for level, nodes in self.levels:
            here = nodes.where((F.col("n") <= ARITY ** level) & (F.col("n") > (ARITY ** (level - self.every) if level else 0)))
            here = here.select("part", "n", "digest")
            out = here if out is None else out.unionByName(here)
        return out


def raise_tree(leaves: DataFrame, every: int = EVERY) -> Tree:
    """``leaves``: part, n (leaves of the part), pos, digest and any others."""
    levels, level = [(0, leaves)], 0
    most = leaves.agg(F.max("n")).first()[0] or 0
    while ARITY ** level < most:
        below = levels[-1][1].where(F.col("n") > ARITY ** level).select("part", "n", "pos", "digest")
        chunk = F.expr(f"pos div {ARITY ** every}")
        up = below.groupBy("part", chunk.alias("chunk")).applyInArrow(raiser(level, every), NODE)
        level += every
        levels.append((level, written(up)))
    return Tree(levels, every)


def descend_tree(tree: Tree, tops: DataFrame, verify: bool = False) -> DataFrame:
    """Paths of all leaves. ``tops``: part, n, path and the ABOVE columns."""
    every, span = tree.every, ARITY ** tree.every
    above_cols = ["path"] + [c.split()[0] for c in ABOVE.split(", ")]
    paths = None
    for level, nodes in reversed(tree.levels):
        if level:
            nodes = nodes.where(F.col("n") > ARITY ** level).withColumn("name", F.lit(None).cast("string"))
        # subtrees whose top is the top of their part start from its path
        start = tops.where((F.col("n") <= ARITY ** (level + every)) & (F.col("n") > (ARITY ** level if level else 0)))
        above = start.select("part", F.lit(0).cast("bigint").alias("chunk"), *above_cols)
        if paths is not None:
            above = above.unionByName(paths.select("part", F.col("pos").alias("chunk"), *above_cols))
        last = verify and level == 0
        keyed = nodes.groupBy("part", F.expr(f"pos div {span}").alias("chunk"))
        # both sides may come from one table: other key names tell them apart
        above = above.select(F.col("part").alias("top_part"), F.col("chunk").alias("top_chunk"), *above_cols)
        paths = keyed.cogroup(above.groupBy("top_part", "top_chunk")).applyInArrow(
            descender(level, every, last), PROOF if last else PATH)
        if level:
            paths = written(paths)
    return paths


def part_key(c: Column) -> Column:
    """Parts as text that sorts null first, then by bytes."""
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), c.cast("string")))


@dataclass
class Manifest:
    """The stored levels of both trees."""
    rows: Tree
    parts: Tree


def build_manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, part_col: str = "lang", id_col: str = "doc_id",
                   candidate: Column | None = None, every: int = EVERY) -> Manifest:
    """Both trees over ``docs``. ``candidate`` is the digest to verify later
    (default: the leaf itself)."""
    prepared(docs.sparkSession)
    leaf = leaf_digest([F.col(f"`{c}`") for c in fields])
    # written once: the range partition reads its input twice
    leaves = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("row"), part_key(F.col(f"`{part_col}`")).alias("part"),
                         leaf.alias("digest"), candidate.alias("candidate") if candidate is not None else F.lit(None).cast("binary").alias("candidate"))
    leaves = written(leaves.withColumns({"candidate": F.coalesce("candidate", "digest"), "loc": F.monotonically_increasing_id()}))
    placed = global_positions(leaves, ["part", "row", "digest", "loc"], "at")
    # joined by part and slice of the positions, so that a hot part's rows are
    # not dealt to one task
    span = ARITY ** EVERY
    sizes = placed.groupBy("part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).withColumn(
        "slice", F.explode(F.sequence(F.expr(f"first div {span}"), F.expr(f"(first + n - 1) div {span}"))))
    nodes = placed.withColumn("slice", F.expr(f"at div {span}")).join(sizes, ["part", "slice"]).select(
        "part", "n", (F.col("at") - F.col("first")).alias("pos"), F.lit(None).cast("string").alias("name"), "digest", "row", "candidate")
    rows = raise_tree(nodes, every)
    tops = written(rows.tops())
    n_parts = tops.count()
    subroots = global_positions(tops, ["part"], "pos", num_partitions=1 + n_parts // PARTS_A_TASK)
    named = subroots.select(F.lit("").alias("part"), F.lit(n_parts).cast("bigint").alias("n"), "pos",
                            F.col("part").alias("name"), "digest")
    return Manifest(rows, raise_tree(named, every))


def proofs(manifest: Manifest) -> DataFrame:
    """One row per leaf: row (its id), leaf, part (as part_key writes it), pos,
    n, subroot, root, proof (hex digests of the siblings, from the leaf's run
    to the root's, left to right), candidate, folded (the root that candidate
    and proof give)."""
    none = F.lit(None)
    top = manifest.parts.tops().select(
        "part", "n", F.lit("").alias("path"), F.lower(F.hex("digest")).alias("root"), none.cast("string").alias("subroot"),
        none.cast("bigint").alias("part_pos"), none.cast("bigint").alias("n_parts"))
    parts = descend_tree(manifest.parts, top).select(
        F.col("name").alias("part"), "path", "root", F.lower(F.hex("digest")).alias("subroot"),
        F.col("pos").alias("part_pos"), F.col("n").alias("n_parts"))
    sizes = manifest.rows.tops().select("part", "n")
    below = descend_tree(manifest.rows, written(parts.join(sizes, "part")), verify=True)
    return below.select("row", F.lower(F.hex("digest")).alias("leaf"), "part", "pos", "n", "subroot", "root",
                        F.col("path").alias("proof"), F.lower(F.hex("candidate")).alias("candidate"), "folded")


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def tampered_leaf(fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The leaf of the row with A-Z of its text lower-cased where 3 divides
    crc32 of the id, null for the other rows."""
    cols = [F.translate(F.col(c), UPPER, LOWER) if c == text_col else F.col(f"`{c}`") for c in fields]
    return F.when(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 0, leaf_digest(cols))
