"""All-pairs cosine similarity with top-k (D8), blocked on both sides.

Rows are sorted by (nearest pivot, id), so that consecutive rows point in
similar directions; up to ``block_rows`` of them with one pivot are a block,
stored once, as one row with its matrix (in the width that the column has) and,
for the rows scaled to length 1, the centroid and the radius around it. A tile
is a block of each side. For unit vectors a and b with centroids p and q and
radii r and s

    |a.b - p.q| <= r|q| + s|p| + rs

bounds everything in a tile from both sides. The highest lower bound of a block
over the other side's blocks of k rows or more is a value that each of its rows
reaches k times; a tile whose upper bound is below that can't change any result
and is skipped.

The other tiles are pairs of a Cartesian product of the two tables of blocks,
which reads the written blocks again for each part of the other side and
shuffles none. A task has the pairs of one part of a side with the whole other
side, and keeps the best k values of each of its rows as the tiles go by; tiles
below a block's least k-th value so far aren't computed. So what is written
grows with the input and k, and only the work with its square.

No block is collected or broadcast; what the driver sees is the pivots (a
fixed number) and one bound of each block (16 bytes for ``block_rows`` rows).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shardforge.session import batch_rows, estimated_bytes, reliable_checkpoint, ship_package

PIVOTS = 64
SLACK = 1e-9     # rounding of bounds and products
PART_BYTES = 32 << 20
META = ["n", "centroid", "radius", "norm"]
BLOCK = "block bigint, n bigint, ids binary, mat binary, centroid array<double>, radius double, norm double"
BEST = "row_id bigint, other_id bigint, logit double"


@dataclass
class TopK:
    """rows: direction, row_id, rank, other_id, logit; how many tiles there
    are and how many could matter by their bounds."""
    rows: DataFrame
    tiles: int
    computed: int


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm == 0.0, 1.0, norm)


def _pivots(df: DataFrame) -> np.ndarray:
    """A fixed number of rows, the same at any partitioning."""
    rows = df.orderBy(F.xxhash64("id"), "id").limit(PIVOTS).collect()
    return _unit(np.array([r["vec"] for r in rows], np.float64)) if rows else np.zeros((0, 0))


def _blocks(df: DataFrame, pivots: np.ndarray, block_rows: int, width: str) -> DataFrame:
    import pyarrow as pa
    from pyspark import TaskContext

    from shardforge.functions.arrowbatch import to_matrix

    def near(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = to_matrix(b.column("vec"), np.dtype(width))
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(np.argmax(_unit(x.astype(np.float64)) @ pivots.T, axis=1).astype(np.int32)),
                 pa.array([r.tobytes() for r in x], pa.binary())],
                ["id", "pivot", "vec"])

    def pack(batches):
        number, ids, vecs, of = TaskContext.get().partitionId() << 33, [], [], None

        def block():
            mat = np.frombuffer(b"".join(vecs), width).reshape(len(vecs), -1)
            x = _unit(mat.astype(np.float64))
            centre = x.mean(axis=0)
            return pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.array([len(ids)]), pa.array([np.array(ids, "<i8").tobytes()]), pa.array([mat.tobytes()]),
                 pa.array([centre.tolist()], pa.list_(pa.float64())), pa.array([float(np.linalg.norm(x - centre, axis=1).max())]),
                 pa.array([float(np.linalg.norm(centre))])], ["block", "n", "ids", "mat", "centroid", "radius", "norm"])
        for b in batches:
            for i, p, v in zip(*(b.column(c).to_pylist() for c in ("id", "pivot", "vec"))):
                if ids and (p != of or len(ids) == block_rows):
                    yield block()
                    number, ids, vecs = number + 1, [], []
                of = p
                ids.append(i)
                vecs.append(v)
        if ids:
            yield block()

    parts = max(df.sparkSession.sparkContext.defaultParallelism, estimated_bytes(df) // PART_BYTES)
    order = ["pivot", "id", "vec"]
    near_rows = df.mapInArrow(near, "id bigint, pivot int, vec binary").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return reliable_checkpoint(near_rows.mapInArrow(pack, BLOCK))


def _best(ids: np.ndarray, logits: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest values of each row, ties by the smaller
    id."""
    k = min(k, logits.shape[1])
    kth = -np.partition(-logits, k - 1, axis=1)[:, k - 1:k]
    return _first(*np.nonzero(logits >= kth), ids, logits, k)


def _first(rows, cols, ids: np.ndarray, logits: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids[cols], -logits[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[keep], cols[keep]


class _Running:
    """The best k values of each row of a block so far, best first."""

    def __init__(self, ids: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.value, self.other = np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
        self.least = -np.inf

    def add(self, ids: np.ndarray, logits: np.ndarray) -> None:
        kth, last = self.value[:, -1], self.other[:, -1]
        rows, cols = np.nonzero(logits >= kth[:, None])
        better = (logits[rows, cols] > kth[rows]) | (ids[cols] < last[rows])
        rows, cols = rows[better], cols[better]
        if not len(rows):
            return
        if len(rows) > 4 * self.value.size:
            rows, cols = _best(ids, logits, self.k)
        # the few rows that change, with what they have and what is new
        own, at = np.unique(rows, return_inverse=True)
        row = np.concatenate([np.repeat(np.arange(len(own)), self.k), at])
        value = np.concatenate([self.value[own].ravel(), logits[rows, cols]])
        other = np.concatenate([self.other[own].ravel(), ids[cols]])
        order = np.lexsort((other, -value, row))
        row = row[order]
        order = order[np.arange(len(row)) - np.searchsorted(row, row) < self.k]
        self.value[own], self.other[own] = value[order].reshape(-1, self.k), other[order].reshape(-1, self.k)
        self.least = self.value[:, -1].min()


def _bounds(scale: float) -> tuple:
    """Lower and upper bound of the tile of the blocks x and y, as columns."""
    dot = F.aggregate(F.zip_with("x_centroid", "y_centroid", lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    off = F.col("x_radius") * F.col("y_norm") + F.col("y_radius") * F.col("x_norm") + F.col("x_radius") * F.col("y_radius")
    return scale * (dot - off - F.lit(SLACK)), scale * (F.least(dot + off, F.lit(1.0)) + F.lit(SLACK))


def _side(blocks: DataFrame, name: str) -> DataFrame:
    return blocks.select(*[F.col(c).alias(f"{name}_{c}") for c in blocks.columns])


def _one_way(x: DataFrame, y: DataFrame, x_meta: DataFrame, y_meta: DataFrame, scale: float, k: int, block_bytes: int) -> tuple[DataFrame, int]:
    """row_id, rank, other_id, logit of the best k of y for each row of x, and
    the number of tiles that could matter."""
    import pyarrow as pa
    lower, upper = _bounds(scale)
    pairs = _side(x_meta, "x").join(_side(y_meta, "y").hint("shuffle_replicate_nl"))
    least = pairs.where(F.col("y_n") >= k).groupBy("x_block").agg(F.max(lower).alias("least"))
    least = reliable_checkpoint(_side(x_meta, "x").select("x_block").join(least, "x_block", "left").select(
        "x_block", F.coalesce("least", F.lit(float("-inf"))).alias("least")))
    matter = upper >= F.col("least")
    computed = (_side(x_meta, "x").join(F.broadcast(least), "x_block").join(_side(y_meta, "y").hint("shuffle_replicate_nl"), matter)).count()

    def run(batches):
        held, of, mat = {}, None, None
        for batch in batches:
            cols = [batch.column(c) for c in ("x_block", "x_ids", "x_mat", "x_n", "y_ids", "y_mat", "y_n", "upper", "width")]
            for i in range(batch.num_rows):
                xb, x_ids, x_mat, x_n, y_ids, y_mat, y_n, up, width = (c[i] for c in cols)
                block, width = xb.as_py(), width.as_py()
                if block not in held:
                    held[block] = _Running(np.frombuffer(x_ids.as_buffer(), "<i8").copy(), k)
                best = held[block]
                if up.as_py() < best.least - SLACK * scale:
                    continue
                if block != of:
                    of, mat = block, _unit(np.frombuffer(x_mat.as_buffer(), width).reshape(x_n.as_py(), -1).astype(np.float64))
                other = _unit(np.frombuffer(y_mat.as_buffer(), width).reshape(y_n.as_py(), -1).astype(np.float64))
                best.add(np.frombuffer(y_ids.as_buffer(), "<i8"), scale * (mat @ other.T))
        for best in held.values():
            rows, at = np.nonzero(best.value > -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(best.ids[rows]), pa.array(best.other[rows, at]), pa.array(best.value[rows, at])],
                                             ["row_id", "other_id", "logit"])

    parts = x.rdd.getNumPartitions()
    tiles = (_side(x, "x").join(F.broadcast(least), "x_block").join(_side(y, "y").hint("shuffle_replicate_nl"), matter)
             .select("x_block", "x_ids", "x_mat", "x_n", "y_ids", "y_mat", "y_n", upper.alias("upper"), F.col("x_width").alias("width")))
    # the parts of a Cartesian product lie one row of parts behind the other:
    # each task gets one part of x and all of y
    with batch_rows(x.sparkSession, 2 * block_bytes):
        found = reliable_checkpoint(tiles.coalesce(parts).mapInArrow(run, BEST))
    w = Window.partitionBy("row_id").orderBy(F.col("logit").desc(), "other_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k), computed


def cosine_tiles(a: DataFrame, b: DataFrame, a_id: str, b_id: str, vec_col: str, logit_scale: float, k: int,
                 block_rows: int = 2048) -> TopK:
    """``cosine_topk`` with the number of tiles."""
    spark = a.sparkSession
    ship_package(spark)
    scale = math.exp(logit_scale)
    same = a is b and a_id == b_id
    floats = all(d.schema[vec_col].dataType.simpleString() == "array<float>" for d in (a, b))
    kind, width = ("array<float>", "<f4") if floats else ("array<double>", "<f8")
    sides = [d.select(F.col(i).cast("bigint").alias("id"), F.col(vec_col).cast(kind).alias("vec")).where("id is not null and vec is not null")
             for d, i in ((a, a_id), (b, b_id))]
    pivots = _pivots(sides[1])
    empty = spark.createDataFrame([], "direction string, row_id bigint, rank int, other_id bigint, logit double")
    if not len(pivots):
        return TopK(empty, 0, 0)
    left = _blocks(sides[0], pivots, block_rows, width)
    right = left if same else _blocks(sides[1], pivots, block_rows, width)
    metas = [reliable_checkpoint(d.select("block", *META).coalesce(spark.sparkContext.defaultParallelism)) for d in ([left] if same else [left, right])]
    n_left, n_right = metas[0].count(), metas[-1].count()
    if not n_left:
        return TopK(empty, 0, 0)
    block_bytes = block_rows * (pivots.shape[1] * int(width[-1]) + 8)
    left, right = (d.withColumn("width", F.lit(width)) for d in (left, right))
    rows, computed = _one_way(left, right, metas[0], metas[-1], scale, k, block_bytes)
    if same:
        rows = rows.withColumn("direction", F.explode(F.array(F.lit("a2b"), F.lit("b2a"))))
    else:
        back, more = _one_way(right, left, metas[-1], metas[0], scale, k, block_bytes)
        rows = rows.withColumn("direction", F.lit("a2b")).unionByName(back.withColumn("direction", F.lit("b2a")))
        computed = max(computed, more)
    return TopK(rows.select("direction", "row_id", "rank", "other_id", "logit"), n_left * n_right, computed)


def cosine_topk(a: DataFrame, b: DataFrame, a_id: str, b_id: str, vec_col: str, logit_scale: float, k: int,
                block_rows: int = 2048) -> DataFrame:
    """Scaled cosine similarity exp(logit_scale) * a.b / (|a||b|) between
    every row of ``a`` and every row of ``b``, reduced to the top ``k`` per
    row in both directions: rows (direction, row_id, rank, other_id, logit),
    direction "a2b" or "b2a"; ties by the smaller other id. A zero vector has
    cosine 0 with every other; rows without id or vector are left out. Exact
    for every ``block_rows``."""
    return cosine_tiles(a, b, a_id, b_id, vec_col, logit_scale, k, block_rows).rows
