"""N-gram Jaccard join with count-vector R-trees.

Two documents link when 100 * |A and B| >= percent * |A or B| for their sets
of distinct word shingles; the result is each document's component.

The set of a document, dealt into G groups by a hash of the shingle, gives a
point of G group counts. The summed coordinate minima of two points bound the
overlap from above. An R-tree over such points alone can't be dealt to many
tasks: at 85 % a pair may differ in 16 % of its shingles, more than the spread
of any few coordinates, so every subtree meets every other of its size. The
trees are therefore grown inside cells that an exact argument provides:

* Cells. Documents whose sizes allow a link share a size class with a largest
  number E of differing shingles. Deal the shingles into B > E groups: the
  differing ones touch E groups at most, so if a document has more than E
  groups that aren't empty, one of them is untouched and equal in the other
  document. Hence each document is listed under (class, group number, hash of
  the group's content), and a document with too few groups also under another
  dealing, until it has enough. Every linked pair shares a cell; cells with one
  set are dropped; cells with equal members count once.
* Stars. One member of each cell (by hash order) is compared with the others,
  by counts first and then by full sets; links found so far are contracted to components.
* Trees. Cells whose members still lie in several components are searched with
  an R-tree of count vectors each, from the root down: pairs of boxes that can't
  reach the overlap, or below which everything is connected, are left out, and
  so are point pairs. What survives joins points into groups of candidates; a
  task puts out fewer edges than it has points.
* Verification. Each group gets its full sets once and a tree of its own, whose
  surviving pairs are verified at once, inside the task; only links that join
  two components leave it. Cells and groups of many members, or many bytes, are
  cut into tiles; first each tile is searched by itself, and when its edges are
  contracted, the tiles that are still open meet pairwise in different tasks.

Equal sets are one node from the start, so groups of copies cost one row per
map batch. Sets are read again, for the nodes in shared cells only. Shingles
are told apart by 64-bit hashes, sets by a 64-bit hash of their shingles.

Defined results: null or empty text, and text without words, has an empty set
and is its own component; with fewer words than a shingle the whole sequence is
the one shingle; repeated rows are copies of each other; the component of
documents whose ids are all null has a null id; an empty table gives an empty
result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardforge.llm.common import prepared, stored, text_or_empty, written
from shardforge.llm.components import connected_components
from shardforge.llm.textarrays import U, chain, mix, salt, slices, string_array, word_hashes

GROUPS, LEAF, FAN, TILE, TILE_BYTES = 512, 32, 8, 1024, 16 << 20
FULL = 255   # a count of 255 stands for any larger one
GOLD = U(0x9E3779B97F4A7C15)


def shingle_sets(arr: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    h, woff = word_hashes(arr)
    whole = chain(h, width)
    out = []
    for lo, hi in zip(woff[:-1], woff[1:]):
        if hi - lo >= width:
            out.append(np.unique(whole[lo:hi - width + 1]))
        elif hi > lo:
            out.append(chain(h[lo:hi], int(hi - lo)) + U(hi - lo))
        else:
            out.append(np.zeros(0, U))
    return out


def set_id(s: np.ndarray) -> np.int64:
    with np.errstate(over="ignore"):
        return np.int64(mix(np.array([mix(s + GOLD).sum(dtype=U) + U(len(s))]))[0].astype(np.int64)) if len(s) else np.int64(0)


class Classes:
    """Size classes: class j holds sizes from bounds[j] up to the next bound.
    A document is listed in its own class and, if it can link to a larger one
    there, in the next."""

    def __init__(self, percent: int, largest: int):
        if not 75 <= percent <= 100:
            raise ValueError(f"percent must lie between 75 and 100, not {percent}")
        self.percent, b = percent, [1]
        grow = 8 if percent >= 85 else 7
        while b[-1] <= 2 * largest + 1:
            b.append(max(b[-1] + 1, -(-b[-1] * grow // 5)))
        self.bounds = np.array(b)
        top = self.bounds[1:] - 1
        # symmetric difference of a linked pair no larger than top
        self.differ = 2 * (100 - percent) * top // (100 + percent)
        self.groups = np.array([self._enough(int(e), -(-percent * int(lo) // 100)) for e, lo in zip(self.differ, self.bounds)])

    @staticmethod
    def _enough(differ: int, least: int) -> int:
        """Groups so that a set of the least size nearly always fills more
        than ``differ`` of them."""
        b = differ + 2
        while True:
            empty = b * (1.0 - 1.0 / b) ** least
            if b - empty - 2.0 * empty ** 0.5 >= differ + 1 or b > 4 * least + 8:
                return b
            b += 1 + b // 64

    def of(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, n, "right") - 1

    def reaches_next(self, n: np.ndarray) -> np.ndarray:
        return 100 * n // self.percent >= self.bounds[self.of(n) + 1]


def cell_rows(sets: list[np.ndarray], ids: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(cell, set id) rows of the given sets (none of them empty)."""
    n = np.array([len(s) for s in sets])
    cls = Classes(percent, int(n.max()))
    own = cls.of(n)
    doc = np.concatenate([np.arange(len(n)), np.flatnonzero(cls.reaches_next(n))])
    j = np.concatenate([own, own[cls.reaches_next(n)] + 1])
    some = cls.differ[j] > 0    # else only equal sets can link
    doc, j = doc[some], j[some]
    cells, nodes, seed = [], [], 0
    while len(doc):
        b, size = cls.groups[j], n[doc]
        base = np.cumsum(b) - b
        h = np.concatenate([sets[d] for d in doc])
        g = (mix(h + salt(seed + 1)) >> U(9)) % np.repeat(b, size).astype(U)
        flat = g.astype(np.int64) + np.repeat(base, size)
        total = int(b.sum())
        content = np.zeros(total, U)
        np.add.at(content, flat, mix(h ^ GOLD))
        full = np.bincount(flat, minlength=total) > 0
        group = np.arange(total) - np.repeat(base, b)
        tag = mix((group.astype(U) << U(16)) + np.repeat(j, b).astype(U) + (U(seed) << U(56)))
        cells.append(mix(content ^ tag)[full])
        nodes.append(np.repeat(ids[doc], b)[full])
        again = np.add.reduceat(full.astype(np.int64), base) <= cls.differ[j]
        doc, j, seed = doc[again], j[again], seed + 1
    if not cells:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(cells).view(np.int64), np.concatenate(nodes)


# --- tasks -----------------------------------------------------------------

def _measure(width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sid = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for lo, part in slices(string_array(batch.column(1))):
                for i, s in enumerate(shingle_sets(part, width)):
                    n[lo + i], sid[lo + i] = len(s), set_id(s)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(sid), batch.column(2)], names=["doc_id", "n", "sid", "th"])
    return run


def _cells(width: int, percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done: set[int] = set()
            for _, part in slices(string_array(batch.column(0))):
                fresh, ids = [], []
                for s in shingle_sets(part, width):
                    sid = int(set_id(s))
                    if len(s) and sid not in done:
                        done.add(sid)
                        fresh.append(s)
                        ids.append(sid)
                if fresh:
                    cell, node = cell_rows(fresh, np.array(ids), percent)
                    yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(node)], names=["cell", "sid"])
    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (cell, sid): distinct rows of cells with two sets
    or more. Only the last row is carried on, with whether it is out already."""
    cell, sid, out = np.zeros(0, np.int64), np.zeros(0, np.int64), False
    for batch in batches:
        if not batch.num_rows:
            continue
        c = np.concatenate([cell, batch.column(0).to_numpy()])
        s = np.concatenate([sid, batch.column(1).to_numpy()])
        new = np.concatenate([[True], (c[1:] != c[:-1]) | (s[1:] != s[:-1])])
        c, s = c[new], s[new]
        same = c[1:] == c[:-1]
        member = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        emit = member.copy()
        if out:
            emit[0] = False
        out = bool(member[-1]) or (out and len(c) == 1)
        cell, sid = c[-1:], s[-1:]
        yield pa.RecordBatch.from_arrays([pa.array(c[emit]), pa.array(s[emit])], names=["cell", "sid"])


def _sets(width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            want = batch.column(0).to_numpy()
            for lo, part in slices(string_array(batch.column(1))):
                rows = [(set_id(s), s) for s in shingle_sets(part, width)]
                rows = [(i, s) for k, (i, s) in enumerate(rows) if i == want[lo + k]]
                vec = [np.minimum(np.bincount((mix(s ^ U(77)) % U(GROUPS)).astype(np.int64), minlength=GROUPS), FULL).astype(np.uint8).tobytes()
                       for _, s in rows]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(i) for i, _ in rows], pa.int64()), pa.array([len(s) for _, s in rows], pa.int64()),
                     pa.array([s.tobytes() for _, s in rows], pa.binary()), pa.array(vec, pa.binary())], names=["sid", "n", "tokens", "vec"])
    return run


def _verify(percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("ta"), batch.column("tb")):
                p, q = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                both = overlap(p, q)
                ok.append(100 * both >= percent * (len(p) + len(q) - both))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])
    return run


def overlap_bound(x: np.ndarray, y: np.ndarray, size) -> np.ndarray:
    """Summed coordinate minima; no more than ``size`` shingles where both
    counts are too large to be stored."""
    low = np.minimum(x, y)
    out = low.sum(axis=-1, dtype=np.int64)
    full = low == FULL
    return out + size * full.any(axis=-1) if full.any() else out


def _within(percent: int) -> Callable:
    """Pairs whose summed coordinate minima allow a link."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, GROUPS) for c in ("va", "vb"))
            keep = pa.array((100 + percent) * overlap_bound(x, y, np.minimum(na, nb)) >= percent * (na + nb))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])
    return run


class CountTree:
    """R-tree over count vectors: leaves of up to LEAF points, sorted by size
    and then by counts, and levels of FAN boxes each above them, up to one
    root. A box keeps the largest count of each coordinate and the least and
    largest set size below it."""

    def __init__(self, n: np.ndarray, vec: np.ndarray):
        slab = max(1, int(np.sqrt(len(n) / LEAF)))
        by_size = np.lexsort((vec[:, 0], n))
        rank = np.empty(len(n), np.int64)
        rank[by_size] = np.arange(len(n)) * slab // len(n)
        self.n, self.vec = n, vec
        self.order = np.lexsort((vec[:, 1], vec[:, 0], rank))
        cuts = np.append(np.arange(0, len(n), LEAF), len(n))
        leaves = [self.order[i:j] for i, j in zip(cuts, cuts[1:])]
        self.levels = [(np.array([vec[x].max(axis=0) for x in leaves]), np.array([n[x].min() for x in leaves]),
                        np.array([n[x].max() for x in leaves]), cuts)]
        while len(self.levels[-1][0]) > 1:
            top, least, most, cuts = self.levels[-1]
            at = np.arange(0, len(top), FAN)
            self.levels.append((np.maximum.reduceat(top, at, axis=0), np.minimum.reduceat(least, at), np.maximum.reduceat(most, at),
                                np.append(cuts[:-1][at], len(n))))

    def members(self, level: int, i: int) -> np.ndarray:
        cuts = self.levels[level][3]
        return self.order[cuts[i]:cuts[i + 1]]

    def leaf_pairs(self, percent: int, apart: Callable[[np.ndarray, np.ndarray], bool]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of leaves that may hold a link, from the root down. A pair of
        boxes is left out when their bound can't reach the overlap, or when
        ``apart`` says that nothing is left to link between them. A box with
        itself comes first, so that neighbours are linked early."""
        stack = [(len(self.levels) - 1, 0, 0)]
        while stack:
            level, i, j = stack.pop()
            if not apart(self.members(level, i), self.members(level, j)):
                continue
            if not level:
                yield self.members(0, i), self.members(0, j)
                continue
            top, least, most, _ = self.levels[level - 1]
            below = [np.arange(k * FAN, min((k + 1) * FAN, len(top))) for k in (i, j)]
            for x in below[0][::-1]:
                ys = below[1] if i != j else below[1][below[1] >= x]
                reach = overlap_bound(top[ys], top[x], np.maximum(most[ys], most[x]))
                may = ((100 + percent) * reach >= percent * (least[ys] + least[x])) & \
                      (100 * most[ys] >= percent * least[x]) & (100 * most[x] >= percent * least[ys])
                near = ys[may]
                stack += [(level - 1, int(x), int(y)) for y in near[near != x][::-1]]
                if x in near:
                    stack.append((level - 1, int(x), int(x)))


def overlap(p: np.ndarray, q: np.ndarray) -> int:
    if len(p) > len(q):
        p, q = q, p
    at = np.searchsorted(q, p)
    return int((q[np.minimum(at, len(q) - 1)] == p).sum())


def _apart(root: np.ndarray, side: np.ndarray) -> Callable[[np.ndarray, np.ndarray], bool]:
    """Whether two boxes can hold a pair of different components (and sides)."""
    across = bool(side.any())

    def may(a: np.ndarray, b: np.ndarray) -> bool:
        if across and (side[a] == side[a[0]]).all() and (side[b] == side[a[0]]).all():
            return False
        first = root[a[0]]
        return bool((root[a] != first).any() or (root[b] != first).any())
    return may


def _leaf_bounds(n, vec, root, side, a, b, percent: int) -> np.ndarray:
    """Point pairs of two leaves whose summed coordinate minima allow a link
    between components (and sides, if there are two)."""
    bound = overlap_bound(vec[a][:, None, :], vec[b][None, :, :], np.minimum(n[a][:, None], n[b][None, :]))
    ok = (100 + percent) * bound >= percent * (n[a][:, None] + n[b][None, :])
    ok &= root[a][:, None] != root[b][None, :]
    if side.any():   # two tiles: only pairs across
        ok &= side[a][:, None] != side[b][None, :]
    return np.triu(ok, 1) if a[0] == b[0] else ok


def tile_forest(n: np.ndarray, vec: np.ndarray, comp: np.ndarray, group: np.ndarray, side: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """Edges that join the points of a cell (or of two tiles of it) into groups
    of candidates: pairs of different components that the bounds allow, as far
    as their groups differ; at most one edge less than points."""
    root = np.unique(group, return_inverse=True)[1]
    by_comp, by_root = _apart(comp, side), _apart(root, side)
    for a, b in CountTree(n, vec).leaf_pairs(percent, lambda a, b: by_root(a, b) and by_comp(a, b)):
        ok = _leaf_bounds(n, vec, comp, side, a, b, percent) & (root[a][:, None] != root[b][None, :])
        for x, y in zip(*np.nonzero(ok)):
            i, j = int(a[x]), int(b[y])
            if root[i] != root[j]:
                root[root == root[j]] = root[i]
                yield i, j


def tile_links(n: np.ndarray, vec: np.ndarray, comp: np.ndarray, side: np.ndarray, sets: Callable[[int], np.ndarray],
               percent: int) -> Iterator[tuple[int, int]]:
    """Links of one cell (or of two tiles of it) that join two components:
    pairs come from the tree, their summed coordinate minima must allow a link,
    and the full sets decide. What is connected already isn't compared, so at
    most one link less than members comes out."""
    root = np.unique(comp, return_inverse=True)[1]
    for a, b in CountTree(n, vec).leaf_pairs(percent, _apart(root, side)):
        for x, y in zip(*np.nonzero(_leaf_bounds(n, vec, root, side, a, b, percent))):
            i, j = int(a[x]), int(b[y])
            if root[i] == root[j]:
                continue
            both = overlap(sets(i), sets(j))
            if 100 * both >= percent * (int(n[i]) + int(n[j]) - both):
                root[root == root[j]] = root[i]
                yield i, j


def _tiles(work: Callable) -> Callable:
    """A task over rows sorted by (cell, lo, hi): ``work(table, first, end,
    columns)`` for the runs of whole tiles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def whole(t: pa.Table) -> Iterator[pa.RecordBatch]:
            key = np.stack([t[c].to_numpy() for c in ("cell", "lo", "hi")])
            first = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0)]))
            cols = [t[c].to_numpy() for c in ("n", "comp", "side")]
            vec = np.frombuffer(b"".join(t["vec"].to_pylist()), np.uint8).reshape(-1, GROUPS)
            yield from work(t, zip(first.tolist(), np.append(first[1:], t.num_rows).tolist()), cols[0], vec, cols[1], cols[2])

        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([rest, t]) if rest is not None else t
            if not t.num_rows:
                continue
            key = np.stack([t[c].to_numpy() for c in ("cell", "lo", "hi")])
            ends = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0))
            if not len(ends):
                rest = t
                continue
            cut = int(ends[-1]) + 1
            yield from whole(t.slice(0, cut).combine_chunks())
            rest = t.slice(cut)
        if rest is not None and rest.num_rows:
            yield from whole(rest.combine_chunks())
    return run


def _edges(found: Callable) -> Callable:
    """A task that puts out pairs of set ids; ``found(table, slice, columns)``
    gives pairs of places of one tile."""
    def work(t, runs, n, vec, comp, side):
        sid, got = t["sid"].to_numpy(), []
        for lo, hi in runs:
            for x, y in found(t, slice(lo, hi), n[lo:hi], vec[lo:hi], comp[lo:hi], side[lo:hi]):
                got.append((min(sid[lo + x], sid[lo + y]), max(sid[lo + x], sid[lo + y])))
        if got:
            a, b = zip(*got)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
    return _tiles(work)


def _gather(percent: int) -> Callable:
    """Edges of groups of candidates."""
    return _edges(lambda t, at, n, vec, comp, side: tile_forest(n, vec, comp, t["grp"].to_numpy()[at], side, percent))


def _search(percent: int) -> Callable:
    """Verified links of each tile."""
    def found(t, at, n, vec, comp, side):
        tokens = t["tokens"]
        return tile_links(n, vec, comp, side, lambda i: np.frombuffer(tokens[at.start + i].as_buffer(), U), percent)
    return _edges(found)


# --- the join ----------------------------------------------------------------

def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    x = sets.select(F.col("sid").alias("a"), F.col("tokens").alias("ta"))
    y = sets.select(F.col("sid").alias("b"), F.col("tokens").alias("tb"))
    return pairs.join(x, "a").join(y, "b").mapInArrow(_verify(percent), "a bigint, b bigint")


def _bounded(pairs: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    x = points.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("vec").alias("va"))
    y = points.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("vec").alias("vb"))
    return pairs.join(x, "a").join(y, "b").mapInArrow(_within(percent), "a bigint, b bigint")


def links(docs: DataFrame, measured: DataFrame, percent: int, width: int) -> DataFrame:
    """(node, comp) over set ids with a link to another set."""
    texts = docs.select(text_or_empty(F.col("_text")).alias("text"))
    sig = texts.mapInArrow(_cells(width, percent), "cell bigint, sid bigint")
    members = stored(sig.repartition("cell").sortWithinPartitions("cell", "sid").mapInArrow(_shared, "cell bigint, sid bigint"), "cells")
    per_cell = members.groupBy("cell").agg(
        F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("sid")).alias("x"), F.bit_xor(F.xxhash64("sid", F.lit(1))).alias("y"),
        F.min_by("sid", F.xxhash64(F.col("sid"), F.col("cell") % 4)).alias("lead"))
    # cells with the same members count once
    cells = per_cell.groupBy("m", "x", "y").agg(F.min("cell").alias("cell"), F.min_by("lead", "cell").alias("lead"))
    cells = stored(cells.select("cell", "m", "lead"), "cells-once")
    members = stored(members.join(cells, "cell"), "members")
    wanted = members.select("sid").distinct()
    reps = measured.groupBy("sid").agg(F.min("doc_id").alias("rep")).join(wanted, "sid").select("sid", "rep")
    sets = stored(docs.join(reps, docs["doc_id"].eqNullSafe(F.col("rep"))).select("sid", text_or_empty(F.col("_text")).alias("text"))
                  .mapInArrow(_sets(width), "sid bigint, n bigint, tokens binary, vec binary"), "sets")
    stars = (members.where("sid <> lead").select(F.least("sid", "lead").alias("a"), F.greatest("sid", "lead").alias("b")).distinct())
    points = stored(sets.select("sid", "n", "vec").dropDuplicates(["sid"]), "points")
    near = stored(_bounded(stars, points, percent), "stars")
    first = written(connected_components(_verified(near, sets, percent)))
    # groups of candidates from the cells, then links from the groups: a pair
    # may share many cells, but lies in one group
    rows = members.select("cell", "sid").join(_named(first, "comp"), "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
    cells = _with_tiles(stored(_open(rows).join(points.select("sid", "n"), "sid"), "open-cells"))
    groups = first.limit(0)
    for across in (False, True):
        if not across or _cut(cells):
            groups = _contracted(groups, _from_cells(cells, points, groups, percent, across))
    known = first
    sized = _with_tiles(stored(_named(groups, "cell").join(points.select("sid", "n"), "sid"), "groups"))
    for across in (False, True):
        if not across or _cut(sized):
            known = _contracted(known, _from_groups(sized, sets, known, percent, across))
    return known


def _with_tiles(rows: DataFrame) -> DataFrame:
    """Rows (cell, n, sid, ...) with the number of tiles of their cell, so that
    a tile has a bounded number of members and bytes."""
    tiles = (rows.groupBy("cell").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("m"))
             .select("cell", F.greatest(F.ceil(F.col("m") / TILE), F.ceil(F.col("m") * F.col("n") * 8 / TILE_BYTES)).cast("int").alias("tiles")))
    return stored(rows.join(tiles, "cell"), "tiles")


def _cut(rows: DataFrame) -> bool:
    """Whether some cell has several tiles, which then must meet."""
    return not rows.where("tiles > 1").isEmpty()


def _tiled(rows: DataFrame, across: bool) -> DataFrame:
    """Rows dealt to their tiles: each tile by itself, or every two of a cell."""
    out = rows.withColumn("t", F.pmod(F.xxhash64("sid"), F.col("tiles")).cast("int"))
    if across:
        out = out.where("tiles > 1").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).where("t <> other")
    else:
        out = out.withColumn("other", F.col("t"))
    return out.withColumns({"lo": F.least("t", "other"), "hi": F.greatest("t", "other"),
                            "side": F.when(F.col("t") > F.col("other"), 1).otherwise(0)}).drop("t", "other", "tiles")


def _open(rows: DataFrame) -> DataFrame:
    """The rows of cells whose members lie in several components."""
    several = rows.groupBy("cell").agg(F.min("comp").alias("p"), F.max("comp").alias("q")).where("p <> q").select("cell")
    return rows.join(several, "cell")


def _dealt(tiled: DataFrame) -> DataFrame:
    key = ["cell", "lo", "hi"]
    return tiled.repartition(*key).sortWithinPartitions(*key)


def _named(known: DataFrame, name: str) -> DataFrame:
    return known.select(F.col("node").alias("sid"), F.col("comp").alias(name))


def _from_cells(cells: DataFrame, points: DataFrame, groups: DataFrame, percent: int, across: bool) -> DataFrame:
    tiled = _tiled(cells, across).join(_named(groups, "grp"), "sid", "left").withColumn("grp", F.coalesce("grp", "sid"))
    tiled = tiled.join(points.select("sid", "vec"), "sid").select("cell", "lo", "hi", "sid", "n", "comp", "grp", "side", "vec")
    return _dealt(tiled).mapInArrow(_gather(percent), "a bigint, b bigint").distinct()


def _from_groups(groups: DataFrame, sets: DataFrame, known: DataFrame, percent: int, across: bool) -> DataFrame:
    size = sets.select("sid", "vec", "tokens").dropDuplicates(["sid"])
    rows = groups.join(_named(known, "comp"), "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
    tiled = _tiled(_open(rows), across).join(size, "sid").select("cell", "lo", "hi", "sid", "n", "comp", "side", "vec", "tokens")
    return _dealt(tiled).mapInArrow(_search(percent), "a bigint, b bigint")


def _contracted(known: DataFrame, more: DataFrame) -> DataFrame:
    """Components (node, comp) after more links between nodes."""
    named = known.withColumnsRenamed({"node": "k"})
    a_side = more.join(named.withColumnRenamed("comp", "ca"), F.col("a") == F.col("k"), "left").select(F.coalesce("ca", "a").alias("a"), "b")
    both = a_side.join(named.withColumnRenamed("comp", "cb"), F.col("b") == F.col("k"), "left").select("a", F.coalesce("cb", "b").alias("b"))
    joined = connected_components(both).withColumnsRenamed({"node": "k", "comp": "c2"})
    merged = known.join(joined, F.col("comp") == F.col("k"), "left").select("node", F.coalesce("c2", "comp").alias("comp"))
    alone = joined.join(known.select(F.col("node").alias("f")), F.col("k") == F.col("f"), "left_anti").select(F.col("k").alias("node"), F.col("c2").alias("comp"))
    return written(merged.unionByName(alone))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, width: int = 5) -> DataFrame:
    """id and text hash (xxhash64, null text as empty) of the document that
    stays of each component: the smallest id, then the smallest hash. A null id
    is the smallest; documents without words stay."""
    rows = _components(docs, id_col, text_col, percent, width)
    place = F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), F.col("th").alias("text_hash"))
    some = rows.where("comp is not null").groupBy("comp").agg(F.min(place).alias("w")).select("w.*")
    return some.unionByName(rows.where("comp is null").select(place.alias("w")).select("w.*").distinct())


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, width: int = 4) -> DataFrame:
    """doc_id, n_shingles, component_id for every row."""
    rows = _components(docs, id_col, text_col, percent, width)
    some = rows.where("comp is not null").select("doc_id", "n_shingles", "comp")
    lowest = some.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    return (some.join(written(lowest), "comp").select("doc_id", "n_shingles", "component_id")
            .unionByName(rows.where("comp is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))))


def _components(docs: DataFrame, id_col: str, text_col: str, percent: int, width: int) -> DataFrame:
    """doc_id, th (text hash), n_shingles, comp (null without shingles) of
    every row, written once."""
    prepared(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("_text"))
    text = text_or_empty(F.col("_text"))
    measured = stored(rows.select("doc_id", text.alias("text"), F.xxhash64(text).alias("th"))
                      .mapInArrow(_measure(width), "doc_id bigint, n bigint, sid bigint, th bigint"), "measured")
    linked = links(rows, measured.where("n > 0"), percent, width)
    some = (measured.where("n > 0").join(linked.withColumnRenamed("node", "sid"), "sid", "left")
            .select("doc_id", "th", F.col("n").alias("n_shingles"), F.coalesce("comp", "sid").alias("comp")))
    none = measured.where("n = 0").select("doc_id", "th", F.col("n").alias("n_shingles"), F.lit(None).cast("bigint").alias("comp"))
    return written(some.unionByName(none))
