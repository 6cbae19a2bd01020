"""Filter interaction audit with decision diagrams of failure masks.

Every document is reduced to the set of filters that it fails. Per part (a
language) the counts of these masks, at most 2^k of them, become a
count-weighted decision diagram: level i tests one filter, the low branch
holds the documents that pass it, the high branch those that fail it, equal
subdiagrams are one node, and a node's weight is the sum of the counts below
it. All filters but the last level's are tested on every path (nothing is
skipped), so that weights add up.

Orders of the filters are visited by swapping adjacent levels (each order
differs from the one before by one swap). A swap rewrites the two levels only:
a node of the upper level keeps its identity and its weight. In each order the
path on which everything passes gives the steps: what goes down the low branch
is kept, what goes down the high branch is removed at this step.

Spark does the counting: one scan of the texts with built-in functions, a join
with the labels, and partial aggregations down to one row per part and mask.
Which texts occurred before is counted without a join: rows of equal text,
part, mask and labels are merged first, so a text that a third of all rows
share is one row per map task, and only merged rows meet in a window.

Defined results: null text counts as empty; a null part is the empty string
(as is an empty one); a row without id has no smaller ids and is nobody's
smaller id, and no labels; rows repeated with one id don't make each other
fail; a document labelled several times is good (toxic) if one label says so;
an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shardforge.llm.common import WORD, held, prepared, text_or_empty, written

LETTERS = "ABCDE"
STEP_SCHEMA = ("part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, "
               "unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint")


# --- the diagram -------------------------------------------------------------


class Diagram:
    """Decision diagram over ``k`` filters; ``counts`` maps a mask (bit i:
    filter i fails) to a tuple of counts. Masks that don't occur count 0."""

    def __init__(self, counts: dict[int, tuple[int, ...]], k: int):
        width = len(next(iter(counts.values()), (0,)))
        self.order = list(range(k))
        self.weight: list[tuple[int, ...]] = []
        self.low: list[int] = []
        self.high: list[int] = []
        self.levels: list[dict] = [{} for _ in range(k + 1)]    # unique table of each level

        def build(level: int, mask: int) -> int:
            if level == k:
                return self._leaf(tuple(counts.get(mask, (0,) * width)))
            return self._node(level, build(level + 1, mask), build(level + 1, mask | 1 << level))
        self.root = build(0, 0)

    def _new(self, low: int, high: int, weight: tuple[int, ...]) -> int:
        self.low.append(low)
        self.high.append(high)
        self.weight.append(weight)
        return len(self.weight) - 1

    def _leaf(self, weight: tuple[int, ...]) -> int:
        table = self.levels[-1]
        if weight not in table:
            table[weight] = self._new(-1, -1, weight)
        return table[weight]

    def _node(self, level: int, low: int, high: int) -> int:
        table = self.levels[level]
        if (low, high) not in table:
            table[low, high] = self._new(low, high, tuple(a + b for a, b in zip(self.weight[low], self.weight[high])))
        return table[low, high]

    def swap(self, level: int) -> None:
        """Exchange the filters of ``level`` and the next one."""
        upper = list(self.levels[level].values())
        self.levels[level + 1] = {}
        self.levels[level] = {}
        for v in upper:
            a, b = self.low[v], self.high[v]
            low = self._node(level + 1, self.low[a], self.low[b])
            high = self._node(level + 1, self.high[a], self.high[b])
            self.low[v], self.high[v] = low, high
            self.levels[level][low, high] = v
        o = self.order
        o[level], o[level + 1] = o[level + 1], o[level]

    def all_pass(self) -> Iterator[tuple[int, tuple[int, ...], tuple[int, ...]]]:
        """(filter, kept weight, removed weight) of each step."""
        v = self.root
        for f in self.order:
            yield f, self.weight[self.low[v]], self.weight[self.high[v]]
            v = self.low[v]

    def failing(self) -> list[int]:
        """How many documents fail each filter: the high weights of its
        level, each as often as paths lead to the node."""
        out, paths = [0] * len(self.order), {self.root: 1}
        for f in self.order:
            below: dict[int, int] = {}
            for v, p in paths.items():
                out[f] += p * self.weight[self.high[v]][0]
                for child in (self.low[v], self.high[v]):
                    below[child] = below.get(child, 0) + p
            paths = below
        return out

    def failing_only(self) -> list[int]:
        """How many documents fail this filter and no other."""
        out = [0] * len(self.order)
        for f in self.order:
            v = self.root
            for g in self.order:
                v = self.high[v] if g == f else self.low[v]
            out[f] = self.weight[v][0]
        return out


def adjacent_swaps(k: int) -> Iterator[int]:
    """Positions whose swaps with the next one visit all orders of ``k``
    things once: the k-th walks through the others, which move one swap on
    whenever it has arrived at an end."""
    if k < 2:
        return
    down = True
    for inner in [*adjacent_swaps(k - 1), None]:
        yield from (range(k - 2, -1, -1) if down else range(k - 1))
        if inner is not None:
            # at the left end the others sit one place to the right
            yield inner + 1 if down else inner
        down = not down


def audit_part(part: str, counts: dict[int, tuple[int, ...]], letters: str = LETTERS) -> list[tuple]:
    """The steps of every order; counts are (documents, good, toxic)."""
    d = Diagram(counts, len(letters))
    fails, only = d.failing(), d.failing_only()
    shapley = [0] * len(letters)
    steps = []
    for swap in [None, *adjacent_swaps(len(letters))]:
        if swap is not None:
            d.swap(swap)
        name = "".join(letters[f] for f in d.order)
        for i, (f, kept, removed) in enumerate(d.all_pass()):
            shapley[f] += removed[0]
            steps.append((name, i + 1, f, kept[0], removed))
    return [(part, name, i, kept, removed[0], fails[f] - removed[0], only[f], removed[1], removed[2], shapley[f])
            for name, i, f, kept, removed in steps]


# --- Spark -------------------------------------------------------------------


def failure_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """id, part, digest, mask (bits of A to D) of every row."""
    d = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"),
                    text_or_empty(F.col(f"`{text_col}`")).alias("x"))
    d = held(d, "w", F.regexp_extract_all("x", F.lit(WORD), F.lit(0)))
    n = F.size("w").cast("bigint")
    conditions = [n < 200,
                  100 * F.size(F.array_distinct("w")).cast("bigint") < 50 * n,
                  100 * F.length(F.regexp_replace("x", "[^A-Z]+", "")).cast("bigint") > 3 * F.length("x").cast("bigint"),
                  F.col("x").rlike(r"[#$%&*|]")]
    mask = F.lit(0)
    for bit, failed in enumerate(conditions):
        mask = mask + F.when(failed, 1 << bit).otherwise(0)
    return d.select("id", "part", F.unhex(F.sha2(F.col("x").cast("binary"), 256)).alias("digest"), mask.alias("mask"))


def labelled(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows with good and toxic (false where there is no label)."""
    def one(c: str) -> Column:
        return F.coalesce(F.max(F.col(c) == 1), F.lit(False))
    marks = (labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("bigint").alias("id"))
             .agg(one("quality").alias("good"), one("toxic").alias("toxic")))
    no = F.lit(False)
    with_id = rows.where("id is not null").join(marks, "id", "left").withColumns(
        {"good": F.coalesce("good", no), "toxic": F.coalesce("toxic", no)})
    return with_id.unionByName(rows.where("id is null").withColumns({"good": no, "toxic": no}))


def mask_counts(rows: DataFrame, repeat_bit: int = 4) -> DataFrame:
    """part, mask, n, good, toxic; ``repeat_bit`` of the mask is set where a
    row with a smaller id has the same digest."""
    kind = ["digest", "part", "mask", "good", "toxic"]
    per_id = rows.groupBy(*kind, "id").agg(F.count(F.lit(1)).alias("n"))
    merged = per_id.groupBy(*kind).agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("no_id"),
        F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("m"))
    least = F.min("m.id").over(Window.partitionBy("digest"))
    first = F.col("no_id") + F.when(F.col("m.id") == F.col("least"), F.col("m.n")).otherwise(0)
    split = merged.withColumn("least", least).select(
        "part", "mask", "good", "toxic", "n", F.coalesce(first, F.col("no_id")).alias("first"))
    both = split.select("part", "good", "toxic", F.explode(F.array(
        F.struct(F.col("mask").alias("mask"), F.col("first").alias("n")),
        F.struct((F.col("mask") + (1 << repeat_bit)).alias("mask"), (F.col("n") - F.col("first")).alias("n")))).alias("v"))
    n = F.col("v.n")
    return (both.groupBy("part", F.col("v.mask").alias("mask"))
            .agg(F.sum(n).alias("n"), F.sum(F.when(F.col("good"), n).otherwise(0)).alias("good"),
                 F.sum(F.when(F.col("toxic"), n).otherwise(0)).alias("toxic")))


def _audit_group(t: pa.Table) -> pa.Table:
    rows = t.to_pylist()
    counts = {r["mask"]: (r["n"], r["good"], r["toxic"]) for r in rows}
    steps = audit_part(rows[0]["part"], counts)
    types = [pa.string(), pa.string(), pa.int32()] + [pa.int64()] * 7
    names = [c.split()[0] for c in STEP_SCHEMA.split(", ")]
    return pa.table([pa.array(col, ty) for col, ty in zip(zip(*steps), types)], names=names)


def audit_filters(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  part_col: str = "lang") -> DataFrame:
    """One row per part, order of the filters and step."""
    prepared(docs.sparkSession)
    rows = written(failure_rows(docs, id_col, text_col, part_col))
    return mask_counts(labelled(rows, labels, id_col)).groupBy("part").applyInArrow(_audit_group, STEP_SCHEMA)
