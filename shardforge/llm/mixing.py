"""Mixing sources to target weights by systematic sampling.

Each source gets a word target by weighted water-filling: weights share the
whole volume, no source gets more than ``max_repeat`` times its own words, and
what is cut off goes to the others by weight. All documents of a source then
have the same expected number of copies r = target / source words. Documents
are put in order of size, r is summed along that order, one offset per source
is added, and a document is emitted once for each integer boundary that its
step crosses: floor(rank * r + u) - floor((rank - 1) * r + u) times.

Because the order is by size, the words taken differ from the target by less
than the largest document of the source.

Ranks without a hot task: counts per (source, size, cell), where the cell is a
hash of the id, are summed over sizes, then over the cells of a size; only
inside one cell are documents numbered. A source with a third of all rows, or
a third of all rows having one size, is spread over ``cells`` tasks. The table
of sources itself (one row per source) is ordered in one task.

Defined results: a null source is a source of its own, last in order; null or
empty text has size 0 and, like a source without words, is never taken unless
its step crosses a boundary (it then adds no words); rows with equal ids and
sizes are interchangeable and each is numbered on its own; an empty table
gives an empty result. Other columns pass through unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shardforge.llm.common import ROW, boxed, field, word_count

WEIGHTS = (5, 2, 1)


def offset(source: Column, seed: int) -> Column:
    """The source's offset in [0, 1), drawn by hashing."""
    key = F.concat(F.lit(f"{seed}|"), F.coalesce(source, F.lit("")), F.when(source.isNull(), F.lit("|null")).otherwise(F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_repeat: int = 3) -> DataFrame:
    """(source, source_size) -> also target. ``weights`` repeat over the
    sources in code-point order, null last."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * max_repeat)
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    to_before = order.rowsBetween(Window.unboundedPreceding, -1)
    # in order of cap / w the capped sources come first; level is what one
    # unit of weight gets if exactly the sources before this one are capped
    s = (s.withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(to_before), F.lit(0)))
                      / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(to_before), F.lit(0.0))))
         .withColumn("free", F.col("level") * F.col("w") <= F.col("cap")))
    s = s.withColumn("final", F.first(F.when(F.col("free"), F.col("level")), ignorenulls=True).over(
        order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return s.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("final") * F.col("w")).alias("target"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
                size_col: str | None = None, weights=WEIGHTS, max_repeat: int = 3, seed: int = 0,
                cells: int = 4096) -> DataFrame:
    """Each input row as the struct ``_llm_row`` with size, source_size,
    target, copies and taken (copies * size). ``size_col`` names a column of
    sizes; without it the words of ``text_col`` are counted."""
    size = F.coalesce(field(size_col).cast("bigint"), F.lit(0)) if size_col else word_count(field(text_col))
    # the source as a key that is never null, so that joins need no null test
    key = F.coalesce(F.concat(F.lit("="), field(source_col).cast("string")), F.lit("null"))
    base = boxed(docs).select(ROW, size.alias("size"), key.alias("src"),
                              F.md5(F.coalesce(field(id_col).cast("string"), F.lit(""))).alias("tie"))
    base = base.withColumn("cell", F.conv(F.substring("tie", 1, 4), 16, 10).cast("int") % cells)
    counts = base.groupBy("src", "size", "cell").agg(F.count(F.lit(1)).alias("n"))
    in_size = Window.partitionBy("src", "size").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cell_offset = counts.select("src", "size", "cell", F.coalesce(F.sum("n").over(in_size), F.lit(0)).alias("cell_before"))
    per_size = counts.groupBy("src", "size").agg(F.sum("n").alias("n"))
    in_source = Window.partitionBy("src").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    sizes = per_size.groupBy("src").agg(F.sum(F.col("n") * F.col("size")).cast("bigint").alias("source_size"))
    named = sizes.withColumn("source", F.when(F.col("src") != "null", F.expr("substring(src, 2)")))
    targets = (source_targets(named, weights, max_repeat)
               .withColumn("src", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))))
    size_offset = (per_size.select("src", "size", F.coalesce(F.sum("n").over(in_source), F.lit(0)).alias("size_before"))
                   .join(targets, "src"))
    before = (cell_offset.join(size_offset, ["src", "size"])
              .select("src", "size", "cell", (F.col("cell_before") + F.col("size_before")).alias("before"),
                      "source", "source_size", "target"))
    in_cell = Window.partitionBy("src", "size", "cell").orderBy("tie")
    out = base.withColumn("i", F.row_number().over(in_cell)).join(before, ["src", "size", "cell"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rank = F.col("before") + F.col("i")
    u = offset(F.col("source"), seed)
    copies = F.floor(rank * rate + u) - F.floor((rank - 1) * rate + u)
    return (out.withColumn("copies", copies.cast("bigint"))
            .select(ROW, "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")))


def emit_mix(docs: DataFrame, **kw) -> DataFrame:
    """The mix itself: each input row as often as it is taken, columns as given."""
    m = mix_sources(docs, **kw).where(F.col("copies") > 0)
    return m.withColumn("_c", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(f"{ROW}.*")
