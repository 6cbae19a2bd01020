"""Chat formatting: collapse cumulative conversation snapshots, then render.

A logging system that stores every state of a dialogue writes the same turns
many times: the conversation after turn 2, after turn 4, and so on. A logged
conversation that is a proper prefix of a longer one adds nothing, and of
equal conversations one is enough.

Method (DataFrame functions only):

1. Turns are grouped into segments of ``segment_turns`` turn numbers, repeated
   rows collapse in the partial aggregation, and each segment holds its turns
   in order. A conversation of any length is many bounded segments.
2. Segment sizes are summed before each segment, so every turn knows its
   position. Each turn is hashed with its position; the prefix hash of length
   k is the running sum of four 32-bit lanes of those hashes, first inside the
   segment, then over segment totals.
3. Equal conversations (same length and hash) keep the smallest conv_id. An
   anti-join against the distinct prefixes of longer conversations leaves the
   maximal ones.
4. The segments of these are rendered as chat markup, one row per segment.

Defined results: a repeated row (same conv_id, turn, role, text) counts once;
rows that share conv_id and turn but differ follow each other by role, then
text, nulls first; a null turn comes before all others; rows with a null
conv_id form one conversation with a null id; a null role renders as
``unknown`` and differs from that word in the comparison; null text renders as
empty and differs from empty in the comparison. ``<|`` inside role or text is
written ``< |`` so that no text can forge a marker. Other input columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shardforge.llm.common import written

LANES = ("h0", "h1", "h2", "h3")


def _marked(c: Column) -> Column:
    """A form in which null, empty and joined values can't be confused."""
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.length(c).cast("string"), F.lit(":"), c))


def _turn_hash(pos: Column, turn: Column) -> Column:
    return F.md5(F.concat(pos.cast("string"), F.lit("|"), _marked(turn["role"]), F.lit("|"), _marked(turn["text"])))


def _lane(digest: Column, k: int) -> Column:
    return F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("bigint")


def _safe(c: Column) -> Column:
    return F.replace(c, F.lit("<|"), F.lit("< |"))


def _render(turn: Column) -> Column:
    return F.concat(F.lit("<|im_start|>"), _safe(F.coalesce(turn["role"], F.lit("unknown"))), F.lit("\n"),
                    _safe(F.coalesce(turn["text"], F.lit(""))), F.lit("<|im_end|>\n"))


def chat_segments(conversations: DataFrame, segment_turns: int = 256) -> DataFrame:
    """conv_id, seg, n, start (turns before the segment), turns (ordered)."""
    rows = conversations.select(
        "conv_id", F.coalesce(F.floor(F.col("turn") / segment_turns), F.lit(-(1 << 62))).cast("bigint").alias("seg"),
        F.struct(F.col("turn").cast("bigint").alias("turn"), F.col("role").cast("string").alias("role"),
                 F.col("text").cast("string").alias("text")).alias("t"))
    segs = (rows.groupBy("conv_id", "seg").agg(F.array_sort(F.collect_set("t")).alias("turns"))
            .withColumn("n", F.size("turns").cast("bigint")))
    return written(segs)


def maximal_conversations(segs: DataFrame) -> DataFrame:
    """conv_id, n_turns, copies: the conversations that are no prefix of a
    longer one, one of each set of equal ones."""
    before = Window.partitionBy("conv_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    placed = (segs.select("conv_id", "seg", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
              .withColumnsRenamed({"conv_id": "c", "seg": "s", "n": "m"}))
    turns = (segs.join(placed, segs.conv_id.eqNullSafe(placed.c) & (segs.seg == placed.s))
             .select("conv_id", "seg", "start", F.posexplode("turns").alias("i", "t"))
             .withColumn("k", F.col("start") + F.col("i") + 1))
    hashed = turns.withColumn("d", _turn_hash(F.col("k"), F.col("t"))).select(
        "conv_id", "seg", "k", *[_lane(F.col("d"), j).alias(h) for j, h in enumerate(LANES)])
    hashed = written(hashed)
    inside = Window.partitionBy("conv_id", "seg").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    totals = hashed.groupBy("conv_id", "seg").agg(*[F.sum(h).alias(h) for h in LANES], F.max("k").alias("k"))
    offsets = totals.select(F.col("conv_id").alias("c"), F.col("seg").alias("s"), F.col("k").alias("last"),
                            *[F.coalesce(F.sum(h).over(before), F.lit(0)).alias(f"o_{h}") for h in LANES],
                            F.max("k").over(Window.partitionBy("conv_id")).alias("n_turns"))
    local = hashed.select("conv_id", "seg", "k", *[F.sum(h).over(inside).alias(h) for h in LANES])
    prefixes = (local.join(offsets, local.conv_id.eqNullSafe(F.col("c")) & (local.seg == F.col("s")))
                .select("conv_id", "k", "n_turns", *[(F.col(h) + F.col(f"o_{h}")).alias(h) for h in LANES]))
    whole = (prefixes.where(F.col("k") == F.col("n_turns"))
             .groupBy("k", *LANES).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies")))
    proper = prefixes.where(F.col("k") < F.col("n_turns")).select("k", *LANES).distinct()
    return (whole.join(proper, ["k", *LANES], "left_anti")
            .select("conv_id", F.col("k").alias("n_turns"), "copies"))


def format_chats(conversations: DataFrame, segment_turns: int = 256) -> DataFrame:
    """conv_id, segment (0, 1, ...), n_segments, n_turns, copies, turns (in
    this segment), text. The texts of a conversation's segments, joined in
    order, are its rendering."""
    segs = chat_segments(conversations, segment_turns)
    keep = maximal_conversations(segs).withColumnRenamed("conv_id", "kept_id")
    order = Window.partitionBy("conv_id").orderBy("seg")
    numbered = segs.select("conv_id", "seg", (F.row_number().over(order) - 1).alias("segment"),
                           F.count(F.lit(1)).over(Window.partitionBy("conv_id")).alias("n_segments"))
    chosen = (numbered.join(keep, F.col("conv_id").eqNullSafe(F.col("kept_id")))
              .select(F.col("conv_id").alias("c"), F.col("seg").alias("s"), "segment", "n_segments", "n_turns", "copies"))
    text = F.concat_ws("", F.transform("turns", _render))
    return (segs.join(chosen, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("seg") == F.col("s")))
            .select("conv_id", F.col("segment").cast("bigint").alias("segment"), "n_segments", "n_turns", "copies",
                    F.col("n").alias("turns"), text.alias("text")))
