"""Shard assignment (F3): interleaved shard numbers per worker — worker w
writes shards w, w + W, w + 2W, ... — rolling to the next shard when the
current one holds ``max_count`` records (count mode) or when either the
record count or the byte size reaches its cap (byte mode, greedy, in key
order, the rule of the reference's shard writer)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardforge.operators.positions import positions_in_group


def assign_shards_count(df: DataFrame, worker_col: str, order_cols: list[str], max_count: int,
                        n_workers: int, start: int | None = None, out_col: str = "shard") -> DataFrame:
    """Count mode: shard = start(worker) + (position in worker div max_count)
    * n_workers, start defaulting to the worker index. Positions come from
    the skew-safe global numbering (no per-worker window)."""
    pos = positions_in_group(df, [worker_col], order_cols, "_pos")
    first = F.col(worker_col) if start is None else F.lit(start) + F.col(worker_col)
    return (pos.withColumn(out_col, (first + F.floor(F.col("_pos") / F.lit(max_count)) * F.lit(n_workers))
                           .cast("bigint"))
            .withColumn("pos_in_worker", F.col("_pos")).drop("_pos"))


# --------------------------------------------------------------------------
# Byte mode: greedy roll-over, exact and parallel
# --------------------------------------------------------------------------
#
# Before writing record j the writer starts a new shard when the current one
# already holds max_count records or max_bytes bytes. From a shard that
# starts at record r, the next one starts at
#     next(r) = min(r + max_count, first j > r with size(r..j-1) >= max_bytes)
# and the shards of a worker are the chain 0 -> next(0) -> next(next(0)) ...
#
# A plain scan walks that chain in one task per worker, which breaks when
# one worker owns a third of the data. Instead each worker's records are
# cut into chunks of ``chunk_rows`` (>= max_count) consecutive positions:
#
#  A. per chunk (plus the first max_count records of the next chunk as a
#     look-ahead), compute next() for every record and, for every record that
#     can be the chunk's first shard start (the chunk's first max_count
#     positions), where the chain leaves the chunk and how many shards it
#     starts inside it;
#  B. resolve the true first start of every chunk by pointer doubling over
#     that small table (log2(chunks) rounds of joins, nothing on the driver);
#  C. per chunk again, walk the chain from the known start and label each
#     record with its shard.
# Every task holds at most chunk_rows + max_count records.

def _next_starts(sizes, max_count: int, max_bytes: float):
    import numpy as np
    n = len(sizes)
    cs = np.concatenate([[0.0], np.cumsum(np.asarray(sizes, dtype=np.float64))])
    r = np.arange(n)
    jb = np.searchsorted(cs, cs[:n] + max_bytes, side="left")
    jb = np.maximum(jb, r + 1)
    return np.minimum(jb, r + max_count)  # local index, may be == n or beyond


def assign_shards_bytes(df: DataFrame, worker_col: str, order_cols: list[str], size_col: str,
                        max_count: int, max_bytes: float, n_workers: int, start: int | None = None,
                        chunk_rows: int = 1 << 20, out_col: str = "shard") -> DataFrame:
    """Byte mode. Workers are numbers; the records of a null worker are kept
    and numbered like any other's, but as there is no first shard for them
    their shard is null."""
    import pandas as pd

    from shardforge.session import reliable_checkpoint, ship_package
    spark = df.sparkSession
    ship_package(spark)
    C = max(int(chunk_rows), int(max_count))
    M = int(max_count)
    # positions feed several jobs below (chunk table, rounds, labelling):
    # write them once rather than re-sorting the data for each job
    pos = positions_in_group(df, [worker_col], order_cols, "_pos")
    # workers as text that is never null, so that joins keep every row
    pos = pos.withColumn("_w", F.coalesce(F.concat(F.lit("="), F.col(worker_col).cast("string")), F.lit("-")))
    light = pos.select("_w", "_pos", F.col(size_col).cast("double").alias("_s"))
    light = light.withColumn("_c", F.floor(F.col("_pos") / F.lit(C)).cast("bigint"))
    sizes_per_worker = light.groupBy("_w").agg(F.count(F.lit(1)).alias("_n"))
    halo = (light.filter((F.col("_c") > 0) & (F.pmod(F.col("_pos"), F.lit(C)) < F.lit(M)))
            .withColumn("_c", F.col("_c") - 1).withColumn("_halo", F.lit(True)))
    grouped = light.withColumn("_halo", F.lit(False)).unionByName(halo).join(sizes_per_worker, "_w")

    # ---- phase A: per chunk, exit and shard count for each possible entry
    def phase_a(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np
        pdf = pdf.sort_values("_pos")
        w = pdf["_w"].iloc[0]
        c = int(pdf["_c"].iloc[0])
        n_total = int(pdf["_n"].iloc[0])
        p = pdf["_pos"].to_numpy()
        nxt_local = _next_starts(pdf["_s"].to_numpy(), M, max_bytes)
        nxt = p[0] + nxt_local  # positions are consecutive
        nxt = np.where(nxt >= n_total, -1, nxt)  # -1: past the worker's last record
        chunk_end = (c + 1) * C
        in_chunk = int((~pdf["_halo"].to_numpy()).sum())
        # follow all chains at once by pointer doubling; a record whose next
        # start lies outside the chunk points to itself and ends its chain
        local = np.arange(in_chunk)
        inside = (nxt[:in_chunk] >= 0) & (nxt[:in_chunk] < chunk_end)
        to = np.where(inside, nxt_local[:in_chunk], local)
        steps = inside.astype(np.int64)
        while inside[to].any():
            steps += steps[to]
            to = to[to]
        exit_, cnt = nxt[to], steps + 1
        first = np.arange(min(M, in_chunk)) if c > 0 else np.array([0])
        return pd.DataFrame({"_w": w, "_c": c, "e": p[first], "x": exit_[first], "k": cnt[first]})

    cand = reliable_checkpoint(grouped.groupBy("_w", "_c").applyInPandas(
        phase_a, "_w string, _c long, e long, x long, k long"))

    # ---- phase B: pointer doubling from (chunk 0, entry 0). ``jump`` maps
    # (chunk c, entry e) to the entry x of chunk c + step (-1 once the
    # worker's records end) and the shards k started on the way; ``known``
    # holds the true entry and shard offset of chunks [0, step).
    n_chunks = cand.agg(F.max("_c")).first()[0]
    n_chunks = 0 if n_chunks is None else int(n_chunks) + 1
    known = cand.filter(F.col("_c") == 0).select("_w", "_c", "e", F.lit(0).cast("bigint").alias("off"))
    jump = cand
    step = 1
    while step < n_chunks:
        reached = (known.join(jump, ["_w", "_c", "e"]).filter(F.col("x") >= 0)
                   .select("_w", (F.col("_c") + step).alias("_c"), F.col("x").alias("e"),
                           (F.col("off") + F.col("k")).alias("off")))
        new_known = known.unionByName(reached)
        if step * 2 < n_chunks:
            a = jump.filter(F.col("x") >= 0).select(
                "_w", "_c", "e", F.col("x").alias("_x"), F.col("k").alias("_k0"),
                (F.col("_c") + step).alias("_cn"))
            b = jump.select("_w", F.col("_c").alias("_cn"), F.col("e").alias("_x"),
                            F.col("x").alias("_x2"), F.col("k").alias("_k1"))
            composed = a.join(b, ["_w", "_cn", "_x"], "left").select(
                "_w", "_c", "e", F.coalesce(F.col("_x2"), F.lit(-1)).cast("bigint").alias("x"),
                (F.col("_k0") + F.coalesce(F.col("_k1"), F.lit(0))).cast("bigint").alias("k"))
            new_jump = composed.unionByName(jump.filter(F.col("x") < 0))
            # both small tables of the round in one checkpoint (one job)
            both = reliable_checkpoint(
                new_known.withColumn("_t", F.lit("k")).unionByName(new_jump.withColumn("_t", F.lit("j")),
                                                                   allowMissingColumns=True),
                persist_first=False)
            known = both.filter(F.col("_t") == "k").select("_w", "_c", "e", "off")
            jump = both.filter(F.col("_t") == "j").select("_w", "_c", "e", "x", "k")
        else:
            known = reliable_checkpoint(new_known)
        step *= 2

    # ---- phase C: label every record from its chunk's known entry
    entries = known.select("_w", "_c", F.col("e").alias("_entry"), F.col("off").alias("_off"))

    def phase_c(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np
        pdf = pdf.sort_values("_pos")
        p = pdf["_pos"].to_numpy()
        entry = int(pdf["_entry"].iloc[0])
        off = int(pdf["_off"].iloc[0])
        nxt_local = _next_starts(pdf["_s"].to_numpy(), M, max_bytes)
        in_chunk = int((~pdf["_halo"].to_numpy()).sum())
        # walk shard starts only (one step per shard), then a cumulative sum
        starts = np.zeros(in_chunk, dtype=np.int64)
        r = entry - p[0]
        while r < in_chunk:
            starts[r] = 1
            r = int(nxt_local[r])
        idx = off - 1 + np.cumsum(starts)
        return pd.DataFrame({"_w": pdf["_w"].iloc[0], "_pos": p[:in_chunk], "_idx": idx})

    labelled = grouped.drop("_n").join(entries, ["_w", "_c"]).groupBy("_w", "_c").applyInPandas(
        phase_c, "_w string, _pos long, _idx long")
    first = F.col(worker_col) if start is None else F.lit(start) + F.col(worker_col)
    out = pos.join(labelled, ["_w", "_pos"])
    return (out.withColumn(out_col, (first + F.col("_idx") * F.lit(n_workers)).cast("bigint"))
            .withColumn("pos_in_worker", F.col("_pos")).drop("_pos", "_idx", "_w"))
