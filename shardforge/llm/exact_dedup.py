"""Exact dedup against a history of digests behind a minimal perfect hash.

1. Every row is reduced to (id, sha256 of its text, row locator) and written
   once; texts move through no shuffle.
2. The history rows (those that ``is_history`` marks, for instance what an
   earlier crawl kept) are reduced to distinct digests with the winner's id
   and locator. Digests are dealt into shards by their leading bits, about
   ``shard_keys`` in each, and each shard gets a minimal perfect hash: keys
   alone at their hashed place settle there, the others try again at the next
   level with another hash, and the slot number is the rank of the place. A
   slot holds the full digest and the winner's locator.
3. The other rows are reduced to distinct digests too, go to their shard, and
   look up their slot. Only if all 32 bytes equal the slot's digest is it a
   member, merged into that slot; nonmembers form groups of their own.
4. Each row is joined with its group. Of equal texts the row with the largest
   id stays.

Groups of copies are reduced in partial aggregations, so a text that a third
of all rows share is one row per map task; the last join has one row per group
on one side and leaves splitting of a hot digest to the adaptive skew join.

Defined results: null text counts as empty; a null id loses against any other
id; of rows repeated with the same id and text one stays; an empty table gives
an empty result. Other input columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardforge.llm.common import bucket_of, prepared, text_or_empty, written
from shardforge.llm.textarrays import U, mix, salt

GROUP_SCHEMA = "digest binary, keep_id bigint, keep_loc bigint, group_size bigint, member boolean"


def key_words(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit words of each 32-byte digest, behind the bits of the shard."""
    w = np.ascontiguousarray(digests).view(np.uint64)
    return w[:, 1], w[:, 2]


def _place(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(a + salt(level + 1)) ^ mix(b + U(level))) % U(size)


class PerfectHash:
    """Minimal perfect hash of distinct 32-byte digests."""

    def __init__(self, digests: np.ndarray, spread: float = 1.5):
        a, b = key_words(digests)
        self.bits, self.before, total, left = [], [], 0, np.arange(len(digests))
        while len(left):
            size = max(8, int(len(left) * spread))
            at = _place(a[left], b[left], len(self.bits), size)
            alone = np.bincount(at.astype(np.int64), minlength=size) == 1
            self.bits.append(alone)
            self.before.append(total + np.cumsum(alone) - alone)
            total += int(alone.sum())
            left = left[~alone[at]]

    def slots(self, digests: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 or any slot for keys that aren't members."""
        a, b = key_words(digests)
        out, left = np.full(len(digests), -1, np.int64), np.arange(len(digests))
        for level, (alone, before) in enumerate(zip(self.bits, self.before)):
            if not len(left):
                break
            at = _place(a[left], b[left], level, len(alone))
            hit = alone[at]
            out[left[hit]] = before[at[hit]]
            left = left[~hit]
        return out


def _digests(col: pa.ChunkedArray) -> np.ndarray:
    joined = b"".join(col.to_pylist())
    return np.frombuffer(joined, np.uint8).reshape(-1, 32)


def _longs(col: pa.ChunkedArray, null: int = -(1 << 63)) -> np.ndarray:
    return col.fill_null(null).to_numpy().astype(np.int64)


def resolve_shard(history: pa.Table, incoming: pa.Table) -> pa.Table:
    """All groups of one shard from its distinct history and new digests."""
    low = -(1 << 63)
    if history.num_rows:
        keys = _digests(history["digest"])
        mph = PerfectHash(keys)
        slot = mph.slots(keys)
        n = len(keys)
        slot_digest = np.empty_like(keys)
        slot_digest[slot] = keys
        ids, locs, sizes = np.empty(n, np.int64), np.empty(n, np.int64), np.empty(n, np.int64)
        ids[slot], locs[slot], sizes[slot] = _longs(history["id"]), _longs(history["loc"]), _longs(history["n"])
    else:
        mph, slot_digest = None, np.zeros((0, 32), np.uint8)
        ids = locs = sizes = np.zeros(0, np.int64)
    new = _digests(incoming["digest"]) if incoming.num_rows else np.zeros((0, 32), np.uint8)
    new_id, new_loc, new_n = _longs(incoming["id"]), _longs(incoming["loc"]), _longs(incoming["n"])
    at = mph.slots(new) if mph is not None else np.full(len(new), -1, np.int64)
    member = at >= 0
    member[member] = (slot_digest[at[member]] == new[member]).all(axis=1)
    hit = at[member]
    sizes[hit] += new_n[member]
    better = new_id[member] > ids[hit]
    ids[hit[better]], locs[hit[better]] = new_id[member][better], new_loc[member][better]
    out = np.concatenate([slot_digest, new[~member]])
    out_id = np.concatenate([ids, new_id[~member]])
    return pa.table({
        "digest": pa.array([x.tobytes() for x in out], pa.binary()),
        "keep_id": pa.array(out_id, pa.int64(), mask=out_id == low),
        "keep_loc": pa.array(np.concatenate([locs, new_loc[~member]])),
        "group_size": pa.array(np.concatenate([sizes, new_n[~member]])),
        "member": pa.array(np.arange(len(out)) < len(slot_digest)),
    })


def _distinct(rows: DataFrame) -> DataFrame:
    """One row per digest: largest id, the locator of that row, row count."""
    per_id = rows.groupBy("digest", "id").agg(F.min("loc").alias("loc"), F.count(F.lit(1)).alias("n"))
    low = F.coalesce("id", F.lit(-(1 << 63)))
    return per_id.groupBy("digest").agg(F.max("id").alias("id"), F.max_by("loc", low).alias("loc"), F.sum("n").alias("n"))


def dedup_rows(docs: DataFrame, is_history: Column, id_col: str = "doc_id", text_col: str = "text",
               shard_keys: int = 20000) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, in_history (the text's
    digest was in the history) for every row."""
    prepared(docs.sparkSession)
    text = text_or_empty(F.col(text_col))
    rows = written(docs.select(F.col(id_col).cast("bigint").alias("id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
                               F.coalesce(is_history, F.lit(False)).alias("old"), F.monotonically_increasing_id().alias("loc")))
    n = rows.count()
    shards = max(1, -(-n // shard_keys))
    shard = (F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("bigint") % shards).alias("shard")
    history = _distinct(rows.where("old")).select("*", shard)
    incoming = _distinct(rows.where("not old")).select("*", shard)
    groups = written(history.groupBy("shard").cogroup(incoming.groupBy("shard")).applyInArrow(resolve_shard, GROUP_SCHEMA))
    return (rows.join(groups, "digest")
            .select(F.col("id").alias("doc_id"), "keep_id", "group_size", (F.col("loc") == F.col("keep_loc")).alias("kept"),
                    F.lower(F.hex("digest")).alias("text_sha256"), F.col("member").alias("in_history")))


def half_history(id_col: str = "doc_id") -> Column:
    """The rows that the registered query treats as history: half of the ids."""
    return bucket_of(F.col(id_col), 2) == 0
