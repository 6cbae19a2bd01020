"""Conflict-constrained best-fit packing of documents into fixed-size bins.

Documents become pieces of at most ``capacity`` words. A piece goes into the
bin with the least room that still holds it, unless that bin already holds
another piece of the same duplicate cluster or ``per_source`` pieces of the
same source; then the next roomier bin is tried until the tightest compatible
one is found, and else a new bin is opened.

Rows are dealt by a hash of their id into groups of about ``group_rows``; each
group is packed on its own by one task, largest pieces first, so hot sources
and large groups of copies are spread over all groups and no task grows with
the input. Open bins are kept in one list ordered by room; a successor search
starts at the first bin that is large enough. Each bin carries a bitmap of its
duplicate clusters and ``per_source`` bitmaps of its sources.

Defined results: null or empty text has no words and gives one row with a null
bin; a text longer than the capacity fills whole bins and its rest is packed
like any other piece; rows repeated with the same id are packed each on its
own and, having one text, never share a bin; a null source or id is a value
like any other; an empty table gives an empty result. Extra columns are
ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardforge.llm.common import prepared, text_or_empty, word_count

SCHEMA = ("doc_id bigint, source string, piece int, first_word bigint, n_words bigint, bin_id string, "
          "bin_words bigint, bin_pieces int")


def best_fit(sizes: list[int], sources: list[int], clusters: list[int], capacity: int, per_source: int) -> list[int]:
    """The bin of each piece, pieces taken in the given order."""
    order: list[tuple[int, int]] = []   # (room, bin), ascending
    cluster_bits: list[int] = []
    source_bits: list[list[int]] = []   # per bin, one bitmap per piece allowed of a source
    out, last = [], None
    for size, source, cluster in zip(sizes, sources, clusters):
        s, c = 1 << source, (1 << cluster) if cluster >= 0 else 0
        # a piece like the one before it (equal rows follow each other) can't
        # use what that one passed over, nor the bin that it took
        start = last[1] if last is not None and last[0] == (size, source, cluster) else (size, -1)
        i = bisect_left(order, start)
        while i < len(order):
            b = order[i][1]
            if not cluster_bits[b] & c and not source_bits[b][-1] & s:
                break
            i += 1
        if i < len(order):
            room, b = order.pop(i)
            last = ((size, source, cluster), (room, b)) if c else None
        else:
            room, b = capacity, len(cluster_bits)
            last = ((size, source, cluster), (capacity, b + 1)) if c else None
            cluster_bits.append(0)
            source_bits.append([0] * per_source)
        cluster_bits[b] |= c
        planes = source_bits[b]
        for k in range(per_source):
            if not planes[k] & s:
                planes[k] |= s
                break
        if room > size:
            insort(order, (room - size, b))
        out.append(b)
    return out


def pack_group(key, t: pa.Table, capacity: int, per_source: int) -> pa.Table:
    group = key[0].as_py()
    n = t["n_words"].to_numpy()
    ids = t["doc_id"].fill_null(-(1 << 63)).to_numpy()
    digest = np.asarray(t["cluster"].to_pylist(), object)
    full, rest = n // capacity, n % capacity
    codes = t["source"].combine_chunks().dictionary_encode()
    source = codes.indices.fill_null(len(codes.dictionary)).to_numpy(zero_copy_only=False)
    _, cluster, times = np.unique(digest.astype(str), return_inverse=True, return_counts=True)
    # copies of one source follow each other
    order = np.lexsort((ids, source, digest.astype(str), -rest))
    order = order[rest[order] > 0]
    # a cluster of one piece can't conflict and needs no bit
    shared = np.flatnonzero(times > 1)
    bit = np.full(len(times), -1)
    bit[shared] = np.arange(len(shared))
    bins = best_fit(rest[order].tolist(), source[order].tolist(), bit[cluster[order]].tolist(), capacity, per_source)
    used = np.bincount(bins, weights=rest[order]).astype(np.int64) if bins else np.zeros(0, np.int64)
    pieces = np.bincount(bins).astype(np.int64) if bins else np.zeros(0, np.int64)
    row, piece, first, words, name, size, many = [], [], [], [], [], [], []
    where = dict(zip(order.tolist(), bins))
    whole = 0
    for i in range(len(n)):
        for k in range(int(full[i])):
            row.append(i), piece.append(k), first.append(k * capacity), words.append(capacity)
            name.append(f"{group}-w{whole}"), size.append(capacity), many.append(1)
            whole += 1
        if rest[i]:
            b = where[i]
            row.append(i), piece.append(int(full[i])), first.append(int(full[i]) * capacity), words.append(int(rest[i]))
            name.append(f"{group}-b{b}"), size.append(int(used[b])), many.append(int(pieces[b]))
        elif not n[i]:
            row.append(i), piece.append(0), first.append(0), words.append(0), name.append(None), size.append(0), many.append(0)
    at = pa.array(row, pa.int64())
    return pa.table({"doc_id": t["doc_id"].take(at), "source": t["source"].take(at), "piece": pa.array(piece, pa.int32()),
                     "first_word": pa.array(first, pa.int64()), "n_words": pa.array(words, pa.int64()),
                     "bin_id": pa.array(name, pa.string()), "bin_words": pa.array(size, pa.int64()),
                     "bin_pieces": pa.array(many, pa.int32())})


def best_fit_packing(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
                     capacity: int = 2048, per_source: int = 4, group_rows: int = 8192) -> DataFrame:
    """doc_id, source, piece, first_word, n_words (the span of the text),
    bin_id, bin_words and bin_pieces (totals of the bin): one row per piece."""
    prepared(docs.sparkSession)
    groups = max(1, -(-docs.select(F.lit(1)).count() // group_rows))
    text = text_or_empty(F.col(text_col))
    digest = F.md5(text.cast("binary"))
    small = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                        word_count(text).alias("n_words"), digest.alias("cluster"))
    # equal rows are merged and numbered, so that they don't all meet in one group
    kind = ["doc_id", "source", "n_words", "cluster"]
    small = (small.groupBy(*kind).agg(F.count(F.lit(1)).alias("times"))
             .select(*kind, F.explode(F.sequence(F.lit(1).cast("bigint"), "times")).alias("copy")))
    small = small.select(*kind, F.pmod(F.xxhash64("doc_id", "cluster", "copy"), F.lit(groups)).alias("grp"))
    return small.groupBy("grp").applyInArrow(lambda key, t: pack_group(key, t, capacity, per_source), SCHEMA)
