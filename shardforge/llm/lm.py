"""Language-model scoring with a weighted backoff automaton.

Model: word n-grams up to ``order``, smoothed with Dirichlet weights: with
history h and its longest proper suffix h',
p(w|h) = (c(hw) + mu * p(w|h')) / (c(h) + mu), and for the empty history
p(w) = (c(w) + 0.1) / (N + 0.1 * (V + 1)). Written as an automaton, each
history seen in training is a state, each n-gram seen in training an arc, and
a state's failure arc leads to its suffix with weight mu / (c(h) + mu). A text
is read from left to right: the state follows the arc of the next word, or
failure arcs until there is one, and log10 weights add up.

The model grows with the corpus, so it is never broadcast or collected. Rows
are dealt into blocks of about ``block_chars`` characters by a hash of the id.

1. Each block counts its distinct n-grams. Sorted by hash they fall into as
   many hash ranges as there are blocks, and go there as packed arrays (hash
   differences and counts, byte by byte, which compresses well).
2. Each range adds up the counts and answers every block with an array in the
   block's own order: the total where several blocks hold the n-gram, else 0
   (a block that alone holds an n-gram knows its count already).
3. Each block counts again, takes the totals, builds the automaton of just the
   n-grams its texts hold, which is all they can reach, and scores its texts.

No text or count is left out; a frequent word is one row per block. N and V
come from one aggregation over the training words. N-grams are told apart by
64-bit hashes.

Defined results: null or empty text is the single end token; held-out texts
(crc32 of the id modulo ``folds`` is 0) are scored and not counted; a null id
counts as training; repeated rows count and are scored each; an empty table
gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardforge.llm.common import bucket_of, prepared, text_or_empty
from shardforge.llm.textarrays import U, mix, string_array, slices, word_hashes

START, END = U(0x5D1C0DE5A11CE001), U(0x5D1C0DE5A11CE002)
PACKED = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
PACKED_SQL = "part int, block int, keys binary, counts binary"
TOTALS = pa.schema([("block", pa.int32()), ("part", pa.int32()), ("totals", pa.binary())])
TOTALS_SQL = "block int, part int, totals binary"
SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                    ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()),
                    ("copies", pa.int64())])


class Grams:
    """The n-grams of a run of texts: for each length k, the local number of
    the n-gram that ends at each place (-1: it would start before the text),
    and for each such n-gram its hash, prefix, suffix, last word and count."""

    def __init__(self, texts: pa.Array, train: np.ndarray, order: int):
        parts, sizes = [], []
        for _, part in slices(texts):
            h, woff = word_hashes(part)
            n = np.diff(woff)
            full = np.empty(len(h) + 2 * len(part), U)
            first = woff[:-1] + 2 * np.arange(len(part))
            full[first], full[first + n + 1] = START, END
            full[np.arange(len(h)) + 2 * np.repeat(np.arange(len(part)), n) + 1] = h
            parts.append(full)
            sizes.append(n + 2)
        words = np.concatenate(parts) if parts else np.zeros(0, U)
        self.size = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        self.first = np.cumsum(self.size) - self.size
        within = np.arange(len(words)) - np.repeat(self.first, self.size)
        self.counted = np.repeat(train, self.size).astype(np.float64)
        uniq, tok = np.unique(words, return_inverse=True)
        self.tok, self.n_words = tok, len(uniq)
        self.ids, self.hash, self.prefix, self.suffix, self.last = [tok], [uniq], [None], [None], [np.arange(len(uniq))]
        for k in range(2, order + 1):
            at = np.flatnonzero(within >= k - 1)
            pair = self.ids[-1][at - 1] * np.int64(self.n_words) + tok[at]
            u, index, inverse = np.unique(pair, return_index=True, return_inverse=True)
            ids = np.full(len(words), -1, np.int64)
            ids[at] = inverse
            pre, last = u // self.n_words, u % self.n_words
            self.suffix.append(self.ids[-1][at[index]])
            self.prefix.append(pre)
            self.last.append(last)
            self.hash.append(mix(self.hash[-1][pre] * U(0x9E3779B97F4A7C15) + U(k)) ^ mix(uniq[last] + U(k)))
            self.ids.append(ids)
        self.count = []
        for ids in self.ids:
            ok = ids >= 0
            n = int(ids.max()) + 1 if len(ids) else 0
            self.count.append(np.rint(np.bincount(ids[ok], weights=self.counted[ok], minlength=n)).astype(np.int64))

    def sorted_keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all n-grams in ascending order, and that order."""
        keys = np.concatenate([mix(h + U(k)) for k, h in enumerate(self.hash)])
        order = np.argsort(keys)
        return keys[order], order


def planes(x: np.ndarray) -> bytes:
    """64-bit numbers, all first bytes, then all second bytes, and so on."""
    return np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T).tobytes()


def unplanes(b: bytes, dtype) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view(dtype).ravel()


def range_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys >> U(32)) * U(parts) >> U(32)).astype(np.int64)


def count_block(key, t: pa.Table, order: int, parts: int) -> pa.Table:
    g = Grams(string_array(t["text"]), t["train"].to_numpy() * t["copies"].to_numpy(), order)
    keys, at = g.sorted_keys()
    counts = np.concatenate(g.count)[at]
    part = range_of(keys, parts)
    first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    ends = np.append(first[1:], len(keys))
    steps = [np.concatenate([keys[i:i + 1], np.diff(keys[i:j])]) for i, j in zip(first, ends)]
    return pa.table([pa.array(part[first], pa.int32()), pa.array(np.full(len(first), key[0].as_py(), np.int32)),
                     pa.array([planes(x) for x in steps], pa.binary()),
                     pa.array([planes(counts[i:j]) for i, j in zip(first, ends)], pa.binary())], schema=PACKED)


def add_up(t: pa.Table) -> pa.Table:
    """The totals of one hash range, for each block in the block's order."""
    keys = [np.cumsum(unplanes(x, U), dtype=U) for x in t["keys"].to_pylist()]
    sizes = np.cumsum([len(x) for x in keys])[:-1]
    keys, counts = np.concatenate(keys), np.concatenate([unplanes(x, np.int64) for x in t["counts"].to_pylist()])
    at = np.argsort(keys, kind="stable")
    ranked = keys[at]
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    times = np.diff(np.append(first, len(ranked)))
    total = np.empty(len(keys), np.int64)
    total[at] = np.repeat(np.where(times > 1, np.add.reduceat(counts[at], first), 0), times)
    return pa.table([t["block"].combine_chunks(), t["part"].combine_chunks(),
                     pa.array([planes(x) for x in np.split(total, sizes)], pa.binary())], schema=TOTALS)


class Automaton:
    """States, arcs and failure arcs of the n-grams of one block."""

    def __init__(self, g: Grams, counts: list[np.ndarray], order: int, mu: float, words: int, types: int):
        self.base = np.log10((counts[0] + 0.1) / (words + 0.1 * (types + 1)))
        p = (counts[0] + 0.1) / (words + 0.1 * (types + 1))
        # state 0 is the empty history; then the seen histories by length
        state, fail, weight, made = [], [np.zeros(1, np.int64)], [np.zeros(1)], 1
        for k in range(order - 1):
            s = np.zeros(len(counts[k]), np.int64)
            seen = np.flatnonzero(counts[k] > 0)
            s[seen] = made + np.arange(len(seen))
            made += len(seen)
            if k:
                suffix_state = state[k - 1][g.suffix[k]]
                s = np.where(s > 0, s, suffix_state)   # an unseen history acts as its suffix
                fail.append(suffix_state[seen])
            else:
                fail.append(np.zeros(len(seen), np.int64))
            weight.append(np.log10(mu / (counts[k][seen] + mu)))
            state.append(s)
        self.fail, self.weight, self.n_words = np.concatenate(fail), np.concatenate(weight), g.n_words
        self.unknown = float(np.log10(0.1 / (words + 0.1 * (types + 1))))
        seen = np.flatnonzero(counts[0] > 0)
        src, tok, lp = [np.zeros(len(seen), np.int64)], [seen], [np.log10(p[seen])]
        dst = [state[0][seen] if order > 1 else np.zeros(len(seen), np.int64)]
        for k in range(1, order):
            p = (counts[k] + mu * p[g.suffix[k]]) / (counts[k - 1][g.prefix[k]] + mu)
            seen = np.flatnonzero(counts[k] > 0)
            src.append(state[k - 1][g.prefix[k][seen]])
            tok.append(g.last[k][seen])
            lp.append(np.log10(p[seen]))
            dst.append(state[k][seen] if k < order - 1 else state[k - 1][g.suffix[k][seen]])
        key = np.concatenate(src) * np.int64(self.n_words) + np.concatenate(tok)
        order_ = np.argsort(key)
        self.arc, self.lp, self.dst = key[order_], np.concatenate(lp)[order_], np.concatenate(dst)[order_]
        self.start = state[0]

    def read(self, g: Grams, start: int) -> np.ndarray:
        """Log10 probability of each text: all texts of the block advance by
        one word at a time, each with its own state."""
        total = np.zeros(len(g.size))
        if not len(g.size):
            return total
        initial = self.start[start] if len(self.start) else 0
        by_len = np.argsort(-g.size, kind="stable")
        size, first = g.size[by_len], g.first[by_len]
        state, acc = np.full(len(size), initial, np.int64), np.zeros(len(size))
        for t in range(1, int(size[0])):
            active = int(np.searchsorted(-size, -t, "left"))   # texts with size > t
            tok = g.tok[first[:active] + t]
            todo = np.arange(active)
            while len(todo):
                want = state[todo] * np.int64(self.n_words) + tok[todo]
                at = np.minimum(np.searchsorted(self.arc, want), len(self.arc) - 1) if len(self.arc) else np.zeros(len(todo), np.int64)
                hit = self.arc[at] == want if len(self.arc) else np.zeros(len(todo), bool)
                ok = todo[hit]
                acc[ok] += self.lp[at[hit]]
                state[ok] = self.dst[at[hit]]
                todo = todo[~hit]
                root = state[todo] == 0
                acc[todo[root]] += self.unknown
                todo = todo[~root]
                acc[todo] += self.weight[state[todo]]
                state[todo] = self.fail[state[todo]]
        total[by_len] = acc
        return total


def score_block(texts: pa.Table, replies: pa.Table, order: int, mu: float, words: int, types: int) -> pa.Table:
    train = texts["train"].to_numpy()
    g = Grams(string_array(texts["text"]), train * texts["copies"].to_numpy(), order)
    _, at = g.sorted_keys()
    counts = np.concatenate(g.count)
    if replies.num_rows:
        totals = np.concatenate([unplanes(x, np.int64) for x in replies.sort_by("part")["totals"].to_pylist()])
        counts[at] = np.where(totals > 0, totals, counts[at])
    cut = np.cumsum([len(h) for h in g.hash])[:-1]
    counts = np.split(counts, cut)
    known = counts[0] > 0
    auto = Automaton(g, counts, order, mu, words, types)
    start = int(np.searchsorted(g.hash[0], START)) if len(g.hash[0]) else 0
    score = auto.read(g, start)
    emitted = np.ones(len(g.tok))
    emitted[g.first] = 0.0
    owner = np.repeat(np.arange(len(g.size)), g.size)
    n = len(g.size)
    known_n = np.rint(np.bincount(owner, weights=emitted * known[g.tok], minlength=n)).astype(np.int64)
    base = np.bincount(owner, weights=emitted * auto.base[g.tok], minlength=n)
    return pa.table([texts["doc_id"].combine_chunks(), pa.array(~train), pa.array(g.size - 1), pa.array(known_n),
                     pa.array(np.full(n, words, np.int64)), pa.array(base), pa.array(score), texts["copies"].combine_chunks()], schema=SCORES)


def _word_counts() -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hs, ends = [], 0
            for _, part in slices(string_array(batch.column(0))):
                h, _ = word_hashes(part)
                hs.append(h)
                ends += len(part)
            key, n = np.unique(np.concatenate([*hs, np.full(ends, END, U)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], names=["key", "n"])
    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal rows of a batch as one row with their number."""
    for batch in batches:
        t = pa.Table.from_batches([batch]).group_by(batch.schema.names).aggregate([([], "count_all")])
        t = t.rename_columns({"count_all": "copies"}).select([*batch.schema.names, "copies"])
        yield from t.combine_chunks().to_batches()


def deal(rows: DataFrame, blocks: int) -> DataFrame:
    """doc_id, train, text, copies, block. Rows of one id (or none) are dealt
    by their texts; equal ones meet in one block, as one row for each batch."""
    merged = rows.select("doc_id", "train", "text").mapInArrow(_merged, "doc_id bigint, train boolean, text string, copies bigint")
    return merged.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, order: int = 2,
                mu: float = 20.0, block_chars: int = 5 << 20) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    prepared(spark)
    train = F.coalesce(bucket_of(F.col(id_col), folds) != 0, F.lit(True))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), train.alias("train"), text_or_empty(F.col(text_col)).alias("text"))
    counted = (rows.where("train").select("text").mapInArrow(_word_counts(), "key bigint, n bigint")
               .groupBy("key").agg(F.sum("n").alias("n")).agg(F.sum("n"), F.count(F.lit(1))).first())
    words, types = int(counted[0] or 0), int(counted[1] or 0)
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))
    dealt = deal(rows, blocks)
    packed = dealt.groupBy("block").applyInArrow(lambda key, t: count_block(key, t, order, blocks), PACKED_SQL)
    replies = packed.groupBy("part").applyInArrow(lambda key, t: add_up(t), TOTALS_SQL)
    scored = dealt.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(
        lambda a, b: score_block(a, b, order, mu, words, types),
        "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, copies bigint")
    return scored.select(*SCORES.names[:-1], F.explode_outer(F.sequence(F.lit(1).cast("bigint"), "copies")).alias("copy")).drop("copy")
