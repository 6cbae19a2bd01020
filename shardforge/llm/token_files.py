"""Token-id files with keyed access through minimal perfect hashes.

Files of one data set, below one folder:

* ``ids-NNNNN-*.bin``: a shard, the raw little-endian ids of its documents one
  after the other, in 2 bytes where the vocabulary fits, else in 4;
* ``ids-NNNNN-*.off``: for each document of the shard where it begins, in ids,
  then the shard's length (little-endian 64-bit);
* ``index-NNNNN-*.mph``: of the keys of one bucket a minimal perfect hash and,
  in the order of its slots, a record for each key: 64-bit fingerprint, shard,
  place in the shard, offset and length in ids, number of documents with this
  key (they follow each other);
* ``manifest.json``: shards with their first document and first id, index
  files, widths, number of buckets. It is written last; files that it doesn't
  name don't count, so attempts that were lost leave nothing to clean up for
  the reader.

Writing: the rows are range partitioned and sorted by (key, text hash, row), so
a repeated key is split over shards like any other rows. Each task encodes its
rows and writes one shard as it goes. Only small rows (key, shard, place,
offset, length) go on, for the index.

Encoding: a tokenizer that never joins anything across white space is given
each distinct word of a batch once (and words that the worker still remembers
not at all); the ids of a text are those of its words in order. What else may be
told apart is a parameter (``WordEncoder``). ``across_spaces=True`` is for
tokenizers that don't work like this: whole texts are encoded. The end id
follows each document.

Reading by key: keys are dealt to buckets, looked up in the bucket's index (a
slot whose fingerprint differs means that the key isn't there), dealt to
shards, and each document's bytes are read at its offset. A single key takes
one bucket's bits, one record and one range of a shard: ``find``.

Defined results: a null text is empty (its document is the end id alone); a
null id is a key of its own and comes first; rows with equal ids are all kept,
in the order of their texts' hashes; an empty table gives a manifest without
shards. Other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import sha256
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shardforge.llm.common import prepared, text_or_empty, written
from shardforge.llm.exact_dedup import PerfectHash
from shardforge.llm.textarrays import raw_bytes, slices, string_array
from shardforge.session import estimated_bytes
from shardforge.sources.storage import Storage, storage, unique_name

MANIFEST = "manifest.json"
ENTRY = "id bigint, shard int, stem string, place bigint, start bigint, n_tokens bigint"
SLOT = np.dtype([("fingerprint", "<u8"), ("shard", "<i4"), ("place", "<i8"), ("start", "<i8"), ("n", "<i8"), ("rows", "<i8")])


# --- encoding ----------------------------------------------------------------


class WordEncoder:
    """Texts to ids, piece by piece, with a bounded memory of pieces.

    ``marks``: characters that the tokenizer always separates from an ASCII
    letter before them; words are cut there, so that a word is the same piece
    with and without a mark. ``fold_case``: the tokenizer lower-cases. Words
    with combining marks or the first character of one of the tokenizer's
    added tokens are left as they are."""

    def __init__(self, path: str, end_id: int, across_spaces: bool = False, marks: str = "", fold_case: bool = False,
                 remember: int = 1 << 19, joined: int = 4096):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"     # Spark has one task per core already
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.end, self.across, self.remember, self.joined = end_id, across_spaces, remember, joined
        self.cut = re.escape(marks) and f"([A-Za-z])([{re.escape(marks)}])"
        self.fold = fold_case
        added = {t.content[0] for t in self.tokenizer.get_added_tokens_decoder().values() if t.content}
        # left as they are; a letter with a combining mark may be composed
        # before case is folded
        self.raw = f"[\\p{{M}}{''.join(map(re.escape, sorted(added)))}]"
        self._forget()

    def _forget(self) -> None:
        self.at: dict[str, int] = {}       # piece to its number
        self.pool, self.ends = array("I"), array("q", [0])

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str], counts: np.ndarray, ids: list[int]) -> None:
        n, first = len(self.at), self.ends[-1]
        self.at.update(zip(pieces, range(n, n + len(pieces))))
        self.pool.extend(ids)
        self.ends.extend((first + np.cumsum(counts)).tolist())

    def _learn_letters(self, pieces: list[str]) -> None:
        """Many words of letters in one call: each is one unit of the
        tokenizer, whose number each id carries."""
        for k in range(0, len(pieces), self.joined):
            part = pieces[k:k + self.joined]
            e = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            counts = np.bincount(np.array(e.word_ids, np.int64), minlength=len(part))
            if len(counts) == len(part) and counts.all():
                self._learn(part, counts, e.ids)
            else:
                self._learn_others(part)

    def _learn_others(self, pieces: list[str]) -> None:
        lists = self._ids(pieces)
        self._learn(pieces, np.array([len(x) for x in lists], np.int64), [i for x in lists for i in x])

    def _pieces(self, words: pa.Array) -> pa.ListArray:
        """The pieces of each word."""
        plain = words
        if self.cut:
            plain = pc.replace_substring_regex(plain, self.cut, r"\1 \2")
        if self.fold:
            plain = pc.ascii_lower(plain)
        if self.cut or self.fold:
            plain = pc.if_else(pc.match_substring_regex(words, self.raw), words, plain)
        return pc.ascii_split_whitespace(plain)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each document followed by the end id, and the documents'
        offsets."""
        n = len(texts)
        if self.across:
            lists = self._ids(texts.to_pylist())
            counts = np.array([len(x) + 1 for x in lists], np.int64)
            ids = np.fromiter((i for x in lists for i in (*x, self.end)), np.uint32, int(counts.sum()))
            return ids, np.concatenate([[0], np.cumsum(counts)])
        split = pc.ascii_split_whitespace(texts)
        at = split.offsets.to_numpy()
        words = split.flatten().dictionary_encode()
        cut = self._pieces(words.dictionary)
        pieces = cut.flatten().dictionary_encode()
        listed = pieces.dictionary
        letters = pc.match_substring_regex(listed, r"^\p{L}+$").to_numpy(zero_copy_only=False)
        names = listed.to_numpy(zero_copy_only=False).tolist()
        known = np.fromiter(map(self.at.get, names, repeat(-1)), np.int64, len(names))
        if len(self.at) + int((known < 0).sum()) > self.remember:
            self._forget()
            known[:] = -1
        for learn, which in ((self._learn_letters, letters), (self._learn_others, ~letters)):
            new = np.flatnonzero((known < 0) & which)
            known[new] = len(self.at) + np.arange(len(new))
            learn([names[i] for i in new])
        ends, pool = np.array(self.ends), np.array(self.pool, np.uint32)
        # the ids of each distinct word, then of the end, which is one more
        # word behind each document's words
        piece, piece_at = pieces.indices.to_numpy(), cut.offsets.to_numpy()
        first, size = ends[known][piece], (ends[known + 1] - ends[known])[piece]
        of_words = np.append(pool[_runs(first, size)], np.uint32(self.end))
        word_at = np.append(np.concatenate([[0], np.cumsum(size)])[piece_at], len(of_words))
        word = np.insert(words.indices.to_numpy(), at[1:] - at[0], len(word_at) - 2)
        # the bytes of the words' ids, copied word by word
        spelt = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(word_at) - 1, [None, pa.py_buffer(4 * word_at), pa.py_buffer(of_words)])
        raw, _ = raw_bytes(spelt.take(pa.array(word)))
        ends_of = np.concatenate([[0], np.cumsum(np.diff(word_at)[word])])
        return raw.view(np.uint32), ends_of[np.concatenate([[0], np.cumsum(np.diff(at) + 1)])]


def _runs(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each run, one run behind the other."""
    stop = np.cumsum(count)
    return np.arange(int(stop[-1]) if len(stop) else 0) + np.repeat(first - (stop - count), count)


@lru_cache(maxsize=2)
def encoder(path: str, end_id: int, options: tuple) -> WordEncoder:
    """One for all tasks of a worker process."""
    return WordEncoder(path, end_id, **dict(options))


def width_of(vocabulary: int) -> int:
    return 2 if vocabulary <= 1 << 16 else 4


# --- shards ------------------------------------------------------------------


def shard_writer(store: Storage, tokenizer: str, end_id: int, width: int, options: tuple):
    """Task: one shard from the sorted rows of a partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        stem = unique_name(f"ids-{number:05d}", "")
        out, total, place, starts = None, 0, 0, []
        for batch in batches:
            texts = string_array(batch["text"])
            for lo, part in slices(texts, 4 << 20):
                if out is None:
                    out = store.open_write(stem + ".bin")
                ids, offs = encoder(tokenizer, end_id, options).encode(part)
                if len(ids) and int(ids.max()) >= 1 << 8 * width:
                    raise ValueError(f"an id needs more than {width} bytes")
                out.write(ids.astype(f"<u{width}").tobytes())
                k = len(part)
                starts.append(total + offs[:-1])
                yield pa.RecordBatch.from_arrays([
                    batch["id"].slice(lo, k), pa.array(np.full(k, number, np.int32)), pa.array([stem] * k),
                    pa.array(np.arange(place, place + k)), pa.array(total + offs[:-1]), pa.array(np.diff(offs))],
                    ["id", "shard", "stem", "place", "start", "n_tokens"])
                total, place = total + int(offs[-1]), place + k
        if out is not None:
            out.close()
            store.write(stem + ".off", np.concatenate([*starts, [total]]).astype("<i8").tobytes())
    return run


# --- index -------------------------------------------------------------------


def key_digest(c: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(c.cast("string"), F.lit("null")).cast("binary"), 256))


def bucket_column(digest: Column, buckets: int) -> Column:
    return F.conv(F.hex(F.substring(digest, 1, 4)), 16, 10).cast("bigint") % buckets


def _digest_array(col) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint8).reshape(-1, 32)


def _fingerprints(digests: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(digests).view("<u8")[:, 3]


def pack_index(mph: PerfectHash, slots: np.ndarray) -> bytes:
    """Number of levels, their sizes, their bits, then the records."""
    head = np.array([len(mph.bits), len(slots)] + [len(b) for b in mph.bits], "<i8").tobytes()
    return head + b"".join(np.packbits(b).tobytes() for b in mph.bits) + slots.tobytes()


def unpack_hash(f) -> tuple[PerfectHash, int, int]:
    """The hash from an index file, the place of its records, their number."""
    levels, n = np.frombuffer(f.read_at(16, 0), "<i8")
    sizes = np.frombuffer(f.read_at(8 * int(levels), 16), "<i8")
    mph, pos, total = PerfectHash.__new__(PerfectHash), 16 + 8 * int(levels), 0
    mph.bits, mph.before = [], []
    for size in sizes:
        raw = f.read_at(-(-int(size) // 8), pos)
        alone = np.unpackbits(np.frombuffer(raw, np.uint8), count=int(size)).astype(bool)
        mph.bits.append(alone)
        mph.before.append(total + np.cumsum(alone) - alone)
        total += int(alone.sum())
        pos += len(raw)
    return mph, pos, int(n)


def index_writer(store: Storage):
    """Task: the index of one bucket's distinct keys."""
    def run(t: pa.Table) -> pa.Table:
        bucket = t["bucket"][0].as_py()
        digests = _digest_array(t["digest"])
        mph = PerfectHash(digests)
        at = mph.slots(digests)
        slots = np.zeros(len(digests), SLOT)
        slots["fingerprint"][at] = _fingerprints(digests)
        for c in ("shard", "place", "start", "n", "rows"):
            slots[c][at] = t[c].to_numpy()
        name = unique_name(f"index-{bucket:05d}", ".mph")
        store.write(name, pack_index(mph, slots))
        return pa.table({"bucket": [bucket], "file": [name], "n_keys": [len(digests)]})
    return run


@dataclass
class TokenFiles:
    """A written data set: its folder and manifest."""
    store: Storage
    manifest: dict

    @staticmethod
    def load(spark: SparkSession, uri: str) -> TokenFiles:
        store = storage(spark, uri)
        return TokenFiles(store, json.loads(store.read(MANIFEST)))

    def find(self, key: int | None) -> list[np.ndarray]:
        """The ids of the documents with this key, without Spark."""
        digest = sha256(("null" if key is None else str(key)).encode()).digest()
        m = self.manifest
        if not m["buckets"]:
            return []
        name = m["index"].get(str(int.from_bytes(digest[:4], "big") % m["buckets"]))
        if name is None:
            return []
        hit = lookup_keys(self.store, name, np.frombuffer(digest, np.uint8).reshape(1, 32))[0]
        if hit is None:
            return []
        out = []
        nth = shard_order(m)[int(hit["shard"])]
        for k, place, rows in spans(m, nth, int(hit["place"]), int(hit["rows"])):
            out += [ids for _, ids in read_documents(self.store, m, m["shards"][k], place, rows)]
        return out


def write_token_files(docs: DataFrame, uri: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
                      shard_bytes: int = 64 << 20, bucket_keys: int = 20000, **options) -> TokenFiles:
    """Encode and write all rows; the data set. ``tokenizer`` is the path of a
    tokenizer file that all executors have, ``options`` go to WordEncoder. ``shard_bytes``: input bytes of a
    shard, by the optimiser's estimate."""
    from tokenizers import Tokenizer
    spark = docs.sparkSession
    prepared(spark)
    store = storage(spark, uri)
    width = width_of(max(Tokenizer.from_file(tokenizer).get_vocab_size(with_added_tokens=True), end_id + 1))
    text = text_or_empty(F.col(f"`{text_col}`"))
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), text.alias("text"),
                       F.xxhash64(text).alias("tie"), F.monotonically_increasing_id().alias("row"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), estimated_bytes(docs) // shard_bytes)
    rows = rows.repartitionByRange(parts, "id", "tie", "row").sortWithinPartitions("id", "tie", "row").select("id", "text")
    entries = written(rows.mapInArrow(shard_writer(store, tokenizer, end_id, width, tuple(sorted(options.items()))), ENTRY))

    # one small row per shard file and per index file
    shards = (entries.groupBy("shard", "stem").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_tokens").alias("ids"))
              .orderBy("shard").collect())
    listed, first_doc, first_id = [], 0, 0
    for s in shards:
        listed.append({"shard": s["shard"], "stem": s["stem"], "first_doc": first_doc, "first_id": first_id,
                       "docs": s["docs"], "ids": s["ids"]})
        first_doc, first_id = first_doc + s["docs"], first_id + s["ids"]
    at = F.struct("shard", "place", "start", "n_tokens")
    keys = entries.groupBy("id").agg(F.min(at).alias("m"), F.count(F.lit(1)).alias("rows"))
    buckets = -(-first_doc // bucket_keys)
    index = {}
    if buckets:
        keyed = keys.select(key_digest(F.col("id")).alias("digest"), "rows", F.col("m.shard").alias("shard"), F.col("m.place").alias("place"),
                            F.col("m.start").alias("start"), F.col("m.n_tokens").alias("n"))
        keyed = keyed.withColumn("bucket", bucket_column(F.col("digest"), buckets))
        files = keyed.groupBy("bucket").applyInArrow(index_writer(store), "bucket bigint, file string, n_keys bigint").collect()
        index = {str(f["bucket"]): f["file"] for f in files}
    manifest = {"width": width, "end_id": end_id, "docs": first_doc, "ids": first_id, "buckets": buckets, "shards": listed, "index": index}
    store.write(MANIFEST, json.dumps(manifest).encode())
    return TokenFiles(store, manifest)


# --- reading -----------------------------------------------------------------


def lookup_keys(store: Storage, name: str, digests: np.ndarray) -> list:
    """The record of each key, None for keys that aren't there. One key's
    record is read alone, those of many keys with the whole file."""
    with store.open_read(name) as f:
        mph, pos, n = unpack_hash(f)
        at = mph.slots(digests)
        if len(digests) == 1:
            raw = f.read_at(SLOT.itemsize, pos + SLOT.itemsize * int(at[0])) if at[0] >= 0 else b"\0" * SLOT.itemsize
            slots = np.frombuffer(raw, SLOT)
        else:
            slots = np.frombuffer(f.read_at(SLOT.itemsize * n, pos), SLOT)[np.maximum(at, 0)]
    there = (at >= 0) & (slots["fingerprint"] == _fingerprints(digests))
    return [s if ok else None for s, ok in zip(slots, there)]


@lru_cache(maxsize=4)
def load_manifest(store: Storage) -> dict:
    """Read once in each worker, so that tasks don't carry it."""
    return json.loads(store.read(MANIFEST))


def shard_order(manifest: dict) -> dict[int, int]:
    """Shard number to its place in the list."""
    return {s["shard"]: i for i, s in enumerate(manifest["shards"])}


def spans(manifest: dict, k: int, place: int, rows: int) -> Iterator[tuple[int, int, int]]:
    """(place in the list of shards, place, rows) of consecutive documents."""
    listed = manifest["shards"]
    while rows:
        here = min(rows, listed[k]["docs"] - place)
        yield k, place, here
        k, place, rows = k + 1, 0, rows - here


def read_documents(store: Storage, manifest: dict, shard: dict, place: int, rows: int, files: dict | None = None):
    """(first id in the data set, ids) of consecutive documents of a shard;
    ``files`` keeps opened files for the next call."""
    width, files = manifest["width"], files if files is not None else {}
    bin_name, off_name = shard["stem"] + ".bin", shard["stem"] + ".off"
    if bin_name not in files:
        for f in files.values():
            f.close()
        files.clear()
        for name in (bin_name, off_name):
            files[name] = store.open_read(name)
    block = 4096
    for lo in range(place, place + rows, block):
        k = min(block, place + rows - lo)
        offs = np.frombuffer(files[off_name].read_at(8 * (k + 1), 8 * lo), "<i8")
        for i in range(k):
            a, b = int(offs[i]), int(offs[i + 1])
            raw = files[bin_name].read_at(width * (b - a), width * a)
            yield shard["first_id"] + a, np.frombuffer(raw, f"<u{width}").astype("<u4")


def key_finder(store: Storage):
    """Task: keys of one bucket to places in shards."""
    def run(t: pa.Table) -> pa.Table:
        manifest = load_manifest(store)
        order = shard_order(manifest)
        name = manifest["index"].get(str(t["bucket"][0].as_py()))
        ids, out = t["id"].to_pylist(), ([], [], [], [])
        if name is not None:
            for key, hit in zip(ids, lookup_keys(store, name, _digest_array(t["digest"]))):
                if hit is None:
                    continue
                for nth, place, rows in spans(manifest, order[int(hit["shard"])], int(hit["place"]), int(hit["rows"])):
                    for col, v in zip(out, (key, nth, place, rows)):
                        col.append(v)
        return pa.table([pa.array(c, pa.int64()) for c in out], names=["id", "nth", "place", "rows"])
    return run


def document_reader(store: Storage, max_bytes: int = 8 << 20):
    """Task: the documents at the given places, sorted by shard and place."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        manifest = load_manifest(store)
        names, files, cols, size = ["id", "start", "n_tokens", "ids"], {}, ([], [], [], []), 0

        def flush():
            types = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(cols, types)], names)
        for batch in batches:
            for r in batch.to_pylist():
                shard = manifest["shards"][r["nth"]]
                for start, ids in read_documents(store, manifest, shard, r["place"], r["rows"], files):
                    for c, v in zip(cols, (r["id"], start, len(ids), ids.tobytes())):
                        c.append(v)
                    size += 4 * len(ids)
                    if size >= max_bytes:
                        yield flush()
                        for c in cols:
                            c.clear()
                        size = 0
        if cols[0]:
            yield flush()
        for f in files.values():
            f.close()
    return run


def read_by_key(files: TokenFiles, keys: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, start (ids of all documents before it), n_tokens, ids (little-endian
    32-bit) of every document with one of the keys; each key counts once."""
    spark, m = keys.sparkSession, files.manifest
    schema = "id bigint, start bigint, n_tokens bigint, ids binary"
    if not m["buckets"]:
        return spark.createDataFrame([], schema)
    prepared(spark)
    wanted = keys.select(F.col(f"`{id_col}`").cast("bigint").alias("id")).distinct().withColumn("digest", key_digest(F.col("id")))
    wanted = wanted.withColumn("bucket", bucket_column(F.col("digest"), m["buckets"]))
    found = wanted.groupBy("bucket").applyInArrow(key_finder(files.store), "id bigint, nth bigint, place bigint, rows bigint")
    dealt = found.repartition(len(m["shards"]), "nth").sortWithinPartitions("nth", "place")
    return dealt.mapInArrow(document_reader(files.store), schema)
