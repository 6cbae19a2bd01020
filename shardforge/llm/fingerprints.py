"""Context-triggered piecewise hashing of documents.

A rolling hash over the last seven bytes of the UTF-8 text triggers a chunk
end wherever it equals block - 1 modulo the block size; every chunk adds one
of 64 characters, chosen by the chunk's own hash, to the signature. The block
size is the least 3 * 2^k that lets 64 chunks of that size cover the text; it
is halved while the signature has fewer than 32 characters, as in repetitive
texts with few different windows. The signature for twice the block size is kept
too, so that texts whose sizes differ by a factor of two share a block size. What follows the 63rd chunk end
is one last chunk. The fingerprint is ``block:signature:signature of 2 * block``.

Likeness of two fingerprints is 1 - d / (length sum) of the signatures at an
equal block size (the better of two such pairs), d being the edit distance
with insertions and deletions; 0 when no block size fits, or when the
signatures share no run of four characters (or the whole of a shorter one);
equal fingerprints have likeness 1.

Neighbours in id order are found without a single-task sort: the rows are
range-partitioned by id, each partition is read in order with one row held
back, and the first and last row of every partition are paired afterwards.

Defined results: null text is empty, its fingerprint is ``3::``; rows with
equal ids follow each other by text; a null id comes last in descending order;
a single row is its own neighbour; an empty table gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shardforge.llm.common import prepared, text_or_empty, written
from shardforge.llm.textarrays import BYTE, U, mix

ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
SIG, WINDOW, MIN_BLOCK = 64, 7, 3
CUT = 1 << 20


def rolling(data: np.ndarray) -> np.ndarray:
    """Hash of the seven bytes that end at each place (fewer at the start)."""
    h = np.zeros(len(data), U)
    v = BYTE[data]
    for k in range(min(WINDOW, len(v))):
        h[k:] += v[:len(v) - k] << U(k)
    return (mix(h) >> U(20)).astype(np.uint32)


def chunk_chars(data: np.ndarray, ends: np.ndarray) -> bytes:
    """One character for each chunk; ``ends`` are the chunk ends, ascending."""
    out, lo = [], 0
    for hi in ends.tolist():
        h = hashlib.blake2b(data[lo:hi].tobytes(), digest_size=4).digest()
        out.append(ALPHABET[h[0] & 63])
        lo = hi
    return bytes(out)


def signature(data: np.ndarray, roll: np.ndarray, block: int) -> str:
    ends = np.flatnonzero(roll % np.uint32(block) == block - 1) + 1
    ends = ends[:SIG - 1]
    if len(data) and (not len(ends) or ends[-1] != len(data)):
        ends = np.append(ends, len(data))
    return chunk_chars(data, ends).decode()


def fingerprint(text: str) -> str:
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    block = MIN_BLOCK
    while block * SIG < len(data):
        block *= 2
    # the rolling hash needs only its window, so a long text is hashed in cuts
    roll = np.empty(len(data), np.uint32)
    for lo in range(0, len(data), CUT):
        back = max(0, lo - WINDOW + 1)
        roll[lo:lo + CUT] = rolling(data[back:lo + CUT])[lo - back:]
    own, double = signature(data, roll, block), signature(data, roll, 2 * block)
    while block > MIN_BLOCK and len(own) < SIG // 2:
        block //= 2
        own, double = signature(data, roll, block), own
    return f"{block}:{own}:{double}"


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit vectors."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for ch in b:
        u = v & where.get(ch, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def _alike(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    n = min(4, len(a), len(b))
    runs = {a[i:i + n] for i in range(len(a) - n + 1)}
    if not any(b[i:i + n] in runs for i in range(len(b) - n + 1)):
        return 0.0
    return 2.0 * common_subsequence(a, b) / (len(a) + len(b))


def likeness(x: str, y: str) -> float:
    if x == y:
        return 1.0
    bx, sx, dx = x.split(":")
    by, sy, dy = y.split(":")
    nx, ny = int(bx), int(by)
    if nx == ny:
        return max(_alike(sx, sy), _alike(dx, dy))
    if nx == 2 * ny:
        return _alike(sx, dy)
    if ny == 2 * nx:
        return _alike(dx, sy)
    return 0.0


def edited(text: str, donor: str) -> str:
    n = len(text) // 2
    return text[:len(text) - n] + donor[:n]


def compared(doc_id, text: str, own: str, donor: str, donor_print: str) -> tuple:
    new = edited(text, donor)
    mark = fingerprint(new)
    return (doc_id, len(text), hashlib.sha256(new.encode("utf-8", "replace")).hexdigest(), own, mark,
            likeness(own, mark), likeness(own, donor_print))


COLS = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
OPEN = COLS + ", part int, place int, text string"
ARROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                   ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
ARROW_OPEN = pa.schema([*ARROW, ("part", pa.int32()), ("place", pa.int32()), ("text", pa.string())])


def _chunk(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Finished rows, and as open rows (place 0 and 1, with text) the first
    and the last of the partition; the last has no partner yet."""
    part, held, out, first = TaskContext.get().partitionId(), None, [], True
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = fingerprint(text)
            if first:
                out.append((doc_id, None, None, own, None, None, None, part, 0, text))
                first = False
            else:
                out.append(compared(*held, text, own) + (None, None, None))
            held = (doc_id, text, own)
            if len(out) >= 500:
                yield _chunk(out, ARROW_OPEN)
                out = []
    if held is not None:
        out.append((held[0], None, None, held[2], None, None, None, part, 1, held[1]))
    if out:
        yield _chunk(out, ARROW_OPEN)


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [compared(r["doc_id"], r["text"], r["fingerprint"], r["donor"], r["donor_print"]) for r in batch.to_pylist()]
        if rows:
            yield _chunk(rows, ARROW)


def fingerprint_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                           part_chars: int = 16 << 20) -> DataFrame:
    """Fingerprints of each document, of its edited text (second half replaced
    by the start of the next document in descending id order), and likeness
    to the edited text and to the next document."""
    spark = docs.sparkSession
    prepared(spark)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_or_empty(F.col(text_col)).alias("text"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), chars // part_chars + 1)
    order = [F.col("doc_id").desc_nulls_last(), F.col("text").desc()]
    # ranges are drawn from ids alone: the sample that goes to the driver holds
    # the sort key, which must not be whole texts
    done = written(rows.repartitionByRange(n, order[0]).sortWithinPartitions(*order).mapInArrow(_stream, OPEN))
    closed = done.where("part is null").select(*ARROW.names)
    # one first and one last row for each partition: the last is paired with
    # the first of the next partition, the last of all with the first of all
    ends = done.where("part is not null").select("doc_id", "fingerprint", "part", "place", "text")
    by_part = Window.orderBy("part")
    # the window sees part numbers only; the texts come by a join on them
    following = ends.where("place = 0").select("part").select(
        "part", F.coalesce(F.lead("part").over(by_part), F.first("part").over(by_part)).alias("next_part"))
    donors = ends.where("place = 0").select(F.col("part").alias("next_part"), F.col("text").alias("donor"), F.col("fingerprint").alias("donor_print"))
    pairs = (ends.where("place = 1").select("part", "doc_id", "text", "fingerprint").join(following, "part").join(donors, "next_part")
             .select("doc_id", "text", "fingerprint", "donor", "donor_print"))
    return closed.unionByName(pairs.mapInArrow(_close, COLS))
