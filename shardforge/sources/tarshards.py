"""``tarshards``: a Python DataSource that writes and reads numbered tar
shards (F1, F2).

Writing: each row is one sample ``(shard, key, <ext columns>...)``; every
column other than ``shard`` and ``key`` becomes a tar member
``<key>.<column>``: BINARY as is, strings, numbers, booleans, decimals, dates
and timestamps as text that the reader turns back into the same value; other
types are an error (cast them first). The caller partitions by shard and sorts
by key inside partitions (``write_shards`` does it), so a shard is written by
exactly one task. A null key or shard, or one key twice in a shard, is an error.

Commit protocol: a task writes each shard under a name of its own attempt and
returns name, rows, size and SHA-256 of the file; only the driver's ``commit``
gives the files their plain names (where the store can move files) and writes
one progress record per shard to ``_progress/``. On stores without moves the
record says where the shard lies. Files of failed or repeated attempts are in
no record, so they never count; they lie below ``_attempts/<job>``, which the
commit or abort of the job deletes.

Index: behind the end of the archive, where tar readers stop, a shard carries
the offset of each row. A large shard is cut at row offsets into ranges of
about ``split_bytes``, each an input partition of its own; small shards share a
task; a shard without an index (from elsewhere) is read by one task. Rows come back long ``(shard, key,
ext, payload)`` by default, or wide when a schema with one column per
extension is given.

Compression: a member takes at least 1,024 bytes of the archive, so a shard of
short values is nearly all headers and padding. With a pattern that ends in
``.gz`` (as with webdataset's writer) shards are written through gzip, in
blocks of whole rows, each a gzip member; the index then has the blocks'
offsets in the file, so a large shard is cut as well, at blocks. Reading goes by
a file's first bytes, not its name.

All files go through ``sources.storage``: any URI that it knows is fine.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import struct
import tarfile
import time
import uuid
import zlib
from dataclasses import dataclass
from datetime import date, datetime, timezone
from decimal import Decimal

import numpy as np
from pyspark.sql import types as T
from pyspark.sql.datasource import (DataSource, DataSourceReader, DataSourceWriter,
                                    InputPartition, WriterCommitMessage)
from shardforge import constants as K
from shardforge.sources.storage import Storage, attempt_name, from_options

LONG_SCHEMA = "shard bigint, key string, ext string, payload binary"
PROGRESS = "_progress"
PROGRESS_SCHEMA = ("run_id string, shard bigint, rows bigint, bytes bigint, committed_at string, "
                   "file string, size bigint, sha256 string, params string, seq bigint")
NAME_PATTERN = K.SHARD_NAME
ROW_MARK = "__row__"   # member of a row whose columns are all null
INDEX_MAGIC = b"tarindex"
SPLIT_BYTES = 64 << 20
OPEN_BYTES = 256 << 10
GZIP_MAGIC = b"\x1f\x8b"
GZIP_BLOCK = 1 << 20     # bytes of the archive in a block; a longer row is a block
GZIP_LEVEL = 1           # headers and padding shrink as well at the fastest level
GZIP_SHRINK = 16         # how much more work than its size a compressed shard counts for a task
# the last gzip member of a shard is empty, its extra field says where the index lies
GZIP_TAIL = GZIP_MAGIC + b"\x08\x04" + bytes(5) + b"\xff\x0c\x00SI\x08\x00"
GZIP_EMPTY = b"\x03\x00" + bytes(8)


def name_regex(pattern: str) -> re.Pattern:
    """Matches the file names that ``pattern`` makes; group 1 is the shard."""
    m = re.fullmatch(r"(.*)%0?\d*d(.*)", pattern)
    if not m:
        raise ValueError(f"tarshards: pattern {pattern!r} needs one %d field")
    return re.compile(f"^{re.escape(m[1])}(\\d+){re.escape(m[2])}$")


def escape_key(key: str) -> str:
    """A member name splits at its first dot and at slashes, so those are
    written as percent codes inside keys."""
    return key.replace("%", "%25").replace(".", "%2E").replace("/", "%2F")


def unescape_key(key: str) -> str:
    return key.replace("%2F", "/").replace("%2E", ".").replace("%25", "%")


def shard_file_name(shard: int, pattern: str = NAME_PATTERN) -> str:
    return pattern % shard


# --- values ------------------------------------------------------------------


def member_bytes(v) -> bytes:
    if isinstance(v, (bytes, bytearray, memoryview)):
        return bytes(v)
    if isinstance(v, bool):
        return b"true" if v else b"false"
    if isinstance(v, datetime):       # a timestamp is written in UTC, one without zone as it is
        return (v.astimezone(timezone.utc) if v.tzinfo else v).isoformat().encode()
    if isinstance(v, date):
        return v.isoformat().encode()
    return str(v).encode("utf-8")


def _boolean(s: str) -> bool:
    if s not in ("true", "false"):
        raise ValueError(f"tarshards: {s!r} is no boolean")
    return s == "true"


def _timestamp(s: str) -> datetime:
    t = datetime.fromisoformat(s)
    return t if t.tzinfo else t.replace(tzinfo=timezone.utc)


_READ = {T.StringType: str, T.BooleanType: _boolean, T.ByteType: int, T.ShortType: int, T.IntegerType: int, T.LongType: int,
         T.FloatType: float, T.DoubleType: float, T.DecimalType: Decimal, T.DateType: date.fromisoformat,
         T.TimestampType: _timestamp, T.TimestampNTZType: datetime.fromisoformat}


def check_types(fields, doing: str) -> None:
    for f in fields:
        if not isinstance(f.dataType, T.BinaryType) and type(f.dataType) not in _READ:
            raise ValueError(f"tarshards: can't {doing} column {f.name} of type {f.dataType.simpleString()}; cast it first")


def member_value(data: bytes | None, t):
    if data is None or isinstance(t, T.BinaryType):
        return data
    return _READ[type(t)](data.decode("utf-8"))


# --- writing -----------------------------------------------------------------


class _Digesting:
    """A stream that knows its position and digest."""

    def __init__(self, out):
        self.out, self.pos, self.sha = out, 0, hashlib.sha256()

    def write(self, data) -> int:
        self.out.write(data)
        self.sha.update(data)
        self.pos += len(data)
        return len(data)

    def tell(self) -> int:
        return self.pos


class _Blocks:
    """Compresses what it gets into gzip members, a new one after each ``cut``."""

    def __init__(self, out):
        self.out, self.pos, self.filled, self.zip = out, 0, 0, None

    def write(self, data) -> int:
        if self.zip is None:
            self.zip = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 16 + zlib.MAX_WBITS)
        if packed := self.zip.compress(data):
            self.out.write(packed)
        self.filled += len(data)
        self.pos += len(data)
        return len(data)

    def tell(self) -> int:
        return self.pos

    def cut(self) -> None:
        if self.zip is not None:
            self.out.write(self.zip.flush())
            self.zip, self.filled = None, 0


class ShardFileWriter:
    """One tar shard, written row by row."""

    def __init__(self, out, compress: bool = False):
        self.stream = _Digesting(out)
        self.blocks = _Blocks(self.stream) if compress else None
        self.tar = tarfile.open(fileobj=self.blocks or self.stream, mode="w", format=tarfile.PAX_FORMAT)
        self.starts, self.rows, self.bytes, self.last = [], 0, 0, None

    def add(self, key: str, members: dict[str, bytes]) -> None:
        name = escape_key(key)
        if name == self.last:
            raise ValueError(f"tarshards: the key {key!r} occurs twice in a shard; number repeated rows first")
        self.last = name
        self.rows += 1
        if self.blocks is not None and self.blocks.filled >= GZIP_BLOCK:
            self.blocks.cut()
        if self.blocks is None or self.blocks.zip is None:
            self.starts.append(self.stream.pos)
        # a null is an absent member; a row without members keeps a mark
        for ext, data in (members or {ROW_MARK: b""}).items():
            info = tarfile.TarInfo(name=f"{name}.{ext}")
            info.size = len(data)
            info.mtime = 0
            self.tar.addfile(info, io.BytesIO(data))
            self.tar.members = []        # tarfile would keep every header
            self.bytes += len(data)

    def close(self) -> None:
        if self.blocks is not None:
            self.blocks.cut()
        end = self.stream.pos
        self.tar.close()
        index = np.array([*self.starts, end], "<i8").tobytes()
        if self.blocks is None:
            self.stream.write(index + struct.pack("<q", len(self.starts) + 1) + INDEX_MAGIC)
        else:
            self.blocks.cut()
            at = self.stream.pos
            self.blocks.write(index)
            self.blocks.cut()
            self.stream.write(GZIP_TAIL + struct.pack("<q", at) + GZIP_EMPTY)
        self.stream.out.close()


def read_index(store: Storage, name: str, size: int) -> np.ndarray | None:
    """Row offsets and the end of the last row, of a compressed shard those of
    its blocks; None without an index."""
    with store.open_read(name) as f:
        packed_tail = len(GZIP_TAIL) + 8 + len(GZIP_EMPTY)
        tail = f.read_at(packed_tail, max(0, size - packed_tail))
        if len(tail) == packed_tail and tail.startswith(GZIP_TAIL) and tail.endswith(GZIP_EMPTY):
            at = struct.unpack_from("<q", tail, len(GZIP_TAIL))[0]
            return np.frombuffer(zlib.decompress(f.read_at(size - packed_tail - at, at), 16 + zlib.MAX_WBITS), "<i8")
        tail = tail[-16:]
        if len(tail) < 16 or tail[8:] != INDEX_MAGIC:
            return None
        n = struct.unpack("<q", tail[:8])[0]
        return np.frombuffer(f.read_at(8 * n, size - 16 - 8 * n), "<i8")


@dataclass
class ShardCommit(WriterCommitMessage):
    files: list  # (shard, attempt's name, rows, payload bytes, file size, sha256)


class TarShardsWriter(DataSourceWriter):
    def __init__(self, options, schema: T.StructType, overwrite: bool):
        if not options.get("path"):
            raise ValueError("tarshards: a path is required")
        self.store = from_options(options["path"], options.get("schemes"))
        self.pattern = options.get("pattern", NAME_PATTERN)
        self.run_id = options.get("run_id", "run")
        self.params = options.get("params")
        self.overwrite = overwrite
        columns = [f.name for f in schema.fields]
        for need in ("shard", "key"):
            if need not in columns:
                raise ValueError(f"tarshards: input needs a '{need}' column")
        check_types([f for f in schema.fields if f.name != "shard"], "write")
        self.members = [c for c in columns if c not in ("shard", "key")]
        self.job = uuid.uuid4().hex
        name_regex(self.pattern)

    def write(self, iterator):
        files, shard, writer, name, seen = [], None, None, None, set()

        def close():
            if writer is not None:
                writer.close()
                files.append((shard, name, writer.rows, writer.bytes, writer.stream.pos, writer.stream.sha.hexdigest()))

        for row in iterator:
            if row["shard"] is None or row["key"] is None:
                raise ValueError("tarshards: null shard or key")
            if int(row["shard"]) != shard:
                close()
                shard = int(row["shard"])
                if shard in seen:
                    raise ValueError(f"tarshards: rows of shard {shard} are not contiguous in the task; "
                                     "partition by shard and sort by key first")
                seen.add(shard)
                name = attempt_name(self.job, shard_file_name(shard, self.pattern))
                writer = ShardFileWriter(self.store.open_write(name), self.pattern.endswith(".gz"))
            writer.add(str(row["key"]), {m: member_bytes(row[m]) for m in self.members if row[m] is not None})
        close()
        return ShardCommit(files=files)

    def commit(self, messages):
        files = [f for m in messages if m is not None for f in m.files]
        shards = [f[0] for f in files]
        if len(shards) != len(set(shards)):
            self.abort(messages)
            raise ValueError("tarshards: a shard was written by more than one task")
        stale = []
        if self.overwrite:
            # progress goes first: a stop in between leaves shards that a
            # resume writes again, never records of shards that are gone
            plain = {shard_file_name(s, self.pattern) for s in shards}
            stale = [f.name for f in committed_files(self.store, self.pattern) if f.name not in plain]
            self.store.delete_tree(PROGRESS)
        now, seq = time.strftime("%Y-%m-%d %H:%M:%S", time.gmtime()), time.time_ns()
        records = []
        for shard, temp, rows, nbytes, size, sha in files:
            records.append({"run_id": self.run_id, "shard": shard, "rows": rows, "bytes": nbytes, "committed_at": now,
                            "file": self.store.settle(temp, shard_file_name(shard, self.pattern)), "size": size, "sha256": sha,
                            "params": self.params, "seq": seq})
        if records:
            self.store.write_record(PROGRESS, records, self.run_id)
        for name in stale:
            self.store.delete(name)
        self.store.drop_attempts(self.job, {r["file"] for r in records})

    def abort(self, messages):
        self.store.drop_attempts(self.job)


# --- reading -----------------------------------------------------------------


@dataclass(frozen=True)
class CommittedShard:
    shard: int
    name: str       # below the folder
    size: int
    modified: float


def committed_files(store: Storage, pattern: str = NAME_PATTERN) -> list[CommittedShard]:
    """The shards of a folder: files with plain names, and on stores without
    moves those that the records list and that still exist. One small row per
    shard."""
    plain = name_regex(pattern)
    found = {int(m[1]): CommittedShard(int(m[1]), f.name, f.size, f.modified) for f in store.list() if (m := plain.match(f.name))}
    if not store.can_move:
        latest = {}
        for r in store.records(PROGRESS):
            if r.get("file") and r.get("seq", 0) >= latest.get(r["shard"], {}).get("seq", 0):
                latest[r["shard"]] = r
        there = {f.name: f for f in store.list(recursive=True)}
        for shard, r in latest.items():
            f = there.get(r["file"])
            if f is not None and plain.match(r["file"].rsplit("/", 1)[-1]):
                found[shard] = CommittedShard(shard, f.name, f.size, f.modified)
    return sorted(found.values(), key=lambda f: f.name)


@dataclass(frozen=True)
class ShardRange:
    """Rows of a shard whose headers begin in start..end (end None: all); of a
    compressed shard the rows of the blocks that lie there. ``size`` is for
    sharing out the work."""
    shard: int
    name: str
    size: int
    start: int = 0
    end: int | None = None


class ShardRanges(InputPartition):
    """One task's share: a range of a large shard, or several small shards."""

    def __init__(self, ranges: list):
        super().__init__(len(ranges))
        self.ranges = ranges


def dealt(ranges: list, most: int, cores: int) -> list:
    """Consecutive ranges put together up to a task's share of all bytes, at
    most ``most``; a file counts some bytes more for its opening."""
    weight = [r.size + OPEN_BYTES for r in ranges]
    share = min(most, max(OPEN_BYTES, sum(weight) // max(1, cores)))
    out, filled = [], share
    for r, w in zip(ranges, weight):
        if filled + w > share:
            out.append([])
            filled = 0
        out[-1].append(r)
        filled += w
    return [ShardRanges(x) for x in out]


def ranges_of(store: Storage, f: CommittedShard, split_bytes: int) -> list[ShardRange]:
    """A large shard with an index, cut at rows into about equal ranges."""
    times = GZIP_SHRINK if f.name.endswith(".gz") else 1
    whole = [ShardRange(f.shard, f.name, f.size * times)]
    if f.size * times <= split_bytes:
        return whole
    starts = read_index(store, f.name, f.size)
    if starts is None:
        return whole
    pieces = -(-int(starts[-1]) * times // split_bytes)
    wanted = np.arange(pieces) * (int(starts[-1]) / pieces)
    cuts = np.unique(np.append(starts[np.searchsorted(starts[:-1], wanted)], starts[-1]))
    return [ShardRange(f.shard, f.name, int(b - a) * times, int(a), int(b)) for a, b in zip(cuts, cuts[1:])]


class _Until:
    """A file that ends at ``end`` (None: where it ends)."""

    def __init__(self, f, end: int | None):
        self.f, self.end = f, end

    def read(self, n: int) -> bytes:
        return self.f.read(n if self.end is None else max(0, min(n, self.end - self.f.tell())))


class TarShardsReader(DataSourceReader):
    def __init__(self, options, schema: T.StructType):
        self.store = from_options(options["path"], options.get("schemes"))
        self.schema = schema
        wanted = options.get("shards")
        self.wanted = None if not wanted else {int(s) for s in wanted.split(",") if s.strip()}
        self.exts = options.get("exts")
        self.exts = None if not self.exts else set(self.exts.split(","))
        self.pattern = options.get("pattern", NAME_PATTERN)
        self.split_bytes = int(options.get("split_bytes", SPLIT_BYTES))
        self.cores = int(options.get("cores", 1))
        check_types([f for f in schema.fields if f.name != "shard"], "read")

    def partitions(self):
        out = []
        for f in committed_files(self.store, self.pattern):
            if self.wanted is None or f.shard in self.wanted:
                out += ranges_of(self.store, f, self.split_bytes)
        # without any shard Spark would call read(None)
        return dealt(out, self.split_bytes, self.cores) or [ShardRanges([])]

    def read(self, partition: ShardRanges):
        for r in partition.ranges:
            yield from self._read_range(r)

    def _read_range(self, partition: ShardRange):
        names = [f.name for f in self.schema.fields]
        long_form = names == ["shard", "key", "ext", "payload"]
        types = {f.name: f.dataType for f in self.schema.fields}

        def row(key, record):
            own = {"shard": partition.shard, "key": key}
            return tuple(own[n] if n in own else member_value(record.get(n), types[n]) for n in names)

        with self.store.open_read(partition.name) as f:
            packed = f.read_at(2, partition.start) == GZIP_MAGIC
            f.seek(partition.start)
            end = None if packed else partition.end
            if packed:
                tar = tarfile.open(fileobj=gzip.GzipFile(fileobj=_Until(f, partition.end), mode="rb"), mode="r|")
            else:
                tar = tarfile.open(fileobj=f, mode="r:")
            current, record = None, {}
            while (info := tar.next()) is not None and (end is None or info.offset < end):
                tar.members = []
                base = info.name.rsplit("/", 1)[-1]
                if not info.isfile() or "." not in base:
                    continue
                key, ext = base.split(".", 1)
                key = unescape_key(key)
                if ext == ROW_MARK:
                    if long_form:
                        continue
                elif self.exts is not None and ext not in self.exts:
                    continue
                data = tar.extractfile(info).read()
                if long_form:
                    yield (partition.shard, key, ext, data)
                    continue
                if key != current:
                    if current is not None:
                        yield row(current, record)
                    current, record = key, {}
                if ext != ROW_MARK:
                    record[ext] = data
            if not long_form and current is not None:
                yield row(current, record)


class TarShardsDataSource(DataSource):
    @classmethod
    def name(cls):
        return "tarshards"

    def schema(self):
        return LONG_SCHEMA

    def reader(self, schema):
        return TarShardsReader(self.options, schema)

    def writer(self, schema, overwrite):
        return TarShardsWriter(self.options, schema, overwrite)


def write_shards(df, path: str, run_id: str = "run", mode: str = "append",
                 num_partitions: int | None = None, grouped: bool = False, pattern: str = NAME_PATTERN,
                 params: str | None = None) -> None:
    """Partition by shard (so each shard is one task's output), sort by key
    inside partitions and write through the data source. ``grouped=True``
    says every shard's rows already sit together in one partition (shards
    numbered per partition), so no shuffle is needed. ``params`` goes into the
    progress records: what the shards were made with."""
    from pyspark.sql import functions as F

    from shardforge.session import register_sources
    from shardforge.sources.storage import as_option, storage
    spark = df.sparkSession
    register_sources(spark)
    if not grouped:
        n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
        df = df.repartition(n, F.col("shard")).sortWithinPartitions("shard", "key")
    w = df.write.format("tarshards").mode(mode).option("run_id", run_id).option("pattern", pattern)
    if params is not None:
        w = w.option("params", params)
    w.option("schemes", as_option(storage(spark, path))).save(path)


def read_shards(spark, path: str, schema: str | None = None, shards=None, exts=None, pattern: str = NAME_PATTERN,
                split_bytes: int = SPLIT_BYTES):
    from shardforge.session import register_sources
    from shardforge.sources.storage import as_option, storage
    register_sources(spark)
    r = spark.read.format("tarshards").option("pattern", pattern).option("split_bytes", split_bytes)
    r = r.option("cores", spark.sparkContext.defaultParallelism)
    r = r.option("schemes", as_option(storage(spark, path)))
    if schema:
        r = r.schema(schema)
    if shards is not None:
        r = r.option("shards", ",".join(str(int(s)) for s in shards))
    if exts is not None:
        r = r.option("exts", ",".join(exts))
    return r.load(path)


def read_progress(spark, path: str):
    """The committed progress records of a shard folder, read by one task per
    record file (a file per commit)."""
    from shardforge.session import ship_package
    from shardforge.sources.storage import storage
    ship_package(spark)
    store = storage(spark, path).below(PROGRESS)
    names = [(f.name,) for f in store.list() if f.name.endswith(".json")]
    if not names:
        return spark.createDataFrame([], PROGRESS_SCHEMA)

    def load(batches):
        import pyarrow as pa
        for b in batches:
            for name in b.column("name").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(store.read(name).decode().splitlines())], ["line"])

    lines = spark.createDataFrame(names, "name string").repartition(min(len(names), 64)).mapInArrow(load, "line string")
    from pyspark.sql import functions as F
    return lines.select(F.from_json("line", PROGRESS_SCHEMA).alias("r")).select("r.*")
