"""Ordered dense packs (F5): samples 0..num-1 into uint8 tensors
(num, H, W, C), written as contiguous ``.npy`` parts with a manifest.

No gather to one process: the indexes are dense, so the part of a row is its
index div rows_per_part, and one shuffle brings each part to one task. The
input runs once. Tasks write under temporary names and report one row per run
of consecutive indexes of one shape; the pack is complete when these runs are
exactly the parts. Only then are the files given their names and the manifest
(one row per part) returned.

``dense_pack`` makes one ``.npz`` file of the parts: its size and the place of
every part follow from the manifest, so tasks write their parts into one file
at the same time, and the checksum is combined from those of the parts. Only
the two headers are written by the driver."""

from __future__ import annotations

import io
import uuid
import zipfile
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardforge.sources.storage import Storage, attempt_name, hidden_name, schemes_of, storage

MANIFEST_SCHEMA = "part int, first_index bigint, rows bigint, h int, w int, c int, path string"


def pack_report(df: DataFrame, num: int, index_col: str = "index") -> DataFrame:
    """One row: expected, present (distinct in range), missing, duplicated
    indexes, out-of-range rows and distinct shapes — from two partial
    aggregations (no join): missing = expected - present."""
    idx = df.select(F.col(index_col).alias("index"), "h", "w", "c")
    in_range = (F.col("index") >= 0) & (F.col("index") < num)
    per = idx.groupBy("index").agg(F.count(F.lit(1)).alias("n"))
    counts = per.agg(F.count(F.when(in_range, F.lit(1))).alias("n_present"),
                     F.count(F.when(F.col("n") > 1, F.lit(1))).alias("n_duplicate"),
                     F.count(F.when(~in_range, F.lit(1))).alias("n_out_of_range"))
    shapes = idx.agg(F.count_distinct("h", "w", "c").alias("n_shapes"))
    both = counts.unionByName(shapes, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in ("n_present", "n_duplicate", "n_out_of_range", "n_shapes")]) \
        .select(F.lit(num).cast("bigint").alias("n_expected"), "n_present",
                (F.lit(num) - F.col("n_present")).cast("bigint").alias("n_missing"),
                "n_duplicate", "n_out_of_range", "n_shapes")


def missing_indexes(df: DataFrame, num: int, index_col: str = "index") -> DataFrame:
    """The absent indexes themselves: range(num) anti-joined with the data."""
    expected = df.sparkSession.range(num).withColumnRenamed("id", "index")
    return expected.join(df.select(F.col(index_col).alias("index")), "index", "left_anti")


RUN_SCHEMA = "first_index bigint, rows bigint, h int, w int, c int, path string"
DEFAULT_PART_ROWS = 1024


def _write_runs(batches, store: Storage, job: str, rows_per_part: int):
    """Arrow batches sorted by (part, index) -> one .npy file and one row per
    run of consecutive indexes inside a part with one shape."""
    import pyarrow as pa
    blocks, start, shape, nxt = [], None, None, None

    def flush():
        arr = np.concatenate(blocks)
        name = attempt_name(job, f"{start:020d}.npy")
        with store.open_write(name) as fh:
            np.save(fh, arr)
        h, w, c = shape
        return pa.RecordBatch.from_pydict({
            "first_index": pa.array([start], pa.int64()), "rows": pa.array([len(arr)], pa.int64()), "h": pa.array([h], pa.int32()),
            "w": pa.array([w], pa.int32()), "c": pa.array([c], pa.int32()), "path": pa.array([name], pa.string())})

    for b in batches:
        if any(b.column(k).null_count for k in ("index", "h", "w", "c", "pixels")):
            raise ValueError("pack: null index, shape or pixels")
        if not len(b):
            continue
        idx = b.column("index").to_numpy()
        hwc = np.stack([b.column(k).to_numpy() for k in ("h", "w", "c")], axis=1)
        breaks = (np.diff(idx) != 1) | (idx[1:] % rows_per_part == 0) | (np.diff(hwc, axis=0) != 0).any(axis=1)
        edges = [0, *(np.flatnonzero(breaks) + 1).tolist(), len(idx)]
        for s, e in zip(edges, edges[1:]):
            now = tuple(int(v) for v in hwc[s])
            joins = blocks and idx[s] == nxt and idx[s] % rows_per_part and now == shape
            if blocks and not joins:
                yield flush()
                blocks = []
            if not blocks:
                start, shape = int(idx[s]), now
            px = b.column("pixels").slice(s, e - s)
            raw = b"".join(px.to_pylist())
            if len(raw) != (e - s) * shape[0] * shape[1] * shape[2]:
                raise ValueError(f"pack: indexes from {int(idx[s])} have {len(raw)} bytes for {e - s} x {shape}")
            blocks.append(np.frombuffer(raw, dtype=np.uint8).reshape(e - s, *shape))
            nxt = int(idx[e - 1]) + 1
    if blocks:
        yield flush()


def pack_tensor(df: DataFrame, num: int, path: str, rows_per_part: int | None = None,
                index_col: str = "index", check: bool = True,
                target_part_bytes: int = 256 << 20, shape: tuple | None = None) -> DataFrame:
    """Write parts and return the manifest. ``df`` has index, h, w, c and
    pixels (BINARY, H*W*C bytes in HWC order); it is computed once. A part
    holds ``rows_per_part`` rows, or about ``target_part_bytes`` when the
    image ``shape`` is given, or 1024 rows (a task holds one part in memory).

    An index that occurs twice or lies outside 0..num-1 is an error. With
    ``check`` so is a missing index or a second shape; without it a hole or a
    change of shape only ends a part early. After an error nothing of the
    pack is visible."""
    from shardforge.session import ship_package
    spark = df.sparkSession
    ship_package(spark)
    if rows_per_part is None:
        rows_per_part = max(1, target_part_bytes // max(1, shape[0] * shape[1] * shape[2])) if shape else DEFAULT_PART_ROWS
    n_parts = max(1, -(-num // rows_per_part))
    store, job = storage(spark, path), uuid.uuid4().hex
    part = F.floor(F.col("index") / F.lit(rows_per_part)).cast("int")
    src = df.select(F.col(index_col).cast("bigint").alias("index"), *[F.col(k).cast("int").alias(k) for k in ("h", "w", "c")], "pixels")
    runs = (src.repartitionById(n_parts, F.coalesce(part, F.lit(0))).sortWithinPartitions("index")
            .mapInArrow(lambda batches: _write_runs(batches, store, job, rows_per_part), RUN_SCHEMA))
    kept = set()
    try:
        rows = sorted((r.asDict() for r in runs.collect()), key=lambda r: r["first_index"])  # one small row per part
        twice = sum(a["first_index"] + a["rows"] > b["first_index"] for a, b in zip(rows, rows[1:]))
        outside = sum(r["first_index"] < 0 or r["first_index"] + r["rows"] > num for r in rows)
        found = {"expected": num, "rows": sum(r["rows"] for r in rows), "runs": len(rows), "runs_with_repeats": twice,
                 "runs_out_of_range": outside, "shapes": len({(r["h"], r["w"], r["c"]) for r in rows})}
        if twice or outside or (check and (found["rows"] != num or found["shapes"] > 1)):
            raise ValueError(f"pack is not complete and uniform: {found}")
        for r in rows:
            name = store.settle(r["path"], f"part-{r['first_index']:012d}.npy")
            kept.add(name)
            r["path"] = store.uri(name)
    finally:
        store.drop_attempts(job, kept)
    return spark.createDataFrame([dict(part=i, **r) for i, r in enumerate(rows)], MANIFEST_SCHEMA)


def read_pack(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Rows (index, h, w, c, pixels) back from the parts, one task per part."""
    import pyarrow as pa

    from shardforge.session import ship_package
    ship_package(spark)
    schemes = schemes_of(spark)

    def read(batches):
        for b in batches:
            for first, p in zip(b.column("first_index").to_pylist(), b.column("path").to_pylist()):
                arr = _load(p, schemes)
                n, h, w, c = arr.shape
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(first, first + n), pa.int64()), pa.array([h] * n, pa.int32()),
                     pa.array([w] * n, pa.int32()), pa.array([c] * n, pa.int32()),
                     pa.array([arr[i].tobytes() for i in range(n)], pa.binary())],
                    names=["index", "h", "w", "c", "pixels"])

    m = manifest.select("first_index", "path")
    return m.repartition(max(1, m.count())).mapInArrow(read, "index bigint, h int, w int, c int, pixels binary")


def _part(path: str, schemes: tuple) -> tuple[Storage, str]:
    folder, name = path.rsplit("/", 1)
    return Storage(folder, schemes), name


def _load(path: str, schemes: tuple) -> np.ndarray:
    store, name = _part(path, schemes)
    with store.open_read(name) as f:
        return np.load(f)


def merge_pack(manifest: DataFrame, out_file: str) -> str:
    """Driver-side single-file ``.npz`` (arr_0) for small packs only: the
    parts are read one after another into the output array."""
    spark = manifest.sparkSession
    rows = sorted(manifest.collect(), key=lambda r: r["first_index"])
    arrays = [_load(r["path"], schemes_of(spark)) for r in rows]
    out = io.BytesIO()
    np.savez(out, arr_0=np.concatenate(arrays) if arrays else np.zeros((0,), np.uint8))
    store, name = _part(out_file, schemes_of(spark))
    store.put(name, out.getvalue())
    return out_file


# --- one dense file, written in parallel ----------------------------------------


def _times(matrix: list[int], vector: int) -> int:
    out = 0
    for i, column in enumerate(matrix):
        if vector >> i & 1:
            out ^= column
    return out


def crc32_join(first: int, second: int, second_length: int) -> int:
    """The CRC-32 of two byte strings, one behind the other, from theirs. A
    zero byte behind a string is a linear map of its CRC over GF(2); the map
    of n zero bytes comes from squaring."""
    bit = [0xEDB88320] + [1 << i for i in range(31)]       # one zero bit
    square = lambda m: [_times(m, c) for c in m]
    step, n = square(square(square(bit))), second_length
    while n:
        if n & 1:
            first = _times(step, first)
        step, n = square(step), n >> 1
    return first ^ second


class _Tail:
    """Takes what zipfile writes behind the data, at its true place."""

    def __init__(self):
        self.pos, self.data = 0, b""

    def seekable(self):
        return True

    def tell(self):
        return self.pos

    def seek(self, pos, whence=0):
        self.pos = pos
        return pos

    def write(self, data):
        self.data += data
        self.pos += len(data)
        return len(data)

    def flush(self):
        pass


def _zip_frame(member: str, size: int, crc: int) -> tuple[bytes, bytes]:
    """Header before and directory behind one stored member, as NumPy's
    ``savez`` has them."""
    info = zipfile.ZipInfo(member)
    info.external_attr = 0o600 << 16
    info.CRC, info.file_size, info.compress_size, info.header_offset = crc, size, size, 0
    head = info.FileHeader(zip64=True)
    tail = _Tail()
    z = zipfile.ZipFile(tail, "w", zipfile.ZIP_STORED)
    z.filelist.append(info)
    z.start_dir, z._didModify = len(head) + size, True
    z.close()
    return head, tail.data


def dense_pack(manifest: DataFrame, out_file: str, block: int = 4 << 20) -> str:
    """One ``.npz`` (arr_0) of all parts, byte for byte what ``merge_pack``
    writes, without a gather. The file must lie in a local or mounted folder
    (stores can't write a file in places). The parts must follow each other
    and have one shape. The file appears under its name when it is whole."""
    from shardforge.session import ship_package
    spark = manifest.sparkSession
    ship_package(spark)
    rows = sorted(manifest.collect(), key=lambda r: r["first_index"])      # one small row per part
    num, shapes = 0, {(r["h"], r["w"], r["c"]) for r in rows}
    for r in rows:
        if r["first_index"] != num or len(shapes) != 1:
            raise ValueError(f"the parts are not one tensor: index {num} is missing or shapes differ: {sorted(shapes)[:5]}")
        num += r["rows"]
    if not rows:
        return merge_pack(manifest, out_file)
    shape = next(iter(shapes))
    npy = io.BytesIO()
    np.lib.format.write_array_header_1_0(npy, {"descr": "|u1", "fortran_order": False, "shape": (num, *shape)})
    row_bytes = shape[0] * shape[1] * shape[2]
    size = len(npy.getvalue()) + num * row_bytes
    data_at = len(_zip_frame("arr_0.npy", size, 0)[0]) + len(npy.getvalue())
    schemes = schemes_of(spark)
    store, name = _part(out_file, schemes)
    temp = hidden_name(name)

    def place(batches):
        import pyarrow as pa
        for b in batches:
            out = []
            for first, path in zip(b.column("first_index").to_pylist(), b.column("path").to_pylist()):
                src, part = _part(path, schemes)
                at, crc = data_at + first * row_bytes, 0
                with src.open_read(part) as f:
                    np.lib.format.read_magic(f)
                    np.lib.format.read_array_header_1_0(f)
                    while data := f.read(block):
                        store.write_at(temp, at, data)
                        crc, at = zlib.crc32(data, crc), at + len(data)
                out.append((first, at - data_at - first * row_bytes, crc))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["first_index", "n", "crc"])

    store.write(temp, b"")
    try:
        done = (manifest.select("first_index", "path").repartition(len(rows)).mapInArrow(place, "first_index bigint, n bigint, crc bigint").collect())
        crc = zlib.crc32(npy.getvalue())
        for r in sorted(done, key=lambda r: r["first_index"]):
            crc = crc32_join(crc, r["crc"], r["n"])
        if sum(r["n"] for r in done) != num * row_bytes:
            raise ValueError("the parts don't have the bytes that the manifest says")
        head, tail = _zip_frame("arr_0.npy", size, crc)
        store.write_at(temp, 0, head + npy.getvalue())
        store.write_at(temp, len(head) + size, tail)
        store.move(temp, name)
    except BaseException:
        store.delete(temp)
        raise
    return out_file
