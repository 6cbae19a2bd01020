"""``imagefolder``: numbered PNG files ``{index:06d}.png`` (F4).

Sink: a Python DataSource writer; each task writes its rows' PNG files into
a folder of its own and moves them itself once all are written, so a failed
task leaves no visible image and the driver handles no file names (on stores
without moves an image is written under its name at once: such files appear
whole). A failed job leaves the images of its finished tasks; a rerun writes
them again under the same names. ``_SUCCESS`` marks a finished write. Source: Spark's ``binaryFile`` reader with a glob,
the index parsed from the file name by ``regexp_extract``, and the PNG
decoded per Arrow batch.

The PNG codec is the standard library's zlib plus the five PNG row filters
(8-bit grey, RGB or RGBA, no interlace) — enough for what the sink writes
and for ordinary encoder output."""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType
from shardforge import constants as K
from shardforge.sources.storage import attempt_name, from_options

_IMAGE, _DONE = re.compile(r"\d+\.png$"), "_SUCCESS"
_SIG = b"\x89PNG\r\n\x1a\n"
_COLOR = {1: 0, 3: 2, 4: 6}  # channels -> PNG colour type


def _chunk(tag: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data) & 0xFFFFFFFF)


def encode_png(pixels: np.ndarray) -> bytes:
    """(H, W) or (H, W, C) uint8 -> PNG bytes (filter 0 on every row)."""
    a = np.asarray(pixels, dtype=np.uint8)
    if a.ndim == 2:
        a = a[:, :, None]
    h, w, c = a.shape
    raw = b"".join(b"\x00" + a[y].tobytes() for y in range(h))
    ihdr = struct.pack(">IIBBBBB", w, h, 8, _COLOR[c], 0, 0, 0)
    return _SIG + _chunk(b"IHDR", ihdr) + _chunk(b"IDAT", zlib.compress(raw, 6)) + _chunk(b"IEND", b"")


def decode_png(data: bytes) -> np.ndarray:
    """PNG bytes -> (H, W, C) uint8 array."""
    if data[:8] != _SIG:
        raise ValueError("not a PNG file")
    pos, idat, w = 8, [], None
    while pos < len(data):
        (n,) = struct.unpack(">I", data[pos:pos + 4])
        tag = data[pos + 4:pos + 8]
        body = data[pos + 8:pos + 8 + n]
        pos += 12 + n
        if tag == b"IHDR":
            w, h, depth, ctype, _c, _f, interlace = struct.unpack(">IIBBBBB", body)
            if depth != 8 or interlace:
                raise ValueError("only 8-bit, non-interlaced PNG is supported")
            ch = {0: 1, 2: 3, 6: 4, 4: 2}[ctype]
        elif tag == b"IDAT":
            idat.append(body)
        elif tag == b"IEND":
            break
    raw = np.frombuffer(zlib.decompress(b"".join(idat)), dtype=np.uint8)
    stride = w * ch
    out = np.zeros((h, stride), dtype=np.uint8)
    prev = np.zeros(stride, dtype=np.int32)
    for y in range(h):
        ft = raw[y * (stride + 1)]
        line = raw[y * (stride + 1) + 1:(y + 1) * (stride + 1)].astype(np.int32)
        if ft == 0:
            cur = line
        elif ft == 2:
            cur = (line + prev) & 0xFF
        else:
            cur = np.zeros(stride, dtype=np.int32)
            for x in range(stride):
                left = cur[x - ch] if x >= ch else 0
                up = prev[x]
                ul = prev[x - ch] if x >= ch else 0
                if ft == 1:
                    pred = left
                elif ft == 3:
                    pred = (left + up) >> 1
                else:
                    p = left + up - ul
                    pa, pb, pc = abs(p - left), abs(p - up), abs(p - ul)
                    pred = left if pa <= pb and pa <= pc else (up if pb <= pc else ul)
                cur[x] = (line[x] + pred) & 0xFF
        out[y] = cur
        prev = cur
    return out.reshape(h, w, ch)


@dataclass
class ImageCommit(WriterCommitMessage):
    files: int


class ImageFolderWriter(DataSourceWriter):
    """Input rows: index (int), h, w, c and pixels (BINARY, H*W*C bytes,
    row-major HWC). With ``overwrite`` the images of the folder are deleted
    before the job starts."""

    def __init__(self, options, schema: StructType, overwrite: bool):
        self.store = from_options(options["path"], options.get("schemes"))
        self.digits = int(options.get("digits", str(K.IMAGE_DIGITS)))
        self.job = uuid.uuid4().hex
        if overwrite:
            self.store.delete(_DONE)       # first: what follows is no finished folder
            for f in self.store.list():
                if _IMAGE.match(f.name):
                    self.store.delete(f.name)

    def write(self, iterator):
        names, moves = [], self.store.can_move
        folder = attempt_name(self.job, "")
        for row in iterator:
            h, w, c = int(row["h"]), int(row["w"]), int(row["c"])
            px = np.frombuffer(bytes(row["pixels"]), dtype=np.uint8)
            if px.size != h * w * c:
                raise ValueError(f"index {row['index']}: {px.size} bytes for shape {(h, w, c)}")
            name = f"{int(row['index']):0{self.digits}d}.png"
            self.store.write(folder + name if moves else name, encode_png(px.reshape(h, w, c)))
            names.append(name)
        for name in names if moves else ():
            self.store.move(folder + name, name)
        return ImageCommit(files=len(names))

    def commit(self, messages):
        # what is left here comes from attempts that were lost
        self.store.drop_attempts(self.job)
        self.store.put(_DONE, str(sum(m.files for m in messages if m)).encode())

    def abort(self, messages):
        self.store.drop_attempts(self.job)


class ImageFolderDataSource(DataSource):
    @classmethod
    def name(cls):
        return "imagefolder"

    def writer(self, schema, overwrite):
        return ImageFolderWriter(self.options, schema, overwrite)


def write_image_folder(df, path: str, mode: str = "append") -> None:
    from shardforge.session import register_sources
    from shardforge.sources.storage import as_option, storage
    register_sources(df.sparkSession)
    (df.select("index", "h", "w", "c", "pixels").write.format("imagefolder").mode(mode)
     .option("schemes", as_option(storage(df.sparkSession, path))).save(path))


def read_image_folder(spark, path: str):
    """(index, h, w, c, pixels BINARY) from ``{index}.png`` files. Listing and
    bytes come from ``binaryFile``, or, for a scheme that was registered here,
    from the storage layer; decoding runs per Arrow batch; the index is parsed
    from the name."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    from shardforge.session import ship_package
    from shardforge.sources.storage import scheme_of, schemes_of, storage
    ship_package(spark)
    if scheme_of(path) in dict(schemes_of(spark)):
        store = storage(spark, path)
        names = [(f.name,) for f in store.list() if _IMAGE.match(f.name)]

        def load(batches):
            for b in batches:
                found = b.column("path").to_pylist()
                yield pa.RecordBatch.from_arrays([b.column("path"), pa.array([store.read(n) for n in found], pa.binary())], ["path", "content"])
        listed = spark.createDataFrame(names, "path string")
        files = listed.repartition(max(1, min(len(names) // 64, 1000))).mapInArrow(load, "path string, content binary")
    else:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "[0-9]*.png").load(path)
    files = files.select(F.regexp_extract("path", r"(\d+)\.png$", 1).cast("bigint").alias("index"), "content")

    def decode(batches):
        from shardforge.sources.imagefolder import decode_png
        for b in batches:
            images = [decode_png(data) for data in b.column("content").to_pylist()]
            shape = [pa.array([a.shape[k] for a in images], pa.int32()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([b.column("index"), *shape, pa.array([a.tobytes() for a in images], pa.binary())],
                                             names=["index", "h", "w", "c", "pixels"])

    return files.mapInArrow(decode, "index bigint, h int, w int, c int, pixels binary")


def with_png(df, pixels_col: str, h: int, w: int, c: int, out_col: str = "png"):
    """Add a PNG-encoded copy of a raw pixel column (H*W*C bytes, HWC), for
    shard members such as ``<key>.png``; encoded per Arrow batch."""
    import pyarrow as pa
    from pyspark.sql.types import BinaryType, StructField, StructType

    from shardforge.session import ship_package
    ship_package(df.sparkSession)

    def enc(batches):
        from shardforge.sources.imagefolder import encode_png
        for b in batches:
            raw = b.column(pixels_col).to_pylist()
            pngs = [None if r is None else encode_png(np.frombuffer(r, dtype=np.uint8).reshape(h, w, c))
                    for r in raw]
            yield b.append_column(out_col, pa.array(pngs, pa.binary()))

    schema = StructType(list(df.schema.fields) + [StructField(out_col, BinaryType())])
    return df.mapInArrow(enc, schema)
