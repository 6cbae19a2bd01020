"""One way to files for every reader and writer: a base URI and names below it.

Tasks that write tar, PNG or pack files run in Python workers, so the layer is
Arrow's filesystem API: ``file:`` and plain paths, ``s3://`` (and ``s3a://``),
``gs://``, ``hdfs://`` come with it, and any other scheme is added with
``register_scheme`` (a ``module:function`` that returns an Arrow filesystem and
the path in it; it must be importable on the executors).

Commits need no rename. An object store has none, and a copy of every file at
the end of a job would double its writes. A task writes under a name that no
other attempt uses (``unique_name``, ``attempt_name``); the job's commit then
writes one small record that lists the files that count, and readers take
listed files only. Where files can be moved (``can_move``: local and mounted
folders, HDFS), ``settle`` gives a listed file its plain name as well; elsewhere
it keeps the name it was written under.
"""

from __future__ import annotations

import importlib
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow.fs as pafs
from pyspark.sql import SparkSession

CONF = "spark.shardforge.fs."
_MOVES = ("local", "hdfs")       # a move is one cheap, atomic step
ATTEMPTS = "_attempts"
BLOCK = 4 << 20


@dataclass(frozen=True)
class FileInfo:
    name: str        # below the base
    size: int
    modified: float  # seconds; 0 where the store doesn't say


def _factory(spec: str):
    module, _, function = spec.partition(":")
    return getattr(importlib.import_module(module), function)


def scheme_of(uri: str) -> str:
    m = re.match(r"([A-Za-z][A-Za-z0-9+.\-]*):", uri)
    return m[1].lower() if m else "file"


@lru_cache(maxsize=256)
def _resolve(uri: str, schemes: tuple) -> tuple[pafs.FileSystem, str]:
    scheme = scheme_of(uri)
    known = dict(schemes)
    if scheme in known:
        return _factory(known[scheme])(uri)
    if scheme == "file":
        path = re.sub(r"^file:(//)?", "", uri) if uri.startswith("file:") else uri
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri))


@dataclass(frozen=True)
class Storage:
    """Files below ``base``. Picklable; connects on first use in a process."""
    base: str
    schemes: tuple = ()

    def at(self, name: str) -> tuple[pafs.FileSystem, str]:
        fs, root = _resolve(self.base, self.schemes)
        return fs, f"{root.rstrip('/')}/{name}" if name else root.rstrip("/")

    def below(self, folder: str) -> Storage:
        return Storage(f"{self.base.rstrip('/')}/{folder}", self.schemes)

    def uri(self, name: str) -> str:
        return f"{self.base.rstrip('/')}/{name}"

    def open_write(self, name: str):
        """A stream. Folders are made only when one is missing: in stores
        that have none this is never the case. Bytes are written as they are;
        Arrow itself would compress what is named ``.gz``."""
        fs, path = self.at(name)
        try:
            return fs.open_output_stream(path, compression=None, buffer_size=1 << 20)
        except FileNotFoundError:
            fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
            return fs.open_output_stream(path, compression=None, buffer_size=1 << 20)

    def open_read(self, name: str):
        """A file that can seek."""
        fs, path = self.at(name)
        return fs.open_input_file(path)

    def write(self, name: str, data: bytes) -> None:
        with self.open_write(name) as out:
            out.write(data)

    def read(self, name: str) -> bytes:
        with self.open_read(name) as f:
            return f.read()

    def read_range(self, name: str, start: int, size: int) -> bytes:
        with self.open_read(name) as f:
            return f.read_at(size, start)

    def list(self, recursive: bool = False) -> list[FileInfo]:
        """The files below the base (hidden ones too), by name."""
        fs, root = self.at("")
        found = fs.get_file_info(pafs.FileSelector(root, recursive=recursive, allow_not_found=True))
        cut = len(root.rstrip("/")) + 1
        return sorted((FileInfo(i.path[cut:], i.size, i.mtime.timestamp() if i.mtime else 0.0)
                       for i in found if i.type == pafs.FileType.File), key=lambda i: i.name)

    def exists(self, name: str) -> bool:
        fs, path = self.at(name)
        return fs.get_file_info(path).type == pafs.FileType.File

    def delete(self, name: str) -> None:
        fs, path = self.at(name)
        try:
            fs.delete_file(path)
        except FileNotFoundError:
            pass

    def size(self, name: str) -> int:
        """Bytes of a file, -1 if there is none."""
        fs, path = self.at(name)
        info = fs.get_file_info(path)
        return info.size if info.type == pafs.FileType.File else -1

    def copy_to(self, name: str, other: Storage, other_name: str, block: int = BLOCK) -> int:
        """Stream a file elsewhere, where it appears whole; its bytes."""
        total = 0
        with self.open_read(name) as src:
            temp = hidden_name(other_name) if other.can_move else other_name
            with other.open_write(temp) as dst:
                while chunk := src.read(block):
                    dst.write(chunk)
                    total += len(chunk)
        if temp != other_name:
            other.move(temp, other_name)
        return total

    def blocks(self, name: str, block: int = BLOCK) -> Iterator[bytes]:
        with self.open_read(name) as src:
            while chunk := src.read(block):
                yield chunk

    # commits

    @property
    def can_move(self) -> bool:
        fs = self.at("")[0]
        return (fs.base_fs.type_name if isinstance(fs, pafs.SubTreeFileSystem) else fs.type_name) in _MOVES

    def move(self, name: str, to: str) -> None:
        fs, path = self.at(name)
        target = self.at(to)[1]
        fs.create_dir(target.rsplit("/", 1)[0], recursive=True)
        fs.move(path, target)

    def settle(self, name: str, plain: str) -> str:
        """The name under which a committed file is found."""
        if not self.can_move:
            return name
        self.move(name, plain)
        return plain

    def put(self, name: str, data: bytes) -> None:
        """A small file that is there whole or not at all."""
        if not self.can_move:
            self.write(name, data)      # a store without moves shows a file once it is closed
            return
        temp = hidden_name(name)
        self.write(temp, data)
        self.move(temp, name)

    def delete_tree(self, folder: str) -> None:
        """The files below a folder of this store."""
        if not folder:
            raise ValueError("delete_tree needs a folder below the base")
        fs, path = self.at(folder)
        try:
            fs.delete_dir(path)
        except FileNotFoundError:
            pass

    def drop_attempts(self, job: str, but: set[str] = frozenset()) -> None:
        """Delete what the attempts of a job left behind, but for the names
        in ``but`` (committed files that couldn't be moved)."""
        folder = f"{ATTEMPTS}/{job}"
        if not any(n.startswith(folder) for n in but):
            self.delete_tree(folder)
            if self.can_move and not self.below(ATTEMPTS).list(recursive=True):
                self.delete_tree(ATTEMPTS)
            return
        for f in self.below(folder).list(recursive=True):
            if f"{folder}/{f.name}" not in but:
                self.delete(f"{folder}/{f.name}")

    def write_at(self, name: str, offset: int, data: bytes) -> None:
        """Bytes at a place of an existing file: for local and mounted
        folders; Arrow's interface has no such call, and stores neither."""
        fs, path = self.at(name)
        if fs.type_name != "local":
            raise ValueError(f"{scheme_of(self.base)}: files can't be written in places")
        with open(path, "r+b") as f:
            f.seek(offset)
            f.write(data)

    # records of what counts

    def write_record(self, folder: str, records: list[dict], label: str = "commit") -> str:
        """One JSON-lines file with a name of its own."""
        name = f"{folder}/{label}-{uuid.uuid4().hex}.json"
        self.write(name, ("\n".join(json.dumps(r) for r in records) + "\n").encode())
        return name

    def records(self, folder: str) -> list[dict]:
        """All records of a folder, in the order of their files' names."""
        out = []
        for info in self.below(folder).list():
            if info.name.endswith(".json"):
                text = self.read(f"{folder}/{info.name}").decode()
                out += [json.loads(line) for line in text.splitlines() if line]
        return out


def unique_name(stem: str, suffix: str) -> str:
    """A name that no other attempt of the same task uses."""
    return f"{stem}-{uuid.uuid4().hex[:12]}{suffix}"


def hidden_name(name: str) -> str:
    """A name beside ``name`` that readers pass over."""
    folder, _, base = name.rpartition("/")
    return unique_name(f"{folder}/.{base}" if folder else f".{base}", ".tmp")


def attempt_name(job: str, name: str) -> str:
    """Where one attempt of a task of ``job`` writes the file ``name``."""
    return f"{ATTEMPTS}/{job}/{uuid.uuid4().hex}/{name}"


def register_scheme(spark: SparkSession, scheme: str, factory: str) -> None:
    """``factory``: ``module:function`` from a URI to (Arrow filesystem, path)."""
    spark.conf.set(CONF + scheme.lower(), factory)


def schemes_of(spark: SparkSession) -> tuple:
    return tuple(sorted((k[len(CONF):], v) for k, v in spark.conf.getAll.items() if k.startswith(CONF)))


def storage(spark: SparkSession, uri: str) -> Storage:
    return Storage(uri, schemes_of(spark))


def as_option(s: Storage) -> str:
    """For data source options."""
    return json.dumps(s.schemes)


def from_options(path: str, schemes: str | None) -> Storage:
    return Storage(path, tuple(tuple(x) for x in json.loads(schemes or "[]")))
