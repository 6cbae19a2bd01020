"""``objects://name/path``: an object store in a local folder. Files appear
when they are closed, there are no renames, appends or writes in places, and
folders don't exist by themselves."""

import os
import uuid

import pyarrow as pa
import pyarrow.fs as pafs

SCHEME = "objects"


class _Upload:
    """A file that is there once it is closed."""

    def __init__(self, path):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        self.path, self.temp = path, os.path.join(os.path.dirname(path), f".upload-{uuid.uuid4().hex}")
        self.f, self.closed = open(self.temp, "wb"), False

    def write(self, data):
        return self.f.write(data)

    def tell(self):
        return self.f.tell()

    def flush(self):
        pass

    def writable(self):
        return True

    def readable(self):
        return False

    def seekable(self):
        return False

    def close(self):
        if not self.closed:
            self.closed = True
            self.f.close()
            os.replace(self.temp, self.path)


class Objects(pafs.FileSystemHandler):
    def __eq__(self, other):
        return isinstance(other, Objects)

    def get_type_name(self):
        return SCHEME

    def normalize_path(self, path):
        return path

    def _info(self, path):
        if os.path.isdir(path):
            return pafs.FileInfo(path, pafs.FileType.Directory)
        if os.path.isfile(path):
            return pafs.FileInfo(path, pafs.FileType.File, size=os.path.getsize(path), mtime=os.path.getmtime(path))
        return pafs.FileInfo(path, pafs.FileType.NotFound)

    def get_file_info(self, paths):
        return [self._info(p) for p in paths]

    def get_file_info_selector(self, selector):
        out = []
        for root, dirs, files in os.walk(selector.base_dir):
            out += [self._info(os.path.join(root, f)) for f in files if not f.startswith(".upload-")]
            if not selector.recursive:
                break
        return out

    def create_dir(self, path, recursive):
        raise NotImplementedError("no folders here")

    def delete_dir(self, path):
        for root, _, files in os.walk(path):
            for f in files:
                os.remove(os.path.join(root, f))

    def delete_dir_contents(self, path, missing_dir_ok=False):
        self.delete_dir(path)

    def delete_root_dir_contents(self):
        raise NotImplementedError

    def delete_file(self, path):
        os.remove(path)

    def move(self, src, dest):
        raise NotImplementedError("no renames here")

    def copy_file(self, src, dest):
        raise NotImplementedError

    def open_input_stream(self, path):
        return pa.PythonFile(open(path, "rb"), mode="r")

    def open_input_file(self, path):
        return pa.PythonFile(open(path, "rb"), mode="r")

    def open_output_stream(self, path, metadata):
        return pa.PythonFile(_Upload(path), mode="w")

    def open_append_stream(self, path, metadata):
        raise NotImplementedError


def connect(uri):
    """objects://tmp/x -> /tmp/x"""
    return pafs.PyFileSystem(Objects()), "/" + uri.split("://", 1)[1]


def use(spark):
    from shardforge.sources.storage import register_scheme
    spark.sparkContext.addPyFile(__file__)
    register_scheme(spark, SCHEME, "objectstore:connect")
    return SCHEME


def uri(path):
    return f"{SCHEME}://{str(path).lstrip('/')}"
