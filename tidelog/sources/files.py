"""Files of a store, through Hadoop's FileSystem, so on any store that Spark reads."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

from ..schema import InvalidArgument, StoreIOError


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder, gone when the application ends, in the one that the cluster shares (spark.checkpoint.dir); a local master needs none set."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise InvalidArgument("spark.checkpoint.dir must name a folder that driver and executors share")
        shared = os.path.join(tempfile.gettempdir(), f"tidelog-scratch-{os.getpid()}")
    path = f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    return path


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")
        self.fs = self._path(self.root).getFileSystem(self.conf)

    def _path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def _do(self, what, *args):
        try:
            return what(*args)
        except Exception as e:
            raise StoreIOError(str(e).splitlines()[0]) from e

    def make_dirs(self, path: str) -> None:
        self._do(self.fs.mkdirs, self._path(path))

    def exists(self, path: str) -> bool:
        return self._do(self.fs.exists, self._path(path))

    def names(self, path: str) -> list[str]:
        """Names in a folder, in order; none where it is not there."""
        if not self.exists(path):
            return []
        return sorted(s.getPath().getName() for s in self._do(self.fs.listStatus, self._path(path)))

    def sizes(self, path: str) -> dict[str, int]:
        """Sizes of all files below a folder, by their paths in it; hidden files left out."""
        if not self.exists(path):
            return {}
        top = self._do(self.fs.getFileStatus, self._path(path)).getPath().toString()
        found, each = {}, self._do(self.fs.listFiles, self._path(path), True)
        while each.hasNext():
            s = each.next()
            name = s.getPath().toString()[len(top) + 1 :]
            if not name.rpartition("/")[2].startswith((".", "_")):
                found[name] = s.getLen()
        return found

    def read(self, path: str) -> bytes:
        stream = self._do(self.fs.open, self._path(path))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def write(self, path: str, data: bytes) -> None:
        """Whole or not at all: written beside, forced to disk, then renamed over."""
        beside = f"{path}.tmp"
        stream = self._do(self.fs.create, self._path(beside), True)
        try:
            stream.write(data)
            stream.hsync()
        finally:
            stream.close()
        uri = self._path(self.root).toUri()
        contexts = self.jvm.org.apache.hadoop.fs.FileContext
        context = contexts.getFileContext(uri, self.conf) if uri.getScheme() else contexts.getFileContext(self.conf)
        self._do(context.rename, self._path(beside), self._path(path), self._overwrite())

    def _overwrite(self):
        from pyspark import SparkContext

        gateway = SparkContext._gateway
        array = gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        array[0] = self.jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        return array

    def rename(self, a: str, b: str) -> None:
        if not self._do(self.fs.rename, self._path(a), self._path(b)):
            raise StoreIOError(f"cannot rename {a} to {b}")

    def remove(self, path: str) -> None:
        self._do(self.fs.delete, self._path(path), True)
