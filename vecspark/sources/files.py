"""Small files and folders on whatever file system Spark reaches."""

from __future__ import annotations

import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Files:
    """Names, text files, renames and copies, by Hadoop's file systems."""

    def __init__(self, spark: SparkSession):
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.conf)

    def exists(self, path: str) -> bool:
        p, fs = self._path(path)
        return fs.exists(p)

    def names(self, path: str) -> list[str]:
        p, fs = self._path(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def sizes(self, path: str) -> dict[str, int]:
        """Lengths of the data files of a folder."""
        p, fs = self._path(path)
        return {s.getPath().getName(): s.getLen() for s in fs.listStatus(p) if s.isFile() and not s.getPath().getName().startswith(("_", "."))}

    def make(self, path: str) -> None:
        p, fs = self._path(path)
        fs.mkdirs(p)

    def read(self, path: str) -> str:
        p, fs = self._path(path)
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """Writes beside and renames over, so that a reader sees the old or the new."""
        beside = f"{path}.{uuid.uuid4().hex}.tmp"
        p, fs = self._path(beside)
        stream = fs.create(p, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        self.rename(beside, path, replace=True)

    def create(self, path: str, text: str) -> bool:
        """Writes a file that isn't there yet; False if there is one."""
        p, fs = self._path(path)
        try:
            stream = fs.create(p, False)
        except Py4JJavaError as e:
            if fs.exists(p):
                return False
            raise OSError(f"{path} can't be written") from e
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        return True

    def age(self, path: str) -> float:
        """Seconds since a file or folder was changed."""
        p, fs = self._path(path)
        return time.time() - fs.getFileStatus(p).getModificationTime() / 1000

    def rename(self, old: str, new: str, replace: bool = False) -> None:
        a, fs = self._path(old)
        b, _ = self._path(new)
        if replace:
            context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(a.toUri(), self.conf)
            options = self.jvm.org.apache.hadoop.fs.Options
            overwrite = self.jvm.java.lang.reflect.Array.newInstance(options.Rename.OVERWRITE.getClass(), 1)
            overwrite[0] = options.Rename.OVERWRITE
            context.rename(fs.makeQualified(a), fs.makeQualified(b), overwrite)
        elif not fs.rename(a, b):
            raise OSError(f"{old} can't be renamed to {new}")

    def copy(self, old: str, new: str) -> None:
        a, fs = self._path(old)
        b, fs2 = self._path(new)
        self.jvm.org.apache.hadoop.fs.FileUtil.copy(fs, a, fs2, b, False, self.conf)

    def delete(self, path: str) -> None:
        p, fs = self._path(path)
        fs.delete(p, True)
