"""Files of any Hadoop file system, from the driver: small metadata only."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


class Appender:
    """An open file of the driver."""

    def __init__(self, stream):
        self._stream = stream

    def write(self, content: bytes) -> None:
        self._stream.write(bytearray(content))
        self._stream.hsync()

    def close(self) -> None:
        self._stream.close()


class LocalAppender(Appender):
    """One of the local file system, without the JVM: bytes pass its gateway as text, which takes longer than the sync."""

    def write(self, content: bytes) -> None:
        self._stream.write(content)
        self._stream.flush()
        os.fsync(self._stream.fileno())


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self._path(f"{self.root}/{name}")

    def uri(self) -> str:
        """The folder with its scheme."""
        return self.fs.makeQualified(self._path(self.root)).toUri().toString()

    def any(self, pattern: str) -> bool:
        """Whether the folder has a file like this; names stay in the JVM, since there may be many."""
        return len(self.fs.globStatus(self.path(pattern)) or ()) > 0

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def list(self, name: str) -> list[str]:
        """Names in a folder, sorted; none if there is no such folder."""
        if not self.exists(name):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(name)) if not s.getPath().getName().startswith("."))

    def read(self, name: str) -> bytes:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def create(self, name: str, content: bytes) -> bool:
        """Writes a new file under another name and renames it; False if the name is taken."""
        if self.exists(name):
            return False
        folder, _, base = name.rpartition("/")
        temp = self.path(f"{folder}/.{base}.{self._jvm.java.util.UUID.randomUUID()}")
        stream = self.fs.create(temp, False)
        try:
            stream.write(bytearray(content))
            stream.hsync()
        finally:
            stream.close()
        if self.exists(name) or not self.fs.rename(temp, self.path(name)):
            self.fs.delete(temp, False)
            return False
        return True

    def appender(self, name: str) -> Appender | None:
        """A new file that grows batch by batch, each one durable where the file system can sync; None if the name is taken."""
        if self.exists(name):
            return None
        if self.fs.getScheme() != "file":
            return Appender(self.fs.create(self.path(name), False))
        at = self.path(name).toUri().getPath()
        os.makedirs(os.path.dirname(at), exist_ok=True)
        try:
            return LocalAppender(open(at, "xb"))
        except FileExistsError:
            return None

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def mkdirs(self, name: str) -> None:
        self.fs.mkdirs(self.path(name) if name else self._path(self.root))
