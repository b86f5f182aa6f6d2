"""Small files and folders in whatever store Spark reads, through Hadoop's own client. Tables never pass through here."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark.sql import SparkSession

_own: list[str] = []


class Taken(Exception):
    """Another writer has put a file of that name there."""


class Store:
    """Files below one root."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm, self.root = spark._jvm, root.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        path = self._hadoop.Path(self.root)
        self._system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        qualified = self._system.makeQualified(path)
        self._context = self._hadoop.FileContext.getFileContext(qualified.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
        self._plain = spark.sparkContext._gateway.new_array(getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _at(self, name: str):
        return self._system.makeQualified(self._hadoop.Path(self.path(name) if name else self.root))

    def names(self, folder: str) -> list[str]:
        """Names within a folder, in order; none if there is no such folder."""
        place = self._at(folder)
        return sorted(status.getPath().getName() for status in self._system.listStatus(place)) if self._system.exists(place) else []

    def changed(self, name: str) -> float:
        """Seconds since the epoch at which a file was written."""
        return self._system.getFileStatus(self._at(name)).getModificationTime() / 1000

    def read(self, name: str) -> str:
        stream = self._system.open(self._at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Put a file there in one step: readers see all of it or nothing. Raises `Taken` if the name is taken, also by a writer at the same time."""
        place, draft = self._at(name), self._at(f"{name}.{uuid.uuid4().hex}.draft")
        stream = self._system.create(draft, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        try:
            self._context.rename(draft, place, self._plain)
        except Exception as error:
            self._system.delete(draft, False)
            if "FileAlreadyExists" in str(error):
                raise Taken(name) from None
            raise

    def delete(self, name: str) -> None:
        self._system.delete(self._at(name), True)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder where the cluster keeps what its jobs share, ``spark.checkpoint.dir``.

    Only a local session may go without that setting; it gets a folder of its own that ends with the process.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="workpulse-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        named = _own[0]
    return f"{named.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def file_system(path: str):
    """File system and path within it, for a task that reads or writes a file of its own."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
