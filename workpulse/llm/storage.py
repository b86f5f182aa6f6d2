"""Places that every executor and the driver share: tables that cut lineage, and files of the library's own formats."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from contextlib import contextmanager

import pyarrow.fs as pafs

_own: list[str] = []
_blocks = threading.local()  # of each thread, the tables of the scratch blocks that are open


def _open() -> list[list[str]]:
    if not hasattr(_blocks, "open"):
        _blocks.open = []
    return _blocks.open


def shared_folder(spark) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Only a local session may go without that setting; it gets a folder of its own that ends with the process.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="workpulse-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return _own[0]


def new_folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(frame, name: str = "table", keep: bool = False):
    """Write ``frame`` as Parquet into the shared folder and read it back.

    The result has no lineage: a lost executor costs no recomputation, and later passes read only the columns they need.
    Within a ``scratch`` block the table goes with the block, unless it is to ``keep``.
    """
    spark = frame.sparkSession
    path = new_folder(spark, name)
    frame.write.parquet(path)
    if _open() and not keep:
        _open()[-1].append(path)
    out = spark.read.schema(frame.schema).parquet(path)
    out.stored_at = path
    return out


def _delete(spark, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def discard(frame) -> None:
    """Delete a stored table that nothing reads any more."""
    path = frame.stored_at
    _delete(frame.sparkSession, path)
    for tables in _open():
        if path in tables:
            tables.remove(path)


@contextmanager
def scratch(spark):
    """Delete the tables that are stored within the block at its end. What the block returns must be stored with ``keep``."""
    tables: list[str] = []
    _open().append(tables)
    try:
        yield
    finally:
        _open().remove(tables)
        for path in tables:
            _delete(spark, path)


def file_system(path: str):
    """File system and path within it, for a task that writes or reads a file of its own."""
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri("file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path)
    return pafs.LocalFileSystem(), path
