"""Writers, and holding a frame for one run; ``snapshots`` holds tables for longer."""

from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import MapType


def write_csv(frame: DataFrame, path, mode="overwrite"):
    """CSV parts with a header; times as wall time, null as an empty cell, texts with the blanks around them."""
    writer = frame.write.mode(mode).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss[.SSSSSS]")
    writer.csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_parquet(frame: DataFrame, path, mode="overwrite", partition_by=()):
    """Cleaned frame as a columnar table that later reports prune and filter at the scan."""
    writer = frame.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_clustered(frame: DataFrame, path, by, mode="overwrite", row_group=8 << 20):
    """Parquet in the order of ``by``, for lookups of a few of its values.

    Rows are dealt by ranges of ``by`` and sorted within, so a value's rows lie in one file or two; the footers' bounds, the page index and a
    Bloom filter let a reader leave out the files, row groups and pages that cannot hold it. A value with very many rows is
    spread over tasks by the other columns of its rows.
    """
    salt = F.xxhash64(*[name for name in frame.columns if not isinstance(frame.schema[name].dataType, MapType)])
    ordered = frame.repartitionByRange(F.col(by), salt).sortWithinPartitions(by)
    writer = ordered.write.mode(mode).option("parquet.block.size", str(row_group)).option(f"parquet.bloom.filter.enabled#{by}", "true")
    writer.option("parquet.bloom.filter.adaptive.enabled", "true").parquet(path)


@contextmanager
def held(frame: DataFrame):
    """Keep ``frame`` for several reports of one run; lost pieces are computed again."""
    frame.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield frame
    finally:
        frame.unpersist()
