"""Landed pages read once: a table of cases that each load brings up to date from the files that came since.

The table is cut into buckets by a hash of the case. A load lists the landed files, leaves out those that an earlier load has read (same path,
length and time), reads the rest, and writes anew only the buckets that hold one of their cases: the old rows and the new ones, each
case as it was landed last. The other buckets are taken over as they lie. The new version is published in one step, so a load that
dies leaves the table as it was, and the next load reads the same files again. A file that was changed in place counts as new; its earlier
records of known cases lose by their time, those without an instance id go with their file.
"""

from __future__ import annotations

import math
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from workpulse import schemas
from workpulse.snapshots import Snapshots, Version
from workpulse.sources import records

BUCKET, SLICE, ENDED = "bucket", "slice", "endedText"
# Rows that a task sorts in memory; larger buckets are merged in slices, a file each.
ROWS_A_TASK = 150_000
CASES, FILES = "cases", "files"


@dataclass(frozen=True)
class Landed:
    """What is landed: the list's name on a page, the records' schema, their declared form fields."""

    list_name: str
    schema: object
    fields: tuple


CASE_PAGES = Landed("requests", schemas.REQUEST, schemas.CASE_FIELDS)
PAYMENT_PAGES = Landed("requests", schemas.PAYMENT, schemas.PAYMENT_FIELDS)


def listed(spark: SparkSession, path) -> DataFrame:
    """``path, length, modified`` and ``landedFile``, the name that records give it, of every file below ``path``; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", F.col("modificationTime").alias("modified"), F.col("_metadata.file_path").alias(records.LANDED_FILE))


def _flat(texts: DataFrame, landed: Landed, on_lost) -> DataFrame:
    """Flat records of all processes and states: a case that left the states asked for must not come back with an older landing.

    The end as it was landed stays beside, in ``endedText``: records of one file are ordered by it.
    """
    rows = records.sound_records(texts, landed.schema, on_lost).withColumn(ENDED, F.col("endDate"))
    return records.with_times(records.flatten(rows, landed.fields, rest=True))


def _once(fresh: DataFrame) -> tuple[DataFrame, list[int], int]:
    """Fresh rows with each case once, the buckets they lie in, and how many rows there are.

    Whether a case is there twice is asked of the ids alone; whole rows are grouped only if one is.
    """
    seen = fresh.groupBy(BUCKET, *records.CASE_KEYS).agg(F.count(F.lit(1)).alias("n"))
    again = F.max(F.when(F.col("processInstanceId").isNotNull(), F.col("n"))) > 1
    held = seen.groupBy(BUCKET).agg(F.sum("n").alias("rows"), again.alias("again")).collect()  # no more than there are buckets
    if any(row["again"] for row in held):
        fresh = records.last_landings(fresh, end=ENDED)
    return fresh.drop(ENDED), [row[BUCKET] for row in held], sum(row["rows"] for row in held)


def _nothing_landed(spark, landed: Landed) -> DataFrame:
    pages = spark.createDataFrame([], f"page string, {records.LANDED_AT} timestamp, {records.LANDED_FILE} string")
    return _flat(records.unwrap(pages, landed.list_name), landed, "raise").drop(ENDED)


def _with_bucket(rows: DataFrame, buckets: int) -> DataFrame:
    """A case's bucket never changes; records without an instance id are dealt by their mark."""
    key = F.coalesce("processInstanceId", records.LANDED_MARK)
    return rows.withColumn(BUCKET, F.pmod(F.xxhash64("processId", key), F.lit(buckets)).cast("int"))


def _still_there(rows: DataFrame, new: DataFrame) -> DataFrame:
    """Old rows without those that have no instance id and come from a file that is read again."""
    unknown = rows.where("processInstanceId is null").join(new.select(records.LANDED_FILE), records.LANDED_FILE, "left_anti")
    return rows.where("processInstanceId is not null").unionByName(unknown)


def _merged(rows: DataFrame, tasks: int, slices=1) -> DataFrame:
    """Each case of each bucket once, as landed last. One shuffle by bucket, and slice of it by a hash of the case, does for the grouping and for the files.

    Marks are MD5 in hexadecimal, which no shuffle compresses well; they travel as bytes, whose order is the same.
    """
    key = F.coalesce("processInstanceId", records.LANDED_MARK)
    rows = rows.withColumn(SLICE, F.pmod(F.hash("processId", key), F.lit(slices)))
    dealt = rows.withColumn(records.LANDED_MARK, F.unhex(records.LANDED_MARK)).repartition(max(1, tasks) * slices, BUCKET, SLICE)
    last = records.last_landings(dealt, (BUCKET, SLICE, *records.CASE_KEYS)).drop(SLICE).sortWithinPartitions(BUCKET, "processInstanceId")
    return last.withColumn(records.LANDED_MARK, F.lower(F.hex(records.LANDED_MARK)))


def _parts_by_bucket(version: Version | None) -> dict[int, str]:
    return {int(part.rpartition("=")[2]): part for part in version.facts["tables"][CASES]["parts"]} if version else {}


def load(spark: SparkSession, source, root, landed: Landed = CASE_PAGES, buckets=256, on_lost="raise", clock=time.time, **layout) -> Version:
    """Read the files below ``source`` that no load has read before and bring the table below ``root`` up to date.

    ``buckets`` holds from the first load on; a bucket of many rows is merged in slices, and written as a file each. ``facts`` of the version tell how many files the load read
    and how many buckets it wrote. With no new file nothing is published. `Conflict` is raised if another load was faster.
    """
    tables = Snapshots(spark, root, clock)
    draft, store = tables.begin(), tables.store
    old = draft.after
    found = listed(spark, source)
    new = found.join(old.table(FILES), ["path", "length", "modified"], "left_anti") if old else found
    # The driver plans a task or more for each file anyway, so it may hold their names.
    paths = [row.path for row in new.select("path").collect()]
    if not paths and old:
        return old
    buckets, lying, written = old.facts["buckets"] if old else buckets, _parts_by_bucket(old), []
    schema = _nothing_landed(spark, landed).schema
    if paths:
        texts = records.read_records(spark, paths, landed.list_name, placed=True, **layout)
        fresh = _with_bucket(_flat(texts, landed, on_lost), buckets)
        # Written, since the buckets are asked for before the merge: the pages are parsed once.
        fresh.write.option("compression", "zstd").parquet(store.path(draft.folder("fresh")))
        fresh = spark.read.schema(fresh.schema).parquet(store.path(draft.folder("fresh")))
        rows, touched, total = _once(fresh)
        if before := [store.path(lying[b]) for b in touched if b in lying]:
            held = spark.read.schema(schema).parquet(*before)
            total += held.count()  # the files' footers tell
            rows = rows.unionByName(_with_bucket(_still_there(held, new), buckets))
        slices = max(1, math.ceil(total / max(1, len(touched)) / ROWS_A_TASK))
        _merged(rows, len(touched), slices).write.partitionBy(BUCKET).option("compression", "zstd").parquet(store.path(draft.folder(CASES)))
        store.delete(draft.folder("fresh"))
        written = [name for name in store.names(draft.folder(CASES)) if name.startswith(f"{BUCKET}=")]
        lying = {b: part for b, part in lying.items() if b not in set(touched)}
    parts = [*lying.values(), *[f"{draft.folder(CASES)}/{name}" for name in written]]
    draft.note(CASES, schema, parts)
    read = new.drop(records.LANDED_FILE)
    draft.write(FILES, (read.unionByName(old.table(FILES)) if old else read).coalesce(1 + len(paths) // 100_000))
    draft.facts |= {"buckets": buckets, "files_read": len(paths), "buckets_written": len(written)}
    return draft.publish()


def loaded(version: Version, process=None, statuses=None) -> DataFrame:
    """Flat cases of a version, as the readers of landed pages give them, with their landing and undeclared fields."""
    return records.asked(version.table(CASES), process, statuses)
