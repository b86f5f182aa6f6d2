"""Exact duplicates by deterministic block naming.

A text without its white space is cut into blocks of `BLOCK` bytes. All blocks of the corpus are sorted, and equal ones get one integer as their
name. Adjacent names of a document make pairs (a last one without a partner stays alone); the pairs are sorted and named in
the same way, and so on until each document has one name. Two documents are equal exactly when they needed as many rounds and have
the same last name: names are given by comparing bytes, so none collide.

Blocks are sorted by a hash first and by their bytes within it. The order is cut at (hash, row, place), so a block that a third of the corpus
shares lies in many tasks. Each task numbers its distinct blocks; only those whose hash may go on in another task, the first and the last of each
task, are named together, and these are a few for each task.

Null texts are empty; empty texts are equal to each other and to texts of white space. Rows may repeat or share an id: each row is
decided by itself, and of rows that tie in all, one stays. A null id loses ties. An empty table gives an empty result. Further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from workpulse.llm.storage import scratch, stored
from workpulse.llm.text import tidy

WHITE = " \t\n\x0b\x0c\r"
BLOCK = 8192

_CARRIED = "row bigint, place bigint, blocks bigint, doc_id bigint, points bigint, digest binary"


def without_white(text):
    """The text without the six characters of white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), WHITE, "")


def first_blocks(docs: DataFrame, size: int = BLOCK) -> DataFrame:
    """One row for each block of each row's text, an empty text being one empty block. What belongs to the whole text goes with its first block.

    ``row`` numbers the rows of ``docs`` within this one pass.
    """
    plain = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("points"),
        without_white(F.col("text")).cast("binary").alias("bytes"),
    )
    last = F.greatest(F.lit(0), F.floor((F.octet_length("bytes") - 1) / size)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.substr(F.col("bytes"), i * size + 1, F.lit(size)))
    whole = plain.select("row", "doc_id", "points", F.unhex(F.sha2("bytes", 256)).alias("digest"), cut.alias("cut"))
    spread = whole.select("row", "doc_id", "points", "digest", F.size("cut").cast("bigint").alias("blocks"), F.posexplode("cut").alias("place", "block"))
    first = F.col("place") == 0
    return spread.select(
        "row", F.col("place").cast("bigint").alias("place"), "blocks",
        *[F.when(first, F.col(name)).alias(name) for name in ("doc_id", "points", "digest")], "block",
    )


def _numbered(batches):
    """Number the distinct blocks of a sorted task. ``edge`` holds a block of the task's first or last hash once or twice."""
    part, rank, before, first, tail = TaskContext.get().partitionId(), 0, None, None, (None, [])
    for batch in batches:
        if not batch.num_rows:
            continue
        marks, blocks = batch.column("mark").to_numpy(), batch.column("block")
        fresh = np.ones(len(marks), bool)
        fresh[1:] = ~pc.equal(blocks.slice(1), blocks.slice(0, len(marks) - 1)).to_numpy(zero_copy_only=False)
        fresh[0] = before is None or blocks[0].as_py() != before
        before = blocks[-1].as_py()
        ranks = rank + np.cumsum(fresh)
        rank = int(ranks[-1])
        if first is None:
            first = marks[0]
        if tail[0] != marks[-1]:
            tail = (marks[-1], [])
        tail[1].extend((int(ranks[i]), blocks[i].as_py()) for i in np.flatnonzero(fresh & (marks == marks[-1])).tolist())
        edges = pc.if_else(pa.array(fresh & (marks == first)), blocks, pa.scalar(None, blocks.type))
        columns = [batch.column(name) for name in batch.schema.names[:-2]]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(marks), part, np.int32)), pa.array(ranks), edges], [*batch.schema.names[:-2], "part", "rank", "edge"])
    if tail[1]:
        names, kinds = batch.schema.names[:-2], [field.type for field in batch.schema][:-2]
        ranks, edges = zip(*tail[1], strict=True)
        columns = [pa.nulls(len(ranks), kind) for kind in kinds]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([part] * len(ranks), pa.int32()), pa.array(ranks, pa.int64()), pa.array(edges, blocks.type)], [*names, "part", "rank", "edge"])


def named(blocks: DataFrame, schema: str, label: str) -> DataFrame:
    """``blocks`` with an integer ``name`` instead of ``block``: equal blocks share it, different ones never do.

    The last column of ``blocks`` is ``block``; the ones before have ``schema``, ``row`` and ``place`` among them.
    """
    kept = [column for column in blocks.columns if column != "block"]
    sorted_ = (
        blocks.select(*kept, F.xxhash64("block").alias("mark"), "block")
        .repartitionByRange("mark", "row", "place")
        .sortWithinPartitions("mark", "block")
    )
    numbered = stored(sorted_.mapInArrow(tidy(_numbered), f"{schema}, part int, rank bigint, edge binary"), label)
    # Both tables below have a few rows for each task of the sort, however many blocks there are.
    edges = numbered.where("edge is not null").select("part", "rank", "edge").distinct()
    shared = edges.select("part", "rank", F.dense_rank().over(Window.orderBy("edge")).cast("bigint").alias("shared"))
    sizes = numbered.groupBy("part").agg(F.max("rank").alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    total = edges.agg(F.count_distinct("edge").alias("total"))
    starts = sizes.crossJoin(F.broadcast(total)).select("part", (F.coalesce(F.sum("size").over(before), F.lit(0)) + F.col("total")).alias("start"))
    joined = numbered.where("row is not null").join(F.broadcast(starts), "part").join(F.broadcast(shared), ["part", "rank"], "left")
    return joined.select(*kept, F.coalesce("shared", F.col("start") + F.col("rank")).alias("name"))


def _pairs(names: DataFrame) -> DataFrame:
    """Adjacent names of a row joined; the last one stays alone if their number is odd."""
    even = F.col("place") % 2 == 0
    pairs = names.groupBy("row", F.floor(F.col("place") / 2).alias("place"), F.ceil(F.col("blocks") / 2).alias("blocks")).agg(
        F.max(F.when(even, F.col("name"))).alias("left"), F.max(F.when(~even, F.col("name"))).alias("right")
    )
    return pairs.select("row", "place", "blocks", F.concat_ws(",", "left", "right").cast("binary").alias("block"))


def identities(docs: DataFrame, size: int = BLOCK) -> DataFrame:
    """``row, doc_id, points, digest`` of every row with its identity, ``rounds`` and ``name``. Rounds grow with the logarithm of the longest text."""
    level = stored(named(first_blocks(docs, size), _CARRIED, "blocks"), "names")
    whole = ["row", "doc_id", "points", "digest"]
    heads = level.where("place = 0")
    found = heads.where("blocks = 1").select(*whole, F.lit(0).alias("rounds"), "name")
    most, rounds, done = level.agg(F.max("blocks")).first()[0] or 0, 0, None
    names = level.select("row", "place", "blocks", "name")
    while most > 1:
        most, rounds = (most + 1) // 2, rounds + 1
        names = stored(named(_pairs(names.where("blocks > 1")), "row bigint, place bigint, blocks bigint", "blocks"), "names")
        ended = names.where("blocks = 1").select("row", F.lit(rounds).alias("rounds"), "name")
        done = ended if done is None else done.unionByName(ended)
    if done is None:
        return found
    return found.unionByName(heads.where("blocks > 1").select(*whole).join(done, "row"))


def exact_duplicates(docs: DataFrame, size: int = BLOCK) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` of every row.

    Of equal texts that with the most code points in the original stays, then that with the smallest id.
    """
    with scratch(docs.sparkSession):
        rows = stored(identities(docs, size), "identities", keep=True)
    best = F.min(F.struct((-F.col("points")).alias("points"), F.col("doc_id").isNull().alias("last"), "doc_id", "row"))
    # Stored, so that the planner may split the documents of one large group when it joins them.
    groups = stored(rows.groupBy("rounds", "name").agg(F.count(F.lit(1)).alias("group_size"), best.alias("best")), "groups")
    told = rows.join(groups, ["rounds", "name"])
    return told.select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def without_duplicates(docs: DataFrame, size: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` whose (id, normalised text) stays; rows that repeat both stay once."""
    keys = exact_duplicates(docs, size).where("kept").select(F.col("doc_id").alias("_naming_id"), F.col("text_sha256").alias("_naming_sha"))
    digest = F.sha2(without_white(F.col("text")).cast("binary"), 256)
    first = docs.withColumn("_naming_mark", digest).dropDuplicates(["doc_id", "_naming_mark"])
    match = F.col("_naming_id").eqNullSafe(first["doc_id"]) & (F.col("_naming_sha") == first["_naming_mark"])
    return first.join(keys, match, "left_semi").drop("_naming_mark")
