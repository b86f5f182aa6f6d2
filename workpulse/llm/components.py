"""Connected components of links between documents, by alternating large-star and small-star steps.

Each task brings the links it holds into stars, so that most chains are gone before they are shuffled. Each step is then a grouped
minimum and a join; the adaptive planner splits a hub's join. A step's links are written to the shared folder, so lineage stays short.
The number of steps grows with the logarithm of the longest chain left.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from workpulse.llm.storage import stored

HELD = 1_000_000  # links that a task brings together at a time


def stars(pairs) -> dict[int, int]:
    """The smallest node reachable over ``pairs`` for each node that is not it."""
    parent: dict[int, int] = {}

    def root(x):
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent[x]
        return top

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


def _contracted(links: DataFrame) -> DataFrame:
    """Links with the same components, brought into stars within each task."""

    def rows(batches):
        def put(pairs):
            found = stars(pairs)
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], ["a", "b"])

        pairs: list = []
        for batch in batches:
            pairs += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            if len(pairs) >= HELD:
                yield put(pairs)
                pairs = []
        yield put(pairs)

    return links.select("a", "b").mapInArrow(rows, "a bigint, b bigint").distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every node of the links ``a > b`` points to one node only, which itself points to none."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up")))).alias("e"))
    seen = ends.groupBy("e.node").agg(F.sum("e.up").alias("ups"), F.count(F.lit(1)).alias("all"))
    return seen.filter("ups > 1 or (ups = 1 and all > 1)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """``node, component`` of every node that is not the smallest of its component; ``links`` are pairs ``a, b``."""
    edges = stored(_contracted(links), "links")
    while not _stars(edges):
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stored(_contracted(small.union(least)), "links")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
