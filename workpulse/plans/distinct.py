"""Distinct counts of the value chain that can be put together again.

Every process, procedure, activity and task has a number of its own, and each combination of unit, season, type and automation keeps which numbers
occur in it as bitmaps of 32,768 bits. A choice of any of these is then answered by joining the bitmaps of its combinations bit by
bit: the rows are not read again, and the counts are exact. New rows add bits; values that are new get the numbers after the last one.
"""

from pyspark.sql import DataFrame, functions as F

from workpulse import labels as L
from workpulse.operators.filters import all_members
from workpulse.operators.grouping import sum_or_zero
from workpulse.operators.ranking import with_position
from workpulse.plans.value_chain import CHOICES

KEYS = ("Unidade", "Temporada", "Tipo de Procedimento", L.AUTOMATION)
COUNTED = dict(zip(("processes", "procedures", "activities", "tasks"), L.COMPONENTS, strict=True))
ANSWERED = tuple(choice for choice in CHOICES if choice.column in KEYS)


def _values(rows: DataFrame, keys=()) -> DataFrame:
    """Each component's values, given ones only, once for each of ``keys``."""
    pairs = F.array(*[F.struct(F.lit(i).alias("component"), F.col(f"`{name}`").alias("value")) for i, name in enumerate(COUNTED.values())])
    return rows.select(*[f"`{key}`" for key in keys], F.inline(pairs)).where("value is not null").distinct()


def numbered(rows: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``component, value, number`` of every value of ``rows``, dense from 1; those that are ``known`` keep their numbers and stay."""
    values = _values(rows)
    if known is None:
        return with_position(values, "component", "value", descending=False, name="number")
    new = values.join(known, ["component", "value"], "left_anti")
    last = known.agg(F.coalesce(F.max("number"), F.lit(0))).scalar()
    added = with_position(new, "component", "value", descending=False, name="number")
    return known.unionByName(added.withColumn("number", F.col("number") + last))


def bitmaps(rows: DataFrame, numbers: DataFrame) -> DataFrame:
    """Which numbers occur in each combination: one row of 4 KB for each combination, component and 32,768 numbers that it has some of.

    Numbers are dealt by their bitmap before any is built: tasks that each held a few bits of all bitmaps would send all of them, 4 KB each.
    """
    keys = [f"`{key}`" for key in KEYS]
    marked = _values(rows, KEYS).join(numbers, ["component", "value"])
    dealt = marked.select(*keys, "component", F.bitmap_bucket_number("number").alias("bucket"), F.bitmap_bit_position("number").alias("bit")).repartition("component", "bucket")
    return dealt.groupBy(*keys, "component", "bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))


def hours(rows: DataFrame) -> DataFrame:
    """Rows and hours of each combination."""
    return rows.groupBy(*[f"`{key}`" for key in KEYS]).agg(F.count(F.lit(1)).alias("rows"), sum_or_zero(F.col(L.DEMAND)).alias("total_hours"))


def joined_bitmaps(*kept: DataFrame) -> DataFrame:
    """Bitmaps of several loads as one table; the rows of a combination, component and bucket are joined bit by bit."""
    stacked = kept[0]
    for more in kept[1:]:
        stacked = stacked.unionByName(more)
    return stacked.groupBy(*[f"`{key}`" for key in KEYS], "component", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def joined_hours(*kept: DataFrame) -> DataFrame:
    stacked = kept[0]
    for more in kept[1:]:
        stacked = stacked.unionByName(more)
    return stacked.groupBy(*[f"`{key}`" for key in KEYS]).agg(F.sum("rows").alias("rows"), F.sum("total_hours").alias("total_hours"))


def kpis(kept_bitmaps: DataFrame, kept_hours: DataFrame, chosen=None) -> DataFrame:
    """The KPIs of the value chain for a choice of units, seasons, types and automation levels, as ``value_chain.kpis`` gives them from the rows."""
    kept = all_members(ANSWERED, chosen)
    together = kept_bitmaps.where(kept).groupBy("component", "bucket").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("n"))
    counts = together.agg(*[F.coalesce(F.sum(F.when(F.col("component") == i, F.col("n"))), F.lit(0)).alias(name) for i, name in enumerate(COUNTED)])
    totals = kept_hours.where(kept).agg(sum_or_zero(F.col("total_hours")).alias("total_hours"), F.count_distinct("Unidade").alias("units"))
    # One row each, put side by side by adding what the other lacks as zeros.
    zeros = {name: F.lit(0).cast("bigint") for name in ("units", *COUNTED)} | {"total_hours": F.lit(0.0)}
    rows = totals.withColumns({name: zeros[name] for name in COUNTED}).unionByName(counts.withColumns({name: zeros[name] for name in ("total_hours", "units")}))
    return rows.agg(*[F.sum(name).alias(name) for name in ("total_hours", "units", *COUNTED)])
