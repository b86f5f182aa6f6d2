"""Positions over a whole frame of groups without bringing it into one task."""

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

SAMPLED = 64  # groups sampled for each piece


def pieces_of(spark: SparkSession) -> int:
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _cuts_before(cuts: str, place: Column, count: int) -> Column:
    """How many of fewer than ``count`` ordered cuts are not above ``place``, by halving. Never null: a join on a column that might be has its null
    test pushed down to every row below the groups."""
    steps = [1 << i for i in reversed(range(count.bit_length()))]
    found = F.aggregate(
        F.array(*[F.lit(step) for step in steps]), F.lit(0), lambda seen, step: F.when(F.get(cuts, seen + step - 1) <= place, seen + step).otherwise(seen)
    )
    return F.coalesce(found, F.lit(0))


def with_position(groups: DataFrame, measure, key, descending=True, name="ranking") -> DataFrame:
    """Add the 1-based position by ``measure``, null measures last, ties by ``key``.

    A window without partitions would sort every group in one task. Here the order is cut into as many pieces
    as a shuffle has partitions: a bounded sample of groups, taken by a hash of the key, gives the cut points; the size of each
    piece gives its first position; a window inside each piece gives the rest. Cut points are
    (measure, key) pairs, so groups that tie on the measure are spread too. ``key`` must be unique
    and ``measure`` the same in each evaluation: counts and ``mean_days`` are.
    """
    count = pieces_of(groups.sparkSession)
    value = F.col(measure)
    place = F.struct(
        value.isNull().alias("last"), (-value if descending else value).alias("value"), F.col(key).alias("key")
    )
    sample = (
        groups.select(place.alias("place"))
        .orderBy(F.xxhash64("place.key"), "place.key")
        .limit(SAMPLED * count)
        .agg(F.sort_array(F.collect_list("place")).alias("places"))
    )
    step = F.size("places") / F.lit(count)
    cuts = sample.select(
        F.transform(F.sequence(F.lit(1), F.lit(count - 1)), lambda i: F.get("places", (i * step).cast("int")))
    )
    pieces = (
        groups.withColumn("_cuts", cuts.scalar())
        .withColumn("_piece", _cuts_before("_cuts", place, count))
        .drop("_cuts")
    )
    # At most as many rows as pieces, whatever the number of groups.
    before = Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    sizes = pieces.groupBy("_piece").agg(F.count(F.lit(1)).alias("_size"))
    starts = sizes.select("_piece", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    order = F.desc_nulls_last(measure) if descending else F.asc_nulls_last(measure)
    inside = F.row_number().over(Window.partitionBy("_piece").orderBy(order, F.asc(key)))
    return pieces.join(F.broadcast(starts), "_piece").select(
        *groups.columns, (F.col("_start") + inside).cast("bigint").alias(name)
    )
