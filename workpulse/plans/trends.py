"""Case groupings that the report keeps in reserve: places, shares, months and the severity pivot."""

from pyspark.sql import DataFrame, Window, functions as F

from workpulse import labels as L
from workpulse.operators.grouping import count_by, keyed, sum_or_zero
from workpulse.operators.ranking import with_position


def by_city(cases: DataFrame) -> DataFrame:
    return count_by(cases, "cidadeFato")


def by_region(cases: DataFrame) -> DataFrame:
    return count_by(cases, "regiaoUnidade")


def rank_cities(cases: DataFrame) -> DataFrame:
    return with_position(by_city(cases), "total", "cidadeFato")


def irregularities_by_place(cases: DataFrame) -> DataFrame:
    """Counts per city and per region from one pass: each case is counted under both of its places."""
    places = F.array(
        F.struct(F.lit("cidade").alias("place_kind"), F.col("cidadeFato").alias("place")),
        F.struct(F.lit("região").alias("place_kind"), F.col("regiaoUnidade").alias("place")),
    )
    placed = cases.select("irregularidade", "gravidadeMaxima", F.inline(places))
    return count_by(placed, "place_kind", "place", "irregularidade", "gravidadeMaxima", name="frequency")


def irregularity_severity(cases: DataFrame) -> DataFrame:
    return count_by(cases, "irregularidade", "gravidadeMaxima", name="frequency")


def measures_by_city(cases: DataFrame) -> DataFrame:
    return count_by(cases, "cidadeFato", "mddCorretSelecionada")


def status_shares(cases: DataFrame) -> DataFrame:
    """Share of the cases by SLA status and by status; a status without a label is a share of its own."""
    kinds = F.array(
        *[F.struct(F.lit(kind).alias("kind"), F.col(kind).alias("label")) for kind in ("slaStatus", "status")]
    )
    counts = cases.select(F.inline(kinds)).groupBy("kind", "label").agg(F.count(F.lit(1)).alias("total"))
    # Two SLA labels, two status labels and null: the window sees five rows at most.
    whole = F.sum("total").over(Window.partitionBy("kind"))
    return counts.withColumn("share", F.col("total") / whole)


def monthly(cases: DataFrame) -> DataFrame:
    """Cases and loss per month of the start, months without a case included, named by their last day.

    A month fills the gap up to the next month that has cases. The window runs over months, which the
    calendar bounds, so it needs no partitions.
    """
    month = F.trunc("startDate", "month").alias("month")
    sums = (
        cases.where(F.col("startDate").isNotNull())
        .groupBy(month)
        .agg(F.count(F.lit(1)).alias("total"), sum_or_zero(F.col("prejFinanc")).alias("loss"))
    )
    one = F.make_ym_interval(F.lit(0), F.lit(1))
    following = F.lead("month").over(Window.orderBy("month"))
    until = F.coalesce((following - one).cast("date"), F.col("month"))
    days = sums.withColumn("months", F.sequence(F.col("month"), until, one)).select(
        "month", "total", "loss", F.explode("months").alias("shown")
    )
    own = F.col("shown") == F.col("month")
    return days.select(
        F.last_day("shown").alias("month_end"),
        F.when(own, F.col("total")).otherwise(0).alias("total"),
        F.when(own, F.col("loss")).otherwise(0.0).alias("loss"),
    )


def monthly_cases(cases: DataFrame) -> DataFrame:
    return monthly(cases).select("month_end", "total")


def monthly_loss(cases: DataFrame) -> DataFrame:
    return monthly(cases).select("month_end", "loss")


def severity_pivot(cases: DataFrame) -> DataFrame:
    """Irregularities by severity, the four severities that the filter lets through as columns."""
    rows = keyed(cases, ["irregularidade", "gravidadeMaxima"])
    table = rows.groupBy("irregularidade").pivot("gravidadeMaxima", list(L.SEVERITIES)).agg(F.count(F.lit(1)))
    return table.na.fill(0)
