"""KPIs of cases from sums that can be added to and taken from.

An ended case never changes with the clock, so ended cases are kept as sums for each unit, first day and last day: counts, lead time as
whole seconds and microseconds, losses as exact decimals. Open cases stay rows; they are few beside those that ever ended, and their lead time and SLA
go by the moment of the report. When a case changes, what it added is taken away and what it adds now is put in its place. All sums
are of integers and decimals, so they are the same bit by bit whatever the order and however often cases changed. Counts and mean lead time equal those of a
scan of all cases bit by bit; the loss is the exact sum, which a scan's sum of doubles comes near. Losses of more than six places or 24 digits
before them are the exception: they are added up as doubles.
"""

from pyspark.sql import Column, DataFrame, functions as F

from workpulse import labels as L
from workpulse.functions.dates import SECONDS_PER_DAY
from workpulse.operators.filters import Choice, Offer, Validity, all_members
from workpulse.operators.grouping import keyed

KEYS = ("unidade", "first_day", "last_day")
COUNTS = ("total", "finished", "open", "on_time", "late", "leads", "seconds", "micros")
MILLION = 1_000_000
EXACT = "decimal(30,6)"  # losses with more places or digits are summed as doubles beside
SUMS = (*COUNTS, "loss", "odd_loss")
UNITS = Choice("unidade", Offer.KEEP_NULL)


def _adds(cases: DataFrame, sign: int = 1) -> DataFrame:
    """What each case adds, or with sign -1 takes away. Cases without a start are in no window and add nothing."""
    lead, loss = F.col("lead_time"), F.col("prejFinanc")
    micros = F.round(lead * (SECONDS_PER_DAY * 1e6)).cast("bigint")
    exact = F.coalesce(loss.try_cast(EXACT).cast("double") == loss, F.lit(False))
    one = {
        "total": F.lit(True), "finished": F.col("status") == L.FINISHED, "open": F.col("status") == L.OPEN, "on_time": F.col("slaStatus") == L.ON_TIME,
        "late": F.col("slaStatus") == L.LATE, "leads": lead.isNotNull(),
    }
    rest = micros % MILLION
    columns = {name: F.when(condition, F.lit(1)).otherwise(F.lit(0)) for name, condition in one.items()}
    columns |= {"seconds": F.coalesce(((micros - rest) / MILLION).cast("bigint"), F.lit(0)), "micros": F.coalesce(rest, F.lit(0))}
    columns = {name: (column * sign).cast("bigint") for name, column in columns.items()}
    none = F.lit(0).cast(EXACT)
    columns["loss"] = F.coalesce(F.when(exact, (loss * sign).try_cast(EXACT)), none)
    columns["odd_loss"] = F.when(~exact & loss.isNotNull(), loss * sign).otherwise(F.lit(0.0))
    days = {"first_day": F.col("startDate").cast("date"), "last_day": F.coalesce("endDate", "startDate").cast("date")}
    return cases.where("startDate is not null").select(
        "unidade", *[day.alias(name) for name, day in days.items()], *[column.alias(name) for name, column in columns.items()]
    )


def _summed(rows: DataFrame, by) -> DataFrame:
    return rows.groupBy(*by).agg(*[F.sum(name).cast(EXACT if name == "loss" else "double" if name == "odd_loss" else "bigint").alias(name) for name in SUMS])


def ended(cases: DataFrame) -> DataFrame:
    return cases.where("endDate is not null")


def still_open(cases: DataFrame) -> DataFrame:
    return cases.where("endDate is null")


def states(cases: DataFrame) -> DataFrame:
    """Sums of the ended ones of clean ``cases``."""
    return _summed(_adds(ended(cases)), KEYS)


def changed(kept: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """``kept`` with what the changed cases added ``before`` taken away and what they add ``after`` put in; new cases are only in ``after``."""
    moved = kept.unionByName(_adds(ended(before), -1)).unionByName(_adds(ended(after)))
    return _summed(moved, KEYS).where("total <> 0")


def changed_open(kept: DataFrame, before: DataFrame, after: DataFrame, key="processInstanceId") -> DataFrame:
    """The open cases after a change."""
    gone = before.select(key).unionByName(after.select(key))
    return kept.join(gone, key, "left_anti").unionByName(still_open(after).select(kept.columns))


def _in_window(validity: Validity) -> Column:
    """``Validity.holds`` on days; both of its limits are midnights."""
    begun = F.lit(True) if validity.first is None else F.col("first_day") >= F.lit(validity.first)
    return begun & (F.col("last_day") <= F.lit(validity.last))


def kpis(kept: DataFrame, open_cases: DataFrame, validity: Validity, units=None, by=()) -> DataFrame:
    """The general KPIs as ``cases.kpis`` gives them from all cases, optionally per unit. ``open_cases`` are clean as of the moment of the report."""
    rows = kept.unionByName(_adds(open_cases)).where(_in_window(validity))
    if units is not None:
        rows = rows.where(all_members([UNITS], {"unidade": units}))
    none = {name: F.coalesce(name, F.lit(0)) for name in ("total", "finished", "open", "on_time", "late")}
    lead = (F.col("seconds") + F.col("micros") / 1e6) / F.nullif("leads", F.lit(0)) / SECONDS_PER_DAY
    loss = F.coalesce(F.col("loss").cast("double") + F.col("odd_loss"), F.lit(0.0))
    return _summed(rows, by).select(*by, *[column.alias(name) for name, column in none.items()], lead.alias("mean_lead"), loss.alias("total_loss"))


def by_unit(kept: DataFrame, open_cases: DataFrame, validity: Validity) -> DataFrame:
    """Cases and mean lead time of each unit."""
    return keyed(kpis(kept, open_cases, validity, by=["unidade"]), ["unidade"]).select("unidade", "total", F.col("mean_lead").alias("lead_time"))
