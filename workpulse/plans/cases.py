"""Case report: cleaning, KPIs, groupings, ranks, detail and timeline."""

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from workpulse import labels as L
from workpulse.functions import categories, numbers
from workpulse.functions.dates import lead_days, mean_days, shown_date
from workpulse.operators.columns import computed_once
from workpulse.operators.filters import Choice, Offer, Validity, passing
from workpulse.operators.grouping import count_by, mean_lead_by, sum_or_zero
from workpulse.operators.ranking import with_position

CHOICES = (
    Choice("status", Offer.KEEP_NULL),
    Choice("slaStatus", Offer.KEEP_NULL),
    Choice("gravidadeMaxima", Offer.FIXED, L.SEVERITIES),
    Choice("unidade", Offer.KEEP_NULL),
    Choice("solicitante", Offer.KEEP_NULL),
    Choice("mddCorretSelecionada", Offer.NOT_NULL),
)


def clean_cases(flat: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Typed and labelled cases, each with its lead time and SLA status.

    The labels are plain columns: a report that does not read one neither works it out nor reads its source.
    """
    labelled = flat.withColumns(
        {
            "lead_time": lead_days(F.col("startDate"), F.col("endDate"), as_of),
            "prejFinanc": numbers.loss_amount(F.col("prejFinanc")),
            "gravidadeMaxima": categories.severity(F.col("gravidadeMaxima")),
            "mddCorretSelecionada": categories.measure(F.col("mddCorretSelecionada")),
            "unidade": categories.unit(F.col("unidade")),
            "tbIrregularidade___1": categories.irregularity(F.col("tbIrregularidade___1")),
            "status": categories.status(F.col("status")),
        }
    )
    sla = categories.sla_status(F.col("gravidadeMaxima"), F.col("tbIrregularidade___1"), F.col("lead_time"))
    return labelled.withColumn("slaStatus", sla)


def general(cases: DataFrame, validity: Validity, units=None) -> DataFrame:
    """Cases in the window and of the chosen units."""
    chosen = {"unidade": units} if units is not None else {}
    return passing(cases, [choice for choice in CHOICES if choice.column == "unidade"], chosen, validity)


def filtered(cases: DataFrame, validity: Validity, chosen=None) -> DataFrame:
    """Cases in the window that pass every multi-select."""
    return passing(cases, CHOICES, chosen, validity)


def kpis(cases: DataFrame, by=()) -> DataFrame:
    """Six counters and the total loss in one pass, optionally per group."""
    return cases.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == L.FINISHED).alias("finished"),
        F.count_if(F.col("status") == L.OPEN).alias("open"),
        F.count_if(F.col("slaStatus") == L.ON_TIME).alias("on_time"),
        F.count_if(F.col("slaStatus") == L.LATE).alias("late"),
        mean_days(F.col("lead_time")).alias("mean_lead"),
        sum_or_zero(F.col("prejFinanc")).alias("total_loss"),
    )


def severity_totals(cases: DataFrame) -> DataFrame:
    return cases.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("gravidadeMaxima") == L.GRAVE).alias("grave"),
        F.count_if(F.col("gravidadeMaxima") == L.MODERATE).alias("moderate"),
        F.count_if(F.col("gravidadeMaxima") == L.LIGHT).alias("light"),
    )


def by_unit(cases: DataFrame) -> DataFrame:
    return count_by(cases, "unidade")


def irregularities_by_unit(cases: DataFrame) -> DataFrame:
    return count_by(cases, "unidade", "irregularidade", "gravidadeMaxima", name="frequency")


def measures_by_unit(cases: DataFrame) -> DataFrame:
    return count_by(cases, "unidade", "mddCorretSelecionada")


def lead_by_unit(cases: DataFrame) -> DataFrame:
    return mean_lead_by(cases, "unidade").orderBy(F.asc_nulls_last("lead_time"), "unidade")


def rank_units(cases: DataFrame) -> DataFrame:
    return with_position(by_unit(cases), "total", "unidade")


def rank_irregularities(cases: DataFrame) -> DataFrame:
    # The null test on the key would copy its long rule list.
    once = computed_once(cases, {"tbIrregularidade___1": F.col("tbIrregularidade___1")})
    return with_position(count_by(once, "tbIrregularidade___1"), "total", "tbIrregularidade___1")


def rank_measures(cases: DataFrame) -> DataFrame:
    return with_position(count_by(cases, "mddCorretSelecionada"), "total", "mddCorretSelecionada")


def rank_lead_units(cases: DataFrame) -> DataFrame:
    return with_position(mean_lead_by(cases, "unidade", "mean_lead"), "mean_lead", "unidade")


def detail(cases: DataFrame) -> DataFrame:
    """Detail table with its headings, dates and money as shown."""
    shown = {
        "startDate": shown_date(F.col("startDate")),
        "endDate": shown_date(F.col("endDate")),
        "prejFinanc": numbers.money_text(F.col("prejFinanc")),
    }
    return cases.select(*[shown.get(name, F.col(name)).alias(heading) for name, heading in L.CASE_DETAIL])


def card(case: DataFrame) -> DataFrame:
    """What is shown of a chosen case: dates with a mark for none, days and money with fixed decimals."""
    return case.select(
        "processInstanceId",
        shown_date(F.col("startDate"), "N/A").alias("startDate"),
        shown_date(F.col("endDate"), "N/A").alias("endDate"),
        F.concat(numbers.fixed_text(F.col("lead_time"), 3), F.lit(" dias")).alias("lead_time"),
        *("status", "slaStatus", "unidade", "cidadeFato", "regiaoUnidade", "tbIrregularidade___1"),
        *("gravidadeMaxima", "nmInvestigado", "solicitante"),
        F.concat(F.lit("R$"), numbers.fixed_text(F.col("prejFinanc"), 2)).alias("prejFinanc"),
        *("descFato", "conclusao"),
    )


def clean_activities(activities: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Activities in one of the kept states, with the days each took, rounded to two places."""
    named = activities.select(
        "processInstanceId",
        F.coalesce("state.stateName", F.lit(L.UNKNOWN_STATE)).alias("stateName"),
        "startDate",
        "endDate",
    )
    kept = named.where(F.col("stateName").isin(list(L.STATES)))
    days = lead_days(F.col("startDate"), F.col("endDate"), as_of)
    return kept.withColumn("lead_time", numbers.round_half_even(days, 2))


def lead_by_task(activities: DataFrame) -> DataFrame:
    """Mean days per state over all activities, those of filtered-out cases too."""
    return mean_lead_by(activities, "stateName").orderBy(F.asc_nulls_last("lead_time"), "stateName")


def rank_lead_tasks(activities: DataFrame) -> DataFrame:
    return with_position(mean_lead_by(activities, "stateName", "mean_lead"), "mean_lead", "stateName")


def timeline(cases: DataFrame, activities: DataFrame) -> DataFrame:
    """Activities of the given cases in the order of their start.

    Spark picks the join from the sizes it sees; a case with very many activities is split by the
    adaptive skew join, since only the left side of a semi join grows.
    """
    rows = activities.select("processInstanceId", "stateName", "startDate", "endDate")
    ours = rows.join(cases.select("processInstanceId"), "processInstanceId", "left_semi")
    return ours.orderBy("processInstanceId", F.asc_nulls_last("startDate"), "stateName")
