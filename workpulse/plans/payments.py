"""Payment report: cleaning, KPIs, groupings, ranks and detail."""

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from workpulse import labels as L
from workpulse.functions import categories, numbers
from workpulse.functions.dates import lead_days, mean_days, shown_date
from workpulse.operators.filters import Choice, Offer, Validity, passing
from workpulse.operators.grouping import count_by, mean_lead_by
from workpulse.operators.ranking import with_position

CHOICES = tuple(
    Choice(column, Offer.NOT_NULL)
    for column in (
        "status",
        "slaStatus",
        "empresaPagamento",
        "unidadeSolicitante",
        "nomeSolicitante",
        "tpPagamento",
        "departamentoSolicitante",
    )
)


def clean_payments(flat: DataFrame, as_of: dt.datetime, company=None) -> DataFrame:
    """Typed and labelled payment requests with their lead time; labels that a report does not read are pruned."""
    return flat.withColumns(
        {
            "lead_time": lead_days(F.col("startDate"), F.col("endDate"), as_of),
            "status": categories.status(F.col("status")),
            "slaStatus": categories.source_sla(F.col("slaStatus")),
            "departamentoSolicitante": categories.department(F.col("departamentoSolicitante"), company),
        }
    )


def filtered(payments: DataFrame, validity: Validity, chosen=None) -> DataFrame:
    """Requests in the window that pass every multi-select."""
    return passing(payments, CHOICES, chosen, validity)


def kpis(payments: DataFrame) -> DataFrame:
    return payments.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == L.FINISHED).alias("finished"),
        F.count_if(F.col("status") == L.OPEN).alias("open"),
        F.count_if(F.col("aprovarSolic") == L.APPROVED).alias("approved"),
        mean_days(F.col("lead_time")).alias("mean_lead"),
    )


def by_unit(payments: DataFrame) -> DataFrame:
    return count_by(payments, "unidadeSolicitante")


def by_department(payments: DataFrame) -> DataFrame:
    return count_by(payments, "departamentoSolicitante")


def lead_by_unit(payments: DataFrame) -> DataFrame:
    means = mean_lead_by(payments, "unidadeSolicitante")
    return means.orderBy(F.asc_nulls_last("lead_time"), "unidadeSolicitante")


def rank_units(payments: DataFrame) -> DataFrame:
    return with_position(by_unit(payments), "total", "unidadeSolicitante")


def rank_departments(payments: DataFrame) -> DataFrame:
    return with_position(by_department(payments), "total", "departamentoSolicitante")


def rank_lead_units(payments: DataFrame) -> DataFrame:
    means = mean_lead_by(payments, "unidadeSolicitante", "mean_lead")
    return with_position(means, "mean_lead", "unidadeSolicitante")


def detail(payments: DataFrame) -> DataFrame:
    """Detail table with its headings and dates as shown."""
    shown = {"startDate": shown_date(F.col("startDate")), "endDate": shown_date(F.col("endDate"))}
    return payments.select(*[shown.get(name, F.col(name)).alias(heading) for name, heading in L.PAYMENT_DETAIL])


def card(payment: DataFrame) -> DataFrame:
    """What is shown of a chosen request: dates with a mark for none, days with one decimal."""
    return payment.select(
        "processInstanceId",
        shown_date(F.col("startDate"), "N/A").alias("startDate"),
        shown_date(F.col("endDate"), "N/A").alias("endDate"),
        F.concat(numbers.fixed_text(F.col("lead_time"), 1), F.lit(" dias")).alias("lead_time"),
        *("status", "slaStatus", "unidadeSolicitante", "tpPagamento", "empresaPagamento"),
        *("departamentoSolicitante", "nomeSolicitante", "funcaoSolicitante", "observacao"),
    )
