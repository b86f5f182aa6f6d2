"""Every operator as a query over the test tables. Doubles are rounded here only, for the value hash."""

import datetime as dt

from pyspark.sql import DataFrame, Observation, functions as F
from pyspark.sql.types import DoubleType

from workpulse import labels as L
from workpulse import schemas, sinks
from workpulse.checks import fixtures as X
from workpulse.files import scratch_folder
from workpulse.operators.filters import Validity, bounds, cases_of, first_case, offered_values
from workpulse.plans import cases, distinct, payments, states, trends, value_chain, versions
from workpulse.snapshots import Snapshots
from workpulse.sources import loads, records, sheets

PLACES = 6
MONEY = ("total_loss", "loss")
# Far below the last place kept: a value that lies on a rounding tie goes up in both engines.
NUDGE = 1e-9
EVERYTHING = Validity(last=X.LAST_DAY)
SOME_YEARS = Validity(first=dt.date(1996, 3, 1), last=dt.date(1999, 6, 30))
ID = "processInstanceId"


def rounded(frame: DataFrame) -> DataFrame:
    """Doubles to the places both engines are compared at, money to cents; minus zero becomes zero."""
    columns = []
    for field in frame.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, DoubleType):
            places = 2 if field.name in MONEY else PLACES
            column = (F.round(column + NUDGE, places) + F.lit(0.0)).alias(field.name)
        columns.append(column)
    return frame.select(*columns)


def _filtered_cases(spark, sf_dir, chosen=None):
    return cases.filtered(X.clean_cases(spark, sf_dir), EVERYTHING, chosen)


def _filtered_payments(spark, sf_dir, chosen=None):
    return payments.filtered(X.clean_payments(spark, sf_dir), EVERYTHING, chosen)


def _of_cases(plan, chosen=None):
    """A report over the filtered cases."""
    return lambda spark, sf_dir: rounded(plan(_filtered_cases(spark, sf_dir, chosen)))


def _of_payments(plan, chosen=None):
    return lambda spark, sf_dir: rounded(plan(_filtered_payments(spark, sf_dir, chosen)))


def _of_activities(plan):
    return lambda spark, sf_dir: rounded(plan(X.clean_activities(spark, sf_dir)))


def _of_chain(plan):
    return lambda spark, sf_dir: rounded(plan(X.chain_filtered(spark, sf_dir)))


def _of_versions(plan):
    return lambda spark, sf_dir: plan(X.chosen_versions(spark, sf_dir))


def _relabelled(flat, clean, column):
    """A column before and after cleaning."""

    def query(spark, sf_dir):
        raw = flat(spark, sf_dir)
        both = raw.withColumn("raw", F.col(column))
        return rounded(clean(both).select(ID, "raw", F.col(column).alias("clean")))

    return query


def _case_label(column):
    return _relabelled(X.flat_cases, lambda rows: cases.clean_cases(rows, X.AS_OF), column)


def _payment_label(column):
    return _relabelled(X.flat_payments, lambda rows: payments.clean_payments(rows, X.AS_OF, X.COMPANY), column)


def _flatten_requests(spark, sf_dir):
    landed = X.landed_cases(spark, sf_dir)
    return records.with_times(records.flatten(landed, schemas.CASE_FIELDS))


def _bad_records(spark, sf_dir):
    """What becomes of pages of every kind, each kind counted."""
    return records.outcomes(records.unwrap(X.mixed_pages(spark, sf_dir)), schemas.REQUEST)


def _landed_again(spark, sf_dir):
    """Cases that were landed up to three times, each as it was landed last and if its state is then asked for."""
    rows = records.sound_records(records.unwrap(X.landed_pages(spark, sf_dir)), schemas.REQUEST)
    last = records.last_landings(records.asked(rows, L.CASE_PROCESS))
    flat = records.with_times(records.flatten(records.asked(last, statuses=L.REQUESTED_STATUS), schemas.CASE_FIELDS))
    landed = F.date_format(records.LANDED_AT, "yyyy-MM-dd").alias(records.LANDED_AT)
    return flat.select(ID, "status", "startDate", "endDate", "unidade", "solicitante", landed, records.LANDED_FILE)


def _landing_outcomes(spark, sf_dir):
    return records.outcomes(records.unwrap(X.landed_pages(spark, sf_dir)), schemas.REQUEST, records.CASE_KEYS)


def _loaded_in_steps(spark, sf_dir):
    """Three loads of one table: each landing's pages are written as files, and a load reads those that are new.

    The files are compressed; since such a file is read by one task, it holds a bounded number of pages.
    """
    folder = scratch_folder(spark, "landed")
    for number in range(len(X.LANDED_AGAIN)):
        landed = X.landed_pages(spark, sf_dir, only=number)
        landed.select("page").write.option("maxRecordsPerFile", 100_000).text(f"{folder}/pages/landing-{number}", compression="gzip")
        version = loads.load(spark, f"{folder}/pages", f"{folder}/table", buckets=16)
    rows = loads.loaded(version, L.CASE_PROCESS, L.REQUESTED_STATUS)
    number = F.regexp_extract(records.LANDED_FILE, "landing-([0-9]+)", 1).cast("int").alias("landing")
    return rows.select(ID, "status", "startDate", "endDate", "unidade", "solicitante", number)


def _outcomes_observed(spark, sf_dir):
    """The counts of ``bad_records``, told by the one pass that reads the records."""
    seen = Observation("landed pages")
    rows = records.sound_records(records.unwrap(X.mixed_pages(spark, sf_dir)), schemas.REQUEST, "skip", observed=seen)
    rows.write.format("noop").mode("overwrite").save()
    return records.outcomes_of(spark, seen)


def _written(spark, frame, name):
    """``frame`` as a table that is kept, as such tables are in use."""
    path = scratch_folder(spark, name)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def _clustered(spark, rows):
    """``rows`` written in the order of their cases, and read back."""
    path = scratch_folder(spark, "clustered")
    sinks.write_clustered(rows, path, ID)
    return spark.read.schema(rows.schema).parquet(path)


def _cases_looked_up(spark, sf_dir):
    return cases.card(cases_of(_clustered(spark, _filtered_cases(spark, sf_dir)), X.LOOKED_UP))


def _timeline_looked_up(spark, sf_dir):
    """Activities of some cases, from cases and activities that both lie in the order of their ids."""
    ours = cases_of(_clustered(spark, _filtered_cases(spark, sf_dir)), X.LOOKED_UP)
    activities = cases_of(_clustered(spark, X.clean_activities(spark, sf_dir)), X.LOOKED_UP)
    return cases.timeline(ours, activities)


def _report_kept(spark, sf_dir):
    """KPIs per unit, kept for ten minutes: the second report finds them and reads no source."""
    tables = Snapshots(spark, scratch_folder(spark, "reports"))
    for _ in range(2):
        version = tables.kept(600, lambda draft: draft.write("kpis", flagship(spark, sf_dir)))
    return version.table("kpis")


def _src_activities(spark, sf_dir):
    """Activities out of landed pages, cleaned."""
    texts = records.unwrap(X.landed_activities(spark, sf_dir), "activities")
    rows = records.asked(records.sound_records(texts, schemas.ACTIVITY), L.CASE_PROCESS)
    return rounded(cases.clean_activities(records.with_times(rows), X.AS_OF))


def _sheet_from_csv(spark, sf_dir):
    """The value-chain sheet, read back from CSV parts."""
    path = scratch_folder(spark, "sheet")
    sinks.write_csv(X.chain_wide(spark, sf_dir), path)
    return sheets.read_sheet(spark, path)


def _versions_from_csv(spark, sf_dir):
    """The stacked versions, each read back from CSV parts."""
    paths = {}
    for version, sheet in X.version_sheets(spark, sf_dir).items():
        paths[version] = scratch_folder(spark, "version")
        sinks.write_csv(sheet, paths[version])
    return sheets.read_versions(spark, paths)


def _detail_from_csv(spark, sf_dir):
    """The detail table as it is written for download, read back."""
    path, shown = scratch_folder(spark, "detail"), cases.detail(_filtered_cases(spark, sf_dir))
    sinks.write_csv(shown, path)
    # An empty cell is null and a quoted one blank; without a null value of its own the reader takes both for null.
    return rounded(spark.read.schema(shown.schema).csv(path, header=True, escape='"', nullValue="\\N"))


def _kpi_from_parquet(spark, sf_dir):
    """KPIs from the cleaned cases as they are written for later reports."""
    path, clean = scratch_folder(spark, "cases"), X.clean_cases(spark, sf_dir)
    sinks.write_parquet(clean, path, partition_by=["status"])
    return rounded(cases.kpis(cases.filtered(spark.read.schema(clean.schema).parquet(path), EVERYTHING)))


def _versions_from_workbooks(spark, sf_dir):
    """The stacked versions, read out of the sheets of workbooks."""
    folder = scratch_folder(spark, "workbooks")
    X.version_workbooks(spark, sf_dir, folder)
    return sheets.read_workbook_versions(spark, folder)


def _kpi_from_states(spark, sf_dir):
    """General KPIs per unit from sums: every second case was open when the sums were made, every seventh was not there yet."""
    now, k = X.clean_cases(spark, sf_dir), F.col(ID).cast("bigint")
    flat = X.flat_cases(spark, sf_dir).where((k % 2 == 0) & (k % 7 != 0))
    earlier = flat.withColumns({"endDate": F.lit(None).cast("timestamp_ntz"), "status": F.lit("OPEN")})
    before = cases.clean_cases(earlier, X.AS_OF)
    first = now.where((k % 2 != 0) & (k % 7 != 0)).unionByName(before)
    after = now.where((k % 2 == 0) | (k % 7 == 0))
    kept = states.changed(states.states(first), before, after)
    still = states.changed_open(states.still_open(first), before, after)
    return rounded(states.kpis(kept, still, EVERYTHING, by=["unidade"]))


def _chain_bitmaps(spark, sf_dir, chosen=None):
    """KPIs of the value chain from bitmaps and sums of two loads of its rows. Each load is kept as a table: it is read several times."""
    rows = value_chain.filtered(value_chain.long(X.chain_wide(spark, sf_dir, dealt=True)))
    rows = rows.select(*[f"`{name}`" for name in dict.fromkeys((*distinct.KEYS, *L.COMPONENTS, L.DEMAND))])
    loads_ = [_written(spark, rows.where(F.pmod(F.hash("Atividade"), F.lit(2)) == i), "load") for i in range(2)]
    first = _written(spark, distinct.numbered(loads_[0]), "numbers")
    numbers = _written(spark, distinct.numbered(loads_[1], first), "numbers")
    bits = distinct.joined_bitmaps(distinct.bitmaps(loads_[0], first), distinct.bitmaps(loads_[1], numbers))
    return rounded(distinct.kpis(bits, distinct.joined_hours(*map(distinct.hours, loads_)), chosen))


def _records_with_other_fields(spark, sf_dir):
    landed = X.cases_with_other_fields(spark, sf_dir)
    return records.sound_records(records.unwrap(X.pages(landed)), schemas.REQUEST)


def _undeclared_fields(spark, sf_dir):
    return records.undeclared_fields(_records_with_other_fields(spark, sf_dir), schemas.CASE_FIELDS)


def _field_census(spark, sf_dir):
    return records.field_census(_records_with_other_fields(spark, sf_dir), schemas.CASE_FIELDS)


def _other_fields(spark, sf_dir):
    """Cases with two undeclared fields as columns and the rest of them as a text of sorted entries."""
    flat = records.flatten(_records_with_other_fields(spark, sf_dir), schemas.CASE_FIELDS, rest=True)
    wide = records.widened(flat, ["novoCampo", "prazo extra"])
    entries = F.array_sort(F.map_entries(records.REST))
    rest = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("(null)")))), "; ")
    return wide.select(ID, "solicitante", "novoCampo", "prazo extra", rest.alias("rest"))


def _src_requests(spark, sf_dir):
    return X.requests_from_pages(spark, sf_dir).drop("processId")


def _src_payments(spark, sf_dir):
    return X.payments_from_pages(spark, sf_dir).drop("processId")


def _lead_time(spark, sf_dir):
    rows = X.clean_cases(spark, sf_dir)
    return rounded(rows.select(ID, "startDate", "endDate", "lead_time"))


def _sla_status(spark, sf_dir):
    rows = X.clean_cases(spark, sf_dir)
    return rounded(rows.select(ID, "gravidadeMaxima", "tbIrregularidade___1", "lead_time", "slaStatus"))


def _filter_options(spark, sf_dir):
    pages = {
        "cases": offered_values(X.clean_cases(spark, sf_dir), cases.CHOICES),
        "payments": offered_values(X.clean_payments(spark, sf_dir), payments.CHOICES),
        "value_chain": value_chain.offered(X.chain_wide(spark, sf_dir)),
    }
    named = [rows.select(F.lit(page).alias("page"), "field", "value") for page, rows in pages.items()]
    return named[0].union(named[1]).union(named[2])


def _window_filter(spark, sf_dir):
    rows = X.clean_cases(spark, sf_dir)
    return rows.where(SOME_YEARS.holds()).select(ID, "startDate", "endDate")


def _window_bounds(spark, sf_dir):
    days = bounds(X.clean_cases(spark, sf_dir), X.LAST_DAY)
    return days.select(*[F.date_format(name, "yyyy-MM-dd").alias(name) for name in days.columns])


def _kpi_general(spark, sf_dir):
    return rounded(cases.kpis(cases.general(X.clean_cases(spark, sf_dir), EVERYTHING)))


def _case_one(spark, sf_dir):
    return cases.card(first_case(_filtered_cases(spark, sf_dir)))


def _payment_one(spark, sf_dir):
    return payments.card(first_case(_filtered_payments(spark, sf_dir)))


def _case_timeline(spark, sf_dir):
    return cases.timeline(_filtered_cases(spark, sf_dir), X.clean_activities(spark, sf_dir))


def _general_of_units(spark, sf_dir):
    return rounded(cases.kpis(cases.general(X.clean_cases(spark, sf_dir), EVERYTHING, X.CHOSEN_UNITS)))


def _chain_chosen(spark, sf_dir):
    rows = value_chain.filtered(X.chain_long(spark, sf_dir), X.CHOSEN_CHAIN)
    return rounded(value_chain.hours_by_unit_type(rows))


def _top(column, n):
    return _of_chain(lambda rows: value_chain.top_in_high_season(rows, column, n))


def _monthly(plan):
    def query(spark, sf_dir):
        rows = rounded(plan(_filtered_cases(spark, sf_dir)))
        return rows.withColumn("month_end", F.date_format("month_end", "yyyy-MM-dd"))

    return query


def flagship(spark, sf_dir):
    """General KPIs per unit, from landed forms to numbers."""
    flat = _flatten_requests(spark, sf_dir)
    rows = cases.general(cases.clean_cases(flat, X.AS_OF), EVERYTHING)
    return rounded(cases.kpis(rows, by=["unidade"]))


QUERIES = {
    # sources
    "src_requests": _src_requests,
    "src_payments": _src_payments,
    "bad_records": _bad_records,
    "landed_again": _landed_again,
    "landing_outcomes": _landing_outcomes,
    "loaded_in_steps": _loaded_in_steps,
    "outcomes_observed": _outcomes_observed,
    "undeclared_fields": _undeclared_fields,
    "field_census": _field_census,
    "other_fields": _other_fields,
    "flatten_requests": _flatten_requests,
    "activities_clean": _of_activities(lambda rows: rows),
    "src_activities": _src_activities,
    "src_wide": X.chain_wide,
    "sheet_from_csv": _sheet_from_csv,
    "versions_from_csv": _versions_from_csv,
    "detail_from_csv": _detail_from_csv,
    "kpi_from_parquet": _kpi_from_parquet,
    "versions_stacked": X.stacked_versions,
    "versions_from_workbooks": _versions_from_workbooks,
    # cleaning
    "lead_time": _lead_time,
    "loss_clean": _case_label("prejFinanc"),
    "severity_norm": _case_label("gravidadeMaxima"),
    "measure_norm": _case_label("mddCorretSelecionada"),
    "unit_norm": _case_label("unidade"),
    "irregularity_norm": _case_label("tbIrregularidade___1"),
    "status_norm": _case_label("status"),
    "sla_source_norm": _payment_label("slaStatus"),
    "sla_status": _sla_status,
    "department_norm": _payment_label("departamentoSolicitante"),
    # filters
    "filter_options": _filter_options,
    "window_filter": _window_filter,
    "window_bounds": _window_bounds,
    "case_one": _case_one,
    "cases_looked_up": _cases_looked_up,
    "timeline_looked_up": _timeline_looked_up,
    "kpi_chosen": _of_cases(cases.kpis, X.CHOSEN_CASES),
    "kpi_units": _general_of_units,
    "payments_chosen": _of_payments(payments.by_unit, X.CHOSEN_PAYMENTS),
    "vc_chosen": _chain_chosen,
    # cases
    "kpi_general": _kpi_general,
    "kpi_general_by_unit": flagship,
    "report_kept": _report_kept,
    "kpi_from_states": _kpi_from_states,
    "kpi_filtered": _of_cases(cases.kpis),
    "cases_by_unit": _of_cases(cases.by_unit),
    "irregularity_by_unit": _of_cases(cases.irregularities_by_unit),
    "severity_totals": _of_cases(cases.severity_totals),
    "lead_by_unit": _of_cases(cases.lead_by_unit),
    "measures_by_unit": _of_cases(cases.measures_by_unit),
    "rank_units": _of_cases(cases.rank_units),
    "rank_irregularities": _of_cases(cases.rank_irregularities),
    "rank_measures": _of_cases(cases.rank_measures),
    "rank_lead_units": _of_cases(cases.rank_lead_units),
    "lead_by_task": _of_activities(cases.lead_by_task),
    "rank_lead_tasks": _of_activities(cases.rank_lead_tasks),
    "case_timeline": _case_timeline,
    "case_detail": _of_cases(cases.detail),
    "case_cards": _of_cases(cases.card),
    # payments
    "payment_kpis": _of_payments(payments.kpis),
    "payments_by_unit": _of_payments(payments.by_unit),
    "payments_by_department": _of_payments(payments.by_department),
    "payment_lead_by_unit": _of_payments(payments.lead_by_unit),
    "rank_payment_units": _of_payments(payments.rank_units),
    "rank_departments": _of_payments(payments.rank_departments),
    "rank_payment_lead": _of_payments(payments.rank_lead_units),
    "payment_one": _payment_one,
    "payment_cards": _of_payments(payments.card),
    "payment_detail": _of_payments(payments.detail),
    # value chain
    "vc_long": lambda spark, sf_dir: rounded(X.chain_long(spark, sf_dir)),
    "vc_filtered": _of_chain(lambda rows: rows),
    "vc_kpis": _of_chain(value_chain.kpis),
    "vc_kpis_bitmaps": _chain_bitmaps,
    "vc_kpis_chosen_bitmaps": lambda spark, sf_dir: _chain_bitmaps(spark, sf_dir, X.CHOSEN_CHAIN),
    "season_ratio": _of_chain(value_chain.season_ratio),
    "hours_by_unit": _of_chain(value_chain.hours_by_unit),
    "hours_by_type": _of_chain(value_chain.hours_by_type),
    "hours_by_unit_type": _of_chain(value_chain.hours_by_unit_type),
    "automation_count": _of_chain(value_chain.automation_count),
    "automation_mean": _of_chain(value_chain.automation_mean),
    "hierarchy_hours": _of_chain(value_chain.hierarchy),
    "top_processes": _top("Processo", 6),
    "top_procedures": _top("Procedimento", 6),
    "top_activities": _top("Atividade", 10),
    "staffing": _of_chain(value_chain.staffing),
    "staffing_long": _of_chain(value_chain.staffing_long),
    # versions
    "version_metrics": _of_versions(versions.metrics),
    "hierarchy_versions": _of_versions(versions.hierarchy),
    "version_diff": _of_versions(lambda rows: versions.diff(rows, X.CHOSEN_VERSIONS)),
    "version_diff_long": _of_versions(lambda rows: versions.diff_long(rows, X.CHOSEN_VERSIONS)),
    "version_gap": _of_versions(lambda rows: versions.gap(rows, X.CHOSEN_VERSIONS)),
    "version_rows": X.chosen_versions,
    # reserve
    "cases_by_city": _of_cases(trends.by_city),
    "cases_by_region": _of_cases(trends.by_region),
    "irregularity_by_place": _of_cases(trends.irregularities_by_place),
    "irregularity_severity": _of_cases(trends.irregularity_severity),
    "measures_by_city": _of_cases(trends.measures_by_city),
    "sla_share": _of_cases(trends.status_shares),
    "monthly_cases": _monthly(trends.monthly_cases),
    "monthly_loss": _monthly(trends.monthly_loss),
    "severity_pivot": _of_cases(trends.severity_pivot),
    "rank_cities": _of_cases(trends.rank_cities),
}
