"""What the plans must and must not hold."""

import contextlib
import io
import re

import pytest

from workpulse.checks import fixtures as X
from workpulse.checks.queries import EVERYTHING, QUERIES
from workpulse.plans import cases, payments

# Their scan is the data source of workbooks.
READ_BY_PYTHON = ("versions_from_workbooks",)
# The JVM does not compile methods above this size.
COMPILED_BYTES = 8000


@pytest.fixture(scope="module")
def static(spark):
    """The session with adaptive planning off, so the plan shows its code."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan(name, static, sf_dir):
    frame = QUERIES[name](static, sf_dir)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "ArrowEval", "localCheckpoint"):
        assert unwanted not in plan or (unwanted == "Python" and name in READ_BY_PYTHON)
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        frame.explain("codegen")
    sizes = [int(size) for size in re.findall(r"maxMethodCodeSize:(-?\d+)", out.getvalue())]
    assert sizes and -1 not in sizes and max(sizes) < COMPILED_BYTES


# A window without partitions may see the pieces of a ranking, the months of the calendar or the literal n of a top list.
BOUND = 400


@pytest.mark.parametrize("name", sorted(name for name in QUERIES if re.match("rank_|monthly_|top_", name)))
def test_windows_without_partitions_see_few_rows(name, static, sf_dir):
    """The rows that reach such a window, as counted by the sort below it, whatever the query is called."""
    frame = QUERIES[name](static, sf_dir)
    frame.collect()
    seen = _inputs_of_lone_windows(frame._jdf.queryExecution().executedPlan())
    assert max(seen, default=0) <= BOUND


def test_other_queries_have_no_window_without_partitions(static, sf_dir):
    for name in sorted(name for name in QUERIES if not re.match("rank_|monthly_|top_", name)):
        plan = QUERIES[name](static, sf_dir)._jdf.queryExecution().executedPlan()
        assert not _inputs_of_lone_windows(plan), name


def _inputs_of_lone_windows(node):
    found = []
    children = node.children()
    below = [children.apply(i) for i in range(children.size())]
    if node.nodeName() == "Window" and node.partitionSpec().isEmpty():
        counted = below[0]
        while not counted.metrics().contains("shuffleRecordsWritten") and not counted.metrics().contains("numOutputRows"):
            counted = counted.children().apply(0)
        metrics = counted.metrics()
        name = "shuffleRecordsWritten" if metrics.contains("shuffleRecordsWritten") else "numOutputRows"
        found.append(metrics.apply(name).value())
    for child in below:
        found += _inputs_of_lone_windows(child)
    return found


def test_scan_reads_only_what_a_report_needs(spark, sf_dir):
    plan = QUERIES["lead_by_task"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    read = re.search(r"FileScan parquet \[([^\]]*)\]", plan).group(1)
    assert "l_extendedprice" not in read and "l_partkey" not in read and "l_shipdate" in read


def test_window_reaches_the_scan(spark, sf_dir):
    plan = QUERIES["window_filter"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate,1996-03-01" in plan


def test_record_text_is_parsed_once(spark, sf_dir):
    plan = QUERIES["src_requests"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json(StructField(processInstanceId") == 1


def test_labels_are_worked_out_once(spark, sf_dir):
    rows = cases.filtered(X.clean_cases(spark, sf_dir), EVERYTHING)
    plan = cases.measures_by_unit(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Advertência Escrita) THEN") == 1


SOURCES = {
    "loss": "format_number(o_totalprice",
    "irregularity": "infracaotransito) THEN",
    "measure": "Advertência Escrita) THEN",
    "severity": "média) THEN",
    "department": "DPTO PESSOAL) THEN",
}


def test_labels_that_a_report_does_not_use_are_pruned(spark, sf_dir):
    def held(frame):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        return {name for name, text in SOURCES.items() if text in plan}

    assert "measure" not in held(QUERIES["kpi_general"](spark, sf_dir))
    assert "loss" not in held(QUERIES["filter_options"](spark, sf_dir))
    assert held(cases.by_unit(X.clean_cases(spark, sf_dir))) == set()
    assert held(QUERIES["cases_by_city"](spark, sf_dir)) == {"measure", "severity"}
    assert held(payments.kpis(X.clean_payments(spark, sf_dir))) == set()


def test_kpis_take_one_scan_and_one_shuffle(spark, sf_dir):
    plan = QUERIES["lead_by_task"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 1
    plan = QUERIES["season_ratio"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1
