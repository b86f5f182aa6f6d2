"""Sums and bitmaps that are put together again, against scans of all rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from workpulse import labels as L
from workpulse.operators.filters import Validity
from workpulse.plans import cases, distinct, states, value_chain

COLUMNS = "processInstanceId string, startDate timestamp_ntz, endDate timestamp_ntz, status string, gravidadeMaxima string, tbIrregularidade___1 string, mddCorretSelecionada string, unidade string, prejFinanc string"
LOSSES = ["12.5", "1,000.01", "0", " ", None, "0.1", "0.2", "99999.99"]


def _case(rng, number):
    start = dt.datetime(2024, 1, 1) + dt.timedelta(microseconds=rng.randrange(60 * 86_400_000_000))
    ended = rng.random() < 0.6
    end = start + dt.timedelta(microseconds=rng.randrange(-86_400_000_000, 20 * 86_400_000_000)) if ended else None
    return (
        str(number), None if rng.random() < 0.05 else start, end, rng.choice(["OPEN", "FINALIZED", "x"]), rng.choice(["leve", "grave", "moderada", None]),
        rng.choice(["desidia_grave", "indefinido_outra", None]), None, rng.choice(["A", "B", "C", None]), rng.choice(LOSSES),
    )


@pytest.fixture
def clean(spark, as_of):
    def build(rows):
        return cases.clean_cases(spark.createDataFrame(rows, COLUMNS).repartition(3), as_of)

    return build


WINDOWS = [Validity(last=dt.date(2024, 4, 30)), Validity(last=dt.date(2024, 2, 10)), Validity(first=dt.date(2024, 1, 15), last=dt.date(2024, 2, 20))]


def _rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_sums_equal_a_scan_after_many_changes(spark, clean):
    rng = random.Random(7)
    now = {n: _case(rng, n) for n in range(200)}
    first = clean(list(now.values()))
    kept, still = states.states(first), states.still_open(first)
    for step in range(3):
        before = [now[n] for n in rng.sample(sorted(now), 60)]
        after = [_case(rng, int(row[0])) for row in before] + [_case(rng, 1000 * (step + 1) + i) for i in range(30)]
        now |= {int(row[0]): row for row in after}
        old, new = clean(before), clean(after)
        kept, still = states.changed(kept, old, new), states.changed_open(still, old, new)
    # The plans of the steps lie one in another; kept as tables in use.
    kept, still = spark.createDataFrame(kept.collect(), kept.schema), spark.createDataFrame(still.collect(), still.schema)
    full = clean(list(now.values()))
    again = states.states(full)
    assert _rows(kept) == _rows(again)
    for window in WINDOWS:
        for units in (None, ["A", None], ["Todos"], ["none"]):
            for by in ((), ("unidade",)):
                ours = _rows(states.kpis(kept, still, window, units, by))
                theirs = _rows(cases.kpis(cases.general(full, window, units), by))
                assert [row[:-1] for row in ours] == [row[:-1] for row in theirs]
                assert [row[-1] for row in ours] == pytest.approx([row[-1] for row in theirs], rel=1e-12)
                assert ours == _rows(states.kpis(again, states.still_open(full), window, units, by))
    lead = {r.unidade: (r.total, r.lead_time) for r in states.by_unit(kept, still, WINDOWS[0]).collect()}
    ours = cases.general(full, WINDOWS[0])
    counts = {r.unidade: r.total for r in cases.by_unit(ours).collect()}
    means = {r.unidade: r.lead_time for r in cases.lead_by_unit(ours).collect()}
    assert lead == {unit: (counts[unit], means[unit]) for unit in counts}


def test_losses_add_up_exactly(spark, clean):
    rows = [(str(i), dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2), "FINALIZED", "leve", None, None, "A", "0.1") for i in range(10)]
    kept = states.states(clean(rows))
    assert states.kpis(kept, clean([]), WINDOWS[0]).first().total_loss == 1.0


def test_losses_beyond_exact_decimals_count_too(spark, clean):
    losses = ["1e25", "3.3333333333", "2.5"]
    rows = [(str(i), dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2), "FINALIZED", "leve", None, None, "A", loss) for i, loss in enumerate(losses)]
    kept = states.states(clean(rows))
    assert states.kpis(kept, clean([]), WINDOWS[0]).first().total_loss == pytest.approx(1e25)
    less = states.changed(kept, clean(rows[:1]), clean([]))
    assert states.kpis(less, clean([]), WINDOWS[0]).first().total == 2


def test_open_cases_go_by_the_moment_of_the_report(spark):
    rows = [("1", dt.datetime(2024, 1, 1), None, "OPEN", "leve", None, None, "A", None), ("2", dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1, 12), "FINALIZED", "leve", None, None, "A", None)]
    flat = spark.createDataFrame(rows, COLUMNS)
    kept = states.states(cases.clean_cases(flat, dt.datetime(2024, 1, 1, 6)))
    for hours, on_time in ((6, 2), (30, 1)):
        at = cases.clean_cases(flat, dt.datetime(2024, 1, 1) + dt.timedelta(hours=hours))
        row = states.kpis(kept, states.still_open(at), Validity(last=dt.date(2024, 5, 1))).first()
        assert (row.total, row.on_time, row.mean_lead) == (2, on_time, (hours + 12) / 2 / 24)


def test_nothing(clean):
    none = clean([])
    assert [tuple(r) for r in states.kpis(states.states(none), none, WINDOWS[0]).collect()] == [(0, 0, 0, 0, 0, None, 0.0)]
    assert states.kpis(states.states(none), none, WINDOWS[0], by=["unidade"]).collect() == []


# ---- Bitmaps ---------------------------------------------------------------------------------------------------------

KIND = "Tipo de Procedimento"
LONG = f"`Unidade` string, `Temporada` string, `{KIND}` string, `{L.AUTOMATION}` string, `Processo` string, `Procedimento` string, `Atividade` string, `Tarefa` string, `{L.DEMAND}` double"


def _long(rng, count):
    def maybe(value):
        return value if rng.random() < 0.9 else None

    return [
        (rng.choice("ABC"), rng.choice(L.SEASONS), rng.choice(["x", "y"]), rng.choice(["Total", "Parcial"]), f"p{rng.randrange(9)}", maybe(f"q{rng.randrange(40)}"),
         maybe(f"a{rng.randrange(200)}"), maybe(f"t{rng.randrange(1000)}"), rng.randrange(80) / 8) for _ in range(count)
    ]


def test_bitmaps_answer_any_choice(spark):
    rng = random.Random(3)
    parts = [spark.createDataFrame(_long(rng, n), LONG).repartition(3) for n in (300, 200, 1)]
    numbers, bits, sums = None, [], []
    for part in parts:
        numbers = distinct.numbered(part, numbers)
        numbers = spark.createDataFrame(numbers.collect(), numbers.schema)
        bits.append(distinct.bitmaps(part, numbers))
        sums.append(distinct.hours(part))
    kept, hours = distinct.joined_bitmaps(*bits), distinct.joined_hours(*sums)
    kept, hours = spark.createDataFrame(kept.collect(), kept.schema), spark.createDataFrame(hours.collect(), hours.schema)
    rows = parts[0].union(parts[1]).union(parts[2])
    listed = sorted(r.number for r in numbers.collect())
    assert listed == list(range(1, len(listed) + 1))
    for chosen in (None, {"Unidade": ["A"]}, {"Unidade": ["A", "C"], "Temporada": ["Alta"]}, {KIND: ["x"], L.AUTOMATION: ["Total"]}, {"Unidade": ["none"]}):
        assert distinct.kpis(kept, hours, chosen).first() == value_chain.kpis(value_chain.filtered(rows, chosen)).first()
    with pytest.raises(ValueError):
        distinct.kpis(kept, hours, {"Processo": ["p1"]})


def test_numbers_beyond_one_bitmap(spark):
    rows = spark.range(70_000).select(
        F.lit("A").alias("Unidade"), F.lit("Alta").alias("Temporada"), F.lit("x").alias(KIND), F.lit("Total").alias(L.AUTOMATION), F.lit("p").alias("Processo"),
        F.lit(None).cast("string").alias("Procedimento"), (F.col("id") % 5).cast("string").alias("Atividade"), F.col("id").cast("string").alias("Tarefa"), F.lit(1.0).alias(L.DEMAND),
    )
    bits = distinct.bitmaps(rows, distinct.numbered(rows))
    got = distinct.kpis(bits, distinct.hours(rows)).first()
    assert (got.tasks, got.activities, got.procedures, got.processes, got.total_hours) == (70_000, 5, 0, 1, 70_000.0)
    assert bits.where("component = 3").count() == 3 and bits.agg(F.max(F.length("bits"))).first()[0] == 4096


def test_numbering_tests_no_row_below_the_groups(spark):
    rows = spark.createDataFrame(_long(random.Random(5), 50), LONG)
    plan = distinct.numbered(rows)._jdf.queryExecution().optimizedPlan().toString()
    tests = [line for line in plan.splitlines() if "Filter" in line.split("(")[0]]
    assert tests and not any("lambda" in line or "subquery" in line for line in tests)


def test_each_bitmap_is_built_in_one_task(spark):
    rows = spark.createDataFrame(_long(random.Random(6), 50), LONG)
    plan = distinct.bitmaps(rows, distinct.numbered(rows))._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("Exchange hashpartitioning")]
    assert above.count("partial_bitmap_construct_agg") == 1 and above.count("bitmap_construct_agg") == 2
    assert "hashpartitioning(component" in plan[plan.index("Exchange hashpartitioning") :].splitlines()[0]


def test_bitmaps_of_nothing(spark):
    rows = spark.createDataFrame([], LONG)
    assert tuple(distinct.kpis(distinct.bitmaps(rows, distinct.numbered(rows)), distinct.hours(rows)).first()) == (0.0, 0, 0, 0, 0, 0)
