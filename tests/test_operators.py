"""Filters, ranks, shares and the timeline on hand-written rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from workpulse.functions.dates import mean_days
from workpulse.operators import ranking
from workpulse.operators.filters import ALL, Choice, Offer, Validity, all_members, bounds, first_case, offered_values
from workpulse.operators.grouping import count_by, sum_by, with_share
from workpulse.plans import cases, payments, trends


def _values(frame, column):
    return sorted((row[column] for row in frame.collect()), key=lambda v: (v is None, str(v)))


@pytest.fixture(scope="module")
def letters(spark):
    return spark.createDataFrame([("a",), ("b",), ("c",), ("",), (None,)], "x string")


@pytest.mark.parametrize(
    "offer, chosen, expected",
    [
        (Offer.KEEP_NULL, ALL, ["", "a", "b", "c", None]),
        (Offer.NOT_NULL, ALL, ["", "a", "b", "c"]),
        (Offer.FIXED, ALL, ["a", "b"]),
        (Offer.KEEP_NULL, ["a"], ["a"]),
        (Offer.KEEP_NULL, ["a", None], ["a", None]),
        (Offer.KEEP_NULL, [None], [None]),
        (Offer.NOT_NULL, ["a", "z"], ["a"]),
        (Offer.NOT_NULL, ["a", ALL], ["", "a", "b", "c"]),
        (Offer.NOT_NULL, [], []),
    ],
)
def test_choice(letters, offer, chosen, expected):
    choice = Choice("x", offer, ("a", "b"))
    assert _values(letters.where(choice.member(chosen)), "x") == expected


def test_unknown_filter_is_refused(letters):
    with pytest.raises(ValueError):
        all_members([Choice("x", Offer.NOT_NULL)], {"y": ["a"]})


def test_a_text_is_no_choice(letters):
    with pytest.raises(ValueError):
        all_members([Choice("x", Offer.KEEP_NULL)], {"x": "abc"})


def test_offered_values(letters):
    kept = offered_values(letters, [Choice("x", Offer.KEEP_NULL)])
    assert _values(kept, "value") == ["", "a", "b", "c", None]
    mixed = letters.withColumn("y", F.col("x"))
    both = offered_values(mixed, [Choice("x", Offer.NOT_NULL), Choice("y", Offer.FIXED, ("q",))])
    assert {(r.field, r.value) for r in both.collect()} == {("x", v) for v in ("", "a", "b", "c")} | {("y", "q")}


def test_policies_of_the_reports():
    kept = {c.column for c in cases.CHOICES if c.offer is Offer.KEEP_NULL}
    assert kept == {"status", "slaStatus", "unidade", "solicitante"}
    assert [c.column for c in cases.CHOICES if c.offer is Offer.NOT_NULL] == ["mddCorretSelecionada"]
    assert {c.offer for c in payments.CHOICES} == {Offer.NOT_NULL} and len(payments.CHOICES) == 7


def test_validity(spark):
    stamp = "TIMESTAMP_NTZ"
    rows = spark.sql(
        f"""SELECT * FROM VALUES
        ('open inside', {stamp}'2024-01-02 00:00:00', NULL),
        ('open late', {stamp}'2024-02-01 00:00:00', NULL),
        ('ends last instant', {stamp}'2024-01-02 00:00:00', {stamp}'2024-01-31 23:59:59.999999'),
        ('ends after', {stamp}'2024-01-02 00:00:00', {stamp}'2024-02-01 00:00:00'),
        ('starts before', {stamp}'2023-12-31 23:59:59', {stamp}'2024-01-02 00:00:00'),
        ('starts first instant', {stamp}'2024-01-01 00:00:00', {stamp}'2024-01-01 00:00:00'),
        ('no start', NULL, {stamp}'2024-01-01 00:00:00') AS t(name, startDate, endDate)"""
    )
    window = Validity(first=dt.date(2024, 1, 1), last=dt.date(2024, 1, 31))
    expected = ["ends last instant", "open inside", "starts first instant"]
    assert _values(rows.where(window.holds()), "name") == expected
    # Without a first day the earliest start counts, which every row with a start passes.
    first = bounds(rows, dt.date(2024, 1, 31)).first()
    assert first.first_day == dt.date(2023, 12, 31)
    given = Validity(first=first.first_day, last=dt.date(2024, 1, 31))
    by_default = rows.where(Validity(last=dt.date(2024, 1, 31)).holds())
    assert _values(rows.where(given.holds()), "name") == _values(by_default, "name")


def test_first_case(spark):
    rows = spark.sql(
        "SELECT * FROM VALUES ('b', TIMESTAMP_NTZ'2024-01-01'), ('a', TIMESTAMP_NTZ'2024-01-01'), ('c', NULL)"
        " AS t(processInstanceId, startDate)"
    )
    assert first_case(rows).first()[0] == "a"
    assert first_case(rows, "c").first()[0] == "c"
    assert first_case(rows, "zz").count() == 0


def _ranked(frame, **options):
    rows = ranking.with_position(frame, "m", "k", **options).collect()
    return {row.k: row.ranking for row in rows}


@pytest.mark.parametrize("groups", [0, 1, 5, 3000])
@pytest.mark.parametrize("descending", [True, False])
def test_positions_equal_brute_force(spark, groups, descending):
    """A third of the groups tie on one measure and some have none."""
    rng = random.Random(groups)
    data = [
        (f"k{rng.random():.9f}{i}", 1 if i % 3 == 0 else None if i % 50 == 7 else rng.randint(0, 500))
        for i in range(groups)
    ]
    frame = spark.createDataFrame(data, "k string, m long").repartition(7)
    sign = -1 if descending else 1
    ordered = sorted(data, key=lambda r: (r[1] is None, sign * (r[1] or 0), r[0]))
    expected = {key: place for place, (key, _) in enumerate(ordered, 1)}
    assert _ranked(frame, descending=descending) == expected


def test_pieces_spread_groups_that_tie(spark):
    """No task gets all groups when every one has the same measure."""
    frame = spark.range(20000).select(F.col("id").cast("string").alias("k"), F.lit(1).alias("m"))
    ranked = ranking.with_position(frame, "m", "k")
    assert ranked.agg(F.count_distinct("ranking"), F.max("ranking")).first() == (20000, 20000)
    plan = ranked._jdf.queryExecution().optimizedPlan().toString()
    assert "_piece" in plan and "Cartesian" not in ranked._jdf.queryExecution().executedPlan().toString()


def test_mean_ranks_are_reproducible(spark):
    """The same rows in other orders give the same means bit by bit."""
    frame = spark.range(5000).select((F.col("id") % 40).alias("k"), (F.col("id") * 37 % 1009 / 24).alias("d"))
    seen = set()
    for parts in (1, 3, 8):
        means = frame.repartition(parts).groupBy("k").agg(mean_days(F.col("d")).alias("m"))
        seen.add(tuple(sorted((row.k, row.m) for row in means.collect())))
    assert len(seen) == 1


def test_groups_leave_null_keys_out(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", None), ("", 2.0), (None, 9.0), ("e", None)], "k string, v double")
    assert {(r.k, r.total) for r in count_by(rows, "k").collect()} == {("a", 2), ("", 1), ("e", 1)}
    assert {(r.k, r.v) for r in sum_by(rows, "v", "k").collect()} == {("a", 1.0), ("", 2.0), ("e", 0.0)}


def test_share(spark):
    rows = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "k string, v double")
    assert {(r.k, r.share) for r in with_share(rows, "v").collect()} == {("a", 0.25), ("b", 0.75)}
    empty = with_share(rows.where("v < 0"), "v")
    assert empty.collect() == []
    zero = with_share(rows.withColumn("v", F.lit(0.0)), "v")
    assert {r.share for r in zero.collect()} == {None}


def test_kpis_of_nothing(spark, sf_dir):
    from workpulse.checks import fixtures as X

    none = X.clean_cases(spark, sf_dir).where("processInstanceId = 'none'")
    row = cases.kpis(none).first()
    assert (row.total, row.finished, row.on_time, row.mean_lead, row.total_loss) == (0, 0, 0, None, 0.0)


def test_months_without_cases(spark):
    rows = spark.sql(
        "SELECT * FROM VALUES (TIMESTAMP_NTZ'2024-01-31 10:00:00', 5D), (TIMESTAMP_NTZ'2024-04-01', NULL),"
        " (TIMESTAMP_NTZ'2024-04-30', 2D), (NULL, 7D) AS t(startDate, prejFinanc)"
    )
    got = [tuple(row) for row in trends.monthly(rows).orderBy("month_end").collect()]
    day = dt.date
    assert got == [(day(2024, 1, 31), 1, 5.0), (day(2024, 2, 29), 0, 0.0), (day(2024, 3, 31), 0, 0.0), (day(2024, 4, 30), 2, 2.0)]
    assert trends.monthly(rows.where("startDate IS NULL")).count() == 0


def test_hot_case_keeps_its_whole_timeline(spark):
    """One case holds a third of the activities; all of them come back, in order of their start."""
    activities = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("processInstanceId"),
        F.lit("Fim").alias("stateName"),
        (F.timestamp_seconds(F.lit(10**9) - F.col("id"))).cast("timestamp_ntz").alias("startDate"),
        F.lit(None).cast("timestamp_ntz").alias("endDate"),
    )
    chosen = spark.createDataFrame([("hot",), ("hot",), ("1",), ("absent",)], "processInstanceId string")
    rows = cases.timeline(chosen, activities).collect()
    assert [r.processInstanceId for r in rows].count("hot") == 3000 and len(rows) == 3001
    starts = [r.startDate for r in rows if r.processInstanceId == "hot"]
    assert starts == sorted(starts)


def test_activity_states(spark, as_of):
    rows = spark.sql(
        "SELECT id AS processInstanceId, named_struct('stateName', s) AS state, TIMESTAMP_NTZ'2024-04-30 12:00:00' AS"
        " startDate, CAST(NULL AS TIMESTAMP_NTZ) AS endDate FROM VALUES ('1', 'Fim'), ('2', 'Outro'), ('3', NULL) AS t(id, s)"
    )
    assert [(r.processInstanceId, r.lead_time) for r in cases.clean_activities(rows, as_of).collect()] == [("1", 1.0)]


def test_chosen_values_against_brute_force(spark, sf_dir):
    """Filters with real choices agree with Python over the cleaned rows."""
    from workpulse.checks import fixtures as X

    clean = X.clean_cases(spark, sf_dir)
    chosen = {"status": ["Aberto", None], "gravidadeMaxima": ["Leve", "Grave"], "solicitante": ["BUILDING", "MACHINERY"],
              "unidade": ["NATION_1", None, "CEEM Boa Vista/Manaus"], "slaStatus": ["Em Atraso"]}
    window = Validity(first=dt.date(1996, 1, 1), last=dt.date(2000, 6, 30))
    got = {r[0] for r in cases.filtered(clean, window, chosen).select("processInstanceId").collect()}
    after = dt.datetime(2000, 7, 1)
    expected = {
        r.processInstanceId
        for r in clean.collect()
        if all(r[name] in values for name, values in chosen.items())
        and r.mddCorretSelecionada is not None
        and r.startDate >= dt.datetime(1996, 1, 1)
        and (r.endDate < after if r.endDate else r.startDate < after)
    }
    assert got == expected and got


def test_hot_case_is_split_over_tasks(spark, tmp_path):
    """With joins by sort, the activities of a case that holds a third of them are read by several tasks."""
    path = str(tmp_path / "activities")
    hot = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string"))
    made = spark.range(0, 300000, 1, 8).select(
        hot.alias("processInstanceId"),
        F.xxhash64("id").cast("string").alias("stateName"),
        F.timestamp_seconds(F.xxhash64("id") % 10**9).cast("timestamp_ntz").alias("startDate"),
        F.lit(None).cast("timestamp_ntz").alias("endDate"),
    )
    made.write.parquet(path)
    chosen = spark.range(0, 300000, 1, 8).select(hot.alias("processInstanceId"))
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100k",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        rows = cases.timeline(chosen, spark.read.parquet(path)).agg(
            F.count(F.lit(1)), F.max(F.struct("startDate", "stateName", "endDate"))
        )
        assert rows.collect()[0][0] == 300000
        assert "SortMergeJoin(skew=true)" in rows._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
