"""Clustered tables and counts that come with the pass that reads."""

import json
import subprocess
import sys
import textwrap

import pytest
from pyspark.sql import Observation, functions as F

from workpulse import schemas, sinks
from workpulse.operators.filters import cases_of
from workpulse.sources import records

from test_landings import case, land


def _scanned(frame):
    """Rows of the result and rows that the scan let through."""
    rows = frame.collect()
    leaves = frame._jdf.queryExecution().executedPlan().collectLeaves()
    return rows, sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("clustered") / "t")
    rows = spark.range(200_000).select(F.xxhash64("id").cast("string").alias("processInstanceId"), F.repeat(F.md5(F.col("id").cast("string")), 4).alias("descFato"), F.create_map(F.lit("a"), F.lit("b")).alias("m"))
    sinks.write_clustered(rows.repartition(8), path, "processInstanceId", row_group=1 << 20)
    return spark.read.parquet(path)


def test_a_lookup_reads_few_row_groups(spark, table):
    wanted = [r.processInstanceId for r in table.where(F.xxhash64("processInstanceId") % 50_000 == 0).collect()]
    assert wanted
    rows, read = _scanned(cases_of(table, wanted[:1]))
    assert [r.processInstanceId for r in rows] == wanted[:1] and read < 20_000
    none, read = _scanned(cases_of(table, ["5"]))
    assert none == [] and read < 20_000
    assert table.count() == 200_000


def test_a_hot_value_lies_in_many_files(spark, tmp_path):
    rows = spark.range(40_000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("processInstanceId"), "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows make one file
    try:
        sinks.write_clustered(rows, str(tmp_path / "t"), "processInstanceId")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    back = spark.read.parquet(str(tmp_path / "t"))
    assert back.where("processInstanceId = 'hot'").select(F.input_file_name()).distinct().count() > 2
    assert back.count() == 40_000 and cases_of(back, ["hot", "3"]).count() == rows.where("processInstanceId in ('hot', '3')").count()


def test_null_ids_and_no_rows(spark, tmp_path):
    for name, rows in (("nulls", [(None, 1), ("a", 2), (None, 3)]), ("empty", [])):
        frame = spark.createDataFrame(rows, "processInstanceId string, n int")
        sinks.write_clustered(frame, str(tmp_path / name), "processInstanceId")
        back = spark.read.schema(frame.schema).parquet(str(tmp_path / name))
        assert sorted(map(str, back.collect())) == sorted(map(str, frame.collect()))
        assert cases_of(back, ["a"]).count() == len([r for r in rows if r[0] == "a"])


MIXED = [[case("1"), 17, None, case("2")], [case("3", process=None)], [case("4", status=None), case("5")]]


def _land_all(folder):
    for i, rows in enumerate(MIXED):
        land(folder, f"{i}.json", rows, 1000)
    (folder / "broken.json").write_text('{"requests": [{"x\n{"error": "denied"}\n')


def test_counts_come_with_the_pass_that_reads(spark, tmp_path):
    _land_all(tmp_path)
    seen = Observation("landed")
    rows = records.read_cases(spark, str(tmp_path), on_lost="skip", landings="all", observed=seen)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan text") == 1 and "CollectMetrics" in plan
    assert rows.count() == 3
    told = {r.outcome: r.total for r in records.outcomes_of(spark, seen).collect()}
    texts = records.read_records(spark, str(tmp_path))
    assert told == {r.outcome: r.total for r in records.outcomes(texts, schemas.REQUEST).collect()}
    assert told == {"sound": 3, "stray element": 2, "no process id": 1, "no status": 1, "broken page": 1, "no list": 1}


def test_counts_with_last_landings(spark, tmp_path):
    _land_all(tmp_path)
    land(tmp_path, "again.json", [case("1", "FINALIZED")], 2000)
    seen = Observation("landed")
    assert records.read_cases(spark, str(tmp_path), on_lost="skip", observed=seen).count() == 3
    assert seen.get["sound"] == 4


def test_tasks_that_run_again_count_once(tmp_path):
    _land_all(tmp_path)
    script = f"""
        import os, sys
        sys.path.insert(0, {json.dumps(sys.path[0])}); sys.path.insert(0, os.getcwd())
        from pyspark.sql import Observation, SparkSession
        from pyspark import TaskContext
        from workpulse.sources import records
        spark = SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
        spark.sparkContext.setLogLevel("OFF")
        seen = Observation("landed")
        rows = records.read_cases(spark, {json.dumps(str(tmp_path))}, on_lost="skip", landings="all", observed=seen).select("processInstanceId")
        def once(batches):
            for batch in batches:
                yield batch
            if TaskContext.get().attemptNumber() == 0:
                raise RuntimeError("first attempt")
        print("rows", rows.mapInArrow(once, rows.schema).count(), {{k: v for k, v in seen.get.items() if v}})
    """
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(script)], capture_output=True, text=True, timeout=240, check=False)
    assert "rows 3 {'sound': 3, 'stray element': 2, 'broken page': 1, 'no list': 1, 'no process id': 1, 'no status': 1}" in done.stdout, done.stderr[-2000:]
