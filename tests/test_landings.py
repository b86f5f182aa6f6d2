"""Cases that are landed more than once."""

import json
import os

import pytest
from pyspark.sql import functions as F

from workpulse import labels as L
from workpulse import schemas
from workpulse.sources import records


def case(number, status="OPEN", end=None, process=L.CASE_PROCESS, **form):
    fields = [{"field": name, "value": value} for name, value in form.items()]
    return {"processInstanceId": number, "processId": process, "status": status, "startDate": "2024-03-01T10:00:00-0300", "endDate": end, "formFields": fields}


def land(folder, name, rows, time, list_name="requests"):
    path = folder / name
    path.write_text(json.dumps({list_name: rows}) + "\n", encoding="utf-8")
    os.utime(path, (time, time))


END = "2024-03-05T10:00:00-0300"


def test_the_last_landing_wins(spark, tmp_path):
    land(tmp_path, "z.json", [case("1", unidade="old"), case("2"), case("3", "FINALIZED", END), case("5")], 1000)
    land(tmp_path, "a.json", [case("1", "FINALIZED", END, unidade="new"), case("2", "CANCELLED"), case("3"), case("4")], 2000)
    rows = {r.processInstanceId: r for r in records.read_cases(spark, str(tmp_path)).collect()}
    assert sorted(rows) == ["1", "3", "4", "5"]  # the second case was cancelled later, so it is no longer asked for
    assert rows["1"].status == "FINALIZED" and rows["1"].unidade == "new" and rows["1"].endDate.day == 5
    assert rows["3"].status == "OPEN" and rows["3"].endDate is None
    assert records.read_cases(spark, str(tmp_path), landings="all").count() == 7
    assert not set(records.PLACE) & set(records.read_cases(spark, str(tmp_path)).columns)
    with pytest.raises(ValueError):
        records.read_cases(spark, str(tmp_path), landings="first")


def test_ties_go_by_file_then_end_then_mark(spark, tmp_path):
    land(tmp_path, "a.json", [case("1", "FINALIZED", END), case("2", unidade="x"), case("2", unidade="y"), case("3", "FINALIZED", END), case("3")], 1000)
    land(tmp_path, "b.json", [case("1")], 1000)
    texts = records.read_records(spark, str(tmp_path), placed=True)
    rows = {r.processInstanceId: r for r in records.read_cases(spark, str(tmp_path)).collect()}
    assert rows["1"].status == "OPEN" and rows["3"].status == "FINALIZED"
    marked = {r.value: r.mark for r in texts.where("record like '%unidade%'").select(F.get_json_object("record", "$.formFields[0].value").alias("value"), F.md5(F.col("record").cast("binary")).alias("mark")).collect()}
    assert rows["2"].unidade == max(marked, key=marked.get)


def test_records_without_an_id_and_of_other_processes_stay_apart(spark, tmp_path):
    land(tmp_path, "a.json", [case(None), case(None), case("1"), case("1", process="other")], 1000)
    land(tmp_path, "b.json", [case(None), case("1", "FINALIZED", END, process="other")], 2000)
    got = sorted((str(r.processInstanceId), r.status) for r in records.read_cases(spark, str(tmp_path)).collect())
    assert got == [("1", "OPEN"), ("None", "OPEN"), ("None", "OPEN"), ("None", "OPEN")]


def test_superseded_records_are_counted(spark, tmp_path):
    land(tmp_path, "a.json", [case("1"), case("2"), 17, case(None), case(None)], 1000)
    land(tmp_path, "b.json", [case("1", "FINALIZED", END), case("1", "FINALIZED", END), case("3", process=None)], 2000)
    texts = records.read_records(spark, str(tmp_path), placed=True)
    counted = {r.outcome: r.total for r in records.outcomes(texts, schemas.REQUEST, records.CASE_KEYS).collect()}
    assert counted == {"sound": 4, "superseded": 2, "stray element": 1, "no process id": 1}
    assert {r.outcome: r.total for r in records.outcomes(texts, schemas.REQUEST).collect()} == {"sound": 6, "stray element": 1, "no process id": 1}


def test_payments_and_activities(spark, tmp_path):
    (tmp_path / "p").mkdir(), (tmp_path / "a").mkdir()
    pay = dict(process=L.PAYMENT_PROCESS)
    land(tmp_path / "p", "a.json", [case("1", tpPagamento="old", **pay)], 1000)
    land(tmp_path / "p", "b.json", [case("1", "FINALIZED", END, tpPagamento="new", **pay)], 2000)
    assert [(r.status, r.tpPagamento) for r in records.read_payments(spark, str(tmp_path / "p")).collect()] == [("FINALIZED", "new")]

    def activity(state, start, end=None):
        return {"processInstanceId": "1", "processId": L.CASE_PROCESS, "state": {"stateName": state} if state else None, "startDate": start, "endDate": end}

    land(tmp_path / "a", "a.json", [activity("Fim", "2024-01-01"), activity(None, "2024-01-01")], 1000, "activities")
    land(tmp_path / "a", "b.json", [activity("Fim", "2024-01-01", "2024-01-03"), activity("Fim", "2024-01-09"), activity(None, "2024-01-01")], 2000, "activities")
    got = sorted((str(r.state and r.state.stateName), r.startDate.day, r.endDate and r.endDate.day or 0) for r in records.read_activities(spark, str(tmp_path / "a")).collect())
    assert got == [("Fim", 1, 3), ("Fim", 9, 0), ("None", 1, 0)]
    assert records.read_activities(spark, str(tmp_path / "a"), landings="all").count() == 5


def test_lines_and_whole_files_tell_their_landing(spark, tmp_path):
    (tmp_path / "l").mkdir(), (tmp_path / "w").mkdir()
    for name, time, status in (("a", 1000, "OPEN"), ("b", 2000, "FINALIZED")):
        for folder, text in (("l", json.dumps(case("1", status))), ("w", json.dumps({"requests": [case("1", status)]}, indent=1))):
            path = tmp_path / folder / f"{name}.json"
            path.write_text(text, encoding="utf-8")
            os.utime(path, (time, time))
    assert [r.status for r in records.read_cases(spark, str(tmp_path / "l"), lines=True).collect()] == ["FINALIZED"]
    assert [r.status for r in records.read_cases(spark, str(tmp_path / "w"), whole_files=True).collect()] == ["FINALIZED"]


def test_a_case_landed_very_often_sends_one_record_a_task(spark, tmp_path):
    for part in range(4):
        land(tmp_path, f"{part}.json", [case("1", unidade=str(i)) for i in range(500)] + [case(f"{part}-{i}") for i in range(20)], 1000 + part)
    rows = records.read_cases(spark, str(tmp_path))
    assert rows.count() == 81
    # The first stage of the aggregation runs before the exchange.
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("partial_max_by") >= 1


def test_no_landing(spark, tmp_path):
    (tmp_path / "empty.json").write_text("", encoding="utf-8")
    assert records.read_cases(spark, str(tmp_path)).collect() == []
