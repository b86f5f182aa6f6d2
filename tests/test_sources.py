"""Landed files in, files out."""

import csv
import glob
import json

import pytest

from workpulse import labels as L
from workpulse import schemas, sinks
from workpulse.sources import records, sheets


def _write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def _case(number, form, **record):
    base = {"processInstanceId": str(number), "processId": L.CASE_PROCESS, "status": "OPEN",
            "startDate": "2024-03-01T10:00:00-0300", "endDate": None}
    return base | record | {"formFields": form}


def _field(name, value):
    return {"field": name, "value": value}


def test_pages_of_cases(spark, tmp_path):
    first = [
        _case(1, [_field("unidade", "old"), _field("unidade", "new"), _field("tbIrregularidade___1", None)]),
        17, None, "loose", [1, 2],
        _case(2, [_field("prejFinanc", 12.5)], unidade="record", status="finalized", endDate="bad"),
    ]
    second = [_case(3, [], unidade="record"), _case(4, [_field("unidade", None)], unidade="record"),
              _case(5, [], status="CANCELLED"), _case(6, [], processId="other")]
    _write(tmp_path / "a.json", json.dumps({"requests": first}) + "\n" + json.dumps({"items": second}) + "\n")
    _write(tmp_path / "b.json", json.dumps([_case(7, None)]) + "\n" + '{"requests": [{"broken": \n')
    rows = {r.processInstanceId: r for r in records.read_cases(spark, str(tmp_path), on_lost="skip").collect()}
    assert sorted(rows) == ["1", "2", "3", "4", "7"]
    assert rows["1"].unidade == "new"
    assert rows["1"].tbIrregularidade___1 == "" and rows["2"].tbIrregularidade___1 is None
    assert rows["2"].prejFinanc == "12.5" and rows["2"].unidade == "record"
    assert rows["4"].unidade is None
    assert rows["1"].startDate.hour == 10 and rows["2"].endDate is None

    texts = records.read_records(spark, str(tmp_path))
    assert sorted((str(r.record), r.outcome) for r in records.skipped_records(texts, schemas.REQUEST).collect()) == [
        ("17", "stray element"), ("None", "stray element"), ("[1,2]", "stray element"), ("loose", "stray element"),
        ('{"requests": [{"broken": ', "broken page"),
    ]


FAULTY = {
    "broken page": json.dumps({"requests": [{"processInstanceId": "1"}]})[:-9],
    "no list": json.dumps({"error": "denied"}),
    "no process id": json.dumps({"requests": [{"processInstanceId": "3", "status": "OPEN"}]}),
    "no status": json.dumps({"requests": [{"processInstanceId": "4", "processId": "p"}]}),
}


@pytest.mark.parametrize("fault", sorted(FAULTY))
def test_nothing_landed_is_lost_without_a_word(spark, tmp_path, fault):
    _write(tmp_path / "a.json", json.dumps({"requests": [_case(1, []), 17]}) + "\n\n" + FAULTY[fault] + "\n")
    with pytest.raises(Exception, match=fault):
        records.read_cases(spark, str(tmp_path)).collect()
    assert records.read_cases(spark, str(tmp_path), on_lost="skip").count() == 1
    texts = records.read_records(spark, str(tmp_path))
    counted = {r.outcome: r.total for r in records.outcomes(texts, schemas.REQUEST).collect()}
    assert counted == {"sound": 1, "stray element": 1, fault: 1}
    pages = [r.page_fault for r in records.broken_pages(records.read_pages(spark, str(tmp_path))).collect()]
    assert pages == [fault] if fault in (records.BROKEN_PAGE, records.NO_LIST) else pages == []


def test_page_faults(spark):
    kinds = {
        '{"requests": 5}': "no list", '{"requests": {"a": 1}}': "no list", "17": "no list", '"text"': "no list", "{}": "no list",
        '[{"a": 1}': "broken page", "oops": "broken page", '{"requests": [1, ': "broken page",
        '{"requests": [], "items": 5}': None, "[]": None, '{"requests": null, "items": [{}]}': None,
    }
    pages = spark.createDataFrame([(text,) for text in kinds], "page string")
    found = {r.page: r.page_fault for r in records.broken_pages(pages).collect()}
    assert found == {text: fault for text, fault in kinds.items() if fault}
    assert records.unwrap(pages).where("page_fault is null").count() == 1


def test_pretty_page_read_by_lines_raises(spark, tmp_path):
    _write(tmp_path / "p.json", json.dumps({"requests": [_case(1, []), _case(2, [])]}, indent=2))
    with pytest.raises(Exception, match="broken page|no list"):
        records.read_cases(spark, str(tmp_path)).count()


def test_one_page_per_file_and_one_record_per_line(spark, tmp_path):
    pages = tmp_path / "pages"
    lines = tmp_path / "lines"
    pages.mkdir(), lines.mkdir()
    _write(pages / "p.json", json.dumps({"requests": [_case(1, []), _case(2, [])]}, indent=2))
    _write(lines / "l.json", "\n".join(json.dumps(_case(n, [])) for n in (3, 4)))
    assert records.read_cases(spark, str(pages), whole_files=True).count() == 2
    assert records.read_cases(spark, str(lines), lines=True).count() == 2


def test_payments(spark, tmp_path):
    row = _case(1, [_field("tpPagamento", "x")], processId=L.PAYMENT_PROCESS, slaStatus="on_time")
    _write(tmp_path / "a.json", json.dumps({"requests": [row, _case(2, [])]}))
    got = records.read_payments(spark, str(tmp_path)).collect()
    assert [(r.processInstanceId, r.slaStatus, r.tpPagamento) for r in got] == [("1", "on_time", "x")]


def test_activities(spark, tmp_path):
    rows = [{"processInstanceId": "1", "processId": L.CASE_PROCESS, "state": {"stateName": "Fim"}, "startDate": "2024-01-01"},
            {"processInstanceId": "2", "processId": L.CASE_PROCESS}]
    _write(tmp_path / "a.json", json.dumps({"activities": rows}))
    got = records.read_activities(spark, str(tmp_path)).orderBy("processInstanceId").collect()
    assert got[0].state.stateName == "Fim" and got[1].state is None


def test_sheet_is_all_text_with_trimmed_headers(spark, tmp_path):
    path = _write(tmp_path / "s.csv", ' Processo , AT_FREQUÊNCIA X\n1,\n"a\nb", x \n')
    sheet = sheets.read_sheet(spark, path, line_breaks=True)
    assert sheet.columns == ["Processo", "AT_FREQUÊNCIA X"]
    assert [tuple(r) for r in sheet.collect()] == [("1", ""), ("a\nb", " x ")]


def test_sheets_split_and_agree_in_every_form(spark, tmp_path):
    cells = spark.range(200_000).selectExpr("cast(id as string) as Processo", "concat('a,\"b ', id) as ` AT_VOLUME X `")
    cells.coalesce(1).write.parquet(str(tmp_path / "parquet"))
    cells.coalesce(1).write.json(str(tmp_path / "json"))
    cells.coalesce(1).write.csv(str(tmp_path / "csv"), header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512k")
    try:
        read = {form: sheets.read_sheet(spark, str(tmp_path / form), form) for form in sheets.FORMS}
        assert read["csv"].rdd.getNumPartitions() > 1 and read["json"].rdd.getNumPartitions() > 1
        assert read["parquet"].rdd.getNumPartitions() > 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    sums = {form: rows.selectExpr("count(*)", "sum(xxhash64(Processo, `AT_VOLUME X`) % 1000003)").first() for form, rows in read.items()}
    assert len(set(sums.values())) == 1 and sums["csv"][0] == 200_000


def test_line_break_in_a_plain_csv_raises(spark, tmp_path):
    path = _write(tmp_path / "s.csv", 'Processo,Nota\n"a\nb",x\n')
    with pytest.raises(Exception):
        sheets.read_sheet(spark, path).collect()
    with pytest.raises(ValueError):
        sheets.read_sheet(spark, path, "xlsx")


def test_versions_from_sheets(spark, tmp_path):
    one = _write(tmp_path / "1.csv", "Processo,Nota\nP,n\nN/A,\n")
    two = _write(tmp_path / "2.csv", "Processo,Extra\nP,e\n")
    rows = sheets.read_versions(spark, {"Nova": two, "Anterior": one})
    assert rows.columns == ["Processo", "Nota", "Versao", "Extra"]
    assert {tuple(r) for r in rows.collect()} == {
        ("P", "n", "Anterior", None), (None, None, "Anterior", None), ("P", None, "Nova", "e"),
    }


def test_csv_sink(spark, tmp_path):
    rows = spark.sql("SELECT 'á,b' AS t, TIMESTAMP_NTZ'2024-01-01 10:00:00' AS d, CAST(NULL AS STRING) AS n, 1.5D AS x")
    sinks.write_csv(rows, str(tmp_path / "out"))
    (part,) = glob.glob(str(tmp_path / "out" / "*.csv"))
    with open(part, encoding="utf-8", newline="") as handle:
        header, row = csv.reader(handle)
    assert header == ["t", "d", "n", "x"] and row[0] == "á,b" and row[1].startswith("2024-01-01 10:00:00") and row[2] == ""


def test_parquet_sink_prunes_and_pushes(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, v int, w string")
    sinks.write_parquet(rows, str(tmp_path / "p"))
    kept = spark.read.parquet(str(tmp_path / "p")).where("k = 'a'").select("v")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(k,a)" in plan and "w:string" not in plan
    assert kept.collect()[0].v == 1


def test_held_frame_is_released(spark):
    rows = spark.range(10)
    with sinks.held(rows) as kept:
        assert kept.count() == 10 and kept.storageLevel.useMemory
    assert not rows.storageLevel.useMemory


def test_an_explicit_null_in_the_form_wins_over_the_record(spark):
    fields = "processInstanceId string, unidade string, tbIrregularidade___1 string, formFields array<struct<field:string,value:string>>"
    form = [[("unidade", None)], [], [("unidade", "form"), ("tbIrregularidade___1", None)]]
    rows = spark.createDataFrame([(str(i), "record", "code", f) for i, f in enumerate(form)], fields)
    flat = records.flatten(rows, ["unidade", "tbIrregularidade___1"]).orderBy("processInstanceId").collect()
    assert [(r.unidade, r.tbIrregularidade___1) for r in flat] == [(None, "code"), ("record", "code"), ("form", "")]


def test_flatten_without_form(spark):
    rows = spark.createDataFrame([("1", None)], "processInstanceId string, formFields array<struct<field:string,value:string>>")
    assert records.flatten(rows, ["unidade"]).first().unidade is None
    with pytest.raises(Exception):
        records.flatten(rows.drop("formFields"), ["unidade"]).collect()
