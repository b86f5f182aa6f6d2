"""Form fields and record columns that nobody declared."""

import json

import pytest

from workpulse import labels as L
from workpulse import schemas
from workpulse.sources import records

from test_landings import case, land


def item(name, value):
    return {"field": name, "value": value}


FORMS = {
    "1": [item("novo", "a"), item("unidade", "U"), item("novo", None), item("x.y `z`", "1")],
    "2": [item("novo", None), item("novo", "b"), item(None, "lost"), item("", "blank name")],
    "3": [],
    "4": None,
    "5": [item("novo", 12.5), item("unidade", None), {"field": "novo2"}, {"value": "no name"}],
}


@pytest.fixture
def rows(spark, tmp_path):
    cases = [case(number) | {"formFields": form} for number, form in FORMS.items()]
    land(tmp_path, "a.json", cases, 1000)
    return records.sound_records(records.read_records(spark, str(tmp_path)), schemas.REQUEST)


def test_rest_holds_what_no_column_holds(rows):
    flat = {r.processInstanceId: r for r in records.flatten(rows, schemas.CASE_FIELDS, rest=True).collect()}
    assert {number: row.otherFields for number, row in flat.items()} == {
        "1": {"novo": None, "x.y `z`": "1"}, "2": {"novo": "b", "": "blank name"}, "3": {}, "4": {}, "5": {"novo": "12.5", "novo2": None},
    }
    assert flat["1"].unidade == "U"
    plain = records.flatten(rows, schemas.CASE_FIELDS)
    assert records.REST not in plain.columns


def test_census(rows):
    got = {r.field: (r.declared, r.records, r.valued, r.repeated) for r in records.field_census(rows, schemas.CASE_FIELDS).collect()}
    assert got == {
        "novo": (False, 3, 2, 2), "unidade": (True, 2, 1, 0), "x.y `z`": (False, 1, 1, 0), None: (False, 2, 2, 0), "": (False, 1, 1, 0), "novo2": (False, 1, 0, 0),
    }
    assert sorted(str(r.field) for r in records.undeclared_fields(rows, schemas.CASE_FIELDS).collect()) == sorted(["novo", "x.y `z`", "None", "", "novo2"])
    plan = records.field_census(rows, schemas.CASE_FIELDS)._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan


def test_widened_columns_leave_the_map(rows):
    wide = records.widened(records.flatten(rows, schemas.CASE_FIELDS, rest=True), ["novo", "absent"])
    got = {r.processInstanceId: (r.novo, r.absent, r.otherFields) for r in wide.collect()}
    assert got["1"] == (None, None, {"x.y `z`": "1"}) and got["2"] == ("b", None, {"": "blank name"}) and got["4"] == (None, None, {})
    again = records.widened(wide, ["x.y `z`"])
    assert {r.processInstanceId: r["x.y `z`"] for r in again.collect()}["1"] == "1"
    untouched = records.widened(wide, [])
    assert untouched.columns == [*[c for c in wide.columns if c != records.REST], records.REST]


def test_a_form_field_wins_over_a_column_of_its_name(rows):
    flat = records.flatten(rows, schemas.CASE_FIELDS, rest=True).selectExpr("*", "'record' AS novo")
    got = {r.processInstanceId: r.novo for r in records.widened(flat, ["novo"]).collect()}
    assert got == {"1": None, "2": "b", "3": "record", "4": "record", "5": "12.5"}


def test_round_trip_through_the_form(rows):
    flat = records.flatten(rows, schemas.CASE_FIELDS, rest=True)
    form = records.form_of(flat, schemas.CASE_FIELDS)
    assert form.schema["formFields"].dataType == schemas.REQUEST["formFields"].dataType or form.schema["formFields"].dataType.simpleString() == schemas.REQUEST["formFields"].dataType.simpleString()
    again = records.flatten(form.select("processInstanceId", "formFields"), schemas.CASE_FIELDS, rest=True)
    names = ["processInstanceId", *schemas.CASE_FIELDS]

    def shown(frame):
        return sorted((tuple(str(r[n]) for n in names), sorted((k, str(v)) for k, v in r.otherFields.items())) for r in frame.collect())

    assert shown(again) == shown(flat)


def test_other_columns_of_a_record(spark, tmp_path):
    own = case("1") | {"prioridade": "alta", "dono": {"nome": "x", "n": [1, 2]}, "unidade": "record"}
    land(tmp_path, "a.json", [own, case("2"), case("3") | {"prioridade": None}, 17], 1000)
    texts = records.read_records(spark, str(tmp_path))
    rows = {r.processInstanceId: r for r in records.sound_records(texts, schemas.REQUEST, rest=True).collect()}
    assert rows["1"].otherColumns["prioridade"] == "alta" and json.loads(rows["1"].otherColumns["dono"]) == {"nome": "x", "n": [1, 2]}
    assert rows["2"].otherColumns == {} and rows["3"].otherColumns == {"prioridade": None}
    assert {r.field: r.records for r in records.undeclared_columns(texts, schemas.REQUEST).collect()} == {"prioridade": 2, "dono": 1}
    assert L.CASE_PROCESS == rows["1"].processId


def test_no_records(spark, tmp_path):
    land(tmp_path, "a.json", [], 1000)
    texts = records.read_records(spark, str(tmp_path))
    rows = records.sound_records(texts, schemas.REQUEST, rest=True)
    assert records.field_census(rows, schemas.CASE_FIELDS).collect() == []
    assert records.undeclared_columns(texts, schemas.REQUEST).collect() == []
