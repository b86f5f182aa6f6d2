"""Sheets of workbooks against the same sheets in other forms."""

import csv
import resource

import pytest

from workpulse import labels as L
from workpulse.checks import workbooks
from workpulse.sources import sheets, workbook

DATE = '<c r="{r}" s="1"><v>%s</v></c>'
TIME = '<c r="{r}" s="2"><v>%s</v></c>'


def _read(spark, path, sheet=None):
    return [tuple(r) for r in sheets._read(spark, str(path), "workbook", False, sheet).collect()]


def test_cells_of_every_kind(spark, tmp_path):
    cells = {
        "12": 12, "12.5": 12.5, "0.1": 0.1, "-3": -3.0, "1e+20": 1e20, "text": "text", "even": "even", " padded ": " padded ", "ação & <b>": "ação & <b>",
        "True": True, "False": False, "2024-03-01": [DATE % 45352], "2024-03-01 12:30:00": [TIME % 45352.520833333336], "1900-02-28": [DATE % 59], "06:00:00": [TIME % 0.25],
        "1.5": ['<c r="{r}" s="3"><v>1.5</v></c>'], "stored": ['<c r="{r}" t="str"><f>A1&amp;"x"</f><v>stored</v></c>'], "7": ['<c r="{r}"><f>3+4</f><v>7</v></c>'],
        "rich text": ['<c r="{r}" t="inlineStr"><is><r><t>rich </t></r><rPh sb="0" eb="1"><t>ri</t></rPh><r><t>text</t></r></is></c>'],
        "a\rb": ['<c r="{r}" t="inlineStr"><is><t>a_x000D_b</t></is></c>'], "2024-03-02": ['<c r="{r}" t="d"><v>2024-03-02T00:00:00</v></c>'],
    }
    none = [None, ['<c r="{r}" t="e"><v>#DIV/0!</v></c>'], ['<c r="{r}" s="1"/>'], ['<c r="{r}" t="str"><v></v></c>'], ['<c r="{r}" t="inlineStr"><is><t></t></is></c>']]
    rows = [["n", "cell"], *[[i, value] for i, value in enumerate([*cells.values(), *none])]]
    workbooks.write(str(tmp_path / "w.xlsx"), {"S": rows})
    got = _read(spark, tmp_path / "w.xlsx")
    assert [value for _, value in got] == [*cells, *[None] * len(none)] and [n for n, _ in got] == [str(i) for i in range(len(got))]


def test_dates_from_1904(spark, tmp_path):
    workbooks.write(str(tmp_path / "w.xlsx"), {"S": [["d"], [[DATE % 0]], [[TIME % 1.5]]]}, from_1904=True)
    assert _read(spark, tmp_path / "w.xlsx") == [("1904-01-01",), ("1904-01-02 12:00:00",)]


def test_number_formats():
    assert [workbook.shows_date(code) for code in ("dd/mm/yyyy", "h:mm", '[$-416]d "de" mmm;@', "mm:ss.0")] == [True] * 4
    assert [workbook.shows_date(code) for code in ("General", "0.00", '"day" 0', "[Red]0", "[h]:mm", "#,##0\\d", "@", "0.00E+00")] == [False] * 8


def test_rows_and_columns_that_are_left_out(spark, tmp_path):
    rows = [[], [], ["a", None, "a", "b"], ["1", "x"], [], [], [None, None, None, "2", "beyond"], [], []]
    workbooks.write(str(tmp_path / "w.xlsx"), {"other": [["z"]], "S": rows})
    frame = sheets._read(spark, str(tmp_path / "w.xlsx"), "workbook", False, "S")
    assert frame.columns == ["a", "Unnamed: 1", "a.1", "b"]
    assert [tuple(r) for r in frame.collect()] == [("1", "x", None, None), (None,) * 4, (None,) * 4, (None, None, None, "2")]
    assert sheets._read(spark, str(tmp_path / "w.xlsx"), "workbook", False).columns == ["z"]
    with pytest.raises(Exception, match="no sheet"):
        sheets._read(spark, str(tmp_path / "w.xlsx"), "workbook", False, "T").collect()


def test_cells_without_references(spark, tmp_path):
    workbooks.write(str(tmp_path / "w.xlsx"), {"S": [["a", "b"], [['<c t="str"><v>x</v></c>'], ['<c><v>2</v></c>']]]})
    assert _read(spark, tmp_path / "w.xlsx") == [("x", "2")]


HEAD = ["Processo", "Procedimento", "Atividade", "Tarefa"]


def _versions():
    out = {}
    for k, version in enumerate(L.VERSIONS):
        head = HEAD + (["Nota"] if k == 0 else [])
        rows = [[f"P{i % 3}", f"Q{i % 7}", None if i % 11 == k else f"A {i}", str(i), *(["nota, com vírgula"] if k == 0 else [])] for i in range(50 * (k + 1))]
        rows[5][2] = "#N/A"
        out[version] = [head, *rows]
    return out


def test_versions_are_those_of_other_forms(spark, tmp_path):
    versions = _versions()
    workbooks.write(str(tmp_path / "v.xlsx"), {L.VERSION_SHEETS[v]: rows for v, rows in versions.items()})
    paths = {}
    for version, rows in versions.items():
        paths[version] = str(tmp_path / f"{version}.csv")
        with open(paths[version], "w", newline="", encoding="utf-8") as file:
            csv.writer(file).writerows([["" if x is None else x for x in row] for row in rows])
    stacked = sheets.read_workbook_versions(spark, str(tmp_path / "v.xlsx"))
    other = sheets.read_versions(spark, paths)
    assert sorted(stacked.columns) == sorted(other.columns)
    assert sorted(map(str, stacked.select(sorted(other.columns)).collect())) == sorted(map(str, other.select(sorted(other.columns)).collect()))
    assert stacked.rdd.getNumPartitions() == 3  # one task a sheet


def test_value_chain_sheet(spark, tmp_path):
    workbooks.write(str(tmp_path / "v.xlsx"), {"S": [[" Processo ", "AT_VOLUME X"], ["p", None], [None, 1.5]]})
    frame = sheets.read_sheet(spark, str(tmp_path / "v.xlsx"), "workbook", sheet="S")
    assert frame.columns == ["Processo", "AT_VOLUME X"] and [tuple(r) for r in frame.collect()] == [("p", ""), ("", "1.5")]
    with pytest.raises(ValueError):
        sheets.read_sheet(spark, "x.csv", sheet="S")


def test_a_folder_of_workbooks(spark, tmp_path):
    folder = tmp_path / "books"
    folder.mkdir()
    for k in range(4):
        head = ["a", "b"] if k != 2 else ["b"]
        workbooks.write(str(folder / f"{k}.xlsx"), {"S": [head, *[[f"{name}{k}" for name in head]] * 3]})
    (folder / "~$0.xlsx").write_text("lock")
    (folder / "notes.txt").write_text("other")
    frame = sheets._read(spark, f"file://{folder}", "workbook", False, "S")
    assert frame.rdd.getNumPartitions() == 4
    assert sorted(set(map(tuple, frame.collect())), key=str) == [("a0", "b0"), ("a1", "b1"), ("a3", "b3"), (None, "b2")]
    workbooks.write(str(folder / "9.xlsx"), {"S": [["a", "c"], ["1", "2"]]})
    with pytest.raises(Exception, match="not in the first workbook"):
        sheets._read(spark, str(folder), "workbook", False, "S").collect()
    (tmp_path / "none").mkdir()
    with pytest.raises(Exception, match="no workbook"):
        sheets._read(spark, str(tmp_path / "none"), "workbook", False).collect()


def test_a_long_sheet_is_read_by_batches(tmp_path):
    """Rows come one after the other: many more of them take no more memory."""
    path = str(tmp_path / "long.xlsx")
    workbooks.write(path, {"S": [["a", "b"], *[[f"row {i % 97}", str(i)] for i in range(120_000)]]})
    with workbook.Workbook(path) as book:
        rows = book.rows("S")
        for _ in range(20_000):
            next(rows)
        before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
        assert sum(1 for _ in rows) == 100_000
        assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 30_000


def test_an_empty_sheet(spark, tmp_path):
    workbooks.write(str(tmp_path / "w.xlsx"), {"S": [["a"]]})
    assert _read(spark, tmp_path / "w.xlsx") == []
