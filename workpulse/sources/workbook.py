"""Sheets of .xlsx workbooks as a Spark data source: one task for each sheet of each workbook.

``spark.read.format("workbook").option("sheet", name).load(path)`` after ``register(spark)``; ``path`` is a workbook or a folder of them. A workbook is a
zip of XML parts, so a sheet cannot be split; the format holds it to 1,048,576 rows. A task streams the rows out of the zip and
holds a batch of them and the workbook's shared strings. All cells are text:

- blank cells, errors and texts without a character are null; true and false are ``True`` and ``False``;
- whole numbers have no point, others the shortest digits that give the same double;
- dates are ``yyyy-MM-dd``, with ``HH:mm:ss`` and up to six places behind if they have a time of day; a time alone is ``HH:mm:ss``;
- formulas give their stored result.

The first row that holds a cell names the columns: one without a name is ``Unnamed: 3`` by its place from 0, a repeated name gets ``.1``, ``.2``. Rows in the
middle without a cell are rows of nulls, those at the end are none. The columns are those of the first workbook by name; another that lacks one has nulls there,
one with further columns raises an error.
"""

from __future__ import annotations

import datetime as dt
import posixpath
import re
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

from workpulse.files import file_system

NAME = "workbook"
BATCH = 4096
# Built-in number formats that show a date or a time of day.
DATE_FORMATS = {*range(14, 23), *range(27, 37), 45, 47, *range(50, 59)}
_NOT_CODE = re.compile(r'"[^"]*"|\\.|_.|\*.|\[[^\]]*\]')  # texts, escapes, paddings, colours and conditions of a number format
_ELAPSED = re.compile(r"\[(h+|m+|s+)\]", re.IGNORECASE)
_ESCAPED = re.compile(r"_x([0-9A-Fa-f]{4})_")
_LETTERS = re.compile(r"[A-Z]+")


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _text(element) -> str:
    """Text of all runs, without those that spell out how it is read aloud."""
    if _local(element.tag) == "t":
        return _ESCAPED.sub(lambda m: chr(int(m[1], 16)), element.text or "")
    return "".join(_text(child) for child in element if _local(child.tag) != "rPh")


def _column(reference: str) -> int:
    """0-based column of a cell's reference such as ``AB12``."""
    at = 0
    for letter in _LETTERS.match(reference)[0]:
        at = at * 26 + ord(letter) - 64
    return at - 1


def shows_date(code: str) -> bool:
    """Whether a number format shows a date or a time of day, and not the time that has passed."""
    return not _ELAPSED.search(code) and bool(re.search("[dmyhs]", _NOT_CODE.sub("", code).lower().replace("general", "")))


def number_text(value: str) -> str:
    number = float(value)
    return str(int(number)) if number.is_integer() and abs(number) < 1e15 else repr(number)


def date_text(value: str, from_1904: bool) -> str:
    """A date's text by its serial number. Serial 60 is a day that never was; as in other readers the days before it are moved by one."""
    serial = float(value)
    if 0 <= serial < 1 and not from_1904:
        moment = dt.datetime(1900, 1, 1) + dt.timedelta(microseconds=round(serial * 86_400_000) * 1000)
        return moment.strftime("%H:%M:%S") + (f".{moment.microsecond:06d}" if moment.microsecond else "")
    begin = dt.datetime(1904, 1, 1) if from_1904 else dt.datetime(1899, 12, 31 if serial < 60 else 30)
    try:
        moment = begin + dt.timedelta(milliseconds=round(serial * 86_400_000))
    except OverflowError:
        return number_text(value)
    if moment.time() == dt.time():
        return f"{moment:%Y-%m-%d}"
    return f"{moment:%Y-%m-%d %H:%M:%S}" + (f".{moment.microsecond:06d}" if moment.microsecond else "")


class Workbook:
    """An open workbook. ``file`` is a path in a store that pyarrow knows."""

    def __init__(self, path: str):
        system, place = file_system(path)
        self._file = system.open_input_file(place)
        self._zip = zipfile.ZipFile(self._file)
        main = self._target("", "officeDocument")
        self._folder = posixpath.dirname(main)
        self._main = main
        book = self._parsed(main)
        ids = self._relations(main)
        self.from_1904 = any(_local(e.tag) == "workbookPr" and e.get("date1904") in ("1", "true") for e in book)
        sheets = next(e for e in book if _local(e.tag) == "sheets")
        self.sheets = {e.get("name"): ids[next(v for k, v in e.items() if _local(k) == "id")][1] for e in sheets}
        self._strings: pa.Array | None = None
        self._dates: list[bool] | None = None

    def close(self) -> None:
        self._zip.close()
        self._file.close()

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()

    def _parsed(self, part: str):
        with self._zip.open(part) as stream:
            return ElementTree.parse(stream).getroot()

    def _relations(self, part: str) -> dict[str, tuple[str, str]]:
        """Kind and part that each relation of a part leads to."""
        folder, name = posixpath.split(part)
        found = {}
        place = posixpath.join(folder, "_rels", f"{name}.rels")
        if place in self._zip.namelist():
            for e in self._parsed(place):
                target = e.get("Target")
                found[e.get("Id")] = (e.get("Type").rpartition("/")[2], target[1:] if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target)))
        return found

    def _target(self, part: str, kind: str) -> str | None:
        return next((target for own, target in self._relations(part).values() if own == kind), None)

    def _elements(self, part: str, name: str):
        """Elements of that name below the part's root or its children, each freed after use."""
        with self._zip.open(part) as stream:
            above = []
            for event, element in ElementTree.iterparse(stream, ("start", "end")):
                if event == "start":
                    above.append(element)
                    continue
                above.pop()
                if _local(element.tag) == name and len(above) <= 2:
                    yield element
                    above[-1].remove(element)

    def strings(self) -> pa.Array:
        if self._strings is None:
            part = self._target(self._main, "sharedStrings")
            chunks, texts = [], []
            for element in self._elements(part, "si") if part else ():
                texts.append(_text(element))
                if len(texts) == 1 << 16:
                    chunks.append(pa.array(texts, pa.large_string()))
                    texts = []
            self._strings = pa.concat_arrays([*chunks, pa.array(texts, pa.large_string())])
        return self._strings

    def dates(self) -> list[bool]:
        """By cell style: whether numbers of that style are dates."""
        if self._dates is None:
            part, self._dates = self._target(self._main, "styles"), []
            root = self._parsed(part) if part else ()
            codes = {int(e.get("numFmtId")): e.get("formatCode") for group in root if _local(group.tag) == "numFmts" for e in group}
            for group in root:
                if _local(group.tag) == "cellXfs":
                    kinds = [int(e.get("numFmtId", 0)) for e in group]
                    self._dates = [shows_date(codes[k]) if k in codes else k in DATE_FORMATS for k in kinds]
        return self._dates

    def _value(self, cell) -> str | None:
        kind, style = cell.get("t", "n"), int(cell.get("s", 0))
        value = next((e for e in cell if _local(e.tag) in ("v", "is")), None)
        if value is None or kind == "e":
            return None
        if kind == "inlineStr":
            return _text(value) or None
        raw = value.text or ""
        if not raw:
            return None
        if kind == "s":
            return self.strings()[int(raw)].as_py() or None
        if kind == "str":
            return _ESCAPED.sub(lambda m: chr(int(m[1], 16)), raw)
        if kind == "b":
            return "True" if raw in ("1", "true") else "False"
        if kind == "d":
            return raw.replace("T", " ").removesuffix(" 00:00:00")
        return date_text(raw, self.from_1904) if style < len(self.dates()) and self.dates()[style] else number_text(raw)

    def cells(self, sheet: str):
        """Row number from 1 and the row's texts by column, for each row of the sheet that holds one."""
        if sheet not in self.sheets:
            raise ValueError(f"no sheet {sheet!r}; there are {list(self.sheets)}")
        row = 0
        for element in self._elements(self.sheets[sheet], "row"):
            row = int(element.get("r", row + 1))
            found, at = {}, -1
            for cell in element:
                if _local(cell.tag) == "c":
                    reference = cell.get("r")
                    at = _column(reference) if reference else at + 1
                    if (value := self._value(cell)) is not None:
                        found[at] = value
            if found:
                yield row, found

    def header(self, sheet: str) -> list[str]:
        return named_columns(next(self.cells(sheet), (0, {}))[1])

    def rows(self, sheet: str):
        """The texts of each row below the header, by column; rows between without a cell are empty."""
        before = None
        for row, found in self.cells(sheet):
            if before is not None:
                for _ in range(row - before - 1):
                    yield {}
                yield found
            before = row


def named_columns(first: dict[int, str]) -> list[str]:
    """Names of the columns up to the last that the first row names."""
    names, seen = [], set()
    for at in range(max(first, default=-1) + 1):
        name = wanted = first.get(at) or f"Unnamed: {at}"
        again = 0
        while name in seen:
            again += 1
            name = f"{wanted}.{again}"
        seen.add(name)
        names.append(name)
    return names


# ---- The data source -------------------------------------------------------------------------------------------------


def workbooks(path: str) -> list[str]:
    """The workbook of that path, or all of that folder by name. Lock files and hidden ones are left out."""
    system, place = file_system(path)
    if system.get_file_info(place).type != pafs.FileType.Directory:
        return [path]
    names = sorted(info.base_name for info in system.get_file_info(pafs.FileSelector(place)) if info.is_file)
    return [f"{path.rstrip('/')}/{name}" for name in names if name.lower().endswith((".xlsx", ".xlsm")) and not name.startswith(("~", ".", "_"))]


class _Sheet(InputPartition):
    def __init__(self, path: str, sheet: str):
        self.path, self.sheet = path, sheet


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, paths: list[str], sheet: str):
        self.names, self.paths, self.sheet = schema.names, paths, sheet

    def partitions(self):
        return [_Sheet(path, self.sheet) for path in self.paths]

    def read(self, partition: _Sheet):
        with Workbook(partition.path) as book:
            own = book.header(partition.sheet)
            if further := [name for name in own if name not in self.names]:
                raise ValueError(f"{partition.path}: columns {further} are not in the first workbook")
            rows, kinds = [], pa.schema([(name, pa.string()) for name in self.names])
            places = [own.index(name) if name in own else -1 for name in self.names]
            for row in book.rows(partition.sheet):
                rows.append(row)
                if len(rows) == BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array([r.get(at) for r in rows], pa.string()) for at in places], schema=kinds)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r.get(at) for r in rows], pa.string()) for at in places], schema=kinds)


class WorkbookSource(DataSource):
    """Options: ``path``, a workbook or a folder of them, and ``sheet``, by default the first one of the first workbook."""

    @classmethod
    def name(cls):
        return NAME

    def _opened(self):
        paths = workbooks(self.options["path"])
        if not paths:
            raise ValueError(f"no workbook in {self.options['path']}")
        with Workbook(paths[0]) as book:
            sheet = self.options.get("sheet") or next(iter(book.sheets))
            return paths, sheet, book.header(sheet)

    def schema(self):
        return StructType([StructField(name, StringType()) for name in self._opened()[2]])

    def reader(self, schema: StructType):
        paths, sheet, _ = self._opened()
        return _Reader(schema, paths, sheet)


def register(spark) -> None:
    """Make the format known to the session."""
    spark.dataSource.register(WorkbookSource)
