"""Landed sheets: all cells text, headers trimmed."""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from workpulse import labels as L
from workpulse.sources import workbook

FORMS = ("parquet", "json", "csv")
WORKBOOK = "workbook"


def tidy_headers(sheet: DataFrame) -> DataFrame:
    return sheet.toDF(*[name.strip() for name in sheet.columns])


def _read(spark: SparkSession, path, form, line_breaks, sheet=None) -> DataFrame:
    """Cells as text. A ``sheet`` of a workbook is one task, see ``workbook``. Parquet, JSON lines and plain CSV are read in as many tasks as their size asks for.

    A CSV with line breaks within cells cannot be split: ``line_breaks`` makes each file one task. Without it, a line with too few or too
    many cells, as such a break leaves, raises an error.
    """
    if form not in (*FORMS, WORKBOOK):
        raise ValueError(f"form is one of {(*FORMS, WORKBOOK)}")
    if line_breaks and form != "csv":
        raise ValueError("line_breaks is for CSV")
    if sheet is not None and form != WORKBOOK:
        raise ValueError("sheet is for workbooks")
    if form == WORKBOOK:
        workbook.register(spark)
        reader = spark.read.format(workbook.NAME)
        return (reader.option("sheet", sheet) if sheet is not None else reader).load(path)
    if form == "parquet":
        sheet = spark.read.parquet(path)
    elif form == "json":
        sheet = spark.read.json(path, primitivesAsString=True)
    else:
        broken = {"multiLine": True} if line_breaks else {"mode": "FAILFAST"}
        sheet = spark.read.csv(path, header=True, inferSchema=False, escape='"', **broken)
    return sheet.select(*[F.col("`" + name.replace("`", "``") + "`").cast("string").alias(name) for name in sheet.columns])


def read_sheet(spark: SparkSession, path, form="csv", line_breaks=False, sheet=None) -> DataFrame:
    """A sheet of the value chain; an empty cell is blank text, not null."""
    return tidy_headers(_read(spark, path, form, line_breaks, sheet)).na.fill("")


def read_version(spark: SparkSession, path, form="csv", line_breaks=False, sheet=None) -> DataFrame:
    """A sheet of one version; a cell with one of the empty texts is null."""
    return empty_to_null(_read(spark, path, form, line_breaks, sheet))


def empty_to_null(sheet: DataFrame) -> DataFrame:
    cells = {name: F.col(f"`{name}`") for name in sheet.columns}
    return sheet.select(*[F.when(~cell.isin(list(L.EMPTY_CELLS)), cell).alias(name) for name, cell in cells.items()])


def stack_versions(sheets) -> DataFrame:
    """Sheets by version name put below each other; a column that one lacks is null there."""
    labelled = [sheets[version].withColumn("Versao", F.lit(version)) for version in L.VERSIONS if version in sheets]
    return reduce(lambda upper, lower: upper.unionByName(lower, allowMissingColumns=True), labelled)


def read_versions(spark: SparkSession, paths, form="csv", line_breaks=False) -> DataFrame:
    return stack_versions({version: read_version(spark, path, form, line_breaks) for version, path in paths.items()})


def read_workbook_versions(spark: SparkSession, path, sheets=None) -> DataFrame:
    """The versions that lie in the sheets of one workbook, or of each workbook of a folder; ``sheets`` maps a version to its sheet's name."""
    sheets = sheets or L.VERSION_SHEETS
    return stack_versions({version: read_version(spark, path, WORKBOOK, sheet=name) for version, name in sheets.items()})
