"""Landed JSON of the process service: pages of records, their form fields and nested state."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructField, StructType

from workpulse import labels as L
from workpulse import schemas
from workpulse.functions.dates import wall_time
from workpulse.operators.columns import computed_once

_BROKEN = "_broken"

# What becomes of a landed page or element. Only sound records are read; strays are skipped, as they are no records at all;
# the others would be records lost, so reading them raises an error unless the caller says that they may be skipped.
SOUND, STRAY = "sound", "stray element"
BROKEN_PAGE, NO_LIST, NO_PROCESS, NO_STATUS = "broken page", "no list", "no process id", "no status"
SUPERSEDED = "superseded"  # sound, but the same case was landed again later

# Where a record was landed: when, in which file, and a mark of its text for records that tie in both.
LANDED_AT, LANDED_FILE, LANDED_MARK = "landedAt", "landedFile", "landedMark"
PLACE = (LANDED_AT, LANDED_FILE, LANDED_MARK)
# What makes two landed records the same case, and two landed activities the same activity.
CASE_KEYS = ("processId", "processInstanceId")
ACTIVITY_KEYS = (*CASE_KEYS, "state", "startDate")


def read_pages(spark: SparkSession, path, whole_files=False, placed=False) -> DataFrame:
    """One row per landed page in ``page``: a line that is not blank, or with ``whole_files`` a whole file.

    A page of many lines that is read by lines is not lost: each of its lines is a broken page. With ``placed`` a page tells when
    it was landed, which is its file's time, and its file.
    """
    pages = spark.read.text(path, wholetext=whole_files).withColumnRenamed("value", "page")
    if placed:
        named = {LANDED_AT: "_metadata.file_modification_time", LANDED_FILE: "_metadata.file_path"}
        pages = pages.select("page", *[F.col(source).alias(name) for name, source in named.items()])
    return pages.where(F.trim("page") != "")


def read_records(spark: SparkSession, path, list_name="requests", lines=False, whole_files=False, placed=False) -> DataFrame:
    """Record texts of all pages below ``path``; with ``lines`` each line is a record by itself."""
    pages = read_pages(spark, path, whole_files, placed)
    if lines:
        records = pages.withColumnRenamed("page", "record").withColumn("page_fault", F.lit(None).cast("string"))
        return records.select("record", "page_fault", *_placed(pages))
    return unwrap(pages, list_name)


def _placed(frame: DataFrame) -> list[str]:
    """The columns of ``frame`` that say where a record was landed."""
    return [name for name in PLACE if name in frame.columns]


def unwrap(pages: DataFrame, list_name="requests") -> DataFrame:
    """Elements of the list under ``list_name``, else under ``items``, else of the page itself.

    Elements stay JSON text, so one that is not a record cannot spoil the others of its page. A page that does not parse or
    that holds no list gives one row: its own text, with what is wrong in ``page_fault``, which is null otherwise. Where the pages
    tell when and in which file they were landed, so do their records.
    """
    placed = _placed(pages)
    names = list(dict.fromkeys((list_name, "items")))
    envelope = StructType([StructField(name, ArrayType(StringType())) for name in names] + [StructField(_BROKEN, StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BROKEN}
    listed = F.ltrim("page").startswith("[")
    opened = pages.select(
        "page",
        *placed,
        listed.alias("listed"),
        F.when(listed, F.from_json("page", ArrayType(StringType()))).alias("bare"),
        F.when(~listed, F.from_json("page", envelope, options)).alias("envelope"),
    )
    # A page whose lists have another type counts as not parsed by the schema; whether it is JSON is asked of such pages only.
    doubtful = F.when(F.col("listed"), F.col("bare").isNull()).otherwise(F.col(f"envelope.{_BROKEN}").isNotNull())
    broken = F.when(doubtful, F.try_parse_json("page").isNull()).otherwise(F.lit(False))
    found = F.coalesce(*[F.col(f"envelope.{name}") for name in names], F.col("bare"))
    judged = opened.select(
        "page", *placed, found.alias("found"), F.when(broken, BROKEN_PAGE).when(found.isNull(), NO_LIST).alias("page_fault")
    )
    texts = F.when(F.col("page_fault").isNull(), F.col("found")).otherwise(F.array("page"))
    return judged.select(F.explode(texts).alias("record"), "page_fault", *placed)


def parse(records: DataFrame, schema: StructType) -> DataFrame:
    """Columns of each ``record`` text, with its ``outcome``.

    The parse is a generator's output, so filters on its columns do not parse the text again.
    """
    return _parsed(records, schema).withColumn("outcome", _outcome(schema)).drop("page_fault", "element")


def _parsed(records: DataFrame, schema: StructType) -> DataFrame:
    """Columns of each text, with ``element`` telling whether it is a record at all."""
    with_broken = StructType(schema.fields + [StructField(_BROKEN, StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BROKEN}
    parsed = records.select("record", "page_fault", *_placed(records), F.inline(F.array(F.from_json("record", with_broken, options))))
    element = F.coalesce(F.ltrim("record").startswith("{") & F.col(_BROKEN).isNull(), F.lit(False))
    return parsed.withColumn("element", element).drop(_BROKEN)


def _required(schema: StructType):
    return [(name, missing) for name, missing in (("processId", NO_PROCESS), ("status", NO_STATUS)) if name in schema.names]


def _ends(schema: StructType) -> list[str]:
    """Outcomes that a page or element can come to."""
    return [SOUND, STRAY, BROKEN_PAGE, NO_LIST, *[missing for _, missing in _required(schema)]]


def _outcome(schema: StructType) -> Column:
    outcome = F.when(F.col("page_fault").isNotNull(), F.col("page_fault")).when(~F.col("element"), STRAY)
    for name, missing in _required(schema):
        outcome = outcome.when(F.col(name).isNull(), missing)
    return outcome.otherwise(SOUND)


COLUMNS_REST = "otherColumns"


def outcomes_of(spark: SparkSession, observed) -> DataFrame:
    """What an ``Observation`` of ``sound_records`` has seen, in the form of ``outcomes``. Waits for the first action on the observed frame."""
    seen = [(name, total) for name, total in observed.get.items() if total]
    return spark.createDataFrame(seen, "outcome string, total bigint")


def sound_records(records: DataFrame, schema: StructType, on_lost="raise", rest=False, observed=None) -> DataFrame:
    """Columns of the sound records. Pages and records that would be lost raise an error, or are left out with ``on_lost="skip"``.

    Records that tell when and in which file they were landed keep that, and a mark of their text for those that tie in both. With ``rest``
    the record's own columns that ``schema`` lacks are kept in the map ``otherColumns``, nested ones as JSON text.

    ``observed`` is an ``Observation`` that the first action on the frame fills with the number of pages and elements that came to each
    outcome, told in the pass that reads them; see ``outcomes_of``. A task that fails and runs again counts once.
    A stage that is worked out again, since a lost executor held its shuffle files, may count again: ``outcomes`` is exact then too.
    """
    if on_lost not in ("raise", "skip"):
        raise ValueError("on_lost is 'raise' or 'skip'")
    whole = F.col("page_fault").isNull()
    for name, _ in _required(schema):
        whole = whole & F.col(name).isNotNull()
    kept = F.col("element") & whole
    if on_lost == "raise":
        told = F.raise_error(F.concat(F.lit("landed data would be lost: "), _outcome(schema))).cast("boolean")
        kept = F.when(kept, True).when(F.col("page_fault").isNull() & ~F.col("element"), False).otherwise(told)
        # Later filters must not come first and take the lost rows away: none is moved over a test of what is not deterministic.
        kept = kept & (F.monotonically_increasing_id() >= 0)
    told = _parsed(records, schema)
    if observed is not None:
        outcome = _outcome(schema)
        told = told.observe(observed, *[F.count_if(outcome == name).alias(name) for name in _ends(schema)])
    sound = told.where(kept)
    placed = _placed(records)
    mark = [F.md5(F.col("record").cast("binary")).alias(LANDED_MARK)] if placed and LANDED_MARK not in placed else []
    given = F.from_json("record", MapType(StringType(), StringType()))
    others = [F.map_filter(given, lambda name, _: ~name.isin(schema.names)).alias(COLUMNS_REST)] if rest else []
    return sound.select(*schema.names, *others, *placed, *mark)


def undeclared_columns(records: DataFrame, schema: StructType) -> DataFrame:
    """Names of the records' own columns that ``schema`` lacks, with how many records hold each."""
    names = F.array_distinct(F.json_object_keys("record"))
    whole = records.where("page_fault is null").select(F.explode(names).alias("field"))
    return whole.where(~F.col("field").isin(schema.names)).groupBy("field").agg(F.count(F.lit(1)).alias("records"))


def last_landings(rows: DataFrame, keys=CASE_KEYS, end="endDate") -> DataFrame:
    """Of each case the record that was landed last, as the service gives each case once whenever it is asked.

    Of records landed at the same time that of the greatest file name counts; within a file an ended one before an open one, then the
    greatest end and mark. A record without an instance id cannot be told from others and stays. Each task sends one record
    a case to the shuffle, so a case that is landed very often is no hot key.
    """
    order = F.struct(LANDED_AT, LANDED_FILE, end, LANDED_MARK)
    apart = F.when(F.col("processInstanceId").isNull(), F.monotonically_increasing_id())
    keyed = rows.withColumns({f"_key_{i}": F.col(name) for i, name in enumerate(keys)} | {"_apart": apart})
    last = keyed.groupBy(*[f"_key_{i}" for i in range(len(keys))], "_apart").agg(F.max_by(F.struct(*rows.columns), order).alias("last"))
    return last.select("last.*")


def skipped_records(records: DataFrame, schema: StructType) -> DataFrame:
    """Texts of all pages and elements that are not read, with the reason of each."""
    return parse(records, schema).where(F.col("outcome") != SOUND).select("record", "outcome")


def broken_pages(pages: DataFrame, list_name="requests") -> DataFrame:
    """Pages that give no record, with the reason of each."""
    return unwrap(pages, list_name).where("page_fault is not null").select(F.col("record").alias("page"), "page_fault")


def outcomes(records: DataFrame, schema: StructType, keys=()) -> DataFrame:
    """How many pages and elements came to each end; together they are all that was landed.

    With ``keys`` a sound record counts as such once for each case, and as superseded whenever the case was landed again.
    """
    told = parse(records, schema)
    if not keys:
        return told.groupBy("outcome").agg(F.count(F.lit(1)).alias("total"))
    known = (F.col("outcome") == SOUND) & F.col("processInstanceId").isNotNull()
    marked = told.select("outcome", known.alias("known"), *[F.when(known, F.col(name)).alias(f"key_{i}") for i, name in enumerate(keys)])
    cases = marked.groupBy(*marked.columns).agg(F.count(F.lit(1)).alias("n"))
    ends = F.array(
        F.struct(F.col("outcome"), F.when(F.col("known"), F.lit(1)).otherwise(F.col("n")).alias("total")),
        F.struct(F.lit(SUPERSEDED).alias("outcome"), F.when(F.col("known"), F.col("n") - 1).otherwise(F.lit(0)).alias("total")),
    )
    return cases.select(F.inline(ends)).where("total > 0").groupBy("outcome").agg(F.sum("total").alias("total"))


def asked(rows: DataFrame, process=None, statuses=None) -> DataFrame:
    """Rows of one process and of the given states, as the service is asked for them."""
    if process is not None:
        rows = rows.where(F.col("processId") == process)
    if statuses is not None:
        rows = rows.where(F.upper("status").isin(list(statuses)))
    return rows


REST = "otherFields"


def flatten(rows: DataFrame, fields, null_is_blank=schemas.NULL_IS_BLANK, rest=False) -> DataFrame:
    """Form fields as columns. The last value of a repeated field wins, and a form field wins over a
    record column of the same name even when its value is null.

    Names and values are turned round once, so the first position found is the last in the form; position
    and element access compile into the stage, unlike a filter with a lambda. With ``rest`` the fields that are not among ``fields``
    are kept in the map ``otherFields``, by the same rule; a field without a name cannot be a key and is left to ``field_census``.
    """
    turned = rows.withColumns(
        {"_names": F.reverse("formFields.field"), "_values": F.reverse("formFields.value")}
    ).withColumns({f"_at_{i}": _position(name) for i, name in enumerate(fields)})
    kept = [name for name in rows.columns if name not in fields and name != "formFields"]
    others = [_rest(fields).alias(REST)] if rest else []
    columns = [
        _form_value(F.col(f"_at_{i}"), name, name in rows.columns, name in null_is_blank).alias(name)
        for i, name in enumerate(fields)
    ]
    return turned.select(*kept, *columns, *others)


def _rest(fields) -> Column:
    """Undeclared names, each with the first value in the turned form; an empty map where there is none."""
    names = F.array_except(F.array_compact(F.coalesce("_names", F.array().cast("array<string>"))), F.array(*[F.lit(name) for name in fields]))
    values = F.transform(names, lambda name: F.get("_values", F.array_position("_names", name).cast("int") - 1))
    return F.map_from_arrays(names, values)


def field_census(rows: DataFrame, fields) -> DataFrame:
    """Every name that a form field of ``rows`` has: in how many records it is given, repeated, and has a value in the end, and whether it is declared.

    A record counts once for each of its names. Names are few and records many, so tasks count before anything is shuffled.
    """
    turned = rows.select(F.reverse("formFields.field").alias("names"), F.reverse("formFields.value").alias("values"))
    # A null name is looked for under a text that holds a control sign, so it has a place of its own.
    none = F.lit("\x00")
    named = turned.select(F.transform("names", lambda name: F.coalesce(name, none)).alias("names"), "values")
    each = named.select("names", "values", F.explode(F.array_distinct("names")).alias("name"))
    counted = each.select(
        F.nullif(F.col("name"), none).alias("field"),
        F.get("values", F.array_position("names", F.col("name")).cast("int") - 1).isNotNull().alias("valued"),
        (F.size(F.filter("names", lambda name: name == F.col("name"))) > 1).alias("repeated"),
    )
    declared = F.coalesce(F.col("field").isin(list(fields)), F.lit(False)).alias("declared")
    return counted.groupBy("field").agg(
        F.count(F.lit(1)).alias("records"), F.count_if("valued").alias("valued"), F.count_if("repeated").alias("repeated")
    ).select("field", declared, "records", "valued", "repeated")


def undeclared_fields(rows: DataFrame, fields) -> DataFrame:
    """Fields that ``flatten`` gives no column, with how many records would miss them."""
    return field_census(rows, fields).where(~F.col("declared")).drop("declared")


def widened(flat: DataFrame, names) -> DataFrame:
    """Undeclared fields of the map ``otherFields`` as columns; what is left stays in the map.

    As with declared fields, a form field wins over a record column of its name even when its value is null.
    """
    rest, names = F.col(REST), list(names)
    columns = {}
    for name in names:
        value = F.try_element_at(rest, F.lit(name))
        columns[name] = F.when(F.map_contains_key(rest, name), value).otherwise(F.col(f"`{name}`")) if name in flat.columns else value
    left = F.map_from_arrays(*[_left(rest, names, part) for part in (F.map_keys, F.map_values)])
    kept = [F.col(f"`{name}`") for name in flat.columns if name not in columns and name != REST]
    return flat.select(*kept, *[column.alias(name) for name, column in columns.items()], left.alias(REST))


def _left(rest, names, part) -> Column:
    """Keys or values of the entries of ``rest`` whose names are not among ``names``."""
    return part(F.map_filter(rest, lambda name, _: ~name.isin(names))) if names else part(rest)


def form_of(flat: DataFrame, fields) -> DataFrame:
    """The form again as the list ``formFields``: declared fields that have a value, then the others by name.

    A declared field that was given as null cannot be told from one not given, and one that a record column holds becomes a form field.
    """
    declared = F.filter(
        F.array(*[F.struct(F.lit(name).alias("field"), F.col(f"`{name}`").cast("string").alias("value")) for name in fields]), lambda item: item["value"].isNotNull()
    )
    entries = F.transform(F.array_sort(F.map_keys(REST)), lambda name: F.struct(name.alias("field"), F.try_element_at(F.col(REST), name).alias("value")))
    kept = [F.col(f"`{name}`") for name in flat.columns if name not in fields and name != REST]
    return flat.select(*kept, F.concat(declared, entries).alias("formFields"))


def _position(name) -> Column:
    """Place of the field in the turned form, 0 when it is not given."""
    return F.coalesce(F.array_position("_names", F.lit(name)), F.lit(0)).cast("int")


def _form_value(position, name, in_record, null_is_blank) -> Column:
    value = F.get("_values", position - 1)
    given = position > 0
    if null_is_blank:
        value = F.when(given, F.coalesce(value, F.lit("")))
    return F.when(given, value).otherwise(F.col(name)) if in_record else value


def with_times(rows: DataFrame) -> DataFrame:
    """Start and end as wall times, where they still are text."""
    texts = {field.name for field in rows.schema.fields if isinstance(field.dataType, StringType)}
    times = {name: wall_time(F.col(name)) for name in ("startDate", "endDate") if name in texts}
    return computed_once(rows, times) if times else rows


def _asked_records(spark, path, list_name, schema, keys, process, statuses, on_lost, landings, observed, layout) -> DataFrame:
    """Sound records as asked for. Whether a state is asked for is told of the last landing: a case that ended otherwise is gone."""
    if landings not in ("last", "all"):
        raise ValueError("landings is 'last' or 'all'")
    last = landings == "last"
    rows = asked(sound_records(read_records(spark, path, list_name, placed=last, **layout), schema, on_lost, observed=observed), process)
    return asked(last_landings(rows, keys).drop(*PLACE) if last else rows, statuses=statuses)


def read_cases(spark, path, process=L.CASE_PROCESS, statuses=L.REQUESTED_STATUS, on_lost="raise", landings="last", observed=None, **layout) -> DataFrame:
    """Flat cases of every landed page; see ``sound_records`` for ``on_lost`` and ``observed``.

    A case that was landed again counts once, as it was landed last; ``landings="all"`` gives every record.
    """
    rows = _asked_records(spark, path, "requests", schemas.REQUEST, CASE_KEYS, process, statuses, on_lost, landings, observed, layout)
    return with_times(flatten(rows, schemas.CASE_FIELDS))


def read_payments(spark, path, process=L.PAYMENT_PROCESS, statuses=L.REQUESTED_STATUS, on_lost="raise", landings="last", observed=None, **layout) -> DataFrame:
    """Flat payment requests of every landed page, each as it was landed last; see ``sound_records`` for ``on_lost``."""
    rows = _asked_records(spark, path, "requests", schemas.PAYMENT, CASE_KEYS, process, statuses, on_lost, landings, observed, layout)
    return with_times(flatten(rows, schemas.PAYMENT_FIELDS))


def read_activities(spark, path, process=L.CASE_PROCESS, on_lost="raise", landings="last", observed=None, **layout) -> DataFrame:
    """Activities of every landed page, their state still nested, each as it was landed last; see ``sound_records`` for ``on_lost``.

    An activity is told by its case, state and start.
    """
    return with_times(_asked_records(spark, path, "activities", schemas.ACTIVITY, ACTIVITY_KEYS, process, None, on_lost, landings, observed, layout))
