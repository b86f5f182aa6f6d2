"""Value-chain report: hours of demand by unit and season."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from workpulse import labels as L
from workpulse.functions import categories, numbers
from workpulse.operators.filters import Choice, Offer, all_members
from workpulse.operators.grouping import count_by, keyed, sum_by, sum_or_zero, with_share

CHOICES = (
    Choice("Unidade", Offer.KEEP_NULL),
    Choice("Processo", Offer.NOT_NULL),
    Choice("Temporada", Offer.FIXED, L.SEASONS),
    Choice("Tipo de Procedimento", Offer.NOT_NULL),
    Choice(L.AUTOMATION, Offer.NOT_NULL),
)
HIERARCHY = L.COMPONENTS


def find_units(columns):
    """Units named by the sheet's columns, sorted."""
    return sorted({name[len(L.UNIT_MARK) :] for name in columns if name.startswith(L.UNIT_MARK)})


def long(wide: DataFrame, carry=None) -> DataFrame:
    """One row per sheet row, unit and season, with volume, hours each and monthly demand.

    Raw cells are unfolded before they are read: the plan holds one parsing expression however many
    units the sheet has, and a unit's hours are read once for both seasons. ``carry`` are the sheet
    columns to keep, all by default; Spark prunes those that a report does not use.
    """
    units = find_units(wide.columns)
    if not units:
        raise ValueError(f"no column starts with {L.UNIT_MARK!r}")
    derived = ("Unidade", "Temporada", L.AUTOMATION, "Frequência", "Volume", L.HOURS_EACH, L.DEMAND)
    kept = [_quoted(name) for name in (wide.columns if carry is None else carry) if name not in derived]

    per_unit = F.array(*[_raw_cells(unit, wide.columns) for unit in units])
    cells = wide.select(*kept, F.inline(per_unit))
    read = cells.select(
        *kept,
        F.col("_unit").alias("Unidade"),
        F.col("_automation").alias(L.AUTOMATION),
        numbers.number_or_zero(F.col("_hours")).alias(L.HOURS_EACH),
        F.inline(F.array(*[_season_cells(season) for season in L.SEASONS])),
    )
    numbered = read.withColumn("Volume", numbers.number_or_zero(F.col("Volume")))
    demand = categories.frequency_multiplier(F.col("Frequência")) * F.col("Volume") * F.col(f"`{L.HOURS_EACH}`")
    return numbered.withColumn(L.DEMAND, demand).select(*kept, *[f"`{name}`" for name in derived])


def _quoted(name):
    return "`" + name.replace("`", "``") + "`"


def _raw_cells(unit, columns) -> Column:
    """Texts of one unit; a column the sheet lacks has its default."""

    def cell(name, default):
        return F.col(_quoted(name)) if name in columns else F.lit(default)

    return F.struct(
        F.lit(unit).alias("_unit"),
        cell(f"{L.AUTOMATION} {unit}", L.NO_AUTOMATION).alias("_automation"),
        cell(f"TEMPO (h) {unit}", "0").alias("_hours"),
        *[
            cell(f"{L.SEASON_PREFIX[season]}_{kind} {unit}", default).alias(f"_{season}_{kind}")
            for season in L.SEASONS
            for kind, default in (("FREQUÊNCIA", ""), ("VOLUME", "0"))
        ],
    )


def _season_cells(season) -> Column:
    return F.struct(
        F.lit(season).alias("Temporada"),
        F.col(f"_{season}_FREQUÊNCIA").alias("Frequência"),
        F.col(f"_{season}_VOLUME").alias("Volume"),
    )


def filtered(rows: DataFrame, chosen=None) -> DataFrame:
    """Long rows that pass every multi-select."""
    return rows.where(all_members(CHOICES, chosen))  # the columns tested are read, not worked out


def kpis(rows: DataFrame) -> DataFrame:
    """Total hours and five distinct counts in one aggregation.

    Folding the seasons before the counts was measured and is not faster: it costs a shuffle of its own.
    """
    counted = (("units", "Unidade"), *zip(("processes", "procedures", "activities", "tasks"), L.COMPONENTS))
    return rows.agg(
        sum_or_zero(F.col(L.DEMAND)).alias("total_hours"),
        *[F.count_distinct(F.col(column)).alias(name) for name, column in counted],
    )


def _season_hours(season) -> Column:
    return F.when(F.col("Temporada") == season, F.col(L.DEMAND))


def season_ratio(rows: DataFrame) -> DataFrame:
    """Hours of each season and by how many percent the high one is above the low one."""
    hours = rows.agg(
        sum_or_zero(_season_hours(L.HIGH)).alias("high_hours"),
        sum_or_zero(_season_hours(L.LOW)).alias("low_hours"),
    )
    ratio = (F.col("high_hours") / F.nullif("low_hours", F.lit(0.0)) - 1) * 100
    return hours.withColumn("ratio_percent", ratio)


def hours_by_unit(rows: DataFrame) -> DataFrame:
    return sum_by(rows, L.DEMAND, "Unidade").orderBy(F.desc(L.DEMAND), "Unidade")


def hours_by_type(rows: DataFrame) -> DataFrame:
    return with_share(sum_by(rows, L.DEMAND, "Tipo de Procedimento"), L.DEMAND)


def hours_by_unit_type(rows: DataFrame) -> DataFrame:
    return sum_by(rows, L.DEMAND, "Unidade", "Tipo de Procedimento")


def automation_count(rows: DataFrame) -> DataFrame:
    """Rows per automation level, the word for none left out in any case."""
    known = rows.where(F.lower(f"`{L.AUTOMATION}`") != L.NO_AUTOMATION)
    return with_share(count_by(known, L.AUTOMATION), "total")


def automation_mean(rows: DataFrame) -> DataFrame:
    return keyed(rows, [L.AUTOMATION]).groupBy(L.AUTOMATION).agg(F.avg(L.DEMAND).alias("mean_hours"))


def top_in_high_season(rows: DataFrame, column, n) -> DataFrame:
    """Both seasons of the ``n`` values with most high-season hours, with their position.

    Both seasons are summed side by side, so the chosen rows already hold what is shown and nothing
    is joined back. Hours are compared to six places: the order of summing must not decide.
    """
    sums = (
        keyed(rows, [column])
        .groupBy(column)
        .agg(*[F.sum(_season_hours(season)).alias(season) for season in L.SEASONS])
    )
    first = sums.where(F.col(L.HIGH).isNotNull()).orderBy(F.desc(F.round(L.HIGH, 6)), column).limit(n)
    # The window below sees n rows, n being a literal.
    position = F.row_number().over(Window.orderBy(F.desc(F.round(L.HIGH, 6)), column))
    seasons = F.array(*[F.struct(F.lit(s).alias("Temporada"), F.col(s).alias(L.DEMAND)) for s in L.SEASONS])
    shown = first.withColumn("position", position).select(column, "position", F.inline(seasons))
    return shown.where(F.col(L.DEMAND).isNotNull())


def hierarchy(rows: DataFrame) -> DataFrame:
    """Hours of every node of process, procedure, activity and task, level 0 being the whole.

    Tasks are summed first, so the levels above expand tasks instead of long rows. ``color`` is the
    mean of the tasks' hours weighted by themselves.
    """
    leaves = sum_by(rows, L.DEMAND, *HIERARCHY)
    hours = F.col(L.DEMAND)
    nodes = leaves.rollup(*HIERARCHY).agg(
        F.sum(hours).alias("hours"),
        (F.sum(hours * hours) / F.nullif(F.sum(hours), F.lit(0.0))).alias("color"),
        F.grouping_id().alias("_folded"),
    )
    level = (F.lit(len(HIERARCHY)) - F.bit_count("_folded")).cast("int")
    return nodes.select(level.alias("level"), *HIERARCHY, "hours", "color")


def staffing(rows: DataFrame) -> DataFrame:
    """People needed per unit at a fixed number of hours each, half a micro-hour being noise."""
    hours = sum_by(rows, L.DEMAND, "Unidade")
    people = F.ceil(F.round(L.DEMAND, 6) / L.HOURS_PER_PERSON).cast("double")
    return hours.withColumn(L.STAFF, people)


def staffing_long(rows: DataFrame) -> DataFrame:
    return staffing(rows).unpivot("Unidade", [L.DEMAND, L.STAFF], *L.STAFF_LONG)


def offered(wide: DataFrame) -> DataFrame:
    """Values each multi-select shows, read from the sheet itself: unfolding it adds no value."""
    units = find_units(wide.columns)
    pairs = [("Processo", F.col("Processo")), ("Tipo de Procedimento", F.col("`Tipo de Procedimento`"))]
    for unit in units:
        name = f"{L.AUTOMATION} {unit}"
        pairs.append(("Unidade", F.lit(unit)))
        pairs.append((L.AUTOMATION, F.col(_quoted(name)) if name in wide.columns else F.lit(L.NO_AUTOMATION)))
    structs = [F.struct(F.lit(field).alias("field"), value.alias("value")) for field, value in pairs]
    seasons = [F.struct(F.lit("Temporada").alias("field"), F.lit(s).alias("value")) for s in L.SEASONS]
    seen = wide.select(F.inline(F.array(*structs))).where("value is not null").distinct()
    return seen.union(wide.sparkSession.range(1).select(F.inline(F.array(*seasons)))).orderBy("field", "value")
