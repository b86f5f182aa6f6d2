"""Wide to long, its reports, and their invariants."""

import pytest
from pyspark.sql import functions as F

from workpulse import labels as L
from workpulse.checks import fixtures as X
from workpulse.plans import value_chain as V

UNIT_B = "Filial B. (norte)"


@pytest.fixture(scope="module")
def sheet(spark):
    """Unit A is complete; unit B has neither automation nor high-season volume columns."""
    columns = ["Processo", "Procedimento", "Atividade", "Tarefa", "Tipo de Procedimento",
               "AT_FREQUÊNCIA A", "AT_VOLUME A", "BT_FREQUÊNCIA A", "BT_VOLUME A", "TEMPO (h) A", "NÍVEL DE AUTOMAÇÃO A",
               f"AT_FREQUÊNCIA {UNIT_B}", f"BT_FREQUÊNCIA {UNIT_B}", f"BT_VOLUME {UNIT_B}", f"TEMPO (h) {UNIT_B}"]
    rows = [
        ("P", "Q", "R", "t1", "x", "DIÁRIO", "2", "Anual", "1,5", "0.5", "Manual", "Mensal", "", "3", "2"),
        ("P", "Q", "R", "t2", "y", "", " 4 ", "Quinzenal", "1", "n/d", "", "Semanal", "semestral", "10", "1"),
    ]
    return spark.createDataFrame(rows, columns)


def test_units_come_from_headers(sheet):
    assert V.find_units(sheet.columns) == ["A", UNIT_B]
    with pytest.raises(ValueError):
        V.long(sheet.select("Processo"))


def test_long_rows(sheet):
    rows = V.long(sheet).collect()
    assert len(rows) == 2 * 2 * 2
    assert set(sheet.columns) <= set(rows[0].asDict())
    got = {(r.Tarefa, r.Unidade, r.Temporada): (r["Volume"], r[L.HOURS_EACH], r[L.DEMAND], r[L.AUTOMATION]) for r in rows}
    assert got["t1", "A", "Alta"] == (2.0, 0.5, 22.0, "Manual")
    assert got["t1", "A", "Baixa"] == (0.0, 0.5, 0.0, "Manual")
    assert got["t2", "A", "Alta"] == (4.0, 0.0, 0.0, "")
    assert got["t1", UNIT_B, "Alta"] == (0.0, 2.0, 0.0, "nan")
    assert got["t1", UNIT_B, "Baixa"] == (3.0, 2.0, 6.0, "nan")
    assert got["t2", UNIT_B, "Baixa"][2] == pytest.approx(1.67)


def test_carried_columns(sheet):
    narrow = V.long(sheet, carry=["Processo"])
    assert narrow.columns[0] == "Processo" and "Tarefa" not in narrow.columns


def test_filter_by_season_and_unit(sheet):
    rows = V.filtered(V.long(sheet), {"Temporada": ["Baixa"], "Unidade": [UNIT_B]})
    assert {(r.Unidade, r.Temporada) for r in rows.collect()} == {(UNIT_B, "Baixa")} and rows.count() == 2


def test_offered(sheet):
    got = {(r.field, r.value) for r in V.offered(sheet).collect()}
    assert got == {("Processo", "P"), ("Tipo de Procedimento", "x"), ("Tipo de Procedimento", "y"), ("Unidade", "A"),
                   ("Unidade", UNIT_B), (L.AUTOMATION, "Manual"), (L.AUTOMATION, ""), (L.AUTOMATION, "nan"),
                   ("Temporada", "Alta"), ("Temporada", "Baixa")}


def test_ratio_without_low_season(sheet):
    only_high = V.filtered(V.long(sheet), {"Temporada": ["Alta"]})
    assert V.season_ratio(only_high).first().ratio_percent is None


def test_automation_leaves_out_the_word_for_none(spark):
    rows = spark.createDataFrame([("nan", 1.0), ("NaN", 2.0), ("", 3.0), ("Manual", 4.0), (None, 5.0)], [L.AUTOMATION, L.DEMAND])
    counted = {r[L.AUTOMATION]: (r.total, r.share) for r in V.automation_count(rows).collect()}
    assert counted == {"": (1, 0.5), "Manual": (1, 0.5)}
    assert {r[L.AUTOMATION] for r in V.automation_mean(rows).collect()} == {"nan", "NaN", "", "Manual"}


def test_top_leaves_out_items_without_high_season(spark):
    data = [("a", "Alta", 5.0), ("a", "Baixa", 1.0), ("b", "Baixa", 99.0), ("c", "Alta", 7.0), ("d", "Alta", 5.0),
            (None, "Alta", 50.0)]
    rows = spark.createDataFrame(data, ["k", "Temporada", L.DEMAND])
    top = V.top_in_high_season(rows, "k", 2).collect()
    assert {(r.k, r.Temporada, r.position, r[L.DEMAND]) for r in top} == {
        ("c", "Alta", 1, 7.0), ("a", "Alta", 2, 5.0), ("a", "Baixa", 2, 1.0),
    }


def test_hierarchy_sums_and_colors(spark):
    data = [("p", "q", "r", "t", 1.0), ("p", "q", "r", "t", 2.0), ("p", "q", "r", "u", 1.0), ("p", None, "r", "t", 9.0)]
    rows = spark.createDataFrame(data, [*V.HIERARCHY, L.DEMAND])
    nodes = {(r.level, r.Tarefa): (r.hours, r.color) for r in V.hierarchy(rows).collect()}
    assert nodes[0, None] == nodes[1, None] == nodes[2, None] == nodes[3, None] == (4.0, 2.5)
    assert nodes[4, "t"] == (3.0, 3.0) and nodes[4, "u"] == (1.0, 1.0)


def test_invariants_on_the_tables(spark, sf_dir):
    wide, rows = X.chain_wide(spark, sf_dir), X.chain_filtered(spark, sf_dir)
    assert X.chain_long(spark, sf_dir).count() == wide.count() * len(X.CHAIN_UNITS) * 2
    nodes = V.hierarchy(rows).groupBy("level").agg(F.sum("hours").alias("h")).collect()
    totals = {r.level: r.h for r in nodes}
    assert all(total == pytest.approx(totals[0]) for total in totals.values())
    by_unit = sum(r[L.DEMAND] for r in V.hours_by_unit(rows).collect())
    assert by_unit == pytest.approx(V.kpis(rows).first().total_hours) == pytest.approx(totals[0])


def test_plan_does_not_grow_with_seasons_per_unit(spark):
    """Twenty times the units, one parsing expression."""

    def wide(units):
        cells = {f"{p}_{k} u{i}": "1" for i in range(units) for p in ("AT", "BT") for k in ("FREQUÊNCIA", "VOLUME")}
        cells |= {f"TEMPO (h) u{i}": "1" for i in range(units)}
        return spark.range(1).select(F.lit("P").alias("Processo"), *[F.lit(v).alias(c) for c, v in cells.items()])

    def parses(units):
        return V.long(wide(units), carry=[])._jdf.queryExecution().analyzed().toString().count("RLIKE")

    assert parses(1) == parses(20)
    assert V.long(wide(20), carry=[]).count() == 40
