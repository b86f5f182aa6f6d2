"""One check per cleaning rule, with null, blank and odd text."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from workpulse.checks.fixtures import CODES
from workpulse.functions import categories as C, dates as D, numbers as N
from workpulse.functions.text import is_blank, strip
from workpulse.operators.ranking import with_position
from workpulse.operators.grouping import count_by

NBSP = " "


def test_severity(mapped):
    raw = ["Levemente", "MODERADO", "Média", "moderada", "muito GRAVE", " ", "", "Outra", "A Definir", None]
    assert mapped(C.severity, raw) == [
        "Leve", "Moderada", "Moderada", "Moderada", "Grave", "Não informado", "Não informado", "Não informado",
        "a definir", None,
    ]
    assert mapped(C.severity, ["grave ou leve"]) == ["Leve"]


def test_measure(mapped):
    raw = ["Suspensão de 2 dias", "Advertência Escrita e Suspensão", "suspensão", " \t", None,
           "Desligamento (Justa Causa) - Desligamento (Justa Causa)", "Desligamento (Justa Causa)"]
    assert mapped(C.measure, raw) == [
        "Suspensão", "Suspensão", "suspensão", "Não informada", None, "Desligamento (Justa Causa)",
        "Desligamento (Justa Causa)",
    ]


def test_unit(mapped):
    raw = ["X CEEM Boa Vista - Manaus Y", NBSP, "Outra", None]
    assert mapped(C.unit, raw) == ["CEEM Boa Vista/Manaus", "Não informada", "Outra", None]


def test_irregularity_order_and_case(mapped):
    raw = ["x_infracaotransitosuspensaocnh_y", "infracaotransito", "InfracaoTransito", "", None, "outracoisa"]
    assert mapped(C.irregularity, raw) == [
        "Infração de Trânsito com Suspensão de CNH", "Infração de Trânsito", "InfracaoTransito", "Indefinido/Outra",
        None, "Indefinido/Outra",
    ]


def test_status_and_source_sla(mapped):
    assert mapped(C.status, ["OPEN", "finalized", "CANCELLED", None]) == ["Aberto", "Finalizado", None, None]
    assert mapped(C.source_sla, ["On_Time", "OVERDUE", "x", None]) == ["No Prazo", "Em Atraso", None, None]


def test_department(mapped):
    raw = ["X ADM - ESCRITORIO FILIAL", "CUIABA ACME - ADMINISTRATIVO - ESCR FILIAL", "qualquer", "", None]
    expected = ["Escritório Filial", "Escritório Filial", "não informado", "não informado", None]
    assert mapped(lambda t: C.department(t, "ACME"), raw) == expected
    assert mapped(C.department, raw) == expected
    assert mapped(lambda t: C.department(t, "OTHER"), raw)[1] == "não informado"


@pytest.mark.parametrize(
    "severity, code, days, expected",
    [
        ("Grave", "Desídia", 10.0, "No Prazo"),
        ("Grave", "Indefinido/Outra", 10.01, "Em Atraso"),
        ("Leve", "Indefinido/Outra", 3.0, "No Prazo"),
        ("Moderada", "Indefinido/Outra", 3.01, "Em Atraso"),
        ("Moderada", "Desídia", 1.0, "No Prazo"),
        ("Leve", "Desídia", 1.01, "Em Atraso"),
        ("Leve", None, 1.0, "No Prazo"),
        ("Leve", None, 2.0, "Em Atraso"),
        ("Não informado", "Desídia", 0.0, "Em Atraso"),
        (None, "Desídia", 0.0, "Em Atraso"),
        ("Grave", "Desídia", None, "Em Atraso"),
        ("Grave", "Desídia", -1.0, "No Prazo"),
    ],
)
def test_sla(spark, severity, code, days, expected):
    row = spark.createDataFrame([(severity, code, days)], "s string, c string, d double")
    assert row.select(C.sla_status(F.col("s"), F.col("c"), F.col("d"))).first()[0] == expected


def test_loss(mapped):
    raw = ["1,234.50", "1.234,50", "0", "0.0", "", " 7 ", "x", None, "1_000", "1d", "nan", "-5"]
    assert mapped(N.loss_amount, raw) == [1234.5, 1.2345, None, None, None, 7.0, None, None, None, None, None, -5.0]


def test_number_or_zero(mapped):
    raw = ["3", f"{NBSP}2.5\t", "1,5", "1_000", "0x10", "1d", "1.5f", "nan", "inf", "", None, "1e2", ".5", "5."]
    assert mapped(N.number_or_zero, raw) == [3.0, 2.5, 0, 0, 0, 0, 0, 0, 0, 0, 0, 100.0, 0.5, 5.0]


def test_frequency(mapped):
    raw = ["DIÁRIO", " semanal\t", "Mensal", f"{NBSP}Bimestral", "trimestral", "Semestral", "Anual", "Quinzenal", "", None]
    assert mapped(C.frequency_multiplier, raw) == [22.0, 4.0, 1.0, 0.5, 0.33, 0.167, 0.083, 1.0, 1.0, 1.0]


def test_spaces(mapped):
    odd = "\x1c 　\x85 a b \r\n"
    assert mapped(strip, [odd, "a", "", None]) == [odd.strip(), "a", "", None]
    assert mapped(is_blank, ["  \x1f", "", " a", None]) == [True, True, False, None]


def test_wall_time_keeps_the_clock(mapped):
    raw = ["2024-03-01T10:00:00-0300", "2024-03-01T10:00:00.250-03:00", "2024-03-01 10:00:00", "nonsense", "", None]
    ten = dt.datetime(2024, 3, 1, 10)
    assert mapped(D.wall_time, raw) == [ten, ten.replace(microsecond=250000), ten, None, None, None]


def test_lead_days_and_open_end(spark, as_of):
    rows = spark.sql(
        "SELECT TIMESTAMP_NTZ'2024-04-30 12:00:00' AS s, CAST(NULL AS TIMESTAMP_NTZ) AS e"
        " UNION ALL SELECT TIMESTAMP_NTZ'2024-04-30 12:00:00', TIMESTAMP_NTZ'2024-04-30 18:00:00.5'"
        " UNION ALL SELECT NULL, TIMESTAMP_NTZ'2024-04-30 18:00:00'"
    )
    days = [row[0] for row in rows.select(D.lead_days(F.col("s"), F.col("e"), as_of)).collect()]
    assert days[0] == 1.0
    assert days[1] == pytest.approx(0.25 + 0.5 / 86400)
    assert days[2] is None


def test_lead_days_do_not_depend_on_the_session_zone(spark, as_of):
    """The night the clocks change is as long as any other on naive times."""
    row = spark.sql("SELECT TIMESTAMP_NTZ'2021-03-13 12:00:00' AS s, TIMESTAMP_NTZ'2021-03-14 12:00:00' AS e")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert row.select(D.lead_days(F.col("s"), F.col("e"), as_of)).first()[0] == 1.0
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_task_days_round_half_to_even(spark):
    rows = spark.createDataFrame([(0.125,), (0.135,), (0.375,), (-0.125,), (None,)], "x double")
    got = [row[0] for row in rows.select(N.round_half_even(F.col("x"), 2)).collect()]
    assert got == [0.12, round(0.135 * 100) / 100, 0.38, -0.12, None]


def test_mean_days_is_exact_and_null_when_empty(spark):
    rows = spark.createDataFrame([(i / 24,) for i in range(1, 1001)] + [(None,)], "x double")
    assert rows.agg(D.mean_days(F.col("x"))).first()[0] == pytest.approx(sum(range(1, 1001)) / 1000 / 24, abs=1e-12)
    assert rows.where("x > 1e9").agg(D.mean_days(F.col("x"))).first()[0] is None


def test_shown_values(spark):
    row = spark.sql("SELECT TIMESTAMP_NTZ'2024-03-09 10:00:00' AS a, CAST(NULL AS TIMESTAMP_NTZ) AS b, 1234567.891D AS m")
    shown = row.select(
        D.shown_date(F.col("a")), D.shown_date(F.col("b")), D.shown_date(F.col("b"), "N/A"), N.money_text(F.col("m"))
    ).first()
    assert tuple(shown) == ("09/03/2024", "", "N/A", "R$1,234,567.89")


# How often each raw code occurs in a known sample of 91, and the labels they must give.
SAMPLE_CODES = {
    "indefinido_outra": 22, "": 4, "infracaotransitosuspensaocnh_grave": 8, "equivocosatividadesprocedimentos_leve": 8,
    "ausenciasnaojustificadas_moderado": 8, "violacaonormasprocedimentos_moderado": 6, "violacaopoliticasgrave_grave": 5,
    "recorrenciacondutasmoderadas_grave": 4, "recorrenciacondutasleves_moderado": 3, "apropriacaofurto_grave": 3,
    "usoimpropriorecursos_moderado": 2, "usoexcessivocelular_moderado": 2, "equivocosdocumentosregistros_leve": 2,
    "embriaguezdrogas_grave": 2, "desrespeitoseguranca_moderado": 2, "atrasosesporadicos_leve": 2,
    "assediomoralsexual_grave": 2, "infracaotransito_moderado": 1, "infracaotransito_leve": 1,
    "falsificacaodocumentos_grave": 1, "desidia_grave": 1, "atrasosfrequentesinjustificadosmoderado": 1,
    "abandonoemprego_grave": 1,
}
SAMPLE_LABELS = {
    "Indefinido/Outra": 26, "Ausências Não Justificadas": 8, "Equívocos em Atividades ou Procedimentos": 8,
    "Infração de Trânsito com Suspensão de CNH": 8, "Violação de Normas ou Procedimentos": 6,
    "Violação Grave de Políticas": 5, "Recorrência de Condutas Moderadas": 4, "Recorrência de Condutas Leves": 3,
    "apropriacaofurto_grave": 3, "Uso Impróprio de Recursos": 2, "Uso Excessivo de Celular": 2,
    "Equívocos em Documentos ou Registros": 2, "Embriaguez ou Drogas": 2, "Desrespeito às Regras de Segurança": 2,
    "Atrasos Esporádicos": 2, "Assédio Moral ou Sexual": 2, "Infração de Trânsito": 2, "Falsificação de Documentos": 1,
    "Desídia": 1, "Atrasos Frequentes e Injustificados": 1, "Abandono de Emprego": 1,
}


def test_known_sample_of_codes(texts):
    codes = [code for code, times in SAMPLE_CODES.items() for _ in range(times)]
    assert len(codes) == 91
    labelled = texts(codes).select(C.irregularity(F.col("t")).alias("label"))
    ranked = with_position(count_by(labelled, "label"), "total", "label").collect()
    assert {row.label: row.total for row in ranked} == SAMPLE_LABELS
    expected = sorted(SAMPLE_LABELS.items(), key=lambda item: (-item[1], item[0].encode()))
    assert [row.label for row in sorted(ranked, key=lambda row: row.ranking)] == [label for label, _ in expected]


def test_fixture_codes_reach_every_rule(mapped):
    labels = set(mapped(C.irregularity, [code for code in CODES if code]))
    assert len(labels) == 20 + 2  # every rule, the omitted marker and the code without a rule


@pytest.mark.parametrize(
    "value, places",
    [(0.25, 1), (1.25, 1), (0.0625, 3), (2.675, 2), (0.125, 2), (-0.125, 2), (-1.005, 2), (12345.5, 0), (1234567.891, 2), (0.0005, 3), (0.05, 1), (0.005, 2), (-0.0005, 3), (0.5, 0), (0.0004, 3), (-0.0004, 3), (0.0007, 3), (0.9996, 3), (0.00149, 3)],
)
def test_shown_numbers_round_the_exact_value_ties_to_even(spark, value, places):
    shown = spark.range(1).select(N.fixed_text(F.lit(value), places).alias("t")).first().t
    assert shown == f"{value:.{places}f}"


def test_shown_null(spark):
    assert spark.range(1).select(N.fixed_text(F.lit(None).cast("double"), 2).alias("t")).first().t == "nan"
