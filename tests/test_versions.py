"""Version comparison on hand-written sheets, and its invariants."""

import pytest

from workpulse import labels as L
from workpulse.checks import fixtures as X
from workpulse.plans import versions as V

COLUMNS = [*L.COMPONENTS, "Versao"]


@pytest.fixture(scope="module")
def stacked(spark):
    rows = [
        ("P", "Q", "R", "t1", "Nova"),
        ("P", "Q2", "R", "t3", "Nova"),
        ("P", "Q", "R", "t1", "Anterior"),
        ("P", "Q", "R ", None, "Anterior"),
        ("p", "Q", "R", "t2", "Anterior"),
        ("X", None, "R", "lost", "Anterior"),
        ("P", "Q", "R", "t1", "Arquitetura"),
    ]
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in COLUMNS))


def test_exactly_two_versions(stacked):
    for chosen in ([], ["Nova"], ["Nova", "Nova"], list(L.VERSIONS), ["Nova", "Outra"]):
        with pytest.raises(ValueError):
            V.rows_of(stacked, chosen)


@pytest.mark.parametrize("chosen", [("Anterior", "Nova"), ("Nova", "Anterior")])
def test_order_of_choice_does_not_matter(stacked, chosen):
    rows = V.rows_of(stacked, chosen)
    assert rows.count() == 5
    assert {tuple(r) for r in V.diff(rows, chosen).collect()} == {
        ("Processo", 1, 1, 0), ("Procedimento", 1, 0, 1), ("Atividade", 1, 1, 0), ("Tarefa", 1, 1, 1),
    }
    gap = {(r.Componente, r.Valor): r.Status for r in V.gap(rows, chosen).collect()}
    assert gap == {
        ("Processo", "P"): "Mantido", ("Processo", "p"): "Removido", ("Procedimento", "Q"): "Mantido",
        ("Procedimento", "Q2"): "Novo", ("Atividade", "R"): "Mantido", ("Atividade", "R "): "Removido",
        ("Tarefa", "t1"): "Mantido", ("Tarefa", "t2"): "Removido", ("Tarefa", "t3"): "Novo",
    }
    assert {(r.Status, r.Quantidade) for r in V.diff_long(rows, chosen, "Tarefa").collect()} == {
        ("Mantidos", 1), ("Removidos", 1), ("Novos", 1),
    }


def test_one_version_left_gives_nothing(stacked):
    chosen = ("Anterior", "Nova")
    rows = V.rows_of(stacked.where("Versao <> 'Nova' OR Processo IS NULL"), chosen)
    assert rows.count() == 3
    assert V.diff(rows, chosen).collect() == [] and V.gap(rows, chosen).collect() == []
    assert V.diff(rows, chosen).columns == ["Componente", "Mantidos", "Removidos", "Novos"]
    assert V.gap(rows, chosen).columns == ["Componente", "Valor", "Status"]


def test_component_without_values_counts_zero(spark):
    rows = spark.createDataFrame(
        [("P", "Q", "R", None, "Anterior"), ("P", "Q", "R", None, "Nova")], ", ".join(f"{c} string" for c in COLUMNS)
    )
    counts = {r.Componente: tuple(r)[1:] for r in V.diff(rows, ("Anterior", "Nova")).collect()}
    assert counts["Tarefa"] == (0, 0, 0)


def test_hierarchy(stacked):
    rows = V.rows_of(stacked, ("Anterior", "Nova"))
    got = {(r.Versao, r.level, r.Processo, r.Procedimento): r.Qtd_Atividade for r in V.hierarchy(rows).collect()}
    assert got["Anterior", 0, None, None] == 3 and got["Anterior", 1, "P", None] == 2 and got["Nova", 2, "P", "Q2"] == 1


def test_invariants_on_the_tables(spark, sf_dir):
    rows = X.chosen_versions(spark, sf_dir)
    metrics = {r.Versao: r for r in V.metrics(rows).collect()}
    names = dict(zip(L.COMPONENTS, ("Qtd_Processos", "Qtd_Procedimentos", "Qtd_Atividades", "Qtd_Tarefas")))
    for r in V.diff(rows, X.CHOSEN_VERSIONS).collect():
        assert r.Mantidos + r.Removidos == metrics["Anterior"][names[r.Componente]]
        assert r.Mantidos + r.Novos == metrics["Nova"][names[r.Componente]]
    assert V.version_of(rows, "Nova").count() + V.version_of(rows, "Anterior").count() == rows.count()
