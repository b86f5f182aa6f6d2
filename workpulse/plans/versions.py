"""Comparison of two versions of the value chain."""

from pyspark.sql import DataFrame, functions as F

from workpulse import labels as L
from workpulse.operators.grouping import keyed


def in_order(chosen):
    """The two chosen versions, the earlier first whatever the order of choice."""
    if len(set(chosen)) != 2 or len(chosen) != 2:
        raise ValueError("choose exactly two versions")
    unknown = set(chosen) - set(L.VERSIONS)
    if unknown:
        raise ValueError(f"no such version: {sorted(unknown)}")
    return tuple(sorted(chosen, key=L.VERSIONS.index))


def rows_of(stacked: DataFrame, chosen) -> DataFrame:
    """Rows of the two versions that have process, procedure and activity."""
    ours = stacked.where(F.col("Versao").isin(list(in_order(chosen))))
    return keyed(ours, L.REQUIRED_COMPONENTS)


def metrics(rows: DataFrame) -> DataFrame:
    """Distinct components per version."""
    return rows.groupBy("Versao").agg(
        *[F.count_distinct(F.col(column)).alias(name) for column, name in zip(L.COMPONENTS, L.COMPONENT_COUNTS)]
    )


def hierarchy(rows: DataFrame) -> DataFrame:
    """Activities per procedure, process and whole of each version, in one shuffle."""
    process, procedure = F.col("Processo"), F.col("Procedimento")
    version = F.col("Versao")
    sets = [[version, process, procedure], [version, process], [version]]
    nodes = rows.groupingSets(sets, version, process, procedure).agg(
        F.count("Atividade").alias("Qtd_Atividade"),
        (F.lit(2) - F.bit_count(F.grouping_id())).cast("int").alias("level"),
    )
    return nodes.select("Versao", "level", "Processo", "Procedimento", "Qtd_Atividade")


def membership(rows: DataFrame, chosen) -> DataFrame:
    """Each value of each component with the versions it occurs in: one pass, one shuffle.

    Null values stay as a row of their own, so a component without values is still counted, as zero.
    """
    earlier, later = in_order(chosen)
    pairs = F.array(
        *[F.struct(F.lit(name).alias("Componente"), F.col(name).cast("string").alias("Valor")) for name in L.COMPONENTS]
    )
    return (
        rows.select("Versao", F.inline(pairs))
        .groupBy("Componente", "Valor")
        .agg(
            F.bool_or(F.col("Versao") == earlier).alias("in_earlier"),
            F.bool_or(F.col("Versao") == later).alias("in_later"),
        )
    )


def _both_present(rows: DataFrame, chosen):
    """Whether each of the two versions has a row left, as subqueries that stop at the first one."""
    earlier, later = in_order(chosen)
    versions = rows.select("Versao")
    return versions.where(F.col("Versao") == earlier).exists() & versions.where(F.col("Versao") == later).exists()


def gap(rows: DataFrame, chosen) -> DataFrame:
    """Each component value with what became of it; empty unless both versions have rows."""
    became = (
        F.when(F.col("in_earlier") & F.col("in_later"), L.KEPT).when(F.col("in_earlier"), L.REMOVED).otherwise(L.NEW)
    )
    values = membership(rows, chosen).where(F.col("Valor").isNotNull())
    return values.where(_both_present(rows, chosen)).select("Componente", "Valor", became.alias("Status"))


def diff(rows: DataFrame, chosen) -> DataFrame:
    """Kept, removed and new values of each component; empty unless both versions have rows."""
    given = F.col("Valor").isNotNull()
    counts = (
        membership(rows, chosen)
        .groupBy("Componente")
        .agg(
            F.count_if(given & F.col("in_earlier") & F.col("in_later")).alias("Mantidos"),
            F.count_if(given & F.col("in_earlier") & ~F.col("in_later")).alias("Removidos"),
            F.count_if(given & ~F.col("in_earlier") & F.col("in_later")).alias("Novos"),
        )
    )
    return counts.where(_both_present(rows, chosen))


def diff_long(rows: DataFrame, chosen, component=None) -> DataFrame:
    """The comparison as (component, status, quantity), of one component or of all."""
    table = diff(rows, chosen)
    if component is not None:
        table = table.where(F.col("Componente") == component)
    return table.unpivot("Componente", ["Mantidos", "Removidos", "Novos"], "Status", "Quantidade")


def version_of(rows: DataFrame, version) -> DataFrame:
    return rows.where(F.col("Versao") == version)
