import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# Names that the operators use themselves.
CLASHING = ("size", "target", "taken", "rank", "bin", "row", "id", "mark", "rep", "component", "score", "stats", "held_out", "_kept",
            "part", "_place", "place", "set_low", "_set_low", "_set_high", "_id", "_low", "blocks", "pair", "chunk")


@pytest.fixture
def docs(spark):
    """A function that gives documents from (id, text) pairs or full rows, with further columns whose names clash."""

    def build(rows, clash=False):
        full = [(*row, "en", "s")[:4] + (len(row[1] or ""),) for row in rows]
        frame = spark.createDataFrame(full, DOCS).repartition(3)
        return frame.selectExpr("*", *[f"cast(1 as int) as {name}" for name in CLASHING]) if clash else frame

    return build
