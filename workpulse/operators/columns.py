"""Columns worked out once."""

from pyspark.sql import DataFrame, functions as F


def computed_once(frame: DataFrame, columns) -> DataFrame:
    """Add or replace columns so that later filters read their result.

    A filter on a projected column is pushed below the projection with a copy of the expression: a label
    would be worked out once in the filter and again for the result, and the stage's code can outgrow
    what the JVM compiles. The output of a generator is not copied, and filters on the columns that
    pass by it are still pushed to the scan.
    """
    kept = [f"`{name}`" for name in frame.columns if name not in columns]
    made = F.struct(*[column.alias(name) for name, column in columns.items()])
    return frame.select(*kept, F.inline(F.array(made)))
