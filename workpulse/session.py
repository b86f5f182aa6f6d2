"""Session settings for a cluster run and for local tests."""

import os

from pyspark.sql import SparkSession

# Given only where the launcher gives nothing.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.session.timeZone": "UTC",
    # Call sites of column expressions help debugging but cost several driver round trips each.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}
WIDTH = "spark.sql.shuffle.partitions"
CLUSTER = {"spark.sql.adaptive.coalescePartitions.initialPartitionNum": "4000"}


def build_session(app="workpulse", master=None, partitions=None):
    """Session with adaptive plans on; ``master`` and ``partitions`` are for local runs only.

    On a cluster leave both unset: the launcher gives the master, and shuffles start wide and are merged
    by the adaptive planner to the advisory size. What the launcher sets stays as it is.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        builder = builder.config("spark.driver.memory", os.environ.get("WORKPULSE_DRIVER_MEMORY", "8g"))
    if partitions:
        builder = builder.config(WIDTH, str(partitions))
    session = builder.getOrCreate()
    given = session.sparkContext.getConf()
    wanted = dict(DEFAULTS)
    if not master and not given.contains(WIDTH):
        wanted |= CLUSTER
    for name, value in wanted.items():
        if not given.contains(name) and session.conf.isModifiable(name):
            session.conf.set(name, value)
    session.sparkContext.setLogLevel("ERROR")
    return session
