"""What the launcher sets stays."""

import subprocess
import sys

SCRIPT = """
from pyspark.sql import SparkSession
SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("{name}", "{value}").getOrCreate()
from workpulse.session import CLUSTER, build_session
session = build_session()
print("GOT", session.conf.get("{name}"), session.conf.get("spark.sql.session.timeZone"), *[session.conf.get(k, None) or "none" for k in CLUSTER])
"""


def _run(name, value):
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(name=name, value=value)], capture_output=True, text=True, timeout=120)
    return next(line for line in done.stdout.splitlines() if line.startswith("GOT")).split()[1:]


def test_a_launcher_value_survives():
    assert _run("spark.sql.adaptive.advisoryPartitionSizeInBytes", "7m") == ["7m", "UTC", "4000"]


def test_a_launcher_width_keeps_the_planner_from_starting_wider():
    assert _run("spark.sql.shuffle.partitions", "77") == ["77", "UTC", "none"]
