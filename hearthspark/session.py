"""Session defaults: UTC, AQE, Arrow. A session that runs already is used as it is, and what spark-submit or spark-defaults.conf set stays."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark import SparkConf, SparkContext
from pyspark.sql import SparkSession


def _configured() -> set[str]:
    """Settings that others made: by spark-submit (its process is there before ours) or in spark-defaults.conf."""
    found: set[str] = set()
    if "PYSPARK_GATEWAY_PORT" in os.environ:
        SparkContext._ensure_initialized()
        found |= {k for k, _ in SparkConf().getAll()}
    folder = os.environ.get("SPARK_CONF_DIR") or (os.path.join(os.environ["SPARK_HOME"], "conf") if "SPARK_HOME" in os.environ else "")
    path = os.path.join(folder, "spark-defaults.conf")
    if folder and os.path.exists(path):
        with open(path) as f:
            found |= {line.replace("=", " ").split()[0] for line in f if line.strip() and not line.startswith("#")}
    return found


def get_session(app: str = "hearthspark", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session for local runs and tests. Arguments that are given hold; all other settings are defaults, for what is set nowhere."""
    if SparkContext._active_spark_context is not None:
        return SparkSession.builder.getOrCreate()
    cores, known = os.environ.get("BENCH_CPUS", "8"), _configured()
    local = master is None and "spark.master" not in known
    defaults = {
        "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.coalescePartitions.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    if local:  # one machine: as many partitions as cores
        defaults |= {"spark.master": f"local[{cores}]", "spark.sql.shuffle.partitions": cores, "spark.ui.enabled": "false", "spark.driver.memory": os.environ.get("HEARTH_DRIVER_MEMORY", "8g")}
    given = {"spark.master": master, "spark.sql.shuffle.partitions": shuffle_partitions and str(shuffle_partitions)}
    conf = {k: v for k, v in defaults.items() if k not in known} | {k: v for k, v in given.items() if v}
    return SparkSession.builder.appName(app).config(map=conf).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per application: they need it for Arrow functions."""
    context = spark.sparkContext
    if getattr(context, "_hearthspark_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="hearthspark-"), "hearthspark.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("hearthspark", os.path.relpath(full, root)))
    context.addPyFile(path)
    context._hearthspark_shipped = True
