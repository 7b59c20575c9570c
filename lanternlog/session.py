"""Session defaults for local runs; on a cluster the submitter's configuration wins."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def local_session(cpus: int | None = None, app: str = "lanternlog", memory: str = "8g") -> SparkSession:
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Send this package to Python workers that could not import it: neither their path nor their folder has it.

    A cluster job that was submitted with the package (--py-files, an image, PYTHONPATH) needs nothing of this.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    sc = spark.sparkContext
    if root in os.environ.get("PYTHONPATH", "").split(os.pathsep) or os.getcwd() == root or getattr(sc, "_lanternlog_shipped", False):
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="spark-", dir="/tmp"), "lanternlog.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(os.path.join(root, "lanternlog")):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, root))
    sc.addPyFile(archive)
    sc._lanternlog_shipped = True
