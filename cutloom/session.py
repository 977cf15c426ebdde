"""Session factory with the settings that every query relies on."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def get_spark(app: str = "cutloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with AQE on; ``conf`` keys use ``__`` for dots. On a cluster the master comes from spark-submit."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Give this package to Python workers that can't import it from where they are (neither PYTHONPATH nor their folder has it). Spark serves the archive to executors."""
    root = Path(__file__).resolve().parents[1]
    known = {Path(p).resolve() for p in [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()] if p}
    sc = spark.sparkContext
    if root in known or getattr(sc, "_cutloom_shipped", False):
        return
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="cutloom-"), "cutloom"), "zip", root, "cutloom")
    sc.addPyFile(archive)
    sc._cutloom_shipped = True
