"""Session settings shared by tests, the benchmark and applications."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for one machine; on a cluster use the cluster's own session instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("rainloom")
        .config("spark.driver.memory", os.environ.get("RAINLOOM_DRIVER_MEMORY", memory))
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once for a context: executors need not have it installed."""
    context = spark.sparkContext
    if getattr(context, "_rainloom_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    if os.path.isdir(root):  # else it came here as an archive itself
        path = os.path.join(tempfile.mkdtemp(), "rainloom_package.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
            for folder, _, names in sorted(os.walk(root)):
                for name in sorted(n for n in names if n.endswith(".py")):
                    archive.write(os.path.join(folder, name), os.path.relpath(os.path.join(folder, name), os.path.dirname(root)))
        context.addPyFile(path)
    context._rainloom_shipped = True
