"""What executors need: this package, which Python workers import wherever they start, and a folder that all of them see."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

HERE = Path(__file__).resolve().parent

#: The application that has the package.
_shipped: list[str] = []


def ship(spark: SparkSession) -> None:
    """Adds the package to the files that Spark itself sends to executors, once an application. The driver keeps the archive in the folder that Spark removes at its end."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    path = os.path.join(sc._temp_dir, f"{HERE.name}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(HERE.rglob("*.py")):
            z.write(f, f.relative_to(HERE.parent))
    sc.addPyFile(path)
    _shipped[:] = [sc.applicationId]


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir, else the context's checkpoint folder, which is set here only where neither is set.

    A running session takes no other value of spark.checkpoint.dir, so the context holds it."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="facetlens-"))
        at = sc.getCheckpointDir()
    return at
