"""Sending the package's code to the executors' Python, which may not have it installed."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once an application: a zip of this package's modules, by Spark's own file server."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        top = Path(__file__).resolve().parent
        file = Path(tempfile.mkdtemp(prefix="matchloom-code-")) / "matchloom.zip"
        with zipfile.ZipFile(file, "w") as z:
            for f in sorted(top.rglob("*.py")):
                z.write(f, f.relative_to(top.parent))
        sc.addPyFile(str(file))
        _shipped.add(sc.applicationId)
