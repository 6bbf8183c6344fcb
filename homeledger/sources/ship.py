"""Sends this package to the executors, for operators whose functions run in Python workers."""

from __future__ import annotations

import tempfile
import zipfile
from functools import lru_cache
from pathlib import Path

from pyspark.sql import SparkSession


@lru_cache(maxsize=4)
def _shipped(app: str) -> Path:
    package = Path(__file__).resolve().parent.parent
    at = Path(tempfile.mkdtemp(prefix="package-")) / "homeledger_core.zip"
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, str(p.relative_to(package.parent)))
    SparkSession.getActiveSession().sparkContext.addPyFile(str(at))
    return at


def ship(spark: SparkSession) -> None:
    _shipped(spark.sparkContext.applicationId)
