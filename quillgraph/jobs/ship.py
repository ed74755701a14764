"""Sends this package to the executors of a session that can't import it from their own path."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package as a zip, once per application; Spark's file server hands it to executors, new ones too."""
    app = spark.sparkContext.applicationId
    if app not in _sent:
        _sent.add(app)
        top = Path(__file__).resolve().parents[2]
        spark.sparkContext.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp()}/quillgraph", "zip", top, "quillgraph"))
