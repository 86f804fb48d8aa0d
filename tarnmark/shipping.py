"""Makes this package importable in Python workers of any cluster."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Add the package to the session's Python files, once per application.

    Not needed where PYTHONPATH already leads the workers to it.
    """
    home = Path(__file__).resolve().parent
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        _SHIPPED.add(app)
        if str(home.parent) not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
            base = os.path.join(tempfile.mkdtemp(prefix="tarnmark-code-"), "tarnmark")
            spark.sparkContext.addPyFile(shutil.make_archive(base, "zip", home.parent, home.name))
    return spark
