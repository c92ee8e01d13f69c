"""Makes the package importable in Python workers that don't have it on their path."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package to the session's Python files, once an application.

    Nothing is sent where the worker's own path already has it.
    """
    app = spark.sparkContext.applicationId
    home = str(_PACKAGE.parent)
    if app in _shipped or home in os.environ.get("PYTHONPATH", "").split(":"):
        return
    path = Path(tempfile.mkdtemp()) / f"{_PACKAGE.name}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(_PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(_PACKAGE.parent))
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)
