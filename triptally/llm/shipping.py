"""Makes this package importable in the executors' Python workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

import triptally

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package's source to the executors once per application. The archive stays with the
    driver, which serves it; executors that join later fetch it too."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(triptally.__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="triptally-source-")) / "triptally_source.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)
