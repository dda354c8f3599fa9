"""The package's code for executors that don't have it installed."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, once per Spark context."""
    context = spark.sparkContext
    if getattr(context, "_shelfmark_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    # On the driver alone, which serves it to executors.
    target = Path(tempfile.mkdtemp(prefix="shelfmark-code-")) / "shelfmark_code.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for file in sorted(package.rglob("*.py")):
            archive.write(file, file.relative_to(package.parent))
    context.addPyFile(str(target))
    context._shelfmark_shipped = True
