"""Session helpers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors once for each context, so that Python workers anywhere can import it."""
    sc = spark.sparkContext
    if getattr(sc, "_seamark_shipped", False):
        return spark
    root = Path(__file__).resolve().parent
    if root.is_dir():  # else the package itself was shipped as an archive
        archive = Path(tempfile.mkdtemp(prefix="seamark-")) / "seamark.zip"
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, Path(root.name) / p.relative_to(root))
        sc.addPyFile(str(archive))
    sc._seamark_shipped = True
    return spark
