"""Makes this package importable on executors that don't find it themselves."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package's code along with the application, once, unless the workers' path holds it already."""
    sc = spark.sparkContext
    if str(_ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or sc.applicationId in _shipped:
        return spark
    target = Path(tempfile.mkdtemp(prefix="tabulon")) / "tabulon.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted((_ROOT / "tabulon").rglob("*.py")):
            z.write(p, p.relative_to(_ROOT))
    sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)
    return spark
