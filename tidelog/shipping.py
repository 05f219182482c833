"""Gets the package to the executors' Python."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package, once for each application, where workers wouldn't find it by PYTHONPATH or working folder."""
    named = {str(Path(p or ".").resolve()) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep)}
    app = spark.sparkContext.applicationId
    if str(ROOT) in named or Path.cwd() == ROOT or app in _SHIPPED:
        return
    _SHIPPED.add(app)
    folder = tempfile.mkdtemp(prefix="tidelog-")  # the driver's own; Spark sends what is in it
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    at = Path(folder) / "tidelog.zip"
    with zipfile.ZipFile(at, "w") as z:
        for f in (ROOT / "tidelog").rglob("*.py"):
            z.write(f, f.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(at))
