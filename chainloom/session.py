"""Sessions, and shipping this package to executors that do not have it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent
_SHIPPED: set[str] = set()


def local_session(cpus: int | str = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings that the tests and the benchmark use."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("chainloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Give the executors this package through Spark's own file service, once for each application.

    Nothing is done where workers find it by PYTHONPATH or by the working folder.
    """
    app = spark.sparkContext.applicationId
    here = str(ROOT.parent)
    known = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p} | {os.path.realpath(os.getcwd())}
    if app in _SHIPPED or os.path.realpath(here) in known:
        return
    to = Path(tempfile.mkdtemp()) / "chainloom.zip"
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(ROOT.rglob("*.py")):
            z.write(p, p.relative_to(ROOT.parent))
    spark.sparkContext.addPyFile(str(to))
    _SHIPPED.add(app)
