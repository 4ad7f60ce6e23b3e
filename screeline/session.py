"""Session defaults for local work; a cluster brings its own session."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.host": "127.0.0.1",
}


def local_session(cores: int | None = None, app: str = "screeline", **conf: str) -> SparkSession:
    """A local session for tests and benches: ``cores`` threads, as many shuffle partitions."""
    cores = cores or int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    settings = DEFAULTS | {
        "spark.sql.shuffle.partitions": str(cores),
        "spark.driver.memory": "12g",
    } | conf
    spark = SparkSession.builder.master(f"local[{cores}]").appName(app).config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Sends this package, compiled, to the session's Python workers; once a session.

    Workers need it wherever the driver runs from.  Spark's own file server hands it out, so
    nothing has to lie on the workers' machines.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    folder = tempfile.mkdtemp(prefix="screeline-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)  # the file server reads it until then
    # compiled from a copy: the place of the package may be read-only
    package = shutil.copytree(Path(__file__).resolve().parent, Path(folder, "screeline"), ignore=shutil.ignore_patterns("__pycache__"))
    target = Path(folder, "screeline.zip")
    with zipfile.PyZipFile(str(target), "w") as archive:
        archive.writepy(str(package))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)


def table(spark: SparkSession, folder: str, name: str):
    """The table ``name`` of a folder of parquet tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
