"""Tables written between steps, in the folder that all executors share.

A staged table cuts lineage: a lost executor costs the tasks it ran, never the
steps before.  The folder is the session's ``spark.checkpoint.dir``.  Only a local
session (tests, benches) without that setting gets a temporary folder.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder for staged tables; an error on a cluster that names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _local:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        _local[app] = tempfile.mkdtemp(prefix="screeline-")
        atexit.register(shutil.rmtree, _local[app], ignore_errors=True)
    return f"file://{_local[app]}"


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _clear(spark: SparkSession, path: str) -> None:
    """Deletes a folder at the end of the program, if the session still can."""
    try:
        _delete(spark, path)
    except Exception:  # noqa: BLE001 - the session may have ended before
        pass


class Staging:
    """Staged tables of one operator call.

    ``put`` writes a table once and reads it back; ``drop`` deletes one that no later
    step needs.  Tables that the lazy result still reads stay until the program ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/screeline/{name}-{uuid.uuid4().hex[:12]}"
        self.paths: dict[str, str] = {}
        atexit.register(_clear, spark, self.root)

    def put(self, name: str, df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
        path = f"{self.root}/{name}"
        previous = self.paths.get(name)
        if previous:
            path = f"{path}-{uuid.uuid4().hex[:8]}"
        writer = df.write.option("compression", "zstd")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
        self.paths[name] = path
        if previous:
            _delete(self.spark, previous)
        if partition_by:
            return self.spark.read.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            if name in self.paths:
                _delete(self.spark, self.paths.pop(name))
