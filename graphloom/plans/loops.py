"""Lineage cutting and shared storage for iterative plans.

Every loop writes its state as Parquet into the folder that all executors
share (``spark.checkpoint.dir``), so a lost executor costs a re-read and not a
recomputation of the whole loop.  Nothing is ever kept on one executor only.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder for cut plans: ``spark.checkpoint.dir`` of the session.

    Only a local session may go without it; it then gets a temporary folder
    that is removed at exit.  A cluster session without the setting uses the
    home directory of its default file system, unless that is a local disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if spark.sparkContext.master.split("[")[0] == "local":
        key = spark.sparkContext.applicationId
        if key not in _OWN:
            _OWN[key] = tempfile.mkdtemp(prefix="graphloom-")
            atexit.register(shutil.rmtree, _OWN[key], ignore_errors=True)
        return "file://" + _OWN[key]
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs.FileSystem.get(spark.sparkContext._jsc.hadoopConfiguration())
    home = fs.getHomeDirectory().toString()
    if home.startswith("file:"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{home}/.graphloom"


def _forget(spark: SparkSession, path: str) -> None:
    """Remove the stages of a loop when the driver ends, if its session still runs."""
    try:
        sc = spark.sparkContext
        if sc._jsc is not None:
            target = sc._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:
        pass


class Cutter:
    """Writes stages of a plan and removes those that are no longer needed.

    What is left, such as the table behind a result, is removed when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._count = 0
        atexit.register(_forget, spark, self.base)

    def path(self) -> str:
        self._count += 1
        return f"{self.base}/{self._count:04d}"

    def cut(self, df: DataFrame) -> tuple[DataFrame, str]:
        """Run ``df``, store its rows, and return them as a plan without history."""
        path = self.path()
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def cut_counting(self, df: DataFrame, **metrics: Column) -> tuple[DataFrame, str, dict]:
        """As :meth:`cut`, with aggregates of the rows that are taken while they are written."""
        seen = Observation()
        path = self.path()
        named = [c.alias(k) for k, c in metrics.items()] or [F.count(F.lit(1)).alias("n")]
        df.observe(seen, *named).write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path, seen.get

    def drop(self, *paths: str | None) -> None:
        """Delete stages; ``None`` entries are ignored."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for path in paths:
            if path:
                target = jvm.org.apache.hadoop.fs.Path(path)
                target.getFileSystem(conf).delete(target, True)
