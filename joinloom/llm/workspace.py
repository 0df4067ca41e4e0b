"""Intermediate tables in the folder that the cluster shares.

``stage`` cuts lineage by writing Parquet: an executor that is lost later costs no
recomputation of what was written, and a non-deterministic task order cannot make
two reads differ.  The folder is the one in ``spark.checkpoint.dir``, or the context's
checkpoint folder.  Only a local master, whose executors are the driver, gets a
folder of its own where neither is set; a cluster without one is an error.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="joinloom-"))
    return context._jsc.sc().getCheckpointDir().get()


def clean(spark: SparkSession) -> None:
    """Deletes all that operators have left in the shared folder, other runs' too."""
    _delete(spark, f"{shared_dir(spark)}/joinloom")


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Workspace:
    """A folder of one run's intermediate tables."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.count = spark, f"{shared_dir(spark)}/joinloom/{name}-{uuid.uuid4().hex}", 0
        self._held: dict[int, tuple[DataFrame, str]] = {}

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        self.count += 1
        path = f"{self.path}/{self.count:02d}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._held[id(out)] = (out, path)
        return out

    def release(self, *tables: DataFrame) -> None:
        """Deletes staged tables that nothing still to be run reads."""
        for t in tables:
            _, path = self._held.pop(id(t), (None, None))
            if path:
                _delete(self.spark, path)

    def result(self, df: DataFrame) -> DataFrame:
        """``df`` staged, and all that was staged before deleted."""
        before = [t for t, _ in self._held.values()]
        out = self.stage(df, "result")
        self.release(*before)
        return out
