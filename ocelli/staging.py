"""Frames that are read more than once, stored where all executors can read them."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir`` or of the context; a local master without either gets one of its own."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="ocelli-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = "file://" + own
        spark.conf.set("spark.checkpoint.dir", found)
    return found


class Stage:
    """Tables of one operator's rounds; ``free`` deletes those that later rounds don't read."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` as a table: its partitions stay as they are, also when executors are lost."""
        path = f"{folder(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def free(self, keep: int = 0) -> None:
        """Deletes all tables but the last ``keep``."""
        cut = len(self.paths) - keep
        gone, self.paths = self.paths[:cut], self.paths[cut:]
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        for path in gone:
            where = hadoop.Path(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
