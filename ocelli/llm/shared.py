"""Session helpers of the corpus operators: shared scratch tables and partition counts."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Scratch tables of this process, in the order in which they were written.
_MADE: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` or the context's checkpoint directory names.

    Without either, a local master gets a folder of its own; a cluster is refused,
    as its executors would write to disks that others can't read.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not context.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="ocelli-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        folder = "file://" + own
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def made() -> int:
    """How many scratch tables there are, for ``freed``."""
    return len(_MADE)


def freed(spark: SparkSession, began: int, *kept: DataFrame) -> None:
    """Deletes the scratch tables written since ``began`` but for those of ``kept``; nothing that is still read may hang on them."""
    stay = {df.scratch_path for df in kept}
    paths = [p for p in _MADE[began:] if p not in stay]
    _MADE[began:] = [p for p in _MADE[began:] if p in stay]
    _deleted(spark, paths)


def _deleted(spark: SparkSession, paths: list[str]) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs
    for path in paths:
        where = hadoop.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes, when it ends, the scratch tables that operators wrote within; what they returned has to be stored by then."""
    began = len(_MADE)
    try:
        yield
    finally:
        paths, _MADE[began:] = _MADE[began:], []
        _deleted(spark, paths)


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What ``make`` gives, ``written``; the scratch tables that it took are deleted."""
    began = len(_MADE)
    out = written(make(), name)
    paths, _MADE[began:] = _MADE[began:-1], _MADE[-1:]
    _deleted(spark, paths)
    return out


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` written once, with a row number under a name that no column has.

    The numbers depend on how files are split, which differs from scan to scan as
    cores come and go; so every join by row has to read this table, never ``docs``.
    """
    taken = {c.lower() for c in docs.columns}
    name = next(n for n in (f"_row{k}" for k in range(len(taken) + 1)) if n not in taken)
    return written(docs.withColumn(name, F.monotonically_increasing_id()), "rows"), name


def only(whole: DataFrame, name: str, rows: DataFrame) -> DataFrame:
    """The rows of ``whole`` (from ``numbered``, as is ``name``) whose number is in ``rows`` (a frame of one column)."""
    return whole.join(rows.toDF(name), name, "left_semi").drop(name)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
