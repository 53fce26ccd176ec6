"""Lineage cuts and tables for loops, in the shared checkpoint folder, and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a few columns that a broadcast may hold.
BROADCAST_ROWS = 200_000


def _folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where none is set, a temporary folder on a local master only."""
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(configured or tempfile.mkdtemp(prefix="lumenweave-"))
    return jsc.getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once, as a compressed table that stays: what reads it neither computes it again nor takes it for dealt by a key, as it would a checkpoint's."""
    return keep(df)


def keep(df: DataFrame) -> DataFrame:
    """``cut`` as a table of its own that ``drop`` deletes again, for loops."""
    spark = df.sparkSession
    path = f"{_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept = path
    return out


def drop(*kept: DataFrame | None) -> None:
    """Delete tables of ``keep`` that nothing will read any more."""
    for df in kept:
        if df is not None:
            sc = df.sparkSession.sparkContext
            path = sc._jvm.org.apache.hadoop.fs.Path(df._kept)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def wide(df: DataFrame) -> DataFrame:
    """``df``, marked so that its joins shuffle: by the size of compressed files, Spark takes millions of rows for few and sends them through the driver."""
    return df.hint("merge")


#: Rows of a task: partitions that go by compressed bytes would grow with rows that compress well.
TASK_ROWS = 1 << 17


def dealt(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """``df`` dealt by ``by`` to as many tasks as hold TASK_ROWS of ``rows`` each; adaptive plans leave these as they are. A few tasks' rows stay."""
    return df if rows <= 4 * TASK_ROWS else df.repartition(-(-rows // TASK_ROWS) or 1, *by)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, marked for broadcast only if its counted rows are few; else its joins shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
