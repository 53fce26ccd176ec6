"""Shared helpers: table access, lineage cuts and session services."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table of a data directory; any file system that Spark can open."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where none is set, a temporary folder on a local master only."""
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(configured or tempfile.mkdtemp(prefix="lumenweave-"))
    return jsc.getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so that lost executors cost no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stow(df: DataFrame) -> DataFrame:
    """``cut`` as a compressed table in the same folder, for what is large: less disk, columns pruned, free again by ``discard``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    # small row groups: a task holds one in memory while it writes
    df.write.option("compression", "zstd").option("parquet.block.size", str(8 << 20)).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stowed = path
    return out


def discard(*stowed: DataFrame) -> None:
    """Delete tables of ``stow`` that nothing will read any more."""
    for df in stowed:
        remove(df.sparkSession, df._stowed)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared one, on whatever file system it is."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of a few longs that a broadcast may hold: some tens of MB on a node.
BROADCAST_ROWS = 400_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, marked for broadcast only if its counted rows are few; else its joins shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files of finished phases before the next phase writes its own."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def row_keys(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> tuple[DataFrame, bool]:
    """``docs`` with __key (long) and __clash (boolean), and whether any row clashes.

    The key is the id where no other row has it. Rows with a null id or one that several rows
    have clash: their key is a hash of id and text (below other ids), which repeated rows share.
    """
    own = F.col(id_col).cast("long")
    shared = cut(docs.select(own.alias("__shared")).groupBy("__shared").count().filter("count > 1 OR __shared IS NULL").select("__shared"))
    if shared.isEmpty():
        return docs.withColumns({"__key": own, "__clash": F.lit(False)}), False
    marked = docs.join(small(shared.withColumn("__clash", F.lit(True))), own.eqNullSafe(F.col("__shared")), "left").drop("__shared")
    low = F.lit(-(1 << 62)) + F.pmod(F.xxhash64(id_col, text), F.lit(1 << 61))
    return marked.withColumns({"__key": F.when(F.col("__clash"), low).otherwise(own), "__clash": F.coalesce("__clash", F.lit(False))}), True


def once(keyed: DataFrame, clashes: bool) -> DataFrame:
    """One row for each __key of ``row_keys``; only clashing rows shuffle."""
    if not clashes:
        return keyed
    return keyed.filter("NOT __clash").unionByName(keyed.filter("__clash").dropDuplicates(["__key"]))


def apart(key: str, name: str | None = None) -> Column:
    """A key (long) whose partitioning the planner doesn't know, so that a join shuffles both sides itself and AQE may split a hot key's rows."""
    return F.bitwise_not(F.bitwise_not(key)).alias(name or key)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(c: Column | str) -> Column:
    """Lower-case A-Z alone; other scripts keep their case."""
    return F.translate(F.col(c) if isinstance(c, str) else c, ASCII_UPPER, ASCII_LOWER)


def crc_fold(c: Column | str, folds: int) -> Column:
    """crc32 of an id's decimal text, modulo ``folds``."""
    return F.crc32((F.col(c) if isinstance(c, str) else c).cast("string").cast("binary")) % folds
