"""What the operators share: worker imports, reliable checkpoints, and size-checked broadcasts."""

from __future__ import annotations

import re
import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])

#: A side is broadcast only when its counted rows times their width stay under this many bytes.
BROADCAST_BYTES = 64 << 20

#: Rows of an Arrow batch, where the session leaves Spark's own number (10,000 rows, whatever they hold): texts and pages are long.
BATCH_ROWS, SPARK_BATCH_ROWS = 500, "10000"
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the driver was started from, and get batches that fit their memory."""
    env = spark.sparkContext.environment
    path = env.get("PYTHONPATH", "")
    if ROOT not in path.split(":"):
        env["PYTHONPATH"] = f"{ROOT}:{path}" if path else ROOT
    if spark.conf.get(_ROWS) == SPARK_BATCH_ROWS:
        spark.conf.set(_ROWS, str(BATCH_ROWS))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. A temporary one serves a local session that names none, as in
    tests; on a cluster that is an error, for its executors would write to their own disks."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints"))
    return sc.getCheckpointDir()


def saved(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def delete(spark: SparkSession, folder: str) -> None:
    """Delete a folder that this session has written, wherever it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fits(rows: int, width: int, budget: int = BROADCAST_BYTES) -> bool:
    return rows * width <= budget


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def name(column: str) -> Column:
    """A top-level column by its name, whatever characters stand in it."""
    return F.col("`" + column.replace("`", "``") + "`")


def content(text: str = "text") -> Column:
    """128 bits that stand for a text; null for a null one."""
    return F.unhex(F.md5(name(text)))


def attach(rows: DataFrame, side: DataFrame, keys: list[str], width: int, heavy: Column | None = None) -> DataFrame:
    """rows left-joined with side, which has one row a key; the result is the same whichever way is taken.

    A side whose counted rows fit is broadcast. A greater one is joined by shuffles, but its rows marked `heavy` (keys that many
    rows share; there are few of them, and they are counted, too) go to the rows by a broadcast, so that no task gets a hot key.
    """
    if fits(side.count(), width):
        return rows.join(F.broadcast(side), keys, "left")
    if heavy is None or not fits(hot := side.where(heavy).count(), width) or not hot:
        return rows.join(side, keys, "left")
    hot_keys = F.broadcast(side.where(heavy).select(keys))
    many = rows.join(hot_keys, keys, "left_semi").join(F.broadcast(side.where(heavy)), keys, "left")
    few = rows.join(hot_keys, keys, "left_anti").join(side.where(~heavy), keys, "left")
    return many.unionByName(few)


def without(docs: DataFrame, key: Column, gone: DataFrame, width: int = 100) -> DataFrame:
    """Rows of docs, with their columns as they were, whose key isn't in gone (one column, distinct, saved). Null keys always stay."""
    at = fresh(docs, "key_")
    gone = gone.toDF(at)
    rows = docs.withColumn(at, key)
    back = [name(c) for c in docs.columns]
    if fits(gone.count(), width):
        return rows.join(F.broadcast(gone), at, "left_anti").select(back)
    # rows without a key needn't meet in one task
    return rows.where(name(at).isNotNull()).join(gone, at, "left_anti").unionByName(rows.where(name(at).isNull())).select(back)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
