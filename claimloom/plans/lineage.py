"""Reliable cuts of long lineages, in the folder that the cluster names, and the sizes that decide how rows are moved."""

from __future__ import annotations

import re
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[2])

#: A side is broadcast only when its counted rows times their width stay under this many bytes.
BROADCAST_BYTES = 64 << 20
#: Bytes of a table for each core up to which its rows are dealt to all cores; more than that come in enough splits of their own.
SPLIT_BYTES = 128 << 20


def saved(df: DataFrame) -> DataFrame:
    """df, written to spark.checkpoint.dir and read again; a temporary folder serves only a local session that names none, as in tests."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints"))
    return df.checkpoint()


def workers(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the driver was started from."""
    env = spark.sparkContext.environment
    path = env.get("PYTHONPATH", "")
    if ROOT not in path.split(":"):
        env["PYTHONPATH"] = f"{ROOT}:{path}" if path else ROOT


def fits(rows: int, width: int) -> bool:
    return rows * width <= BROADCAST_BYTES


def spread(df: DataFrame, key: str) -> DataFrame:
    """df, dealt by key to all cores if it is too small to come in a split for each: a small file may be one row group.

    Files for all cores are read as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= cores:
        return df
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores, key) if size <= cores * SPLIT_BYTES else df
