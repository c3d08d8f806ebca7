"""Scans and sinks: JSON documents and lines, text, segment files, package directories, line-numbered trees of text."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEGMENT = "text string, speaker string, time_ref string, source_hint string, modality_source string"
VIDEO = "video_id string, title string, language string, duration_seconds int, genre string"
TEXT_SUFFIXES = tuple(f".{x}" for x in "cfg json md py toml txt yaml yml".split())
SKIPPED = (".git", ".pytest_cache", "__pycache__", "build", "dist")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever file system it names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One document a file; no rows where there is no file."""
    return spark.read.schema(schema).json(path, multiLine=True) if exists(spark, path) else spark.createDataFrame([], schema)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row a line, blank ones passed over; no rows where there is no file."""
    return spark.read.schema(schema).json(path) if exists(spark, path) else spark.createDataFrame([], schema)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """value: the whole text of each file."""
    return spark.read.text(path, wholetext=True)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON document a row; nulls are written, and what stood at the path is replaced once all is written."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").option("ignoreNullFields", "false").json(path)


def write_text(df: DataFrame, path: str) -> None:
    """The single string column of df, in its order, as one file."""
    df.coalesce(1).write.mode("overwrite").text(path)


def segments(spark: SparkSession, path: str, glob: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(segments, videos) of files that hold a list of segments, or an object with `video` and `segments`.

    A bare list has no header: its video_id is its file's name. Other shapes: ValueError, from a look at the files' first characters.
    """
    rows = spark.read.text(path, wholetext=True, pathGlobFilter=glob) if glob else spark.read.text(path, wholetext=True)
    rows = rows.select("value", F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "").alias("file"))
    kind = F.left(F.regexp_replace("value", r"^[﻿\s]+", ""), F.lit(1))
    if rows.where(~kind.isin("[", "{")).limit(1).count():
        raise ValueError("segments must be a JSON list, or an object with a list of segments")
    item = f"array<struct<{SEGMENT.replace(' string', ':string')}>>"
    whole = F.from_json("value", f"struct<video:struct<{VIDEO.replace(' string', ':string').replace(' int', ':int')}>,segments:{item}>")
    parsed = rows.select("file", F.when(kind == "{", whole).alias("o"), F.when(kind == "[", F.from_json("value", item)).alias("l"))
    held = parsed.select(F.coalesce("o.video.video_id", "file").alias("video_id"), "o.video", F.coalesce("o.segments", "l").alias("segments"))
    if held.where("segments is null").limit(1).count():
        raise ValueError("segments must be a JSON list, or an object with a list of segments")
    videos = held.select("video_id", *(F.col(f"video.{c.split()[0]}") for c in VIDEO.split(", ")[1:]))
    return held.select("video_id", F.posexplode("segments").alias("seg_ord", "s")).select("video_id", "seg_ord", "s.*"), videos


def topic_folder(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """segments() of the files video_*.json of a folder; videos get `video_ord`, the order of the files' names."""
    from pyspark.sql import Window

    found, videos = segments(spark, path, "video_*.json")
    return found, videos.withColumn("video_ord", F.row_number().over(Window.orderBy("video_id")))


def package(spark: SparkSession, schema: str, path: str | None = None, run_dir: str | None = None) -> DataFrame:
    """A package's document, or that of a run's folder (residual/package.json)."""
    return read_json(spark, path or f"{run_dir}/residual/package.json", schema)


def text_tree(spark: SparkSession, root: str, suffixes: tuple[str, ...] = TEXT_SUFFIXES, skipped: tuple[str, ...] = SKIPPED) -> DataFrame:
    """path, line_no, line of the text files below a folder; undecodable files have no rows."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    low = F.lower("path")
    wanted = F.lit(False)
    for s in suffixes:
        wanted = wanted | F.endswith(low, F.lit(s))
    for part in skipped:
        wanted = wanted & ~F.contains("path", F.lit(f"/{part}/"))
    text = F.try_validate_utf8(F.col("content").cast("string"))
    lines = files.where(wanted).select("path", F.posexplode_outer(F.split(text, r"\r\n|\r|\n")).alias("n", "line"))
    return lines.where("line is not null").select("path", (F.col("n") + 1).alias("line_no"), "line")


def bundle(out: str, tables: dict[str, DataFrame], texts: dict[str, str]) -> dict:
    """A topic's tables as JSON lines by name, its texts as files, and a manifest of both, which is returned."""
    for name, df in tables.items():
        write_jsonl(df, f"{out}/{name}")
    spark = next(iter(tables.values())).sparkSession
    for name, text in texts.items():
        write_text(spark.createDataFrame([(text,)], "value string"), f"{out}/{name}")
    manifest = {"tables": sorted(tables), "texts": sorted(texts)}
    write_text(spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string"), f"{out}/manifest")
    return manifest


def local(path: str | Path) -> str:
    return Path(path).absolute().as_uri()
