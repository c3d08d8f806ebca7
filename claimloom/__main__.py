"""python -m claimloom: package, topic, hesitation and serve, over files in any file system that Spark reads."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import assembly, claims, cluster, reports, speech, terrain, worth
from .plans import service
from .sources import files


def build_topic(spark: SparkSession, folder: str, method: str, threshold: float | None):
    """(members, groups) of the files video_*.json of a folder, which are one topic."""
    segments, videos = files.topic_folder(spark, folder)
    rows = claims.records(claims.classified(claims.split_claims(segments))).join(videos.select("video_id", "video_ord"), "video_id")
    rows = rows.withColumns({"topic_id": F.lit("topic"), "topic_ord": F.col("video_ord").cast("bigint") * (1 << 32) + F.col("claim_ord")})
    rows = terrain.members(rows, cluster.clusters(rows, method, threshold)).cache()
    return rows, terrain.claim_groups(rows, method).cache()


def main(words: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="claimloom")
    sub = parser.add_subparsers(dest="command", required=True)
    p = sub.add_parser("package", help="segments to typed claims, and whether they are worth more analysis")
    p.add_argument("segments"), p.add_argument("out"), p.add_argument("--assembly", choices=("cue", "sentence"), default="cue")
    for name in ("topic", "serve"):
        p = sub.add_parser(name, help="claims of several videos into groups" + " and answer questions about them" * (name == "serve"))
        p.add_argument("folder")
        p.add_argument("--clusterer", choices=sorted(cluster.THRESHOLDS), default="normalized"), p.add_argument("--threshold", type=float)
        if name == "topic":
            p.add_argument("out")
    p = sub.add_parser("hesitation", help="markers of word timings (JSON lines)")
    p.add_argument("words"), p.add_argument("out")
    a = parser.parse_args(words)
    spark = SparkSession.builder.getOrCreate()
    if a.command == "package":
        segments, videos = files.segments(spark, a.segments)
        if a.assembly == "sentence":
            segments = assembly.segments_to_sentences(segments)
        found = claims.classified(claims.split_claims(segments, presplit=a.assembly == "cue"))
        videos = claims.packages(segments, videos.withColumnRenamed("genre", "genre_override"))
        decisions = worth.decisions(found, videos)
        files.bundle(a.out, {"claims": found, "videos": videos, "timeline": assembly.timeline(found), "worth": decisions, "worth_markdown": reports.worth_markdown(decisions)}, {})
    elif a.command == "hesitation":
        rows = speech.hesitation(files.read_jsonl(spark, a.words, "claim_id string, word_ord int, word string, start string, `end` string"))
        files.bundle(a.out, {"hesitation": rows, "hesitation_markdown": reports.hesitation_markdown(rows)}, {})
    else:
        rows, groups = build_topic(spark, a.folder, a.clusterer, a.threshold)
        if a.command == "serve":
            service.serve(sys.stdin, lambda s: (sys.stdout.write(s), sys.stdout.flush()), service.topic_tools(rows, groups))
        else:
            tables = {"claims": rows, "evidence": claims.evidence_records(rows), "groups": groups, "disagreements": terrain.disagreements(groups), "outliers": terrain.outliers(groups), "contradictions": terrain.contradictions(rows, groups)}
            tables |= {"opinion_groups": terrain.opinion_groups(groups), "opinion_warnings": terrain.opinion_warnings(groups), "stance_groups": terrain.stance_groups(rows), "terrain_markdown": reports.terrain_markdown(groups), "prompt": reports.prompt(groups)}
            files.bundle(a.out, tables, {})
    return 0


if __name__ == "__main__":
    sys.exit(main())
