"""Read-only questions about topics and overlays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMITS = ("labels and structures text; never decides what is true", "not fact-checked", "not truth-ranked")


def topic_summary(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """topic_id, video_record_count, claim_total, claim_group_count, counts of repeated, disagreeing and single-source groups."""
    sizes = rows.groupBy("topic_id").agg(F.count_distinct("video_id").alias("video_record_count"), F.count("*").alias("claim_total"))
    kinds = groups.groupBy("topic_id").agg(F.count("*").alias("claim_group_count"), F.count_if("repeated_claim").alias("repeated_claim_groups"), F.count_if("disagreement_point").alias("disagreement_groups"), F.count_if("outlier_claim").alias("outlier_groups"))
    return sizes.join(kinds, "topic_id").withColumns({"truth_status": F.lit("not_evaluated"), "fact_check_status": F.lit("not_performed")})


def topic_claim_groups(groups: DataFrame) -> DataFrame:
    return groups.select("topic_id", "group_id", "label", "claim_count", "video_ids", F.struct("repeated_claim", "disagreement_point", "outlier_claim").alias("status"), F.struct("video_count", "speaker_count", F.lit(0).alias("channel_count")).alias("source_diversity"), "grouping_confidence", "human_review_required")


def group_detail(groups: DataFrame, rows: DataFrame, group_id: str | None = None) -> DataFrame:
    """The members of a group of each topic, or of all groups, with their evidence; no row where there is no such group."""
    if group_id is not None:
        groups = groups.where(F.col("group_id") == group_id)
    return groups.select("topic_id", "group_id", "cluster").join(rows, ["topic_id", "cluster"]).select("topic_id", "group_id", "claim_uid", "video_id", "time_ref", "timestamp_start", "speaker", "confidence", "modality", "evidence_id", "coordinate", "need_gates", "text")


def topic_limitations(groups: DataFrame) -> DataFrame:
    return groups.select("topic_id").distinct().withColumns({"limitations": F.array(*map(F.lit, LIMITS)), "truth_status": F.lit("not_evaluated"), "fact_check_status": F.lit("not_performed")})


def overlay_summary(overlays: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return overlays.select("overlay_id", F.coalesce("ok", F.lit(False)).alias("ok"), text("schema_version"), text("topic_id"), text("overlay_status"), F.coalesce("overlay_group_count", F.lit(0)).alias("overlay_group_count"), "limitations", "policy")


def overlay_groups(overlays: DataFrame, overlay_group_id: str | None = None) -> DataFrame:
    """A row a group of each overlay, with defaults for what is missing; those of one id only, if given."""
    rows = overlays.select("overlay_id", F.posexplode("overlay_groups").alias("group_ord", "g"))
    text = lambda c: F.coalesce(f"g.{c}", F.lit("")).alias(c)
    found = rows.select("overlay_id", "group_ord", text("overlay_group_id"), text("source_group_id"), text("split_axis"), F.coalesce("g.claim_count", F.lit(0)).alias("claim_count"), text("truth_status"), text("fact_check_status"), F.coalesce("g.allowed_for_model_answer", F.lit(False)).alias("allowed_for_model_answer"))
    return found if overlay_group_id is None else found.where(F.col("overlay_group_id") == overlay_group_id)
