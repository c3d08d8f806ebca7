"""Markdown of topics, decisions and hesitation, written by the executors: a column of lines or a text a topic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _list(c: str) -> Column:
    return F.array_join(c, ", ")


def _text(name: str, value: Column | str) -> Column:
    return F.concat(F.lit(f"- {name}: "), F.coalesce((F.col(value) if isinstance(value, str) else value).cast("string"), F.lit("none")), F.lit("\n"))


def terrain_markdown(groups: DataFrame) -> DataFrame:
    """topic_id, markdown of claim_groups(): every group with its sources, stances and flags, in order."""
    part = F.concat(
        F.lit("## "), F.col("group_id"), F.lit(" "), F.col("label"), F.lit("\n"), _text("Claims", "claim_count"), _text("Sources", _list("video_ids")), _text("Stances", _list("stances")),
        _text("Repeated", "repeated_claim"), _text("Disagreement", "disagreement_point"), _text("Single source", "outlier_claim"), _text("Needs a person", "human_review_required"),
    )
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("group_id", part.alias("p")))), lambda x: x["p"]), "\n")
    return groups.groupBy("topic_id").agg(F.concat(F.lit("# Topic "), F.first("topic_id"), F.lit("\n\nNothing here says what is true.\n\n"), body).alias("markdown"))


def subset_markdown(groups: DataFrame, flag: str) -> DataFrame:
    """terrain_markdown() of the groups with a flag: repeated_claim, disagreement_point or outlier_claim."""
    return terrain_markdown(groups.where(flag))


def prompt(groups: DataFrame) -> DataFrame:
    """topic_id, prompt: what to ask a strong model about a topic, on the terrain alone."""
    asked = "Describe which positions recur, which collide and which stand alone. Cite group ids. Don't judge truth and add no outside knowledge.\n\n"
    return terrain_markdown(groups).select("topic_id", F.concat(F.lit(asked), "markdown").alias("prompt"))


def worth_markdown(decisions: DataFrame) -> DataFrame:
    """video_id, markdown of decisions()."""
    return decisions.select("video_id", F.concat(
        F.lit("# "), F.coalesce("title", "video_id"), F.lit("\n\n"), _text("Worth analysing", "analysis_worth"), _text("Reasons", _list("why_analyze")), _text("Stop reasons", _list("skip_or_stop_reasons")), _text("Route", "recommended_route"),
        _text("Next cost", "estimated_next_cost"), _text("Next step", "recommended_next_action"), _text("Duplicate ratio", "duplicate_ratio"), _text("Weak claims", _list("weak_claim_ids")),
    ).alias("markdown"))


def hesitation_markdown(rows: DataFrame) -> DataFrame:
    """claim_id, markdown of hesitation(): cues to listen to, not a score."""
    return rows.select("claim_id", F.concat(F.lit("## "), "claim_id", F.lit("\n"), _text("Marker", "marker"), _text("Words", "word_count"), _text("Pauses", "pause_count"), _text("Fillers", "filler_count"), _text("Restarts", "restart_count"), F.lit("\nListen before judging.\n")).alias("markdown"))
