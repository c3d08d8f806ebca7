"""Whether a video is worth more analysis: duplicates, risks, a decision with its reasons, and the route that follows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as lx

REASONS = ("high_value_claim_types", "residual_or_uncertainty_candidates", "weak_or_unclear_evidence", "high_risk_genre", "time_sensitive_claims", "promotional_or_hype_noise", "low_quality_or_uncertain_information")
DUPLICATE_RATIO = 0.6
ROUTES = {
    "skip_expensive_analysis": ("none", "keep the caption-first package unless an operator lifts the hard stop"),
    "needs_source_verification": ("medium", "verify bounded claims of high value or risk; search the web only for an approved list of claims"),
    "caption_first_with_caution": ("low_to_medium", "keep labels of promotion and uncertainty; escalate only claims with times and clear gaps in evidence"),
    "compact_strong_model_review": ("low_to_medium", "make a compact evidence packet before any multimodal review"),
    "caption_first_only": ("low", "summarise or archive without costly audio or image analysis unless there is a new question"),
}


def weak(evidence: Column, confidence: Column) -> Column:
    return F.coalesce(evidence.isin("unclear", "inference") | (confidence == "low"), F.lit(False))


def residual(aside_type: Column, aside_score: Column) -> Column:
    return (F.coalesce(aside_type, F.lit("none")) != "none") | (F.coalesce(aside_score, F.lit(0)) > 0)


def source_trace(claims: DataFrame, limit: int = 5) -> DataFrame:
    """The first claims of each video, clipped to 500 characters."""
    at = Window.partitionBy("video_id").orderBy("claim_ord")
    rows = claims.withColumn("trace_ord", F.row_number().over(at)).where(F.col("trace_ord") <= limit)
    return rows.select("video_id", "trace_ord", "claim_id", "time_ref", F.coalesce("evidence", F.lit("unclear")).alias("evidence"), F.coalesce("confidence", F.lit("low")).alias("confidence"), F.coalesce("content_type", F.lit("other")).alias("claim_type"), F.left(F.coalesce("text", F.lit("")), F.lit(500)).alias("excerpt"))


def blobs(claims: DataFrame, videos: DataFrame) -> DataFrame:
    """videos (video_id, title, ...) with blob, the lower-case title and claims, and what their claims add up to."""
    ordered = F.array_sort(F.collect_list(F.struct("claim_ord", F.coalesce("text", F.lit("")).alias("t"), F.when(weak(F.col("evidence"), F.col("confidence")), F.col("claim_id")).alias("w"))))
    high = F.coalesce(F.col("content_type").isin(lx.markers("worth", "high_value_type")), F.lit(False))
    sums = claims.groupBy("video_id").agg(ordered.alias("_c"), F.bool_or(high).alias("high_value"), F.bool_or(residual(F.col("aside_type"), F.col("aside_score"))).alias("residual"))
    rows = videos.join(sums, "video_id", "left")
    texts = F.array_join(F.transform("_c", lambda x: x["t"]), " ")
    ids = F.filter(F.transform("_c", lambda x: x["w"]), lambda w: F.coalesce(w, F.lit("")) != "")
    return rows.withColumns({
        "blob": F.lower(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce(texts, F.lit("")))),
        "weak_claim_ids": F.coalesce(ids, lx.array([])), "high_value": F.coalesce("high_value", F.lit(False)), "residual": F.coalesce("residual", F.lit(False)),
    }).drop("_c")


def decisions(claims: DataFrame, videos: DataFrame, duplicates: DataFrame | None = None) -> DataFrame:
    """A row a video (video_id, title, genre struct): decision, reasons, cost tier, route and information risks.

    duplicates: a duplicate_report; without one nothing counts as a duplicate. Videos without claims are decided on their titles.
    """
    rows = blobs(claims, videos)
    if duplicates is not None:
        rows = rows.join(duplicates, "video_id", "left")
    else:
        rows = rows.withColumns({"claim_count": F.lit(0), "likely_duplicate_claim_count": F.lit(0), "duplicate_ratio": F.lit(0.0)})
    b = F.col("blob")
    found = lambda label: F.filter(lx.array(sorted(lx.markers("worth", label))), lambda m: F.contains(b, m))
    rows = rows.withColumns({"promotional_markers": found("promotional"), "low_quality_markers": found("low_quality"), "_risky": F.coalesce(F.col("genre.genre").isin(lx.markers("worth", "high_risk_genre")), F.lit(False))})
    skips = F.array_compact(F.array(
        F.when(lx.any_of(b, lx.markers("worth", "entertainment")) & ~F.col("high_value"), "commodity_entertainment_or_music"),
        F.when((F.coalesce("duplicate_ratio", F.lit(0.0)) >= DUPLICATE_RATIO) & (F.coalesce("claim_count", F.lit(0)) >= 2), "local_duplicate_heavy"),
    ))
    holds = (F.col("high_value"), F.col("residual"), F.size("weak_claim_ids") > 0, F.col("_risky"), lx.any_of(b, lx.markers("worth", "time_sensitive")), F.size("promotional_markers") > 0, F.size("low_quality_markers") > 0)
    rows = rows.withColumns({"skip_or_stop_reasons": skips, "why_analyze": F.array_compact(F.array(*(F.when(c, r) for c, r in zip(holds, REASONS))))})
    stop = F.size("skip_or_stop_reasons") > 0
    yes = F.col("high_value") | F.col("residual") | F.col("_risky")
    rows = rows.withColumns({"analysis_worth": F.when(stop, "no").when(yes, "yes").otherwise("maybe"), "max_cost_tier": F.when(stop, "none").when(yes, "medium_need_gated").otherwise("caption_first_only")})
    why = lambda *r: F.exists("why_analyze", lambda x: x.isin(*r))
    route = (
        F.when(stop, "skip_expensive_analysis").when(why("time_sensitive_claims", "high_risk_genre"), "needs_source_verification")
        .when(why("promotional_or_hype_noise", "low_quality_or_uncertain_information"), "caption_first_with_caution")
        .when(F.col("analysis_worth") == "yes", "compact_strong_model_review").otherwise("caption_first_only")
    )
    rows = rows.withColumn("recommended_route", route)
    pick = lambda i: F.element_at(F.create_map(*(F.lit(x) for k, v in ROUTES.items() for x in (k, v[i]))), F.col("recommended_route"))
    return rows.withColumns({"estimated_next_cost": pick(0), "recommended_next_action": pick(1), "auto_skip_candidate": stop}).drop("_risky", "blob")
