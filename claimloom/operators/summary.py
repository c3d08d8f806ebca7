"""Main summaries: a score for every claim, the best one as the line, and rows of key information."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import text as tx

NO_CLAIM = "(no claims extracted)"
FILLERS = ("네", "어", "음", "자")


def score(text: Column, claim_id: Column, content_type: Column, confidence: Column, time_ref: Column, is_aside: Column, genre: Column) -> Column:
    """How well a claim would stand for its video; -1000 for a blank one."""
    line = lambda t: F.struct(t.alias("t"), F.lower(t).alias("low"), F.regexp_extract_all(F.lower(t), F.lit("([0-9A-Za-z가-힣]+)"), 1).alias("tokens"))
    parts = lx.bound(tx.squeeze(F.coalesce(text, F.lit(""))), line)
    return lx.bound(parts, lambda p: _score(p["t"], p["low"], p["tokens"], claim_id, content_type, confidence, time_ref, is_aside, genre))


def _score(t: Column, low: Column, tokens: Column, claim_id: Column, content_type: Column, confidence: Column, time_ref: Column, is_aside: Column, genre: Column) -> Column:
    n = F.length(t)
    give = lambda cond, x: F.when(cond, F.lit(float(x))).otherwise(F.lit(0.0))
    kind = F.coalesce(content_type, F.lit(""))
    by_genre = lambda lexicon, f, none: _by_genre(genre, lexicon, f, none)
    fillers = F.size(F.filter(tokens, lambda x: F.array_contains(lx.array(FILLERS), x)))
    length = (
        F.when((n >= 45) & (n <= 170), F.lit(16.0)).when((n >= 28) & (n < 45), F.lit(7.0)).when((n > 170) & (n <= 230), F.lit(3.0))
        .when(n > 230, -(12 + (n - 230) / 18)).otherwise(F.lit(-8.0))
    )
    total = (
        give(is_aside, -18) + give((kind != "") & (kind != "other"), 4)
        + by_genre("preferred", lambda m: give(kind.isin(m), 5), F.lit(0.0)) + by_genre("demoted", lambda m: give(kind.isin(m), -10), F.lit(0.0))
        + by_genre("keyword", lambda m: F.least(F.lit(10.0), F.size(F.filter(lx.array([x.lower() for x in m]), lambda x: F.contains(low, x))) * 3.0), F.lit(0.0))
        + F.when(confidence == "high", 8.0).when(confidence == "medium", 4.0).otherwise(0.0) + give(F.coalesce(time_ref, F.lit("")) != "", 2) + length
        + F.greatest(F.lit(0.0), F.lit(11.0) - (tx.claim_number(claim_id) - 1) * 0.45)
        - tx.repeats(tokens) * 7.0
        - F.size(F.filter(lx.array(lx.markers("summary", "noise")), lambda m: F.contains(low, m))) * 8.0
        - F.size(F.filter(lx.array(lx.markers("summary", "low_signal")), lambda m: F.contains(t, m))) * 16.0
        + give(F.exists(lx.array(lx.markers("summary", "weak_start")), lambda m: F.startswith(t, m)), -6)
        + give(F.exists(lx.array(lx.markers("summary", "weak_end")), lambda m: F.endswith(t, m)), -5)
        - F.when(fillers >= 3, fillers * 2.0).otherwise(0.0)
        + give(~t.rlike(r"[\p{L}\p{N}]"), -25)
    )
    return F.when(t == "", F.lit(-1000.0)).otherwise(total)


def _by_genre(genre: Column, lexicon: str, make, none: Column) -> Column:
    out = F.when(F.lit(False), none)
    for g in sorted({r[2] for r in lx.rows() if r[1] == lexicon}):
        out = out.when(genre == g, make(lx.markers(lexicon, g)))
    return out.otherwise(none)


def scored(claims: DataFrame, genres: DataFrame) -> DataFrame:
    """claims with summary_score; genres: video_id, genre (its name)."""
    rows = claims.join(genres.select("video_id", F.col("genre").alias("_g")), "video_id", "left")
    s = score(F.col("text"), F.col("claim_id"), F.col("content_type"), F.col("confidence"), F.col("time_ref"), F.col("aside_type") != "none", F.coalesce("_g", F.lit("")))
    return rows.withColumn("summary_score", s).drop("_g")


def one_line(scored_claims: DataFrame) -> DataFrame:
    """video_id, one_line: the best main claim, or if all are asides the best of these; the first of equal ones."""
    best = F.max_by("text", F.struct((F.col("aside_type") == "none").cast("int"), "summary_score", -F.col("claim_ord")))
    return scored_claims.groupBy("video_id").agg(tx.clip(best).alias("one_line"), F.count_if(F.col("aside_type") == "none").alias("main_claim_count"), F.count_if(F.col("aside_type") != "none").alias("aside_claim_count"))


def key_information(claims: DataFrame, limit: int = 12) -> DataFrame:
    """video_id, info_id, label, content, time_ref, source_claim_id, confidence: typed main claims, sure ones first."""
    at = Window.partitionBy("video_id").orderBy(F.desc(F.col("confidence") == "high"), "claim_ord")
    rows = claims.where("aside_type = 'none' and content_type <> 'other' and confidence in ('high', 'medium')").withColumn("_n", F.row_number().over(at)).where(F.col("_n") <= limit)
    return rows.select("video_id", F.format_string("K%03d", "_n").alias("info_id"), F.col("content_type").alias("label"), F.col("text").alias("content"), "time_ref", F.col("claim_id").alias("source_claim_id"), "confidence")
