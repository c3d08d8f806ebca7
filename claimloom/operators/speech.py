"""Hesitation in word timings: pauses, fillers, restarts, and the label that they give.

Words: claim_id, word_ord, word, start, end (seconds, or null). Times that aren't numbers count as missing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import text as tx

PAUSE = 0.7
MIN_WORDS = 4


def timed(words: DataFrame) -> DataFrame:
    """Words with both times as numbers, and their place in the order of time."""
    rows = words.withColumns({"start": F.col("start").try_cast("double"), "end": F.col("end").try_cast("double")}).where("start is not null and end is not null")
    return rows.withColumn("index", F.row_number().over(Window.partitionBy("claim_id").orderBy("start", "end", "word_ord")) - 1)


def pauses(words: DataFrame, least: float = PAUSE) -> DataFrame:
    """claim_id, after_word_index, gap_seconds, at_seconds, next_word: silences between two words, never at the ends."""
    at = Window.partitionBy("claim_id").orderBy("start", "end", "word_ord")
    rows = timed(words).withColumns({"_next": F.lead("start").over(at), "next_word": F.coalesce(F.lead("word").over(at), F.lit(""))})
    gap = F.col("_next") - F.col("end")
    return rows.where(gap >= least).select("claim_id", F.col("index").alias("after_word_index"), F.round(gap, 3).alias("gap_seconds"), F.round("end", 3).alias("at_seconds"), "next_word")


def hesitation(words: DataFrame, least: float = PAUSE) -> DataFrame:
    """A row a claim: word_count, speech_span_s, pause_count, filler_count, restart_count, hesitation_score (always null), marker."""
    at = Window.partitionBy("claim_id").orderBy("word_ord")
    rows = words.withColumn("_t", tx.edge_trim(F.col("word"))).withColumn("_again", tx.restarts(F.col("_t"), F.lead("_t").over(at)))
    counts = rows.groupBy("claim_id").agg(F.count("*").alias("word_count"), F.count_if(F.col("_t").isin(lx.markers("filler"))).alias("filler_count"), F.count_if("_again").alias("restart_count"))
    by = F.struct("start", "end", "word_ord")
    span = timed(words).groupBy("claim_id").agg(F.round(F.max_by("end", by) - F.min_by("start", by), 3).alias("speech_span_s"))
    silent = pauses(words, least).groupBy("claim_id").agg(F.count("*").alias("pause_count"))
    rows = counts.join(span, "claim_id", "left").join(silent, "claim_id", "left").withColumn("pause_count", F.coalesce("pause_count", F.lit(0)))
    heard = (F.col("pause_count") >= 1) | (F.col("filler_count") >= 2) | (F.col("restart_count") >= 1)
    marker = F.when(F.col("word_count") < MIN_WORDS, "insufficient_words").when(heard, "hesitation_candidate").otherwise("no_hesitation_detected")
    return rows.select("claim_id", "word_count", "speech_span_s", "pause_count", "filler_count", "restart_count", F.lit(None).cast("double").alias("hesitation_score"), marker.alias("marker"))


def marker_counts(rows: DataFrame) -> DataFrame:
    """One row: claims, and how many have which marker."""
    return rows.agg(F.count("*").alias("claim_count"), F.count_if(F.col("marker") == "hesitation_candidate").alias("candidate_count"), F.count_if(F.col("marker") == "insufficient_words").alias("insufficient_count"))
