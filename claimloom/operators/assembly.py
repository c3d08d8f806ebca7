"""Ordered assembly: cues into sentences by a running fold, and claims into a timeline by islands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

MAX_CHARS = 200
MAX_SPAN = 15.0

_STATE = "struct<units:array<struct<text:string,start:double,end:double,cues:array<int>>>,text:string,start:double,end:double,cues:array<int>,chars:int>"


def fold(cues: Column, max_chars: int = MAX_CHARS, max_span: float = MAX_SPAN) -> Column:
    """Units of an ordered array of struct(ord, text, start, end, final): text, start, end and cue numbers of each.

    A cue closes a unit when it ends a sentence, or the unit has reached max_chars, or its end is max_span seconds after the
    first start. Blank cues are passed over; the rest at the end is a unit, too.
    """
    nothing = F.lit(None).cast("double")
    empty = F.array().cast("array<int>")
    first = F.struct(F.array().cast("array<struct<text:string,start:double,end:double,cues:array<int>>>").alias("units"), F.lit("").alias("text"), nothing.alias("start"), nothing.alias("end"), empty.alias("cues"), F.lit(0).alias("chars"))

    def unit(s: dict) -> Column:
        return F.array(F.struct(s["text"].alias("text"), s["start"].alias("start"), s["end"].alias("end"), s["cues"].alias("cues")))

    def step(s: Column, c: Column) -> Column:
        piece = c["text"]
        new = F.size(s["cues"]) == 0
        now = {
            "text": F.when(new, piece).otherwise(F.concat(s["text"], F.lit(" "), piece)),
            "start": F.coalesce(s["start"], c["start"]),
            "end": F.coalesce(c["end"], s["end"]),
            "cues": F.concat(s["cues"], F.array(c["ord"])),
            "chars": s["chars"] + F.length(piece) + F.when(new, 0).otherwise(1),
        }
        close = c["final"] | (now["chars"] >= max_chars) | F.coalesce((c["end"] - now["start"]) >= max_span, F.lit(False))
        after = {"text": F.lit(""), "start": nothing, "end": nothing, "cues": empty, "chars": F.lit(0)}
        keep = F.struct(s["units"].alias("units"), *(now[k].alias(k) for k in now))
        done = F.struct(F.concat(s["units"], unit(now)).alias("units"), *(after[k].alias(k) for k in now))
        return F.when(piece == "", s).otherwise(F.when(close, done).otherwise(keep))

    def finish(s: Column) -> Column:
        return F.when(F.size(s["cues"]) > 0, F.concat(s["units"], unit({k: s[k] for k in ("text", "start", "end", "cues")}))).otherwise(s["units"])

    return F.aggregate(cues, first.cast(_STATE), lambda s, c: step(s, c).cast(_STATE), finish)


def sentences(cues: DataFrame, max_chars: int = MAX_CHARS, max_span: float = MAX_SPAN) -> DataFrame:
    """video_id, unit_ord, text, start, end, cue_indices, cue_count, span_seconds, is_merged of cues (video_id, cue_ord, text, start, end)."""
    piece = tx.squeeze(F.coalesce("text", F.lit("")))
    row = F.struct(F.col("cue_ord").cast("int").alias("ord"), piece.alias("text"), F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), tx.ends_sentence(piece).alias("final"))
    units = cues.select("video_id", row.alias("c")).groupBy("video_id").agg(fold(F.array_sort(F.collect_list("c")), max_chars, max_span).alias("u"))
    rows = units.select("video_id", F.posexplode("u").alias("unit_ord", "u")).select("video_id", "unit_ord", "u.text", "u.start", "u.end", F.col("u.cues").alias("cue_indices"))
    return rows.withColumns({"cue_count": F.size("cue_indices"), "span_seconds": F.greatest(F.lit(0.0), F.col("end") - F.col("start")), "is_merged": F.size("cue_indices") > 1}).withColumn("span_seconds", F.when(F.col("start").isNotNull() & F.col("end").isNotNull(), F.col("span_seconds")))


def segments_to_sentences(segments: DataFrame) -> DataFrame:
    """Segments merged into sentences; speaker and the rest come from the first cue, source_time_refs from all."""
    start = tx.cue_seconds(F.col("time_ref"))
    cues = segments.select("video_id", F.col("seg_ord").alias("cue_ord"), "text", start.alias("start"), start.alias("end"))
    units = sentences(cues).select("video_id", F.col("unit_ord").alias("seg_ord"), "text", "cue_indices")
    of = segments.select("video_id", F.col("seg_ord").alias("cue"), "speaker", "time_ref", "source_hint", "modality_source")
    rows = units.select("*", F.explode("cue_indices").alias("cue")).join(of, ["video_id", "cue"])
    first = lambda c: F.min_by(c, "cue").alias(c)
    refs = F.transform(F.array_sort(F.collect_list(F.struct("cue", F.col("time_ref").alias("t")))), lambda x: x["t"]).alias("source_time_refs")
    return rows.groupBy("video_id", "seg_ord", "text").agg(first("speaker"), first("time_ref"), first("source_hint"), first("modality_source"), refs)


def timeline(claims: DataFrame) -> DataFrame:
    """video_id, entry_ord, time_ref, speaker, text, main_ids, aside_ids: runs of claims of equal time and speaker."""
    at = Window.partitionBy("video_id").orderBy("claim_ord")
    new = F.when((F.row_number().over(at) > 1) & F.lag("time_ref").over(at).eqNullSafe(F.col("time_ref")) & F.lag("speaker").over(at).eqNullSafe(F.col("speaker")), 0).otherwise(1)
    rows = claims.withColumn("_new", new).withColumn("entry_ord", F.sum("_new").over(at))
    listed = lambda cond: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("claim_ord", F.col("claim_id").alias("x"))))), lambda r: r["x"])
    return rows.groupBy("video_id", "entry_ord", "time_ref", "speaker").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("claim_ord", "text"))), lambda r: r["text"]), " ").alias("text"),
        listed(F.col("aside_type") == "none").alias("main_ids"), listed(F.col("aside_type") != "none").alias("aside_ids"),
    )
