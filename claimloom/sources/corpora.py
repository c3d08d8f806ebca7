"""The driver's tables as the inputs of this library: segments, cues, words, lines, payloads.

Conversations are videos, their turns segments and their roles speakers; each turn ends with a sentence of SEEDS, chosen by
its numbers, so that lexicons find something in invented prose. A conversation is a topic as well, with a source for each role.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..plans.lineage import spread

SEEDS = (
    "The vendor says it can cut water use, and a case study claims twenty percent savings.",
    "However, the probe may drift, so maintenance was left out of the price.",
    "It might be the soil, not the software, that explains the yield.",
    "Our policy adoption plan has a deadline and a subsidy this month.",
    "Doctors recommend this treatment; the dosage is guaranteed to lower cholesterol.",
    "Between you and me, the real reason was never on record.",
    "I think, um, uh, maybe we could try another idea?",
    "According to research the central bank moved the interest rate today.",
    "First install the package. Then open the dashboard on the screen and run the code.",
    "This affiliate video is sponsored, and everyone says the viral claim is true.",
    "오늘 정책 발표가 있었다 그리고 금리는 그대로다.",
    "이번 회의의 주요 내용을 정리했다 다음은 예산이다.",
    "솔직히 말하면 현장에서 들은 이야기다.",
    "Just a plain remark about nothing much.",
    "In this music video the lyrics are a highlight.",
    "I remember, back in school I bought shares, and the market will rise.",
    "Water sensors improve yield; the brochure says savings of 20 per cent.",
)


#: Claims of few words in common form, for and against the same things.
DEBATES = (
    "The vendor says sensor probes can cut water use by twenty percent.",
    "However, sensor probes drift and cut water use by ten percent only.",
    "Sensor probes might cut water use where the soil is dry.",
    "A case study claims that sensor probes always cut water use.",
    "The ministry claims the subsidy policy is proven to improve adoption.",
    "However, a subsidy policy without maintenance does not prove adoption.",
    "It may be the weather, and not the subsidy policy, behind adoption.",
    "Just a plain remark about nothing much.",
    "",
)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def seeded(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text: conversations, each turn with its seed sentence."""
    at = (F.pmod(F.col("conv_id") * 7 + F.col("turn"), F.lit(len(SEEDS))) + 1).cast("int")
    seed = F.element_at(F.array(*map(F.lit, SEEDS)), at)
    return spread(conversations, "conv_id").select("conv_id", "turn", "role", F.concat(F.coalesce("text", F.lit("")), F.lit(" "), seed).alias("text"))


def segments(conversations: DataFrame) -> DataFrame:
    s = seeded(conversations)
    fixed = lambda c: F.lit("transcript").alias(c)
    return s.select(F.concat(F.lit("v"), F.col("conv_id").cast("string")).alias("video_id"), F.col("turn").cast("int").alias("seg_ord"), "text", F.col("role").alias("speaker"), tx.clock(F.col("turn") * 6).alias("time_ref"), fixed("source_hint"), fixed("modality_source"))


def videos(conversations: DataFrame) -> DataFrame:
    n = F.col("conv_id").cast("string")
    return conversations.select("conv_id").distinct().select(F.concat(F.lit("v"), n).alias("video_id"), F.concat(F.lit("Conversation "), n).alias("title"), F.lit("en").alias("language"), F.lit("1").alias("schema_version"))


def topic_segments(conversations: DataFrame) -> DataFrame:
    """topic_id, and segments with one source for each role of a conversation."""
    return _topics(seeded(conversations))


def debate_segments(conversations: DataFrame) -> DataFrame:
    """As topic_segments, but of each turn's claim of DEBATES alone."""
    at = (F.pmod(F.col("conv_id") * 5 + F.col("turn") * 2, F.lit(len(DEBATES))) + 1).cast("int")
    return _topics(conversations.select("conv_id", "turn", "role", F.element_at(F.array(*map(F.lit, DEBATES)), at).alias("text")))


def _topics(turns: DataFrame) -> DataFrame:
    t = F.concat(F.lit("t"), F.col("conv_id").cast("string"))
    return turns.select(t.alias("topic_id"), F.concat(t, F.lit("-"), F.coalesce("role", F.lit("unknown"))).alias("video_id"), F.col("turn").cast("int").alias("seg_ord"), "text", F.col("role").alias("speaker"), tx.clock(F.col("turn") * 6).alias("time_ref"), F.lit("transcript").alias("source_hint"), F.lit("transcript").alias("modality_source"))


def line_segments(documents: DataFrame) -> DataFrame:
    """video_id, seg_ord, text: the lines of documents."""
    return spread(documents.select("doc_id", "text"), "doc_id").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("video_id"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("seg_ord", "text"))


def benchmark_segments(benchmark: DataFrame) -> DataFrame:
    return line_segments(benchmark.select(F.col("item_id").alias("doc_id"), "text"))


def words(events: DataFrame) -> DataFrame:
    """A word for each event of a user, who is the claim; it lasts a hundredth of its value."""
    start = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    at = F.struct("ts", "event_id")
    rows = events.select(F.col("user_id").cast("string").alias("claim_id"), F.col("event_id").alias("word_ord"), F.col("event_type").alias("word"), start.alias("start"), (start + F.col("value") / 100).alias("end"), at.alias("_at"))
    return rows.drop("_at")


def payloads(conversations: DataFrame, claims: DataFrame) -> DataFrame:
    """What the report gate reads, of the videos' typed claims (classified())."""
    n = F.col("claim_ord")
    claim = F.struct(
        F.col("text").alias("claim"), F.when(F.col("evidence") == "inference", "fact").when(F.col("confidence") == "high", "opinion").otherwise("fact").alias("type"), "confidence",
        (n % 5 + 1).cast("string").alias("importance"), F.lit(False).alias("important"),
        F.when(n % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("E"), (n % 7).cast("string")))).alias("evidence_refs"),
        F.when(n % 2 == 0, F.col("time_ref")).alias("segment_id"), F.lit(None).cast("string").alias("timestamp"),
        F.when(n % 4 == 0, "risk").alias("risk_label"), F.array().cast("array<string>").alias("labels"),
        (F.contains(F.lower("text"), F.lit("screen"))).alias("requires_visual"), F.lit(False).alias("requires_audio"), F.lit(None).cast("string").alias("dependency"),
    )
    rows = claims.groupBy(F.col("video_id").alias("payload_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("claim_ord", claim.alias("c")))), lambda x: x["c"]).alias("claims"), F.min_by("text", "claim_ord").alias("summary"), F.max("seg_ord").alias("_last"))
    number = F.substring("payload_id", 2, 20).cast("bigint")
    ids = F.array(*(F.lit(f"E{i}") for i in range(6)))
    none = F.array().cast("array<string>")
    return rows.select(
        "payload_id", F.when(number % 3 == 0, "Finance_Economy").otherwise("other").alias("genre"), F.when(number % 5 == 0, "high").alias("risk_domain"),
        F.when(number % 2 == 0, 4000.0).otherwise(100.0).alias("duration_seconds"), (number % 4 == 0).alias("final_report_created"), F.when(number % 8 == 0, "fail").otherwise("pass").alias("quality_gate_status"),
        "summary", F.slice(ids, 1, 4).alias("known_evidence_ids"), F.slice(ids, 4, 3).alias("allowed_evidence_ids"), F.lit(False).alias("visual_needed"), (number % 7 == 0).alias("audio_needed"),
        none.alias("visual_artifacts"), none.alias("audio_artifacts"), F.array(F.struct(F.lit("0").alias("start"), (F.col("_last") * 6).cast("string").alias("end"))).alias("timeline"), "claims",
        F.array(F.struct(F.lit("Check").alias("title"), F.when(number % 2 == 0, "find the source").alias("goal"), F.when(number % 3 == 0, "source named").alias("acceptance_criteria"))).alias("tasks"),
    )
