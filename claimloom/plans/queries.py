"""The library's queries over the driver's tables. Whole tables, whole texts; arrays come out joined, integers as bigint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import lexicon as lx
from ..functions import terms
from ..functions import text as tx
from ..operators import assembly, claims, cluster, gates, similarity, speech, summary, terrain, views, worth
from ..sources import corpora
from .lineage import saved

QUERIES: dict = {}


def query(f):
    def run(spark, sf_dir):
        return flat(f(lambda table: corpora.read(spark, sf_dir, table), spark))

    QUERIES[f.__name__] = run
    return run


def flat(df: DataFrame) -> DataFrame:
    """Scalar columns only: arrays joined by |, structs as JSON, integers as bigint."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), "|")
        elif isinstance(f.dataType, (T.StructType, T.MapType)):
            c = F.to_json(c)
        elif isinstance(f.dataType, T.IntegerType):
            c = c.cast("bigint")
        out.append(c.alias(f.name))
    return df.select(*out)


def _claims(read) -> DataFrame:
    return claims.classified(claims.split_claims(corpora.segments(read("conversations"))))


def _topics(read, segments=corpora.topic_segments) -> DataFrame:
    """Claim records of the topics, one claim a turn."""
    segs = segments(read("conversations"))
    rows = claims.records(claims.classified(claims.split_claims(segs, presplit=False)))
    return rows.withColumn("topic_ord", F.col("seg_ord"))


def _packages(read) -> DataFrame:
    return claims.packages(corpora.segments(read("conversations")), corpora.videos(read("conversations")))


def _grouped(read, method: str = "token_jaccard", threshold: float | None = 1.0, segments=corpora.topic_segments) -> DataFrame:
    """Topics' claims in groups of equal token sets, which SQL can form as well; or by a method's own threshold."""
    rows = saved(_topics(read, segments))
    return saved(terrain.members(rows, cluster.clusters(rows, method, threshold)))


@query
def claim_tokens(read, spark):
    lines = corpora.line_segments(read("documents")).where("text <> ''").withColumn("_t", tx.terms(F.col("text"), F.lit("other"), "canonical", "group_key"))
    return lines.select("video_id", "seg_ord", F.col("_t.canonical").alias("canonical_text"), F.col("_t.group_key").alias("claim_group_key"), tx.group_label(F.col("_t.group_key")).alias("claim_group_label"))


@query
def sentence_split(read, spark):
    return claims.split_claims(corpora.line_segments(read("documents"))).select("video_id", "seg_ord", "claim_ord", "claim_id", "text")


@query
def token_df_topk(read, spark):
    """The 100 tokens that most lines hold."""
    return terms.line_counts(corpora.line_segments(read("documents"))).orderBy(F.desc("df"), "token").limit(100)


@query
def time_refs(read, spark):
    refs = read("conversations").select("conv_id", "turn", tx.clock(F.col("turn") * 606).alias("ref"))
    return refs.select("*", tx.clock_seconds(F.col("ref")).alias("seconds"), tx.cue_seconds(F.col("ref")).alias("cue_seconds"), tx.clock(F.col("turn") * 6, hours=True).alias("long_ref"))


@query
def lexicon_sizes(read, spark):
    return lx.table(spark).groupBy("lexicon", "label").agg(F.count("*").alias("markers"))


@query
def claim_axes(read, spark):
    return _claims(read).select("video_id", "claim_ord", "content_type", "content_markers", "evidence", "confidence", "evidence_markers")


@query
def aside_signals(read, spark):
    return _claims(read).select("video_id", "claim_ord", "aside_type", "aside_score", "aside_markers", "needs_audio_check")


@query
def ranked_asides(read, spark):
    return claims.ranked_asides(_claims(read)).select("video_id", "claim_id", "aside_rank", "aside_score")


@query
def genre_detect(read, spark):
    g = _packages(read)
    return g.select("video_id", "genre.genre", "genre.risk_domain", "genre.score", "genre.markers", "genre.basis", "genre.sections")


@query
def claim_records(read, spark):
    return _topics(read).select("claim_uid", "evidence_id", "stance", "support_role", "modality", "timestamp_start", "speaker_confidence", "canonical_text", "token_set", "coordinate", *(F.col(f"need_gates.{g}").alias(g) for g in claims.GATES))


@query
def evidence_records(read, spark):
    return claims.evidence_records(_topics(read)).drop("timestamp_end")


@query
def need_gate_summary(read, spark):
    return claims.need_gate_summary(_topics(read))


@query
def record_counts(read, spark):
    return claims.record_counts(_topics(read))


@query
def timeline(read, spark):
    return assembly.timeline(_claims(read))


@query
def key_information(read, spark):
    return summary.key_information(_claims(read))


@query
def one_line(read, spark):
    return summary.one_line(summary.scored(_claims(read), _packages(read).select("video_id", "genre.genre")))


@query
def summary_scores(read, spark):
    return summary.scored(_claims(read), _packages(read).select("video_id", "genre.genre")).select("video_id", "claim_ord", F.round("summary_score", 6).alias("summary_score"))


@query
def assembled_sentences(read, spark):
    lines = corpora.line_segments(read("documents"))
    at = (F.col("seg_ord") * 4).cast("double")
    return assembly.sentences(lines.select("video_id", F.col("seg_ord").alias("cue_ord"), "text", at.alias("start"), (at + 3).alias("end")))


@query
def segment_sentences(read, spark):
    return assembly.segments_to_sentences(corpora.segments(read("conversations")))


@query
def pause_events(read, spark):
    return speech.pauses(corpora.words(read("events")))


@query
def hesitation_markers(read, spark):
    return speech.hesitation(corpora.words(read("events")))


@query
def hesitation_counts(read, spark):
    return speech.marker_counts(speech.hesitation(corpora.words(read("events"))))


@query
def duplicate_report(read, spark):
    return similarity.duplicate_report(corpora.line_segments(read("documents")), corpora.benchmark_segments(read("benchmark")))


@query
def similar_turns(read, spark):
    """Pairs of different word sets of turns and of debated claims with a Jaccard of 0.3 or more."""
    turns = read("conversations").select("text").unionByName(corpora.debate_segments(read("conversations")).select("text"))
    sets = turns.select(F.array_sort(tx.words(F.col("text"))).alias("tokens")).distinct().where(F.size("tokens") > 0).withColumn("key", F.array_join("tokens", " "))
    pairs = similarity.jaccard_pairs(sets, None, 0.3)
    first, second = F.least("left_key", "right_key"), F.greatest("left_key", "right_key")
    return pairs.select(F.md5(first).alias("left_key"), F.md5(second).alias("right_key"), F.round("score", 6).alias("score"))


@query
def topic_similarity(read, spark):
    return similarity.topic_pairs(saved(_topics(read))).where("score >= 0.2").select("topic_id", "a", "b", "score")


@query
def source_trace(read, spark):
    return worth.source_trace(_claims(read))


@query
def worth_decision(read, spark):
    found = _claims(read)
    return worth.decisions(found, _packages(read), similarity.duplicate_report(found, corpora.benchmark_segments(read("benchmark")))).drop("genre", "language", "schema_version", "recommended_next_action")


@query
def package_validation(read, spark):
    heads = read("documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("video_id"), F.col("source").alias("title"), F.col("lang").alias("language"), F.lit(None).cast("string").alias("schema_version"))
    bodies = corpora.line_segments(read("documents")).withColumns({"claim_ord": F.col("seg_ord"), "claim_id": F.when(F.col("seg_ord") % 5 > 0, F.concat(F.lit("C"), (F.col("seg_ord") % 50).cast("string"))), "content_type": F.lit("other"), "evidence": F.when(F.length("text") % 2 == 0, "unclear").otherwise("fact"), "confidence": F.lit("low")})
    return gates.package_issues(heads, bodies).groupBy("video_id", "issue").agg(F.count("*").alias("n"))


@query
def leak_scan(read, spark):
    lines = corpora.line_segments(read("documents"))
    return gates.leaks(lines.select(F.col("video_id").alias("path"), (F.col("seg_ord") + 1).alias("line_no"), F.col("text").alias("line")), ["@example", "license"])


@query
def quality_issues(read, spark):
    return gates.payload_issues(corpora.payloads(read("conversations"), _claims(read))).drop("issue_ord")


@query
def quality_gate(read, spark):
    p = corpora.payloads(read("conversations"), _claims(read))
    return gates.gate(p, gates.payload_issues(p))


@query
def unknown_evidence_refs(read, spark):
    refs = read("lineitem").select(F.col("l_orderkey").cast("string").alias("video_id"), F.col("l_linenumber").cast("string").alias("claim_id"), F.array(F.col("l_partkey").cast("string"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string"))).alias("evidence_refs"))
    return gates.unknown_refs(refs, read("part").select(F.col("p_partkey").cast("string").alias("evidence_id")))


@query
def answer_guard(read, spark):
    rows = corpora.seeded(read("conversations")).select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("answer_id"), "text")
    return gates.answer_issues(rows)


@query
def tool_policy(read, spark):
    tools = F.array(F.lit("overlay.summary"), F.lit("overlay.write"), F.lit("fact_check"))
    kind = F.element_at(tools, (F.col("event_id") % 3 + 1).cast("int"))
    return gates.request_issues(read("events").select(F.col("event_id").alias("request_id"), kind.alias("tool"), F.array("event_type", kind).alias("words")))


@query
def overlay_validation(read, spark):
    return gates.overlay_issues(_overlays(read), ["@example"])


@query
def overlay_groups(read, spark):
    return views.overlay_groups(_overlays(read))


@query
def overlay_summary(read, spark):
    return views.overlay_summary(_overlays(read)).drop("policy", "limitations")


def _overlays(read) -> DataFrame:
    """An overlay for each customer's nation, with its customers' segments as groups."""
    rows = read("customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").cast("int").alias("n"))
    group = F.struct(
        F.col("c_mktsegment").alias("overlay_group_id"), F.concat(F.lit("G"), F.col("n").cast("string")).alias("source_group_id"), F.lit("segment").alias("split_axis"), F.col("n").alias("claim_count"),
        F.when(F.col("n") % 2 == 0, "not_evaluated").otherwise("true").alias("truth_status"), F.lit("not_performed").alias("fact_check_status"), F.lit(False).alias("allowed_for_model_answer"),
    )
    by = rows.groupBy(F.col("c_nationkey").alias("overlay_id")).agg(F.array_sort(F.collect_list(group)).alias("overlay_groups"))
    flags = F.map_from_arrays(lx.array(list(gates.FLAGS)), F.array(*(F.col("overlay_id") % 6 == i for i in range(6))))
    return by.select("overlay_id", F.lit(True).alias("ok"), F.when(F.col("overlay_id") % 2 == 0, "1").alias("schema_version"), F.lit("topic").alias("topic_id"), F.lit("ready").alias("overlay_status"), F.lit(4).alias("overlay_group_count"), "overlay_groups", F.slice(lx.array(list(gates.LIMITATIONS)), 1, 3).alias("limitations"), flags.alias("policy"))


@query
def clusters_normalized(read, spark):
    return cluster.clusters(saved(_topics(read)))


@query
def clusters_token_jaccard(read, spark):
    return cluster.clusters(saved(_topics(read)), "token_jaccard")


@query
def clusters_equal_tokens(read, spark):
    return cluster.clusters(saved(_topics(read)), "token_jaccard", 1.0)


@query
def claim_groups(read, spark):
    return terrain.claim_groups(_grouped(read), "token_jaccard").drop("_external", "cluster", "opened")


@query
def claim_groups_normalized(read, spark):
    return terrain.claim_groups(_grouped(read, "normalized", None)).drop("_external", "cluster", "opened")


@query
def disagreements(read, spark):
    return terrain.disagreements(terrain.claim_groups(_grouped(read, "normalized", None)))


@query
def outliers(read, spark):
    return terrain.outliers(terrain.claim_groups(_grouped(read), "token_jaccard"))


@query
def contradictions(read, spark):
    rows = _grouped(read, "normalized", None)
    return terrain.contradictions(rows, terrain.claim_groups(rows))


@query
def opinion_groups(read, spark):
    return terrain.opinion_groups(terrain.claim_groups(_grouped(read), "token_jaccard"))


@query
def opinion_warnings(read, spark):
    return terrain.opinion_warnings(terrain.claim_groups(_grouped(read), "token_jaccard"))


@query
def stance_groups(read, spark):
    return terrain.stance_groups(_topics(read))


@query
def topic_summary(read, spark):
    rows = _grouped(read)
    return views.topic_summary(rows, terrain.claim_groups(rows, "token_jaccard"))


@query
def group_detail(read, spark):
    rows = _grouped(read)
    return views.group_detail(terrain.claim_groups(rows, "token_jaccard"), rows).drop("need_gates")


def _checks(read) -> DataFrame:
    """Each benchmark item must be with itself, and must not be with the next one."""
    items = read("benchmark").select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = items.select(F.lit("b").alias("topic_id"), F.concat(F.lit("b:"), F.col("item_id").cast("string")).alias("claim_uid"), F.col("item_id").alias("topic_ord"), tx.terms(F.col("text"), F.lit("other"), "canonical", "token_set").alias("_t"))
    rows = rows.select("topic_id", "claim_uid", "topic_ord", F.col("_t.canonical").alias("canonical_text"), F.col("_t.token_set").alias("token_set"))
    same = items.select(F.lit("must_link").alias("kind"), F.col("item_id").alias("pair_ord"), F.col("text").alias("left_text"), F.upper("text").alias("right_text"))
    after = items.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("right_text"))
    other = items.join(after, "item_id").select(F.lit("cannot_link").alias("kind"), F.col("item_id").alias("pair_ord"), F.col("text").alias("left_text"), "right_text")
    return terrain.pair_checks(same.unionByName(other), rows, cluster.clusters(rows, "token_jaccard", 1.0))


@query
def pair_checks(read, spark):
    return _checks(read).select("kind", "pair_ord", "left_uid", "right_uid", "ok")


@query
def pair_agreement(read, spark):
    return terrain.pair_agreement(_checks(read))
