"""What clusters of claims say across sources: groups, repetition, disagreement, outliers, contradictions, positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import terms
from ..functions import text as tx
from ..plans.lineage import saved
from . import similarity

AXES = ("supporting", "challenging", "alternative", "reported")
AXIS_LABEL = ("Supporting / promotional position", "Challenging / limiting position", "Alternative-explanation position", "Reported / contextual position")
PROMOTES, DOUBTS, SUPPOSES = "claim_or_promotion", "caution_or_counterpoint", "hypothesis_or_alternative"


def numbered(prefix: str, n: Column) -> Column:
    """The prefix and a number of four digits or more."""
    s = n.cast("string")
    return F.concat(F.lit(prefix), F.lpad(s, F.greatest(F.lit(4), F.length(s)), F.lit("0")))


def members(claims: DataFrame, clusters: DataFrame) -> DataFrame:
    """Claim records (topic_id, claim_uid, ...) with their cluster and the time at which it was opened."""
    opened = clusters.groupBy("topic_id", "cluster").agg(F.min("topic_ord").alias("opened"))
    return claims.join(clusters.drop("topic_ord"), ["topic_id", "claim_uid"]).join(opened, ["topic_id", "cluster"])


def mean_scores(rows: DataFrame, method: str = "normalized") -> DataFrame:
    """topic_id, cluster, grouping_score: the mean over all pairs of members, 1 for a single one.

    Pairs without a common token score 0 and needn't be formed (two empty sets score 1 by token_jaccard), nor those of equal sets, which score 1.
    """
    many = rows.groupBy("topic_id", "cluster").agg(F.count("*").alias("_n"))
    kinds = saved(rows.join(many.where("_n > 1").select("topic_id", "cluster"), ["topic_id", "cluster"]).groupBy("topic_id", "cluster", F.array_sort("token_set").alias("token_set")).agg(F.count("*").alias("_c"), F.min("claim_uid").alias("claim_uid")))
    keyed = kinds.withColumn("_k", F.to_json(F.struct("topic_id", "cluster")))
    one = F.col("_c") * (F.col("_c") - 1) / 2
    equal = F.when((F.size("token_set") > 0) | F.lit(method == "token_jaccard"), one).otherwise(0.0)
    sizes = keyed.groupBy("topic_id", "cluster", "_k").agg(F.sum("_c").alias("_n"), F.count("*").alias("_kinds"), F.sum(equal).alias("_equal"))
    sets = keyed.join(sizes.where("_kinds > 1").select("_k"), "_k").withColumn("topic_ord", F.row_number().over(Window.partitionBy("_k").orderBy("claim_uid")))
    pairs = similarity.topic_pairs(saved(sets.select(F.col("_k").alias("topic_id"), "claim_uid", "topic_ord", "token_set")), method)
    side = lambda x: keyed.select(F.col("_k").alias("topic_id"), F.col("claim_uid").alias(x), F.col("_c").alias(f"{x}_c"))
    sums = pairs.join(side("a"), ["topic_id", "a"]).join(side("b"), ["topic_id", "b"]).groupBy(F.col("topic_id").alias("_k")).agg(F.sum(F.col("score") * F.col("a_c") * F.col("b_c")).alias("_s"))
    mean = (F.coalesce("_s", F.lit(0.0)) + F.col("_equal")) / (F.col("_n") * (F.col("_n") - 1) / 2)
    means = sizes.join(sums, "_k", "left").select("topic_id", "cluster", F.round(mean, 4).alias("grouping_score"))
    return many.select("topic_id", "cluster").join(means, ["topic_id", "cluster"], "left").withColumn("grouping_score", F.coalesce("grouping_score", F.lit(1.0)))


def claim_groups(rows: DataFrame, method: str = "normalized") -> DataFrame:
    """One row a group, of members() (topic_id, video_id, claim_uid, topic_ord, stance, support_role, speaker, evidence_id, ...).

    claim_group_key: the four tokens that most members have.
    """
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("topic_ord", F.col(c).alias("x")))), lambda r: r["x"])
    sets = F.collect_list(F.split("canonical_text", " "))
    agg = rows.groupBy("topic_id", "cluster", "opened").agg(
        F.sort_array(F.collect_set("video_id")).alias("video_ids"), F.count("*").alias("claim_count"),
        F.sort_array(F.collect_set("stance")).alias("stances"), F.sort_array(F.collect_set("support_role")).alias("support_roles"),
        listed("claim_uid").alias("claim_uids"), F.min_by("claim_uid", "topic_ord").alias("representative_claim_uid"),
        F.sort_array(F.collect_set("evidence_id")).alias("evidence_ids"), F.size(F.collect_set(F.coalesce("speaker", F.lit("unknown-speaker")))).cast("bigint").alias("speaker_count"),
        F.bool_or(F.col("need_gates.external_verification") == "needed").alias("_external"),
        F.filter(F.sort_array(F.reduce(sets, F.first("tokens"), lambda a, b: F.array_intersect(a, b))), lambda x: x != "").alias("_shared"), F.flatten(F.collect_list("token_set")).alias("_all"),
    )
    keyed = agg.withColumn("claim_group_key", F.coalesce(terms.most_held(F.col("_all")), F.lit("generic_claim"))).drop("_all")
    found = keyed.join(mean_scores(rows, method), ["topic_id", "cluster"])
    has = lambda s: F.array_contains("stances", s)
    n, videos = F.row_number().over(Window.partitionBy("topic_id").orderBy("claim_group_key", "opened")), F.size("video_ids")
    found = found.withColumns({
        "group_id": numbered("G", n), "label": tx.group_label(F.col("claim_group_key")), "video_count": videos,
        "repeated_claim": videos >= 2, "outlier_claim": videos == 1, "disagreement_point": has(PROMOTES) & (has(DOUBTS) | has(SUPPOSES)),
        "shared_tokens": F.when(F.col("claim_count") >= 2, F.array_distinct(F.slice(F.array_distinct("_shared"), 1, 8))).otherwise(F.array().cast("array<string>")),
    })
    return found.withColumns({
        "summary": F.concat("label", F.lit(": "), F.col("claim_count").cast("string"), F.lit(" claim(s) across "), F.col("video_count").cast("string"), F.lit(" video(s).")),
        "grouping_confidence": F.when((F.col("grouping_score") >= 0.62) & F.col("repeated_claim"), "high").when(F.col("repeated_claim") | (F.col("grouping_score") >= 0.20), "medium").otherwise("low"),
        "human_review_required": F.col("disagreement_point") | F.col("outlier_claim"),
        "axis": axis(F.col("support_roles")),
    }).drop("_shared")


def axis(roles: Column) -> Column:
    """The first position, in declared order, that a group's roles hold."""
    has = lambda r: F.array_contains(roles, r)
    return F.when(has("supporting_or_promotional"), AXES[0]).when(has("challenging_or_limiting"), AXES[1]).when(has("alternative_explanation"), AXES[2]).otherwise(AXES[3])


def disagreements(groups: DataFrame) -> DataFrame:
    """Groups that promote and doubt at once: relation_id, relation_type, claim_uids, confidence."""
    only = F.array_contains("stances", SUPPOSES) & ~F.array_contains("stances", DOUBTS)
    return groups.where("disagreement_point").select(
        "topic_id", F.concat(F.lit("D"), F.substring("group_id", 2, 20)).alias("relation_id"), F.col("group_id").alias("claim_group_id"),
        F.when(only, "alternative_explanation").otherwise("support_vs_caution").alias("relation_type"), "claim_uids",
        F.when(F.col("claim_count") >= 2, "medium").otherwise("low").alias("confidence"), F.lit(True).alias("human_review_required"),
    )


def outliers(groups: DataFrame) -> DataFrame:
    """Groups of a single source."""
    return groups.where("outlier_claim").select("topic_id", F.col("group_id").alias("claim_group_id"), F.lit("single_source_outlier").alias("outlier_type"), "claim_uids", F.when(F.col("_external"), "medium").otherwise("low").alias("followup_priority"))


def contradictions(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """topic_id, claim_group_id, left_claim_uid, right_claim_uid, opposition_score: pairs of members that oppose each other."""
    keyed = rows.select(F.to_json(F.struct("topic_id", "cluster")).alias("_k"), "claim_uid", "topic_ord", "token_set", "text", "stance")
    pairs = similarity.topic_pairs(keyed.withColumnRenamed("_k", "topic_id")).where(F.col("score") >= 0.22)
    side = lambda x: keyed.select(F.col("_k").alias("topic_id"), F.col("claim_uid").alias(x), F.col("text").alias(f"{x}_text"), F.col("stance").alias(f"{x}_stance"))
    both = pairs.join(side("a"), ["topic_id", "a"]).join(side("b"), ["topic_id", "b"])
    scored = both.withColumn("opposition_score", similarity.opposition(*(F.col(c) for c in ("score", "a_text", "b_text", "a_stance", "b_stance")))).where("opposition_score >= 0.45")
    of = groups.select(F.to_json(F.struct("topic_id", "cluster")).alias("_k"), F.col("topic_id").alias("_topic"), F.col("group_id").alias("claim_group_id"))
    return scored.join(of, F.col("topic_id") == F.col("_k")).select(F.col("_topic").alias("topic_id"), "claim_group_id", F.col("a").alias("left_claim_uid"), F.col("b").alias("right_claim_uid"), "opposition_score")


def _buckets(groups: DataFrame) -> DataFrame:
    at = F.array_position(F.array(*map(F.lit, AXES)), F.col("axis"))
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("group_id", F.col(c).alias("x")))), lambda r: r["x"])
    return groups.withColumn("_at", at).groupBy("topic_id", "axis", "_at").agg(
        F.sort_array(F.collect_list("group_id")).alias("member_claim_group_ids"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("video_ids")))).alias("source_video_ids"),
        ordered("representative_claim_uid").alias("distinguishing_claims"), F.bool_or("disagreement_point").alias("contains_disagreement_point"),
    )


def opinion_groups(groups: DataFrame, allow_single_video: bool = False) -> DataFrame:
    """Positions that several sources hold, numbered in the axes' order within each topic."""
    kept = _buckets(groups) if allow_single_video else _buckets(groups).where(F.size("source_video_ids") >= 2)
    label = F.element_at(F.array(*map(F.lit, AXIS_LABEL)), F.col("_at").cast("int"))
    n = F.row_number().over(Window.partitionBy("topic_id").orderBy("_at"))
    return kept.select("topic_id", numbered("OG", n).alias("opinion_group_id"), "axis", label.alias("label"), "member_claim_group_ids", "source_video_ids", "distinguishing_claims", "contains_disagreement_point", F.when(F.size("source_video_ids") >= 2, "medium").otherwise("low").alias("confidence"), F.lit("not_evaluated").alias("truth_status"))


def opinion_warnings(groups: DataFrame) -> DataFrame:
    """topic_id, warning: positions passed over for a single source, and topics left without any."""
    small = _buckets(groups).withColumn("_small", F.size("source_video_ids") < 2)
    passed = small.where("_small").select("topic_id", F.concat(F.lit("opinion_group_skipped_single_source:"), "axis").alias("warning"))
    none = small.groupBy("topic_id").agg(F.bool_and("_small").alias("_none")).where("_none").select("topic_id", F.lit("opinion_group_builder_produced_no_groups").alias("warning"))
    return passed.unionByName(none)


def stance_groups(claims: DataFrame) -> DataFrame:
    """topic_id, stance, claim_uids in order."""
    return claims.groupBy("topic_id", "stance").agg(F.transform(F.array_sort(F.collect_list(F.struct("topic_ord", "claim_uid"))), lambda x: x["claim_uid"]).alias("claim_uids"))


def resolved(texts: DataFrame, claims: DataFrame) -> DataFrame:
    """text, claim_uid: each fixture text's claim, by its canonical text (the last claim of equal ones), else the most similar of 0.55 or more."""
    known = claims.groupBy(F.col("canonical_text").alias("key")).agg(F.max_by("claim_uid", "topic_ord").alias("uid"), F.min("topic_ord").alias("first"))
    wanted = texts.select("text").distinct().withColumn("key", tx.canonical(tx.claim_tokens(F.col("text"))))
    words = lambda df: df.select("key").distinct().withColumn("tokens", F.array_distinct(F.filter(F.split("key", " "), lambda x: x != "")))
    exact = wanted.join(known, "key")
    near = similarity.jaccard_pairs(words(wanted.join(known, "key", "left_anti")), words(known), 0.55)
    best = near.join(known, F.col("right_key") == F.col("key")).groupBy("left_key").agg(F.max_by("uid", F.struct("score", -F.col("first"))).alias("uid"))
    guess = wanted.join(best, F.col("key") == F.col("left_key")).select("text", "uid")
    return texts.select("text").distinct().join(exact.select("text", "uid").unionByName(guess), "text", "left").withColumnRenamed("uid", "claim_uid")


def pair_checks(pairs: DataFrame, claims: DataFrame, clusters: DataFrame) -> DataFrame:
    """pairs (kind must_link or cannot_link, pair_ord, left_text, right_text) with both claims, their clusters and ok."""
    texts = pairs.select(F.explode(F.array("left_text", "right_text")).alias("text"))
    of = resolved(texts, claims).join(clusters.select("claim_uid", "cluster"), "claim_uid", "left")
    for side in ("left", "right"):
        pairs = pairs.join(of.select(F.col("text").alias(f"{side}_text"), F.col("claim_uid").alias(f"{side}_uid"), F.col("cluster").alias(f"{side}_group")), f"{side}_text", "left")
    same = F.col("left_group") == F.col("right_group")
    ok = F.col("left_uid").isNotNull() & F.col("right_uid").isNotNull() & F.when(F.col("kind") == "must_link", same).otherwise(~same)
    return pairs.withColumn("ok", F.coalesce(ok, F.lit(False)))


def pair_agreement(checks: DataFrame, threshold: float = 0.75) -> DataFrame:
    """One row: passed, total, score, threshold, status; without pairs it fails."""
    score = F.when(F.col("total") > 0, F.round(F.col("passed") / F.col("total"), 4)).otherwise(0.0)
    return checks.agg(F.count_if("ok").alias("passed"), F.count("*").alias("total")).withColumn("score", score).withColumn("threshold", F.lit(float(threshold))).withColumn("status", F.when((F.col("total") > 0) & (F.col("score") >= threshold), "pass").otherwise("fail"))


def last_of(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key, the last: how videos and evidence of several records are merged."""
    names = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*names), order).alias("_r")).select(key, "_r.*")
