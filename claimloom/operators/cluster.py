"""Greedy clustering of claims in order, exact and distributed.

A claim only ever joins a group through a pair at or above the threshold, so no group leaves a connected component of
such pairs, and pairs below it cannot change a choice. The ordered fold runs on the pairs of each topic; where the largest
topic has more than TOPIC_PAIRS of them, on those of each connected component instead, with the same result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import saved
from .components import components
from .grouped import mapped
from .similarity import topic_pairs

THRESHOLDS = {"normalized": 0.20, "token_jaccard": 0.5}
#: Pairs of a topic that one task folds at most, before topics are split into components.
TOPIC_PAIRS = 500_000


def clusters(claims: DataFrame, method: str = "normalized", threshold: float | None = None, topic_pairs_most: int = TOPIC_PAIRS) -> DataFrame:
    """topic_id, claim_uid, topic_ord, cluster: the uid of the claim that opened the group.

    claims: topic_id, claim_uid, topic_ord (the order within the topic), token_set. normalized: a claim joins the group
    with the most similar member; token_jaccard: the one with the most similar first claim; the earliest of equal ones. Claims
    without tokens are alone under normalized, and all together under token_jaccard. Unknown methods: ValueError.
    """
    if method not in THRESHOLDS:
        raise ValueError(f"unknown clusterer {method!r}; there are {', '.join(sorted(THRESHOLDS))}")
    least = THRESHOLDS[method] if threshold is None else threshold
    if method == "token_jaccard" and least == 1:
        return equal(claims)
    pairs = topic_pairs(claims, method).where(F.col("score") >= least)
    if method == "token_jaccard":
        empty = claims.where(F.size("token_set") == 0)
        first = empty.groupBy("topic_id").agg(F.min_by("claim_uid", "topic_ord").alias("a"), F.min("topic_ord").alias("a_ord"))
        star = empty.select("topic_id", F.col("claim_uid").alias("b"), F.col("topic_ord").alias("b_ord")).join(first, "topic_id").where("a_ord < b_ord")
        pairs = pairs.unionByName(star.select("topic_id", "a", "b", "a_ord", "b_ord", F.lit(1.0).alias("score")))
    pairs = saved(pairs)
    largest = pairs.groupBy("topic_id").count().agg(F.max("count")).first()[0] or 0
    if largest <= topic_pairs_most:
        grouped = pairs.withColumn("component", F.lit(""))
    else:
        grouped = pairs.join(components(pairs).select("topic_id", F.col("node").alias("a"), "component"), ["topic_id", "a"])
    leaders_only = method == "token_jaccard"

    def fold(edges: dict[str, list]) -> list[tuple]:
        order = {**dict(zip(edges["a"], edges["a_ord"])), **dict(zip(edges["b"], edges["b_ord"]))}
        near: dict[str, list[tuple[str, float]]] = {}
        for a, b, s in zip(edges["a"], edges["b"], edges["score"]):
            near.setdefault(b, []).append((a, s))
        cluster: dict[str, str] = {}
        for x in sorted(order, key=order.__getitem__):
            best, at = 0.0, None
            for a, s in near.get(x, ()):
                c = cluster[a]
                if leaders_only and c != a:
                    continue
                if s > best or s == best and at is not None and order[c] < order[at]:
                    best, at = s, c
            cluster[x] = x if at is None else at
        return [(edges["topic_id"][0], x, c) for x, c in cluster.items()]

    joined = mapped(grouped, ["topic_id", "component"], fold, "topic_id string, claim_uid string, cluster string")
    return claims.select("topic_id", "claim_uid", "topic_ord").join(joined, ["topic_id", "claim_uid"], "left").withColumn("cluster", F.coalesce("cluster", "claim_uid"))


def equal(claims: DataFrame) -> DataFrame:
    """token_jaccard at 1: claims of equal token sets, without any pairs."""
    rows = claims.select("topic_id", "claim_uid", "topic_ord", F.array_sort("token_set").alias("_set"))
    first = rows.groupBy("topic_id", "_set").agg(F.min("topic_ord").alias("_ord"), F.min_by("claim_uid", F.struct("topic_ord", "claim_uid")).alias("_uid"))
    held = F.when(F.col("topic_ord") > F.col("_ord"), F.col("_uid")).otherwise(F.col("claim_uid"))
    return rows.join(first, ["topic_id", "_set"]).select("topic_id", "claim_uid", "topic_ord", held.alias("cluster"))
