"""Set-similarity joins: inverted on tokens, never a nested loop over texts.

Two sets with a Jaccard of t or more share a token among the first n - ceil(t n) + 1 of each, in any order that both
follow; rare tokens first makes few candidates. The order goes by the counts of all tokens. Those that many sets hold are
few (in at least one of FREQUENT sets there are at most FREQUENT times the mean size of a set) and go to the sets by a
broadcast; the rest, which are spread evenly, by a shuffle where they are too many to go along.

Candidates grow as the square of the sets where words are few, so they are never rows of a table: sets are dealt into parts of
like sizes, and every two parts that can hold a pair meet in a tile, which one task solves in memory (setjoin). The shuffle
carries each set once for each part.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import text as tx
from ..plans.lineage import fits, saved, workers
from . import grouped, setjoin

FREQUENT = 500
DUPLICATE = 0.55
#: Tokens of the sets of a part at most (a set that has more is alone), and at least where there are cores for more parts.
PART, PART_LEAST = 2_000_000, 50_000
#: Claims of a topic that one task pairs in its memory at most.
LOCAL = 1000
SHARED = "topic_id string, a string, b string, a_ord bigint, b_ord bigint, a_n bigint, b_n bigint, both bigint"


def token_counts(sets: DataFrame) -> tuple[DataFrame, int]:
    """token, df, rank of all tokens (sets: tokens), saved, and the number of sets; ranks go up from 0 by df, then token."""
    counts = sets.select(F.explode_outer("tokens").alias("token")).where("token is not null").groupBy("token").agg(F.count("*").alias("df"))
    counts = saved(counts.orderBy("df", "token")).withColumn("_m", F.monotonically_increasing_id())
    part, row = F.shiftright("_m", 33), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    held = {r.p: r.n for r in counts.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    first = np.r_[0, np.cumsum([held.get(p, 0) for p in range(max(held, default=0) + 1)])].tolist()
    rank = F.element_at(F.array(*map(F.lit, first)), (part + 1).cast("int")) + row
    return counts.select("token", "df", rank.cast("int").alias("rank")), sets.count()


def counted(exploded: DataFrame, counts: DataFrame, n_sets: int) -> DataFrame:
    """exploded (token, ...) with the df and rank of each token."""
    if fits(counts.count(), 80):
        return exploded.join(F.broadcast(counts), "token")
    many = F.broadcast(counts.where(F.col("df") * FREQUENT >= n_sets))
    few = counts.where(F.col("df") * FREQUENT < n_sets)
    return exploded.join(many, "token").unionByName(exploded.join(many.select("token"), "token", "left_anti").join(few, "token"))


def ranked(sets: DataFrame, counts: DataFrame, n_sets: int) -> DataFrame:
    """id, n, ranks in ascending order of sets (id, tokens), saved."""
    exploded = sets.select("id", F.explode_outer("tokens").alias("token")).where("token is not null")
    return saved(counted(exploded, counts, n_sets).groupBy("id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("rank")).alias("ranks")))


def parts(sets: DataFrame, most: int, least: int) -> list[tuple[int, int, int]]:
    """Of sets (id, n): n, the first part of that size and in how many parts the sets of that size are dealt; and the parts number up by size."""
    sizes = sorted((r.n, r.c) for r in sets.groupBy("n").agg(F.count("*").alias("c")).collect())
    whole = max(least, min(most, math.ceil(sum(n * c for n, c in sizes) / math.sqrt(6 * sets.sparkSession.sparkContext.defaultParallelism))))
    out, part, held = [], 0, 0
    for n, c in sizes:
        if held and held + n * c > whole:
            part, held = part + 1, 0
        k = max(1, math.ceil(n * c / whole))
        out.append((n, part, k))
        if k > 1:
            part, held = part + k, 0
        else:
            held += n * c
    return out


def ranges(of: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """part, least and greatest size of its sets."""
    by: dict[int, list[int]] = {}
    for n, first, k in of:
        for p in range(first, first + k):
            by.setdefault(p, []).append(n)
    return [(p, min(ns), max(ns)) for p, ns in sorted(by.items())]


def solve(t: float, alone: bool):
    """For mapInArrow over tile, side, id, n, ranks with whole tiles in a task, in order of tile: a, b, score of its pairs."""

    def solved(kept: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(kept).combine_chunks()
        side = table.column("side").to_numpy()

        def of(which: int) -> setjoin.Sets:
            rows = table.filter(pa.array(side == which)).combine_chunks()
            ranks = rows.column("ranks").combine_chunks().flatten().to_numpy(zero_copy_only=False) if rows.num_rows else np.zeros(0, np.int32)
            return setjoin.Sets(rows.column("id").to_numpy(), rows.column("n").to_numpy(), ranks)

        within = alone and not (side == 1).any()
        found = setjoin.pairs(of(0), None if within else of(1), t, alone)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["a", "b", "score"])

    def run(batches):
        kept, last = [], None
        for batch in batches:
            tile = batch.column("tile").to_numpy()
            start = np.flatnonzero(np.r_[True, tile[1:] != tile[:-1]]) if len(tile) else ()
            for s, e in zip(start, [*start[1:], len(tile)]):
                if kept and tile[s] != last:
                    yield solved(kept)
                    kept = []
                last = tile[s]
                kept.append(batch.slice(s, e - s))
        if kept:
            yield solved(kept)

    return run


def met(left: DataFrame, right: DataFrame | None, t: float, most: int = PART, least: int = PART_LEAST) -> DataFrame:
    """a, b, score of the pairs of ranked sets; without right each pair within left once."""
    spark = left.sparkSession
    workers(spark)
    sides = [left] if right is None else [left, right]
    of = [parts(s, most, least) for s in sides]
    own, other = ranges(of[0]), ranges(of[-1])
    tiles = [(i, j) for i, i_lo, i_hi in own for j, j_lo, j_hi in other if (i <= j or right is not None) and i_hi >= j_lo * t - 1e-9 and j_hi >= i_lo * t - 1e-9]
    if not tiles:
        return spark.createDataFrame([], "a bigint, b bigint, score double")
    goes = [[(i, k, 0) for k, (i, _) in enumerate(tiles)], [(j, k, 1) for k, (i, j) in enumerate(tiles) if right is not None or i != j]]
    dealt = []
    for side, to in enumerate(goes):
        rows, by = sides[-1 if side else 0], of[-1 if side else 0]
        if not to:
            continue
        table = F.broadcast(spark.createDataFrame(by, "n bigint, _first int, _k int"))
        dealt.append(
            rows.join(table, "n").withColumn("_part", (F.col("_first") + F.pmod(F.xxhash64("id"), F.col("_k"))).cast("int"))
            .join(F.broadcast(spark.createDataFrame(to, "_part int, tile int, side int")), "_part").select("tile", "side", "id", "n", "ranks")
        )
    rows = dealt[0] if len(dealt) == 1 else dealt[0].unionByName(dealt[1])
    tasks = min(len(tiles), 10_000)
    rows = rows.repartitionById(tasks, F.expr(f"cast(tile % {tasks} as int)")).sortWithinPartitions("tile")
    return rows.mapInArrow(solve(t, right is None), "a bigint, b bigint, score double")


def jaccard_pairs(left: DataFrame, right: DataFrame | None, t: float) -> DataFrame:
    """left_key, right_key, score of all pairs of sets (key, tokens) with a Jaccard of t > 0 or more. Empty sets pair with none.

    Without right, of the pairs of two rows of left each comes once, in either order.
    """
    numbered = lambda df: saved(df.select("key", "tokens").where(F.size("tokens") > 0).withColumn("id", F.monotonically_increasing_id()))
    a = numbered(left)
    b = a if right is None else numbered(right)
    counts, n = token_counts(a.select("tokens") if right is None else a.select("tokens").unionByName(b.select("tokens")))
    found = met(ranked(a, counts, n), None if right is None else ranked(b, counts, n), t)
    named = lambda df, id_, key: df.select(F.col("id").alias(id_), F.col("key").alias(key))
    return saved(found).join(named(a, "a", "left_key"), "a").join(named(b, "b", "right_key"), "b").select("left_key", "right_key", "score")


def near_duplicates(claims: DataFrame, others: DataFrame, t: float = DUPLICATE, lookup: bool | None = None) -> DataFrame:
    """claims (text) with likely_duplicate: whether some other text has a Jaccard of t or more.

    Others whose words fit a broadcast go to the claims, which neither move nor meet one another (lookup: so or not, whatever
    they hold); with more of them, both are joined, and equal word sets compared once.
    """
    key = F.array_sort(tx.words(F.col("text")))
    right = saved(others.select(key.alias("key")).distinct()).withColumn("tokens", F.col("key"))
    if lookup is None:
        lookup = fits(right.agg(F.coalesce(F.sum(F.size("key")), F.lit(0))).first()[0], 80)
    if lookup:
        return claims.withColumn("likely_duplicate", held_by(setjoin.Lookup([r.key for r in right.select("key").collect()], t), claims)(F.lower(F.coalesce("text", F.lit("")))))
    rows = claims.withColumn("_words", key)
    left = saved(rows.select(F.col("_words").alias("key")).distinct()).withColumn("tokens", F.col("key"))
    hits = jaccard_pairs(left, right, t).select(F.col("left_key").alias("_words")).distinct().withColumn("_hit", F.lit(True))
    return rows.join(hits, "_words", "left").withColumn("likely_duplicate", F.coalesce("_hit", F.lit(False))).drop("_words", "_hit")


def held_by(table: setjoin.Lookup, rows: DataFrame):
    """A function of a lower-case text: whether a set of the table is like its words."""
    workers(rows.sparkSession)
    sent, word = rows.sparkSession.sparkContext.broadcast(table), re.compile(tx.WORD)

    @F.pandas_udf("boolean")
    def found(texts: pd.Series) -> pd.Series:
        look = sent.value
        return pd.Series([look.holds({w for w in word.findall(x) if len(w) > 1}) for x in texts], dtype=bool)

    return found


def duplicate_report(claims: DataFrame, others: DataFrame) -> DataFrame:
    """video_id, claim_count, likely_duplicate_claim_count, duplicate_ratio; claims without text don't count."""
    rows = near_duplicates(claims.where("text <> ''"), others.where("text <> ''"))
    n, d = F.count("*"), F.count_if("likely_duplicate")
    return rows.groupBy("video_id").agg(n.alias("claim_count"), d.alias("likely_duplicate_claim_count"), F.round(d / n, 3).alias("duplicate_ratio"))


def topic_pairs(claims: DataFrame, method: str = "normalized", local: int = LOCAL) -> DataFrame:
    """topic_id, a, b, a_ord, b_ord, score of pairs within a topic, a before b, that share a token; score by the method.

    claims: topic_id, claim_uid, topic_ord (int), token_set. Topics of at most local claims are each paired in one task's memory, larger ones by a
    join on their tokens. claims are read twice, so they should be saved.
    """
    rows = claims.select("topic_id", "claim_uid", F.col("topic_ord").cast("bigint").alias("topic_ord"), "token_set").where("topic_id is not null")
    large = saved(rows.groupBy("topic_id").agg(F.count("*").alias("n")).where(F.col("n") > local).select("topic_id"))
    pairs = None
    many = large.count()
    if not many:
        pairs = grouped.mapped(rows, ["topic_id"], shared, SHARED)
    else:
        large = F.broadcast(large) if fits(many, 100) else large
        pairs = grouped.mapped(rows.join(large, "topic_id", "left_anti"), ["topic_id"], shared, SHARED).unionByName(shared_tokens(rows.join(large, "topic_id", "left_semi")))
    both, an, bn = F.col("both"), F.col("a_n"), F.col("b_n")
    score = tx.blend(both, an, bn) if method == "normalized" else both / (an + bn - both)
    return pairs.select("topic_id", "a", "b", "a_ord", "b_ord", score.alias("score"))


def shared(topic: dict[str, list]) -> list[tuple]:
    """Rows of SHARED: pairs of a topic's claims that share tokens, with the numbers of tokens of each and of both."""
    rows = [(u, o, s, len(s)) for u, o, s in zip(topic["claim_uid"], topic["topic_ord"], map(frozenset, topic["token_set"])) if o is not None]
    name = topic["topic_id"][0]
    return [(name, u, v, o, p, n, m, both) for u, o, s, n in rows for v, p, t, m in rows if o < p and (both := len(s & t))]


def shared_tokens(claims: DataFrame) -> DataFrame:
    """shared() of topics of any size, by a join."""
    side = claims.select("topic_id", "claim_uid", "topic_ord", F.size("token_set").cast("bigint").alias("n"), F.explode_outer("token_set").alias("token")).where("token is not null")
    a, b = (side.select("topic_id", "token", F.col("claim_uid").alias(x), F.col("topic_ord").alias(f"{x}_ord"), F.col("n").alias(f"{x}_n")) for x in "ab")
    return a.join(b, ["topic_id", "token"]).where("a_ord < b_ord").groupBy("topic_id", "a", "b", "a_ord", "b_ord", "a_n", "b_n").agg(F.count("*").alias("both"))


def assertive(text: Column) -> Column:
    return lx.any_of(F.lower(text), lx.markers("assertive"))


def limiting(text: Column) -> Column:
    return lx.any_of(F.lower(text), lx.markers("limit"))


def opposition(similarity: Column, a: Column, b: Column, a_stance: Column, b_stance: Column) -> Column:
    """0.8 for an assertive text against a limiting one, 0.45 for differing stances of which one doubts; 0 for unlike claims."""
    doubts = ("caution_or_counterpoint", "hypothesis_or_alternative")
    return (
        F.when(similarity < 0.22, 0.0).when((assertive(a) & limiting(b)) | (assertive(b) & limiting(a)), 0.8)
        .when((a_stance != b_stance) & (a_stance.isin(*doubts) | b_stance.isin(*doubts)), 0.45).otherwise(0.0)
    )
