"""Pairs and groups of topics: by lists in memory, by joins and by equal sets alike, against nested loops."""

import random

import pytest

from claimloom.operators import cluster, grouped, similarity, terrain
from test_operators import CLAIM, blend, greedy, jaccard
from test_similarity import written


def topics(n, seed=1, words="abcdefgh", most=4):
    rng = random.Random(seed)
    return [(f"t{t}", f"t{t}c{i:02}", i, sorted(rng.sample(words, rng.randint(0, most)))) for t in range(n) for i in range(rng.randint(1, 12))]


@pytest.mark.parametrize("method", ("normalized", "token_jaccard"))
@pytest.mark.parametrize("local", (0, 6, 1000))
def test_pairs_in_memory_and_by_joins_are_the_nested_loop(spark, method, local, monkeypatch):
    monkeypatch.setattr(grouped, "ROWS", 5)
    rows = topics(15)
    score = blend if method == "normalized" else jaccard
    want = {(a[0], a[1], b[1], a[2], b[2]): score(set(a[3]), set(b[3])) for a in rows for b in rows if a[0] == b[0] and a[2] < b[2] and set(a[3]) & set(b[3])}
    got = {(r.topic_id, r.a, r.b, r.a_ord, r.b_ord): r.score for r in similarity.topic_pairs(spark.createDataFrame([*rows, (None, "x", 0, ["a"]), (None, "y", 1, ["a"])], CLAIM), method, local).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_equal_sets_are_the_greedy_loop_at_one(spark):
    rows, want = topics(12, 2, "abc", 2), {}
    for t in {r[0] for r in rows}:
        want |= greedy([(r[1], set(r[3])) for r in rows if r[0] == t], jaccard, 1.0, True)
    assert {r.claim_uid: r.cluster for r in cluster.clusters(spark.createDataFrame(rows, CLAIM), "token_jaccard", 1.0).collect()} == want


@pytest.mark.parametrize("method", ("normalized", "token_jaccard"))
def test_mean_scores_are_those_of_all_pairs(spark, method):
    rows = [(*r, f"k{i % 3}") for i, r in enumerate(topics(10, 3, "abcd", 3))]
    score = blend if method == "normalized" else jaccard
    groups: dict = {}
    for t, _, _, s, k in rows:
        groups.setdefault((t, k), []).append(set(s))
    want = {g: [score(a, b) for i, a in enumerate(x) for b in x[i + 1 :]] for g, x in groups.items()}
    got = {(r.topic_id, r.cluster): r.grouping_score for r in terrain.mean_scores(spark.createDataFrame(rows, CLAIM + ", cluster string"), method).collect()}
    assert got.keys() == want.keys() and all(abs(got[g] - (sum(x) / len(x) if x else 1.0)) < 1e-4 for g, x in want.items())


def test_equal_claims_form_no_pairs(spark):
    """All pairs of a topic's equal claims were joined on each of their tokens, to be clustered and once more for their mean."""
    took = []
    for n in (200, 1600):
        df = spark.createDataFrame([("t", f"c{i:05}", i, list("abcdefghij")) for i in range(n)], CLAIM)
        df = df.localCheckpoint()
        before = written(spark)
        rows = terrain.members(df, cluster.clusters(df, "token_jaccard", 1.0))
        assert [r.grouping_score for r in terrain.mean_scores(rows, "token_jaccard").collect()] == [1.0]
        took.append(written(spark) - before)
    assert took[1] < 16 * took[0]
