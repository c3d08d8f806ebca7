"""Joins of sets in tiles, and the lookup among few sets, against the nested loop."""

import random

import numpy as np
import pytest

from claimloom.operators import setjoin, similarity
from test_operators import jaccard


def some_sets(n, words, longest, seed=3):
    rng = random.Random(seed)
    return [sorted({f"w{int(rng.random() ** 2 * words)}" for _ in range(rng.randint(0, longest))}) for _ in range(n)]


def nested(a, b, t):
    return {(i, j): jaccard(set(x), set(y)) for i, x in enumerate(a) for j, y in enumerate(b) if x and y and jaccard(set(x), set(y)) >= t}


def written(spark):
    return sum(e.totalShuffleWrite() for e in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jsc.sc().statusStore().executorList(True)))


@pytest.mark.parametrize("t,most", [(0.3, 40), (0.3, 10**6), (0.55, 40), (1.0, 40)])
def test_tiles_hold_every_pair_once(spark, t, most):
    sets, others = some_sets(90, 25, 14), some_sets(40, 25, 9, 8)
    want, across = nested(sets, sets, t), nested(sets, others, t)
    a, b = (spark.createDataFrame(list(enumerate(s)), "key int, tokens array<string>").selectExpr("cast(key as bigint) as id", "tokens").where("size(tokens) > 0") for s in (sets, others))
    counts, n = similarity.token_counts(a.select("tokens").unionByName(b.select("tokens")))
    a, b = similarity.ranked(a, counts, n), similarity.ranked(b, counts, n)
    got = [(*sorted((r.a, r.b)), r.score) for r in similarity.met(a, None, t, most, 1).collect()]
    assert sorted(got) == sorted((i, j, s) for (i, j), s in want.items() if i < j)
    assert sorted((r.a, r.b, r.score) for r in similarity.met(a, b, t, most, 1).collect()) == sorted((i, j, s) for (i, j), s in across.items())


def test_ranks_go_up_with_counts(spark):
    sets = some_sets(60, 40, 10)
    counts, n = similarity.token_counts(spark.createDataFrame([(s,) for s in sets], "tokens array<string>"))
    rows = sorted(counts.collect(), key=lambda r: r.rank)
    assert n == 60 and [(r.df, r.token) for r in rows] == sorted((r.df, r.token) for r in rows) and [r.rank for r in rows] == list(range(len(rows)))


def test_candidates_are_not_shuffled(spark):
    """Sets of few frequent words: nearly all pairs are candidates, few are results."""
    took = []
    for n in (1000, 3000):
        rng = random.Random(n)
        rows = [(f"k{i}", [f"a{x}" for x in rng.sample(range(24), 10)]) for i in range(n)]
        df = spark.createDataFrame(rows, "key string, tokens array<string>")
        before = written(spark)
        assert similarity.jaccard_pairs(df, df, 0.9).count() >= n
        took.append(written(spark) - before)
    assert took[1] < 5 * took[0]


def test_rounds_of_candidates_lose_nothing(monkeypatch):
    monkeypatch.setattr(setjoin, "MOST", 7)
    sets = [s for s in some_sets(70, 20, 12) if s]
    rank = {w: i for i, w in enumerate(sorted({w for s in sets for w in s}))}
    n = np.array([len(s) for s in sets])
    a = setjoin.Sets(np.arange(len(sets)), n, np.array([r for s in sets for r in sorted(map(rank.get, s))], np.int32))
    got = [tuple(sorted((int(i), int(j)))) for i, j, _ in zip(*setjoin.pairs(a, None, 0.4))]
    assert sorted(got) == sorted((i, j) for i, j in nested(sets, sets, 0.4) if i < j)


@pytest.mark.parametrize("t", (0.3, 0.55, 1.0))
def test_lookup_finds_what_the_join_finds(spark, t):
    texts, others = ([" ".join(s).upper() + ", a" for s in some_sets(n, 25, 12, seed)] for n, seed in ((80, 4), (25, 6)))
    claims = spark.createDataFrame([*enumerate([*texts, ""]), (99, None)], "n int, text string")
    other = spark.createDataFrame([(x,) for x in others], "text string")
    sets = [[set(x.lower().replace(",", "").split()) - {"a"} for x in xs] for xs in (texts, others)]
    want = {i for i, x in enumerate(sets[0]) if any(x and y and jaccard(x, y) >= t for y in sets[1])}
    for lookup in (None, True, False):
        got = similarity.near_duplicates(claims, other, t, lookup).collect()
        assert len(got) == 82 and {r.n for r in got if r.likely_duplicate} == want
    assert not any(r.likely_duplicate for r in similarity.near_duplicates(claims, other.limit(0), t).collect())


def test_long_lines_are_not_repeated_for_each_of_their_words(spark):
    """A line's words went along with each of them, so that what was shuffled grew as the square of a line's length."""
    took = []
    for n in (200, 1600):
        lines = spark.createDataFrame([(f"v{i}", " ".join(f"w{(i * 7 + k * 13) % 9973}" for k in range(n))) for i in range(60)], "video_id string, text string")
        before = written(spark)
        assert similarity.duplicate_report(lines, lines.limit(3)).count() == 60
        took.append(written(spark) - before)
    assert took[1] < 12 * took[0]
