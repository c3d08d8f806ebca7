import numpy as np
from pyspark.sql import functions as F

from claimloom.llm import knn as N

SCHEMA = "vec_id bigint, embedding array<float>, id string, cell string, distance string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "a", "b", "c") for i, v in rows], SCHEMA)


def by_force(rows, k):
    out = {}
    for i, v in rows:
        d = sorted({(round(float(np.sqrt(((np.float64(np.float32(v)) - np.float64(np.float32(w))) ** 2).sum())), N.DIGITS), j, tuple(w)) for j, w in rows if j != i})
        out.setdefault(i, []).append([(r + 1, j, x) for r, (x, j, _) in enumerate(d[:k])])
    return out


def found(df):
    out = {}
    for r in df.orderBy("vec_id", "rank").collect():
        out.setdefault(r.vec_id, []).append((r["rank"], r.neighbor_id, r.distance))
    return out


def test_clusters_match_brute_force_and_are_not_all_replicated(spark):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(12, 5)) * 40
    x = centre[rng.integers(0, 12, 900)] + rng.normal(size=(900, 5))
    x[10:30] = x[9]
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)]
    got = found(N.neighbours(frame(spark, rows), rows=100))
    want = by_force(rows, N.K)
    assert {i: [v] for i, v in got.items()} == want

    pivots = x[::45]
    d = N.distances(x, pivots)
    cell = d.argmin(1)
    own = d[np.arange(900), cell]
    size = np.bincount(cell, minlength=len(pivots))
    radius = np.array([own[cell == i].max(initial=0) for i in range(len(pivots))])
    lay = N.Layout(pivots, size, radius, [np.sort(own[cell == i])[: N.K + 1] for i in range(len(pivots))], N.K + 1, 100)
    assert lay.groups >= 9 and lay.needed(d, cell).sum() < 0.25 * 900 * lay.groups


def test_queries_of_a_kind_against_all_in_any_number_of_tiles(spark):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(6, 8)) * 9
    rows = [(i, (centre[i % 6] + rng.normal(size=8)).tolist()) for i in range(500)] + [(7, (centre[3] + 1).tolist())]
    want = by_force(rows, N.K)
    for tiles in (1, 5, None):
        got = found(N.neighbours(frame(spark, rows), rows=15, asks=F.col("vec_id") % 5 == 0, tiles=tiles))
        assert {i: [v] for i, v in got.items()} == {i: v for i, v in want.items() if i % 5 == 0}


def test_exact_far_from_the_origin_and_with_a_far_vector(spark):
    rng = np.random.default_rng(6)
    rows = [(i, (100_000 + rng.normal(size=3) * 1e-3).tolist()) for i in range(60)]
    for more in ([], [(60, [-9e6, 0.0, 0.0])]):
        data = spark.createDataFrame(rows + more, "vec_id bigint, embedding array<double>")
        want = {}
        for i, v in rows + more:
            d = sorted((round(float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), N.DIGITS), j) for j, w in rows + more if j != i)
            want[i] = [(r + 1, j, x) for r, (x, j) in enumerate(d[:4])]
        got = found(N.neighbours(data, k=4, rows=20))
        assert {i: [(r, j) for r, j, _ in v] for i, v in got.items()} == {i: [(r, j) for r, j, _ in v] for i, v in want.items()}
        assert all(abs(a[2] - b[2]) < 2e-6 for i in want for a, b in zip(got[i], want[i]))


def test_hot_cell_is_split(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=3).tolist()) for i in range(400)]
    assert {i: [v] for i, v in found(N.neighbours(frame(spark, rows), k=4, pivots=1, rows=37)).items()} == by_force(rows, 4)


def test_edge_rows(spark):
    rows = [(1, [0.0, 0.0]), (1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, -1.0]), (5, [3.0, 4.0]), (5, [0.0, 0.5])]
    odd = [(6, None), (7, []), (8, [1.0]), (9, [float("nan"), 1.0]), (10, [None, 1.0]), (None, [0.0, 0.0]), (11, [float("inf"), 1.0])]
    got = N.neighbours(frame(spark, rows + odd), k=3)
    assert got.columns == ["vec_id", "rank", "neighbor_id", "distance"]
    got = found(got)
    assert got[1] == [(1, 5, 0.5), (2, 2, 1.0), (3, 3, 1.0)] and sorted(got) == [1, 2, 3, 4, 5] and len(got[5]) == 6
    assert not N.neighbours(frame(spark, odd)).count() and not N.neighbours(frame(spark, []).limit(0)).count()
    assert not N.neighbours(frame(spark, [(1, [0.5])])).count()
