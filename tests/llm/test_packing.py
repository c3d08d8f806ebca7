import random
from collections import defaultdict

import numpy as np
import pytest

from claimloom.llm import packing as P


def one_by_one(lengths, capacity):
    """The same method on single pieces: reduction with a list, then best fit, longest first."""
    left = sorted(lengths, reverse=True)
    bins = []
    i = 0
    while i < len(left):
        w = left[i]
        rest = left[:i] + left[i + 1 :]
        room = capacity - w
        asc = rest[::-1]
        r = max((x for x in rest if x <= room), default=0)
        take = None
        if not r:
            take = []
        elif len(asc) < 2 or asc[0] + asc[1] > room or r == room:
            take = [r]
        elif len(asc) < 3 or sum(asc[:3]) > room:
            a, b = max(((x, y) for p, x in enumerate(rest) for y in rest[p + 1 :] if x + y <= room), key=lambda t: (sum(t), t[0] - t[1] < 0))
            pairs = [(x, y) for p, x in enumerate(rest) for y in rest[p + 1 :] if x + y == a + b]
            a, b = max(pairs)
            others = sorted(x for x in rest if x > b)
            if a in others:
                others.remove(a)
            if r >= a + b:
                take = [r]
            elif a == r and not (len(others) > 1 and others[0] + others[1] <= room):
                take = [a, b]
        if take is None:
            i += 1
            continue
        bins.append([w, *take])
        for x in [w, *take]:
            left.remove(x)
        i = sum(x > w for x in left)
    space = []
    for w in left:
        fit = [k for k in range(len(space)) if capacity - sum(space[k]) >= w]
        if fit:
            space[min(fit, key=lambda k: capacity - sum(space[k]))].append(w)
        else:
            space.append([w])
    return bins, space


def best(lengths, capacity):
    """The least number of bins, by trying all ways."""
    lengths = sorted(lengths, reverse=True)
    least = [len(lengths)]

    def go(i, rooms):
        if len(rooms) >= least[0]:
            return
        if i == len(lengths):
            least[0] = len(rooms)
            return
        for r in {*rooms}:
            if r >= lengths[i]:
                k = rooms.index(r)
                go(i + 1, rooms[:k] + [r - lengths[i]] + rooms[k + 1 :])
        go(i + 1, [*rooms, capacity - lengths[i]])

    go(0, [])
    return least[0]


def contents(runs):
    bins = defaultdict(list)
    for w, _, n, first, each, offset in runs.tolist():
        for k in range(n):
            bins[first + k // each].append((offset + k % each * w, w))
    return bins


@pytest.mark.parametrize("seed", range(60))
def test_plan_is_valid_and_as_good_as_piece_by_piece(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 30, 100])
    low = rng.choice([1, capacity // 5, capacity // 4])
    lengths = [rng.randint(max(1, low), capacity) for _ in range(rng.randint(1, 80))]
    count = np.bincount(lengths, minlength=capacity + 1)
    runs, n = P.plan(count, capacity)
    bins = contents(runs)
    assert sorted(w for b in bins.values() for _, w in b) == sorted(lengths) and sorted(bins) == list(range(n))
    for b in bins.values():
        end = 0
        for offset, w in sorted(b):
            assert offset == end
            end += w
        assert end <= capacity
    fixed, rest = one_by_one(lengths, capacity)
    assert n == len(fixed) + len(rest)
    if len(lengths) <= 12:
        assert n <= best(lengths, capacity) + 1


@pytest.mark.parametrize("seed", range(40))
def test_reduction_loses_nothing(seed):
    rng = random.Random(100 + seed)
    capacity = 20
    lengths = [rng.randint(rng.choice([3, 5, 7]), capacity) for _ in range(9)]
    count = np.bincount(lengths, minlength=capacity + 1)
    fixed = P.reduce(count, capacity)
    left = [w for w in range(capacity + 1) for _ in range(count[w])]
    assert sum(t for t, _ in fixed) + (best(left, capacity) if left else 0) == best(lengths, capacity)


@pytest.mark.parametrize("part_rows", [P.PART_ROWS, 7])
def test_packed(spark, part_rows):
    rng = random.Random(2)
    rows = [(i, "é" * rng.randint(0, 60), "x", "y") for i in range(300)] + [(5, "abc", "x", "y")] * 3 + [(None, "abc", "x", "y"), (700, None, "x", "y"), (701, "z" * 5003, "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, piece string, length string")
    got = P.packed(docs, 100, part_rows=part_rows).collect()
    bins, cut = defaultdict(list), defaultdict(list)
    for r in got:
        bins[r.bin_id].append((r.bin_offset, r.length))
        cut[r.doc_id].append((r.start, r.length))
    for b in bins.values():
        b.sort()
        assert b[0][0] == 0 and all(x + n == y for (x, n), (y, _) in zip(b, b[1:])) and sum(n for _, n in b) <= 100
    want = defaultdict(int)
    for r in rows:
        if r[1]:
            want[r[0]] += len(r[1].encode())
    assert {k: sum(n for _, n in v) for k, v in cut.items()} == want
    assert sorted(cut[701]) == [(a, min(100, 5003 - a)) for a in range(0, 5003, 100)]
    lengths = [n for v in cut.values() for _, n in v]
    assert len(bins) == sum(map(len, one_by_one(lengths, 100)))
    assert P.packed(docs.limit(0), 100).count() == 0
