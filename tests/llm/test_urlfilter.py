import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from claimloom.llm import urlfilter as U
from claimloom.llm.words import strings

PAGES = "page_id bigint, url string, score string, kept string, rejected string"


def made(seed, n):
    rng = random.Random(seed)
    good = [f"{a}{b}.example.{t}" for a in ("news", "blog", "wiki", "docs") for b in ("house", "line", "land") for t in ("com", "org")]
    bad = [f"{a}-{b}.example.{t}" for a in ("cheap", "best", "free", "win") for b in ("pills", "casino", "bets") for t in ("net", "com")]
    rows = []
    for i in range(n):
        r = rng.random() < 0.4
        rows.append((i, f"https://{rng.choice(bad if r else good)}/{rng.choice(['en', 'fr'])}/{rng.randint(1, 9999)}{rng.choice(['', '.html', '?page=2'])}", r))
    return rows


def by_hand(train, url):
    """Witten-Bell over dictionaries, byte by byte."""
    counts = defaultdict(Counter)
    pad = lambda u: [0] * U.ORDER + [b + 2 for b in u.encode()] + [1]
    for u in train:
        s = pad(u)
        for i in range(U.ORDER, len(s)):
            for k in range(U.ORDER + 1):
                counts[tuple(s[i - k : i])][s[i]] += 1
    s, total = pad(url), 0.0
    for i in range(U.ORDER, len(s)):
        p = 1 / 257
        for k in range(U.ORDER + 1):
            c = counts.get(tuple(s[i - k : i]))
            if c:
                p = (c[s[i]] + len(c) * p) / (sum(c.values()) + len(c))
        total += math.log(p)
    return total


def test_chain_against_dictionaries():
    rows = made(1, 60)
    urls = [u for _, u, _ in rows[:40]]
    chain = U.Chain(U.counted(strings(pa.array(urls)), 48), 48)  # so many cells that no n-grams share one
    for _, u, _ in rows[40:] + [(0, "é", 0)]:
        ctx, pair, text = U.contexts(strings(pa.array([u, "x", u])))
        got = np.bincount(text, chain.log(ctx, pair))
        assert abs(got[0] - by_hand(urls, u)) < 1e-6 and abs(got[0] - got[2]) < 1e-9


def test_counts_of_all_tasks_are_those_of_one(spark):
    rows = made(4, 300)
    urls = spark.createDataFrame([(u, r) for _, u, r in rows], "url string, rejected boolean").repartition(5)
    for got, label in zip(U.chains(urls, 48), (False, True)):
        want = U.Chain(U.counted(strings(pa.array([u for _, u, r in rows if r == label])), 48), 48)
        assert len(got.levels) == U.ORDER + 1 and all(np.array_equal(x, y) for a, b in zip(got.levels, want.levels) for x, y in zip(a, b))


def test_held_out_accuracy(spark):
    rows = made(2, 900)
    labels = spark.createDataFrame([(u, r, "x") for _, u, r in rows[:500]], "url string, rejected boolean, page_id string")
    pages = spark.createDataFrame([(i, u, "a", "b", "c") for i, u, _ in rows], PAGES)
    want = {i: r for i, _, r in rows}
    got = U.filtered(pages, labels).collect()
    assert len(got) == 900 and np.mean([r.kept != want[r.page_id] for r in got if r.page_id >= 500]) > 0.99


def test_edge_rows(spark):
    rows = made(3, 200)
    odd = [(900, None), (901, ""), (902, "http://" + "a" * 50_000), (None, rows[0][1]), (0, rows[0][1]), (903, "日本")]
    pages = spark.createDataFrame([(i, u, "a", "b", "c") for i, u, *_ in rows + odd], PAGES)
    got = defaultdict(list)
    for r in U.filtered(pages).collect():
        got[r.page_id].append((r.score, r.p_rejected, r.kept))
    assert got[900] == got[901] == [(None, None, False)] and got[0] == got[None] * 2 and len(got) == 205
    assert not U.filtered(pages.limit(0)).count()
    none = pages.where("url like 'zz%'").selectExpr("url", "true as rejected")
    assert {r.p_rejected for r in U.filtered(pages, none).collect()} == {0.0, None}
    assert {r.p_rejected for r in U.filtered(pages, pages.selectExpr("url", "true as rejected")).collect()} == {1.0, None}
