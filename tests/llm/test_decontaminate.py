import random

from claimloom.llm import decontaminate as D

DOCS = "doc_id bigint, text string, item_id string, fp int, pos string"
ITEMS = "item_id bigint, text string, doc_id string"


def words(t):
    import re

    return re.findall(r"[0-9a-z_\x80-\U0010ffff]+", (t or "").lower())


def by_force(docs, items, need):
    out = set()
    for d, t in docs:
        for i, s in items:
            a, b = words(t), words(s)
            for x in range(len(a)):
                for y in range(len(b)):
                    if a[x] == b[y] and not (x and y and a[x - 1] == b[y - 1]):
                        n = 0
                        while x + n < len(a) and y + n < len(b) and a[x + n] == b[y + n]:
                            n += 1
                        if n >= need:
                            out.add((d, i, x, y, n))
    return out


def run(spark, docs, items, **kw):
    d = spark.createDataFrame([(i, t, "a", 1, "b") for i, t in docs], DOCS)
    i = spark.createDataFrame([(i, t, "a") for i, t in items], ITEMS)
    return [tuple(r) for r in D.shared_spans(d, i, **kw).collect()]


def test_every_shared_run_with_either_join(spark):
    rng = random.Random(1)
    items = [(n, " ".join(rng.choice("abc") + rng.choice("xy") for _ in range(rng.randint(3, 40)))) for n in range(12)]
    docs = []
    for n in range(40):
        w = [rng.choice("abc") + rng.choice("xyz") for _ in range(60)]
        if n % 2:
            s = rng.choice(items)[1].upper().split()
            a = rng.randrange(len(s))
            w[10:10] = s[a:]
        docs.append((n, " -- ".join(w)))
    want = by_force(docs, items, 7)
    assert len(want) > 10
    for budget in (None, 0):
        got = run(spark, docs, items, k=4, w=4, budget=budget)
        assert len(got) == len(set(got)) and set(got) == want


def test_edge_rows(spark):
    p = " ".join(f"p{i}" for i in range(12))
    long = " ".join(f"w{i}" for i in range(120_000))
    docs = [(1, p), (1, p), (2, None), (3, ""), (4, p[:-4]), (None, p), (5, long + " " + p.replace(" ", ",\n")), (6, ("a " * 30))]
    items = [(1, p), (2, p), (3, None), (4, ""), (None, "b " + p), (5, "short one"), (6, "a " * 12)]
    got = set(run(spark, docs, items))
    want = by_force(docs, [(i, t) for i, t in items], 12)
    assert got == want and (5, 1, 120_000, 0, 12) in got and (None, None, 0, 1, 12) in got
    d = spark.createDataFrame([(i, t, "a", 1, "b") for i, t in docs], DOCS)
    i = spark.createDataFrame([(i, t, "a") for i, t in items], ITEMS)
    kept = D.clean(d, i)
    assert kept.columns == d.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["2", "3", "4"]
    assert not D.shared_spans(d.limit(0), i).count() and not D.shared_spans(d, i.limit(0)).count()


def test_rows_are_judged_by_their_text(spark):
    p, other = " ".join(f"p{i}" for i in range(14)), " ".join(f"q{i}" for i in range(14))
    rows = [(None, p), (None, other), (1, p), (1, other), (2, None), (3, ""), (4, p)]
    d = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id bigint, text string, `a.key` string, key_ string")
    items = spark.createDataFrame([(1, p)], "item_id bigint, text string")
    kept = D.clean(d, items)
    assert kept.columns == d.columns
    assert sorted((str(r.doc_id), r.text or "") for r in kept.collect()) == sorted([("1", other), ("2", ""), ("3", ""), ("None", other)])
    assert D.clean(d, items.limit(0)).count() == len(rows) and not D.clean(d.limit(0), items).count()
