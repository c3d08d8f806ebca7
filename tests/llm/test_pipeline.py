import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline as C
from claimloom.llm import decontaminate, neardup, quality, secrets
from claimloom.llm.words import strings, word_hashes

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, `a.b` string, key string, `select` int"
KEY = "f33e61083db5dbdf4bd2369d2f80176e57f7fda2"


def made(n=160, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choice(["ka", "ti", "on", "er", "sha", "lu", "me", "ro", "nd"]) for _ in range(rng.randint(1, 5))) for _ in range(900)]
    passage = " ".join(rng.choice(words) for _ in range(30))
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randint(60, 200))]
        if i % 10 == 3:
            w = rows[-1][1].split()
            w[5] = rng.choice(words)
        if i % 16 == 5:
            w[20:20] = passage.split()
        if i % 20 == 7:
            w[3] = f"token={KEY}"
        good = i % 4 > 0 and "$$" not in w[0]  # a copy of a bad document is bad
        rows.append((i, " ".join(w if good else [x.upper().rstrip("$") + "$$" for x in w])))
        if i < n * 3 // 4:
            labels.append((i, int(good)))
    rows += [(1000, None), (1001, ""), (1002, "... !"), (None, rows[1][1]), (1, rows[1][1]), (1, rows[2][1] + " more"), (None, None), (1003, " ".join(rng.choice(words) for _ in range(40_000)))]
    return rows, labels, passage


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    rows, labels, passage = made()
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "x", "y", 1) for i, t in rows], SCHEMA)
    docs.repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, "see: " + passage), (2, None), (3, "short")], "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def pairs(df):
    return sorted((str(r.doc_id), str(r.text)) for r in df.collect())


def test_each_stage_against_brute_force(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    stages = dict(C.STAGES)
    assert list(stages) == ["quality_classifier", "simhash_neardup", "benchmark_decontamination", "secret_scan", "best_fit_packing"]

    good = stages["quality_classifier"](spark, docs, tables)
    model = quality.train(docs, spark.read.parquet(f"{tables}/labels.parquet"))
    want = sorted((str(r.doc_id), str(r.text)) for r in docs.collect() if r.text and model([r.text.encode()])[0] >= quality.THRESHOLD)
    assert good.columns == docs.columns and pairs(good) == want and 80 < len(want) < 150
    assert not any("$$" in t for _, t in want)

    rows = good.collect()
    one = stages["simhash_neardup"](spark, good, tables)
    code, size, _ = neardup.simhash(*word_hashes(strings(pa.array([r.text for r in rows]))))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in np.flatnonzero(neardup.distance(code[:i], code[i]) <= neardup.RADIUS) if size[i] else ():
            root[find(i)] = find(int(j))
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i])
    want = sorted(min((r.doc_id is None, r.doc_id or 0, str(r.doc_id), r.text) for r in g)[2:] for g in groups.values())
    assert one.columns == docs.columns and pairs(one) == want and len(want) < len(rows)

    clean = stages["benchmark_decontamination"](spark, one, tables)
    need, grams = decontaminate.K + decontaminate.W - 1, set()
    for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect():
        w = re.findall("[a-z0-9]+", r.text or "")
        grams |= {tuple(w[i : i + need]) for i in range(len(w) - need + 1)}
    has = lambda t: any(tuple(w[i : i + need]) in grams for w in [re.findall("[a-z0-9]+", t)] for i in range(len(w) - need + 1))
    kept = one.collect()
    want = sorted((str(r.doc_id), r.text) for r in kept if not has(r.text))
    assert clean.columns == docs.columns and pairs(clean) == want and len(want) < len(kept)

    masked = stages["secret_scan"](spark, clean, tables)
    spans = defaultdict(list)
    for r in secrets.scan(clean).collect():
        spans[r.doc_id].append((r.start, r.end))
    want = {}
    for r in clean.collect():
        text = r.text
        for a, b in sorted(spans[r.doc_id], reverse=True):
            text = text[:a] + secrets.MASK + text[b:]
        want[r.doc_id, r.text.replace(KEY, secrets.MASK)] = (text, len(text))
    assert masked.columns == docs.columns and sorted((r.text, r.n_chars) for r in masked.collect()) == sorted(want.values())
    assert sum(KEY in r.text for r in clean.collect()) > 2 and not any(KEY in r.text for r in masked.collect())

    packed = stages["best_fit_packing"](spark, masked, tables).collect()
    total, bins = defaultdict(int), defaultdict(list)
    for r in packed:
        total[r.doc_id] += r.length
        bins[r.bin_id].append((r.bin_offset, r.length))
    for r in masked.collect():
        total[r.doc_id] -= len(r.text.encode())
    assert not any(total.values())
    for b in bins.values():
        b.sort()
        assert b[0][0] == 0 and all(x + n == y for (x, n), (y, _) in zip(b, b[1:])) and sum(n for _, n in b) <= 8192


def test_no_near_copy_at_the_radius_is_kept(spark):
    rng = random.Random(41)
    texts = []
    for _ in range(200):  # copies with a ninth of the words changed lie about the radius
        w = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(60, 200))]
        texts.append(" ".join(w))
        for k in rng.sample(range(len(w)), len(w) // 9):
            w[k] = f"v{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    code, _, _ = neardup.simhash(*word_hashes(strings(pa.array(texts))))
    d = np.stack([neardup.distance(code, c) for c in code])
    near = {(i, j) for i, j in np.argwhere(d <= neardup.RADIUS).tolist() if i < j}
    assert 100 < len(near) < 200 and all(i % 2 == 0 and j == i + 1 for i, j in near)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), "x", "y", 1) for i, t in enumerate(texts)], SCHEMA)
    got = C.keep_one_copy(spark, docs, "")
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(range(len(texts))) - {j for _, j in near})


def test_whole_run_and_empty_tables(spark, tables, tmp_path):
    got = C.run(spark, tables)
    assert got.columns == ["doc_id", "piece", "start", "length", "bin_id", "bin_offset"]
    rows = got.collect()
    assert len({(r.doc_id, r.piece, r.start) for r in rows}) == len(rows) - 1 > 50  # two texts go by the id 1
    for empty in (("documents",), ("labels", "benchmark"), ("documents", "labels", "benchmark")):
        at = str(tmp_path / "-".join(empty))
        for name in ("documents", "labels", "benchmark"):
            df = spark.read.parquet(f"{tables}/{name}.parquet")
            (df.limit(0) if name in empty else df).write.parquet(f"{at}/{name}.parquet")
        assert bool(C.run(spark, at).count()) == ("documents" not in empty)
