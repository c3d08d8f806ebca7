import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa

from claimloom.llm import neardup as N
from claimloom.llm.words import strings, word_hashes

SCHEMA = "doc_id bigint, text string, code string, id string, group_id string"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in texts], SCHEMA)


def made(n=240, seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))
    out, docs = [], []
    for i in range(n):
        if docs and rng.random() < 0.5:
            w = list(rng.choice(docs))
            for _ in range(len(w) // 25):
                w[rng.randrange(len(w))] = word()
        else:
            w = [word() for _ in range(rng.randint(40, 300))]
            docs.append(w)
        out.append((i, " ".join(w)))
    return out


def by_force(texts):
    """Components over all pairs within the radius."""
    code, size, _ = N.simhash(*word_hashes(strings(pa.array([t for _, t in texts]))))
    root = list(range(len(texts)))
    pairs = set()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in np.flatnonzero(N.distance(code[i + 1 :], code[i]) <= N.RADIUS) + i + 1:
            pairs.add((i, int(j)))
            a, b = sorted((find(i), find(int(j))))
            root[b] = a
    return [find(i) for i in range(len(texts))], pairs


def test_groups_match_all_pairs(spark):
    texts = made()
    roots, pairs = by_force(texts)
    got = {r.doc_id: r.group_id for r in N.groups(frame(spark, texts)).collect()}
    assert pairs and len(got) == len(texts)
    assert sum(got[a] == got[b] for a, b in pairs) >= 0.95 * len(pairs)
    assert all(roots[i] == roots[g] for i, g in got.items())


def test_groups_are_those_of_all_pairs_where_every_pair_meets(spark):
    texts = made(300, 8)
    roots, pairs = by_force(texts)
    got = {r.doc_id: r.group_id for r in N.groups(frame(spark, texts), tables=80, bits=4).collect()}
    assert pairs and [got[i] for i in range(len(texts))] == roots


def test_simhash_against_single_votes():
    texts = ["one two three two", "", "x " * 600 + " ".join(f"w{i}" for i in range(700))]
    h, off = word_hashes(strings(pa.array(texts)))
    code, size, _ = N.simhash(h, off)
    assert size.tolist() == [3, 0, 701]
    from claimloom.llm.words import mix

    for t in range(3):
        words = np.unique(h[off[t] : off[t + 1]])
        votes = []
        for s in range(4):
            x = mix(words, s + 1)
            votes += [int(((x >> np.uint64(8 * b + j)) & np.uint64(1)).sum()) for j in range(8) for b in range(8)]
        assert np.packbits([2 * v > len(words) for v in votes]).tobytes() == code[t].tobytes()


def test_tree_and_exploration_find_what_all_pairs_do():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, (6, 4)).astype(np.uint64)
    codes = np.concatenate([np.repeat(base[:1], 700, 0), np.repeat(base[1:2], 60, 0), np.repeat(base[2:], 30, 0)])
    for i in range(len(codes)):
        for b in rng.integers(0, 256, 16):
            codes[i, b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    codes = np.unique(codes[rng.permutation(len(codes))], axis=0)
    codes = codes[rng.permutation(len(codes))]
    d = np.stack([N.distance(codes, c) for c in codes])
    want = {(i, j) for i, j in zip(*np.nonzero(d <= 36)) if i != j}
    f = N.Forest(codes, np.zeros(len(codes), np.int64))
    assert set(zip(*map(np.ndarray.tolist, f.search(np.arange(len(codes)), 36)))) == want

    def roots(pairs):
        r = list(range(len(codes)))

        def find(x):
            while r[x] != x:
                x = r[x]
            return x

        for a, b in pairs:
            a, b = sorted((find(a), find(b)))
            r[b] = a
        return [find(i) for i in range(len(codes))]

    a, b = N.edges(codes, np.zeros(len(codes), np.int64), 36)
    assert len(a) < len(want) / 4 and all(d[x, y] <= 36 for x, y in zip(a, b))
    assert roots(zip(a.tolist(), b.tolist())) == roots(want)


def test_recall_at_the_radius_holds_with_more_bits(spark):
    rng = np.random.default_rng(11)
    one = rng.integers(0, 2**63, (400, 4)).astype(np.uint64)
    other = one.copy()
    for i in range(len(other)):
        for b in rng.permutation(256)[: N.RADIUS]:
            other[i, b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    codes = np.concatenate([one, other])
    rows = spark.createDataFrame([(i, bytearray(c.tobytes())) for i, c in enumerate(codes)], "id bigint, code binary")
    for bits in (14, 20, 26):  # 26 are the bits for 10^9 codes
        got = {(r.a, r.b) for r in N.near_edges(rows, len(codes), bits=bits).collect()}
        assert len({tuple(sorted(p)) for p in got} & {(i, i + 400) for i in range(400)}) >= 0.86 * 400, bits
    for bits in range(1, 40):  # by the hypergeometric formula
        meet = np.prod([(256 - N.RADIUS - i) / (256 - i) for i in range(bits)])
        assert 1 - (1 - meet) ** N.tables_for(bits) >= 0.9


def roots_of(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(int(a)), find(int(b))))
        root[b] = a
    return [find(i) for i in range(n)]


def flipped(rng, codes, least, most):
    out = codes.copy()
    for c in out:
        for b in rng.permutation(256)[: rng.integers(least, most + 1)]:
            c[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    return out


def test_no_pair_at_the_radius_is_left_out(spark, monkeypatch):
    rng = np.random.default_rng(12)
    one = rng.integers(0, 2**63, (400, 4)).astype(np.uint64)
    codes = np.concatenate([one, flipped(rng, one, N.RADIUS, N.RADIUS), flipped(rng, one, N.RADIUS + 1, N.RADIUS + 1)])
    rows = spark.createDataFrame([(i, bytearray(c.tobytes())) for i, c in enumerate(codes)], "id bigint, code binary")
    want = roots_of(len(codes), ((i, j) for i in range(len(codes)) for j in np.flatnonzero(N.distance(codes[:i], codes[i]) <= N.RADIUS)))
    assert len(set(want)) == 800
    for least in (20_000, 200):  # one part, and parts that meet in tiles
        monkeypatch.setattr(N, "PART_LEAST", least)
        for tasks in (10_000, 5):
            monkeypatch.setattr(N, "TASKS", tasks)
            assert roots_of(len(codes), ((r.a, r.b) for r in N.near_edges(rows, len(codes)).collect())) == want
    assert roots_of(len(codes), ((r.a, r.b) for r in N.near_edges(rows, len(codes), tables=1, bits=40).collect())) == want


def test_groups_are_those_of_all_pairs(spark):
    rng = random.Random(31)
    texts = []
    for i in range(150):  # copies with a tenth of the words changed lie about the radius
        w = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(60, 200))]
        texts.append((2 * i, " ".join(w)))
        for k in rng.sample(range(len(w)), len(w) // 9):
            w[k] = f"v{rng.randrange(10**6)}"
        texts.append((2 * i + 1, " ".join(w)))
    roots, pairs = by_force(texts)
    got = {r.doc_id: r.group_id for r in N.groups(frame(spark, texts)).collect()}
    assert 40 < len(pairs) < 150 and [got[i] for i in range(len(texts))] == roots


def test_exact_search_of_clusters_and_parts(monkeypatch):
    rng = np.random.default_rng(9)
    base = rng.integers(0, 2**63, (5, 4)).astype(np.uint64)
    codes = flipped(rng, np.repeat(base, [1300, 500, 20, 20, 20], 0), 8, 18)
    codes = np.unique(codes, axis=0)
    codes = codes[rng.permutation(len(codes))]
    pairs = [(i, int(j)) for i in range(len(codes)) for j in np.flatnonzero(N.distance(codes[:i], codes[i]) <= 27)]
    plain = set()
    for most, known in ((1 << 18, 0), (1 << 18, 0.02), (50, 0.5), (1 << 18, 1)):
        monkeypatch.setattr(N, "MOST", most)
        have = [p for p in pairs if rng.random() < known]
        label = np.array(roots_of(len(codes), have))
        plain.add(bool(N.Block(codes, label, np.arange(17)).plain))
        for split in (None, 0, 700, len(codes)):
            a, b = N.rest_edges(codes, label, 27, split)
            assert (N.distance(codes[a], codes[b]) <= 27).all() and (label[a] != label[b]).all()
            met = pairs if split is None else [(x, y) for x, y in pairs if y < split <= x]
            assert roots_of(len(codes), [*have, *zip(a, b)]) == roots_of(len(codes), have + met)
    assert plain == {True, False}
    for n, radius in ((10, 44), (10**5, 44), (10**6, 44), (100, 3), (100, 0)):  # the pigeonhole's sums
        found = N.blocks(n, radius)
        assert sum(w for w, _ in found) == 256 and sum(r + 1 for _, r in found) == radius + 1


def test_texts_of_few_words_are_searched(spark):
    rng = random.Random(23)
    words = [f"w{i}" for i in range(40)]
    texts = []
    while len(texts) < 300:
        w = rng.sample(words, rng.randint(1, 12))
        for _ in range(rng.randint(1, 3)):
            texts.append((len(texts), " ".join(w) + (". " + w[0]) * (len(texts) % 3)))
            w = [rng.choice(words) if rng.random() < 0.1 else x for x in w]
    sets = [frozenset(re.findall("[a-z0-9]+", t)) for _, t in texts]
    code, size, _ = N.simhash(*word_hashes(strings(pa.array([t for _, t in texts]))))
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    near = 0
    for i in range(len(texts)):
        for j in range(i):
            if 4 * len(sets[i] & sets[j]) >= 3 * len(sets[i] | sets[j]):
                near += sets[i] != sets[j]
                a, b = sorted((find(i), find(j)))
                root[b] = a
    exact = [find(i) for i in range(len(texts))]
    got = {r.doc_id: r.group_id for r in N.groups(frame(spark, texts)).collect()}
    assert near > 30 and max(size) <= N.FEW
    assert all(got[i] == got[exact[i]] for i in range(len(texts)))
    for i in range(len(texts)):  # nothing else meets but by the fingerprints
        for j in np.flatnonzero(N.distance(code, code[i]) <= N.RADIUS):
            a, b = sorted((find(i), find(int(j))))
            root[b] = a
    assert all(find(i) == find(g) for i, g in got.items())


def test_one_changed_word_of_seven(spark):
    texts = [(1, "the quick brown fox jumps over dogs"), (2, "the quick brown fox jumps over cats"), (3, "a wholly other sentence of seven words"), (4, "line one here\n" * 400), (5, "line one here now\n" * 300)]
    assert [r.group_id for r in N.groups(frame(spark, texts)).orderBy("doc_id").collect()] == [1, 1, 3, 4, 4]


def test_components(spark):
    pairs = [(5, 4), (4, 3), (3, 2), (2, 1), (9, 8), (8, 7), (7, 9), (20, 30), (30, 40), (40, 21), (6, 6)]
    got = {r.id: r.root for r in N.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert {k: v for k, v in got.items() if k != v} == {2: 1, 3: 1, 4: 1, 5: 1, 8: 7, 9: 7, 21: 20, 30: 20, 40: 20}


def test_edge_rows(spark):
    long = " ".join(f"word{i}" for i in range(150_000))
    texts = [(1, None), (2, None), (3, ""), (4, "..."), (5, "a b c"), (6, "C, b a!"), (7, "a b d"), (8, long), (9, long + " more"), (8, long), (None, long)]
    got = defaultdict(list)
    for r in N.groups(frame(spark, texts)).collect():
        got[r.doc_id].append((r.group_id, r.kept))
        got[r.doc_id].sort()
    assert got == {1: [(1, True)], 2: [(2, True)], 3: [(3, True)], 4: [(4, True)], 5: [(5, True)], 6: [(5, False)], 7: [(7, True)], 8: [(8, False), (8, True)], 9: [(8, False)], None: [(8, False)]}
    kept = N.dedup(frame(spark, texts))
    assert kept.columns == ["doc_id", "text", "code", "id", "group_id"]
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "4", "5", "7", "8"]
    assert N.groups(frame(spark, texts).limit(0)).count() == 0


def test_rows_and_not_ids_are_dropped(spark):
    words = [f"w{i}" for i in range(200)]
    a, b = " ".join(words[:90]), " ".join(words[90:])
    near = b.replace("w150", "x150")
    rows = [(1, a), (5, a), (5, b), (7, near), (9, None), (9, ""), (None, a), (None, "alone in its group of words"), (None, "Alone in its group of words.")]
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id bigint, text string, `a.key` string, `select` int")
    kept = N.dedup(d)
    assert kept.columns == d.columns
    got = sorted((str(r.doc_id), r.text or "") for r in kept.collect())
    assert [x for x in got if "lone" not in x[1]] == sorted([("1", a), ("5", b), ("9", ""), ("9", "")])
    assert len(got) == 5
    names = {(str(r.doc_id), r.group_id, r.kept) for r in N.groups(d).collect()}
    assert {("1", 1, True), ("5", 1, False), ("5", 5, True), ("7", 5, False), ("None", None, True), ("None", None, False)} <= names
    text_ids = d.selectExpr("concat('id', doc_id) as doc_id", "text")
    assert sorted(str(r.doc_id) for r in N.dedup(text_ids).collect()) == ["None", "id1", "id5", "id9", "id9"]
    assert not N.dedup(d.limit(0)).count()


def test_joins_by_shuffle_give_the_same(spark, monkeypatch):
    from claimloom.llm import session

    rows = [(i % 200, t) for i, t in made(250, 4)] + [(1000 + i, "one text that many hold, of some words") for i in range(150)] + [(2000, None)] * 5
    d = frame(spark, rows).repartition(3)
    want = sorted(map(str, N.dedup(d).collect())), sorted(map(str, N.groups(d).collect()))
    for budget, hot in ((0, 1000), (300, 3)):
        monkeypatch.setattr(session.fits, "__defaults__", (budget,))
        monkeypatch.setattr(N, "HOT", hot)
        assert (sorted(map(str, N.dedup(d).collect())), sorted(map(str, N.groups(d).collect()))) == want
