import math
import random
import re
from collections import Counter, defaultdict

import numpy as np

from claimloom.llm import secrets as S

DOCS = "doc_id bigint, text string, secrets string, n_chars bigint, score string, place string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "a", len(t or ""), "b", "c") for i, t in rows], DOCS)


def made(seed, n=200):
    rng = random.Random(seed)
    words = ["".join(rng.choice(["ka", "ti", "on", "er", "sha", "lu", "me", "ro", "nd"]) for _ in range(rng.randint(2, 10))) for _ in range(500)]
    rows, planted = [], {}
    for i in range(n):
        w = [rng.choice(words) for _ in range(80)]
        if i % 5 == 0:
            kind = i // 5 % 4
            key = ["".join(rng.choice("0123456789abcdef") for _ in range(40)), "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)), "".join(rng.choice("0123456789abcdef") for _ in range(18)), "".join(rng.choice(S._ALPHABET[:62]) for _ in range(32))][kind]
            w[7] = ["token = " + f'"{key}"', key, "password=" + key, "key:" + key][kind]
            planted[i] = key
        rows.append((i, " ".join(w)))
    return rows, planted


def test_planted_secrets_and_clean_documents(spark):
    rows, planted = made(4)
    docs = docs_of(spark, rows)
    got = {}
    for r in S.scan(docs).collect():
        got.setdefault(r.doc_id, []).append(r.secret)
    assert sum(got.get(i) == [k] for i, k in planted.items()) >= 0.95 * len(planted)
    assert not set(got) - set(planted)
    out = S.redact(docs)
    assert out.columns == docs.columns
    before = dict(rows)
    for r in out.collect():
        want = before[r.doc_id]
        for k in got.get(r.doc_id, ()):
            want = want.replace(k, S.MASK)
        assert r.text == want and r.n_chars == len(want) and r.secrets == "a"


def test_held_out_rates():
    rows, _ = made(9)
    words = sorted({w for _, t in rows for w in re.findall(r"\b[a-z]{4,}\b", t)})
    m = S.Model(*S.samples(words, 8000))
    keys, names = S.samples(words, 4000, seed=99)
    assert (m.score(keys) > m.threshold).mean() > 0.97 and (m.score(names) > m.threshold).mean() < 0.005
    assert abs(m.score(["abcdefgh1234abcd"])[0] - m.score(["x" * 40, "abcdefgh1234abcd"])[1]) < 1e-9

    def ordinary(rng):
        w = [x[: rng.randint(2, 7)] for x in rng.sample(words, 2)]
        return rng.choice([w[0] + str(rng.randint(0, 9999)), f"{w[0]}_{w[1]}{rng.randint(0, 99)}", f"{w[0].title()}{w[1].title()}{rng.randint(0, 9)}", f"20{rng.randint(10, 29)}-0{rng.randint(1, 9)}-{rng.randint(10, 28)}", str(rng.randint(10**7, 10**14))])

    rng = random.Random(5)
    short = [x for x in (ordinary(rng) for _ in range(6000)) if S.SHORTEST <= len(x) < S.LENGTH and re.fullmatch(S.CANDIDATE, x)]
    assert len(short) > 2000 and (m.score(short) > m.threshold).mean() < 0.005
    rate = {n: np.mean([m.score(["".join(rng.choice(S._ALPHABET[:62]) for _ in range(n))])[0] > m.threshold for _ in range(300)]) for n in (10, 12, 15, 16, 24)}
    assert rate[16] > 0.97 and rate[24] > 0.99 and rate[15] > 0.9 and rate[12] > 0.6, rate


def test_chain_against_counts_in_dictionaries():
    tokens = ["abc_def", "abab", "x", "Zz9/9=", "abc"]
    got, size = S.Chain(tokens).log, len(S._ALPHABET) + 1
    number = {c: i + 1 for i, c in enumerate(S._ALPHABET)}
    two, one, none = defaultdict(Counter), defaultdict(Counter), Counter()
    for t in tokens:
        x = [0, 0, *(number[c] for c in t)]
        for i in range(2, len(x)):
            two[x[i - 2], x[i - 1]][x[i]] += 1
            one[x[i - 1]][x[i]] += 1
            none[x[i]] += 1
    for a in range(size):
        for b in range(size):
            for c in (0, 1, 2, 3, 26, 27, 52, 62, 63, 64, 65):
                p0 = (none[c] + 0.5) / (sum(none.values()) + 0.5 * size)
                p1 = (one[b][c] + (len(one[b]) + 1e-6) * p0) / (sum(one[b].values()) + len(one[b]) + 1e-6)
                p2 = (two[a, b][c] + (len(two[a, b]) + 1e-6) * p1) / (sum(two[a, b].values()) + len(two[a, b]) + 1e-6)
                assert abs(math.log(p2) - got[a * size + b, c]) < 1e-9


def test_letters_are_counted_over_all_texts(spark):
    rows, _ = made(3, 60)
    rows += [(900, None), (901, ""), (902, "Übung naïve x1y ABC abc"), (903, "z" * 5000)]
    want = Counter()
    for _, t in rows:
        for w in re.findall("[a-z]+", (re.sub("[^\x00-\x7f]", " ", t or "")).lower()):
            x = [0, 0, *(ord(c) - 96 for c in w)]
            want.update(zip(x, x[1:], x[2:]))
    got = S.letter_counts(docs_of(spark, rows).repartition(5))
    assert {k: int(got[k]) for k in zip(*(x.tolist() for x in np.nonzero(got)))} == dict(want)


def key_of(rng, kind):
    alphabet, n = [("0123456789abcdef", 40), ("0123456789abcdef", 32), (S._ALPHABET[:62], 32), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 20)][kind]
    return "".join(rng.choice(alphabet) for _ in range(n))


def test_keys_in_paths_and_names():
    rows, _ = made(9)
    words = sorted({w for _, t in rows for w in re.findall(r"\b[a-z]{4,}\b", t)})
    m, rng = S.Model(*S.samples(words, 8000)), random.Random(31)
    w = lambda: rng.choice(words)
    for around in (lambda k: "/".join([w() for _ in range(5)] + [k] + [w() for _ in range(3)]), lambda k: f"{w()}_{w()}_token_{k}", lambda k: f"{w()}-{w()}-{k}/{w()}", lambda k: k):
        for kind in range(4):
            keys = [key_of(rng, kind) for _ in range(150)]
            runs = [around(k) for k in keys]
            score = m.score(runs)
            found = [[r[a:b] for a, b, _ in m.spans(r)] if s > m.threshold else [] for r, s in zip(runs, score)]
            assert sum(any(k in f for f in got) for k, got in zip(keys, found)) >= 0.95 * len(keys), (runs[0], kind)
            assert sum(got == [k] for k, got in zip(keys, found)) >= 0.9 * len(keys), (runs[0], kind)
    paths = ["/".join(w() for _ in range(9)) for _ in range(2000)]
    assert (m.score(paths) > m.threshold).mean() < 0.01
    two = [key_of(rng, 0), key_of(rng, 0)]
    assert [f"{two[0]}/{'/'.join(words[:4])}/{two[1]}"[a:b] for a, b, _ in m.spans(f"{two[0]}/{'/'.join(words[:4])}/{two[1]}")] == two


def test_masks_keys_in_paths_and_names(spark):
    rows, _ = made(6)
    key = "f33e61083db5dbdf4bd2369d2f80176e57f7fda2"
    rows += [(900, f"see srv/data/config/backup/{key}/index/file/list now"), (901, f"user_session_token_{key}")]
    found = {r.doc_id: r.text for r in S.redact(docs_of(spark, rows)).where("doc_id >= 900").collect()}
    assert found == {900: "see srv/data/config/backup/[SECRET]/index/file/list now", 901: "user_session_token_[SECRET]"}


def test_places_and_masking_by_place(spark):
    key, short = "f33e61083db5dbdf4bd2369d2f80176e57f7fda2", "qX7vK2pZ9tRw4m"
    rows, _ = made(6)
    texts = {900: f"é {key} ü\n{key}: {short}!", 901: f"{short} and in{short}side is no place", 902: key}
    docs = docs_of(spark, rows + list(texts.items()))
    found = [r for r in S.scan(docs).collect() if r.doc_id >= 900]
    assert all(texts[r.doc_id][r.start : r.end] == r.secret for r in found) and sum(r.secret == key for r in found) == 3 and sum(r.secret == short for r in found) >= 2
    by = {i: sorted((r.start, r.end) for r in found if r.doc_id == i) for i in texts}
    for r in S.redact(docs).where("doc_id >= 900").collect():
        want, at = "", 0
        for a, b in by[r.doc_id]:
            want, at = want + texts[r.doc_id][at:a] + S.MASK, b
        assert r.text == want + texts[r.doc_id][at:]


def test_edge_rows(spark):
    key = "f33e61083db5dbdf4bd2369d2f80176e57f7fda2"
    rows, _ = made(5, 60)
    rows += [(900, None), (901, ""), (902, f"{key} and {key}"), (903, "word " * 100_000 + key), (None, key), (902, f"{key} and {key}"), (904, "4785380592391139 " * 3 + "=" * 50)]
    got = {}
    for r in S.scan(docs_of(spark, rows)).orderBy("doc_id", "place").collect():
        got.setdefault(r.doc_id, []).append((r.place, r.secret))
    assert {900, 901, 904}.isdisjoint(got) and got[None] == [(0, key)] and got[903] == [(0, key)]
    assert got[902] == [(0, key), (0, key), (1, key), (1, key)]
    text = {r.doc_id: (r.text, r.n_chars) for r in S.redact(docs_of(spark, rows)).collect()}
    assert text[900] == (None, 0) and text[901] == ("", 0) and text[902] == ("[SECRET] and [SECRET]", 21) and text[None][0] == S.MASK
    assert not S.scan(docs_of(spark, rows).limit(0)).count() and not S.redact(docs_of(spark, rows).limit(0)).count()
    odd = docs_of(spark, rows[:5]).withColumnRenamed("secrets", "a.b").withColumnRenamed("place", "secrets_")
    assert S.redact(odd).columns == odd.columns and S.redact(odd).count() == 5
