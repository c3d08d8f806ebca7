import random

import numpy as np

from claimloom.llm import quality as Q

DOCS = "doc_id bigint, text string, p_good string, kept string, quality string"
LABELS = "doc_id bigint, quality int, text string"


def made(n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    out = []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randint(30, 300))]
        out.append((i, " ".join(w), 1) if i % 3 else (i, " ".join(x.upper() + "$$" for x in w), 0))
    return out


def frames(spark, rows, labelled):
    docs = spark.createDataFrame([(i, t, "a", "b", "c") for i, t, _ in rows], DOCS)
    return docs, spark.createDataFrame([(i, q, "z") for i, _, q in rows if i is not None and i < labelled], LABELS)


def test_held_out_accuracy_and_filter(spark):
    rows = made(600, 1)
    docs, labels = frames(spark, rows, 300)
    want = {i: q for i, _, q in rows}
    got = Q.scores(docs, labels).collect()
    held = [r for r in got if r.doc_id >= 300]
    assert len(got) == 600 and np.mean([r.kept == bool(want[r.doc_id]) for r in held]) > 0.98
    kept = Q.good(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in got if r.kept)


def test_sizes_cover_the_whole_text():
    raw = Q.dictionary([b"some words here"])
    text = random.Random(1).randbytes(10_000)
    assert Q.sizes(text, raw) > 9_500 and Q.sizes(text + text, raw) > 1.9 * Q.sizes(text, raw)
    import zstandard

    whole = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
    for i in range(0, len(text), Q.CHUNK):
        assert whole.decompress(Q._compressor(raw).compress(text[i : i + Q.CHUNK]), max_output_size=Q.CHUNK) == text[i : i + Q.CHUNK]


def test_edge_rows(spark):
    rows = made(120, 2)
    odd = [(1000, None, 0), (1001, "", 0), (None, "plain words", 1), (1002, rows[1][1] * 500, 1), (1, rows[1][1], 1)]
    docs, labels = frames(spark, rows + odd, 100)[0], spark.createDataFrame([(i, q, "z") for i, _, q in rows] + [(1000, 0, ""), (1001, 1, ""), (5, None, ""), (6, 7, "")], LABELS)
    got = Q.scores(docs, labels).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.p_good, r.kept))
    assert len(got) == 125 and by[1000] == by[1001] == [(None, False)]
    assert len(by[1]) == 2 and by[1][0] == by[1][1] and by[1002][0][1] and len(by[None]) == 1
    assert not Q.scores(docs.limit(0), labels).count()
    assert {r.p_good for r in Q.scores(docs, labels.limit(0)).collect()} == {1.0, None}
    assert {r.p_good for r in Q.scores(docs, labels.where("quality = 0")).collect()} == {0.0, None}


def test_scores_against_plain_compression(spark):
    import zstandard

    rows = made(200, 3)
    docs, labels = frames(spark, rows, 120)
    model = Q.train(docs, labels)
    press = [zstandard.ZstdCompressor(level=Q.LEVEL, dict_data=zstandard.ZstdCompressionDict(raw), write_dict_id=False, write_content_size=False, write_checksum=False) for raw in (model.good, model.bad)]
    got = {r.doc_id: r.p_good for r in Q.scores(docs, labels).collect()}
    for i, text, _ in rows:
        raw = text.encode()
        good, bad = (sum(len(p.compress(raw[a : a + Q.CHUNK])) - 6 for a in range(0, len(raw), Q.CHUNK)) for p in press)
        n, ratio = len(raw), np.log((max(good, bad, 0) + 1) / len(raw))
        x = np.array([(bad - good) / n, ratio, np.log(n), ratio * np.log(n), (bad - good) / n * np.log(n)])
        x = (np.minimum(np.maximum(x, model.link.low), model.link.high) - model.link.mean) / model.link.scale
        assert abs(got[i] - 1 / (1 + np.exp(-(x @ model.link.weight[:-1] + model.link.weight[-1])))) < 1e-9


def test_text_ids_and_clashing_columns(spark):
    rows = made(300, 4)
    docs = spark.createDataFrame([(f"id{i}", t, "a", "b") for i, t, _ in rows], "doc_id string, text string, `a.b` string, quality string")
    labels = spark.createDataFrame([(f"id{i}", q) for i, _, q in rows], "doc_id string, quality int")
    assert Q.good(docs, labels).columns == docs.columns
    kept, want = {r.doc_id for r in Q.good(docs, labels).collect()}, {f"id{i}" for i, _, q in rows if q}
    assert len(kept ^ want) <= 0.03 * len(rows)
    assert Q.scores(docs, labels).count() == 300 and not Q.good(docs.limit(0), labels).count()


def test_dictionary_without_training_takes_chunks_of_all_texts(monkeypatch):
    def fails(*a, **k):
        raise Q.zstandard.ZstdError("too few samples")

    monkeypatch.setattr(Q.zstandard, "train_dictionary", fails)
    raw = Q.dictionary([bytes([65 + i]) * 8000 for i in range(26)])
    assert set(raw) == set(range(65, 91)) and len(raw) <= Q.DICTIONARY
