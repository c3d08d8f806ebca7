"""Tokens and what follows from them, against plain loops; their work grows with the text."""

import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from claimloom.functions import lexicon as lx
from claimloom.functions import text as tx
from claimloom.plans import queries


def documents(spark, folder, texts):
    rows = [(i, x) for i, x in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(1).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ("claim_tokens", "token_df_topk"))
def test_work_on_a_line_grows_with_its_length(spark, tmp_path, name):
    """Each token was sought in the whole line."""
    took = []
    for n in (200, 5_000, 80_000):
        sf = documents(spark, tmp_path / str(n), [" ".join(f"word{k}" for k in range(n))])
        began = time.time()
        assert queries.QUERIES[name](spark, sf).count() > 0
        queries.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took.append(time.time() - began)
    assert took[2] < 3 * took[1] + 8


def test_terms_are_the_plain_loop(spark):
    rng = random.Random(4)
    words = ["Savings", "policies", "the", "cuts", "adopting", "maintain", "us", "bus", "glass", "carried", "running", "물", "보조금을", "20%", "İstanbul", "per cent", "twenty percent", "SOIL", "prove", "x", "flies", "reed", "seed"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 12))) for _ in range(150)] + ["", None, "  ,,"]
    kinds = [rng.choice(["other", "", None, "health_claim"]) for _ in texts]
    same, stop = lx.pairs("synonym"), lx.markers("stopword")

    def token(x):
        x = same.get(x, x)
        for end, n, put in (("ies", 5, "y"), ("ing", 6, ""), ("ed", 5, ""), ("s", 4, "")):
            if x.endswith(end) and len(x) > n and not (end == "s" and x.endswith("ss")):
                x = x[: -len(end)] + put
                break
        x = same.get(x, x)
        return x if len(x) >= 3 and x not in stop else None

    def want(text, kind):
        if text is None:
            return None, None, None, None
        low = text.lower().replace("twenty percent", "20 percent").replace("per cent", "percent")
        raw = "".join(c if c in "%0123456789abcdefghijklmnopqrstuvwxyz" or "가" <= c <= "힣" else " " for c in low).split()
        tokens = [t for t in map(token, raw) if t]
        kind = "" if kind in (None, "other") else kind
        more = {x for a, b in tx.EXPANSIONS if set(a) & set(tokens) for x in b}
        top = [t for t, _ in Counter(tokens).most_common(4)]
        return tokens, " ".join(tokens), sorted({*tokens, *more, *([kind] if kind else [])}), "topic_" + "_".join(top) if tokens else kind or "generic_claim"

    df = spark.createDataFrame(list(zip(range(len(texts)), texts, kinds)), "i int, text string, kind string")
    got = df.select("i", tx.terms(F.col("text"), F.col("kind"), "tokens", "canonical", "token_set", "group_key").alias("t")).orderBy("i").collect()
    assert [tuple(r.t) for r in got] == [want(*x) for x in zip(texts, kinds)]


def test_counts_of_lines(spark, monkeypatch):
    from claimloom.functions import terms

    monkeypatch.setattr(terms, "MOST", 3)
    rng = random.Random(6)
    lines = [" ".join(rng.choices(["alpha", "beta", "gamma", "delta", "omega", "the"], k=rng.randint(0, 6))) for _ in range(80)] + [None, ""]
    want = Counter(t for x in lines for t in set((x or "").split()) - {"the"})
    got = terms.line_counts(spark.createDataFrame([(x,) for x in lines], "text string")).collect()
    assert {r.token: r.df for r in got} == want


def test_markers_are_the_plain_search(spark):
    lists = {"low": ["water", "물", "a b"], "cased": ["XAI", "ai", "PC"]}
    texts = ["XAI and Water", "xai a  b a b", "pc PC 물", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", lx.hits(F.col("text"), lists).alias("h"), lx.best(F.col("text"), "content").alias("b")).orderBy("i")
    for r, text in zip(df.collect(), texts):
        t = text or ""
        assert r.h.asDict() == {k: [m for m in items if m in t or m in t.lower()] for k, items in lists.items()}
        found = [(label, [m for m in lx.markers("content", label) if m in t or m in t.lower()]) for label in lx.labels("content")]
        label, hits = max(found, key=lambda x: len(x[1]))
        assert (r.b.n, r.b.label, r.b.hits) == (len(hits), label, hits)
