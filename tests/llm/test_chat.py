import random

import numpy as np
import pytest

from claimloom.llm import chat as C

SCHEMA = "conv_id bigint, turn bigint, role string, text string, n_tokens string"
pytestmark = pytest.mark.skipif(not __import__("os").path.exists(C.TOKENIZER), reason="no vocabulary files here")


def test_mask_against_every_character():
    rng = random.Random(6)
    for _ in range(200):
        at, spans, offsets = 0, [], []
        while at < 60:
            at += rng.randint(1, 5)
            spans.append((at, at := at + rng.randint(1, 6)))
        at = 0
        while at < 70:
            n = rng.randint(0, 4)
            offsets += [(at, at + n)] * rng.randint(1, 2)
            at += n
        inside = {c for a, b in spans for c in range(a, b)}
        assert C.mask(np.array(offsets), spans).tolist() == [int(any(c in inside for c in range(a, b))) for a, b in offsets]


def test_round_trip_and_trained_text(spark):
    rng = random.Random(7)
    talk = lambda: " ".join(rng.choice(["naïve", "the", "<|end|>", "日本", "x\ny", "émeu", "🙂 ok", "1234"]) for _ in range(rng.randint(0, 30)))
    rows = [(c, t, ["user", "assistant", "system"][rng.randrange(3)], talk(), "z") for c in range(40) for t in range(rng.randint(1, 6))]
    shuffled = rows[:]
    rng.shuffle(shuffled)
    got = {r.conv_id: r for r in C.formatted(spark.createDataFrame(shuffled, SCHEMA)).collect()}
    assert len(got) == 40
    decode = C._tokenizer(C.TOKENIZER).decode
    for c, r in got.items():
        text, spans = C.render([(x[2], x[3]) for x in rows if x[0] == c])
        assert decode(r.token_ids, skip_special_tokens=False) == text
        assert r.n_turns == sum(x[0] == c for x in rows) and r.n_tokens == len(r.token_ids) == len(r.loss_mask) and r.n_trained == sum(r.loss_mask)
        (ids, off), inside = C.encode([text])[0], {k for a, b in spans for k in range(a, b)}
        assert ids.tolist() == r.token_ids
        assert r.loss_mask == [int(any(k in inside for k in range(a, b))) for a, b in off.tolist()]


def test_edge_rows(spark):
    rows = [(1, None, "user", None, "z"), (1, 0, None, "hi", "z"), (1, 0, "assistant", "b", "z"), (1, 0, "assistant", "a", "z"), (1, 0, "assistant", "a", "z"), (None, 1, "assistant", "", "z"), (2, 0, "assistant", "word " * 50_000, "z")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.conv_id: r for r in C.formatted(df).collect()}
    text, _ = C.render([("user", ""), ("assistant", "a"), ("assistant", "a"), ("assistant", "b"), ("unknown", "hi")])
    assert C._tokenizer(C.TOKENIZER).decode(got[1].token_ids) == text and got[1].n_turns == 5
    assert got[None].n_turns == 1 and got[None].n_trained > 0 and got[2].n_trained > 50_000
    assert not C.formatted(df.limit(0)).count()
