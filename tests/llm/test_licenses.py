import random
import re

import pyarrow.parquet as pq

from claimloom.llm import licenses as L

DOCS = "doc_id bigint, text string, license string, start string"


def best_at(notice, text):
    """Least edits of any occurrence (Sellers)."""
    row = list(range(len(notice) + 1))
    least = row[-1]
    for c in text:
        now = [0]
        for i, x in enumerate(notice):
            now.append(min(row[i] + (x != c), row[i + 1] + 1, now[i] + 1))
        row = now
        least = min(least, row[-1])
    return least


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        now = [i + 1]
        for j, y in enumerate(b):
            now.append(min(row[j] + (x != y), row[j + 1] + 1, now[j] + 1))
        row = now
    return row[-1]


def spoil(rng, s, n):
    s = list(s)
    for _ in range(n):
        i = rng.randrange(len(s))
        kind = rng.randrange(3)
        if kind == 0:
            s[i] = rng.choice("abcxyz, ")
        elif kind == 1:
            s.insert(i, rng.choice("abcxyz, "))
        else:
            del s[i]
    return "".join(s)


def test_same_finds_as_brute_force():
    rng = random.Random(8)
    hits = misses = 0
    for n in range(160):
        i = rng.randrange(len(L.NOTICES))
        wording = L.NOTICES[i][1]
        noise = ["".join(rng.choice("abcdelin rsu,") for _ in range(40)) for _ in range(2)]
        text = noise[0] + spoil(rng, wording, rng.randint(0, 2 * L.edits(wording))) + noise[1]
        got = L.find(text)
        for j, (_, w) in enumerate(L.NOTICES):
            want = best_at(w.lower(), text.lower()) <= L.edits(w)
            assert want == any(g[0] == j for g in got), (n, j)
            hits, misses = hits + want, misses + (not want)
        for j, a, b, e in got:
            assert e <= L.edits(L.NOTICES[j][1]) and distance(text[a:b].lower(), L.NOTICES[j][1].lower()) <= e
    assert hits > 60 and misses > 60


def test_spans_of_exact_notices_that_lie_close_together():
    w = L.NOTICES[0][1]
    text = f"{w}.{w}. İ {w.upper()}"
    got = [(a, b, e) for i, a, b, e in L.find(text) if i == 0]
    assert [text[a:b] for a, b, _ in got] == [w, w, w.upper()] and all(e == 0 for _, _, e in got)


def test_every_notice_line_of_the_documents_is_found():
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()
    lines = {line for t in texts if t for line in t.split("\n") if re.search(r"(?i)licen[sc]e|rights reserved", line)}
    assert "All rights reserved." in lines and len(lines) >= 5
    for line in lines:
        assert any(e == 0 for *_, e in L.find(f"some words\n{line}\nsome more")), line
    assert {L.NOTICES[i][0] for i, *_ in L.find("x\nAll rights reserved.\ny")} == {"Proprietary"}
    assert L.find("x\nall rigths reserved") == [] and L.find("All right reserved.")[0][3] == 1


def test_edge_rows(spark):
    w = "Licensed under CC BY-NC 4.0"
    rows = [(1, None), (2, ""), (3, "x" * 300_000 + w), (4, w), (4, w), (None, "licensed\nunder CC BY NC 4.0."), (5, "nothing here")]
    docs = spark.createDataFrame([(i, t, "a", "b") for i, t in rows], DOCS)
    got = sorted((str(r.doc_id), r.license, r.start, r.end, r.edits, r.matched) for r in L.scan(docs).collect())
    assert got == [("3", "CC-BY-NC-4.0", 300_000, 300_027, 0, w), ("4", "CC-BY-NC-4.0", 0, 27, 0, w), ("4", "CC-BY-NC-4.0", 0, 27, 0, w), ("None", "CC-BY-NC-4.0", 0, 27, 2, "licensed\nunder CC BY NC 4.0")]
    assert not L.scan(docs.limit(0)).count()
