"""Benchmark decontamination by winnowing.

Every k consecutive words have a hash; of each window of w consecutive hashes the least is kept (the rightmost of equal
ones) as a fingerprint. Two texts that share k + w - 1 consecutive words share a whole window and therefore a
fingerprint at matching places. Fingerprints of training and test texts are joined, and along the diagonal of each hit
the texts are compared word by word, which yields every maximal shared run of at least k + w - 1 words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .session import BROADCAST_BYTES, content, fits, prepare, saved, without
from .words import mix, sliced, strings, word_hashes

K, W = 8, 5


def winnow(h: np.ndarray, off: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, word position, fingerprint) of texts given by word hashes and offsets; none for texts under k + w - 1 words."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    n = len(h) - k + 1
    if n < w:
        return none
    g = np.zeros(n, np.uint64)
    for j in range(k):
        g = g * np.uint64(0x5851F42D4C957F2D) + h[j : j + n]
    g = mix(g)
    text = np.repeat(np.arange(len(off) - 1), np.diff(off))
    m = n - w + 1
    inside = text[:m] == text[k + w - 2 : k + w - 2 + m]
    least, at = g[:m].copy(), np.zeros(m, np.int64)
    for j in range(1, w):
        x = g[j : j + m]
        less = x <= least
        least[less] = x[less]
        at[less] = j
    at += np.arange(m)
    keep = np.zeros(n, bool)
    keep[at[inside]] = True
    at = np.flatnonzero(keep)
    return text[at], at - off[text[at]], g[at]


def fingerprints(df: DataFrame, text: str, k: int = K, w: int = W, among: np.ndarray | None = None) -> DataFrame:
    """df with a column of fingerprints, array<struct<pos, fp>>.

    With `among` (a sorted array), only those fingerprints are kept, and only rows that have one. Null and short
    texts have no fingerprints.
    """
    prepare(df.sparkSession)
    fields = T.StructType([T.StructField("pos", T.LongType()), T.StructField("fp", T.LongType())])
    out = T.StructType([*df.schema.fields, T.StructField("fingerprints", T.ArrayType(fields))])
    held = df.sparkSession.sparkContext.broadcast(among) if among is not None else None
    kind = pa.list_(pa.struct([("pos", pa.int64()), ("fp", pa.int64())]))

    def run(batches):
        for batch in batches:
            texts = strings(batch.column(text))
            for a, b in sliced(texts):
                h, off = word_hashes(texts[a:b])
                t, pos, fp = winnow(h, off, k, w)
                fp = fp.view(np.int64)
                rows = batch.slice(a, b - a)
                if held is not None:
                    known = held.value
                    if not len(known):
                        continue
                    at = np.minimum(np.searchsorted(known, fp), len(known) - 1)
                    hit = known[at] == fp
                    t, pos, fp = t[hit], pos[hit], fp[hit]
                    which = np.unique(t)
                    rows = rows.take(pa.array(which))
                    t = np.searchsorted(which, t)
                if rows.num_rows:
                    offsets = np.searchsorted(t, np.arange(rows.num_rows + 1)).astype(np.int32)
                    values = pa.StructArray.from_arrays([pa.array(pos), pa.array(fp)], ["pos", "fp"])
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.ListArray.from_arrays(offsets, values).cast(kind)], [*rows.schema.names, "fingerprints"])

    return df.mapInArrow(run, out)


def shared_spans(docs: DataFrame, items: DataFrame, k: int = K, w: int = W, budget: int | None = None) -> DataFrame:
    """Every maximal run of at least k + w - 1 words that a document and a test item share.

    docs: doc_id, text; items: item_id, text; other columns are ignored. Result: doc_id, item_id, doc_start,
    item_start, n_words (places and lengths in words), distinct rows.

    Null, empty and short texts (under k + w - 1 words) give no row; so do empty tables. Repeated documents each give
    their rows, which collapse when the id repeats as well; a null id is kept as null. Very long texts are scanned
    whole. The test fingerprints are shipped to the scan when their counted size is within the budget, so that only
    documents with a hit leave it; beyond that all fingerprints go through the join, with the same result.
    """
    spark = docs.sparkSession
    prepare(spark)
    tests = items.select(F.monotonically_increasing_id().alias("_item"), "item_id", F.col("text").alias("_item_text"))
    tests = saved(fingerprints(tests, "_item_text", k, w))
    marks = tests.select("_item", F.inline("fingerprints")).withColumnRenamed("pos", "_ipos")
    among = None
    budget = BROADCAST_BYTES if budget is None else budget
    n_marks, n_bytes = marks.count(), tests.agg(F.sum(F.octet_length("_item_text") + 100)).first()[0] or 0
    # an item, or a passage of one, that a third of the documents hold must not gather them in a task: what fits goes to them
    near = F.broadcast if fits(n_marks, 32, budget) else lambda side: side
    whole = F.broadcast if n_bytes <= budget else lambda side: side
    if fits(n_marks, 8, budget):
        among = np.sort(np.array([r[0] for r in marks.select("fp").distinct().collect()], np.int64))
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "text")
    found = saved(fingerprints(rows, "text", k, w, among))
    pairs = (
        found.select("_row", F.inline("fingerprints"))
        .join(near(marks), "fp")
        .groupBy("_row", "_item")
        .agg(F.collect_set(F.col("pos") - F.col("_ipos")).alias("_diagonals"))
        .join(whole(tests.select("_item", "item_id", "_item_text")), "_item")
        .join(found.select("_row", "doc_id", "text"), "_row")
        .select("doc_id", "item_id", "text", "_item_text", "_diagonals")
    )
    ids = [docs.schema["doc_id"], items.schema["item_id"]]
    out = T.StructType([*ids, *(T.StructField(c, T.LongType()) for c in ("doc_start", "item_start", "n_words"))])
    need = k + w - 1

    def extend(batches):
        for batch in batches:
            texts, tests = strings(batch.column("text")), strings(batch.column("_item_text"))
            diagonals = batch.column("_diagonals").to_pylist()
            for a, b in sliced(texts):
                h, off = word_hashes(texts[a:b])
                g, goff = word_hashes(tests[a:b])
                rows: list[list[int]] = [[], [], [], []]
                for r in range(b - a):
                    d, t = h[off[r] : off[r + 1]], g[goff[r] : goff[r + 1]]
                    for s in diagonals[a + r]:
                        i = max(0, -s)
                        same = d[i + s : i + s + len(t) - i]
                        same = np.concatenate([[False], same == t[i : i + len(same)], [False]])
                        edge = np.flatnonzero(same[1:] != same[:-1])
                        for x, y in zip(edge[::2].tolist(), edge[1::2].tolist()):
                            if y - x >= need:
                                for c, v in zip(rows, (a + r, i + s + x, i + x, y - x)):
                                    c.append(v)
                if rows[0]:
                    at = pa.array(rows[0])
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("item_id").take(at), *(pa.array(c, pa.int64()) for c in rows[1:])], out.names)

    return pairs.mapInArrow(extend, out).distinct()


def clean(docs: DataFrame, items: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """The documents that share no run of k + w - 1 words with a test item, with their columns as they were.

    Whether one goes depends on its text alone: rows that share an id are judged one by one, and so are rows with a null id. Null,
    empty and short texts stay, repeated rows stay or go together, and very long texts are read whole. Extra columns may have
    any name. Without documents there are none, without items all stay.
    """
    found = shared_spans(docs.select(content().alias("doc_id"), "text"), items, k, w)
    return without(docs, content(), saved(found.select("doc_id").distinct()))


ORACLE = f"""
WITH dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[0-9a-z_\\x{{80}}-\\x{{10FFFF}}]+') AS a FROM documents),
iw AS (SELECT item_id, regexp_extract_all(lower(text), '[0-9a-z_\\x{{80}}-\\x{{10FFFF}}]+') AS a FROM benchmark),
dk AS (SELECT doc_id, i, array_to_string(a[i + 1 : i + {K}], ' ') AS g FROM (SELECT doc_id, a, unnest(range(len(a) - {K - 1})) AS i FROM dw)),
tk AS (SELECT item_id, j, array_to_string(a[j + 1 : j + {K}], ' ') AS g FROM (SELECT item_id, a, unnest(range(len(a) - {K - 1})) AS j FROM iw)),
m AS (SELECT doc_id, item_id, i, j, i - row_number() OVER (PARTITION BY doc_id, item_id, i - j ORDER BY i) AS run
      FROM dk JOIN tk USING (g))
SELECT doc_id, item_id, min(i)::BIGINT AS doc_start, min(j)::BIGINT AS item_start, (count(*) + {K - 1})::BIGINT AS n_words
FROM m GROUP BY doc_id, item_id, i - j, run HAVING count(*) + {K - 1} >= {K + W - 1}
"""
