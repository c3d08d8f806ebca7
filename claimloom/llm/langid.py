"""Language identification of web pages by Bayesian fusion of evidence.

log P(language | page) is, up to a constant, the sum of the tempered log-likelihood of the visible text (byte trigrams), of
log P(declared markup language | language), of log P(address suffix | language) and of the log prior of the host. These
three come from grouped counts over all pages of the languages that their text alone suggests, each page without its own
count; the host's prior is smoothed by that of its domain, and this by that of all pages.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .session import BATCH_ROWS, attach, prepare, saved
from .words import buffers, sliced, strings

#: Labelled documents of each language that the text model is trained on at most, those with the least hash of their id.
SAMPLE = 1500
BUCKETS = 1 << 16
#: Weight of the text's log-likelihood: its trigrams overlap and aren't independent.
TEMPER = 0.3
#: Pages that the prior one level up counts for.
STRENGTH = 5.0
#: A host is hot if one page of so many is its own; there are at most as many of them.
HOT = 1000
UNKNOWN = "und"


def _trigrams(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte trigrams of lower-cased texts (a space stands at either end), and len(arr) + 1 offsets."""
    space, nothing = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
    low = pc.binary_join_element_wise(space, pc.utf8_lower(arr), space, nothing)
    data, off = buffers(low)
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    x = data.astype(np.uint32)
    code = ((x[:-2] * 0x9E3779B1) ^ (x[1:-1] * 0x85EBCA6B) ^ (x[2:] * 0xC2B2AE35)) & 0xFFFFFFFF
    code = (code ^ (code >> 15)) % BUCKETS
    text = np.repeat(np.arange(len(off) - 1), np.diff(off))
    inside = text[:-2] == text[2:]
    return code[inside].astype(np.int64), np.r_[0, np.cumsum(np.bincount(text[:-2][inside], minlength=len(off) - 1))]


class TextModel:
    """log P(trigram | language), smoothed by adding a half; languages in order of their names."""

    def __init__(self, texts: list[str], languages: list[str]):
        self.languages = sorted(set(languages))
        count = np.zeros((len(self.languages), BUCKETS))
        for i, name in enumerate(self.languages):
            arr = strings(pa.array([t for t, x in zip(texts, languages) if x == name], pa.string()))
            for a, b in sliced(arr):
                count[i] += np.bincount(_trigrams(arr[a:b])[0], minlength=BUCKETS)
        self.log = np.log((count + 0.5) / (count.sum(1)[:, None] + 0.5 * BUCKETS)) if len(count) else count

    def score(self, arr: pa.Array) -> np.ndarray:
        """Log-likelihoods, texts x languages, of arr."""
        out = [np.zeros((0, len(self.languages)))]
        for a, b in sliced(arr):
            code, off = _trigrams(arr[a:b])
            total = np.zeros((len(off) - 1, len(self.languages)))
            some = np.flatnonzero(np.diff(off))
            if len(some):
                for i in range(len(self.languages)):
                    total[some, i] = np.add.reduceat(self.log[i][code], off[some])
            out.append(total)
        return np.concatenate(out)


def train(docs: DataFrame, sample: int = SAMPLE) -> TextModel:
    """Fit on at most `sample` documents of each lang, a null or empty one excepted."""
    from pyspark.sql import Window

    at = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = docs.where("length(lang) > 0 and doc_id is not null and length(text) > 0").select("lang", "doc_id").distinct()
    ids = ids.withColumn("n", F.row_number().over(at)).where(F.col("n") <= sample).select("lang", "doc_id")
    rows = docs.select("doc_id", "lang", "text").join(F.broadcast(ids), ["doc_id", "lang"]).collect()
    rows.sort(key=lambda r: (r.lang, r.doc_id, r.text or ""))
    return TextModel([r.text for r in rows], [r.lang for r in rows])


_OPENING = re.compile(r"(?i)<(?:(script|style|nav|template)\b|(!--))?")
_CLOSING = {n: re.compile(rf"(?i)</{n}\s*>") for n in ("script", "style", "nav", "template")}
_DECLARED = r"(?i)<html\b[^<>]*?\blang\s*=\s*[\"']?\s*([a-z]{2,3})\b"
_HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"


def visible(html: str | None) -> str:
    """The text of a page without markup, scripts, styles and navigation.

    One scan forward: what closes no element or comment from some place on closes none after it either, and isn't looked for again.
    """
    html = html or ""
    parts, at, never = [], 0, set()

    def closed(mark: str, start: int) -> int:
        """The place after the next closing mark, or -1."""
        if mark in never:
            return -1
        if mark in _CLOSING:
            m = _CLOSING[mark].search(html, start)
            end = m.end() if m else -1
        else:
            end = html.find(mark, start)
            end += len(mark) if end >= 0 else 0
        if end < 0:
            never.add(mark)
        return end

    search = _OPENING.search
    m = search(html)
    while m:
        start, end = m.start(), -1
        if m[1]:
            end = closed(m[1].lower(), m.end())
        elif m[2]:
            end = closed("-->", m.end())
        if end < 0:
            end = closed(">", start + 1)
        if end < 0:  # no tag ends from here on
            break
        parts.append(html[at:start])
        at = end
        m = search(html, end)
    parts.append(html[at:])
    return " ".join(entities.unescape(" ".join(parts)).split())


def evidence(pages: DataFrame, model: TextModel) -> DataFrame:
    """page_id, host, domain, suffix, declared, ll (the text's log-likelihoods) and best (the language they suggest)."""
    prepare(pages.sparkSession)
    held = pages.sparkSession.sparkContext.broadcast(model)
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), _HOST, 1))
    rows = pages.select("page_id", host.alias("host"), F.substring_index(host, ".", -2).alias("domain"), F.regexp_extract(host, r"\.([^.]+)$", 1).alias("suffix"), F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), _DECLARED, 1)).alias("declared"), "html")
    out = T.StructType([*rows.schema.fields[:-1], T.StructField("ll", T.ArrayType(T.DoubleType())), T.StructField("best", T.IntegerType())])

    def run(batches):
        for batch in batches:
            m = held.value
            for a in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(a, BATCH_ROWS)
                ll = m.score(strings(pa.array([visible(h) for h in part.column("html").to_pylist()], pa.string()))) * TEMPER
                best = np.where(ll.max(1) > ll.min(1), ll.argmax(1), -1) if len(m.languages) else np.full(len(ll), -1)
                values = pa.ListArray.from_arrays(pa.array(np.arange(len(ll) + 1, dtype=np.int32) * ll.shape[1]), pa.array(ll.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], values, pa.array(best.astype(np.int32))], out.names)

    return rows.mapInArrow(run, out)


def _counts(rows: DataFrame, key: str, n: int) -> DataFrame:
    return saved(rows.groupBy(key).agg(F.array(*(F.sum((F.col("best") == i).cast("double")) for i in range(n))).alias(f"{key}_n"), F.count("*").alias(f"{key}_rows")))


def identify(pages: DataFrame, docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """page_id, lang, p_lang, text_lang, declared, suffix: a row a page.

    pages: page_id, url, html; docs: doc_id, text, lang, to train on; other columns are ignored. A null or empty page has
    no text evidence (text_lang `und`) and a null URL the host ''; the rest decides, and of equal languages the first by
    name. Without training documents lang is `und` with a null p_lang. Rows that repeat each get a row; ids may be null.
    Pages are read whole, in one scan each, however broken their markup is.
    """
    model = train(docs, sample)
    names = model.languages
    rows = saved(evidence(pages, model))
    if not names:
        return rows.select("page_id", F.lit(UNKNOWN).alias("lang"), F.lit(None).cast("double").alias("p_lang"), F.lit(UNKNOWN).alias("text_lang"), "declared", "suffix")
    n = len(names)
    rows = rows.withColumn("declared_as", F.when(F.col("declared").isin(names), F.col("declared")).otherwise(F.when(F.col("declared") == "", "").otherwise("other")))
    *total, pages_in_all = rows.agg(*(F.sum((F.col("best") == i).cast("double")) for i in range(n)), F.count("*")).first()
    total = [float(x or 0) for x in total]
    suffixes = None
    for key in ("host", "domain", "suffix", "declared_as"):
        counts = _counts(rows, key, n)
        suffixes = counts.count() if key == "suffix" else suffixes
        rows = attach(rows, counts, [key], 100 + 8 * n, F.col(f"{key}_rows") * HOT >= pages_in_all)
    own = [(F.col("best") == i).cast("double") for i in range(n)]
    some = F.when(F.col("best") >= 0, 1.0).otherwise(0.0)

    def level(key: str, above: list[Column]) -> list[Column]:
        counted = F.aggregate(f"{key}_n", F.lit(0.0), lambda a, x: a + x) - some
        return [(F.col(f"{key}_n")[i] - own[i] + STRENGTH * above[i]) / (counted + STRENGTH) for i in range(n)]

    prior = level("host", level("domain", [(total[i] - own[i] + 1) / (sum(total) - some + n) for i in range(n)]))
    kinds = n + 2
    score = [
        F.col("ll")[i]
        + F.log((F.col("declared_as_n")[i] - own[i] + F.when(F.col("declared_as") == names[i], 1.0).otherwise(0.1)) / (total[i] - own[i] + 1 + 0.1 * (kinds - 1)))
        + F.log((F.col("suffix_n")[i] - own[i] + 1) / (total[i] - own[i] + suffixes + 1))
        + F.log(prior[i])
        for i in range(n)
    ]
    rows = rows.select("page_id", "declared", "suffix", "best", F.array(*score).alias("s"))
    top = F.array_max("s")
    name = F.array(*map(F.lit, names))
    return rows.select(
        "page_id",
        F.element_at(name, F.array_position("s", top).cast("int")).alias("lang"),
        (1 / F.aggregate("s", F.lit(0.0), lambda a, x: a + F.exp(x - top))).alias("p_lang"),
        F.when(F.col("best") >= 0, F.get(name, F.col("best"))).otherwise(UNKNOWN).alias("text_lang"),
        "declared",
        "suffix",
    )
