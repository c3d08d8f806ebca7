"""URL filter: two smoothed variable-order Markov models of characters, of accepted and of rejected URLs.

Each model backs off from ORDER characters of context to none (Witten-Bell), on counts over all labelled URLs. A URL's score is its log-likelihood under
the rejected model less that under the accepted one, over its length; held-out samples calibrate it to a probability.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .calibrate import Logistic
from .session import prepare, saved
from .words import buffers, mix, sliced, strings

ORDER = 6
#: Labelled URLs of each class that the score is calibrated on at most, those with the least hash.
SAMPLE = 6000
#: n-grams of one order share 2 ** BITS cells.
BITS = 19
#: Bytes of URLs that are scored or counted at once: each has 2 * (ORDER + 1) hashes.
SLICE = 1 << 18
THRESHOLD = 0.5
#: Hosts with one of these words are the rejected samples of the default labels.
REJECTED_WORDS = ("spam", "casino", "pills", "bets", "adult", "ads-", "track", "porn", "viagra", "lottery", "malware", "phish", "warez")


def contexts(arr: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """For every byte of the texts: hashes of its contexts of 0 to ORDER bytes, of these with the byte, and its text."""
    data, off = buffers(arr)
    n = np.diff(off)
    # ORDER start marks before and one end mark after every text
    padded = np.zeros(len(data) + len(n) * (ORDER + 1), np.uint64)
    text = np.repeat(np.arange(len(n)), n)
    padded[np.arange(len(data)) + text * (ORDER + 1) + ORDER] = data.astype(np.uint64) + np.uint64(2)
    ends = off[1:] + np.arange(len(n)) * (ORDER + 1) + ORDER
    padded[ends] = 1
    text = np.repeat(np.arange(len(n)), n + 1)
    at = np.arange(len(text)) + (text + 1) * ORDER
    ctx, pair, h = [], [], np.zeros(len(at), np.uint64)
    for k in range(ORDER + 1):
        if k:
            h = h * np.uint64(0x100000001B3) + padded[at - k] + np.uint64(1)
        ctx.append(mix(h, k))
        pair.append(mix(ctx[-1] + padded[at], 77))
    return ctx, pair, text


def counted(arr: pa.Array, bits: int = BITS) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of the n-grams of texts, for each order: their cells in order, how often each occurs, and the cell of its context."""
    ctx, pair, _ = contexts(arr)
    shift = np.uint64(64 - bits)
    out = []
    for c, p in zip(ctx, pair):
        cell, first, n = np.unique(p >> shift, return_index=True, return_counts=True)
        out.append((cell.astype(np.int64), n, (c[first] >> shift).astype(np.int64)))
    return out


class Chain:
    """A smoothed chain from the counts of its n-grams; without any all bytes are equally likely."""

    def __init__(self, counts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], bits: int = BITS):
        self.levels, self.shift = [], np.uint64(64 - bits)
        for cell, n, ctx in counts:
            if len(cell):
                seen, at = np.unique(ctx, return_inverse=True)
                self.levels.append((cell.astype(np.uint64), n, seen.astype(np.uint64), np.bincount(at, n), np.bincount(at)))

    def log(self, ctx: list[np.ndarray], pair: list[np.ndarray]) -> np.ndarray:
        """Log-probability of each byte."""
        p = np.full(len(ctx[0]), 1 / 257)
        for (known, n, seen, total, kinds), c, x in zip(self.levels, ctx, pair):
            c, x = c >> self.shift, x >> self.shift
            i = np.minimum(np.searchsorted(seen, c), len(seen) - 1)
            there = seen[i] == c
            j = np.minimum(np.searchsorted(known, x), len(known) - 1)
            count = np.where(known[j] == x, n[j], 0)
            p = np.where(there, (count + kinds[i] * p) / (total[i] + kinds[i]), p)
        return np.log(p)


class Model:
    """Chains of the two classes, calibrated on samples that they haven't counted."""

    def __init__(self, accepted: Chain, rejected: Chain, held: tuple[list[str], list[str]]):
        self.accepted, self.rejected = accepted, rejected
        self.link, self.only = None, float(bool(rejected.levels or held[1]) and not (accepted.levels or held[0]))
        if held[0] and held[1]:
            x = np.concatenate([self.score(strings(pa.array(u, pa.string()))) for u in held])
            self.link = Logistic(x[:, None], np.r_[np.zeros(len(held[0])), np.ones(len(held[1]))])

    def score(self, arr: pa.Array) -> np.ndarray:
        out = [np.zeros(0)]
        for a, b in sliced(arr, SLICE):
            ctx, pair, text = contexts(arr[a:b])
            d = self.rejected.log(ctx, pair) - self.accepted.log(ctx, pair)
            out.append(np.bincount(text, d, b - a) / np.bincount(text, minlength=b - a))
        return np.concatenate(out)

    def probability(self, score: np.ndarray) -> np.ndarray:
        return self.link(score[:, None]) if self.link else np.full(len(score), self.only)


def labelled(pages: DataFrame, words: tuple[str, ...] = REJECTED_WORDS) -> DataFrame:
    """url, rejected: weak labels, by whether a word stands in the host."""
    host = F.lower(F.regexp_extract("url", "^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?#]*)", 1))
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(host, F.lit(w))
    return pages.where("length(url) > 0").select("url", hit.alias("rejected"))


def _merged(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    key, n, ctx = map(np.concatenate, zip(*parts))
    order = np.lexsort((ctx, key))
    key, n, ctx = key[order], n[order], ctx[order]
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[start], np.add.reduceat(n, start), ctx[start]


def chains(urls: DataFrame, bits: int = BITS) -> tuple[Chain, Chain]:
    """The chains of accepted and of rejected URLs (url, rejected): the n-grams of all of them, counted by a grouped aggregation.

    There are 2 * (ORDER + 1) * 2 ** bits cells; they bound what is collected and broadcast, whatever the number of URLs.
    """

    def run(batches):
        held, size = [], 0
        names = ["key", "n", "ctx"]
        for batch in batches:
            rejected = batch.column("rejected").to_numpy(zero_copy_only=False).astype(bool)
            for label in (0, 1):
                arr = strings(batch.column("url").filter(pa.array(rejected == label)))
                for a, b in sliced(arr, SLICE):
                    for level, (cell, n, ctx) in enumerate(counted(arr[a:b], bits)):
                        held.append((cell + ((label * (ORDER + 1) + level) << bits), n, ctx))
                        size += len(cell)
            if size > 2_000_000:
                held = [_merged(held)]
                size = len(held[0][0])
                if size > 1_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], names)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _merged(held)], names)

    rows = urls.select("url", "rejected").mapInArrow(run, "key bigint, n bigint, ctx bigint")
    found = rows.groupBy("key").agg(F.sum("n").alias("n"), F.min("ctx").alias("ctx")).toArrow()
    key, n, ctx = (found.column(c).to_numpy() for c in ("key", "n", "ctx"))
    order = np.argsort(key)
    key, n, ctx = key[order], n[order], ctx[order]
    at = np.searchsorted(key, np.arange(2 * (ORDER + 1) + 1) << bits)
    levels = [(key[a:b] & ((1 << bits) - 1), n[a:b], ctx[a:b]) for a, b in zip(at, at[1:])]
    return Chain(levels[: ORDER + 1], bits), Chain(levels[ORDER + 1 :], bits)


def train(labels: DataFrame, sample: int = SAMPLE, bits: int = BITS) -> Model:
    """Chains from all labelled URLs but every third (by a hash), of which at most `sample` of each class calibrate the score.

    Each distinct URL counts once. Null labels and null or empty URLs are ignored; a class of fewer than three calibrates on what
    it counts.
    """
    rows = labels.where("length(url) > 0 and rejected is not null").select("url", F.col("rejected").cast("boolean").alias("rejected")).distinct()
    rows = saved(rows.withColumn("h", F.xxhash64("url")))
    third = F.pmod("h", F.lit(3)) == 0
    held = [[r.url for r in rows.where(third & (F.col("rejected") == x)).orderBy("h", "url").limit(sample).collect()] for x in (False, True)]
    few = [x for x in (False, True) if len(held[x]) < 3]
    for x in few:  # too few to hold any out, or fewer than three at all
        held[x] = [r.url for r in rows.where(F.col("rejected") == x).orderBy("h", "url").limit(sample).collect()]
    return Model(*chains(rows.where(~third | F.col("rejected").isin(few)) if few else rows.where(~third), bits), tuple(held))


def filtered(pages: DataFrame, labels: DataFrame | None = None, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, score, p_rejected, kept (p_rejected under the threshold): a row for each page.

    pages: page_id, url; labels: url, rejected (by default those of `labelled`); other columns are ignored. A null or empty
    URL has null scores and isn't kept. Rows that repeat each get a row; ids may be null. URLs are scored whole. Without
    rejected samples all have p_rejected 0, without accepted ones 1, and a score of what one model gives.
    """
    prepare(pages.sparkSession)
    model = pages.sparkSession.sparkContext.broadcast(train(labelled(pages) if labels is None else labels, sample))
    out = T.StructType([pages.schema["page_id"], T.StructField("score", T.DoubleType()), T.StructField("p_rejected", T.DoubleType()), T.StructField("kept", T.BooleanType())])

    def run(batches):
        for batch in batches:
            urls = strings(batch.column("url"))
            score = model.value.score(urls)
            p = model.value.probability(score)
            off = np.frombuffer(urls.buffers()[1], np.int64)[urls.offset : urls.offset + len(urls) + 1]
            empty = np.diff(off) == 0
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(score, mask=empty), pa.array(p, mask=empty), pa.array((p < threshold) & ~empty)], out.names)

    return pages.select("page_id", "url").mapInArrow(run, out)
