"""Tokens of claims and what follows from them alone, in Python: a word is normalised once and then looked up."""

from __future__ import annotations

import re
from collections import Counter
from heapq import nlargest, nsmallest

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import workers
from . import lexicon as lx

#: Words that are remembered, and tokens whose counts are held before they are passed on.
MOST = 1 << 20
RAW = re.compile("[%0-9a-z가-힣]+")
EXPANSIONS = tuple(
    (tuple(sorted(a.split())), tuple(b.split()))
    for a, b in (("guarantee percent saving water", "water saving"), ("cost drift maintenance probe", "maintenance reliability"), ("cause prove soil software yield", "yield causality"), ("adoption policy", "policy adoption"))
)
FIELDS = {"tokens": "array<string>", "canonical": "string", "token_set": "array<string>", "group_key": "string"}


def stem(x: str) -> str:
    if x.endswith("ies") and len(x) > 5:
        return x[:-3] + "y"
    if x.endswith("ing") and len(x) > 6:
        return x[:-3]
    if x.endswith("ed") and len(x) > 5:
        return x[:-2]
    return x[:-1] if x.endswith("s") and len(x) > 4 and not x.endswith("ss") else x


class Words(dict):
    """Word to token: synonyms, one suffix rule, synonyms again; '' for stop words and words under three characters."""

    def __init__(self):
        super().__init__()
        self.same, self.stop = lx.pairs("synonym"), frozenset(lx.markers("stopword"))

    def __missing__(self, word: str) -> str:
        x = stem(self.same.get(word, word))
        x = self.same.get(x, x)
        x = x if len(x) >= 3 and x not in self.stop else ""
        if len(self) >= MOST:
            self.clear()
        self[word] = x
        return x

    def tokens(self, text: str) -> list[str]:
        """Of a text that is folded()."""
        return list(filter(None, map(self.__getitem__, RAW.findall(text))))


def kind_of(content_type: str | None) -> str:
    return "" if content_type == "other" else content_type or ""


def token_set(tokens: list[str], kind: str) -> list[str]:
    """Sorted distinct tokens with those that they imply, and the content type unless it is `other` or empty."""
    out = set(tokens)
    more = [b for a, b in EXPANSIONS if not out.isdisjoint(a)]
    out.update(*more)
    if kind:
        out.add(kind)
    return sorted(out)


def group_key(tokens: list[str], kind: str) -> str:
    """`topic_` and the four most frequent tokens, earlier ones first; the content type or generic_claim without tokens."""
    if not tokens:
        return kind or "generic_claim"
    n = Counter(tokens)
    return "topic_" + "_".join(tokens[:4] if len(n) == len(tokens) else nlargest(4, n, key=n.__getitem__))


def folded(text: Column) -> Column:
    """Lower case, with the two phrases that are one token."""
    low = F.lower(text)
    one = F.regexp_replace(F.regexp_replace(low, r"\btwenty percent\b", "20 percent"), r"\bper cent\b", "percent")
    return F.when(F.contains(low, F.lit("twenty percent")) | F.contains(low, F.lit("per cent")), one).otherwise(low)


def terms(text: Column, content_type: Column, *fields: str) -> Column:
    """struct of those of FIELDS that are asked for; they are null where the text is."""
    workers(SparkSession.active())
    make = {"tokens": lambda t, k: t, "canonical": lambda t, k: " ".join(t), "token_set": token_set, "group_key": group_key}
    words: list[Words] = []

    @F.arrow_udf(f"struct<{', '.join(f'{f}: {FIELDS[f]}' for f in fields)}>")
    def found(texts: pa.Array, kinds: pa.Array) -> pa.Array:
        if not words:
            words.append(Words())
        of = words[0].tokens
        rows = [(None if t is None else of(t), kind_of(k)) for t, k in zip(texts.to_pylist(), kinds.to_pylist())]
        out = [[None if t is None else make[f](t, k) for t, k in rows] for f in fields]
        return pa.StructArray.from_arrays([pa.array(x, pa.string()) if FIELDS[f] == "string" else lx.lists_of(x) for f, x in zip(fields, out)], list(fields))

    return found(folded(text), content_type)


def most_held(tokens: Column) -> Column:
    """`topic_` and the four most frequent of a group's tokens, of equal ones the first by name; null without any."""
    workers(SparkSession.active())

    @F.arrow_udf("string")
    def found(groups: pa.Array) -> pa.Array:
        counts = map(Counter, groups.to_pylist())
        return pa.array(["topic_" + "_".join(t for _, t in nsmallest(4, ((-n, t) for t, n in c.items()))) if c else None for c in counts], pa.string())

    return found(tokens)


def line_counts(lines: DataFrame) -> DataFrame:
    """token, df: in how many of the lines (text) each token is; counted where the lines are read, and then added up."""
    workers(lines.sparkSession)

    def count(batches):
        words, n = Words(), Counter()
        rows = lambda: pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["token", "n"])
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    n.update(set(words.tokens(text)))
            if len(n) >= MOST:
                yield rows()
                n.clear()
        yield rows()

    return lines.select(folded(F.col("text")).alias("text")).mapInArrow(count, "token string, n bigint").groupBy("token").agg(F.sum("n").alias("df"))
