"""Secret scans: character Markov models of random strings and of ordinary identifiers, compared by log-likelihood ratio.

Candidates are runs of letters, digits, +, /, _ and - (with up to two = after them), of at least LENGTH characters, or of SHORTEST or
more where a digit is among them. Both models are smoothed Markov chains of order 2 over characters, trained from
labelled samples: strings drawn at random from the usual alphabets of keys, and ordinary identifiers made of the corpus's
own words, whose letters follow one another as in all words of all documents. A candidate holds a secret when some
span of it, of at least LENGTH characters, has a log-likelihood ratio a character above the threshold that held-out
samples give, so that ordinary characters around a key, as in a path or after a prefix, don't hide it. A shorter run has to
exceed the sum that LENGTH characters at the threshold have by EVIDENCE, so it needs more a character. The secret is
the span that exceeds the threshold by the greatest sum, moved to the separators around it.
"""

from __future__ import annotations

import random
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import fresh, name, prepare
from .words import buffers, sliced, strings

LENGTH = 16
SHORTEST = 8
CANDIDATE = f"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{{{LENGTH},}}+|(?=[A-Za-z+/_-]{{0,{LENGTH - 1}}}[0-9])[A-Za-z0-9+/_-]{{{SHORTEST},{LENGTH - 1}}}+)={{0,2}}"
#: Documents whose words serve as samples at most, those with the least hash of their id.
SAMPLE = 1500
#: Samples of each class.
SAMPLES = 20000
#: Characters of every fourth ordinary sample: spans of long paths and names are held out as well.
LONG = 64
#: Share of the held-out ordinary samples that may lie above the threshold.
FALSE_ALARMS = 0.0005
#: A span whose sum falls by more than this inside is two secrets with ordinary characters between them. In random characters
#: a fall this deep begins at a given place with a chance of exp(-BETWEEN) at most, as of any likelihood ratio.
BETWEEN = 12.0
#: What a run shorter than LENGTH needs besides: an ordinary run has so great a sum with a chance of exp(-EVIDENCE) at most.
EVIDENCE = 12.0
MASK = "[SECRET]"

_ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-="
_KEYS = ("0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", _ALPHABET[:62], _ALPHABET[:64], "abcdefghijklmnopqrstuvwxyz0123456789")
_PIECE = re.compile("[^/_-]+")
_MIXED = re.compile("(?=.*[a-z])(?=.*[A-Z]).*[0-9]")
_COMMON = "get set user name value index count data file path list item config handler request response service client server buffer cache queue index session parse build update delete create find total result error message content version module default max min test example http https www com org html page section article number table column record document source target license token key password access id".split()


def samples(words: list[str], n: int = SAMPLES, seed: int = 17) -> tuple[list[str], list[str]]:
    """Labelled samples: n random strings and n ordinary identifiers."""
    rng = random.Random(seed)
    words = sorted(set(words)) + _COMMON * max(1, len(set(words)) // (4 * len(_COMMON)))
    keys, names = [], []
    for i in range(n):
        keys.append("".join(rng.choice(_KEYS[i % len(_KEYS)]) for _ in range(rng.randint(LENGTH, 64))))
        kind, name = i % 8, ""
        least = LONG if i // 8 % 4 == 0 else LENGTH
        while len(name) < least:
            w = rng.choice(words)
            if kind == 0:
                name += w
            elif kind == 1:
                name += w.upper()
            elif kind == 2:
                name += w.capitalize()
            elif kind == 3:
                name += ("_" if name else "") + w
            elif kind == 4:
                name += ("-" if name else "") + w
            elif kind == 5:
                name += ("/" if name else "") + rng.choice([w, w, str(rng.randint(0, 2050))])
            elif kind == 6:
                name += w + rng.choice(["", "_", "-"]) + rng.choice(["", "", str(rng.randint(0, 99))])
            else:
                name += str(rng.randint(0, 10**18)) if rng.random() < 0.7 else "-_="[rng.randrange(3)] * LENGTH
        names.append(name)
    rng.shuffle(keys)  # so that every kind is among those held out
    rng.shuffle(names)
    return keys, names


def _codes(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Contexts of two characters and the characters after them, of all tokens in turn; two marks precede each token."""
    table = np.zeros(128, np.int64)
    for i, c in enumerate(_ALPHABET):
        table[ord(c)] = i + 1
    size = len(_ALPHABET) + 1
    raw = np.frombuffer("".join("\0\0" + t for t in tokens).encode("ascii", "replace"), np.uint8) & 127
    c = table[raw]
    at = np.flatnonzero(raw != 0)
    return c[at - 2] * size + c[at - 1], c[at]


_LETTERS = np.array([0] + [_ALPHABET.index(c) + 1 for c in _ALPHABET[:26]])
_CAPITALS = np.array([0] + [_ALPHABET.index(c) + 1 for c in _ALPHABET[26:52]])


def letter_counts(docs: DataFrame) -> np.ndarray:
    """Of all words of ASCII letters in all documents, lower-cased: how often each letter follows each two before it (27 x 27 x 27;
    0 stands for what is before a word). Tasks count their own; what moves is bounded by the number of cells."""
    spark = docs.sparkSession
    prepare(spark)

    def run(batches):
        total = np.zeros(27**3, np.int64)
        for batch in batches:
            texts = strings(batch.column(0))
            for a, b in sliced(texts):
                data, off = buffers(texts[a:b])
                low = data | np.uint8(32)
                x = np.where((low >= 97) & (low <= 122) & (data < 128), low - 96, 0).astype(np.int32)
                padded = np.zeros(len(x) + 2 * len(off), np.int32)  # two marks before each text
                padded[np.arange(len(x)) + 2 * np.repeat(np.arange(1, len(off)), np.diff(off))] = x
                one, two, three = padded[:-2], padded[1:-1], padded[2:]
                one = np.where(two > 0, one, 0)
                total += np.bincount(((one * 27 + two) * 27 + three)[three > 0], minlength=27**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])

    found = docs.select("text").mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(27**3)
    for r in found:
        counts[r.cell] = r.n
    return counts.reshape(27, 27, 27)


class Chain:
    """Markov chain of order 2, interpolated with those of order 1 and 0 (Witten-Bell).

    With `letters`, a letter after two letters, or in a word's first places, counts as often again as the tokens have it, in the
    proportions of `letters`.
    """

    def __init__(self, tokens: list[str], letters: np.ndarray | None = None):
        size = len(_ALPHABET) + 1
        ctx, c = _codes(tokens)
        n2 = np.bincount(ctx * size + c, minlength=size**3).reshape(-1, size).astype(float)
        if letters is not None and letters.sum():
            cube = n2.reshape(size, size, size)
            for case in (_LETTERS, _CAPITALS):
                at = np.ix_(case, case, case[1:])
                cube[at] += letters[:, :, 1:] * (cube[at].sum() / letters[:, :, 1:].sum())
        n1 = n2.reshape(size, size, size).sum(0)
        n0 = n1.sum(0)
        p0 = (n0 + 0.5) / (n0.sum() + 0.5 * size)
        p1 = (n1 + (n1 > 0).sum(1)[:, None] * p0 + 1e-6 * p0) / (n1.sum(1) + (n1 > 0).sum(1) + 1e-6)[:, None]
        back = np.tile(p1, (size, 1))
        kinds = (n2 > 0).sum(1)[:, None]
        self.log = np.log((n2 + kinds * back + 1e-6 * back) / (n2.sum(1)[:, None] + kinds + 1e-6))


class Model:
    def __init__(self, keys: list[str], names: list[str], false_alarms: float = FALSE_ALARMS, letters: np.ndarray | None = None):
        self.ratio = Chain(keys[::2]).log - Chain(names[::2], letters).log
        held = np.sort(self.score(names[1::2]))
        self.threshold = float(max(0.0, held[int(len(held) * (1 - false_alarms)) - 1]))

    def score(self, tokens: list[str]) -> np.ndarray:
        """Greatest log-likelihood ratio a character, random over ordinary, of the spans of LENGTH characters or more.

        A span of twice that length or more has a half that is no worse, so longer ones needn't be tried. A shorter token is one span,
        whose sum less EVIDENCE counts as that of LENGTH characters.
        """
        if not tokens:
            return np.zeros(0)
        ctx, c = _codes(tokens)
        n = np.array([len(t) for t in tokens])
        start = np.r_[0, np.cumsum(n)[:-1]]
        total = np.r_[0.0, np.cumsum(self.ratio[ctx, c])]
        left = np.repeat(start + n, n) - np.arange(len(c))  # characters from each place to the end of its token
        best = np.full(len(c), -np.inf)
        for size in range(LENGTH, min(2 * LENGTH, int(n.max()) + 1)):
            at = np.flatnonzero(left >= size)
            best[at] = np.maximum(best[at], (total[at + size] - total[at]) / size)
        return np.where(n < LENGTH, (total[start + n] - total[start] - EVIDENCE) / LENGTH, np.maximum.reduceat(best, start))

    def spans(self, token: str) -> list[tuple[int, int, float]]:
        """(start, end, ratio a character) of the secrets in a token, in order; they don't overlap."""
        if len(token) < LENGTH:
            score = float(self.score([token])[0])
            return [(0, len(token), score)] if score > self.threshold else []
        ctx, c = _codes([token])
        over = np.r_[0.0, np.cumsum(self.ratio[ctx, c] - self.threshold)]
        pieces = [m.span() for m in _PIECE.finditer(token)]
        out, todo = [], [(0, len(token), 0, len(token))]
        while todo:
            lo, hi, low, high = todo.pop()  # where to search, and how far a find may be widened
            if hi - lo < LENGTH:
                continue
            least = np.minimum.accumulate(over[lo : hi - LENGTH + 1])
            gain = over[lo + LENGTH : hi + 1] - least
            end = int(gain.argmax())
            if gain[end] <= 1e-9:
                continue
            a, b = lo + int(over[lo : lo + end + 1].argmin()), lo + LENGTH + end
            fall = np.maximum.accumulate(over[a : b + 1]) - over[a : b + 1]
            trough = a + int(fall.argmax())
            peak = a + int(over[a : trough + 1].argmax())
            if fall.max() > BETWEEN and max(peak - a, b - trough) >= LENGTH:
                todo += [(lo, peak, low, trough), (trough, hi, peak, high)]
                continue
            score = float((over[b] - over[a]) / (b - a) + self.threshold)
            a, b = _snapped(a, b, low, high, over, pieces, bool(_MIXED.match(token[a:b])))
            out.append((a, b, score))
            todo += [(lo, a, low, a), (b, hi, b, high)]
        out.sort()
        return [(max(a, out[i - 1][1]) if i else a, b, s) for i, (a, b, s) in enumerate(out)]


def _snapped(a: int, b: int, lo: int, hi: int, over: np.ndarray, pieces: list[tuple[int, int]], mixed: bool) -> tuple[int, int]:
    """The span from a to b, widened to whole pieces between separators where most of a piece is in it or looks random, and
    without the few characters of an ordinary piece at its ends. Keys of mixed alphabets (base 64) may hold separators
    themselves, so next to those the shortest pieces count as random."""
    pieces = [(max(s, lo), min(e, hi)) for s, e in pieces if s < hi and e > lo]
    random_looking = [over[e] > over[s] or mixed and e - s <= 3 for s, e in pieces]
    shared = [min(e, b) - max(s, a) for s, e in pieces]
    kept = [i for i, (s, e) in enumerate(pieces) if shared[i] > 0 and (random_looking[i] or shared[i] * 2 >= e - s or shared[i] >= LENGTH)]
    if not kept:
        return a, b
    first, last = kept[0], kept[-1]
    while first and random_looking[first - 1]:
        first -= 1
    while last + 1 < len(pieces) and random_looking[last + 1]:
        last += 1

    def whole(i):
        return random_looking[i] or shared[i] * 2 >= pieces[i][1] - pieces[i][0]

    start = pieces[first][0] if whole(first) else max(a, pieces[first][0])
    end = pieces[last][1] if whole(last) else min(b, pieces[last][1])
    return start, end


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Ordinary identifiers are made of words of four letters or more, without digits, in at most `sample` documents; how letters
    follow one another is counted over all documents."""
    ids = docs.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    words = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("(?<![a-z0-9])([a-z]{4,})(?![a-z0-9])"), 1)).alias("w"))
    words = [r.w for r in words.distinct().orderBy(F.xxhash64("w"), "w").limit(SAMPLES).collect()]
    return Model(*samples(words), letters=letter_counts(docs))


def _secrets(model, tokens: Column) -> Column:
    """The secrets of an array of candidates: the candidate's place, start and end in it, the secret and its score; null if there are none."""

    @F.pandas_udf("array<struct<token int, start int, end int, secret string, score double>>")
    def pick(column: pd.Series) -> pd.Series:
        m = model.value
        n = [0 if x is None else len(x) for x in column]
        tokens = [t for x in column if x is not None for t in x]
        score = m.score(tokens)
        out, a = [], 0
        for k in n:
            found = [{"token": i - a, "start": x, "end": y, "secret": tokens[i][x:y], "score": s} for i in range(a, a + k) if score[i] > m.threshold for x, y, s in m.spans(tokens[i])]
            out.append(found or None)
            a += k
        return pd.Series(out, dtype=object)

    return pick(tokens)


def _located(docs: DataFrame, sample: int) -> tuple[DataFrame, str]:
    """docs with an array of the secrets in each text, with their places in it by characters, and that column's name."""
    prepare(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(train(docs.select("doc_id", "text"), sample))
    found = fresh(docs, "secrets_")
    tokens = F.regexp_extract_all(F.col("text"), F.lit(CANDIDATE), 0)
    rows = docs.withColumn(found, _secrets(model, tokens))
    between = F.split("text", CANDIDATE, -1)

    def placed(views: Column) -> Column:
        # characters before each candidate, counted up
        ends = F.aggregate(
            F.zip_with(views["between"], views["tokens"], lambda b, t: F.struct(F.length(b).alias("b"), F.coalesce(F.length(t), F.lit(0)).alias("t"))),
            F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")),
            lambda s, x: F.struct((s["at"] + x["b"] + x["t"]).alias("at"), F.concat(s["starts"], F.array(s["at"] + x["b"])).alias("starts")),
            lambda s: s["starts"],
        )
        return F.transform(F.array(ends), lambda at: F.transform(F.col(found), lambda s: F.struct((F.get(at, s["token"]) + s["start"]).alias("start"), (F.get(at, s["token"]) + s["end"]).alias("end"), s["secret"].alias("secret"), s["score"].alias("score"))))[0]

    where = F.transform(F.array(F.struct(between.alias("between"), tokens.alias("tokens"))), placed)[0]
    return rows.withColumn(found, F.when(F.col(found).isNotNull(), where)), found


def scan(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, place (0 for the first secret of a document), start, end (characters), secret, score: a row for each secret found.

    docs: doc_id, text; other columns are ignored. Null and empty texts have none. A string that occurs twice in a text
    is reported twice, and rows that repeat are each scanned; ids may be null. Runs of digits alone are ordinary: numbers. Very long
    texts are scanned whole. An empty table gives an empty one.
    """
    rows, found = _located(docs.select("doc_id", "text"), sample)
    rows = rows.where(F.col(found).isNotNull()).select("doc_id", F.posexplode(found).alias("place", "s"))
    longs = [F.col(c).cast("bigint").alias(n) for c, n in (("place", "place"), ("s.start", "start"), ("s.end", "end"))]
    return rows.select("doc_id", *longs, "s.secret", "s.score")


def redact(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs with every secret that `scan` finds replaced by MASK at its place, and n_chars, if there is one, counted again where
    the text changed. The same string elsewhere, where it is no secret, is left.

    All rows and columns stay, whatever the columns' names. Null and empty texts, and texts without secrets, are as they were.
    """
    rows, found = _located(docs, sample)
    changed = fresh(rows, "redacted_")
    # from the last secret to the first, so that the places before stay true
    cut = lambda t, s: F.concat(F.left(t, s["start"]), F.lit(MASK), F.substring(t, s["end"] + 1, F.length(t)))
    text = F.aggregate(F.reverse(found), F.col("text"), cut)
    rows = rows.withColumn(changed, F.when(F.col(found).isNotNull(), text).otherwise(F.col("text")))
    now = {"text": F.col(changed)}
    if "n_chars" in docs.columns:
        now["n_chars"] = F.when(F.col(found).isNotNull(), F.length(changed).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return rows.select(*(now.get(c, name(c)).alias(c) for c in docs.columns))
