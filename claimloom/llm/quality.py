"""Quality classifier by compression.

Two zstandard dictionaries are built from good and from bad labelled texts. A text is compressed in chunks with each;
the difference of its compressed sizes over its own size, with its greater compressed ratio and its length, becomes the
calibrated probability that it is good.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .calibrate import Logistic
from .session import prepare
from .words import strings

#: Labelled rows of each class that are used at most, those with the least hash of their id.
SAMPLE = 2000
CHUNK = 400
DICTIONARY = 1 << 16
LEVEL = 3
#: Bytes of a class's text that its dictionary is trained on at most, taken evenly over all its chunks.
TRAIN_BYTES = 6_000_000
SEED = 7
#: Documents whose probability of being good is below this are rejected.
THRESHOLD = 0.15


@lru_cache(4)
def _compressor(raw: bytes) -> zstandard.ZstdCompressor:
    held = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_AUTO)
    held.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_dict_id=False, write_content_size=False, write_checksum=False)


def sizes(text: bytes | memoryview, raw: bytes) -> int:
    """Compressed bytes of all chunks, without the frames' headers."""
    press = _compressor(raw).compress
    return sum(len(press(text[i : i + CHUNK])) - 6 for i in range(0, len(text), CHUNK))


def features(texts: list, good: bytes, bad: bytes) -> np.ndarray:
    """The difference of the compressed sizes over the text's own, the ratio with the less apt dictionary (how repetitive a text is,
    even one that went into a dictionary), and both by the length."""
    g = np.array([sizes(t, good) for t in texts], float)
    b = np.array([sizes(t, bad) for t in texts], float)
    n = np.array([max(len(t), 1) for t in texts], float)
    difference, ratio, size = (b - g) / n, np.log((np.maximum(np.maximum(g, b), 0) + 1) / n), np.log(n)
    return np.stack([difference, ratio, size, ratio * size, difference * size], 1)


def dictionary(texts: list[bytes], train_bytes: int = TRAIN_BYTES) -> bytes:
    """A zstandard dictionary of the texts, of about train_bytes of them; of too few to train one, chunks of the texts themselves.

    Chunks are taken evenly over all texts where they are more than that.
    """
    chunks = [t[i : i + CHUNK] for t in texts for i in range(0, len(t), CHUNK)]

    def evenly(most: int) -> list[bytes]:
        return chunks[:: max(1, -(-sum(map(len, chunks)) // most))]

    try:
        return zstandard.train_dictionary(DICTIONARY, evenly(train_bytes), level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(evenly(DICTIONARY))


class Model:
    """Dictionaries from every other sample, calibrated on the rest."""

    def __init__(self, good: list[bytes], bad: list[bytes], train_bytes: int = TRAIN_BYTES):
        self.good, self.bad = dictionary(good[::2], train_bytes), dictionary(bad[::2], train_bytes)
        held = [(t, 1) for t in good[1::2] or good] + [(t, 0) for t in bad[1::2] or bad]
        self.link = Logistic(features([t for t, _ in held], self.good, self.bad), np.array([y for _, y in held], float)) if good and bad else None
        self.only = float(bool(good) or not bad)

    def __call__(self, texts: list) -> np.ndarray:
        """P(good); without samples of one class all have that of the other, without any all are good."""
        if self.link is None:
            return np.full(len(texts), self.only)
        return self.link(features(texts, self.good, self.bad)) if texts else np.zeros(0)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, train_bytes: int = TRAIN_BYTES) -> Model:
    """Fit on at most `sample` labelled documents of each class, and their dictionaries on about train_bytes of their text.

    Labels other than 0 and 1, and empty texts, are ignored; ids may be of any type.
    """
    ids = labels.where("quality in (0, 1) and doc_id is not null").select("doc_id", "quality").distinct()
    picked = [ids.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for q in (1, 0)]
    picked = picked[0].union(picked[1])  # 2 * sample ids: a bounded side
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").where("length(text) > 0")
    # rows are put in an order of their own, as those that count for training and for calibration alternate
    rows = rows.groupBy("doc_id", "quality", "text").agg(F.xxhash64("doc_id", F.lit(SEED)).alias("h")).collect()
    rows.sort(key=lambda r: (r.h, r.doc_id, r.text))
    return Model([r.text.encode() for r in rows if r.quality == 1], [r.text.encode() for r in rows if r.quality == 0], train_bytes)


def _probabilities(batch: pa.RecordBatch, model: Model) -> pa.Array:
    texts = strings(batch.column("text"))
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1].tolist()
    raw = memoryview(texts.buffers()[2]) if texts.buffers()[2] else memoryview(b"")
    p = model([raw[a:b] for a, b in zip(off, off[1:])])
    return pa.array(p, mask=np.diff(off) == 0)


def scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD, train_bytes: int = TRAIN_BYTES) -> DataFrame:
    """doc_id, p_good and kept (p_good of at least the threshold), a row a document.

    docs: doc_id, text; labels: doc_id, quality (1 good, 0 bad); other columns are ignored. Null and empty texts have a
    null p_good and aren't kept. Ids may be null or repeat, each row stands for itself. Without labels of either class
    p_good is that of the other class, without any 1. Whole texts are compressed, however long.
    """
    prepare(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample, train_bytes))
    out = T.StructType([docs.schema["doc_id"], T.StructField("p_good", T.DoubleType()), T.StructField("kept", T.BooleanType())])

    def run(batches):
        for batch in batches:
            p = _probabilities(batch, model.value)
            kept = pa.array(np.nan_to_num(p.to_numpy(zero_copy_only=False), nan=-1.0) >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), p, kept], out.names)

    return docs.select("doc_id", "text").mapInArrow(run, out)


def good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD, train_bytes: int = TRAIN_BYTES) -> DataFrame:
    """The documents that `scores` keeps, with their columns as they were, whatever their names.

    Each row is judged by its own text: ids may be null or repeat. Null and empty texts go, as they have no probability. Without
    labels of either class all with text go or stay with the other class, without any all with text stay. An empty
    table gives an empty one.
    """
    prepare(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample, train_bytes))

    def run(batches):
        for batch in batches:
            p = _probabilities(batch, model.value).to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(np.nan_to_num(p, nan=-1.0) >= threshold))

    plain = docs.toDF(*(c if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)))  # names with dots can't be passed on
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
