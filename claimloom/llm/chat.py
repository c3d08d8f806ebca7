"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, encoded once with the characters' offsets, and the spans to train on (the bodies of
assistant turns with their end marks), which are sorted, are intersected with the token spans by binary search.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .session import prepare

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
START, BODY, END = "<|", "|>\n", "<|end|>\n"
TRAINED = ("assistant",)
#: Conversations that are encoded at once.
BATCH = 64


def render(turns: list[tuple[str, str]], trained: tuple[str, ...] = TRAINED) -> tuple[str, list[tuple[int, int]]]:
    """The text of a conversation and the sorted character spans to train on."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, tail = f"{START}{role}{BODY}", text + END
        if role in trained:
            spans.append((at + len(head), at + len(head) + len(tail)))
        parts += [head, tail]
        at += len(head) + len(tail)
    return "".join(parts), spans


def mask(offsets: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """1 for each token, of offsets (n x 2), that shares a character with a span."""
    if not spans or not len(offsets):
        return np.zeros(len(offsets), np.int32)
    start, end = np.array(spans).T
    at = np.searchsorted(end, offsets[:, 0], "right")
    first = np.r_[start, np.iinfo(np.int64).max][at]
    return ((first < offsets[:, 1]) & (offsets[:, 0] < offsets[:, 1])).astype(np.int32)


@lru_cache(2)
def _tokenizer(path: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def encode(texts: list[str], path: str = TOKENIZER) -> list[tuple[np.ndarray, np.ndarray]]:
    """Ids and offsets of each text."""
    found = _tokenizer(path).encode_batch(texts, add_special_tokens=False)
    return [(np.array(e.ids, np.int32), np.array(e.offsets, np.int64).reshape(-1, 2)) for e in found]


def formatted(turns: DataFrame, path: str = TOKENIZER, trained: tuple[str, ...] = TRAINED) -> DataFrame:
    """conv_id, n_turns, n_tokens, n_trained, token_ids, loss_mask: a row a conversation.

    turns: conv_id, turn, role, text; other columns are ignored. Turns go by number (null first), then role, then text;
    repeated rows are repeated turns. A null text is empty and a null role `unknown`. Turns with a null conv_id make one
    conversation. An empty table gives an empty one. The path must exist on the executors.
    """
    prepare(turns.sparkSession)
    row = F.struct(F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    talks = turns.select("conv_id", row.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t"), _in_turn).alias("turns"))
    longs = [T.StructField(c, T.LongType()) for c in ("n_turns", "n_tokens", "n_trained")]
    lists = [T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("token_ids", "loss_mask")]
    out = T.StructType([turns.schema["conv_id"], *longs, *lists])

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, BATCH):
                part = batch.slice(a, BATCH)
                talks = part.column("turns").to_pylist()
                texts = [render([(t["role"], t["text"]) for t in talk], trained) for talk in talks]
                tokens = encode([t for t, _ in texts], path)
                masks = [mask(o, s) for (_, o), (_, s) in zip(tokens, texts)]
                off = pa.array(np.r_[0, np.cumsum([len(i) for i, _ in tokens])].astype(np.int32))
                flat = [pa.array(np.concatenate(x)) for x in ([i for i, _ in tokens], masks)]
                counts = [[len(t) for t in talks], [len(m) for m in masks], [int(m.sum()) for m in masks]]
                yield pa.RecordBatch.from_arrays([part.column("conv_id"), *(pa.array(c, pa.int64()) for c in counts), *(pa.ListArray.from_arrays(off, f) for f in flat)], out.names)

    return talks.mapInArrow(run, out)


def _in_turn(a, b):
    order = F.lit(0)
    for c in ("text", "role", "turn"):
        x, y = a[c], b[c]
        order = F.when(x.eqNullSafe(y), order).when(x.isNull(), -1).when(y.isNull(), 1).when(x < y, -1).otherwise(1)
    return order
