"""Cues into sentences as they arrive: the rules of operators.assembly on a stream, with a state for each video.

Cues of a video are taken in the order of their numbers within a micro-batch, and must reach it in that order from one to
the next. What is left of a video is a unit once nothing came for `idle_ms` of processing time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators.assembly import MAX_CHARS, MAX_SPAN

OUT = "video_id string, text string, start double, end double, cue_indices array<int>"
STATE = "text string, start double, end double, cues array<int>"


def sentences(cues: DataFrame, max_chars: int = MAX_CHARS, max_span: float = MAX_SPAN, idle_ms: int = 60_000) -> DataFrame:
    """video_id, text, start, end, cue_indices of a stream of cues (video_id, cue_ord, text, start, end)."""
    piece = tx.squeeze(F.coalesce("text", F.lit("")))
    rows = cues.select("video_id", F.col("cue_ord").cast("int").alias("cue_ord"), piece.alias("text"), F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), tx.ends_sentence(piece).alias("final")).where("text <> ''")

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        text, start, end, held = state.get if state.exists else ("", None, None, [])
        held, units = list(held), []
        if state.hasTimedOut:
            state.remove()
            units, held = [(key[0], text, start, end, held)], []
        else:
            got = pd.concat(list(batches)).sort_values("cue_ord")
            for c in got.itertuples():
                a, b = (None if pd.isna(x) else float(x) for x in (c.start, c.end))
                text = f"{text} {c.text}" if held else c.text
                start, end = a if start is None else start, end if b is None else b
                held.append(int(c.cue_ord))
                if c.final or len(text) >= max_chars or b is not None and start is not None and b - start >= max_span:
                    units.append((key[0], text, start, end, held))
                    text, start, end, held = "", None, None, []
            if held:
                state.update((text, start, end, held))
                state.setTimeoutDuration(idle_ms)
            elif state.exists:
                state.remove()
        if units:
            yield pd.DataFrame(units, columns=["video_id", "text", "start", "end", "cue_indices"])

    return rows.groupBy("video_id").applyInPandasWithState(run, OUT, STATE, "append", "ProcessingTimeTimeout")


def words_by_window(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Words counted by claim and window of event time (claim_id, ts, word), late ones within a watermark."""
    rows = events.withWatermark("ts", late).groupBy("claim_id", F.window("ts", window).alias("w"))
    return rows.agg(F.count("*").alias("words")).select("claim_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "words")
