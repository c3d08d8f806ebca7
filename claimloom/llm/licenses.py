"""Fuzzy search for short licence notices.

A notice may differ from its model by up to EDITS[n] insertions, deletions or substitutions. It is split into one piece
more than that: of any occurrence at least one piece is exact (pigeonhole). One automaton finds all pieces of all
notices in a single pass; around each find, the regex library's bounded-error matching verifies the whole notice and
reports its span and edits.
"""

from __future__ import annotations

from collections import defaultdict
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .session import prepare

#: Name and wording of each notice.
NOTICES = (
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-2.0", "under the terms of the GNU General Public License, version 2"),
    ("LGPL", "under the terms of the GNU Lesser General Public License"),
    ("AGPL-3.0", "licensed under the GNU Affero General Public License"),
    ("MPL-2.0", "subject to the terms of the Mozilla Public License, v. 2.0"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-4.0", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC0-1.0", "dedicated to the public domain under CC0 1.0 Universal"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("Proprietary", "All rights reserved. No part of this publication may be reproduced"),
    ("Proprietary", "All rights reserved"),
)
#: Characters of a notice for each edit that is allowed.
CHARS_PER_EDIT = 12


def edits(notice: str) -> int:
    return max(1, len(notice) // CHARS_PER_EDIT)


def pieces(notice: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces of nearly equal length, with their places."""
    cut = [len(notice) * i // (k + 1) for i in range(k + 2)]
    return [(a, notice[a:b]) for a, b in zip(cut, cut[1:])]


def folded(text: str) -> str:
    """Lower case, character for character."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) != 1 else c.lower() for c in text)


@lru_cache(8)
def _machine(notices: tuple[tuple[str, str], ...]):
    import ahocorasick

    seeds = defaultdict(list)
    patterns = []
    for i, (_, wording) in enumerate(notices):
        low, k = folded(wording), edits(wording)
        patterns.append((len(low), k, regex.compile(f"(?e)(?:{regex.escape(low, special_only=True)}){{e<={k}}}")))
        for at, piece in pieces(low, k):
            seeds[piece].append((i, at))
    automaton = ahocorasick.Automaton()
    for piece, places in seeds.items():
        automaton.add_word(piece, (len(piece), tuple(places)))
    automaton.make_automaton()
    return automaton, patterns


def find(text: str, notices: tuple[tuple[str, str], ...] = NOTICES) -> list[tuple[int, int, int, int]]:
    """(notice, start, end, edits) of all occurrences in a text; those of one notice don't overlap."""
    automaton, patterns = _machine(notices)
    low = folded(text)
    windows = defaultdict(list)
    for end, (size, places) in automaton.iter(low):
        for i, at in places:
            n, k, _ = patterns[i]
            start = end + 1 - size - at - k
            windows[i].append((start, start + n + 2 * k))
    out = []
    for i, spans in windows.items():
        spans.sort()
        merged = [spans[0]]
        for a, b in spans[1:]:
            if a <= merged[-1][1]:
                merged[-1] = merged[-1][0], max(b, merged[-1][1])
            else:
                merged.append((a, b))
        for a, b in merged:
            for m in patterns[i][2].finditer(low, max(a, 0), min(b, len(low))):
                out.append((i, m.start(), m.end(), sum(m.fuzzy_counts)))
    return sorted(out, key=lambda x: (x[1], x[0]))


def scan(docs: DataFrame, notices: tuple[tuple[str, str], ...] = NOTICES) -> DataFrame:
    """doc_id, license, notice (its number), start, end (characters), edits, matched: a row for each occurrence.

    docs: doc_id, text; other columns are ignored. Case doesn't count as an edit. Null and empty texts have none; rows that
    repeat are each scanned; ids may be null. Whole texts are searched. Of one notice, occurrences don't overlap; those of
    different notices may.
    """
    prepare(docs.sparkSession)
    notices = tuple(notices)
    fields = [("license", T.StringType()), ("notice", T.LongType()), ("start", T.LongType()), ("end", T.LongType()), ("edits", T.LongType()), ("matched", T.StringType())]
    out = T.StructType([docs.schema["doc_id"], *(T.StructField(n, t) for n, t in fields)])

    def run(batches):
        for batch in batches:
            row, cols = [], [[] for _ in fields]
            texts = batch.column("text")
            for r in range(batch.num_rows):
                text = texts[r].as_py()
                for i, a, b, e in find(text, notices) if text else ():
                    row.append(r)
                    for c, v in zip(cols, (notices[i][0], i, a, b, e, text[a:b])):
                        c.append(v)
            if row:
                kinds = [pa.string(), *[pa.int64()] * 4, pa.string()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row)), *(pa.array(c, k) for c, k in zip(cols, kinds))], out.names)

    return docs.select("doc_id", "text").mapInArrow(run, out)
