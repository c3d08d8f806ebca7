"""Best-fit packing of documents into sequences, after a Martello-Toth dominance reduction.

A document's length is its number of UTF-8 bytes (the tokens of a byte-level vocabulary), or any other column. What
exceeds the capacity is cut into full pieces and a rest. The plan is made on the histogram of lengths, whose size the
capacity bounds whatever the number of documents: sets of up to three pieces that dominate every alternative are fixed
as bins for good, then the remaining lengths go, longest first, to the bin that they fill best. Placements of equal
lengths are kept as runs, and each piece finds its own by its rank among the pieces of its length.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import attach, prepare, saved

CAPACITY = 8192
#: Pieces of one length are ranked in as many parts as hold about so many pieces each; the parts' counts are added up.
PART_ROWS = 100_000


def reduce(count: np.ndarray, capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Take out the sets of pieces that dominate: (how many bins, their lengths). count, by length, is changed.

    For a longest piece j of length w, of what else is left: if nothing fits beside it, {j} is a bin. If at most one
    piece does, or one fills the bin exactly, j goes with the longest that fits. If at most two do, j goes with the
    longest single one, r, where that is as long as the best pair (a, b), or with that pair where a is as long as r and
    no two pieces longer than b, apart from a, fit together.
    """
    fixed = []

    def least(n: int) -> list[int]:
        """The n smallest lengths left, with repetitions."""
        out: list[int] = []
        for x in np.flatnonzero(count)[:n]:
            out += [int(x)] * min(int(count[x]), n - len(out))
        return out

    def longest(room: int) -> int:
        at = np.flatnonzero(count[: room + 1])
        return int(at[-1]) if len(at) else 0

    def fix(*lengths: int) -> None:
        times = min(int(count[x]) // lengths.count(x) for x in set(lengths) if lengths.count(x))
        for x in lengths:
            count[x] -= times
        fixed.append((times, lengths))

    for w in range(capacity, 0, -1):
        room = capacity - w
        while count[w]:
            count[w] -= 1
            small, r = least(3), longest(room)
            pair = None
            if small[1:] and sum(small[:3]) > room >= sum(small[:2]) or len(small) == 2 and sum(small) <= room:
                pair = _best_pair(count, room)
            again = count[r] if r else 0
            count[w] += 1
            if not r:
                fixed.append((int(count[w]), (w,)))
                count[w] = 0
            elif len(small) < 2 or sum(small[:2]) > room or r == room:
                if not again:
                    break
                fix(w, r)
            elif pair and r >= sum(pair):
                fix(w, r)
            elif pair and pair[0] == r and not _two_fit(count, w, pair, room):
                fix(w, *pair)
            else:
                break
    return fixed


def _best_pair(count: np.ndarray, room: int) -> tuple[int, int] | None:
    """Lengths a >= b that fit in room together and fill it best."""
    have = np.flatnonzero(count[: room + 1])
    best = None
    for a in have[::-1]:
        a = int(a)
        if best and 2 * a <= sum(best):
            break
        rest = [int(b) for b in have[: np.searchsorted(have, min(a, room - a), "right")][-2:]]
        rest = [b for b in rest if b != a or count[a] > 1]
        if rest and (best is None or a + rest[-1] > sum(best)):
            best = a, rest[-1]
    return best


def _two_fit(count: np.ndarray, w: int, pair: tuple[int, int], room: int) -> bool:
    """Whether two pieces longer than the pair's second fit, of all but one of length w and the pair's first."""
    longer: list[int] = []
    for x in np.flatnonzero(count[: room + 1]):
        x = int(x)
        if x > pair[1]:
            longer += [x] * min(2, int(count[x]) - (x == w) - (x == pair[0]))
        if len(longer) >= 2:
            return sum(longer[:2]) <= room
    return False


def plan(count: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Runs of placements, and the number of bins.

    A row: length, rank of the run's first piece, pieces, first bin, pieces a bin, offset of the first piece in a bin.
    """
    count = count.copy()
    runs, bins = [], 0
    done = np.zeros(capacity + 1, np.int64)

    def place(w: int, n: int, first: int, each: int, offset: int) -> None:
        runs.append((w, int(done[w]), n, first, each, offset))
        done[w] += n

    for times, lengths in reduce(count, capacity):
        offset = 0
        for w in dict.fromkeys(lengths):
            each = lengths.count(w)
            place(w, times * each, bins, each, offset)
            offset += each * w
        bins += times
    free: dict[int, list[tuple[int, int]]] = defaultdict(list)  # by room left: runs of bins, (first, how many)
    has = np.zeros(capacity + 1, bool)
    for w in range(capacity, 0, -1):
        left = int(count[w])
        while left:
            room = w + int(has[w:].argmax())  # the least room that w fits; what it leaves is below w
            if has[room]:
                first, n = free[room].pop()
                has[room] = bool(free[room])
            else:
                room, first, n = capacity, bins, -(-left // (capacity // w))
                bins += n
            each = room // w
            full = min(n, left // each)
            if full:
                place(w, full * each, first, each, capacity - room)
                left -= full * each
                if room - each * w:
                    free[room - each * w].append((first, full))
                    has[room - each * w] = True
            rest, first = n - full, first + full
            if rest and left:  # fewer than fill a bin
                place(w, left, first, left, capacity - room)
                free[room - left * w].append((first, 1))
                has[room - left * w] = True
                left, rest, first = 0, rest - 1, first + 1
            if rest:
                free[room].append((first, rest))
                has[room] = True
    return np.array(runs, np.int64).reshape(-1, 6), bins


def packed(docs: DataFrame, capacity: int = CAPACITY, length: Column | None = None, part_rows: int = PART_ROWS) -> DataFrame:
    """doc_id, piece, start, length, bin_id, bin_offset: a row for each piece of each document, all bigint but the id.

    start and length place the piece in its document, bin_id and bin_offset in the sequences. docs: doc_id, text; other
    columns are ignored. Null and empty texts have no piece. Rows that repeat, or repeat an id, are packed one by one; ids
    may be null. Equal lengths are interchangeable and are ranked by id, within parts of about part_rows of
    them that are drawn at random where there are more.
    """
    spark = docs.sparkSession
    prepare(spark)
    n = F.coalesce((F.octet_length("text") if length is None else length).cast("bigint"), F.lit(0))
    rows = docs.select("doc_id", n.alias("_n")).where("_n > 0")
    pieces = rows.select("doc_id", F.posexplode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / capacity))).alias("piece", "_at"), "_n")
    pieces = pieces.select("doc_id", F.col("piece").cast("bigint").alias("piece"), (F.col("_at") * capacity).cast("bigint").alias("start"), F.least(F.lit(capacity).cast("bigint"), F.col("_n") - F.col("_at") * capacity).alias("length"))
    pieces = saved(pieces.withColumn("_row", F.monotonically_increasing_id()))
    total = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect():  # a row a length at most
        total[r["length"]] = r["n"]
    # lengths of many pieces, full pieces above all, are ranked in many parts
    parts = spark.createDataFrame([(i, int(-(-total[i] // part_rows))) for i in np.flatnonzero(total > part_rows).tolist()], "length bigint, _parts int")
    part = F.pmod(F.xxhash64("_row"), F.coalesce("_parts", F.lit(1))).cast("int")
    pieces = pieces.join(F.broadcast(parts), "length", "left").withColumn("_part", part).drop("_parts", "_row")
    counts = saved(pieces.groupBy("length", "_part").agg(F.count("*").alias("_count")))
    runs, _ = plan(total, capacity)
    order = np.lexsort((runs[:, 1], runs[:, 0]))
    held = spark.sparkContext.broadcast(runs[order])
    before = F.coalesce(F.sum("_count").over(Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = pieces.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_part").orderBy("doc_id", "piece", "start")))
    ranked = attach(ranked, saved(counts.select("length", "_part", before.alias("_before"))), ["length", "_part"], 40)
    ranked = ranked.select("doc_id", "piece", "start", "length", (F.col("_before") + F.col("_rank") - 1).alias("_rank"))
    out = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece bigint, start bigint, length bigint, bin_id bigint, bin_offset bigint"

    def place(batches):
        table = held.value
        key = (table[:, 0] << 48) + table[:, 1] if len(table) else np.zeros(0, np.int64)
        for batch in batches:
            w, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            run = table[np.searchsorted(key, (w << 48) + rank, "right") - 1]
            nth = rank - run[:, 1]
            bins = run[:, 3] + nth // run[:, 4]
            offset = run[:, 5] + nth % run[:, 4] * w
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(bins), pa.array(offset)], ["doc_id", "piece", "start", "length", "bin_id", "bin_offset"])

    return ranked.mapInArrow(place, out)
