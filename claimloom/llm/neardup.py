"""SimHash near-duplicate groups, searched with BK-trees.

The fingerprint of a text has BITS bits: each distinct word votes on every bit. Two texts are near copies when their
fingerprints differ in at most RADIUS bits; groups are the connected components. They are found in two passes. In the first,
candidates meet in shards: each of some tables picks some bits, and fingerprints that agree on them share a shard. More bits
a table make a meeting rarer, so there are as many tables as keep the chance of one at FIRST. Every shard holds a BK-tree
(children keyed by the integer Hamming distance to their parent), searched for all its members, following only edges within the
radius. Trees grow with the data, so shards are brought to their queries by the shuffle instead of a broadcast. This pass joins
most of what is near, and great clusters without all their pairs, but misses pairs by chance.

The second pass is exact and leaves out no pair within the radius whose fingerprints the first one didn't connect. Every two parts of
the fingerprints meet in a tile. There the bits are split into blocks with an allowance each, and allowances plus one add up to
the radius plus one: two fingerprints within the radius are within the allowance in at least one block (pigeonhole), so only those are compared.

On few words a vote says little: one changed word of seven moves the fingerprint by 50 bits or more. Texts of at most FEW
distinct words are therefore compared by their sets of words as well, exactly, at the Jaccard that RADIUS stands for.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .session import BROADCAST_BYTES, attach, fresh, name, prepare, saved, without
from .words import mix, sliced, strings, word_hashes

BITS = 256
RADIUS = 44
#: Distinct words of a text that is also compared by its set of words: all that can be near a text of fewer than ten. The least
#: Jaccard is 3/4: RADIUS bits of BITS are the angle of texts that share 0.86 of their words.
FEW = 12
#: Chance that two fingerprints exactly at the radius share a shard, at least, by default of `tables_for`; nearer ones have a better one.
RECALL = 0.9
#: The same chance in the first pass. It shifts work between the passes and changes no result.
FIRST = 0.5
#: Fingerprints of a part, at most, and the number under which a part isn't split to occupy all cores.
PART, PART_LEAST = 250_000, 20_000
#: Tiles are dealt to so many tasks, at most.
TASKS = 10_000
#: Candidates that are compared at a time.
MOST = 1 << 18
#: Shards of more fingerprints are explored by components instead of by all pairs.
LARGE = 128
#: Shards are sized to hold about so many unrelated fingerprints.
SHARD = 16
#: A fingerprint is hot if one text of so many has it; there are at most as many of them.
HOT = 1000


def simhash(h: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts given by word hashes and offsets: fingerprints (n x 4 uint64), numbers of distinct words, hashes of the distinct words of each in turn."""
    n = len(off) - 1
    text = np.repeat(np.arange(n), np.diff(off))
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    h, text = h[first], text[first]
    size = np.bincount(text, minlength=n)
    votes = np.zeros((n, BITS), np.int32)
    if len(h):
        # eight votes a uint64, a byte each; a part has at most 255 words of one text, so that no byte overflows
        place = np.arange(len(h)) - np.repeat(np.r_[0, np.cumsum(size)[:-1]], size)
        start = np.flatnonzero(place % 255 == 0)
        whole = np.flatnonzero(np.r_[True, text[start][1:] != text[start][:-1]])
        for s in range(4):
            x = mix(h, s + 1)
            for j in range(8):
                sums = np.add.reduceat((x >> np.uint64(j)) & np.uint64(0x0101010101010101), start)
                parts = sums.view(np.uint8).reshape(-1, 8).astype(np.int32)
                votes[text[start[whole]], s * 64 + j * 8 : s * 64 + j * 8 + 8] = np.add.reduceat(parts, whole, axis=0)
    code = np.packbits(2 * votes > size[:, None], axis=1).view(np.uint64)
    return code, size, h


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without their text, and code (32 bytes; null for null and wordless texts, which equal nothing) and few (the hashes of the
    distinct words of a text that has at most FEW, else null)."""
    prepare(docs.sparkSession)
    others = [f for f in docs.schema.fields if f.name != text]
    out = T.StructType([*others, T.StructField("code", T.BinaryType()), T.StructField("few", T.BinaryType())])

    def run(batches):
        for batch in batches:
            texts = strings(batch.column(text))
            for a, b in sliced(texts):
                code, size, h = simhash(*word_hashes(texts[a:b]))
                raw = np.ascontiguousarray(code).tobytes()
                off = np.arange(b - a + 1, dtype=np.int32) * 32
                codes = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(off), pa.py_buffer(raw)])
                codes = pc.if_else(pa.array(size > 0), codes, pa.scalar(None, pa.binary()))
                short = (size > 0) & (size <= FEW)
                off = np.r_[0, np.cumsum(np.where(short, size, 0) * 8)].astype(np.int32)
                few = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(off), pa.py_buffer(h[np.repeat(short, size)].tobytes())])
                few = pc.if_else(pa.array(short), few, pa.scalar(None, pa.binary()))
                rows = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*(rows.column(f.name) for f in others), codes, few], out.names)

    return docs.mapInArrow(run, out)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(1, dtype=np.int32)


class Forest:
    """One BK-tree for each group of codes; node i is row i, and the first row of a group is its root."""

    def __init__(self, codes: np.ndarray, group: np.ndarray):
        n = len(codes)
        self.codes, self.root = codes, np.zeros(n, np.int64)
        start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if n else np.zeros(0, np.int64)
        self.root = np.repeat(start, np.diff(np.r_[start, n]))
        self.parent, edge = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        item = np.flatnonzero(self.root != np.arange(n))
        at = self.root[item]
        self.levels = [start]
        while len(item):
            key = at * 512 + distance(codes[item], codes[at])
            order = np.argsort(key, kind="stable")
            item, key = item[order], key[order]
            new = np.r_[True, key[1:] != key[:-1]]
            child = item[new]
            self.parent[child], edge[child] = key[new] // 512, key[new] % 512
            self.levels.append(child)
            at = np.repeat(child, np.diff(np.r_[np.flatnonzero(new), len(key)]))[~new]
            item = item[~new]
        self.children = np.flatnonzero(self.parent >= 0)
        key = self.parent[self.children] * 512 + edge[self.children]
        order = np.argsort(key, kind="stable")
        self.children, self.key = self.children[order], key[order]

    def search(self, query: np.ndarray, radius: int, alive: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query node, node within the radius in its tree). alive marks the nodes that are looked for."""
        found_q, found_n = [], []
        below = None
        if alive is not None:  # how many nodes of each subtree are still looked for
            below = alive.astype(np.int64)
            for level in reversed(self.levels[1:]):
                np.add.at(below, self.parent[level], below[level])
        q, node = query, self.root[query]
        while len(q):
            if below is not None:
                some = below[node] > 0
                q, node = q[some], node[some]
            d = distance(self.codes[q], self.codes[node])
            hit = (d <= radius) & (q != node)
            if alive is not None:
                hit &= alive[node]
            found_q.append(q[hit])
            found_n.append(node[hit])
            lo = np.searchsorted(self.key, node * 512 + np.maximum(d - radius, 0))
            hi = np.searchsorted(self.key, node * 512 + np.minimum(d + radius, 511), "right")
            n = hi - lo
            q = np.repeat(q, n)
            node = self.children[np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())]
        return np.concatenate([*found_q, np.zeros(0, np.int64)]), np.concatenate([*found_n, np.zeros(0, np.int64)])


def _batches(group: np.ndarray, most: int = 400_000):
    """Runs of whole groups, of about `most` query-node visits at the least depth."""
    start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[start, len(group)])
    work = np.cumsum(size * size)
    a = 0
    while a < len(start):
        b = max(a + 1, int(np.searchsorted(work, (work[a - 1] if a else 0) + most, "right")))
        yield start[a], start[b - 1] + size[b - 1]
        a = b


def edges(codes: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that connect, within each group of distinct codes, all that chains of steps within the radius connect.

    Small groups give all pairs. A large one is explored from node to node and only the nodes not yet reached are
    looked for, so that a cluster of m copies costs m searches of what is left instead of m * m pairs; clusters that
    hold little of the group are left to the search for all pairs among the rest. LARGE changes the edges, never what they connect.
    """
    left, right = [], []
    size = np.diff(np.r_[np.flatnonzero(np.r_[True, group[1:] != group[:-1]]), len(group)])
    large = np.repeat(size > LARGE, size)
    small = np.flatnonzero(~large)
    for a, b in _batches(group[small]) if len(small) else ():
        f = Forest(codes[small[a:b]], group[small[a:b]])
        q, n = f.search(np.arange(b - a), radius)
        once = q < n
        left.append(small[a:b][q[once]])
        right.append(small[a:b][n[once]])
    at = np.flatnonzero(large)
    for g in np.unique(group[at]):
        rest = at[group[at] == g]
        while len(rest):
            f = Forest(codes[rest], np.zeros(len(rest), np.int64))
            alive = np.ones(len(rest), bool)
            alive[0] = False
            frontier = np.zeros(1, np.int64)
            while len(frontier):
                reached = []
                for a in range(0, len(frontier), 2048):
                    q, n = f.search(frontier[a : a + 2048], radius, alive)
                    n, first = np.unique(n, return_index=True)
                    alive[n] = False
                    left.append(rest[q[first]])
                    right.append(rest[n])
                    reached.append(n)
                frontier = np.concatenate(reached)
            got, rest = len(rest) - alive.sum(), rest[alive]
            if len(rest) <= LARGE or got * 20 < len(rest):
                break
        for a in range(0, len(rest), 1024):
            f = f if a else Forest(codes[rest], np.zeros(len(rest), np.int64))
            q, n = f.search(np.arange(a, min(a + 1024, len(rest))), radius)
            left.append(rest[q[q < n]])
            right.append(rest[n[q < n]])
    return np.concatenate([*left, np.zeros(0, np.int64)]), np.concatenate([*right, np.zeros(0, np.int64)])


def picks(tables: int, bits: int) -> np.ndarray:
    """The bits of each table, the same in every run."""
    rng = np.random.default_rng(20240229)
    return np.stack([rng.permutation(BITS)[:bits] for _ in range(tables)])


def tables_for(bits: int, radius: int = RADIUS, recall: float = RECALL) -> int:
    """The number of tables of so many picked bits that lets a pair at the radius meet with a chance of recall."""
    meet = math.comb(BITS - radius, bits) / math.comb(BITS, bits)
    return math.ceil(math.log1p(-recall) / math.log1p(-meet)) if 0 < meet < 1 else 1


def blocks(n: int, radius: int) -> list[tuple[int, int]]:
    """Width and allowance of each block; of the numbers of blocks the one at which n fingerprints cost least against as many others."""
    found = []
    for m in range(12, 33):
        width = [BITS // m + (t < BITS % m) for t in range(m)]
        allow = [(radius + 1) // m - 1 + (t < (radius + 1) % m) for t in range(m)]
        ball = [sum(math.comb(w, i) for i in range(min(r, w) + 1)) for w, r in zip(width, allow)]
        found.append((sum(x * (1 + 2 * n / 2**w) for x, w in zip(ball, width)), list(zip(width, allow))))
    return min(found)[1]


class Block:
    """Codes in the order of their values on some bits and their labels; runs of one value and label are one item if that saves work."""

    def __init__(self, codes: np.ndarray, label: np.ndarray, bits: np.ndarray):
        raw = codes.view(np.uint8).reshape(-1, 32)
        value = np.zeros(len(codes), np.int64)
        for j in bits.tolist():
            value = value * 2 + (raw[:, j // 8] >> (j % 8) & 1)
        self.order = np.lexsort((label, value))
        value, label, at = value[self.order], label[self.order], np.arange(len(codes))
        self.words = [np.ascontiguousarray(codes[self.order, w]) for w in range(4)]
        start = np.flatnonzero(np.r_[True, (value[1:] != value[:-1]) | (label[1:] != label[:-1])])
        size = np.diff(np.r_[start, len(at)])
        self.plain = (size * size).sum() <= 4 * len(at)
        # runs are cut at 1024, so that two of them have at most 2 ** 20 pairs
        self.start = at if self.plain else np.flatnonzero((at - np.repeat(start, size)) % 1024 == 0)
        self.size = np.diff(np.r_[self.start, len(at)])
        self.value, self.label, self.code_label = value[self.start], label[self.start], label
        self.first = np.r_[0, np.cumsum(np.bincount(self.value, minlength=1 << len(bits)))]


def _ramp(n: np.ndarray) -> np.ndarray:
    """0 to n[0] - 1, 0 to n[1] - 1 and so on."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _cuts(work: np.ndarray):
    """Slices of about MOST work."""
    total = np.cumsum(work)
    a = 0
    while a < len(work):
        b = max(a + 1, int(np.searchsorted(total, total[a] - work[a] + MOST, "right")))
        yield slice(a, b)
        a = b


def block_pairs(a: Block, b: Block, width: int, allow: int, radius: int):
    """Pairs (row of a, row of b) within the radius, of different labels and within the allowance in the block; if a is b, each pair once."""
    every = np.arange(len(a.value))
    for flips in range(min(allow, width) + 1):
        for bits in itertools.combinations(range(width), flips):
            if a is b and not flips:
                item, lo = every, every + 1
                n = a.first[a.value + 1] - lo
            else:
                item = np.flatnonzero(a.value & (1 << bits[-1]) == 0) if a is b else every
                value = a.value[item] ^ sum(1 << j for j in bits)
                lo = b.first[value]
                n = b.first[value + 1] - lo
            some = np.flatnonzero(n)
            item, lo, n = item[some], lo[some], n[some]
            for s in _cuts(n):
                i = np.repeat(item[s], n[s])
                j = np.repeat(lo[s], n[s]) + _ramp(n[s])
                if a.plain and b.plain:
                    yield _near(a, b, i, j, radius)
                    continue
                other = a.label[i] != b.label[j]
                i, j = i[other], j[other]
                for t in _cuts(k := a.size[i] * b.size[j]):
                    r, w = _ramp(k[t]), np.repeat(b.size[j[t]], k[t])
                    yield _near(a, b, np.repeat(a.start[i[t]], k[t]) + r // w, np.repeat(b.start[j[t]], k[t]) + r % w, radius)


def _near(a: Block, b: Block, i: np.ndarray, j: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    d = np.zeros(len(i), np.int16)
    for w in range(4):
        d = d + np.bitwise_count(a.words[w][i] ^ b.words[w][j])
        if w % 2:
            hit = np.flatnonzero(d <= radius)
            i, j, d = i[hit], j[hit], d[hit]
    hit = a.code_label[i] != b.code_label[j]
    return a.order[i[hit]], b.order[j[hit]]


def merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The labels (from 0), those that the pairs a, b of labels connect made one."""
    root = np.arange(label.max(initial=-1) + 1)
    while (apart := root[a] != root[b]).any():
        x, y = root[a[apart]], root[b[apart]]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    return root[label]


def _one_each(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of the pairs i, j one for each two labels that differ."""
    x, y = label[i], label[j]
    i, j, key = (z[x != y] for z in (i, j, np.minimum(x, y) * len(label) + np.maximum(x, y)))
    _, first = np.unique(key, return_index=True)
    return np.stack([i[first], j[first]])


def rest_edges(codes: np.ndarray, label: np.ndarray, radius: int, split: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows within the radius that, with the labels, connect all pairs within it: of rows before split with the others, or of all.

    codes are distinct; rows of one label count as connected. What a block connects is one label in the next.
    """
    label = np.unique(label, return_inverse=True)[1]
    bits = np.random.default_rng(20240229).permutation(BITS)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    one, two = (slice(None), None) if split is None else (slice(split), slice(split, None))
    if not len(codes[one]) or two and not len(codes[two]):
        return left[0], right[0]
    at = 0
    for width, allow in blocks(len(codes) if two is None else max(split, len(codes) - split), radius):
        if allow >= 0:
            a = Block(codes[one], label[one], bits[at : at + width])
            b = Block(codes[two], label[two], bits[at : at + width]) if two else a
            found = [np.zeros((2, 0), np.int64)]
            for i, j in itertools.chain(block_pairs(a, b, width, allow, radius), [(None, None)]):
                if i is not None and len(i):
                    found.append(_one_each(label, i, j + (split or 0)))
                if i is None or sum(x.shape[1] for x in found) > 16 * MOST:
                    i, j = _one_each(label, *np.concatenate(found, axis=1))
                    left.append(i)
                    right.append(j)
                    label, found = merged(label, label[i], label[j]), [np.zeros((2, 0), np.int64)]
        at += width
    return np.concatenate(left), np.concatenate(right)


def missed_edges(codes: DataFrame, n: int, radius: int = RADIUS) -> DataFrame:
    """a, b: ids of codes within the radius that connect, with the roots, all pairs of codes within the radius.

    codes: id, code (32 bytes), root (equal for codes known to be connected); n: how many. Parts of at most about PART
    codes meet two by two, each pair of parts in one task; the shuffle carries each code once for each part.
    """
    cores = codes.sparkSession.sparkContext.defaultParallelism
    parts = max(1, math.ceil(n / PART), min(math.ceil(n / PART_LEAST), math.ceil(math.sqrt(6 * cores))))
    tiles = parts * (parts + 1) // 2

    def solve(batches):
        kept: list[pa.RecordBatch] = []

        def solved():
            table = pa.Table.from_batches(kept)
            kept.clear()
            side = table.column("side").to_numpy()
            table = table.take(pa.array(np.argsort(side, kind="stable"))).combine_chunks()
            ids, root = table.column("id").to_numpy(), table.column("root").to_numpy()
            raw = np.frombuffer(b"".join(table.column("code").to_pylist()), np.uint64).reshape(-1, 4)
            a, b = rest_edges(raw, root, radius, int((side == 1).sum()) if side.any() else None)
            return pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], ["a", "b"])

        last = None
        for batch in batches:
            tile = batch.column("tile").to_numpy()
            start = np.flatnonzero(np.r_[True, tile[1:] != tile[:-1]]) if len(tile) else ()
            for s, e in zip(start, [*start[1:], len(tile)]):
                if kept and tile[s] != last:
                    yield solved()
                last = tile[s]
                kept.append(batch.slice(s, e - s))
        if kept:
            yield solved()

    met = codes.select("id", "code", "root", F.expr(f"pmod(xxhash64(id), {parts})").alias("p"))
    met = met.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<bigint>")))
    met = met.withColumn("lo", F.least("p", "q")).withColumn("hi", F.greatest("p", "q"))
    tile = F.expr(f"lo * ({2 * parts + 1} - lo) div 2 + hi - lo").alias("tile")
    side = F.expr("case when p = q then 0 when p < q then 1 else 2 end").alias("side")
    met = met.select(tile, side, "id", "code", "root")
    tasks = min(tiles, TASKS)
    met = met.repartitionById(tasks, F.expr(f"cast(tile % {tasks} as int)"))
    return met.sortWithinPartitions("tile").mapInArrow(solve, "a bigint, b bigint")


def near_edges(codes: DataFrame, n: int, radius: int = RADIUS, tables: int | None = None, bits: int | None = None) -> DataFrame:
    """a, b: pairs of ids that connect exactly what chains of steps within the radius connect.

    codes: id (bigint), code (32 bytes), all distinct; n: how many. tables and bits are those of the first pass and change no result.
    """
    linked = components(shard_edges(codes, n, radius, tables, bits))
    rest = codes.select("id", "code").join(linked, "id", "left").withColumn("root", F.coalesce("root", "id"))
    return linked.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(missed_edges(rest, n, radius))


def shard_edges(codes: DataFrame, n: int, radius: int = RADIUS, tables: int | None = None, bits: int | None = None) -> DataFrame:
    """a, b: ids of codes that are within the radius, enough of them to connect whatever a shard connects.

    codes: id (bigint), code (32 bytes), all distinct; n: how many. bits is by default the number that leaves about
    SHARD unrelated codes in a shard, and tables the one that keeps FIRST at these bits, so that the work follows n
    and, with the tables, about its power of 1.3.
    """
    bits = bits or max(14, math.ceil(math.log2(max(n, 1) / SHARD)))
    tables = tables or tables_for(bits, radius, FIRST)
    which = picks(tables, bits)

    def deal(batches):
        for batch in batches:
            raw = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(-1, 32)
            on = np.unpackbits(raw, axis=1)
            for t in range(tables):
                shard = np.zeros(len(on), np.int64)
                for j in which[t]:
                    shard = shard * 2 + on[:, j]
                yield pa.RecordBatch.from_arrays([pa.array(shard + (t << 48)), batch.column("id"), batch.column("code")], ["shard", "id", "code"])

    def solve(batches):
        kept: list[pa.RecordBatch] = []
        held, most = 0, 100_000

        def flush(table, final):
            shard = table.column("shard").to_numpy()
            cut = len(shard) if final else int(np.searchsorted(shard, shard[-1]))
            ids = table.column("id").to_numpy()[:cut]
            raw = np.frombuffer(b"".join(table.column("code").slice(0, cut).to_pylist()), np.uint64).reshape(-1, 4)
            a, b = edges(raw, shard[:cut], radius) if cut else (np.zeros(0, int), np.zeros(0, int))
            return pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], ["a", "b"]), table.slice(cut)

        for batch in batches:
            kept.append(batch)
            held += batch.num_rows
            if held >= most:
                got, rest = flush(pa.Table.from_batches(kept).combine_chunks(), False)
                kept, held = rest.to_batches(), rest.num_rows
                most = max(100_000, 2 * held)  # a great shard is put together a few times, not at every batch
                yield got
        if held:
            yield flush(pa.Table.from_batches(kept).combine_chunks(), True)[0]

    dealt = codes.select("id", "code").mapInArrow(deal, "shard bigint, id bigint, code binary")
    return dealt.repartition("shard").sortWithinPartitions("shard").mapInArrow(solve, "a bigint, b bigint")


def few_edges(codes: DataFrame) -> DataFrame:
    """a, b: ids of sets of words (id, few) that connect all sets with a Jaccard of 3/4 or more to each other.

    Two such sets have m words in common and d and d' others, with 3 (d + d') <= m. So each set is dealt to its subsets of m
    words with 3 d <= m, and within a subset all are compared with the one of least d, which is near to all that are near to any.
    """

    def deal(batches):
        for batch in batches:
            ids = batch.column("id").to_numpy()
            few = batch.column("few").to_pylist()
            size = np.array([len(x) // 8 for x in few])
            for n in np.unique(size):
                at = np.flatnonzero(size == n)
                for part in np.split(at, range(1000, len(at), 1000)):
                    h = np.frombuffer(b"".join(few[i] for i in part), np.uint64).reshape(-1, n)
                    for d in range(n // 4 + 1):
                        pick = np.array(list(itertools.combinations(range(n), n - d)))
                        s1, s2 = (mix(h, seed)[:, pick].sum(2, dtype=np.uint64).view(np.int64).ravel() for seed in (11, 12))
                        m, left = np.full(len(s1), n - d, np.int64), np.full(len(s1), d, np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (s1, s2, m, left, np.repeat(ids[part], len(pick)))], ["s1", "s2", "m", "d", "id"])

    dealt = saved(codes.where("few is not null").select("id", "few").mapInArrow(deal, "s1 bigint, s2 bigint, m bigint, d bigint, id bigint"))
    least = dealt.groupBy("s1", "s2", "m").agg(F.min(F.struct("d", "id")).alias("x"), F.count("*").alias("n")).where("n > 1")
    met = dealt.join(least, ["s1", "s2", "m"]).where("id <> x.id and 3 * (d + x.d) <= m")
    return met.select(F.col("x.id").alias("a"), F.col("id").alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """id, root: the least id of the connected component of each other id on an edge (alternating large and small stars)."""
    e = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").where("u <> v").distinct()
        now = saved(small)
        # a fixpoint has only stars: no id is both a centre and a leaf, and no leaf has two centres
        leaf = now.groupBy("u").agg(F.count("*").alias("n"))
        if not now.count() or not leaf.where("n > 1").union(now.join(leaf.select("u", "n").withColumnRenamed("u", "v"), "v").select("u", "n")).limit(1).count():
            return now.select(F.col("u").alias("id"), F.col("v").alias("root"))
        e = now


def _grouped(docs: DataFrame, radius: int = RADIUS, tables: int | None = None, bits: int | None = None) -> DataFrame:
    """docs (doc_id, text and others) without the text, with group_id and kept.

    Rows are told apart by a number of their own, whatever their ids: a code goes by the least number of its rows.
    """
    prints = saved(fingerprints(docs).withColumn("row", F.monotonically_increasing_id()))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("best")
    codes = prints.where("code is not null").groupBy("code").agg(F.min("row").alias("id"), F.max("few").alias("few"), F.count("*").alias("n"), best)
    codes = saved(codes)
    n, total = codes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    found = near_edges(codes, n, radius, tables, bits).unionByName(few_edges(codes))
    linked = components(found)
    linked = linked.unionByName(linked.select(F.col("root").alias("id"), "root").distinct()).join(codes.select("id", "best"), "id")
    leader = linked.groupBy("root").agg(F.min("best").alias("leader"))
    linked = linked.join(leader, "root").select("id", "leader")
    leaders = codes.join(linked, "id", "left").select("code", "n", F.coalesce("leader", "best").alias("leader"))
    others = [name(c) for c in prints.columns if c not in ("code", "few", "row")]
    met = attach(prints.where("code is not null"), saved(leaders), ["code"], 120, F.col("n") * HOT >= total)
    met = met.select(*others, F.col("leader.doc_id").alias("group_id"), (F.col("row") == F.col("leader.row")).alias("kept"))
    return met.unionByName(prints.where("code is null").select(*others, F.col("doc_id").alias("group_id"), F.lit(True).alias("kept")))


def groups(docs: DataFrame, radius: int = RADIUS, tables: int | None = None, bits: int | None = None) -> DataFrame:
    """doc_id, group_id (the least doc_id of the group of near copies) and kept, a row a document.

    Of each group one row is kept: one with the least id, of those that repeat it any one. docs: doc_id (of any type that can be
    ordered), text; other columns are ignored. Exact copies always share a group, and so do texts of the same words in
    another order. Null and wordless texts are groups of their own and are kept; texts of at most FEW distinct words are
    near copies from a Jaccard of 3/4 of their sets of words, too. Rows that repeat a doc_id each get a row, and each goes
    with its own text. A null doc_id comes after all others and is a group's id only if there is no other in it. Very long texts are
    read whole. An empty table gives an empty one.
    """
    return _grouped(docs.select("doc_id", "text"), radius, tables, bits)


def dedup(docs: DataFrame) -> DataFrame:
    """The rows of docs that `groups` keeps, with their columns as they were, whatever their names.

    One row of each group of near copies stays: rows go by their id and text together, so that two texts under one id are
    two documents, and rows that repeat both are one. Null and wordless texts all stay, a null id is an id like others.
    """
    key = F.concat(F.coalesce(F.md5(name("doc_id").cast("string")), F.lit("")), F.md5(name("text")))
    found = _grouped(docs.select("doc_id", key.alias("key"), "text"))
    pairs = found.where("key is not null").groupBy("key").agg(F.count_if("kept").alias("stay"), F.count("*").alias("n"))
    pairs = saved(pairs.where("stay < n"))
    left = without(docs, key, pairs.select("key"))
    again = pairs.where("stay > 0").select("key")
    if not (n := again.count()):
        return left
    at = fresh(docs, "key_")
    again = again.toDF(at)
    rows = docs.withColumn(at, key).join(F.broadcast(again) if n * 100 <= BROADCAST_BYTES else again, at, "left_semi")
    return left.unionByName(rows.dropDuplicates([at]).select([name(c) for c in docs.columns]))
