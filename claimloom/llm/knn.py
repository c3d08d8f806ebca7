"""Exact k nearest neighbours by a Voronoi join of queries with all vectors.

Pivots split the vectors into cells. From summaries of the cells (size, radius, and the distances of the vectors nearest to
the pivot) follows for the queries of each cell a distance theta within which all of them have k neighbours. Query cells are
gathered into groups, and a vector goes to a group only if for some cell i of it neither its distance from the ball of
the cell's queries nor the bisector between pivot i and its own pivot puts it beyond theta i. Groups are solved alone, each in
tiles of the vectors dealt to it, so that all cores work where nothing can be pruned; a query's tiles are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import prepare, saved

K = 10
#: Queries that a group holds at most.
GROUP_ROWS = 20_000
#: Pivots at most, of as many as the square root of the number of vectors.
PIVOTS = 2048
DIGITS = 6
#: Components of a greater magnitude are taken for infinite: their squares leave the range of numbers.
HUGE = 1e150
_SLACK = 1e-6
#: Relative error of a squared distance from squared norms, with room for sums over many components.
_ERROR = 1e-12


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T))


class Layout:
    """Pivots and, for each cell, the radius of its queries, their bound and their groups.

    size and radius: of the queries of each cell; near: of each cell's vectors the least distances to the pivot. k counts the
    vectors of the query's own id, too. All distances are of vectors less `centre`, whose norms are small beside their spread.
    """

    def __init__(self, pivots: np.ndarray, size: np.ndarray, radius: np.ndarray, near: list[np.ndarray], k: int, rows: int, norm: float = 0.0):
        self.pivots, self.radius = pivots, radius
        self.between = between = distances(pivots, pivots)
        self.error = 4 * _ERROR * norm * norm  # of a squared distance between vectors of norms up to `norm`
        self.slack = _SLACK + np.sqrt(self.error)
        self.theta = np.full(len(pivots), np.inf)
        cell, least = np.repeat(np.arange(len(pivots)), [len(x) for x in near]), np.concatenate([*near, np.zeros(0)])
        if len(least) >= k:
            for i in np.flatnonzero(size):
                self.theta[i] = np.partition(radius[i] + between[i, cell] + least, k - 1)[k - 1]
        self.first, self.parts = np.zeros(len(pivots), np.int64), np.ones(len(pivots), np.int64)
        left, at, group, held = size > 0, None, 0, 0
        while left.any():  # next the cell nearest to the last one, so that a group's cells lie together
            at = int(left.argmax()) if at is None else int(np.where(left, between[at], np.inf).argmin())
            left[at] = False
            if held and held + size[at] > rows:
                group, held = group + 1, 0
            self.first[at], self.parts[at] = group, -(-size[at] // rows)
            if self.parts[at] > 1:
                group, held = group + int(self.parts[at]), 0
            else:
                held += size[at]
        some = size > 0
        self.groups = int((self.first + self.parts)[some].max()) if some.any() else 0
        self.holds = np.zeros((len(pivots), self.groups), np.float32)  # whether a group has queries of a cell
        for i in np.flatnonzero(some):
            self.holds[i, self.first[i] : self.first[i] + self.parts[i]] = 1

    def needed(self, d: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """Of vectors with distances d (n x pivots) to the pivots and their cells: n x groups, whether a group may need them."""
        reach = self.theta * (1 + 1e-9) + self.slack
        own = d[np.arange(len(d)), cell][:, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            beyond = np.where(self.between[cell] > 0, (d * d - own * own - self.error) / (2 * self.between[cell]), 0.0)  # of the bisector
        ask = np.maximum(0, self.between[cell] / 2 - self.radius)  # the queries' distance from it, on the other side
        close = (d - self.radius <= reach) & (beyond + ask <= reach + self.slack)
        return close.astype(np.float32) @ self.holds > 0


def neighbours(vectors: DataFrame, k: int = K, key: str = "vec_id", column: str = "embedding", pivots: int = PIVOTS, rows: int = GROUP_ROWS, asks: Column | None = None, tiles: int | None = None) -> DataFrame:
    """key, rank (from 1), neighbor_id, distance: of every query the k nearest other vectors, by Euclidean distance.

    asks says which rows are queries (by default all); all rows are searched. Distances are rounded to DIGITS places and ties go to
    the lesser id. Rows with a null id, or whose vector is null, empty, has a null, a NaN, an infinity or a component beyond
    HUGE, or another dimension than most (the least of equally frequent ones), neither ask nor answer. Repeated rows
    count once; vectors of the same id are not neighbours of each other. With fewer than k others there are fewer rows.
    Other columns are ignored. The result is the same however many pivots, groups and tiles there are, at any norm.
    """
    spark = vectors.sparkSession
    prepare(spark)
    ask = F.coalesce(asks, F.lit(False)) if asks is not None else F.lit(True)
    fine = vectors.select(F.col(key).cast("bigint").alias("id"), F.col(column).cast("array<double>").alias("v"), ask.alias("ask"))
    fine = fine.where("id is not null and size(v) > 0").where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > HUGE)))
    fine = fine.groupBy("id", "v").agg(F.max("ask").alias("ask"))
    fine = saved(fine.withColumn("row", F.monotonically_increasing_id()))
    sizes = fine.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    out = "id bigint, rank bigint, neighbor_id bigint, distance double"
    if not sizes:
        return spark.createDataFrame([], out).withColumnRenamed("id", key)
    fine = fine.where(F.size("v") == sizes[0]["d"])
    own = fine.groupBy("id").count().agg(F.max("count")).first()[0]  # vectors of one id, which are no neighbours
    chosen = fine.orderBy(F.xxhash64("id"), "id", "row").limit(min(pivots, max(1, int(sizes[0]["count"] ** 0.5)))).collect()
    at = np.array([r.v for r in chosen])
    centre = at.mean(0)
    held = spark.sparkContext.broadcast((at - centre, centre))

    def assign(batches):
        for batch in batches:
            at, centre = held.value
            v = _matrix(batch.column("v")) - centre
            d = distances(v, at)
            cell = d.argmin(1)
            columns = [*batch.columns, pa.array(cell.astype(np.int64)), pa.array(d[np.arange(len(d)), cell]), pa.array(np.sqrt((v * v).sum(1)))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "v", "ask", "row", "cell", "d", "norm"])

    cells = saved(fine.mapInArrow(assign, "id bigint, v array<double>, ask boolean, row bigint, cell bigint, d double, norm double"))
    near = F.slice(F.array_sort(F.collect_list("d")), 1, k + own)
    some = F.when(F.col("ask"), F.col("d"))
    # a task's share of a cell is cut to its k + own least before it moves; a task holds no more than its own rows
    part = cells.groupBy("cell", F.spark_partition_id().alias("p")).agg(F.count(some).alias("n"), F.max(some).alias("r"), F.max("norm").alias("norm"), near.alias("near"))
    summary = part.groupBy("cell").agg(F.sum("n").alias("n"), F.max("r").alias("r"), F.max("norm").alias("norm"), F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k + own).alias("near")).collect()
    size, radius, lists = np.zeros(len(chosen), np.int64), np.zeros(len(chosen)), [np.zeros(0)] * len(chosen)
    for r in summary:
        size[r.cell], radius[r.cell], lists[r.cell] = r.n, r.r or 0.0, np.array(r.near)
    lay = Layout(at - centre, size, radius, lists, k + own, rows, max(r.norm for r in summary))
    layout = spark.sparkContext.broadcast(lay)
    tiles = tiles or max(1, -(-2 * spark.sparkContext.defaultParallelism // max(lay.groups, 1)))

    def deal(batches):
        """Each query to all tiles of its group (role 0), and each vector to one tile of the groups that may need it (role 1)."""
        for batch in batches:
            lay, (at, centre) = layout.value, held.value
            cell, number = batch.column("cell").to_numpy(), batch.column("row").to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)
            asking = np.flatnonzero(batch.column("ask").to_numpy(zero_copy_only=False))
            home = lay.first[cell] + (number % lay.parts[cell].astype(np.uint64)).astype(np.int64)
            who, group = np.nonzero(lay.needed(distances(_matrix(batch.column("v")) - centre, at), cell))
            for role, rows_, tile in (
                (0, np.repeat(asking, tiles), np.repeat(home[asking], tiles) * tiles + np.tile(np.arange(tiles), len(asking))),
                (1, who, group * tiles + (number[who] % np.uint64(tiles)).astype(np.int64)),
            ):
                if len(rows_):
                    taken = batch.select(["row", "id", "v"]).take(pa.array(rows_))
                    yield pa.RecordBatch.from_arrays([pa.array(tile), pa.array(np.full(len(rows_), role)), *taken.columns], ["g", "role", "row", "id", "v"])

    def solve(batches):
        group, asks, solver = None, [], None
        for batch in batches:
            g, role = batch.column("g").to_numpy(), batch.column("role").to_numpy()
            key_ = g * 2 + role
            for x in np.unique(key_):
                part = batch.slice(int(np.searchsorted(key_, x)), int(np.searchsorted(key_, x, "right") - np.searchsorted(key_, x)))
                if x // 2 != group:
                    if solver:
                        yield from solver.result()
                    group, asks, solver = x // 2, [], None
                v = _matrix(part.column("v")) - held.value[1]
                if x % 2 == 0:
                    asks.append((part.column("row").to_numpy(), part.column("id").to_numpy(), v))
                elif asks:
                    solver = solver or Local(*map(np.concatenate, zip(*asks)), k, own)
                    solver.see(part.column("id").to_numpy(), v)
        if solver:
            yield from solver.result()

    dealt = cells.mapInArrow(deal, "g bigint, role bigint, row bigint, id bigint, v array<double>")
    solved = dealt.repartition("g").sortWithinPartitions("g", "role").mapInArrow(solve, "row bigint, id bigint, neighbor_id bigint, distance double")
    # one row a query and neighbour: another vector of the same neighbour may have been seen in another tile
    best = Window.partitionBy("row").orderBy("distance", "neighbor_id")
    ranked = solved.withColumn("rank", F.row_number().over(best).cast("bigint")).where(F.col("rank") <= k)
    return ranked.select(F.col("id").alias(key), "rank", "neighbor_id", "distance")


class Local:
    """The k best of all vectors seen, for the queries held."""

    BLOCK = 1024

    def __init__(self, rows: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int, own: int = 1):
        self.rows, self.ids, self.v, self.k, self.own = rows, ids, v, k, own
        self.best = np.full((len(ids), k), np.inf)
        self.who = np.full((len(ids), k), np.iinfo(np.int64).max)

    def see(self, ids: np.ndarray, v: np.ndarray) -> None:
        for b in range(0, len(ids), 2 * self.BLOCK):
            for a in range(0, len(self.ids), self.BLOCK):
                self._see(slice(a, a + self.BLOCK), ids[b : b + 2 * self.BLOCK], v[b : b + 2 * self.BLOCK])

    def _see(self, at: slice, ids: np.ndarray, v: np.ndarray) -> None:
        mine, k = self.v[at], self.k
        mm, vv = (mine * mine).sum(1)[:, None], (v * v).sum(1)
        d = mm + vv - 2 * mine @ v.T
        error = _ERROR * (mm + vv.max(initial=0))[:, 0]  # how far a square may be off
        bound = self.best[at, -1] + _SLACK
        if not np.isfinite(bound).all() and d.shape[1] >= k + self.own:
            bound = np.minimum(bound, np.sqrt(np.maximum(0, np.partition(d, k + self.own - 1, axis=1)[:, k + self.own - 1] + error)) + _SLACK)
        row, col = np.nonzero(d <= (bound * bound + error)[:, None])
        other = ids[col] != self.ids[at][row]
        row, col = row[other], col[other]
        far = np.round(np.sqrt(((mine[row] - v[col]) ** 2).sum(1)), DIGITS)
        n = len(mine)
        row = np.r_[np.repeat(np.arange(n), k), row]
        far = np.r_[self.best[at].ravel(), far]
        who = np.r_[self.who[at].ravel(), ids[col]]
        order = np.lexsort((who, far, row))
        row, far, who = row[order], far[order], who[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        keep = rank < k
        self.best[at], self.who[at] = far[keep].reshape(n, k), who[keep].reshape(n, k)

    def result(self):
        there = np.isfinite(self.best)
        row, rank = np.nonzero(there)
        yield pa.RecordBatch.from_arrays([pa.array(self.rows[row]), pa.array(self.ids[row]), pa.array(self.who[there]), pa.array(self.best[there])], ["row", "id", "neighbor_id", "distance"])


#: The queries of op7: rows whose id is divisible by this.
ASKS = 50
ORACLE = f"""
SELECT vec_id, rank, neighbor_id, distance FROM (
  SELECT vec_id, neighbor_id, distance, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbor_id)::BIGINT AS rank
  FROM (SELECT a.vec_id, b.vec_id AS neighbor_id, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), {DIGITS}) AS distance
        FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % {ASKS} = 0))
WHERE rank <= {K}
"""
