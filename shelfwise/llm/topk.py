"""Exact top-k by integer inner product on KD-trees per shard (operator 8).

Vectors become floor(1024 x). Median splits of the widest component, fitted on a bounded sample, part the space into cells;
every vector is dealt to its cell, and a cell of more vectors than a task should hold into several shards. Each cell has a
tight bounding box over all its vectors, and each shard a KD-tree with tight boxes at its nodes. The best product that a
query can have with a box is known from the box's corners. A query first searches the cell of its greatest bound; the kth
score found there goes with it to those other cells only whose bound reaches it. In a shard nodes are visited best first,
and a node whose bound lies below the kth score so far is never opened.

Vectors are shuffled once for each of the two passes, a query once for each shard it must ask; a task holds one shard and a
batch of queries. The sample only places the splits: every vector is indexed, and the result is exact.

Defined cases: vectors that are null or hold a null or a non-finite component take no part; an empty vector counts as
zeros, and vectors of unequal length as if the shorter ended in zeros; ties go to the smaller vec_id; rows that repeat a
vec_id are all candidates, but none of them for a query of that vec_id; each query row has a result of its own, also where
rows repeat; null ids take no part; products beyond a long are clipped to it; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

LEAF = 128
SCALE = 1024.0
EXACT = 2.0**53


def clipped(scores: np.ndarray) -> np.ndarray:
    """Python's integers as far as a long goes; doubles stay, as they are used below 2^53 only."""
    return np.clip(scores, -(1 << 63), (1 << 63) - 1) if scores.dtype == object else scores


class Tree:
    """Median splits down to leaves of at most `leaf` points; rows are reordered so that each node is a range of them."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(points))
        self.points, self.ids = points, ids
        self.begin, self.end, self.child, low, high = [], [], [], [], []
        stack = [(0, len(points), -1)]
        while stack:
            a, b, parent = stack.pop()
            own = points[self.order[a:b]]
            node = len(self.begin)
            if parent >= 0:
                self.child[parent].append(node)
            self.begin.append(a)
            self.end.append(b)
            self.child.append([])
            low.append(own.min(0))
            high.append(own.max(0))
            width = high[-1] - low[-1]
            if b - a > leaf and width.size and width.max() > 0:
                axis = int(width.argmax())
                middle = (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(own[:, axis], middle)]
                stack += [(a, a + middle, node), (a + middle, b, node)]
        self.low, self.high = np.array(low), np.array(high)
        self.points, self.ids = points[self.order], ids[self.order]

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The largest product that each query can have with a point of each node's box."""
        return clipped(np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T)

    def search(self, query: np.ndarray, own: int, bound: np.ndarray, k: int, floor: float) -> list[tuple[int, int]]:
        """The k best (score, vec_id) here that reach `floor`, best first."""
        best: list[tuple[float, int]] = []  # heap of (score, -vec_id): the worst is on top
        heap = [(-bound[0], 0)]
        while heap:
            up, node = heapq.heappop(heap)
            if -up < floor:
                break
            if self.child[node]:
                for c in self.child[node]:
                    if bound[c] >= floor:
                        heapq.heappush(heap, (-bound[c], c))
                continue
            a, b = self.begin[node], self.end[node]
            scores, ids = clipped(self.points[a:b] @ query), self.ids[a:b]
            for s, i in zip(*(x[(scores >= floor) & (ids != own)].tolist() for x in (scores, ids))):
                if len(best) < k:
                    heapq.heappush(best, (s, -i))
                elif (s, -i) > best[0]:
                    heapq.heapreplace(best, (s, -i))
            if len(best) == k:
                floor = max(floor, best[0][0])
        return [(int(s), -i) for s, i in sorted(best, reverse=True)]


def matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Lists as rows of `width` doubles, zeros where a list ends before."""
    ends = column.offsets.to_numpy()
    out = np.zeros((len(column), width))
    out[np.arange(width) < np.diff(ends)[:, None]] = column.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]]
    return out


def whole(points: np.ndarray) -> np.ndarray:
    """As Python's integers, for products beyond what doubles add exactly."""
    return np.array([[int(c) for c in row] for row in points.tolist()], object).reshape(points.shape)


@dataclass
class Cells:
    """A partition of space: node n splits `axis[n]` at `cut[n]` into nodes 2n + 1 and 2n + 2; the leaves are the cells."""

    axis: np.ndarray
    cut: np.ndarray

    @classmethod
    def fit(cls, sample: np.ndarray, depth: int) -> Cells:
        """Median splits of the component that varies most."""
        axis, cut = np.zeros((1 << depth) - 1, int), np.full((1 << depth) - 1, np.inf)
        rows = {0: np.arange(len(sample))}
        for node in range(axis.size):
            own = rows.pop(node)
            if own.size > 1:
                points = sample[own]
                axis[node] = int((points.max(0) - points.min(0)).argmax())
                values = np.sort(points[:, axis[node]])
                cut[node] = (values[(own.size - 1) // 2] + values[own.size // 2]) / 2
            left = sample[own, axis[node]] <= cut[node]
            rows[2 * node + 1], rows[2 * node + 2] = own[left], own[~left]
        return cls(axis, cut)

    def of(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), int)
        for _ in range(int(self.axis.size + 1).bit_length() - 1):
            node = 2 * node + 1 + (points[np.arange(len(points)), self.axis[node]] > self.cut[node])
        return node - self.axis.size


@dataclass
class Boxes:
    """By cell with vectors: its number, how many it has, the number of its first shard and how many it has of these, and its box."""

    cell: np.ndarray
    first: np.ndarray
    shards: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """At least the largest product of each query with a vector of each cell (rounding errors are added)."""
        most = np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T
        return most + 1e-9 * (np.abs(queries) @ np.maximum(np.abs(self.low), np.abs(self.high)).T)


def whole_numbers(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v array<double>): floor(1024 x) of each component, for the vectors that take part."""
    # decided by the double itself: a whole double is kept as it is, so no component overflows here
    part = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    scaled = F.transform("x", lambda c: F.when(F.abs(c * SCALE) < F.lit(2.0**62), F.floor(c * SCALE).cast("double")).otherwise(c * SCALE))
    return part.filter(F.col("vec_id").isNotNull() & F.col("x").isNotNull()).filter(finite).select("vec_id", scaled.alias("v"))


def boxes_of(points: DataFrame, cells: Cells, width: int, shard_rows: int) -> Boxes:
    """One row a cell reaches the driver."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        for batch in batches:
            rows = matrix(batch["v"], width)
            at = cells.of(rows)
            for c in np.unique(at).tolist():
                own = rows[at == c]
                n, low, high = held.get(c, (0, np.inf, -np.inf))
                held[c] = n + len(own), np.minimum(low, own.min(0)), np.maximum(high, own.max(0))
        columns = [list(held), [h[0] for h in held.values()], *([h[k].tobytes() for h in held.values()] for k in (1, 2))]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["cell", "n", "low", "high"])

    def merged(table: pa.Table) -> pa.Table:
        low, high = (np.array([np.frombuffer(x) for x in table[c].to_pylist()]) for c in ("low", "high"))
        return pa.table([table["cell"][:1], pa.array([sum(table["n"].to_pylist())]), pa.array([low.min(0).tobytes()]), pa.array([high.max(0).tobytes()])], names=["cell", "n", "low", "high"])

    schema = "cell long, n long, low binary, high binary"
    rows = sorted(points.select("v").mapInArrow(partial, schema).groupBy("cell").applyInArrow(merged, schema).collect())
    shards = np.array([-(-r.n // shard_rows) for r in rows], int)
    low, high = (np.array([np.frombuffer(r[c]) for r in rows]).reshape(len(rows), width) for c in ("low", "high"))
    return Boxes(np.array([r.cell for r in rows], int), np.cumsum(shards) - shards, shards, low, high)


def found(rows: DataFrame, width: int, k: int, schema: str) -> DataFrame:
    """Of rows (shard, kind 0 for vectors and 1 for queries, id, v, ask, floor), what the queries find in their shards: shuffled by shard, vectors first."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, points, ids = None, [], []
        trees: dict[bool, Tree] = {}
        for batch in batches:
            keys, kinds = batch["shard"].to_numpy(), batch["kind"].to_numpy()
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]) | (kinds[1:] != kinds[:-1])) + 1).tolist(), keys.size]
            out = []
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if keys[a] != shard:
                    shard, points, ids, trees = keys[a], [], [], {}
                part = batch.slice(a, b - a)
                own, own_ids = matrix(part["v"], width), part["id"].to_numpy()
                if kinds[a] == 0:
                    points.append(own)
                    ids.append(own_ids)
                elif points:
                    every = np.concatenate(points)
                    beyond = bool(np.abs(every).max(0) @ np.abs(own).max(0) >= EXACT)
                    if beyond not in trees:
                        trees[beyond] = Tree(whole(every) if beyond else every, np.concatenate(ids))
                    wanted, asks, floors = whole(own) if beyond else own, part["ask"].to_pylist(), part["floor"].to_pylist()
                    for at in range(0, len(wanted), 256):
                        bounds = trees[beyond].bounds(wanted[at : at + 256])
                        for q, own_id, ask, floor, bound in zip(wanted[at : at + 256], own_ids[at : at + 256].tolist(), asks[at : at + 256], floors[at : at + 256], bounds):
                            out += [(ask, own_id, i, s) for s, i in trees[beyond].search(q, own_id, bound, k, -float("inf") if floor is None else floor)]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in range(4)], ["ask", "query_id", "vec_id", "score"])

    return rows.sortWithinPartitions("shard", "kind").mapInArrow(search, schema)


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = 8192, most_cells: int = 4096, sample: int = 16_384
) -> DataFrame:
    """Per query row query_id, rank, vec_id and score: its k best among `vectors`, exactly.

    The driver holds `sample` vectors and the boxes of at most `most_cells` cells (fewer if vectors have over 64 components).
    """
    points = whole_numbers(vectors, id_col, vector_col)
    asked = common.stored(whole_numbers(queries, id_col, vector_col).withColumn("ask", F.monotonically_increasing_id()), "asked")
    n, width, asked_width = points.agg(F.count("*"), F.max(F.size("v"))).first() + asked.agg(F.max(F.size("v"))).first()
    width = max(1, width or 0, asked_width or 0)
    cells_wanted = min(most_cells, max(1, most_cells * 64 // width), 1 + n // shard_rows)
    depth = (cells_wanted - 1).bit_length()
    taken = points.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(min(sample, max(1, sample * 64 // width))).select("v").collect() if depth else []
    held = np.zeros((len(taken), width))
    for row, r in zip(held, taken):
        row[: len(r.v)] = r.v
    cells = Cells.fit(held, depth)
    boxes = boxes_of(points, cells, width, shard_rows)
    n_shards = int(boxes.shards.sum())
    given = points.sparkSession.sparkContext.broadcast((cells, boxes))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, boxes = given.value
        for batch in batches:
            at = np.searchsorted(boxes.cell, cells.of(matrix(batch["v"], width)))
            part = batch["part"].to_numpy() % boxes.shards[at]
            yield pa.RecordBatch.from_arrays([pa.array(boxes.first[at] + part), batch["vec_id"], batch["v"]], ["shard", "id", "v"])

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A query to each shard of the cell of its greatest bound, or, once it has its kth score, of the others that reach it."""
        boxes = given.value[1]
        for batch in batches:
            bounds = boxes.bounds(matrix(batch["v"], width))
            home = bounds.argmax(1)
            goes = np.zeros(bounds.shape, bool)
            if "floor" in batch.schema.names:
                floors = np.array([-np.inf if f is None else float(f) for f in batch["floor"].to_pylist()])
                goes = bounds >= floors[:, None] - 1e-9 * np.abs(floors[:, None]) if len(floors) else goes
                goes[np.arange(len(home)), home] = False
            else:
                goes[np.arange(len(home)), home] = True
            row, cell = np.nonzero(goes)
            times = boxes.shards[cell]
            shard = np.repeat(boxes.first[cell], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            whom = pa.array(np.repeat(row, times))
            floor = batch["floor"] if "floor" in batch.schema.names else pa.nulls(batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(shard), *(x.take(whom) for x in (batch["vec_id"], batch["v"], batch["ask"], floor))], ["shard", "id", "v", "ask", "floor"])

    lists, schema = "v array<double>", "ask long, query_id long, vec_id long, score long"
    # no partition holds more shards than chance deals to it
    spread = points.withColumn("part", F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 30))).mapInArrow(dealt, f"shard long, id long, {lists}")
    every = spread.select("shard", F.lit(0).alias("kind"), "id", "v", F.lit(None).cast("long").alias("ask"), F.lit(None).cast("long").alias("floor"))

    def matched(asks: DataFrame) -> DataFrame:
        to = asks.mapInArrow(sent, f"shard long, id long, {lists}, ask long, floor long") if n_shards else asks.sparkSession.createDataFrame([], f"shard long, id long, {lists}, ask long, floor long")
        both = every.unionByName(to.withColumn("kind", F.lit(1)))
        return found(both.repartition(max(1, n_shards), "shard"), width, k, schema)

    order = W.partitionBy("ask").orderBy(F.desc("score"), "vec_id")
    near = common.stored(matched(asked), "near")
    kth = near.withColumn("n", F.row_number().over(order)).filter(F.col("n") == k).select("ask", F.col("score").alias("floor"))
    far = matched(asked.join(kth, "ask", "left")) if len(boxes.cell) > 1 else near.limit(0)
    ranked = near.unionByName(far).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
