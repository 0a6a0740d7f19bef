"""Exact top-k inner-product search: a ball tree for each shard, searched by branch and bound.

Vectors are turned into integers floor(256 x), once. A bounded number of them, chosen by hash, are pivots; each vector
lies in the cell of its nearest pivot, and a cell of many vectors is dealt by hash into shards of bounded size, so a
common vector fills several. A shard builds a ball tree; in it nodes are visited in the order of their upper bounds,
query by query a node is left out whose bound <q, centre> + |q| radius lies below the query's kth score so far, and
leaves are scored by one product. Every query first searches its own shard; the kth score found there goes with it,
and it travels only to shards whose cell's bound reaches that score. Queries travel in packed blocks and stream
through a shard, of which a task holds nothing but the tree. Ties go to the smaller vec_id, so a bound equal to the kth
score is still visited.

Defined cases: vectors that are null or hold null or non-finite components take no part, nor do those without an id;
vectors of different lengths are compared with those of their own length only; rows that share a vec_id are rows of
their own, as queries and as candidates; fewer candidates than k give fewer rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, lean, small_batches

K, SHARD, LEAF, QUERY_BLOCK, SCALE = 5, 16384, 64, 512, 256
#: Pivots of vectors of one length, at most; they are broadcast with a radius each.
PIVOTS = 1024


class BallTree:
    """Rows are reordered so that each node is a range; children split at the middle of the widest direction."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, rows: np.ndarray):
        order = np.arange(len(x))
        self.nodes: list[tuple[int, int, int, int]] = []  # first, end, left child, right child (or -1)
        centres, radii = [], []
        stack = [(0, len(x), -1, 0)]
        while stack:
            a, b, parent, side = stack.pop()
            part = x[order[a:b]]
            centre = part.mean(axis=0)
            away = ((part - centre) ** 2).sum(axis=1)
            me = len(self.nodes)
            self.nodes.append((a, b, -1, -1))
            centres.append(centre)
            radii.append(np.sqrt(away.max()))
            if parent >= 0:
                p = self.nodes[parent]
                self.nodes[parent] = (p[0], p[1], me, p[3]) if side == 0 else (p[0], p[1], p[2], me)
            if b - a > LEAF:
                far = part[away.argmax()]
                other = part[((part - far) ** 2).sum(axis=1).argmax()]
                along = part @ (other - far)
                m = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(along, m)]
                stack += [(a, a + m, me, 0), (a + m, b, me, 1)]
        self.x, self.ids, self.rows = x[order], ids[order], rows[order]
        self.centres, self.radii = np.array(centres), np.array(radii)

    def search(self, q: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best (scores, ids) of each query, -inf where there are fewer; own: its row; floor: a score the kth has anyway."""
        n = len(q)
        best = np.full((n, k), -np.inf)
        who = np.full((n, k), np.iinfo(np.int64).max)
        # rounding of the bound itself is covered by a margin that follows its size
        reach = np.sqrt((q * q).sum(axis=1))
        bound = q @ self.centres.T + reach[:, None] * self.radii
        bound += 1e-9 * np.abs(bound) + 1e-6
        kth = floor.astype(np.float64).copy()
        heap = [0]
        while heap:
            # the node with the highest bound of any query that still needs it
            need = bound[:, heap] >= kth[:, None]
            value = np.where(need, bound[:, heap], -np.inf).max(axis=0)
            top = int(value.argmax())
            if value[top] == -np.inf:
                break
            node = heap.pop(top)
            a, b, left, right = self.nodes[node]
            if left >= 0:
                heap += [left, right]
                continue
            some = np.flatnonzero(bound[:, node] >= kth)
            s = q[some] @ self.x[a:b].T
            s[own[some][:, None] == self.rows[a:b]] = -np.inf
            all_s = np.concatenate([best[some], s], axis=1)
            all_i = np.concatenate([who[some], np.broadcast_to(self.ids[a:b], s.shape)], axis=1)
            order = np.lexsort((all_i, -all_s), axis=1)[:, :k]
            best[some] = np.take_along_axis(all_s, order, axis=1)
            who[some] = np.take_along_axis(all_i, order, axis=1)
            kth[some] = np.maximum(floor[some], best[some, k - 1])
        return best, who


def integers(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """(row, vec_id, dim, q) with q the integers as little-endian doubles, which hold them exactly up to 2**53."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            size = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy().astype(np.int64)
            flat = lists.flatten().cast(pa.float64())  # without what null lists cover
            x = flat.to_numpy(zero_copy_only=False)  # nulls become NaN
            ends = np.concatenate([[0], np.cumsum(size)])
            odd = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
            good = (size > 0) & (odd[ends[1:]] == odd[ends[:-1]]) & ~ids.is_null().to_numpy(zero_copy_only=False)
            data = np.floor(SCALE * x[np.repeat(good, size)]).astype("<f8")
            at = np.concatenate([[0], np.cumsum(8 * size[good])]).astype(np.int32)
            if good.any():
                q = pa.Array.from_buffers(pa.binary(), int(good.sum()), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(data.tobytes())])
                yield pa.RecordBatch.from_arrays([ids.filter(pa.array(good)), pa.array(size[good].astype(np.int32)), q], ["vec_id", "dim", "q"])

    small_batches(vectors.sparkSession)
    made = vectors.select(vectors[key].cast("long").alias("vec_id"), vectors[column].cast("array<double>").alias("v")).mapInArrow(lean(rows), "vec_id long, dim int, q binary")
    return checkpointed(made.withColumn("row", F.monotonically_increasing_id()))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(-1, dim)


def by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of a batch (row, vec_id, dim, q, …) of each length."""
    dims = batch.column(2).to_numpy()
    for dim in np.unique(dims).tolist():
        yield dim, batch.filter(pa.array(dims == dim))


class Cells:
    """All pivots of each length; each with the radius of its cell and its shards: ``shards`` of them from ``first`` on."""

    def __init__(self, pivots: dict[int, np.ndarray]):
        self.pivots = pivots
        self.base = dict(zip(pivots, np.cumsum([0, *(len(p) for p in pivots.values())]).tolist(), strict=False))
        n = sum(map(len, pivots.values()))
        self.radius, self.first, self.shards = np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each vector, and how far its pivot is."""
        p = self.pivots[x.shape[1]]
        cell = (x @ p.T - (p * p).sum(axis=1) / 2).argmax(axis=1)
        return self.base[x.shape[1]] + cell, np.sqrt(((x - p[cell]) ** 2).sum(axis=1))

    def own_shard(self, cell: np.ndarray, row: np.ndarray) -> np.ndarray:
        spread = (row.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        return self.first[cell] + (spread % self.shards[cell].astype(np.uint64)).astype(np.int64)

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, slice]:
        """An upper bound of each vector's products with those of each cell of its length; which cells these are."""
        p = self.pivots[x.shape[1]]
        own = slice(self.base[x.shape[1]], self.base[x.shape[1]] + len(p))
        out = x @ p.T + np.sqrt((x * x).sum(axis=1))[:, None] * self.radius[own]
        return out + 1e-9 * np.abs(out) + 1e-6, own


def cells_of(vectors: DataFrame) -> tuple[DataFrame, Cells]:
    """The vectors with their cells, and the cells: at most PIVOTS for each length, with a radius and a count."""
    count = vectors.groupBy("dim").count().collect()
    spread = Window.partitionBy("dim").orderBy(F.xxhash64("row", "vec_id"), "row")
    most = min(PIVOTS, max([1, *(-(-r["count"] // SHARD) for r in count)]))
    chosen = vectors.withColumn("_r", F.row_number().over(spread)).where(F.col("_r") <= most).select("dim", "q").collect()
    pivots: dict[int, list[np.ndarray]] = {}
    for r in chosen:
        pivots.setdefault(r["dim"], []).append(np.frombuffer(r["q"], "<f8"))
    cells = Cells({d: np.array(p) for d, p in sorted(pivots.items())})
    shared = vectors.sparkSession.sparkContext.broadcast(cells)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for dim, batch in by_dim(whole):
                cell, away = shared.value.nearest(matrix(batch.column(3), dim))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(away)], ["row", "vec_id", "dim", "q", "cell", "away"])

    told = checkpointed(vectors.select("row", "vec_id", "dim", "q").mapInArrow(lean(rows), "row long, vec_id long, dim int, q binary, cell int, away double"))
    at = 0
    for r in sorted(told.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect()):
        cells.radius[r["cell"]], cells.first[r["cell"]], cells.shards[r["cell"]] = r["radius"] * (1 + 1e-9) + 1e-6, at, -(-r["n"] // SHARD)
        at += -(-r["n"] // SHARD)
    return told, cells


PACKED = "shard long, kind int, dim int, rows binary, ids binary, floors binary, q binary"


def packed(shard: int, kind: int, x: np.ndarray, rows: np.ndarray, ids: np.ndarray, floors: np.ndarray) -> pa.RecordBatch:
    values = [[shard], [kind], [x.shape[1]], [rows.tobytes()], [ids.tobytes()], [floors.tobytes()], [x.tobytes()]]
    types = [pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], [c.split()[0] for c in PACKED.split(", ")])


def at_home(kind: int, shared):
    """Blocks of rows for their own shards: candidates (kind 0) or queries (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for dim, batch in by_dim(whole):
                row, ids, x = batch.column(0).to_numpy(), batch.column(1).to_numpy(), matrix(batch.column(3), dim)
                shard = shared.value.own_shard(batch.column(4).to_numpy(), row)
                for one in np.unique(shard).tolist():
                    some = shard == one
                    yield packed(one, kind, x[some], row[some], ids[some], np.full(int(some.sum()), -np.inf))

    return run


def abroad(shared):
    """Blocks of queries (with a floor) for the other shards that their floors don't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            cells = shared.value
            for dim, batch in by_dim(whole):
                row, ids, x = batch.column(0).to_numpy(), batch.column(1).to_numpy(), matrix(batch.column(3), dim)
                home, floor = cells.own_shard(batch.column(4).to_numpy(), row), batch.column(5).to_numpy()
                bounds, own = cells.bounds(x)
                for k, first, shards in zip(range(bounds.shape[1]), cells.first[own].tolist(), cells.shards[own].tolist(), strict=True):
                    reach = bounds[:, k] >= floor
                    for one in range(first, first + shards):
                        some = reach & (home != one)
                        if some.any():
                            yield packed(one, 1, x[some], row[some], ids[some], floor[some])

    return run


FOUND = "query_row long, query_id long, vec_id long, score double"


def seek(k: int):
    """From rows ordered by shard, candidates first: the k best of each query in the shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, parts, tree = None, [], None
        for batch in batches:
            for r in batch.to_pylist():
                if r["shard"] != shard:
                    shard, parts, tree = r["shard"], [], None
                x = np.frombuffer(r["q"], "<f8").reshape(-1, r["dim"])
                rows, ids = np.frombuffer(r["rows"], np.int64), np.frombuffer(r["ids"], np.int64)
                if r["kind"] == 0:
                    parts.append((x, ids, rows))
                    continue
                if tree is None:
                    if not parts:
                        continue
                    tree, parts = BallTree(*(np.concatenate(p) for p in zip(*parts, strict=True))), []
                floors = np.frombuffer(r["floors"], np.float64)
                for a in range(0, len(x), QUERY_BLOCK):
                    b = slice(a, a + QUERY_BLOCK)
                    best, who = tree.search(x[b], rows[b], floors[b], k)
                    q, j = np.nonzero(np.isfinite(best))
                    yield pa.RecordBatch.from_arrays([pa.array(rows[b][q]), pa.array(ids[b][q]), pa.array(who[q, j]), pa.array(best[q, j])], [c.split()[0] for c in FOUND.split(", ")])

    return run


def search(vectors: DataFrame, is_query, k: int = K) -> DataFrame:
    """vectors: from ``integers``; is_query: a condition on them. (query_id, rank, vec_id, score), k rows a query row at most."""
    told, cells = cells_of(vectors)
    shared = vectors.sparkSession.sparkContext.broadcast(cells)
    queries = told.where(is_query).drop("away")
    candidates = told.drop("away").mapInArrow(lean(at_home(0, shared)), PACKED)

    def met(asked: DataFrame) -> DataFrame:
        return candidates.unionByName(asked).repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(lean(seek(k)), FOUND)

    first = checkpointed(met(queries.mapInArrow(lean(at_home(1, shared)), PACKED)))
    none = F.lit(float("-inf"))
    kth = first.groupBy("query_row").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(none).alias("floor"))
    others = queries.join(kth.withColumnRenamed("query_row", "row"), "row", "left").select("row", "vec_id", "dim", "q", "cell", F.coalesce("floor", none).alias("floor"))
    best = first.unionByName(met(others.mapInArrow(lean(abroad(shared)), PACKED)))
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.col("score").cast("long").alias("score"))


def digest(embeddings: DataFrame) -> DataFrame:
    """Queries are the rows whose vec_id is divisible by 50, candidates all rows but the query's own."""
    return search(integers(embeddings, "vec_id", "embedding"), F.col("vec_id") % 50 == 0, K)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""
