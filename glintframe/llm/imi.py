"""Nearest neighbours by an inverted multi-index.

Two codebooks quantise the two halves of a vector separately; a pair of centroids
names a cell.  A query visits cells in the order of summed distance, found by a heap
over the two sorted distance lists, until enough entries are seen; distance is the
negative inner product of a half with its centroid, as the inner product is asked
for.  The inverted lists lie in the order of cells, cut into shards; a query goes to
the shards that hold cells it visits, and there it is multiplied with the entries of
those cells alone.  Codebooks are fitted on a bounded sample, every row is indexed.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, mix, tuned

#: Vectors that the codebooks are fitted on, at most (those of smallest id hash).
SAMPLE = 10_000
#: Centroids of a half: they grow with the fourth root of the rows, between these.
LEAST_CENTROIDS, MOST_CENTROIDS = 128, 256
#: Share of the entries that a query sees.  Vectors without any cluster structure need this much
#: for a recall of 0.93 and more; clustered ones need far less.
FRACTION = 0.45
SHARD, QUERY_BLOCK = 16_384, 4_096


def centroids_for(n: int) -> int:
    """A power of two near ``8 * n ** (1 / 4)``."""
    return int(min(MOST_CENTROIDS, max(LEAST_CENTROIDS, 2 ** round(math.log2(8 * max(n, 1) ** 0.25)))))


def _kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    r = np.random.default_rng(seed)
    c = x[r.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = ((c * c).sum(1) - 2 * x @ c.T).argmin(1)
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


@dataclass
class Codebooks:
    first: np.ndarray
    second: np.ndarray

    @staticmethod
    def fit(x: np.ndarray, k: int = LEAST_CENTROIDS) -> Codebooks:
        half = x.shape[1] // 2
        return Codebooks(_kmeans(x[:, :half], k, seed=1), _kmeans(x[:, half:], k, seed=2))

    def cells(self, x: np.ndarray) -> np.ndarray:
        """The pair of nearest centroids of each vector."""
        half = self.first.shape[1]
        one = lambda y, c: ((c * c).sum(1) - 2 * y @ c.T).argmin(1)
        return one(x[:, :half], self.first) * len(self.second) + one(x[:, half:], self.second) if len(x) else np.zeros(0, np.int64)

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Negative inner products of both halves with their centroids."""
        half = self.first.shape[1]
        return -x[:, :half] @ self.first.T, -x[:, half:] @ self.second.T

    def visit(self, a: np.ndarray, b: np.ndarray, held: np.ndarray, enough: int) -> np.ndarray:
        """Cells in the order of summed distance until they hold ``enough`` entries, as flags.

        The heap has, of every first centroid begun, the pair with the next second one;
        a first centroid begins when the one before it has given its first pair.
        """
        seen, n = np.zeros(held.size, bool), 0
        ia, ib = a.argsort(kind="stable"), b.argsort(kind="stable").tolist()
        a, b, size, width = a[ia].tolist(), np.sort(b).tolist(), held.tolist(), len(b)
        base = (ia * width).tolist()
        heap, visited = [(a[0] + b[0], 0, 0)], []
        while heap and n < enough:
            _, i, j = heap[0]
            cell = base[i] + ib[j]
            visited.append(cell)
            n += size[cell]
            if j + 1 < width:
                heapq.heapreplace(heap, (a[i] + b[j + 1], i, j + 1))
            else:
                heapq.heappop(heap)
            if j == 0 and i + 1 < len(a):
                heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))
        seen[visited] = True
        return seen


@dataclass
class Shards:
    """Cells in order, cut where about ``SHARD`` entries are full; a larger cell is dealt over several shards."""

    first: np.ndarray  # by cell: its first shard
    count: np.ndarray  # by cell: its shards
    low: np.ndarray  # by shard: first cell, and the end
    high: np.ndarray

    @staticmethod
    def of(held: np.ndarray, most: int = SHARD) -> Shards:
        first, count, low, high, n = np.zeros(len(held), np.int64), np.ones(len(held), np.int64), [0], [], 0
        for cell, size in enumerate(held.tolist()):
            parts = -(-size // most)
            if n and (n + size > most or parts > 1):
                high.append(cell)
                low.append(cell)
                n = 0
            first[cell], n = len(low) - 1, n + size
            if parts > 1:
                count[cell] = parts
                high += [cell + 1] * parts
                low += [cell] * (parts - 1) + [cell + 1]
                n = 0
        return Shards(first, count, np.array(low), np.array([*high, len(held)]))

    def place(self, cell: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The shard of each entry."""
        return self.first[cell] + (mix(ids.view(np.uint64)) % self.count[cell].astype(np.uint64)).astype(np.int64)


def visited_scores(q: np.ndarray, seen: np.ndarray, e: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, int]:
    """Inner products of queries with the entries (in order of cells) of the cells they see, else minus infinity; how many."""
    score, n = np.full((len(q), len(e)), -np.inf), 0
    begin = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, np.int64)
    for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(cell)]):
        who = np.flatnonzero(seen[:, cell[a]])
        if len(who):
            score[who, a:b] = q[who] @ e[a:b].T
            n += len(who) * (b - a)
    return score, n


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _steps(count: np.ndarray) -> np.ndarray:
    """0 to count - 1 for each count, one after another."""
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)


def valid_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, v``: vectors that take part.

    Null, empty and zero vectors and those with null or non-finite components take
    no part, nor do those of another length than the most frequent one.  Rows that
    repeat an id and its vector count once.
    """
    v = F.col("v")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    return rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & ~F.exists(v, bad) & F.exists(v, lambda x: x != 0))


def nearest(vectors: DataFrame, query: str, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", fraction: float = FRACTION, centroids: int | None = None) -> DataFrame:
    """The ``k`` nearest found of every row that satisfies the SQL expression ``query`` over ``vec_id``.

    Nearest is largest inner product in double precision, ties to the smaller id.
    Candidates are all rows with another id than the query's.  Returns ``query_id,
    rank, vec_id, score``.  Of equal vectors only the ``k + 1`` smallest ids can be
    among the nearest, so only those are entries; equal queries are searched once.
    Too few rows give fewer neighbours; without valid rows the result is empty.
    """
    spark = tuned(vectors.sparkSession)
    rows = valid_vectors(vectors, id_col, vector_col)
    top = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if top is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    dim = top["d"]
    rows = rows.where(F.size("v") == dim).distinct()
    few = Window.partitionBy("v").orderBy("vec_id")
    sample = np.array([r["v"] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()])
    books = Codebooks.fit(sample, centroids or centroids_for(rows.count()))
    n_cells = len(books.first) * len(books.second)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(books.cells(_matrix(b.column(1), dim)), pa.int32())], names=["vec_id", "v", "cell"])

    entries = cut(rows.withColumn("r", F.row_number().over(few)).where(F.col("r") <= k + 1).drop("r").mapInArrow(assign, "vec_id bigint, v array<double>, cell int"))
    held = np.zeros(n_cells, np.int64)
    for r in entries.groupBy("cell").count().collect():  # one row a cell, of which there are centroids squared
        held[r["cell"]] = r["count"]
    total = int(held.sum())
    enough = min(total, max(math.ceil(fraction * total), 4 * k))
    asked = cut(rows.where(query).groupBy("v").agg(F.min("vec_id").alias("q")))
    n_queries = asked.count()
    blocks, shards = max(1, math.ceil(n_queries / QUERY_BLOCK)), Shards.of(held)

    def traverse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first, second = books.distances(_matrix(b.column(0), dim))
            row, shard, seen = [], [], []
            for r, (x, y) in enumerate(zip(first, second)):
                flags = books.visit(x, y, held, enough)
                for k in np.unique(np.repeat(shards.first[flags], shards.count[flags]) + _steps(shards.count[flags])).tolist():
                    row.append(r)
                    shard.append(k)
                    seen.append(np.packbits(flags[shards.low[k] : shards.high[k]]).tobytes())
            pick = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pick), b.column(1).take(pick), pa.array(shard, pa.int32()), pa.array(seen, pa.binary())], names=["v", "q", "shard", "seen"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = shards.place(b.column(2).to_numpy().astype(np.int64), b.column(0).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int32())], names=["vec_id", "v", "cell", "shard"])

    deal = F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int").alias("block")
    left = asked.repartition(max(1, min(n_queries // 64 + 1, 4 * spark.sparkContext.defaultParallelism))).mapInArrow(traverse, "v array<double>, q bigint, shard int, seen binary").select("*", deal)
    right = entries.mapInArrow(place, "vec_id bigint, v array<double>, cell int, shard int").select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))

    def rerank(queries: pa.Table, shard: pa.Table) -> pa.Table:
        shard = shard.sort_by("cell")
        ids, cell = shard.column("vec_id").to_numpy(), shard.column("cell").to_numpy()
        e = _matrix(shard.column("v").combine_chunks(), dim) if shard.num_rows else np.zeros((0, dim))
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        for at in range(0, queries.num_rows if len(e) else 0, 256):
            part = queries.slice(at, 256)
            q, low, high = _matrix(part.column("v").combine_chunks(), dim), *(x[part.column("shard")[0].as_py()] for x in (shards.low, shards.high))
            seen = np.unpackbits(np.frombuffer(b"".join(part.column("seen").to_pylist()), np.uint8).reshape(len(q), -1), axis=1, count=high - low).astype(bool)
            score, _ = visited_scores(q, seen, e, cell - low)
            m = min(k + 1, len(e))
            bar = np.partition(score, len(e) - m, axis=1)[:, len(e) - m] - 1e-9
            r, c = np.nonzero((score >= bar[:, None]) & np.isfinite(score))
            exact = (q[r] * e[c]).sum(1)
            order = np.lexsort((ids[c], -exact, r))
            r, c, exact = r[order], c[order], exact[order]
            place = np.arange(len(r)) - np.searchsorted(r, r)
            keep = place <= k
            for column, x in zip(out, (part.column("q").to_numpy()[r[keep]], ids[c[keep]], exact[keep])):
                column.append(x)
        return pa.table({"q": np.concatenate(out[0]), "vec_id": np.concatenate(out[1]), "score": np.concatenate(out[2])})

    found = left.groupBy("block", "shard").cogroup(right.groupBy("block", "shard")).applyInArrow(rerank, "q bigint, vec_id bigint, score double")
    order = [F.desc("score"), "vec_id"]
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where(F.col("r") <= k + 1).drop("r")
    queries = rows.where(query).select(F.col("vec_id").alias("query_id"), "v").join(asked, "v").select("query_id", "q")
    final = queries.join(best, "q").where("query_id <> vec_id")
    final = final.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)
    return final.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def nearest_of_twentieth(vectors: DataFrame) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20."""
    return nearest(vectors, "vec_id % 20 = 0")
