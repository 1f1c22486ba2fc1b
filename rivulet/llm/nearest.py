"""Approximate nearest neighbours by an inverted file with product-quantised residuals (operator 5).

A bounded sample trains coarse centroids and one codebook per slice of the residual. Every vector is indexed under its
nearest centroid. A query probes its nearest cells and estimates the distances of their vectors by asymmetric
tables. An estimate is off by no more than the length of what the vector's code leaves over, which the index keeps; every
vector that the estimates can't rule out gets its exact distance, so none of a probed cell is missed however coarse its
codes are. How many cells are probed is measured with queries against brute force over the sample.

Queries are sent to the tasks in blocks of bounded size; each task scans its part of the index, which lies in the order
of the cells, and keeps the best few of each query. No vector is shuffled to a cell or a query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rivulet.llm.common import materialise

#: Distinct vectors that training reads at most; k-means steps; slices and codes a slice of the quantiser.
TRAIN_ROWS, STEPS, SLICES, CODES = 20_000, 8, 16, 64
#: Vectors of a cell, on average, until the sample bounds the number of cells; least cells that a query probes.
CELL, PROBES = 512, 8
#: Sampled queries, and the share of their true neighbours in the sample that the probed cells must hold.
TRIALS, AIM = 200, 0.97
#: Rounding of an estimated distance, as a share of the numbers that it comes from.
SLACK = 1e-12
#: Query vectors of one broadcast block.
QUERIES = 20_000


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return ((centroids**2).sum(1) - 2 * x @ centroids.T).argmin(1)


def kmeans(x: np.ndarray, k: int, seed: int, steps: int = STEPS) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centroids = x[np.sort(rng.choice(len(x), min(k, len(x)), replace=False))].copy()
    for _ in range(steps):
        owner = _nearest(x, centroids)
        counts = np.bincount(owner, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, owner, x)
        centroids[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centroids


@dataclass
class Index:
    """Coarse centroids [cell, dim] and codebooks [slice, code, dim / slices]; dimensions are padded with zeros to whole slices."""

    centroids: np.ndarray
    books: np.ndarray
    dim: int
    probed: int = PROBES

    def pad(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, self.books.shape[0] * self.books.shape[2] - self.dim)))

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cells, codes, and the length of what each vector's codes leave over."""
        cells = _nearest(x, self.centroids)
        rest = self.pad(x - self.centroids[cells]).reshape(len(x), self.books.shape[0], -1)
        codes = np.stack([_nearest(rest[:, s], self.books[s]) for s in range(len(self.books))], 1).astype(np.uint8)
        over = np.sqrt(sum(((rest[:, s] - self.books[s][codes[:, s]]) ** 2).sum(1) for s in range(len(self.books))))
        return cells, codes, over

    def probes(self, q: np.ndarray) -> np.ndarray:
        """The cells that each query probes, nearest first."""
        d = (self.centroids**2).sum(1) - 2 * q @ self.centroids.T
        return np.argsort(d, 1, kind="stable")[:, : self.probed]

    def tables(self, q: np.ndarray, cell: int) -> np.ndarray:
        """Squared distances [query, slice, code] of the queries' residuals in a cell to all codes."""
        rest = self.pad(q - self.centroids[cell]).reshape(len(q), self.books.shape[0], 1, -1)
        return ((rest - self.books[None]) ** 2).sum(-1)


def train(vectors: DataFrame, queries: DataFrame, n: int, k: int = 10, max_rows: int = TRAIN_ROWS, seed: int = 7) -> Index | None:
    """Trains on at most ``max_rows`` distinct vectors and tries TRIALS distinct queries, both chosen by a hash of their values."""
    rows = vectors.select("v").orderBy(F.xxhash64("v"), "v").limit(max_rows).toPandas()
    if not len(rows):
        return None
    x = np.array(rows.v.tolist(), float)
    centroids = kmeans(x, int(max(1, min(math.ceil(n / CELL), len(x) // 16))), seed)
    rest = x - centroids[_nearest(x, centroids)]
    width = -(-x.shape[1] // SLICES)
    rest = np.pad(rest, ((0, 0), (0, width * SLICES - x.shape[1]))).reshape(len(x), SLICES, width)
    books = np.stack([_fill(kmeans(rest[:, s], CODES, seed + s)) for s in range(SLICES)])
    index = Index(centroids, books, x.shape[1])
    trials = queries.select("v").orderBy(F.xxhash64("v"), "v").limit(TRIALS).toPandas()
    index.probed = _depth(index, x, np.array(trials.v.tolist(), float).reshape(len(trials), x.shape[1]), k)
    return index


def _depth(index: Index, x: np.ndarray, trials: np.ndarray, k: int) -> int:
    """The number of cells that hold the share AIM of the k nearest of the tried queries. Neighbours in a sample are farther than in all rows, so it errs upwards."""
    index.probed = len(index.centroids)
    place, cells, at = np.argsort(index.probes(trials), 1), _nearest(x, index.centroids), []  # rank of each cell
    for of, q in enumerate(trials):
        d = ((x - q) ** 2).sum(1)
        other = np.flatnonzero(d > 0)  # equal vectors lie in the first cell
        at.append(place[of, cells[other[np.argsort(d[other], kind="stable")[:k]]]])
    at = np.concatenate(at) if at else np.zeros(0)
    return int(max(PROBES, np.quantile(at, AIM, method="higher") + 1 if len(at) else 1))


def _fill(book: np.ndarray) -> np.ndarray:
    return np.concatenate([book, np.repeat(book[:1], CODES - len(book), 0)]) if len(book) < CODES else book


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and vector (doubles) of the rows that take part: not null, not zero, all components finite."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    return rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0))


def search(vectors: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest found of every distinct query (rows whose id is divisible by ``every``): query_id, rank, vec_id, score (Euclidean distance of the original vectors).

    Ties go to the smaller id; a query's own row is no candidate. Equal vectors are one entry of the index: of their
    ids the k + 1 smallest can be among any k nearest, and only those are kept (a window limit, taken before the
    shuffle), so copies cost nothing and nothing is lost. Vectors of another length than the most common one are
    searched among themselves. Null, zero and non-finite vectors take no part; rows that repeat id and vector are one.
    """
    rows = usable(vectors, id_col, vector_col)
    sizes = [r.n for r in rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").collect()]
    parts = [_search(rows.where(F.size("v") == n), k, every) for n in sizes] or [_search(rows, k, every)]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def _search(rows: DataFrame, k: int, every: int) -> DataFrame:
    spark = rows.sparkSession
    top = rows.agg(F.max(F.array_max(F.transform("v", F.abs)))).head()[0] or 1.0
    # squares of numbers beyond 1e150 overflow and those of numbers below 1e-150 vanish; a power of two changes no digit
    scale = 1.0 if 1e-150 < top < 1e150 else 2.0 ** -max(-1_000, min(1_000, math.frexp(top)[1]))
    rows = rows.withColumn("v", F.transform("v", lambda x: x * F.lit(scale) + F.lit(0.0)))  # -0.0 becomes 0.0, so equal vectors are equal keys
    by_vector = Window.partitionBy("v").orderBy("id")
    kept = rows.withColumn("_n", F.dense_rank().over(by_vector)).where(F.col("_n") <= k + 1)
    kept = materialise(kept.groupBy("v").agg(F.sort_array(F.collect_set("id")).alias("ids")))
    n = kept.count()
    queries = rows.where(F.col("id") % every == 0).select("id", "v")
    asked = materialise(queries.select("v").distinct())
    index = train(kept, asked, n, k)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shared = spark.sparkContext.broadcast(index)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cells, codes, over = shared.value.encode(np.array(batch.v.tolist(), float).reshape(len(batch), -1))
            yield pd.DataFrame({"cell": cells, "ids": batch.ids, "v": batch.v, "code": [c.tobytes() for c in codes], "over": over})

    indexed = kept.mapInPandas(encode, "cell int, ids array<long>, v array<double>, code binary, over double")
    indexed = materialise(indexed.repartitionByRange("cell", F.xxhash64("v")).sortWithinPartitions("cell"))
    blocks, found = math.ceil(asked.count() / QUERIES), None
    for block in range(blocks):
        q = asked.where(F.pmod(F.xxhash64("v"), F.lit(blocks)) == block).toPandas()
        if not len(q):
            continue
        part = _scanned(indexed, shared, spark.sparkContext.broadcast(np.array(q.v.tolist(), float)), k)
        part = materialise(part)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # per distinct query vector: the k + 1 nearest ids; each of its queries then leaves itself out
    nearest = found.select("v", "score", F.explode("ids").alias("vec_id"))
    nearest = nearest.withColumn("_n", F.row_number().over(Window.partitionBy("v").orderBy("score", "vec_id"))).where(F.col("_n") <= k + 1)
    pairs = queries.distinct().select(F.col("id").alias("query_id"), "v").join(nearest, "v").where("query_id != vec_id")
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "v").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", (F.col("score") / F.lit(scale)).alias("score"))


def _kept(low: np.ndarray, high: np.ndarray, worst: np.ndarray, n: int) -> np.ndarray:
    """Which vectors [query, vector] can be among the n nearest, by bounds of their distances and the n-th best so far."""
    bound = np.minimum(worst, np.partition(high, n - 1, 1)[:, n - 1]) if n <= high.shape[1] else worst
    return low <= bound[:, None]


def _nearer(q: np.ndarray, x: np.ndarray, centre: np.ndarray, told: np.ndarray, over: np.ndarray, worst: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, vectors, exact distances) of the vectors of a cell that may be among each query's n nearest: none that is goes.

    Bounds come from the estimates first, then, for vectors that some query keeps, from products of what lies off the
    centre, whose rounding is bounded.
    """
    slack = SLACK * (np.abs(x).max() + np.abs(q).max() + np.abs(centre).max() + told)
    kept = _kept(told - over - slack, told + over + slack, worst, n)
    some = np.flatnonzero(kept.any(0))
    a, b = q - centre, x[some] - centre
    sizes = (a**2).sum(1)[:, None] + (b**2).sum(1)
    squares, off = sizes - 2 * a @ b.T, 1e-15 * (x.shape[1] + 8) * sizes
    low, high = np.sqrt(np.maximum(squares - off, 0)) - slack[:, some], np.sqrt(np.maximum(squares + off, 0)) + slack[:, some]
    row, column = np.nonzero(kept[:, some] & _kept(low, high, worst, n))
    exact = np.concatenate([np.sqrt(((x[some[column[i : i + 20_000]]] - q[row[i : i + 20_000]]) ** 2).sum(1)) for i in range(0, len(row), 20_000)] or [np.zeros(0)])
    ends = np.searchsorted(row, np.arange(len(q) + 1))
    for of in np.flatnonzero(np.diff(ends)):
        at = slice(ends[of], ends[of + 1])
        closer = np.flatnonzero(exact[at] <= worst[of])
        if len(closer):
            yield int(of), some[column[at][closer]], exact[at][closer]


def _scanned(indexed: DataFrame, index: Broadcast, block: Broadcast, k: int) -> DataFrame:
    """(v, score, ids) of the k + 1 best of each task for each query vector of the block. A task holds a batch of the index and its best so far."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q = block.value
        probed = np.zeros((len(q), len(index.value.centroids)), bool)
        for i in range(0, len(q), 1_000):
            part = index.value.probes(q[i : i + 1_000])
            probed[np.arange(i, i + len(part))[:, None], part] = True
        best: dict[int, list[tuple]] = {}
        worst = np.full(len(q), np.inf)
        for batch in batches:
            x, cells, over = np.array(batch.v.tolist(), float).reshape(len(batch), -1), batch.cell.to_numpy(), batch.over.to_numpy()
            codes = np.frombuffer(b"".join(batch.code), np.uint8).reshape(len(batch), -1)
            for cell in np.unique(cells):
                at = np.flatnonzero(cells == cell)
                asked = np.flatnonzero(probed[:, cell])
                for i in range(0, len(asked), 256):
                    some = asked[i : i + 256]
                    tables = index.value.tables(q[some], int(cell))
                    told = np.sqrt(sum(tables[:, s, codes[at, s]] for s in range(tables.shape[1])))
                    for of, row, exact in _nearer(q[some], x[at], index.value.centroids[cell], told, over[at], worst[some], k + 1):
                        mine = best.get(int(some[of]), [])
                        new = [(d, batch.ids.iloc[at[r]]) for d, r in zip(exact, row, strict=True)]
                        best[int(some[of])] = mine = sorted(mine + new, key=lambda m: (m[0], m[1][0]))[: k + 1]  # what comes later is not among the k nearest of all others
                        worst[some[of]] = mine[-1][0] if len(mine) > k else np.inf
        made = [(q[of], score, ids) for of, mine in best.items() for score, ids in mine]
        for i in range(0, len(made), 10_000):
            yield pd.DataFrame(made[i : i + 10_000], columns=["v", "score", "ids"])

    return indexed.mapInPandas(run, "v array<double>, score double, ids array<long>")
