"""Approximate nearest neighbours: score-aware anisotropic product quantisation, four-bit table scans, exact reranking.

A vector is its nearest coarse centre plus a difference. The difference's direction is coded in groups of PAIR
components, each by one of 16 centres; its length is kept, so that crowded places are coded as finely as they
are crowded. Codebooks and codes minimise a loss that weighs the part of the residual which is parallel to
the direction ETA times as much as the rest, as only that part shifts large inner products. A query's inner
products with all centres make tables of 16; two neighbouring four-bit codes are scanned at once in a table
of 256. In every block of vectors (which holds equal vectors once for each id that can matter) the best
candidates of a query are reranked by exact double-precision distances to the original vectors, and the
nearest of all blocks are the result.

Codebooks are fitted to at most TRAIN_ROWS vectors, those with the least hash of their id; every vector is
coded and scanned. Queries come in blocks of QUERIES and vectors in blocks of VECTORS, so no task holds more.

Defined results: vectors that are null, empty, zero, hold null or non-finite components, have a null vec_id
or another dimension than the most take no part; ties go to the smaller vec_id; rows that share a vec_id are
one vector for the query itself (none of them is its own neighbour) but separate candidates, and repeated
query rows are one query; with fewer than K candidates all are given; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, map_batches, staged

K, EVERY, ETA = 10, 100, 4.0
PAIR = 2  # components in a group
TRAIN_ROWS, ROUNDS, COARSE = 20_000, 8, 64
QUERIES, VECTORS, RERANK = 256, 4_096, 96
#: Bytes of queries that are broadcast at once.
SENT = 8 << 20


class Quantiser:
    """Coarse centres, and for the directions of what vectors differ from theirs by, centres of (groups, 16, PAIR)."""

    def __init__(self, train: np.ndarray, eta: float = ETA, seed: int = 3):
        self.dim = train.shape[1]
        self.groups = -(-self.dim // PAIR)
        self.groups += self.groups % 2  # two codes make a byte
        self.eta = eta
        rng = np.random.default_rng(seed)
        self.coarse = train[rng.permutation(len(train))[:COARSE]].copy()
        for _ in range(ROUNDS):
            own = self.nearest(train)
            for c in np.unique(own):
                self.coarse[c] = train[own == c].mean(axis=0)
        x = self.split(self.residuals(train)[1])
        self.centres = np.stack([x[rng.integers(0, len(train), 16), g] for g in range(self.groups)])
        for _ in range(ROUNDS):
            self.update(x, self.codes(x))

    def nearest(self, vectors: np.ndarray) -> np.ndarray:
        return ((self.coarse**2).sum(axis=1) - 2 * vectors @ self.coarse.T).argmin(axis=1)

    def residuals(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Coarse centre, direction of the difference to it, and the difference's length."""
        own = self.nearest(vectors)
        r = vectors - self.coarse[own]
        size = np.linalg.norm(r, axis=1)
        return own, r / np.maximum(size, 1e-300)[:, None], size

    def split(self, vectors: np.ndarray) -> np.ndarray:
        """Vectors as (n, groups, PAIR), with zeros at the end."""
        return np.pad(vectors, ((0, 0), (0, self.groups * PAIR - self.dim))).reshape(len(vectors), self.groups, PAIR)

    def codes(self, x: np.ndarray) -> np.ndarray:
        """Codes of least anisotropic loss |r|^2 + (eta - 1) <r, x>^2 by coordinate descent over the groups."""
        plain = ((x[:, :, None, :] - self.centres) ** 2).sum(axis=3)  # (n, groups, 16)
        along = np.einsum("ngd,gkd->ngk", x, self.centres)
        own = (x * x).sum(axis=2)
        codes = plain.argmin(axis=2)
        rows = np.arange(len(x))
        parallel = 1 - np.take_along_axis(along, codes[:, :, None], 2)[:, :, 0].sum(axis=1)
        for _ in range(2):
            for g in range(self.groups):
                rest = parallel + along[rows, g, codes[:, g]] - own[:, g]  # parallel residual of the other groups
                loss = plain[:, g] + (self.eta - 1) * (rest[:, None] + own[:, g, None] - along[:, g]) ** 2
                new = loss.argmin(axis=1)
                parallel += along[rows, g, codes[:, g]] - along[rows, g, new]
                codes[:, g] = new
        return codes.astype(np.uint8)

    def update(self, x: np.ndarray, codes: np.ndarray) -> None:
        """Centres of least loss for given codes: each solves its own small weighted system, the other groups held."""
        rows = np.arange(len(x))
        chosen = np.stack([self.centres[g][codes[:, g]] for g in range(self.groups)], axis=1)
        parallel = 1 - (x * chosen).sum(axis=(1, 2))
        for g in range(self.groups):
            rest = parallel + (x[:, g] * chosen[:, g]).sum(axis=1)
            for k in range(16):
                m = rows[codes[:, g] == k]
                if len(m):
                    a = x[m, g]
                    left = len(m) * np.eye(PAIR) + (self.eta - 1) * a.T @ a
                    right = a.sum(axis=0) + (self.eta - 1) * (a * rest[m, None]).sum(axis=0)
                    self.centres[g, k] = np.linalg.solve(left, right)
            new = self.centres[g][codes[:, g]]
            parallel = rest - (x[:, g] * new).sum(axis=1)
            chosen[:, g] = new

    def packed(self, vectors: np.ndarray) -> np.ndarray:
        codes = self.codes(self.split(self.residuals(vectors)[1]))
        return codes[:, ::2] | (codes[:, 1::2] << 4)

    def scan(self, queries: np.ndarray, packed: np.ndarray) -> np.ndarray:
        """Inner products (queries, vectors) with coded directions, by tables for two codes at once."""
        table = np.einsum("qgd,gkd->qgk", self.split(queries), self.centres).astype(np.float32)
        both = table[:, 1::2, :, None] + table[:, ::2, None, :]  # high four bits, low four bits
        both = np.ascontiguousarray(both.reshape(len(queries), self.groups // 2, 256).transpose(1, 2, 0))
        out = np.zeros((len(packed), len(queries)), np.float32)
        for byte in range(self.groups // 2):
            out += both[byte][packed[:, byte]]
        return out.T

    def distances(self, queries: np.ndarray, vectors: np.ndarray, packed: np.ndarray) -> np.ndarray:
        """Approximate squared distances |q - c|^2 + |r|^2 - 2 <q - c, r> for vectors c + r."""
        own, _, size = self.residuals(vectors)
        codes = np.stack([packed & 15, packed >> 4], axis=2).reshape(len(packed), self.groups)
        decoded = self.centres[np.arange(self.groups), codes].reshape(len(packed), -1)[:, : self.dim]
        cross = (self.coarse[own] * decoded).sum(axis=1)
        far = (queries**2).sum(axis=1)[:, None] - 2 * queries @ self.coarse.T + (self.coarse**2).sum(axis=1)
        return far[:, own] + size**2 - 2 * size * (self.scan(queries, packed) - cross)


def usable(table: DataFrame) -> DataFrame:
    """vec_id and v (doubles) of the vectors that take part, all of the dimension that most have."""
    v = F.col("embedding").cast("array<double>")
    fine = table.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull()
        & (F.size("v") > 0)
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("v", lambda x: x != 0)
    )
    return fine


def trained(vectors: DataFrame, most: int = TRAIN_ROWS) -> tuple[int, Quantiser] | None:
    dims = vectors.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if dims is None:
        return None
    rows = vectors.where(F.size("v") == dims["n"]).orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(most).select("v").toArrow()
    return dims["n"], Quantiser(np.array(rows.column(0).to_pylist()))


def matter(ids: np.ndarray, vectors: np.ndarray, k: int) -> np.ndarray:
    """Which rows, sorted by id, can be among the k nearest others of any id: of equal vectors k rows of each of the
    k + 1 smallest ids, as a query leaves out the rows of one id."""
    _, group = np.unique(vectors, axis=0, return_inverse=True)
    order = np.lexsort((ids, group))
    g, i = group[order], ids[order]
    place = np.arange(len(i))
    new = np.concatenate([[True], (g[1:] != g[:-1]) | (i[1:] != i[:-1])])
    own = place - np.maximum.accumulate(np.where(new, place, 0))  # rows of the same vector and id before this one
    nth = np.cumsum(new)
    smaller = nth - nth[np.searchsorted(g, g)]  # ids of the same vector that are smaller
    return np.sort(order[(own < k) & (smaller <= k)])


def nearest(table: DataFrame, k: int = K, every: int = EVERY, rerank: int = RERANK) -> DataFrame:
    """For each query (vec_id divisible by `every`) its k nearest others: query_id, rank, vec_id, score (distance)."""
    spark = table.sparkSession
    bounded_batches(spark)
    vectors = staged(usable(table), "vectors")
    model = trained(vectors)
    schema = "query_id long, rank int, vec_id long, score double"
    if model is None:
        return spark.createDataFrame([], schema)
    dim, quantiser = model
    vectors = vectors.where(F.size("v") == dim)
    known = spark.sparkContext.broadcast(quantiser)  # groups * 16 * PAIR numbers

    def blocks(rows: DataFrame, size: int, with_codes: bool) -> DataFrame:
        """Rows packed into blocks of at most `size`, within the partitions they are read in."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, parts = np.empty(0, np.int64), np.empty((0, dim))

            def out(i: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
                order = np.argsort(i, kind="stable")
                i, x = i[order], x[order]
                if with_codes:
                    keep = matter(i, x, k)
                    i, x = i[keep], x[keep]
                codes = known.value.packed(x).tobytes() if with_codes else b""
                return pa.RecordBatch.from_pydict({"ids": [i.astype("<i8").tobytes()], "v": [x.astype("<f8").tobytes()], "codes": [codes]})

            for batch in batches:
                ids = np.concatenate([ids, batch.column(0).to_numpy(zero_copy_only=False)])
                parts = np.concatenate([parts, batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)])
                while len(ids) >= size:
                    yield out(ids[:size], parts[:size])
                    ids, parts = ids[size:], parts[size:]
            if len(ids):
                yield out(ids, parts)

        return rows.mapInArrow(run, "ids binary, v binary, codes binary")

    coded = staged(blocks(vectors, VECTORS, True), "codes")
    asked = vectors.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = staged(blocks(asked, QUERIES, False), "queries")

    def scan(batch: pa.RecordBatch, queries: list[tuple[np.ndarray, np.ndarray]]) -> dict:
        found: list[list] = [[], [], []]
        q = known.value
        for row in batch.to_pylist():
            ids = np.frombuffer(row["ids"], "<i8")
            v = np.frombuffer(row["v"], "<f8").reshape(len(ids), dim)
            packed = np.frombuffer(row["codes"], np.uint8).reshape(len(ids), -1)
            for query_ids, query in queries:
                near = q.distances(query, v, packed)
                best = np.argsort(near, axis=1, kind="stable")[:, :rerank]  # equal vectors by their ids, as they lie
                for i, c in enumerate(best):
                    c = c[ids[c] != query_ids[i]]
                    distance = np.sqrt(np.cumsum((v[c] - query[i]) ** 2, axis=1)[:, -1])  # summed from the first component on
                    order = np.lexsort((ids[c], distance))[:k]
                    found[0].append(np.full(len(order), query_ids[i]))
                    found[1].append(ids[c][order])
                    found[2].append(distance[order])
        return {n: np.concatenate(x) if x else [] for n, x in zip(("query_id", "vec_id", "score"), found)}

    # some queries after the others go to all vectors: what is broadcast at once has a fixed bound
    results: list[DataFrame] = []

    def ask(ids: np.ndarray, v: np.ndarray) -> None:
        sent = spark.sparkContext.broadcast([(ids[i : i + QUERIES], v[i : i + QUERIES]) for i in range(0, len(ids), QUERIES)])
        found = map_batches(coded.repartition(_spread(coded)), lambda batch: scan(batch, sent.value), "query_id long, vec_id long, score double")
        results.append(staged(_best(found, k), "nearest"))

    ids, v = np.empty(0, np.int64), np.empty((0, dim))
    for row in asked.toLocalIterator():
        ids = np.concatenate([ids, np.frombuffer(row["ids"], "<i8")])
        v = np.concatenate([v, np.frombuffer(row["v"], "<f8").reshape(-1, dim)])
        if v.nbytes >= SENT:
            ask(ids, v)
            ids, v = ids[:0], v[:0]
    if len(ids):
        ask(ids, v)
    return reduce(DataFrame.unionByName, results) if results else spark.createDataFrame([], schema)


def _spread(coded: DataFrame) -> int:
    return max(1, min(coded.count(), int(coded.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
