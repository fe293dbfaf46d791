"""Approximate nearest neighbours: stable projections to a few dimensions, kd-trees over them, and a chi-square stopping test.

A Gaussian projection to m dimensions turns a distance r into one whose square, divided by r * r, is chi-square with m
degrees of freedom. So once the next place of the tree lies so far from a query in the projection that the quantile CONFIDENT
of that law, times the square of its k-th best distance, is exceeded, each true neighbour has been met with at least that
probability, and the query stops. Cosine is searched as the distance of unit vectors; scores come from the original vectors.

Take no part: null vectors, empty ones, those of zeros, with null or non-finite components, and rows without an id. Vectors
are compared with those of as many components only. Equal rows count once; of rows with one id but other vectors, each
candidate counts by its best score. Ties go to the smaller id. Empty tables give no rows; extra columns don't matter.

Spark deals rows by the leaf of a tree fitted on SAMPLE rows at most, chosen by hash; a leaf of more than BLOCK rows is
dealt over as many blocks as it needs, so a vector that a third of all rows share is no hot key. Each block keeps
its own tree over all its rows; of equal vectors it needs only the k + 1 smallest ids, as no other can be in an answer. A
query first searches its own block, which bounds its distance, and then all others. Queries reach the blocks as files of about
QUERIES rows that executors fetch from the shared folder, FILES of them in a job; none goes through the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import batches, materialised, shared_dir, shipped, small_batches, table

K, EVERY = 5, 50
PROJECTED, CONFIDENT, SEED = 8, 0.99, 13
BLOCK, BUCKET, LEAVES, SAMPLE = 8192, 64, 4096, 50_000
QUERIES, FILES = 4096, 64


def chi_square(x: float, m: int) -> float:
    """Distribution function of the chi-square law with an even number m of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(m // 2))


def stopping_ratio(m: int, confident: float) -> float:
    """The quantile: least ratio of squared projected distance to squared distance at which the test holds."""
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, m) < confident else (low, mid)
    return high


def projection(dim: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).standard_normal((dim, PROJECTED))


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of length 1, also of very large or small components."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each pair of rows; powers of two are taken out first, which changes no digit but keeps squares finite."""
    a, b = (np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1]) for x in (a, b))
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def valid(vectors: DataFrame, queries: Column) -> DataFrame:
    """(vec_id, dim, v, asks) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"), fine.alias("fine"))
    return rows.where("vec_id is not null and fine").select("vec_id", F.size("v").alias("dim"), "v", "asks")


class Splits:
    """The upper tree of one number of components: at each node a projected dimension and the value that parts it."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.depth = max(0, math.ceil(math.log2(max(1, leaves))))
        self.axis, self.value = np.zeros(1 << self.depth, np.int64), np.zeros(1 << self.depth)
        self._fit(1, sample, 0)

    def _fit(self, node: int, rows: np.ndarray, depth: int) -> None:
        if depth == self.depth:
            return
        if len(rows):
            axis = int(np.argmax(np.ptp(rows, axis=0)))
            self.axis[node], self.value[node] = axis, np.median(rows[:, axis])
        below = rows[:, self.axis[node]] < self.value[node]
        self._fit(2 * node, rows[below], depth + 1)
        self._fit(2 * node + 1, rows[~below], depth + 1)

    def leaf(self, rows: np.ndarray) -> np.ndarray:
        node = np.ones(len(rows), np.int64)
        for _ in range(self.depth):
            node = 2 * node + (rows[np.arange(len(rows)), self.axis[node]] >= self.value[node])
        return node


def fitted(rows: DataFrame, block: int) -> dict[int, Splits]:
    """An upper tree for each number of components, of about a leaf for each ``block`` rows, LEAVES at most."""
    counts = {r.dim: r.n for r in rows.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n")).limit(LEAVES).collect()}
    total = sum(counts.values())
    by = F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 40))
    share = min(1.0, 2 * SAMPLE / max(1, total))
    drawn = rows.where(by < int(share * (1 << 40))).orderBy(by, "vec_id").limit(SAMPLE).select("dim", "v").collect()
    of: dict[int, list] = {}
    for r in drawn:
        of.setdefault(r.dim, []).append(r.v)
    return {d: Splits(unit(np.array(v)) @ projection(d), min(LEAVES, math.ceil(counts.get(d, 1) / block))) for d, v in of.items()}


def with_leaves(rows: DataFrame, trees: dict[int, Splits]) -> DataFrame:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            dims = b.column(1).to_numpy()
            leaf = np.ones(b.num_rows, np.int64)
            for d in np.unique(dims):
                if int(d) in trees:
                    on = np.flatnonzero(dims == d)
                    v = np.array(b.column(2).take(pa.array(on)).flatten()).reshape(len(on), d)
                    leaf[on] = trees[int(d)].leaf(unit(v) @ projection(int(d)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf)], names=["vec_id", "dim", "v", "asks", "leaf"])

    return rows.mapInArrow(run, "vec_id long, dim int, v array<double>, asks boolean, leaf long")


class Block:
    """Rows of one block in the order of their tree's buckets, and each bucket's box in the projection."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, cuts: np.ndarray):
        self.ids, self.v, self.cuts = ids, v, cuts
        self.unit = unit(v)
        self.at = self.unit @ projection(v.shape[1])
        self.low, self.high = np.minimum.reduceat(self.at, cuts[:-1]), np.maximum.reduceat(self.at, cuts[:-1])

    @staticmethod
    def ordered(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(order of the rows, first row of each bucket and the number of rows): halves by the widest dimension."""
        at, parts = unit(v) @ projection(v.shape[1]), [np.arange(len(v))]
        while max(map(len, parts)) > BUCKET:
            halves = []
            for p in parts:
                if len(p) <= BUCKET:
                    halves.append(p)
                    continue
                axis = int(np.argmax(np.ptp(at[p], axis=0)))
                p = p[np.argsort(at[p, axis], kind="stable")]
                halves += [p[: len(p) // 2], p[len(p) // 2 :]]
            parts = halves
        return np.concatenate(parts), np.cumsum([0, *map(len, parts)])

    def search(self, ids: np.ndarray, v: np.ndarray, far: np.ndarray, k: int, ratio: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of the query, id, score) of the k best that each query finds here, within the squared distance ``far``.

        Buckets are visited by their distance from the query in the projection, one, then twice as many each time; before
        each visit, the query's stopping test is taken with the k-th best distance so far.
        """
        own, at = unit(v), unit(v) @ projection(v.shape[1])
        gap = np.zeros((len(v), len(self.low)))
        for j in range(PROJECTED):
            off = np.maximum(0, np.maximum(self.low[None, :, j] - at[:, j, None], at[:, j, None] - self.high[None, :, j]))
            gap += off * off
        rank = np.argsort(np.argsort(gap, axis=1, kind="stable"), axis=1)
        far, begin, step = far.copy(), 0, 1
        q_, i_, s_ = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        while begin < len(self.low):
            now = (rank >= begin) & (rank < begin + step) & (gap <= ratio * far[:, None] + 1e-9)
            found = []
            for b in np.flatnonzero(now.any(axis=0)):
                q = np.flatnonzero(now[:, b])
                part = slice(self.cuts[b], self.cuts[b + 1])
                near = own[q] @ self.unit[part].T
                good = (2 - 2 * near <= far[q][:, None] + 1e-9) & (self.ids[part][None] != ids[q][:, None])
                x, y = np.nonzero(good)
                found.append((q[x], y + self.cuts[b]))
            begin, step = begin + step, 2 * step
            if not found:
                if not (gap <= ratio * far[:, None] + 1e-9)[rank >= begin].any():
                    break
                continue
            q, i = (np.concatenate(x) for x in zip(*found))
            q_, i_, s_ = np.concatenate([q_, q]), np.concatenate([i_, i]), np.concatenate([s_, cosine(v[q], self.v[i])])
            order = np.lexsort((self.ids[i_], -s_, q_))
            q_, i_, s_ = q_[order], i_[order], s_[order]
            first = np.searchsorted(q_, q_)
            place = np.arange(len(q_)) - first
            q_, i_, s_ = q_[place < k], i_[place < k], s_[place < k]
            last = np.arange(len(q_)) - np.searchsorted(q_, q_) == k - 1
            far[q_[last]] = np.minimum(far[q_[last]], np.maximum(0, 2 - 2 * s_[last]))
        return q_, self.ids[i_], s_


INDEX = "dim int, ids binary, v binary, cuts binary, q_ids binary, q_v binary, q_far binary"


def index(rows: DataFrame, k: int, ratio: float) -> DataFrame:
    """A row for each block: its rows in the tree's order, and its queries with the bounds that the block gives them."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id", kind="stable")
        v, ids, asks = np.array(pdf.v.tolist(), np.float64), pdf.vec_id.to_numpy(np.int64), pdf.asks.to_numpy(bool)
        key = np.ascontiguousarray(v + 0.0).view(np.dtype((np.void, v.shape[1] * 8))).ravel()
        frame = pd.DataFrame({"key": np.unique(key, return_inverse=True)[1], "id": ids})
        new = ~frame.duplicated().to_numpy()
        place = frame[new].groupby("key").cumcount().to_numpy()
        keep = np.flatnonzero(new)[place <= k]
        order, cuts = Block.ordered(v[keep])
        keep = keep[order]
        own, asking = Block(ids[keep], v[keep], cuts), np.flatnonzero(asks & new)
        far = np.full(len(asking), 4.0)
        for a in range(0, len(asking), 1024):
            part = asking[a : a + 1024]
            q, _, s = own.search(ids[part], v[part], far[a : a + 1024], k, ratio)
            last = np.arange(len(q)) - np.searchsorted(q, q) == k - 1
            far[a + q[last]] = np.maximum(0, 2 - 2 * s[last])
        row = {"dim": v.shape[1], "ids": own.ids.tobytes(), "v": own.v.tobytes(), "cuts": cuts.astype(np.int64).tobytes(), "q_ids": ids[asking].tobytes(), "q_v": v[asking].tobytes(), "q_far": far.tobytes()}
        return pd.DataFrame([row])

    return rows.groupBy("dim", "leaf", "salt").applyInPandas(run, INDEX)


def query_files(blocks: DataFrame) -> list[str]:
    """Names of the files of queries, of about QUERIES rows each, fetched by every executor."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            for r in b.to_pylist():
                n = len(r["q_ids"]) // 8
                for k in range(0, n, QUERIES):
                    row = {"dim": r["dim"], "q_ids": r["q_ids"][8 * k : 8 * (k + QUERIES)], "q_v": r["q_v"][8 * k * r["dim"] : 8 * (k + QUERIES) * r["dim"]], "q_far": r["q_far"][8 * k : 8 * (k + QUERIES)]}
                    row["size"] = len(row["q_ids"]) // 8
                    yield pa.RecordBatch.from_pylist([row], schema=schema)

    schema = pa.schema([("dim", pa.int32()), ("q_ids", pa.binary()), ("q_v", pa.binary()), ("q_far", pa.binary()), ("size", pa.int64())])
    parts = materialised(blocks.select("dim", "q_ids", "q_v", "q_far").mapInArrow(run, "dim int, q_ids binary, q_v binary, q_far binary, size long"), "queries")
    total = parts.agg(F.sum("size")).first()[0] or 0
    if not total:
        return []
    path = shared_dir(parts.sparkSession, "query-files")
    parts.drop("size").repartition(math.ceil(total / QUERIES)).write.parquet(path)
    return shipped(parts.sparkSession, path)


def searched(blocks: DataFrame, files: list[str], k: int, ratio: float) -> DataFrame:
    """(query_id, vec_id, score): each task's k best of every query of these files."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = []
        for f in files:
            for r in pq.read_table(SparkFiles.get(f)).to_pylist():
                asked.append([r["dim"], np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["q_v"], np.float64).reshape(-1, r["dim"]), np.frombuffer(r["q_far"], np.float64).copy()])
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)) for _ in asked]
        for b in batches(it):
            for r in b.to_pylist():
                own = Block(np.frombuffer(r["ids"], np.int64), np.frombuffer(r["v"], np.float64).reshape(-1, r["dim"]), np.frombuffer(r["cuts"], np.int64))
                for n, (dim, ids, v, far) in enumerate(asked):
                    if dim != r["dim"]:
                        continue
                    for a in range(0, len(ids), 1024):
                        q, i, s = own.search(ids[a : a + 1024], v[a : a + 1024], far[a : a + 1024], k, ratio)
                        best[n] = tuple(np.concatenate(x) for x in zip(best[n], (q + a, i, s)))
                    q, i, s = best[n]
                    order = np.lexsort((i, -s, q))
                    q, i, s = q[order], i[order], s[order]
                    new = np.concatenate([[True], (q[1:] != q[:-1]) | (i[1:] != i[:-1])]) if len(q) else np.zeros(0, bool)
                    q, i, s = q[new], i[new], s[new]
                    place = np.arange(len(q)) - np.searchsorted(q, q)
                    q, i, s = best[n] = q[place < k], i[place < k], s[place < k]
                    last = np.arange(len(q)) - np.searchsorted(q, q) == k - 1
                    far[q[last]] = np.minimum(far[q[last]], np.maximum(0, 2 - 2 * s[last]))
        for (_, ids, _, _), (q, i, s) in zip(asked, best):
            yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(i), pa.array(s)], names=["query_id", "vec_id", "score"])

    return blocks.select("dim", "ids", "v", "cuts").mapInArrow(run, "query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, queries: Column, k: int = K, confident: float = CONFIDENT, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest that the search finds of each row that ``queries`` picks."""
    spark, ratio = vectors.sparkSession, stopping_ratio(PROJECTED, confident)
    small_batches(spark)
    rows = valid(vectors, queries)
    placed = materialised(with_leaves(rows, fitted(rows, block)), "leaves")
    sizes = placed.groupBy("dim", "leaf").agg(F.ceil(F.count("*") / block).alias("blocks"))
    salt = F.pmod(F.monotonically_increasing_id(), F.col("blocks"))  # of a written table; repeated rows part as well
    dealt = placed.join(F.broadcast(sizes.where("blocks > 1")), ["dim", "leaf"], "left").withColumn("salt", F.coalesce(salt, F.lit(0)))  # LEAVES rows for each dim
    blocks = materialised(index(dealt.drop("blocks"), k, ratio), "blocks")
    files = query_files(blocks)
    if not files:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = reduce(DataFrame.union, (searched(blocks, files[n : n + FILES], k, ratio) for n in range(0, len(files), FILES)))
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)
