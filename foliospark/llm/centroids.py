"""Centroid clustering by sort-means: Lloyd's rounds on integer vectors, with centroids scanned in the order of their distance.

Kept are vectors of exactly DIM components, none null or non-finite, with ``floor(1024 * x)`` of 62 bits at most; a row
whose components are larger takes no part, as no distance to it fits a long. Components are integers, so every sum and
distance is exact. A distance that doesn't fit a long is null. Rows with equal or null ids are rows of their own; a null id
comes last among the first centroids. No kept vector, or an empty table: no rows. Extra columns don't matter.
Spark holds the vectors in blocks, one row each, of a few thousand: packed components, the cluster of each and the sums of
each cluster. A round is one narrow pass that writes the blocks to the shared folder, and an aggregate of the sums column
alone; the driver sees the centroids only. The blocks of the round before the last are deleted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, dropped, shared_dir, table

DIM, CLUSTERS, ROUNDS, SCALE, SALT = 64, 8, 10, 1024, "3"
#: Components from here on leave a vector out.
TOO_LARGE = 2.0**62
#: Up to these component sizes distances are exact in doubles, or in 64-bit integers.
DOUBLES, LONGS = 2**22, 2**26

BLOCK = "ids binary, known binary, comps binary, width int, cluster binary, sums array<struct<c:int,n:long,s:array<decimal(38,0)>,d:decimal(38,0)>>"


def valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the kept vectors, v as doubles."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < TOO_LARGE / SCALE))
    return vectors.where((F.size("embedding") == DIM) & fine).select("vec_id", v.alias("v"))


def first_centroids(vectors: DataFrame, clusters: int) -> list[list[int]]:
    """The vectors with the smallest hashes; equal hashes, that is equal ids, in order of their components."""
    key = F.sha2(F.concat(F.lit(f"{SALT}:"), F.col("vec_id").cast("string")), 256)
    whole = F.transform("v", lambda x: F.floor(x * SCALE))
    rows = vectors.select(key.alias("key"), whole.alias("v")).orderBy(F.asc_nulls_last("key"), "v").limit(clusters).collect()
    return [[int(x) for x in r.v] for r in rows]


def exact(values: np.ndarray) -> np.ndarray:
    """The same integers in the fastest type that keeps squared distances exact."""
    top = max((abs(int(values.max())), abs(int(values.min())))) if values.size else 0
    return values.astype(np.float64 if top < DOUBLES else np.int64 if top < LONGS else object)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    off = x - c
    return np.einsum("ij,ij->i", off, off) if off.dtype != object else (off * off).sum(axis=1)


def assign(x: np.ndarray, before: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row and its squared distance; of equally near ones the smallest number.

    From a row's cluster before, the other centroids are tried by their distance D from that one. One that is nearer to
    the row, or as near, has D at most twice the row's distance d from its cluster before; so a row is done once D > 2d.
    """
    cluster, best = before.copy(), np.zeros(len(x), x.dtype)
    for p in np.unique(before):
        rows = np.flatnonzero(before == p)
        start = squared(x[rows], centroids[p])
        best[rows] = start
        between = squared(centroids, centroids[p])
        for c in sorted((c for c in range(len(centroids)) if c != p), key=lambda c: (between[c], c)):
            on = between[c] <= 4 * start
            if not on.any():
                break
            rows, start = rows[on], start[on]
            far = squared(x[rows], centroids[c])
            nearer = (far < best[rows]) | (far == best[rows]) & (c < cluster[rows])
            best[rows[nearer]], cluster[rows[nearer]] = far[nearer], c
    return cluster, best


def packed(values: np.ndarray) -> tuple[bytes, int]:
    """Integers in the narrowest of 2, 4 and 8 bytes."""
    top = max(abs(int(values.max())), abs(int(values.min())))
    width = 2 if top < 2**15 else 4 if top < 2**31 else 8
    return values.astype(f"<i{width}").tobytes(), width


def block(ids: bytes, known: bytes, comps: bytes, width: int, before: bytes, centroids: list[list[int]]) -> tuple[dict, np.ndarray]:
    values = np.frombuffer(comps, f"<i{width}").reshape(-1, len(centroids[0])).astype(np.int64)
    both = exact(np.concatenate([values, np.array(centroids, np.int64)]))
    cluster, best = assign(both[: len(values)], np.frombuffer(before, np.int32), both[len(values) :])
    sums = []
    for c in np.unique(cluster):
        own = cluster == c
        sums.append({"c": int(c), "n": int(own.sum()), "s": [sum(map(int, s)) if both.dtype == object else int(s) for s in (values[own].T if both.dtype == object else values[own].sum(axis=0))], "d": sum(map(int, best[own]))})
    return {"ids": ids, "known": known, "comps": comps, "width": width, "cluster": cluster.astype(np.int32).tobytes(), "sums": sums}, best


SUMS = pa.list_(pa.struct([("c", pa.int32()), ("n", pa.int64()), ("s", pa.list_(pa.decimal128(38, 0))), ("d", pa.decimal128(38, 0))]))
SCHEMA = pa.schema([("ids", pa.binary()), ("known", pa.binary()), ("comps", pa.binary()), ("width", pa.int32()), ("cluster", pa.binary()), ("sums", SUMS)])


def in_blocks(vectors: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """A block for each Arrow batch of vectors, assigned by a scan that starts at centroid 0."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            ids, v = b.column(0), np.array(b.column(1).flatten()).reshape(b.num_rows, -1)
            comps, width = packed(np.floor(v * SCALE).astype(np.int64))
            known = np.array(ids.is_valid()).astype(np.uint8).tobytes()
            row, _ = block(np.array(ids.fill_null(0)).astype("<i8").tobytes(), known, comps, width, np.zeros(b.num_rows, np.int32).tobytes(), centroids)
            yield pa.RecordBatch.from_pylist([row], schema=SCHEMA)

    return vectors.select(F.col("vec_id").cast("long"), "v").mapInArrow(run, BLOCK)


def reassigned(blocks: DataFrame, centroids: list[list[int]]) -> DataFrame:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            for r in b.select(["ids", "known", "comps", "width", "cluster"]).to_pylist():
                yield pa.RecordBatch.from_pylist([block(r["ids"], r["known"], r["comps"], r["width"], r["cluster"], centroids)[0]], schema=SCHEMA)

    return blocks.select("ids", "known", "comps", "width", "cluster").mapInArrow(run, BLOCK)


def totals(blocks: DataFrame, dim: int) -> list:
    """(c, n, d, s0, s1, ...) of each cluster; only the sums column is read."""
    each = blocks.select(F.explode("sums").alias("x")).select("x.*")
    whole = lambda x: F.sum(x).cast("decimal(38,0)")
    return each.groupBy("c").agg(F.sum("n").alias("n"), whole(F.col("d")).alias("d"), *(whole(F.col("s")[i]).alias(f"s{i}") for i in range(dim))).collect()


def clustered(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """((vec_id, cluster, distance) of each kept vector, (cluster, n, cluster_inertia, inertia, centroid) of each cluster)."""
    spark = vectors.sparkSession
    kept = valid(vectors)
    centroids = first_centroids(kept, clusters)
    if not centroids:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), spark.createDataFrame([], "cluster int, n long, cluster_inertia decimal(38,0), inertia decimal(38,0), centroid array<long>")
    blocks, path = in_blocks(kept, centroids), None
    for done in range(rounds + 1):
        new = shared_dir(spark, "sort-means")
        blocks.write.option("compression", "zstd").parquet(new)
        if path:
            dropped(spark, path)
        path, blocks = new, spark.read.schema(BLOCK).parquet(new)
        sums = totals(blocks, DIM)
        if done == rounds:
            break
        for r in sums:
            centroids[r.c] = [int(r[f"s{i}"]) // r.n for i in range(DIM)]
        blocks = reassigned(blocks, centroids)
    whole = sum(r.d for r in sums)
    rows = [(r.c, r.n, r.d, whole, centroids[r.c]) for r in sums]
    about = spark.createDataFrame(rows, "cluster int, n long, cluster_inertia decimal(38,0), inertia decimal(38,0), centroid array<long>")
    last = [list(c) for c in centroids]

    def rows_of(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            for r in b.to_pylist():
                values = np.frombuffer(r["comps"], f"<i{r['width']}").reshape(-1, DIM).astype(np.int64)
                cluster = np.frombuffer(r["cluster"], np.int32)
                both = exact(np.concatenate([values, np.array(last, np.int64)]))
                best = squared(both[: len(values)], both[len(values) :][cluster])
                fits = np.array([x < 2**63 for x in best.tolist()])
                distance = pa.array([int(x) if ok else None for x, ok in zip(best.tolist(), fits)], pa.int64())
                ids = pa.array(np.frombuffer(r["ids"], "<i8"), mask=np.frombuffer(r["known"], np.uint8) == 0)
                yield pa.RecordBatch.from_arrays([ids, pa.array(cluster), distance], names=["vec_id", "cluster", "distance"])

    return blocks.select("ids", "known", "comps", "width", "cluster").mapInArrow(rows_of, "vec_id long, cluster int, distance long"), about


def op11_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, about = clustered(table(spark, sf_dir, "embeddings"))
    long = lambda c: F.when(F.col(c) <= 2**63 - 1, F.col(c)).cast("long").alias(c)
    digest = F.sha2(F.array_join(F.transform("centroid", lambda x: x.cast("string")), ","), 256).alias("centroid_sha256")
    return rows.join(F.broadcast(about.select("cluster", long("cluster_inertia"), long("inertia"), digest)), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle() -> str:
    """The same in DuckDB's SQL: vectors as rows of components, a pair of tables for each round."""
    parts = [
        f"e AS MATERIALIZED (SELECT vec_id, [CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIM})",
        f"v AS MATERIALIZED (SELECT vec_id, unnest(range(1, {DIM + 1})) AS i, unnest(v) AS x FROM e)",
        f"f AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('{SALT}:' || vec_id)) - 1 AS k FROM e QUALIFY k < {CLUSTERS})",
        "c0 AS MATERIALIZED (SELECT k, i, x FROM f JOIN v USING (vec_id))",
    ]
    for n in range(ROUNDS + 1):
        parts.append(f"a{n} AS MATERIALIZED (SELECT vec_id, min(struct_pack(d := d, k := k)) AS b FROM (SELECT vec_id, k, sum((v.x - c{n}.x) * (v.x - c{n}.x)) AS d FROM v JOIN c{n} USING (i) GROUP BY 1, 2) GROUP BY 1)")
        if n < ROUNDS:
            parts.append(f"m{n} AS (SELECT a{n}.b.k AS k, i, sum(x) AS s, count(*) AS n FROM a{n} JOIN v USING (vec_id) GROUP BY 1, 2)")
            parts.append(f"c{n + 1} AS MATERIALIZED (SELECT c{n}.k, c{n}.i, CAST(CASE WHEN n IS NULL THEN c{n}.x ELSE (s - ((s % n) + n) % n) // n END AS BIGINT) AS x FROM c{n} LEFT JOIN m{n} ON m{n}.k = c{n}.k AND m{n}.i = c{n}.i)")
    last = f"SELECT vec_id, CAST(b.k AS INTEGER) AS cluster, CAST(b.d AS BIGINT) AS distance, CAST(sum(b.d) OVER (PARTITION BY b.k) AS BIGINT) AS cluster_inertia, CAST(sum(b.d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256 FROM a{ROUNDS} JOIN (SELECT k AS hk, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS h FROM c{ROUNDS} GROUP BY 1) ON hk = b.k"
    return "WITH " + ", ".join(parts) + " " + last


ORACLE = oracle()
