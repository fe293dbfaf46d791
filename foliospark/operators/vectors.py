"""Exact cosine nearest neighbours of a stated set of query vectors, within a scope, and what a search has covered."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliospark.plans.session import checkpoint_dir

#: Query vectors of a file, and files held by a task, more are taken in several jobs; scores worked out at once.
QUERY_BLOCK, HELD, SCORES = 4096, 32, 1 << 20


def block_files(queries: DataFrame) -> list[str]:
    """Names of files of about QUERY_BLOCK query vectors each, written to the shared folder and fetched by each executor."""
    spark = queries.sparkSession
    n = queries.count()
    path = f"{checkpoint_dir(spark)}/queries-{uuid.uuid4().hex}"
    queries.repartition(max(1, math.ceil(n / QUERY_BLOCK))).write.parquet(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = [f.getPath().toString() for f in hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(hadoop)]
    files = sorted(f for f in files if f.endswith(".parquet"))
    for f in files:
        spark.sparkContext.addFile(f)
    return [f.rsplit("/", 1)[1] for f in files]


def nearest(vectors: DataFrame, queries: DataFrame, k: int, own: bool = False) -> DataFrame:
    """(query_id, vec_id, score, rn): the k nearest of all vectors to each query; itself only if ``own``; a zero vector scores 0.

    Vectors that are null or of another length than a query, or hold nulls, aren't met. Each task keeps its own k best of
    every query, so k rows a task and query are shuffled. Ties go to the smaller id.
    """
    files, out = block_files(queries.select("vec_id", "embedding")), None
    for start in range(0, len(files), HELD):
        some = files[start : start + HELD]

        def run(it: Iterator[pd.DataFrame], some=some) -> Iterator[pd.DataFrame]:
            asked: dict[int, list] = {}
            for f in some:
                for i, v in zip(*(c.to_pylist() for c in pq.read_table(SparkFiles.get(f)).columns)):
                    if v is not None and None not in v:
                        asked.setdefault(len(v), []).append((i, np.array(v, float)))
            sides = {d: (np.array([i for i, _ in x]), np.array([v for _, v in x], float).reshape(len(x), d)) for d, x in asked.items()}
            sides = {d: (i, q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)) for d, (i, q) in sides.items()}
            best = {d: (np.zeros((len(i), 0), np.int64), np.zeros((len(i), 0))) for d, (i, _) in sides.items()}
            for pdf in it:
                rows = [(i, v) for i, v in zip(pdf.vec_id, pdf.embedding) if v is not None and not any(x is None for x in v)]
                for d in {len(v) for _, v in rows} & sides.keys():
                    ids = np.array([i for i, v in rows if len(v) == d])
                    v = np.array([list(v) for _, v in rows if len(v) == d], float).reshape(len(ids), d)
                    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
                    asking, q = sides[d]
                    some_of = max(1, SCORES // len(ids))
                    for a in range(0, len(asking), some_of):
                        part = slice(a, a + some_of)
                        score = np.round(q[part] @ v.T, 6) + 0.0
                        if not own:
                            score[asking[part, None] == ids[None]] = -np.inf
                        all_ids = np.concatenate([best[d][0][part], np.broadcast_to(ids, score.shape)], axis=1)
                        score = np.concatenate([best[d][1][part], score], axis=1)
                        top = np.lexsort((all_ids, -score))[:, :k]
                        held = (np.take_along_axis(all_ids, top, 1), np.take_along_axis(score, top, 1))
                        if best[d][0].shape[1] != held[0].shape[1]:
                            best[d] = tuple(np.pad(x, ((0, 0), (0, held[0].shape[1] - x.shape[1])), constant_values=c) for x, c in zip(best[d], (0, -np.inf)))
                        best[d][0][part], best[d][1][part] = held
            for d, (ids, score) in best.items():
                yield pd.DataFrame({"query_id": np.repeat(sides[d][0], ids.shape[1]), "vec_id": ids.ravel(), "score": score.ravel()})

        found = vectors.select("vec_id", "embedding").mapInPandas(run, "query_id long, vec_id long, score double").where("score > -2")
        out = found if out is None else out.union(found)
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)


def in_scope(chunks: DataFrame, members: DataFrame | None = None, work: Column | None = None) -> DataFrame:
    """Chunks of a project's works (members: work_id), of one work, or of all."""
    kept = chunks if members is None else chunks.join(members.select("work_id").distinct(), "work_id", "left_semi")
    return kept if work is None else kept.where(F.col("work_id") == work)


def semantic_search(chunks: DataFrame, queries: DataFrame, works: DataFrame, space: str, k: int = 30, members: DataFrame | None = None) -> DataFrame:
    """(query_id, rn, chunk_id, work_id, title, year, score): the k chunks of the scope nearest to each query, with their works.

    chunks: chunk_id, work_id, space, embedding. Vectors of another space than the active one are stale and not compared.
    """
    own = in_scope(chunks.where(F.col("space") == space), members).select(F.col("chunk_id").alias("vec_id"), "work_id", "embedding")
    hits = nearest(own, queries, k, own=True)
    named = hits.join(own.select("vec_id", "work_id"), "vec_id").join(works.select("work_id", "title", "year"), "work_id", "left")
    return named.select("query_id", "rn", F.col("vec_id").alias("chunk_id"), "work_id", "title", "year", "score")


def coverage(chunks: DataFrame, works: DataFrame, with_text: DataFrame, space: str, by: str) -> DataFrame:
    """(by, works_total, works_with_text, works_embedded, works_stale_only, chunks, stale_chunks) of each scope.

    works: work_id and the column ``by``; with_text: work_id. Stale chunks are of another space than the active one.
    """
    own = chunks.groupBy("work_id").agg(F.count_if(F.col("space") == space).alias("fresh"), F.count_if(F.col("space") != space).alias("old"))
    x = works.select("work_id", by).join(with_text.select("work_id").distinct().withColumn("t", F.lit(True)), "work_id", "left").join(own, "work_id", "left").fillna(0, ["fresh", "old"])
    return x.groupBy(by).agg(F.count("*").alias("works_total"), F.count_if("t").alias("works_with_text"), F.count_if(F.col("fresh") > 0).alias("works_embedded"), F.count_if((F.col("fresh") == 0) & (F.col("old") > 0)).alias("works_stale_only"), F.sum("fresh").alias("chunks"), F.sum("old").alias("stale_chunks"))
