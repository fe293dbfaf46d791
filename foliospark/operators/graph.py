"""Citation-graph operators."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def project_graph(works: DataFrame, citations: DataFrame, least: float, n: int) -> DataFrame:
    """The n most relevant works with their in- and out-degree in the whole graph and among themselves; self edges aside."""
    e = citations.where("citing != cited")
    nodes = works.where(F.coalesce("relevance", F.lit(0.0)) >= least).orderBy(F.desc_nulls_last("relevance"), "work_id").limit(n)
    ids = nodes.select("work_id")
    inner = e.join(ids.withColumnRenamed("work_id", "citing"), "citing", "left_semi").join(ids.withColumnRenamed("work_id", "cited"), "cited", "left_semi")
    degree = lambda edges, end, name: edges.groupBy(F.col(end).alias("work_id")).agg(F.count("*").alias(name))
    out = nodes
    for edges, end, name in ((e, "cited", "in_degree"), (e, "citing", "out_degree"), (inner, "cited", "inner_in"), (inner, "citing", "inner_out")):
        out = out.join(degree(edges, end, name), "work_id", "left")
    return out.fillna(0, ["in_degree", "out_degree", "inner_in", "inner_out"])


def cited_by(citations: DataFrame, members: DataFrame) -> DataFrame:
    """Distinct citing members of each cited member; self citations aside."""
    e = citations.where("citing != cited").join(members.withColumnRenamed("work_id", "citing"), "citing", "left_semi").join(members.withColumnRenamed("work_id", "cited"), "cited", "left_semi")
    return e.groupBy("cited").agg(F.count_distinct("citing").alias("n_citing"))


def reachable(edges: DataFrame, start: DataFrame, most: int | None = None) -> DataFrame:
    """(node, hops) of all nodes that the start nodes reach; each round visits new nodes only and is checkpointed, and so are
    the edges, which are made once.

    Nodes farther than ``most`` hops, if it is given, are an error and not left out.
    """
    front = start.select("node", F.lit(0).alias("hops")).distinct().checkpoint()
    edges = edges.select("citing", "cited").where("citing != cited").checkpoint()
    fronts = [front]
    for hop in count(1):
        new = front.join(edges, front.node == edges.citing).select(F.col("cited").alias("node")).distinct()
        for seen in fronts:  # each front is kept as it was written; none is written again
            new = new.join(seen.select("node"), "node", "left_anti")
        front = new.withColumn("hops", F.lit(hop)).checkpoint()
        if front.isEmpty():
            break
        if most is not None and hop > most:
            raise ValueError(f"nodes lie farther than {most} hops")
        fronts.append(front)
    return reduce(DataFrame.union, fronts)


def peeled(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((node, depth) of the nodes that reach no cycle, (node, base) of the rest). nodes: node, base; edges: child, parent.

    A node's depth is its base, or one more than its deepest parent. Each round takes the nodes that wait for no parent,
    tells their children, and drops their edges, so a round touches only what is left.
    """
    nodes, edges, done = nodes.checkpoint(), edges.checkpoint(), []
    while True:
        front = nodes.join(edges.select(F.col("child").alias("node")).distinct(), "node", "left_anti").checkpoint()
        if front.isEmpty():
            break
        done.append(front)
        told = edges.join(front.select(F.col("node").alias("parent"), "base"), "parent").groupBy(F.col("child").alias("node")).agg((F.max("base") + 1).alias("told"))
        nodes = nodes.join(front.select("node"), "node", "left_anti").join(told, "node", "left").select("node", F.greatest("base", F.coalesce("told", F.lit(0))).alias("base")).checkpoint()
        edges = edges.join(front.select(F.col("node").alias("parent")), "parent", "left_anti").select("child", "parent").checkpoint()
    all_ = reduce(DataFrame.union, done) if done else nodes.limit(0)
    return all_.withColumnRenamed("base", "depth"), nodes


def depths(works: DataFrame, citations: DataFrame) -> DataFrame:
    """(work_id, depth, parent, back_edges): how many citations lie below a work on the longest path; 0 if it cites none here.

    works: work_id, year. On cycles, works go by year (absent last), then id: what a work cites among those after it is a
    back edge, counted and not followed. The primary parent is the deepest work it cites that is less deep; of equal ones
    the least id.
    """
    ids = lambda name: works.select(F.col("work_id").alias(name)).distinct()
    e = citations.select(F.col("citing").alias("child"), F.col("cited").alias("parent")).where("child != parent").distinct().join(ids("child"), "child", "left_semi").join(ids("parent"), "parent", "left_semi").select("child", "parent").checkpoint()
    free, stuck = peeled(works.select(F.col("work_id").alias("node"), F.lit(0).alias("base")), e)
    order = works.select(F.col("work_id").alias("node"), F.struct(F.col("year").isNull().alias("absent"), "year", F.col("work_id").alias("id")).alias("place")).join(stuck.select("node"), "node", "left_semi")
    inner = e.join(order.toDF("child", "of"), "child").join(order.toDF("parent", "at"), "parent")
    late, _ = peeled(stuck, inner.where("at < of").select("child", "parent"))
    back = inner.where("at > of").groupBy(F.col("child").alias("work_id")).agg(F.count("*").alias("back_edges"))
    depth = free.union(late).select(F.col("node").alias("work_id"), "depth").checkpoint()
    pairs = e.join(depth.toDF("child", "own"), "child").join(depth.toDF("parent", "depth"), "parent").where("depth < own")
    parent = pairs.groupBy(F.col("child").alias("work_id")).agg(F.max(F.struct("depth", (-F.col("parent")).alias("p"))).alias("x")).select("work_id", (-F.col("x.p")).alias("parent"))
    return depth.join(parent, "work_id", "left").join(back, "work_id", "left").fillna(0, ["back_edges"])
