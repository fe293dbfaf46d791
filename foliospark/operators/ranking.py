"""Ranks, bands and other window operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def normalised_rank(df: DataFrame, group: str, value: str, out: str = "rank") -> DataFrame:
    """1 for the largest value of a group down to 0; ties share the better rank, absent values have none, one row has 1.

    Ranks come from counts by value, so the rows of a group are never gathered, only its distinct values.
    """
    by = df.where(F.col(value).isNotNull()).groupBy(F.col(group).alias("g__"), F.col(value).alias("v__")).agg(F.count("*").alias("n__"))
    w = W.partitionBy("g__")
    above = F.sum("n__").over(w.orderBy(F.desc("v__")).rowsBetween(W.unboundedPreceding, 0)) - F.col("n__")
    ranks = by.select("g__", "v__", (1 - F.coalesce(above / F.nullif(F.sum("n__").over(w) - 1, F.lit(0)), F.lit(0.0))).alias(out))
    return df.join(ranks, F.col(group).eqNullSafe(F.col("g__")) & (F.col(value) == F.col("v__")), "left").drop("g__", "v__")


def bands(df: DataFrame, group: str, value: str) -> DataFrame:
    """high, medium or low by the values at a fifth and half of a group's descending order; equal values share a band.

    The cut-offs come from counts by value, so no group is gathered in one place.
    """
    by = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n"))
    w = W.partitionBy(group).orderBy(F.desc(value))
    total = F.sum("n").over(W.partitionBy(group))
    upto = by.select(group, value, F.sum("n").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("upto"), total.alias("total"))
    cut = lambda share: F.max(F.when(F.col("upto") > F.floor(F.col("total") * share), F.col(value)))
    cuts = upto.groupBy(group).agg(cut(F.lit(0.2)).alias("high_from"), cut(F.lit(0.5)).alias("medium_from"))
    band = F.when(F.col(value) >= F.col("high_from"), "high").when(F.col(value) >= F.col("medium_from"), "medium").when(F.col(value).isNotNull(), "low")
    return df.join(cuts, group, "left").withColumn("band", band)


def top_per_group(df: DataFrame, group: str, order: list, k: int) -> DataFrame:
    return df.withColumn("rn", F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col("rn") <= k)


def budgeted(df: DataFrame, group: str, order: str, size: str, budget: int) -> DataFrame:
    """Leading rows of each group whose sizes sum to at most ``budget``; the first always."""
    w = W.partitionBy(group).orderBy(order)
    out = df.withColumns({"upto": F.sum(size).over(w.rowsBetween(W.unboundedPreceding, 0)), "rn": F.row_number().over(w)})
    return out.where((F.col("upto") <= budget) | (F.col("rn") == 1))


def merged_spans(df: DataFrame, group: str, start: str, end: str) -> DataFrame:
    """Unions of overlapping or touching spans of each group."""
    w = W.partitionBy(group).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1))
    islands = df.withColumn("island", F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0))
    islands = islands.withColumn("island", F.sum("island").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return islands.groupBy(group, "island").agg(F.min(start).alias("span_start"), F.max(end).alias("span_end"), F.count("*").alias("n")).drop("island")


def newest_per_group(df: DataFrame, group: str, order: list, key: list[str], keep: int) -> DataFrame:
    """History: of equal keys only the newest row, of these the newest ``keep`` of each group."""
    last = df.withColumn("rn", F.row_number().over(W.partitionBy(group, *key).orderBy(*order))).where("rn = 1").drop("rn")
    return top_per_group(last, group, order, keep)


def numbered(df: DataFrame, group: list[str], order: list, out: str) -> DataFrame:
    """Numbers the rows of each group from 1 in this order, however large a group is: rows are sorted over all partitions
    by range, numbered in each, and moved up by the counts of the partitions before. The sorted rows are checkpointed."""
    names = [c for c in df.columns]
    keys = [F.col(c) if isinstance(c, str) else c for c in [*group, *order]]
    rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows = rows.select("*", F.spark_partition_id().alias("part__"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("row__")).checkpoint()
    parts = rows.groupBy(*group, "part__").agg(F.count("*").alias("n__"), F.min("row__").alias("first__"))
    before = F.coalesce(F.sum("n__").over(W.partitionBy(*group).orderBy("part__").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select(*[F.col(c).alias(f"{c}__g") for c in group], F.col("part__").alias("p__"), (before - F.col("first__") + 1).alias("up__"))
    same = (F.col("part__") == F.col("p__"))
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}__g"))
    return rows.join(starts, same).withColumn(out, F.col("row__") + F.col("up__")).select(*names, out)
