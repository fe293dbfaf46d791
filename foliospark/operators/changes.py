"""Writes as rewrites: upsert, insert-if-absent, retiring, superseding, and what is stale."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upserted(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """All rows of ``new``, and those of ``old`` whose key it hasn't. Keys of ``new`` are distinct."""
    return old.join(new, key, "left_anti").unionByName(new)


def inserted(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """All rows of ``old``, and one row of ``new`` for each key it hasn't; of several the least by its other columns."""
    rest = [c for c in new.columns if c not in key]
    first = new.groupBy(*key).agg(F.min(F.struct(*rest)).alias("x")).select(*key, "x.*")
    return old.unionByName(first.join(old, key, "left_anti"))


def retired(rows: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    """The rows whose key isn't among those that go."""
    return rows.join(gone.select(*key), key, "left_anti")


def superseded(runs: DataFrame, key: list[str], order: str) -> DataFrame:
    """Adds ``is_current``: the newest run of its key. The newest comes from an aggregate, so a hot key isn't sorted."""
    newest = runs.groupBy(*key).agg(F.max(order).alias("newest"))
    return runs.join(newest, key).withColumn("is_current", F.col(order) == F.col("newest")).drop("newest")


def stamped(items: DataFrame, upstream: DataFrame, key: str, stamp: str, version: str) -> DataFrame:
    """Adds ``fingerprint`` of a version and the sorted distinct stamps of what an item builds on."""
    stamps = upstream.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(F.col(stamp).cast("string"))), ",").alias("stamps"))
    whole = F.concat_ws("|", F.lit(version), F.coalesce("stamps", F.lit("")))
    return items.join(stamps, key, "left").withColumn("fingerprint", F.sha2(whole, 256)).drop("stamps")


def stale(now: DataFrame, recorded: DataFrame, key: str, value: str) -> DataFrame:
    """(key, reason): missing, where nothing is recorded, or changed, where the values differ; equal absences are current."""
    old = recorded.select(key, F.col(value).alias("old"), F.lit(True).alias("known"))
    both = now.join(old, key, "left")
    reason = F.when(F.col("known").isNull(), "missing").when(~F.col(value).eqNullSafe(F.col("old")), "changed")
    return both.withColumn("reason", reason).where(F.col("reason").isNotNull()).select(key, "reason")


def in_scope(rows: DataFrame, projects: DataFrame, project: str = "project_id") -> DataFrame:
    """(project_id, n): rows of each of these projects, those of project 0 counted for every one, without joining them to all."""
    own = rows.where(F.col(project) != 0).groupBy(project).agg(F.count("*").alias("own"))
    shared = rows.where(F.col(project) == 0).count()
    return projects.select(project).distinct().where(F.col(project) != 0).join(own, project, "left").select(project, (F.coalesce("own", F.lit(0)) + shared).alias("n"))



def cascaded(tables: dict[str, DataFrame], gone: dict[str, DataFrame], owned: list[tuple[str, str, str, str]]) -> dict[str, DataFrame]:
    """The tables without the rows that go, and without all rows that belong to them, level by level.

    gone: ids by table, in the table's key; owned: (table, column, owner, owner's key): rows of the table go with the owner
    that their column names. The relations hold no circle and are given owners first.
    """
    left = {t: x.join(gone[t], gone[t].columns, "left_anti").select(*x.columns) if t in gone else x for t, x in tables.items()}
    for table, column, owner, key in owned:
        lost = tables[owner].select(F.col(key).alias(column)).join(left[owner].select(F.col(key).alias(column)), column, "left_anti")
        left[table] = left[table].join(lost, column, "left_anti").select(*tables[table].columns)
    return left
