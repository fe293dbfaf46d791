"""A project's rows across related tables, and their way into another store, where they get other ids."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.operators.ranking import numbered


@dataclass(frozen=True)
class Relation:
    """Rows of ``table`` name rows of ``target`` by ``column``. Owned rows go with the one they name; else only the named
    row goes with the one that names it."""

    table: str
    column: str
    target: str
    owned: bool = False


def closure(tables: dict[str, DataFrame], keys: dict[str, str], relations: list[Relation], start: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The rows that belong to the rows of ``start`` (ids by table, in a column of the key's name): owned ones downwards first,
    then whatever the rows name, until nothing is added. Each pass goes through the relations once and keeps ids alone."""
    ids = {t: (start[t].select(keys[t]).distinct() if t in start else tables[t].select(keys[t]).limit(0)).checkpoint() for t in tables}
    for down in (True, False):
        while True:
            sizes = {t: x.count() for t, x in ids.items()}
            for r in relations:
                if down and r.owned:
                    new = tables[r.table].join(ids[r.target].select(F.col(keys[r.target]).alias(r.column)), r.column, "left_semi").select(keys[r.table])
                    ids[r.table] = ids[r.table].union(new).distinct().checkpoint()
                elif not down:
                    named = tables[r.table].join(ids[r.table], keys[r.table], "left_semi").select(F.col(r.column).alias(keys[r.target])).where(f"`{keys[r.target]}` is not null")
                    new = tables[r.target].select(keys[r.target]).join(named, keys[r.target], "left_semi")
                    ids[r.target] = ids[r.target].union(new).distinct().checkpoint()
            if sizes == {t: x.count() for t, x in ids.items()}:
                break
    return {t: tables[t].join(ids[t], keys[t], "left_semi") for t in tables}


def restored(old: dict[str, DataFrame], new: dict[str, DataFrame], keys: dict[str, str], relations: list[Relation], same: dict[str, list[str]]) -> dict[str, DataFrame]:
    """The tables of ``old`` with the rows of ``new``: a row whose columns ``same`` equal an old row's is that row, the least of
    them; any other gets a number after the largest old key, in the order of its own. References follow their rows."""
    maps = {}
    for t, rows in new.items():
        k = keys[t]
        print_ = F.sha2(F.to_json(F.struct(*same[t])), 256) if t in same else F.lit(None).cast("string")
        known = old[t].select(print_.alias("p"), F.col(k).alias("to")).where("p is not null").groupBy("p").agg(F.min("to").alias("to"))
        mine = rows.select(F.col(k).alias("from"), print_.alias("p")).join(known, "p", "left")
        top = old[t].agg(F.coalesce(F.max(k), F.lit(0))).first()[0]
        fresh = numbered(mine.where("to is null").select("from").withColumn("g", F.lit(0)), ["g"], ["from"], "n").select("from", (F.col("n") + top).alias("to"))
        maps[t] = mine.where("to is not null").select("from", "to").union(fresh).checkpoint()
    out = {}
    for t, rows in new.items():
        x = rows
        for column, target in [(keys[t], t), *((r.column, r.target) for r in relations if r.table == t)]:
            m = maps[target].select(F.col("from").alias(column), F.col("to").alias("to__"))
            x = x.join(m, column, "left").withColumn(column, F.col("to__")).drop("to__")
        fresh = x.join(old[t].select(keys[t]), keys[t], "left_anti")
        out[t] = old[t].unionByName(fresh.select(*old[t].columns))
    return out
