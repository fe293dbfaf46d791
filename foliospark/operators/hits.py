"""What a search elsewhere has found, beside what is here: which work a hit is, what it adds, and what comes in new."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions import bibliographic as B
from foliospark.operators.ranking import numbered

#: Prefixes of DOIs that preprint servers give.
PREPRINT = r"^10\.(?:1101|48550)/"
#: Fields of a work that a hit may fill.
FILLED = ("title", "doi", "year", "venue", "abstract")


def is_preprint(doi: Column) -> Column:
    return F.coalesce(B.normal_doi(doi).rlike(PREPRINT), F.lit(False))


def keyed(rows: DataFrame) -> DataFrame:
    """Adds doi_key and title_key, null where there is nothing to go by."""
    return rows.withColumns({"doi_key": F.nullif(B.normal_doi(F.col("doi")), F.lit("")), "title_key": F.nullif(B.loose(F.col("title")), F.lit(""))})


def resolved(hits: DataFrame, works: DataFrame) -> DataFrame:
    """Hits with ``work_id``: the work of their DOI, else of their title without regard to case and marks, the least of
    several; null if there is none. A hit whose DOI another work of that title contradicts isn't that work."""
    own = keyed(works.select("work_id", "doi", "title"))
    by_doi = own.where("doi_key is not null").groupBy("doi_key").agg(F.min("work_id").alias("of_doi"))
    by_title = own.where("title_key is not null").groupBy("title_key").agg(F.min(F.struct("work_id", F.col("doi_key").alias("d"))).alias("t"))
    x = keyed(hits).withColumn("row__", F.xxhash64(*hits.columns))
    for own_key, of in (("doi_key", by_doi), ("title_key", by_title)):
        # meant to deal out hits without a key; where Spark drops the constant from the join's keys, one task still gets them
        part = F.when(F.col(own_key).isNull(), F.col("row__")).otherwise(0)
        x = x.withColumn("part__", part).join(of.withColumn("part__", F.lit(0).cast("long")).hint("merge"), [own_key, "part__"], "left")
    other = F.coalesce(F.col("doi_key") != F.col("t.d"), F.lit(False))
    return x.withColumn("work_id", F.coalesce("of_doi", F.when(~other, F.col("t.work_id")))).select(*[c for c in hits.columns if c != "work_id"], "doi_key", "title_key", "work_id")


def in_project(hits: DataFrame, works: DataFrame, members: DataFrame) -> DataFrame:
    """Resolved hits with ``member``: whether their work is the project's already."""
    own = members.select("work_id").distinct().withColumn("m", F.lit(True))
    return resolved(hits, works).join(own, "work_id", "left").withColumn("member", F.col("m").isNotNull()).drop("m")


def upserted(works: DataFrame, hits: DataFrame) -> DataFrame:
    """Works with what hits add: fields that are absent are filled from the hit with the least hit_id that has them, none is
    overwritten; hits that are no work come in as new works, one for each DOI or else title, numbered after the largest id in
    the order of their least hit. Hits without either come in not at all.

    works: work_id and FILLED; hits: hit_id and FILLED.
    """
    first = lambda c: F.min_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col("hit_id"))).alias(c)
    key = F.when(F.col("work_id").isNull(), F.coalesce(F.concat(F.lit("doi:"), "doi_key"), F.concat(F.lit("title:"), "title_key")))
    # what is known and what is new come from one pass over the hits
    by = resolved(hits, works).withColumn("key", key).where("work_id is not null or key is not null").groupBy("work_id", "key").agg(F.min("hit_id").alias("hit_id"), *(first(c) for c in FILLED)).checkpoint()
    adds = by.where("work_id is not null").select("work_id", *(F.col(c).alias(f"new_{c}") for c in FILLED))
    old = works.join(adds.hint("merge"), "work_id", "left").select("work_id", *(F.coalesce(c, f"new_{c}").alias(c) for c in FILLED))
    fresh = by.where("work_id is null").drop("work_id", "key")
    top = works.agg(F.coalesce(F.max("work_id"), F.lit(0))).first()[0]
    new = numbered(fresh.withColumn("g", F.lit(0)), ["g"], ["hit_id"], "n").select((F.col("n") + top).alias("work_id"), *FILLED)
    return old.unionByName(new)
