"""The review queue: which facts a reader should look at, why, and what was said of them before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions import text as T


def fingerprint() -> Column:
    """A fact by what it says, not by its row: field, subject, conditions, unit and value."""
    return T.fingerprint(*(F.col(c) for c in ("field", "subject", "conditions", "unit")), F.col("value").cast("string")).alias("fingerprint")


def reasons(facts: DataFrame, verifier: DataFrame, checks: DataFrame, sample: DataFrame) -> DataFrame:
    """The facts that need a look, with the first of: conflict, failed or partial by the verifier, a failed check, inferred,
    drawn for the sample. One builder serves the queue and its count, so they agree.

    facts: fact_id, project_id, kind and the fields of ``fingerprint``; verifier: fact_id, result; checks and sample: fact_id.
    """
    worst = verifier.groupBy("fact_id").agg(F.max(F.when(F.col("result") == "failed", 2).when(F.col("result") == "partial", 1).otherwise(0)).alias("worst"))
    flags = lambda df, name: df.select("fact_id").distinct().withColumn(name, F.lit(True))
    x = facts.join(worst, "fact_id", "left").join(flags(checks, "checked"), "fact_id", "left").join(flags(sample, "drawn"), "fact_id", "left")
    why = F.when(F.col("kind") == "conflict", "conflict").when(F.col("worst") == 2, "failed").when(F.col("worst") == 1, "partial").when(F.col("checked"), "check").when(F.col("kind") == "inferred", "inferred").when(F.col("drawn"), "sample")
    return x.withColumn("reason", why).where(F.col("reason").isNotNull()).drop("worst", "checked", "drawn")


def queue(facts: DataFrame, verifier: DataFrame, checks: DataFrame, sample: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``reasons`` with the newest verdict on the very fact, else the newest on one that says the same, which is stale.

    verdicts: verdict_id, fact_id, fingerprint, verdict.
    """
    newest = lambda key, name: verdicts.groupBy(key).agg(F.max_by("verdict", "verdict_id").alias(name))
    x = reasons(facts, verifier, checks, sample).withColumn("fingerprint", fingerprint())
    x = x.join(newest("fact_id", "exact"), "fact_id", "left").join(newest("fingerprint", "alike"), "fingerprint", "left")
    return x.withColumns({"verdict": F.coalesce("exact", "alike"), "stale": F.col("exact").isNull() & F.col("alike").isNotNull()}).drop("exact", "alike")


def count(facts: DataFrame, verifier: DataFrame, checks: DataFrame, sample: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(project_id, n) of the same queue."""
    return reasons(facts, verifier, checks, sample).groupBy("project_id").agg(F.count("*").alias("n"))
