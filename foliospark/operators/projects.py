"""Projects at a glance: counts of their works by what has happened to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: States of a job.
FAILED, BUSY = ("failed", "error"), ("running", "queued", "blocked")


def needs_attention(jobs: DataFrame, runs: DataFrame) -> DataFrame:
    """Failed jobs that nobody dismissed and whose run no later one has replaced. jobs: run_id; runs: run_id, superseded."""
    history = runs.where("superseded").select("run_id").distinct()
    return jobs.where(F.col("status").isin(*FAILED) & ~F.col("dismissed") & F.col("run_id").isNotNull()).join(history, "run_id", "left_anti")


def touched(rows: DataFrame, members: DataFrame) -> DataFrame:
    """(project_id, work_id), distinct: of rows that name a project, theirs; of rows of project 0, those of every project
    that has the work."""
    own = rows.where("project_id != 0 and work_id is not null").select("project_id", "work_id")
    every = rows.where("project_id = 0").select("work_id").distinct().join(members.select("project_id", "work_id"), "work_id").select("project_id", "work_id")
    return own.union(every).distinct()


def overview(projects: DataFrame, members: DataFrame, facts: DataFrame, jobs: DataFrame, runs: DataFrame) -> DataFrame:
    """(project_id, works, ranked, reference, extracted, unread, undecided, decided, failed, processing) of every project.

    projects: project_id; members: project_id, work_id, relevance, inclusion_status, is_reference; facts: project_id, work_id
    of current runs; jobs: project_id (0 for all), work_id, status, outcome, dismissed, run_id; runs: run_id, superseded.
    Extracted, failed and processing count works once; extracted ones only if they are the project's.
    """
    on = lambda c: F.count_if(c)
    kind = F.col("inclusion_status")
    base = members.groupBy("project_id").agg(F.count("*").alias("works"), F.count("relevance").alias("ranked"), on(F.col("is_reference")).alias("reference"), on(kind == "unread").alias("unread"), on(kind.isin("read", "uncertain")).alias("undecided"), on(kind.isin("included", "excluded")).alias("decided"))
    read = touched(facts, members).join(members.select("project_id", "work_id"), ["project_id", "work_id"], "left_semi")
    busy = jobs.where(F.col("status").isin(*BUSY) & F.col("outcome").isNull())
    out = projects.select("project_id").distinct().join(base, "project_id", "left")
    for name, rows in (("extracted", read), ("failed", touched(needs_attention(jobs, runs), members)), ("processing", touched(busy, members))):
        out = out.join(rows.groupBy("project_id").agg(F.count("*").alias(name)), "project_id", "left")
    return out.fillna(0).select("project_id", "works", "ranked", "reference", "extracted", "unread", "undecided", "decided", "failed", "processing")
