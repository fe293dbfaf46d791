"""Jobs of a pipeline: planned for works, what blocks them, which comes next, and what comes back when one is tried again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliospark.operators import stages as S

#: States that end a job, that let those after it start, and the most attempts.
ENDED, SATISFIED, ATTEMPTS = ("done", "failed", "cancelled", "review"), ("done", "review"), 5


def key() -> Column:
    return F.concat_ws(":", "stage", F.col("work_id").cast("string"), F.col("project_id").cast("string"))


def planned(works: DataFrame, stages: list[S.Stage], jobs: DataFrame, runs: DataFrame) -> DataFrame:
    """(job_key, work_id, project_id, stage, idx): the jobs to add, one for each work and stage that has neither a live job of
    its key nor a current run that holds. Planning again adds nothing.

    works: work_id, project_id; jobs: job_key, status; runs: work_id, stage, status of current runs.
    """
    order = F.broadcast(S.table(works.sparkSession, stages).select("stage", "idx"))
    each = works.select("work_id", "project_id").distinct().withColumn("stage", F.explode(F.array(*(F.lit(s.name) for s in stages)))).join(order, "stage").withColumn("job_key", key())
    live = jobs.where(~F.col("status").isin(*ENDED)).select("job_key").distinct()
    held = runs.where(F.col("status").isin(*S.CACHEABLE)).select("work_id", "stage").distinct()
    return each.join(live.hint("merge"), "job_key", "left_anti").join(held.hint("merge"), ["work_id", "stage"], "left_anti").select("job_key", "work_id", "project_id", "stage", "idx")


def dependencies(jobs: DataFrame, stages: list[S.Stage]) -> DataFrame:
    """(job_id, depends_on): a job waits for those of the same work and project whose stages provide what it needs."""
    needs = S.table(jobs.sparkSession, stages).select("stage", F.explode(F.flatten("needs")).alias("before")).distinct()
    mine = jobs.select("job_id", "work_id", "project_id", "stage").join(F.broadcast(needs), "stage")
    # jobs are many for each row that Spark judges their size by, so they aren't broadcast, here and below
    theirs = jobs.select(F.col("job_id").alias("depends_on"), "work_id", "project_id", F.col("stage").alias("before")).hint("merge")
    return mine.join(theirs, ["work_id", "project_id", "before"]).where("job_id != depends_on").select("job_id", "depends_on").distinct()


def blocked(jobs: DataFrame, waits: DataFrame) -> DataFrame:
    """Adds live_blockers and dead_blockers: ids, in order and joined by commas, of what a job waits for and what will never
    let it start."""
    state = jobs.select(F.col("job_id").alias("depends_on"), "status").where(~F.col("status").isin(*SATISFIED)).hint("merge")
    dead = F.col("status").isin("failed", "cancelled")
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c, F.col("depends_on")))), lambda x: x.cast("string")), ",")
    by = waits.join(state, "depends_on").groupBy("job_id").agg(joined(~dead).alias("live_blockers"), joined(dead).alias("dead_blockers"))
    return jobs.join(by.hint("merge"), "job_id", "left").fillna("", ["live_blockers", "dead_blockers"])


def ready(jobs: DataFrame, waits: DataFrame, stages: list[S.Stage], now: str) -> DataFrame:
    """Adds ``turn`` to the jobs that may start: queued, not cancelled, due, not tried too often, waiting for nothing; by
    priority, the order of stages, and id."""
    order = F.broadcast(S.table(jobs.sparkSession, stages).select("stage", "idx"))
    open_ = waits.join(jobs.select(F.col("job_id").alias("depends_on"), "status").where(~F.col("status").isin(*SATISFIED)).hint("merge"), "depends_on").select("job_id").distinct().hint("merge")
    due = F.col("run_after").isNull() | (F.col("run_after") <= F.lit(now).cast("timestamp"))
    x = jobs.where((F.col("status") == "queued") & ~F.col("cancel_requested") & due & (F.col("attempts") < ATTEMPTS)).join(open_, "job_id", "left_anti").join(order, "stage")
    return x.withColumn("turn", F.row_number().over(W.partitionBy("project_id").orderBy("priority", "idx", "job_id")))


def settled(jobs: DataFrame, now: str, wait: int = 60) -> DataFrame:
    """Running jobs whose lease has run out go back into the queue, later the more often they were tried, or fail."""
    lost = (F.col("status") == "running") & (F.col("lease_until") < F.lit(now).cast("timestamp"))
    spent = lost & (F.col("attempts") >= ATTEMPTS)
    later = F.lit(now).cast("timestamp") + F.make_dt_interval(secs=F.lit(wait) * F.pow(F.lit(2), F.col("attempts") - 1))
    return jobs.withColumns({"status": F.when(spent, "failed").when(lost, "queued").otherwise(F.col("status")), "run_after": F.when(lost & ~spent, later).otherwise(F.col("run_after"))})


def retried(jobs: DataFrame, waits: DataFrame, again: DataFrame) -> DataFrame:
    """Failed or cancelled jobs of ``again`` (job_id) are queued anew, and so are cancelled ones that wait, directly or through
    others, for them. Each round looks only at what the last one brought back."""
    front = jobs.where(F.col("status").isin("failed", "cancelled")).join(again.select("job_id").hint("merge"), "job_id", "left_semi").select("job_id").distinct().checkpoint()
    back = [front]
    cancelled = jobs.where("status = 'cancelled'").select("job_id").hint("merge")
    while not front.isEmpty():
        new = waits.join(front.select(F.col("job_id").alias("depends_on")).hint("merge"), "depends_on").select("job_id").distinct().join(cancelled, "job_id", "left_semi")
        for seen in back:
            new = new.join(seen.hint("merge"), "job_id", "left_anti")
        front = new.checkpoint()
        back.append(front)
    revived = back[0]
    for x in back[1:]:
        revived = revived.union(x)
    out = jobs.join(revived.withColumn("hit", F.lit(True)).hint("merge"), "job_id", "left")
    return out.withColumns({"status": F.when(F.col("hit"), "queued").otherwise(F.col("status")), "attempts": F.when(F.col("hit"), 0).otherwise(F.col("attempts"))}).drop("hit").select(*jobs.columns)


def rollup(jobs: DataFrame) -> DataFrame:
    """(project_id, stage, cell, n): each stage's worst state over a project's jobs: failed, running, waiting, cancelled, done."""
    rank = F.when(F.col("status") == "failed", 4).when(F.col("status") == "running", 3).when(F.col("status").isin("queued", "blocked"), 2).when(F.col("status") == "cancelled", 1).otherwise(0)
    by = jobs.groupBy("project_id", "stage").agg(F.max(rank).alias("r"), F.count("*").alias("n"))
    return by.select("project_id", "stage", F.get(F.array(*map(F.lit, ("done", "cancelled", "waiting", "running", "failed"))), F.col("r")).alias("cell"), "n")
