"""A pipeline's stages and their runs: what is stale, what may run, and what falls with a run that is superseded."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Outcomes that hold until their inputs change, that let the next stage go on, and job states of the queue.
CACHEABLE, SATISFYING, QUEUED = ("succeeded", "empty", "skipped", "refused"), ("succeeded", "empty", "skipped"), ("queued", "blocked", "running", "failed", "cancelled")
RETIRED = "retired while running: an input this stage depends on changed"


@dataclass(frozen=True)
class Stage:
    """``transforms`` is a capability that a stage both needs and provides: it doesn't feed others by it."""

    name: str
    requires: tuple[str, ...] = ()
    provides: tuple[str, ...] = ()
    rank: int = 0
    transforms: str | None = None


def ordered(stages: list[Stage]) -> list[Stage]:
    """Stages after all others that provide what they require; of those that may come next, by rank and name. A circle, or a
    capability that nothing provides, is an error."""
    offered = {c for s in stages for c in s.provides}
    if missing := [c for s in stages for c in s.requires if c not in offered]:
        raise ValueError(f"nothing provides {missing}")
    rest, out = list(stages), []
    while rest:
        waits = lambda s: any(c in o.provides for o in rest if o is not s for c in s.requires)  # noqa: E731, B023
        ready = sorted((s for s in rest if not waits(s)), key=lambda s: (s.rank, s.name))
        if not ready:
            raise ValueError(f"stages wait for each other: {sorted(s.name for s in rest)}")
        out.append(ready[0])
        rest.remove(ready[0])
    return out


def table(spark: SparkSession, stages: list[Stage]) -> DataFrame:
    """(stage, idx, needs): needs has, for each capability required, the earlier stages that provide it."""
    order = ordered(stages)
    rows = [(s.name, i, [[o.name for o in order[:i] if c in o.provides] for c in s.requires]) for i, s in enumerate(order)]
    return spark.createDataFrame(rows, "stage string, idx int, needs array<array<string>>")


def stale(works: DataFrame, stages: list[Stage], runs: DataFrame, now: DataFrame, jobs: DataFrame) -> DataFrame:
    """(work_id, stages): works with stages whose run is missing though what they need is there, or was made from other inputs.

    works: work_id; runs: work_id, stage, status, fingerprint of the current runs; now: work_id, stage, fingerprint; jobs:
    work_id, stage, status. Left out: works without any run, stages with a job in the queue, and stages whose run ended in
    a way that doesn't hold. One row a work and stage: the stages are a handful, known to the program.
    """
    plan = F.broadcast(table(works.sparkSession, stages))
    by = runs.groupBy("work_id").agg(F.collect_set(F.when(F.col("status").isin(*SATISFYING), F.col("stage"))).alias("satisfied"), F.collect_set(F.when(~F.col("status").isin(*CACHEABLE), F.col("stage"))).alias("open"))
    held = jobs.where(F.col("status").isin(*QUEUED)).groupBy("work_id").agg(F.collect_set("stage").alias("held"))
    each = F.array(*(F.lit(s.name) for s in stages))
    # runs, jobs and fingerprints are many for each row that Spark judges their size by, so they aren't broadcast, here and below
    rows = works.select("work_id").distinct().join(by.hint("merge"), "work_id").join(held.hint("merge"), "work_id", "left").withColumn("stage", F.explode(each)).join(plan, "stage")
    rows = rows.where(~F.array_contains("open", F.col("stage")) & ~F.coalesce(F.array_contains("held", F.col("stage")), F.lit(False)))
    made = runs.groupBy("work_id", "stage").agg(F.max("fingerprint").alias("made"), F.lit(True).alias("ran"))
    both = rows.join(made.hint("merge"), ["work_id", "stage"], "left").join(now.select("work_id", "stage", F.col("fingerprint").alias("now")).hint("merge"), ["work_id", "stage"], "left")
    ready = F.forall("needs", lambda chain: F.arrays_overlap(chain, F.col("satisfied")))
    is_stale = F.when(F.col("ran").isNull(), ready).otherwise(~F.col("made").eqNullSafe(F.col("now")))
    found = both.where(is_stale).groupBy("work_id").agg(F.array_sort(F.collect_list(F.struct("idx", "stage"))).alias("s"))
    return found.select("work_id", F.array_join(F.transform("s", lambda x: x["stage"]), ",").alias("stages"))


def downstream(stages: list[Stage], name: str) -> list[str]:
    """The stage and all later ones that need, directly or through others, what it provides; capabilities it only transforms
    aside."""
    order = ordered(stages)
    seen, todo = [name], [name]
    while todo:
        at = next(i for i, s in enumerate(order) if s.name == todo[0])
        gives = {c for c in order[at].provides if c != order[at].transforms}
        more = [s.name for s in order[at + 1 :] if s.name not in seen and gives & {*s.requires, *([s.transforms] if s.transforms else [])}]
        seen, todo = seen + more, todo[1:] + more
    return seen


def superseded(runs: DataFrame, stages: list[Stage], origins: DataFrame) -> DataFrame:
    """All runs after those of ``origins`` (work_id, stage) and all runs below them are superseded: with superseded, status
    and error. A running one fails; runs that are superseded already stay as they are."""
    falls = {s.name: downstream(stages, s.name) for s in stages}
    below = reduce(lambda c, s: c.when(F.col("stage") == s.name, F.array(*map(F.lit, falls[s.name]))), stages[1:], F.when(F.col("stage") == stages[0].name, F.array(*map(F.lit, falls[stages[0].name]))))
    # a stage falls only through an origin that has a current run; all meet by work, as their stages are a handful, so that
    # rows which are dealt out by work already stay where they are
    current = runs.where("not superseded").groupBy("work_id").agg(F.collect_set("stage").alias("current"))
    live = origins.join(current.hint("merge"), "work_id").where(F.array_contains("current", F.col("stage")))
    hit = live.groupBy("work_id").agg(F.flatten(F.collect_set(below)).alias("hit"))
    x = runs.join(hit.hint("merge"), "work_id", "left").withColumn("falls", F.coalesce(F.array_contains("hit", F.col("stage")), F.lit(False)) & ~F.col("superseded"))
    running: Column = F.col("falls") & (F.col("status") == "running")
    return x.withColumns({"error": F.when(running, F.coalesce("error", F.lit(RETIRED))).otherwise(F.col("error")), "status": F.when(running, "failed").otherwise(F.col("status")), "superseded": F.col("superseded") | F.col("falls")}).drop("hit", "falls")
