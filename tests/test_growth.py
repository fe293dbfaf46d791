"""What must not grow with the tables: what is broadcast, how much one task and one batch hold."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from foliospark.plans.session import checkpoint_dir
from tests.test_queries import SF


@pytest.mark.parametrize("name", ["bibliography_references", "callout_gate", "bibliography_entries", "blocked_jobs", "ready_jobs", "cell_disagreements", "retried_jobs", "stale_works", "superseded_cascade", "planned_jobs"])
def test_only_fixed_tables_are_broadcast(spark, name):
    checkpoint_dir(spark)
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().sparkPlan().toString()
    keys = {re.sub(r"#\d+L?", "", k) for k in re.findall(r"BroadcastHashJoin \[(.*?)\]", plan)}
    assert keys <= {"stage"} and "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_batches_of_texts_are_small(spark):
    from foliospark.operators import bibliography, callouts, passages

    docs = spark.createDataFrame([(1, "a text")], "id long, text string")
    key, before = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for of in (lambda: passages.chunks(docs, 400), lambda: bibliography.entries(docs), lambda: callouts.scanned(docs, spark.createDataFrame([(1, 1, 0, 1)], "id long, ordinal int, at int, end int"))):
            spark.conf.set(key, "10000")
            of()
            assert int(spark.conf.get(key)) <= 1024
    finally:
        spark.conf.set(key, before)


def test_nearest_in_small_blocks(spark, monkeypatch):
    from foliospark.operators import vectors

    checkpoint_dir(spark)
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    run = lambda: sorted(map(tuple, vectors.nearest(e, e.where("vec_id % 10 = 0"), 3).collect()))
    whole = run()
    monkeypatch.setattr(vectors, "SCORES", 1)
    assert whole and run() == whole


def held_apart(spark, made):
    """Partitions that hold rows, as the plan deals them, without what Spark joins as it runs."""
    key = "spark.sql.adaptive.enabled"
    spark.conf.set(key, "false")
    try:
        return made().select(F.spark_partition_id()).distinct().count()
    finally:
        spark.conf.set(key, "true")


def test_hits_without_a_key_are_dealt_out(spark):
    from foliospark.operators import hits

    own = spark.createDataFrame([(1, "10.1/a", "A title")], "work_id long, doi string, title string")
    found = spark.range(1000).select(F.col("id").alias("hit_id"), F.lit(None).cast("string").alias("doi"), F.lit(None).cast("string").alias("title"))
    assert held_apart(spark, lambda: hits.resolved(found, own)) > 1


def test_paragraphs_meet_quotations_by_document(spark):
    from foliospark.operators import quotes

    q = spark.createDataFrame([(1, 1, None, "a quotation that is long enough")], "quote_id long, id long, claimed array<int>, quote string")
    p = spark.createDataFrame([(1, 0, "A quotation that is long enough, and more", 7)], "id long, idx int, text string, at int")
    plan = quotes.located(q, p)._jdf.queryExecution().sparkPlan().toString()
    assert len(re.findall("(?:Join|CartesianProduct)", plan)) == 1


def test_rows_that_become_many_are_dealt_by_their_number(spark):
    from foliospark.sources import entities

    few, many = (entities.spread(spark.range(n), "id").rdd.getNumPartitions() for n in (10, 40 * 20_000))
    assert many >= 40 > few


def test_reachable_makes_its_edges_once(spark, tmp_path):
    from foliospark.operators import graph

    checkpoint_dir(spark)
    log = str(tmp_path / "made")

    def run(it):
        with open(log, "a") as f:
            f.write("x")
        yield from it

    edges = spark.range(5, numPartitions=1).selectExpr("id as citing", "id + 1 as cited").mapInPandas(run, "citing long, cited long")
    assert graph.reachable(edges, spark.createDataFrame([(0,)], "node long")).count() == 6
    assert open(log).read() == "x"


def test_plain_texts_are_spared_the_table_of_marks(spark, monkeypatch):
    from foliospark.functions import bibliographic as B

    texts = ["Effi cient e ffi cient", "a ` b`", "caf´ e", "naïve “x” – y", "", None, "plain of\nlines", "ﬁ ´"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    whole = [r[0] for r in df.select(B.fold_text(F.col("t"))).collect()]
    assert whole[:2] == ["Effi cient efficient", "ab"] and whole[3:6] == ['naive "x" - y', "", None]
    monkeypatch.setattr(B, "compatible", lambda: ("a", "b"))
    assert spark.createDataFrame([("banana",)], "t string").select(B.fold_text(F.col("t"))).first()[0] == "banana"


def shuffles(df):
    """The kinds of the shuffles in a plan."""
    return re.findall(r"Exchange .*?, (\w+), \[plan_id", df._jdf.queryExecution().executedPlan().toString())


def test_runs_dealt_out_by_work_stay_where_they_are(spark):
    from foliospark.operators import stages
    from foliospark.plans.documents import STAGES

    runs = spark.createDataFrame([(1, "parse", "succeeded", False, None), (1, "clean", "running", False, None), (1, None, "succeeded", False, None), (2, "clean", "succeeded", True, None), (2, "segment", "succeeded", False, None)], "work_id long, stage string, status string, superseded boolean, error string").repartition(3, "work_id")
    origins = spark.createDataFrame([(1, "parse"), (1, "parse"), (2, "clean"), (3, None)], "work_id long, stage string").repartition(3, "work_id")
    out = stages.superseded(runs, STAGES, origins)
    assert sorted(map(tuple, out.select("work_id", F.coalesce("stage", F.lit("")).alias("stage"), "status", "superseded").collect())) == [(1, "", "succeeded", False), (1, "clean", "failed", True), (1, "parse", "succeeded", True), (2, "clean", "succeeded", True), (2, "segment", "succeeded", False)]
    assert set(shuffles(out)) == {"REPARTITION_BY_NUM"}


def test_places_are_followed_in_one_pass(monkeypatch):
    import numpy as np

    from foliospark.operators import sampling

    n, seed, isin, seen = 1 << 17, 7 * 2654435761, np.isin, []
    place = np.arange(n)
    for k, u in enumerate(sampling.drawn(seed, np.arange(1, n)), 1):
        i = n - k
        j = int(u * (i + 1))
        place[i], place[j] = place[j], place[i]
    monkeypatch.setattr(sampling.np, "isin", lambda a, b: (seen.append(len(a)), isin(a, b))[1])
    assert sampling.first_places(seed, n, 300) == place[:300].tolist()
    assert sum(seen) <= 2 * n


def test_projects_are_dealt_out_before_their_shuffle(spark, monkeypatch):
    from foliospark.operators import sampling

    checkpoint_dir(spark)
    rows, seen = spark.range(100).selectExpr("id % 5 as project_id", "id as fact_id"), []
    run = type(rows).mapInPandas
    monkeypatch.setattr(type(rows), "mapInPandas", lambda df, *a: (seen.append(shuffles(df)), run(df, *a))[1])
    assert sampling.qc_sample(rows, "project_id", "fact_id", ["fact_id"]).count() == 15
    assert [x[0] for x in seen] == ["REPARTITION_BY_NUM"]


@pytest.mark.parametrize("name", ["reference_scores", "reference_matches"])
def test_references_and_works_are_not_broadcast(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("of", ["references", "callouts", "gate"])
def test_texts_are_read_once_where_they_lie(spark, of, tmp_path):
    from foliospark.operators import bibliography, callouts

    log = str(tmp_path / "read")
    text = "It is known [1] and shown [2, 3], as others [4-400] say. " * 9 + "\n\nReferences\n" + "\n".join(f"[{i}] Smith, J. A work of art {i}. Journal {i}, 1–9 doi:10.1/same (2001).\nA Running Head {i}" for i in range(1, 7))

    def run(it):
        with open(log, "a") as f:
            f.write("x")
        yield from it

    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "id long, text string").coalesce(1).mapInPandas(run, "id long, text string")
    out = {"references": bibliography.references, "callouts": callouts.callouts_of, "gate": callouts.gate_of}[of](docs)
    assert shuffles(out) == []
    rows = out.collect()
    assert open(log).read() == "x"
    if of == "references":
        assert [(r.ordinal, r.doi, r.year, r.surnames[0]) for r in rows] == [(i, None, 2001, "smith") for i in range(1, 7)] and "Head" not in rows[0].raw
    elif of == "callouts":
        assert sorted({(r.at, r.ordinal) for r in rows})[:3] == [(12, 1), (26, 2), (26, 3)] and len(rows) == 27
    else:
        assert [tuple(r) for r in rows] == [(1, 6, 3, 9, 0, False)]


def test_one_reading_gives_what_entries_and_marks_do(spark):
    from foliospark.operators import bibliography, callouts
    from foliospark.sources import entities

    docs = entities.papers(spark, SF)
    entries = bibliography.entries(docs)
    marks = callouts.scanned(docs, entries)
    same = lambda a, b: sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(*a.columns).collect()))
    assert same(callouts.callouts_of(docs), callouts.callouts(marks, entries))
    assert same(callouts.gate_of(docs), callouts.gate(marks, entries))


def test_pairs_that_sketches_rule_out_are_no_candidates(spark):
    from foliospark.operators import matching
    from tests.test_literature import REF, WORK

    works = [(1, "crystallography alpha beta gamma delta", None, ["longlastname"], 2000, "Journal of Things"), (2, "crystallography kappa lambda sigma omega", None, ["longlastname"], 2000, "Journal of Things"), (3, "of other matters", None, ["longlastname"], 2001, "Annals")]
    refs = [(9, 1, None, "crystallography alpha beta gamma delta", ["longlastname"], 2000, None, ""), (9, 2, None, None, ["longlastname"], 2000, "J. Things", "Longlastname, A.")]
    a, b = matching.prepared(spark.createDataFrame(refs, REF), spark.createDataFrame(works, WORK))
    got = sorted((r.ref_index, r.work_id) for r in matching.candidates(a, b, matching.LEAST).collect())
    assert got == [(1, 1), (2, 1), (2, 2)]
