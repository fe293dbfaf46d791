"""Records, readings, tables, identifiers and jobs: SQL on the smallest tables, and cases by hand."""

import csv
import io
import json

import pytest
from pyspark.sql import functions as F

from foliospark.functions import text as T
from foliospark.operators import extraction, jobs
from foliospark.plans.desk import DESK, DESK_ORACLE
from foliospark.plans.documents import STAGES
from foliospark.plans.session import checkpoint_dir
from tests.test_queries import SF, duck, plain  # noqa: F401


@pytest.mark.parametrize("name", sorted(DESK_ORACLE))
def test_query(spark, duck, name):  # noqa: F811
    mine, theirs = DESK[name](spark, SF), duck.execute(DESK_ORACLE[name])
    names = [c[0] for c in theirs.description]
    assert sorted(mine.columns) == sorted(names)
    got = sorted(tuple(plain(x) for x in r) for r in mine.select(*names).collect())
    assert got and got == sorted(tuple(plain(x) for x in r) for r in theirs.fetchall())


def column(spark, of, *texts):
    df = spark.createDataFrame([*enumerate(texts)], "i int, t string")
    return [r.x for r in df.select("i", of(F.col("t")).alias("x")).orderBy("i").collect()]


def test_quantities_and_absences(spark):
    assert column(spark, T.reads_as_quantity, "5", "about 12", "~ 3", ">95 °C", ".5", "up to 7", "N 95", "", None, "some") == [True] * 6 + [False] * 4
    assert column(spark, T.reports_absence, "n.d.", "ND", "not detected", "No activity", "no product was detected", "below the limit of x", "n/a", "5", "nothing", "", None) == [True] * 7 + [False] * 4


def test_identifiers(spark):
    got = column(spark, T.identifier, "https://doi.org/10.1021/JA1.", "arxiv.org/abs/2301.00001v2", "2301.00001", "cond-mat/0207270", "math.GT/0309136", "PMID 27096365", "27096365", "1234", "a title", "", None)
    assert [r and tuple(r) for r in got] == [("doi", "10.1021/ja1"), ("arxiv", "2301.00001v2"), ("arxiv", "2301.00001"), ("arxiv", "cond-mat/0207270"), ("arxiv", "math.GT/0309136"), ("pmid", "27096365"), ("pmid", "27096365"), None, None, None, None]


def test_safe_and_plain(spark):
    assert column(spark, lambda x: T.safe(x, 5), " a\x00b‮c ", "\x07", "abcdefgh", None) == ["abc", None, "abcde", None]
    html = "<p>One <b>bold</b> &amp;lt; 5 &deg;C</p><script>var x = '<p>';</script><!-- no --><div>two</div>"
    assert column(spark, T.plain_markup, html, "", None, "a < b") == ["One bold &lt; 5 °C two", "", None, "a < b"]


def test_csv_is_read_back(spark):
    checkpoint_dir(spark)
    rows = [(3, " lead", None), (1, 'say "x", y', "a\r\nb"), (2, "", "é µ"), (2, "z", "tail ")]
    lines = extraction.csv_lines(spark.createDataFrame(rows, "k int, a string, b string"), ["k", "a"]).orderBy("line_no").collect()
    text = "".join(r.line for r in lines)
    assert text.startswith("﻿k,a,b\r\n") and text.endswith("\r\n") and '" lead"' in text and '"tail "' in text
    assert [*csv.reader(io.StringIO(text[1:], newline=""))] == [["k", "a", "b"], *([str(k), a, b or ""] for k, a, b in sorted(rows, key=lambda r: r[:2]))]


def test_readings(spark):
    cols = "work_id long, field_id long, subject string, conditions string, fact_id long, measurement_id long"
    rows = [(1, 1, " A ", None, 1, 9), (1, 1, "a", "", 2, 8), (1, 1, "b", "x", 3, 1), (1, 2, "A", None, 4, 2), (1, None, "c", None, 5, 3), (2, 1, None, None, 6, None)]
    df = spark.createDataFrame(rows, cols)
    out = {(r.work_id, r.field_id, r.reading): (r.fact_id, r.depth, r.paper_level) for r in extraction.readings(df, ["measurement_id"]).collect()}
    assert out == {(1, 1, "a|"): (2, 2, False), (1, 1, "b|x"): (3, 2, False), (1, 2, "a|"): (4, 2, True), (2, 1, "|"): (6, 1, False)}
    assert [r.fact_id for r in extraction.unassigned(df).collect()] == [5]


def test_project_json(spark):
    projects = spark.createDataFrame([(1, "one"), (2, "two")], "project_id long, name string")
    members = spark.createDataFrame([(1, 5, "read"), (1, 4, None)], "project_id long, work_id long, inclusion_status string")
    rows = spark.createDataFrame([(5, 2, None, "f", "s", 1.5, "mM", "validated"), (5, 1, 7, None, None, None, None, "review")], "work_id long, fact_id long, measurement_id long, field_key string, subject string, value double, unit string, status string")
    out = {r.project_id: json.loads(r.json) for r in extraction.project_json(projects, members, rows).collect()}
    assert [w["work_id"] for w in out[1]["works"]] == [4, 5] and [x["fact_id"] for x in out[1]["works"][1]["records"]] == [1, 2] and out[1]["works"][0]["records"] == [] and "works" not in out[2]


def test_verdicts_and_batches(spark):
    df = spark.createDataFrame([("ok", None), ("unclear", ""), ("problem", "It says 5"), ("problem", "this may be 5"), ("problem", None)], "v string, n string")
    assert [r[0] for r in df.select(extraction.settled(F.col("v"), F.col("n"))).collect()] == ["passed", "skipped", "failed", "skipped", "failed"]
    q = spark.createDataFrame([(i, "p" if i % 3 else "q", "k") for i in range(30)], "question_id int, passage string, kind string")
    sizes = {(r.passage, r.batch): r["count"] for r in extraction.batched(q).groupBy("passage", "batch").count().collect()}
    assert sizes == {("p", 0): 8, ("p", 1): 8, ("p", 2): 4, ("q", 0): 8, ("q", 1): 2}


JOB = "job_id long, work_id long, project_id long, stage string, status string, cancel_requested boolean, run_after timestamp, attempts int, priority int"


def test_jobs(spark):
    checkpoint_dir(spark)
    names = [s.name for s in STAGES]
    state = {1: ["done", "failed", "cancelled", "cancelled", "cancelled", "cancelled", "queued"], 2: ["done", "done", "done", "queued", "queued", "queued", "queued"]}
    rows = [(10 * w + i, w, 1, n, state[w][i], False, None, 0, 5) for w in (1, 2) for i, n in enumerate(names)]
    all_ = spark.createDataFrame(rows, JOB)
    waits = jobs.dependencies(all_, STAGES)
    assert {r.depends_on for r in waits.where("job_id = 16").collect()} == {13, 14}
    by = {r.job_id: (r.live_blockers, r.dead_blockers) for r in jobs.blocked(all_, waits).collect()}
    assert by[16] == ("", "13,14") and by[25] == ("23", "") and by[23] == ("", "")
    assert [(r.job_id, r.turn) for r in jobs.ready(all_, waits, STAGES, "2024-01-01").orderBy("turn").collect()] == [(23, 1), (24, 2)]
    again = jobs.retried(all_, waits, spark.createDataFrame([(11,), (10,)], "job_id long"))
    assert sorted(r.job_id for r in again.where("status = 'queued' and work_id = 1").collect()) == [11, 12, 13, 14, 15, 16]
    none = jobs.retried(all_, waits, spark.createDataFrame([], "job_id long"))
    assert none.where("status = 'queued'").count() == 5
    plan = jobs.planned(spark.createDataFrame([(3, 1), (3, 1)], "work_id long, project_id long"), STAGES, spark.createDataFrame([("fetch:3:1", "queued"), ("parse:3:1", "failed")], "job_key string, status string"), spark.createDataFrame([(3, "embed", "empty"), (3, "clean", "failed")], "work_id long, stage string, status string"))
    assert sorted(r.stage for r in plan.collect()) == ["callouts", "clean", "parse", "references", "segment"]


def test_leases(spark):
    rows = [(1, "running", 1, "2024-01-01", None), (2, "running", 5, "2024-01-01", None), (3, "running", 1, "2025-01-01", None), (4, "queued", 0, None, None)]
    df = spark.createDataFrame(rows, "job_id long, status string, attempts int, lease string, run string").selectExpr("job_id", "status", "attempts", "cast(lease as timestamp) as lease_until", "cast(run as timestamp) as run_after")
    out = {r.job_id: (r.status, str(r.run_after)) for r in jobs.settled(df, "2024-06-01 00:00:00").collect()}
    assert out == {1: ("queued", "2024-06-01 00:01:00"), 2: ("failed", "None"), 3: ("running", "None"), 4: ("queued", "None")}


def test_hits(spark):
    from foliospark.operators import hits

    checkpoint_dir(spark)
    cols = "title string, doi string, year int, venue string, abstract string"
    works = spark.createDataFrame([(1, "A Title", "10.1234/a", None, None, None), (2, "Other", None, 1999, "V", None), (3, "a title!", None, None, None, None)], "work_id long, " + cols)
    rows = [(10, "x", "https://doi.org/10.1234/A", 2001, None, None), (11, "OTHER", None, 2002, "W", "abs"), (12, "A title", "10.1234/b", 2003, None, None), (13, "a title", None, 2004, "late", "late"), (14, None, None, 1, "n", "n"), (15, "New", "10.48550/n", None, None, None), (16, "new", "doi:10.48550/N", 2020, "ar", None), (17, " - ", "", None, None, None)]
    found = spark.createDataFrame(rows, "hit_id long, " + cols)
    out = {r.hit_id: (r.work_id, r.member) for r in hits.in_project(found, works, spark.createDataFrame([(2,)], "work_id long")).collect()}
    assert out == {10: (1, False), 11: (2, True), 12: (None, False), 13: (1, False), 14: (None, False), 15: (None, False), 16: (None, False), 17: (None, False)}
    new = {r.work_id: (r.title, r.doi, r.year, r.venue, r.abstract) for r in hits.upserted(works, found).collect()}
    assert new == {1: ("A Title", "10.1234/a", 2001, "late", "late"), 2: ("Other", None, 1999, "V", "abs"), 3: ("a title!", None, None, None, None), 4: ("A title", "10.1234/b", 2003, None, None), 5: ("New", "10.48550/n", 2020, "ar", None)}
    assert column(spark, hits.is_preprint, "10.1101/2020.1", "https://doi.org/10.48550/arXiv.1", "10.1038/x", None) == [True, True, False, False]
