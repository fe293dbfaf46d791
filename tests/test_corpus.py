"""Scoped search, project counts, absent papers, roles and cells: SQL on the smallest tables, and cases by hand."""

import random

import pytest
from pyspark.sql import functions as F

from foliospark.functions import roles
from foliospark.operators import cells, changes, matching, projects, search
from foliospark.plans import corpus
from foliospark.plans.corpus import CORPUS, CORPUS_ORACLE
from tests.test_queries import SF, duck, plain  # noqa: F401


@pytest.mark.parametrize("name", sorted(CORPUS_ORACLE))
def test_query(spark, duck, name):  # noqa: F811
    mine, theirs = CORPUS[name](spark, SF), duck.execute(CORPUS_ORACLE[name])
    names = [c[0] for c in theirs.description]
    assert sorted(mine.columns) == sorted(names)
    got = sorted(tuple(plain(x) for x in r) for r in mine.select(*names).collect())
    assert got and got == sorted(tuple(plain(x) for x in r) for r in theirs.fetchall())


def test_list_count_and_facets_agree(spark):
    people = corpus.people(spark, SF).cache()
    for f in (corpus.SCOPED, search.Filters(), search.Filters(query="ring", year=("2010-2035",)), search.Filters(content_status=("full_text",), inclusion_status=("unread",))):
        n = search.total(people, f, True).first().n
        assert n == people.where(search.predicates(f, scoped=True)).count()
        if n <= search.SEARCH_LIMIT:
            assert search.page(people, f, True).count() == n
        by = {(r.facet, r.value): r.n for r in search.buckets(people, f, True).collect()}
        for facet in ("venue", "inclusion_status"):  # without its own clause a facet counts what choosing each value would find
            for (k, v), count in by.items():
                if k == facet:
                    assert count == people.where(search.predicates(f, facet, True)).where(F.col(facet) == v).count()
                    break
    pages = [r.work_id for o in range(0, 30, 7) for r in search.page(people, search.Filters(), True, 7, o).orderBy("place").collect()]
    assert len(pages) == len(set(pages)) == 35


def test_inclusion_without_a_project(spark):
    people = search.population(corpus.E.works(spark, SF), corpus.E.citations(spark, SF), corpus.E.documents_of_works(spark, SF))
    assert search.total(people, search.Filters(inclusion_status=("read",)), False).first().n == 0 < search.total(people, search.Filters(inclusion_status=(" ",), year=("soon", "1990 - x")), False).first().n
    assert "inclusion_status" not in {r.facet for r in search.buckets(people, search.Filters(), False).collect()}
    titles = [r.title.lower() for r in search.page(people, search.Filters(sort="title"), False, 50).orderBy("place").collect()]
    assert titles == sorted(titles) and search.page(people, search.Filters(), False, 10, 300).count() == 0
    with pytest.raises(ValueError):
        search.order_of("newest", True)


def test_overview(spark):
    members = spark.createDataFrame([(1, 1, 0.5, "unread", True), (1, 2, None, "read", False), (2, 2, 0.1, "included", False)], "project_id long, work_id long, relevance double, inclusion_status string, is_reference boolean")
    facts = spark.createDataFrame([(1, 1), (1, 9), (0, 2), (0, 2)], "project_id long, work_id long")
    job = "project_id long, work_id long, status string, outcome string, dismissed boolean, run_id long"
    jobs = spark.createDataFrame([(1, 1, "failed", None, False, 5), (1, 1, "error", None, False, 6), (1, 2, "failed", None, True, 5), (2, 2, "failed", None, False, None), (0, 2, "failed", None, False, 7), (0, 2, "queued", None, False, None), (1, 1, "running", "skipped", False, None), (0, None, "running", None, False, None)], job)
    runs = spark.createDataFrame([(5, False), (6, False), (7, True)], "run_id long, superseded boolean")
    out = {r.project_id: tuple(r)[1:] for r in projects.overview(spark.createDataFrame([(1,), (2,), (3,)], "project_id long"), members, facts, jobs, runs).collect()}
    assert out == {1: (2, 1, 1, 2, 1, 1, 0, 1, 1), 2: (1, 1, 0, 1, 0, 0, 1, 0, 1), 3: (0,) * 9}


def test_merged(spark):
    rows = [(5, 1, "10.1/A", "One title here", "none"), (3, 2, "https://doi.org/10.1/a", "Other", "retrieving"), (9, 1, None, "A longer title", "failed"), (8, 1, " ", "a  LONGER title!", None), (7, 4, None, "short", "odd"), (6, 4, None, None, None)]
    out = {r.key: (r["head"], r.title, r.status, r.citing, r.members) for r in matching.merged(spark.createDataFrame(rows, "id long, citing long, doi string, title string, status string")).collect()}
    assert out == {"doi:10.1/a": (3, "Other", "retrieving", [1, 2], [3, 5]), "title:a longer title": (8, "a  LONGER title!", "failed", [1], [8, 9]), "row:7": (7, "short", "none", [4], [7]), "row:6": (6, None, "none", [4], [6])}


def test_promotion(spark):
    edges = spark.createDataFrame([(1, 5)], "citing long, cited long")
    absent = spark.createDataFrame([(10, 1), (11, 1), (12, 2), (13, 2)], "id long, citing long")
    contexts = spark.createDataFrame([(1, 1, 10, None), (2, 1, None, 5), (3, 2, 12, None), (4, 2, 13, None)], "context_id long, citing long, ref_id long, cited long")
    e, a, c = matching.promoted(edges, absent, contexts, spark.createDataFrame([(10, 5), (11, 6), (12, 2), (12, 3)], "id long, work_id long"))
    assert sorted(map(tuple, e.collect())) == [(1, 5), (1, 6)] and [r.id for r in a.collect()] == [13]
    assert sorted(map(tuple, c.collect()), key=lambda r: r[0]) == [(1, 1, None, 5), (2, 1, None, 5), (4, 2, 13, None)]


def test_roles(spark):
    cases = [("as previously described in [4]", "r2-method"), ("KE70 was greater than KE07 [3]", None), ("It was 3 times greater than this [3]", "r6-comparison"), ("See ref. 5, higher than all", None), ("Unlike others, we saw it", "r4-contrast"), ("nothing", None)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)] + [(99, "nothing")], "i int, t string")
    out = df.select("i", roles.role(F.col("t"), F.when(F.col("i") == 99, "background").otherwise("results")).alias("r")).orderBy("i").collect()
    assert [r.r and r.r.cue for r in out] == [c for _, c in cases] + ["r8-intro-default"]


def test_figures(spark):
    pairs = [("1,234", "1234", True), ("5.0 ± 0.1", "5", True), ("> 5", "5", False), ("> 5", "≥5.0", True), ("5*", "5.0", True), ("−3", "-3", True), ("1e3", "1000", True), ("n.d.", "5", False), ("a", "a", True), ("1,23", "123", False), ("", "", True)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(pairs)], "i int, a string, b string")
    assert [r.s for r in df.select("i", cells.same_figure(F.col("a"), F.col("b")).alias("s")).orderBy("i").collect()] == [s for *_, s in pairs]
    marks = ["", None, "n.d.", "N D", "not determined", "below limit", "-", "—", "*", "5", "notable", "none"]
    df = spark.createDataFrame([*enumerate(marks)], "i int, a string")
    assert [r.s for r in df.select("i", cells.is_absence(F.col("a")).alias("s")).orderBy("i").collect()] == [True] * 9 + [False, False, True]


def test_cells_by_brute_force(spark):
    """Cells of plain whole numbers, where equal figures are equal texts."""
    rng = random.Random(12)
    stored = [(d, f"r{r}", f"c{c}", str(rng.randrange(4))) for d in range(30) for r in range(2) for c in range(3) for _ in range(rng.randrange(3))]
    read = {(d, f"r{r}", f"c{c}"): [str(rng.randrange(4)) for _ in range(rng.randrange(3))] for d in range(30) for r in range(2) for c in range(3) if rng.random() < 0.8}
    marked = {k: rng.choice(["n.d.", None]) for k in read}
    want = []
    by = {}
    for d, r, c, v in stored:
        by.setdefault((d, r, c), []).append(v)
    for (d, r, c), vs in by.items():
        if (d, r, c) not in read:
            continue
        printed = read[d, r, c]
        others = {x: [k[2] for k in sorted(read) if k[:2] == (d, r) and x in read[k] and (not printed or k[2] != c)] for x in vs}
        for v in vs:
            if printed and v in printed:
                continue
            kind = "value-belongs-to-another-column" if others[v] else "value-not-printed" if printed else "stored-where-page-marks-absent"
            want.append((d, r, c, v, kind, (others[v] or [None])[0]))
        want += [(d, r, c, None, "value-not-stored", None) for p in printed if p not in vs]
    out = cells.disagreements(spark.createDataFrame(stored, "doc int, row string, col string, value string"), spark.createDataFrame([(*k, v, marked[k]) for k, v in read.items()], "doc int, row string, col string, values array<string>, marked string"))
    assert want and sorted([(r.doc, r.row, r.col, r.stored, r.kind, r.under) for r in out.collect()], key=str) == sorted(want, key=str)


def test_cascade(spark):
    t = {"a": spark.createDataFrame([(1,), (2,)], "a long"), "b": spark.createDataFrame([(10, 1), (11, 2), (12, None)], "b long, of long"), "c": spark.createDataFrame([(20, 10), (21, 11), (22, 99)], "c long, of_b long")}
    left = changes.cascaded(t, {"a": spark.createDataFrame([(1,)], "a long")}, [("b", "of", "a", "a"), ("c", "of_b", "b", "b")])
    assert [sorted(r[0] for r in left[k].collect()) for k in "abc"] == [[2], [11, 12], [21, 22]]
