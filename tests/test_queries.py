"""Each query of the library against its SQL in DuckDB, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from foliospark.plans.more import MORE, MORE_ORACLE
from foliospark.plans.oracle import ORACLE
from foliospark.plans.queries import QUERIES

QUERIES, ORACLE = QUERIES | MORE, ORACLE | MORE_ORACLE

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return ""
    return f"{x:.5g}" if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, duck, name):
    mine = QUERIES[name](spark, SF)
    theirs = duck.execute(ORACLE[name])
    names = [c[0] for c in theirs.description]
    assert sorted(mine.columns) == sorted(names)
    got = sorted(tuple(plain(x) for x in r) for r in mine.select(*names).collect())
    assert got == sorted(tuple(plain(x) for x in r) for r in theirs.fetchall())


def test_search_page_is_in_order(spark):
    got = [(-r.n_citations, r.year is None, -(r.year or 0), r.title.lower(), r.work_id) for r in QUERIES["search"](spark, "/root/testdata/sf0.01").collect()]
    assert got and got == sorted(got)


def test_packed_chunks(spark):
    docs = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect() if r.text is not None]
    got = [(r.chunks, r.longest, r.chars) for r in QUERIES["packed_chunks"](spark, SF).orderBy("doc_id").collect()]

    def brute(text):
        out, now = [], 0
        for n in map(len, text.split("\n")):
            if now and now + n > 600:
                out.append(now)
                now = 0
            now += n
        out += [now] if now else []
        return len(out), max(out, default=None), sum(out)

    assert got == [brute(t) for t in docs]


def test_reachable_ends_only_when_nothing_is_new(spark):
    from foliospark.operators import graph
    from foliospark.plans.session import checkpoint_dir

    checkpoint_dir(spark)
    edges, start = spark.createDataFrame([(i, i + 1) for i in range(5)] + [(5, 0)], "citing long, cited long"), spark.createDataFrame([(0,)], "node long")
    for most in (None, 5):
        assert {tuple(r) for r in graph.reachable(edges, start, most).collect()} == {(i, i) for i in range(6)}
    with pytest.raises(ValueError):
        graph.reachable(edges, start, 3)


def test_stream_has_every_day(spark):
    both = [sorted(tuple(map(str, r)) for r in QUERIES[q](spark, SF).select("day", "event_type", "n", "total", "k_sum").collect()) for q in ("daily_usage", "daily_usage_stream")]
    assert both[0] and both[0] == both[1]
