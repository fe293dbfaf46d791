"""Passages, quotations, tree depth, vectors, stages and archives: SQL on the smallest tables, and brute force."""

import hashlib
import random

import numpy as np
import pytest

from foliospark.operators import archive, graph, passages, quotes, stages, vectors
from foliospark.plans.documents import DOCUMENTS, DOCUMENTS_ORACLE, STAGES
from foliospark.plans.session import checkpoint_dir
from tests.test_queries import SF, duck, plain  # noqa: F401


@pytest.mark.parametrize("name", sorted(DOCUMENTS_ORACLE))
def test_query(spark, duck, name):  # noqa: F811
    mine, theirs = DOCUMENTS[name](spark, SF), duck.execute(DOCUMENTS_ORACLE[name])
    names = [c[0] for c in theirs.description]
    assert sorted(mine.columns) == sorted(names)
    got = sorted(tuple(plain(x) for x in r) for r in mine.select(*names).collect())
    assert got and got == sorted(tuple(plain(x) for x in r) for r in theirs.fetchall())


PAPER = """A title of a paper

1. Introduction

First prose here, which is long enough to be no heading at all, and it says a thing.

....

12

- a list item
- another one

Table 1. A caption of something

2 Materials and Methods

Second prose, also long enough to be no heading of any kind, says another thing.
It goes on.

REFERENCES

1. Smith, J. Something. Nature 1, 2 (1999)."""


def test_paragraphs():
    found = passages.segmented(PAPER)
    assert [(k, s) for *_, k, s in found] == [("heading", "front"), ("heading", "introduction"), ("prose", "introduction"), ("list", "introduction"), ("caption", "introduction"), ("heading", "methods"), ("prose", "methods"), ("heading", "references"), ("reference", "references")]
    assert all(PAPER[a:b] == PAPER[a:b].strip() != "" for _, a, b, *_ in found) and [p[0] for p in found] == [*range(9)]
    assert passages.segmented("") == passages.segmented(None) == passages.segmented(" \n\n ") == []
    assert passages.section_of("IV. Results and Discussion") == "results" and passages.section_of("Methods we used are many and described below.") is None


def test_chunks_by_brute_force():
    rng = random.Random(6)
    for _ in range(60):
        text = "\n\n".join(rng.choice(["Methods", "Results", "x" * rng.randrange(1, 90) + ".", "word " * rng.randrange(20, 60) + ".", "77"]) for _ in range(rng.randrange(12)))
        paragraphs = passages.segmented(text)
        groups, held = [], []
        for p in paragraphs:
            size = sum(q[2] - q[1] for q in held)
            if held and (held[0][4] != p[4] or p[0] != held[-1][0] + 1 or size + p[2] - p[1] > 130):
                groups.append(held)
                held = []
            held.append(p)
        groups += [held] if held else []
        want = [(i, g[0][0], g[-1][0], text[g[0][1] : g[-1][2]]) for i, g in enumerate(groups)]
        got = passages.chunked(text, paragraphs, 130)
        assert [(c[0], c[1], c[2], c[6]) for c in got] == want
        assert all(c[6] == text[c[3] : c[4]] and c[7] == -(-len(c[6]) // 4) and c[9] == hashlib.sha256(c[6].encode()).hexdigest() for c in got)


def test_parts(spark):
    assert passages.parts_of([]) == [] and passages.parts_of([5, 4, 3], 11) == [(0, 11), (2, 3)] and passages.parts_of([50, 1, 1], 10) == [(0, 50), (1, 4)]
    text = "\n\n".join("y" * 50 + "." for _ in range(9))
    out = passages.source_parts(spark.createDataFrame([(1, text), (2, None)], "id long, text string"), 110, 3).collect()
    assert [(r.part, r.total, r.first, r.fits) for r in out] == [(1, 5, 0, False), (2, 5, 2, False), (3, 5, 4, False), (4, 5, 6, False), (5, 5, 8, False)]
    assert passages.budget_of(512, "ab") == 504 * 4 - 2 and passages.budget_of(10) == 120


def test_quotes(spark):
    texts = ["The k cat of the enzyme is 10 5 s-1, as shown.", "Another sentence stands here, and here it ends.", "The same words twice: same words twice, İstanbul.", "Another sentence stands here, and here it ends."]
    at = [0, 100, 200, 300]
    p = spark.createDataFrame([(1, i, t, a) for i, (t, a) in enumerate(zip(texts, at))], "id long, idx int, text string, at int")
    cases = [
        ([0], "kcat of the Enzyme is 10^5", (0, "contiguous", False, "k cat of the enzyme is 10 5")),
        ([2], "same words twice", (2, "contiguous", True, "same words twice")),
        ([0, 1], "as shown. Another sentence", (0, "stitched", False, None)),
        ([0], "enzyme (10) cat", (0, "stitched", False, None)),
        ([2], "Another sentence stands", (1, "contiguous", True, "Another sentence stands")),
        ([9], "kcat of the enzyme", None),
        ([], "kcat of the enzyme", None),
        ([0], "nothing of the sort anywhere", None),
        (None, "ANOTHER sentence", (1, "contiguous", False, "Another sentence")),
        (None, "The k cat of the ... is 10 5 s-1, as shown", (0, "stitched", False, None)),
        (None, "it ends. The same words", (1, "stitched", False, None)),
        (None, "i̇stanbul", (2, "contiguous", False, "İstanbul")),
        (None, "never printed", None),
        ([0], " .,; ", None),
        (None, None, None),
    ]
    q = spark.createDataFrame([(i, 1, c, t) for i, (c, t, _) in enumerate(cases)] + [(99, 2, [0], "kcat of")], "quote_id long, id long, claimed array<int>, quote string")
    out = {r.quote_id: r for r in quotes.located(q, p).collect()}
    for i, (_, t, want) in enumerate(cases):
        r = out.get(i)
        cut = r and r["at"] is not None and texts[r.paragraph][r["at"] - at[r.paragraph] : r["end"] - at[r.paragraph]]
        assert (r and (r.paragraph, r["match"], r.ambiguous, cut or None)) == want, (i, t, r)
    assert 99 not in out


def test_printed(spark):
    df = spark.createDataFrame([("The k cat ∕ K m was 10 5 s − 1 M − 1 here and there", "kcat ∕ Km was 105 s-1 M-1 here and there"), ("short one", "short"), ("x", None), (None, "a" * 30)], "t string, q string")
    assert [r[0] for r in df.select(quotes.is_printed(df.q, df.t)).collect()] == [True, False, False, False]


def brute_depths(nodes, edges):
    parents = {n: set() for n in nodes}
    for a, b in edges:
        if a != b and a in parents and b in parents:
            parents[a].add(b)
    depth, waiting = {}, dict(parents)
    while ready := [n for n in waiting if all(p in depth for p in parents[n])]:
        for n in ready:
            depth[n] = max((depth[p] + 1 for p in parents[n]), default=0)
        for n in ready:
            del waiting[n]
    back = {}
    for n in sorted(waiting, key=lambda n: (nodes[n] is None, nodes[n] or 0, n)):
        known = [p for p in parents[n] if p in depth]
        back[n] = len(parents[n]) - len(known)
        depth[n] = max((depth[p] + 1 for p in known), default=0)
    best = {n: max(((depth[p], -p) for p in parents[n] if depth[p] < depth[n]), default=(0, None))[1] for n in nodes}
    return {(n, depth[n], None if best[n] is None else -best[n], back.get(n, 0)) for n in nodes}


@pytest.mark.parametrize("seed", range(3))
def test_depths_with_cycles(spark, seed):
    checkpoint_dir(spark)
    rng = random.Random(seed)
    nodes = {i: rng.choice([None, 1990, 1991, 2000]) for i in range(25)}
    edges = [(rng.randrange(27), rng.randrange(27)) for _ in range([12, 30, 60][seed])] + [(3, 4), (4, 3), (5, 5)]
    out = graph.depths(spark.createDataFrame([*nodes.items()], "work_id long, year int"), spark.createDataFrame(edges + edges[:4], "citing long, cited long")).collect()
    assert {(r.work_id, r.depth, r.parent, r.back_edges) for r in out} == brute_depths(nodes, edges) and len(out) == 25


def test_depths_of_nothing(spark):
    checkpoint_dir(spark)
    none = spark.createDataFrame([], "citing long, cited long")
    assert graph.depths(spark.createDataFrame([], "work_id long, year int"), none).count() == 0
    assert [tuple(r) for r in graph.depths(spark.createDataFrame([(1, None)], "work_id long, year int"), none).collect()] == [(1, 0, None, 0)]


def test_nearest_in_blocks(spark, monkeypatch):
    checkpoint_dir(spark)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 7)
    monkeypatch.setattr(vectors, "HELD", 2)
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 3 + i % 2)]) for i in range(90)] + [(200, None), (201, [None, 1.0, 2.0]), (202, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = [(r.query_id, r.rn, r.vec_id, r.score) for r in vectors.nearest(df, df.where("vec_id % 3 = 0"), 4).orderBy("query_id", "rn").collect()]
    want, good = [], [(i, np.array(v)) for i, v in rows if v is not None and None not in v]
    unit = lambda v: v / max(np.linalg.norm(v), 1e-300)
    for q, a in good:
        if q % 3 == 0:
            best = sorted((-round(float(unit(a) @ unit(b)), 6) + 0.0, i) for i, b in good if i != q and len(a) == len(b))[:4]
            want += [(q, n, i, -s + 0.0) for n, (s, i) in enumerate(best, 1)]
    assert [(a, b, c, round(d, 6)) for a, b, c, d in got] == [(a, b, c, round(d, 6)) for a, b, c, d in sorted(want)]


def test_stage_order():
    assert [s.name for s in stages.ordered(STAGES)] == ["fetch", "parse", "clean", "segment", "references", "embed", "callouts"]
    assert stages.downstream(STAGES, "parse") == ["parse", "clean", "segment", "references", "embed", "callouts"] and stages.downstream(STAGES, "clean") == ["clean"] and stages.downstream(STAGES, "segment") == ["segment", "embed", "callouts"]
    with pytest.raises(ValueError):
        stages.ordered([stages.Stage("a", ("x",), ("y",)), stages.Stage("b", ("y",), ("x",))])
    with pytest.raises(ValueError):
        stages.ordered([stages.Stage("a", ("x",), ())])


def test_stale_stages(spark):
    runs = [(1, "fetch", "succeeded", "f"), (1, "parse", "succeeded", "old"), (2, "fetch", "refused", "f"), (3, "fetch", "failed", "f"), (5, "fetch", "empty", "f")]
    now = [(w, s.name, "f") for w in range(1, 6) for s in STAGES]
    out = stages.stale(spark.createDataFrame([(w,) for w in range(1, 6)], "work_id long"), STAGES, spark.createDataFrame(runs, "work_id long, stage string, status string, fingerprint string"), spark.createDataFrame(now, "work_id long, stage string, fingerprint string"), spark.createDataFrame([(5, "parse", "queued"), (1, "clean", "done"), (1, "references", "failed")], "work_id long, stage string, status string"))
    assert {r.work_id: r.stages for r in out.collect()} == {1: "parse,clean,segment"}


def test_supersede(spark):
    cols = "work_id long, stage string, status string, superseded boolean, error string"
    rows = [(1, "fetch", "succeeded", False, None), (1, "segment", "succeeded", False, None), (1, "embed", "running", False, None), (1, "callouts", "running", True, "x"), (2, "segment", "succeeded", True, None), (2, "embed", "running", False, None)]
    out = stages.superseded(spark.createDataFrame(rows, cols), STAGES, spark.createDataFrame([(1, "segment"), (2, "segment")], "work_id long, stage string"))
    assert {(r.work_id, r.stage): (r.status, r.superseded, r.error) for r in out.collect()} == {(1, "fetch"): ("succeeded", False, None), (1, "segment"): ("succeeded", True, None), (1, "embed"): ("failed", True, stages.RETIRED), (1, "callouts"): ("running", True, "x"), (2, "segment"): ("succeeded", True, None), (2, "embed"): ("running", False, None)}


def test_archive_round_trip(spark):
    """A project's rows put into an empty store, and into one that has some of them, tell the same."""
    checkpoint_dir(spark)
    rel = [archive.Relation("item", "box", "box", True), archive.Relation("item", "kind", "kind"), archive.Relation("box", "inside", "box")]
    keys = {"box": "b", "item": "i", "kind": "k"}
    tables = {"box": spark.createDataFrame([(1, "one", None), (2, "two", 1), (3, "three", None), (4, "four", 2)], "b long, name string, inside long"), "item": spark.createDataFrame([(10, 4, 7), (11, 3, 8), (12, 4, None), (13, None, 7)], "i long, box long, kind long"), "kind": spark.createDataFrame([(7, "x"), (8, "y")], "k long, label string")}
    part = archive.closure(tables, keys, rel, {"box": spark.createDataFrame([(4,)], "b long")})
    assert {t: sorted(r[0] for r in x.collect()) for t, x in part.items()} == {"box": [1, 2, 4], "item": [10, 12], "kind": [7]}

    def told(t):
        boxes, kinds = {r.b: r for r in t["box"].collect()}, {r.k: r.label for r in t["kind"].collect()}
        up = lambda b: [] if b is None else [boxes[b].name, *up(boxes[b].inside)]
        return sorted((up(r.box), kinds.get(r.kind) or "") for r in t["item"].collect())

    empty = {t: x.limit(0) for t, x in tables.items()}
    assert told(archive.restored(empty, part, keys, rel, {})) == told(part)
    other = empty | {"box": spark.createDataFrame([(4, "else", None)], "b long, name string, inside long"), "kind": spark.createDataFrame([(3, "x"), (9, "x"), (7, "z")], "k long, label string")}
    back = archive.restored(other, part, keys, rel, {"kind": ["label"]})
    assert told(back) == told(part) and back["kind"].count() == 3 and {r.kind for r in back["item"].collect()} == {3, None}
    assert sorted(r.b for r in back["box"].collect()) == [4, 5, 6, 7]
