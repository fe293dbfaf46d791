"""Bibliographies, callouts and reference matching: SQL on the smallest tables, and brute force on made cases."""

import random

import pytest
from pyspark.sql import functions as F

from foliospark.functions import bibliographic as B
from foliospark.operators import bibliography, callouts, matching
from foliospark.plans.literature import LITERATURE, LITERATURE_ORACLE
from tests.test_queries import SF, duck, plain  # noqa: F401


@pytest.mark.parametrize("name", sorted(LITERATURE_ORACLE))
def test_query(spark, duck, name):  # noqa: F811
    mine, theirs = LITERATURE[name](spark, SF), duck.execute(LITERATURE_ORACLE[name])
    names = [c[0] for c in theirs.description]
    assert sorted(mine.columns) == sorted(names)
    got = sorted(tuple(plain(x) for x in r) for r in mine.select(*names).collect())
    assert got and got == sorted(tuple(plain(x) for x in r) for r in theirs.fetchall())


def values(spark, column, *rows):
    return [r[0] for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + ", ".join(f"c{k} string" for k in range(len(rows[0])))).orderBy("i").select(column).collect()]


def test_folding(spark):
    got = values(spark, B.fold_text(F.col("c0")), ("Röthlisberger",), ("Ro ¨ thlisberger",), ("Altho ff , E. A.",), ("Taw fi k",), ("ﬁnd ﬂow",), ("a–b “c” ‘d’",), (None,), ("",))
    assert got == ["Rothlisberger", "Rothlisberger", "Althoff, E. A.", "Tawfik", "find flow", "a-b \"c\" 'd'", None, ""]


def test_lines_joined(spark):
    got = values(spark, B.unwrapped(F.col("c0")), ("biomo-\nlecular",), ("ring-\nopening",), ("X-\nray",), ("off-\nthe-shelf",), ("doi 10.1101/2024.08.02.\n606416",), ("a \n b",))
    assert got == ["biomolecular", "ring-opening", "X-ray", "off-the-shelf", "doi 10.1101/2024.08.02.606416", "a b"]


def test_venues_and_names(spark):
    sim = B.venue_similarity(B.venue_tokens(F.col("c0")), B.venue_tokens(F.col("c1")))
    assert values(spark, sim, ("J. Mol. Biol.", "Journal of Molecular Biology"), ("Proteins", "Protein Science"), ("Nature", "Science"), ("", "Science")) == [1.0, 0.5, 0.0, 0.0]
    assert values(spark, B.surnames_equal(F.col("c0"), F.col("c1")), ("rothlisberger", "rcthlisberger"), ("smith", "smyth"), ("rothlisberger", "rothlisberge")) == [True, False, False]
    assert values(spark, B.words_equal(F.col("c0"), F.col("c1")), ("enzyme", "enzime"), ("enzyme", "enzymes"), ("cat", "car"), ("cat", "cat")) == [True, True, False, True]
    assert values(spark, B.series_part(F.col("c0")), ("Chemistry. II. Rates",), ("Part 4: more",), ("Cu(II) complexes",), ("I think",)) == ["2", "4", None, None]
    assert values(spark, B.normal_doi(F.col("c0")), ("https://dx.doi.org/10.1021/JA1.",), ("doi: 10.1/x)",)) == ["10.1021/ja1", "10.1/x"]


WORK = "work_id long, title string, doi string, author_surnames array<string>, year int, venue string"
REF = "citing long, ref_index int, doi string, title string, surnames array<string>, year int, venue string, raw string"


def rand_name(rng):
    return "".join(rng.choice("abcdefgh") for _ in range(rng.choice([4, 6, 9, 10])))


def test_candidates_lose_no_pair(spark):
    """Every pair that scores enough among all pairs is a candidate."""
    rng = random.Random(7)
    words = ["alpha", "beta", "gamma", "delta", "kinetics", "enzyme", "catalysis", "design", "of", "the", "directed", "proton"]
    people = [rand_name(rng) for _ in range(14)]
    works = [(1000 + i, " ".join(rng.choice(words) for _ in range(rng.randrange(2, 8))), None, [rng.choice(people) for _ in range(rng.randrange(0, 4))], rng.choice([None, 2000, 2001, 2002, 2010]), rng.choice([None, "Journal of Things", "Nature", "Chem Rev"])) for i in range(60)]
    refs = []
    for i in range(240):
        w = rng.choice(works)
        title = rng.choice([None, w[1], " ".join(w[1].split()[:-1]), w[1].upper(), ""])
        names = [n if rng.random() < 0.7 else n[:1] + "z" + n[2:] for n in w[3]]
        refs.append((i % 12, i, None, title, rng.choice([names, [], None]), w[4] if w[4] is None or rng.random() < 0.6 else w[4] + rng.choice([1, -1, 7]), rng.choice([w[5], "J. Th.", None]), " ".join(n.title() for n in names) + rng.choice([" et al. ", " "]) + (w[1] if rng.random() < 0.5 else "")))
    r, w = spark.createDataFrame(refs, REF), spark.createDataFrame(works, WORK)
    a, b = matching.prepared(r, w)
    want = {(x.citing, x.ref_index, x.work_id, round(x.s, 9)) for x in a.crossJoin(b).withColumn("s", matching.score()).where(f"s >= {matching.LEAST}").collect()}
    got = {(x.citing, x.ref_index, x.work_id, round(x.score, 9)) for x in matching.scored(r, w).collect()}
    assert len(want) > 50 and got == want


def test_scores_of_single_pairs(spark):
    title = "Kemp elimination catalysts by computational enzyme design"
    work = (1, title, "10.1/A", ["Röthlisberger", "Khersonsky"], 2008, "Nature")
    refs = [
        (9, 1, "https://doi.org/10.1/a", "anything", [], 1990, None, ""),
        (9, 2, None, title, ["rothlisberger"], 2008, "Nature", "Rothlisberger D, et al."),
        (9, 3, None, title, ["rcthlisberger", "khersonsky"], 2009, "Nature", ""),
        (9, 4, None, None, ["rothlisberger"], 2008, "Nat.", "D. Rothlisberger, Nature 2008"),
        (9, 5, None, None, ["rothlisberger"], 2005, "Nature", "D. Rothlisberger, Nature 2005"),
        (9, 6, None, None, ["khersonsky"], 2008, "Nature", "O. Khersonsky, Nature 2008"),
        (9, 7, None, title, ["rothlisberger"], 2001, "J. Org. Chem.", ""),
        (9, 8, None, title + ". II. More", ["rothlisberger"], 2008, "Nature", ""),
        (1, 9, None, title, ["rothlisberger"], 2008, "Nature", ""),
        (9, 10, None, None, [], None, None, None),
    ]
    two = (2, "Something. I. Else " + title, None, ["Röthlisberger"], 2008, "Nature")
    out = {(r.ref_index, r.work_id): (round(r.score, 6), r.method) for r in matching.scored(spark.createDataFrame(refs, REF), spark.createDataFrame([work, two], WORK)).collect()}
    assert out[1, 1] == (1.0, "doi") and out[2, 1] == (1.0, "scored") and out[3, 1] == (0.925, "scored") and out[4, 1][0] == round((0.3 + 0.25 * 1.0 + 0.15) / 0.7, 6)
    assert not {(5, 1), (6, 1), (7, 1), (9, 1), (8, 2)} & out.keys() and not [k for k in out if k[0] == 10]


def test_assignment_within_a_paper(spark):
    rng = random.Random(1)
    rows = list({(c, r, w): (c, r, w, rng.choice((0.7, 0.8, 0.9)), "scored") for c in range(5) for _ in range(120) for r, w in [(rng.randrange(12), rng.randrange(15))]}.values())
    want = set()
    for c in range(5):
        refs, works = set(), set()
        for _, r, w, s, _ in sorted((x for x in rows if x[0] == c), key=lambda x: (-x[3], x[1], x[2])):
            if r not in refs and w not in works:
                refs.add(r)
                works.add(w)
                want.add((c, r, w, s))
    got = matching.assigned(spark.createDataFrame(rows, "citing long, ref_index int, work_id long, score double, method string")).collect()
    assert {tuple(r)[:4] for r in got} == want
    ties = [(1, r, w, 0.9, "scored") for r in range(40) for w in range(40)]
    got = matching.assigned(spark.createDataFrame(ties, "citing long, ref_index int, work_id long, score double, method string")).collect()
    assert sorted((r.ref_index, r.work_id) for r in got) == [(i, i) for i in range(40)]


def test_longest_chain():
    def brute(nums):
        best = []
        for i, n in enumerate(nums):
            if n <= 3:
                chain = [i]
                for j in range(i + 1, len(nums)):
                    if 0 < nums[j] - nums[chain[-1]] <= 3:
                        chain.append(j)
                best = chain if len(chain) >= len(best) else best
        return best

    rng = random.Random(3)
    for _ in range(500):
        nums = [rng.randrange(1, 15) for _ in range(rng.randrange(25))]
        assert bibliography.chain_of(nums) == brute(nums)


BODY = "\n".join(f"This is line {i} of a text that says nothing of note in {['one', 'two'][i % 2]} ways." for i in range(40))
LEADS = {"dot": "{}. ", "bracket": "[{}] ", "paren": "({}) ", "bare": "{} ", "author-year": ""}


def entry(rng, n):
    name = rng.choice(["Wolfenden", "Khersonsky", "Tawfik", "Hilvert"])
    return f"{name}, R.; Baker, D. A title that is set in a line\nand goes on here. J. Mol. Biol. {n}, {n + 100}–{n + 120} ({1950 + n})."


@pytest.mark.parametrize("style", LEADS)
@pytest.mark.parametrize("heading", ["References", "8. Bibliographical References", "R EFERENCES", ""])
@pytest.mark.parametrize("gap", [False, True])
def test_entries_of_each_style(style, heading, gap):
    if style == "author-year" and not heading:
        return
    rng = random.Random(f"{style}{heading}{gap}")
    nums = [n for n in range(1, 16) if not (gap and n in (4, 5, 9))]
    want = [LEADS[style].format(n) + entry(rng, n) for n in nums]
    printed = [e + ("\nResults of Imagined Work 12" if n % 3 == 0 and style != "author-year" else "") for n, e in zip(nums, want)]
    text = BODY + f"\n{heading}\n" + "\n".join(printed) + "\nAcknowledgements\nWe thank 12 people and 1999 others."
    rows = bibliography.split_of(text, "Results of Imagined Work")
    assert [r[2] for r in rows] == want and {r[0] for r in rows} == {style}
    assert [r[1] for r in rows] == (nums if style != "author-year" else [*range(1, len(nums) + 1)])
    assert all(text[r[3] : r[4]] == r[2] for r in rows)


def test_texts_without_a_bibliography():
    for text in ("", "short", BODY, BODY + "\nReferences\n", BODY + "\n" + "\n".join(f"{i}. Figure of things" for i in range(1, 20))):
        assert bibliography.split_of(text, None) == []


def test_marker_inside_a_line_and_entries_after_the_section():
    rng = random.Random(2)
    rows = [f"({n}) " + entry(rng, n) for n in range(1, 13)]
    text = BODY + "\nReferences\n" + "\n".join(rows[:4]) + " Biochemistry ARTICLE " + "\n".join(rows[4:10]) + "\nMethods\nWe did much.\n" + "\n".join(rows[10:])
    assert [r[1] for r in bibliography.split_of(text, None)] == [*range(1, 13)]


def test_references(spark):
    long = "(11) (a) Wolfenden, R. Nature 2001, 12, 100-110. (b) Baker, D. Science 2002, 3, 4-9. (c) no"
    lines = [f"({n}) Tawfik, D. S. A title of some length here. Nature {n}, 10–20 ({1990 + n}). doi:10.1234/{'same' if n in (3, 4) else n}" for n in range(1, 11)]
    df = spark.createDataFrame([(1, BODY + "\nReferences\n" + "\n".join([*lines, long])), (2, None), (3, "")], "id long, text string")
    out = bibliography.references(df).orderBy("place", F.asc_nulls_first("part")).collect()
    assert [(r.ordinal, r.part) for r in out] == [(n, None) for n in range(1, 12)] + [(11, "a"), (11, "b")]
    assert [r.doi for r in out[:5]] == ["10.1234/1", "10.1234/2", None, None, "10.1234/5"] and [r.year for r in out[:3]] == [1991, 1992, 1993]
    assert out[-1].year == 2002 and out[-1].at == -1 and "baker" in out[-1].surnames and out[0].surnames[0] == "tawfik"


def test_marks_expand(spark):
    cases = {"1": [1], "1, 3-5;7": [1, 3, 4, 5, 7], "4-400": None, "5-3": None, "0": None, "": None, "2–4": [2, 3, 4], "1,,2": [1, 2], "-5": None, "1-2-3": None, " 7 ": [7], "1-41": [*range(1, 42)], "1-42": None}
    assert values(spark, callouts.expanded(F.col("c0")), *((k,) for k in cases)) == list(cases.values())
    for k, v in cases.items():
        assert callouts.ordinals(k) == (v or [])


def scan(text, known=range(1, 9), spans=(), fence=(-1, -1)):
    return [(text[a:b], s) for _, a, b, _, s in callouts.marks_of(text, set(known), list(spans), fence)]


def test_callouts_in_context():
    long = "and this goes on for a good while so that it is long enough."
    assert [m for m, _ in scan(f"As shown before [1,2] {long} Others [3] agree {long}")] == ["[1,2]", "[3]"]
    assert [m for m, _ in scan(f"Found (2) and (3, 4) {long} At pH (7) none, n = (5) none, in 1998 (99) none {long}")] == ["(2)", "(3, 4)"]
    assert scan(f"See equation (3) and [4] {long}") == [] == scan(f"1 Department of Chemistry [4] {long}")
    assert [m for m, _ in scan(f"Inside [1] {long}", spans=[(5, 12)])] == [] and len(scan(f"Inside [1] {long}", spans=[(8, 12), (0, 3)])) == 1
    assert scan(f"{long}\n\nFenced [2] {long}", fence=(61, 90)) == []
    (_, s), = scan(f"It was seen, e.g. by others et al. [5], that this is so. {long}")
    assert s == "It was seen, e.g. by others et al. [5], that this is so."
    (_, s), = scan(f"A first sentence which is long enough to stand alone here. [6] It was then con-\ntinued elsewhere at length.")
    assert s.startswith("A first sentence") and s.endswith("continued elsewhere at length.")
