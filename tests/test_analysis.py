"""Units, samples, numbering, relations of fields and reviews: SQL on the smallest tables, and brute force."""

import collections
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from foliospark.operators import ranking, records, review, sampling, units
from foliospark.plans.analysis import ANALYSIS, ANALYSIS_ORACLE
from foliospark.plans.session import checkpoint_dir
from tests.test_queries import SF, duck, plain  # noqa: F401


@pytest.mark.parametrize("name", sorted(ANALYSIS_ORACLE))
def test_query(spark, duck, name):  # noqa: F811
    mine, theirs = ANALYSIS[name](spark, SF), duck.execute(ANALYSIS_ORACLE[name])
    names = [c[0] for c in theirs.description]
    assert sorted(mine.columns) == sorted(names)
    got = sorted(tuple(plain(x) for x in r) for r in mine.select(*names).collect())
    assert got and got == sorted(tuple(plain(x) for x in r) for r in theirs.fetchall())


RATE = ["M^-1 s^-1", "s^-1 M^-1", "m  1 s  1", "M  1 s  1", "M 2 1 s 2 1", "M⁻¹ s⁻¹", "M−1 s−1", "M⁻¹s⁻¹", "s^-1 ∙ M^-1", "M ‒ 1 s ‒ 1", "m⁻¹ s⁻¹"]
KNOWN = {"nM": ("M", 1e-9, 0), "nm": ("Å", 10, 0), "mM": ("M", 1e-3, 0), "pM": ("M", 1e-12, 0), "pm": ("Å", 0.01, 0), "μM": ("M", 1e-6, 0), "µM": ("M", 1e-6, 0), "uM": ("M", 1e-6, 0), "K": ("°C", 1, -273.15), "Kelvin": ("°C", 1, -273.15), "celsius": ("°C", 1, 0), "°C": ("°C", 1, 0), "C": ("°C", 1, 0), "Minutes": ("s", 60, 0), "MIN": ("s", 60, 0), "Angstrom": ("Å", 1, 0), "kJ/mol": ("kcal/mol", 0.239006, 0), "kcal mol^-1": ("kcal/mol", 1, 0), "1/s": ("s^-1", 1, 0), "mol/L/s": ("M s^-1", 1, 0), "M/M": ("1", 1, 0), "Fold change": ("fold", 1, 0), "percent": ("%", 1, 0), "pH units": ("pH", 1, 0), "ratio": ("ratio", 1, 0)}


def test_known_units():
    for u in RATE:
        assert units.canonical_unit(u) == ("M^-1 s^-1", 1.0, 0.0), u
    for u, (name, scale, shift) in KNOWN.items():
        got = units.canonical_unit(u)
        assert got and got[0] == name and math.isclose(got[1], scale) and got[2] == shift, u
    for u in ["um", "Ml", "MS", "H", "PM", "NM", "MM", "Nm", "FM", "S", "furlong", "", " ", None, "24 h of", "s^0", "kg/mol", "M^x"]:
        assert units.canonical_unit(u) is None, u


def test_dimensions(spark):
    pairs = [("mM", "uM", True), ("mM", "MM", None), ("M", "um", None), ("s^-1", "", None), ("mM", "mm", None), ("%", "pH", None), ("fold", "ratio", None), ("fold", "Fold change", True), ("%", "mM", False), ("pH", "s^-1", False), (RATE[0], RATE[2], True), ("kcal/mol", "s", False)]
    of = lambda u: (units.canonical_unit(u) or (None,))[0]
    df = spark.createDataFrame([(i, of(a), of(b)) for i, (a, b, _) in enumerate(pairs)], "i int, a string, b string")
    assert [r.c for r in df.select("i", units.compatible(F.col("a"), F.col("b")).alias("c")).orderBy("i").collect()] == [c for *_, c in pairs]


def test_bounds():
    assert units.bound_of("N 95") == (">", 95.0) and units.bound_of("b ~ 1,000 mM") == ("<", 1000.0) and units.bound_of("N 95 °C") == (">", 95.0)
    assert all(units.bound_of(t) is None for t in ("n = 3", "N 95 people", "95", "x 95", "", None, "N"))


def test_canonical_values(spark):
    rows = [("mM", 5.0), ("nm", 5.0), ("MM", 5.0), (None, 5.0), ("K", 0.0), ("mM", None)]
    out = {(r.unit, r.value): r.canonical_value for r in records.canonical(spark.createDataFrame(rows, "unit string, value double")).collect()}
    assert out == {("mM", 5.0): 5e-3, ("nm", 5.0): 50.0, ("MM", 5.0): None, (None, 5.0): None, ("K", 0.0): -273.15, ("mM", None): None}


def mulberry(seed):
    """The generator step by step."""
    a = seed & 0xFFFFFFFF

    def step():
        nonlocal a
        a = (a + 0x6D2B79F5) & 0xFFFFFFFF
        t = ((a ^ a >> 15) * (1 | a)) & 0xFFFFFFFF
        t = ((t + (((t ^ t >> 7) * (61 | t)) & 0xFFFFFFFF)) & 0xFFFFFFFF) ^ t
        return ((t ^ t >> 14) & 0xFFFFFFFF) / 4294967296

    return step


def test_generator_in_columns(spark):
    seeds = [0, 1, 7, 2654435761 * 3 + 12, 2**40 + 5]
    got = [r.x for s in seeds for r in spark.range(1, 40).select("id", sampling.draw(F.lit(s), F.col("id")).alias("x")).orderBy("id").collect()]
    want = [rng() for s in seeds for rng in [mulberry(s)] for _ in range(39)]
    assert got == want
    import numpy as np

    assert [float(x) for s in seeds for x in sampling.drawn(s, np.arange(1, 40))] == want


@pytest.mark.parametrize("chunk", [4, 1 << 20])
def test_shuffle_backwards(monkeypatch, chunk):
    monkeypatch.setattr(sampling, "CHUNK", chunk)
    for n in [1, 2, 3, 10, 57]:
        for seed in range(5):
            pool, rng = list(range(n)), mulberry(seed)
            for i in range(n - 1, 0, -1):
                j = int(rng() * (i + 1))
                pool[i], pool[j] = pool[j], pool[i]
            for size in (1, 4, n):
                assert sampling.first_places(seed, n, size) == pool[:size]


def test_sample_of_distinct_facts(spark):
    checkpoint_dir(spark)
    rng = random.Random(4)
    rows = [(p, rng.randrange(40), i) for p in range(1, 5) for i in range([0, 1, 2, 30, 90][p])]
    out = sampling.qc_sample(spark.createDataFrame(rows, "project long, fact long, m long"), "project", "fact", ["m"]).orderBy("project", "place").collect()
    for p in range(1, 5):
        pool = sorted(x for x in rows if x[0] == p)
        pool.sort(key=lambda x: x[2])
        n, draw = len(pool), mulberry(p * 2654435761 + len(pool))
        for i in range(n - 1, 0, -1):
            j = int(draw() * (i + 1))
            pool[i], pool[j] = pool[j], pool[i]
        want = list(dict.fromkeys(x[1] for x in pool))[: max(min(3, n), min(10, math.ceil(n * 0.1)))]
        assert [r.fact for r in out if r.project == p] == want


def test_numbering_of_any_group(spark):
    checkpoint_dir(spark)
    rng = random.Random(9)
    rows = [(rng.choice([None, "a", "a", "a", "b"]), rng.randrange(1000), i) for i in range(3000)]
    out = ranking.numbered(spark.createDataFrame(rows, "g string, x int, i int"), ["g"], ["x", "i"], "n").collect()
    want = {}
    for g in (None, "a", "b"):
        for n, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: r[1:]), 1):
            want[r[2]] = n
    assert {r.i: r.n for r in out} == want


RECORD = "work_id long, run_id long, ordinal int, subject string, field string, value double, unit string"


def test_scale_shifts_by_brute_force(spark):
    checkpoint_dir(spark)
    rng = random.Random(2)
    rows = [(r, r, k, "s", rng.choice("fg"), rng.choice([-1, 1]) * rng.choice([1.0, 2.0, 5.0, 9.0]) * (1e4 if r in (3, 8) else 1), rng.choice(["mM", "uM" if r < 4 else "mM", None, "odd"])) for r in range(10) for k in range(rng.randrange(12))]
    rows += [(20, 20, 0, "s", "f", None, "mM"), (20, 20, 1, "s", "f", 0.0, "mM")]
    want, groups = set(), collections.defaultdict(list)
    for _, run, _, _, f, v, u in rows:
        if v and u in ("mM", "uM"):
            groups[f].append((run, abs(v) * {"mM": 1e-3, "uM": 1e-6}[u]))
    for f, vals in groups.items():
        for run in {r for r, _ in vals}:
            mine, rest = [v for r, v in vals if r == run], [v for r, v in vals if r != run]
            if len(mine) >= 3 and len(rest) >= 5:
                d = abs(math.log10(statistics.median(mine) / statistics.median(rest)))
                if d > 2:
                    want.add((f, run, len(mine), len(rest), round(d, 9)))
    out = records.scale_shifts(spark.createDataFrame(rows, RECORD)).collect()
    assert want and {(r.field, r.run_id, r.n, r.others, round(r.decades, 9)) for r in out} == want


def test_derived_gaps(spark):
    rows = []
    for work, (power, noise, n) in {1: (3, 0, 4), 2: (0, 0, 5), 3: (-2, 0.04, 5), 4: (2, 0.2, 5), 5: (3, 0, 3), 6: (10, 0, 5)}.items():
        for k in range(n):
            a, b = 3.0 + k, 2.0 + k * k
            rows += [(work, work, k, f"s{k}", f, v, u) for f, v, u in (("a", a, "s^-1"), ("b", b, "M"), ("c", a / b * 10 ** (power + noise * (k % 2)), "M^-1 s^-1"), ("t", 20.0 + k, "K"), ("x", a, "odd"))]
    out = records.derived_gaps(spark.createDataFrame(rows, RECORD), "work_id").collect()
    assert {(r.work_id, r.numerator, r.denominator, r.result, r.decades, r.n) for r in out} == {(1, "a", "b", "c", 3, 4), (3, "a", "b", "c", -2, 5)}


def test_review_reasons(spark):
    cols = "fact_id long, project_id long, kind string, field string, subject string, conditions string, unit string, value double"
    facts = spark.createDataFrame([(i, 1, {1: "conflict", 2: "inferred"}.get(i, "stated"), "F", f"s{i % 4}", None, "mM", 1.0) for i in range(1, 9)], cols)
    one = lambda *ids: spark.createDataFrame([(i,) for i in ids], "fact_id long")
    verifier = spark.createDataFrame([(3, "failed"), (3, "passed"), (4, "partial"), (1, "failed"), (8, "passed")], "fact_id long, result string")
    said = facts.where("fact_id in (3, 7)").select((F.col("fact_id") + 10).alias("verdict_id"), "fact_id", review.fingerprint(), F.lit("accept").alias("verdict"))
    said = said.union(said.where("fact_id = 3").select(F.lit(99), F.lit(0), "fingerprint", F.lit("correct")))
    got = {r.fact_id: (r.reason, r.verdict, r.stale) for r in review.queue(facts, verifier, one(2, 5), one(5, 6), said).collect()}
    assert got == {1: ("conflict", None, False), 2: ("check", None, False), 3: ("failed", "accept", False), 4: ("partial", None, False), 5: ("check", None, False), 6: ("sample", None, False)}
    assert review.count(facts, verifier, one(2, 5), one(5, 6), said).collect()[0].n == 6
