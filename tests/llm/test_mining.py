"""Centroids, phrases and neighbours against brute force, with nulls, ties, repeated rows, odd vectors and empty tables."""

import collections
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.llm import centroids, phrases, projections

VECTORS = "vec_id long, embedding array<double>, cluster string, leaf string, v string, n long"


def vectors(rng, n, dim=64, spread=0.3, centres=6):
    c = rng.normal(size=(centres, dim))
    return [(i, [float(x) for x in c[i % centres] + spread * rng.normal(size=dim)], "clash", "clash", "clash", 1) for i in range(n)]


def saved(spark, path, rows, schema=VECTORS, parts=3):
    spark.createDataFrame(rows, schema).repartition(parts).write.parquet(f"{path}/embeddings.parquet")
    return str(path)


def brute_clusters(rows):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) and abs(x) < 2**52 for x in v)]
    key = lambda r: (1,) if r[0] is None else (0, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest())
    at = [list(v) for _, v in sorted(kept, key=lambda r: (key(r), r[1]))[:8]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    near = lambda v: min((far(v, c), k) for k, c in enumerate(at))
    for _ in range(10):
        own = [near(v)[1] for _, v in kept]
        for k in range(len(at)):
            mine = [v for (_, v), o in zip(kept, own) if o == k]
            if mine:
                at[k] = [sum(x) // len(mine) for x in zip(*mine)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    inertia = collections.Counter()
    for _, k, d in found:
        inertia[k] += d
    short = lambda x: x if x < 2**63 else None
    return sorted(((i, k, short(d), short(inertia[k]), short(sum(inertia.values())), hashlib.sha256(",".join(map(str, at[k])).encode()).hexdigest()) for i, k, d in found), key=str)


@pytest.mark.parametrize("case", ["clusters", "ties", "huge", "few"])
def test_sort_means_equals_brute_force(spark, tmp_path, case):
    rng = np.random.default_rng(3)
    rows = vectors(rng, 150 if case == "clusters" else 60)
    if case == "ties":  # corners of a cube, many times
        rows = [(i, [float((i >> b) & 1) for b in range(64)], *r[2:]) for i, r in enumerate(rows)] + [(i % 7, [0.5] * 64, *r[2:]) for i, r in enumerate(rows)]
    if case == "huge":
        rows += [(900 + i, [float(x) * 10.0 ** (3 * i) for x in rng.normal(size=64)], "", "", "", 1) for i in range(6)]
    if case == "few":
        rows = rows[:5]
    odd = [(1001, None), (1002, []), (1003, [1.0] * 63), (1004, [1.0] * 65), (1005, [None] + [1.0] * 63), (1006, [math.nan] + [1.0] * 63), (1007, [math.inf] * 64), (1008, [1e300] * 64), (None, [0.25] * 64)]
    rows += [(i, v, None, None, None, None) for i, v in odd] + rows[:3]
    out = centroids.op11_sort_means(spark, saved(spark, tmp_path, rows)).collect()
    assert sorted(map(tuple, out), key=str) == brute_clusters([r[:2] for r in rows])


def test_sort_means_skips_only_what_is_farther():
    rng = np.random.default_rng(1)
    for _ in range(30):
        x, c = rng.integers(-4, 5, (200, 3)), rng.integers(-4, 5, (9, 3))
        far = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        both = centroids.exact(np.concatenate([x, c]))
        cluster, best = centroids.assign(both[:200], rng.integers(0, 9, 200).astype(np.int32), both[200:])
        assert (cluster == far.argmin(axis=1)).all() and (best == far.min(axis=1)).all()


def test_no_vectors(spark, tmp_path):
    d = saved(spark, tmp_path, [(1, None, None, None, None, 1)])
    assert centroids.op11_sort_means(spark, d).count() == 0 == projections.op13_neighbours(spark, d).count()
    d = saved(spark, tmp_path / "none", [])
    assert centroids.op11_sort_means(spark, d).count() == 0 == projections.op13_neighbours(spark, d).count()


def brute_phrases(rows, max_n, least, covered, top):
    counts = collections.defaultdict(collections.Counter)
    for lang, text in rows:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for b in ".,;:!?\n\x0b\x0c\r":
            text = text.replace(b, "\n")
        for piece in text.split("\n"):
            words = [w for w in piece.replace("\t", " ").split(" ") if w]
            for n in range(1, max_n + 1):
                counts["und" if lang is None else lang].update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, f in counts.items():
        total = sum(n for p, n in f.items() if len(p) == 1)
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in found.items():
            score, _, l, r = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))  # noqa: E741
            if not any(len(q) > len(p) and 100 * b >= covered * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in found.items()):
                rows.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, total, -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top])]
    return sorted(out)


@pytest.mark.parametrize("max_n,least,top,flush,known", [(3, 3, 2000, 1 << 21, 1 << 19), (3, 2, 7, 50, 1 << 19), (3, 2, 2000, 50, 5), (2, 2, 2000, 50, 0), (4, 2, 2000, 300, 1 << 19), (4, 2, 2000, 300, 3), (5, 3, 2000, 300, 9)])
def test_phrases_equal_brute_force(spark, monkeypatch, max_n, least, top, flush, known):
    monkeypatch.setattr(phrases, "FLUSH_WORDS", flush)
    monkeypatch.setattr(phrases, "DICTIONARY", known)
    rng = random.Random(5)
    words = ["the", "The", "of", "a", "é", "É", "red", "hot", " ", "x\x1cy", "new", "york", "\U0001f600", "--"]
    ends = [" ", " ", " ", " ", "  ", "\t", ", ", ". ", "\n", "?!", "\x0b", "\r\n"]
    text = lambda n: "".join(rng.choice(words) + rng.choice(ends) for _ in range(n))
    rows = [(rng.choice(["en", "fr", None, "und"]), text(rng.choice([0, 1, 2, 5, 40]))) for _ in range(60)]
    rows += [("en", None), (None, None), ("de", ""), ("en", " .. "), ("en", "the of " * 4000)] + rows[:9]
    df = spark.createDataFrame([(a, b, "clash", "clash", 1) for a, b in rows], "lang string, text string, phrase string, head string, n long").repartition(4)
    got = phrases.mined(df, max_n, least, 50, top).collect()
    assert sorted(map(tuple, got)) == brute_phrases(rows, max_n, least, 50, top)
    assert phrases.mined(df.limit(0)).count() == 0


def brute_neighbours(rows, k=5, every=50):
    kept = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, a in kept:
        if q % every == 0:
            best = {}
            for i, b in kept:
                if i != q and len(a) == len(b):
                    a_, b_ = a / np.abs(a).max(), b / np.abs(b).max()
                    s = float(a_ @ b_ / math.sqrt(a_ @ a_) / math.sqrt(b_ @ b_))
                    best[i] = max(best.get(i, -2), s)
            out.setdefault(q, {})
            for i, s in best.items():
                out[q][i] = max(out[q].get(i, -2), s)
    return {q: sorted(((-round(s, 12), i) for i, s in m.items()))[:k] for q, m in out.items()}


@pytest.mark.parametrize("spread,block", [(0.3, 10_000), (0.3, 100), (3.0, 70)])
def test_neighbours_against_brute_force(spark, spread, block):
    rng = np.random.default_rng(8)
    rows = [r[:2] for r in vectors(rng, 900, 16, spread)]
    rows += [(2000 + i, rows[50][1]) for i in range(300)] + [(3000 + i, [2.0 * x for x in rows[100][1]]) for i in range(20)] + rows[:40]
    rows += [(4000, None), (4050, []), (4100, [0.0] * 16), (4150, [None] * 16), (4200, [math.nan] * 16), (4250, [math.inf] + [0.0] * 15), (None, rows[0][1]), (4300, [1.0, 2.0]), (4301, [2.0, 1.0]), (4350, [7.0]), (4400, [1e300] * 16), (4450, [1e-300] * 16), (50, rows[3][1])]
    df = spark.createDataFrame([(i, v, "x", "x", "x", 1) for i, v in rows], VECTORS).repartition(4)
    got = collections.defaultdict(list)
    for r in projections.nearest(df, F.col("vec_id") % 50 == 0, 5, block=block).orderBy("query_id", "rank").collect():
        assert r["rank"] == len(got[r.query_id]) + 1
        got[r.query_id].append((-round(r.score, 12), r.vec_id))
    want = brute_neighbours(rows)
    want = {q: x for q, x in want.items() if x}
    assert got.keys() == want.keys()
    hit = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hit >= 0.97 * sum(map(len, want.values()))
    assert all(len(got[q]) == len(want[q]) for q in want)
    exact = {(q, i): s for q, x in brute_neighbours(rows, 10**6).items() for s, i in x}
    assert all(abs(exact[q, i] - s) < 1e-11 for q, x in got.items() for s, i in x)


def test_chi_square_quantile():
    assert abs(projections.stopping_ratio(8, 0.99) - 20.0902) < 1e-3
    draws = np.random.default_rng(0).normal(size=(20000, 8))
    assert abs(((draws**2).sum(axis=1) < projections.stopping_ratio(8, 0.9)).mean() - 0.9) < 0.01
