"""URLs: parts, rules and features against plain Python, and the trees on hosts they haven't seen."""

import math
import random
import re

from pyspark.sql import functions as F

from foliospark.llm import urls

SF = "/root/testdata/sf0.1"


def brute(url, rules):
    m = re.match(r"(?s)^.*?://(.*)$", url or "")
    rest = m[1] if m else ""
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in re.match(r"[^/?#]*", rest)[0])
    path = re.match(r"[^?#]*", rest[len(re.match(r"[^/?#]*", rest)[0]) :])[0]
    fits = [(len(s + p), s + p, v) for v, s, p in rules if (host == s or host.endswith("." + s)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_parts_and_rules_by_brute_force(spark):
    rng = random.Random(4)
    bits = ["http", "://", "www.", "example", ".com", ".COM", "net", "/en/", "/es/", "/fr/", "/", "?", "#", "a", ".", "=", "é", "\n", "com"]
    rows = ["".join(rng.choice(bits) for _ in range(rng.randrange(9))) for _ in range(600)] + ["https://" + "".join(rng.choice(bits) for _ in range(rng.randrange(9))) for _ in range(900)] + [None, "", "://", "x://net/es/", "https://a.example.com/en/" + "y" * 5000]
    df = spark.createDataFrame([*enumerate(rows)], "i int, url string")
    host, path = urls.parts(F.col("url"))
    out = df.select("i", host.alias("h"), path.alias("p")).withColumn("r", urls.ruled(F.col("h"), F.col("p"))).orderBy("i").collect()
    assert [(r.h, r.p, r.r and r.r.rule, r.r and r.r.verdict) for r in out] == [brute(u, urls.RULES) for u in rows]


def test_features_by_brute_force(spark):
    rows = ["http://a-b.c.de/x/y1?p=1&q=22#f", "", None, "http://h", "aaa", "http://é.com/é?"]
    df = spark.createDataFrame([*enumerate(rows)], "i int, url string")
    host, path = urls.parts(F.col("url"))
    out = urls.lexical(df.withColumns({"h": host, "p": path}), "url", "h", "p").orderBy("i").collect()
    for r, u in zip(out, rows):
        u = u or ""
        n = max(1, len(u))
        h, p, *_ = brute(u, ())
        entropy = -sum(u.count(c) / n * math.log2(u.count(c) / n) for c in set(u))
        want = (len(u), len([x for x in p.split("/") if x]), sum(c in "0123456789" for c in u) / n, entropy, u.rsplit("?", 1)[1].count("=") + 1 if "?" in u else 0, u.count("-"), h.count("."))
        got = [r[f"uf__{f}"] for f in urls.FEATURES[:7]]
        assert all(abs(a - b) < 1e-9 for a, b in zip(got, want)), (u, got, want)


def test_trees_on_unseen_hosts(spark):
    """Of the URLs that rules judge, a third of the hosts is held out; suffix rates and trees see the others alone."""
    host, path = urls.parts(F.col("url"))
    x = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", host.alias("host"), path.alias("path"))
    x = x.withColumn("r", urls.ruled(F.col("host"), F.col("path"))).where("r is not null").withColumn("blocked", (F.col("r.verdict") == "block").cast("int"))
    out = F.pmod(F.xxhash64("host"), F.lit(3)) == 0
    scored = urls.fit(x.where(~out).select("url", "blocked"))(urls.lexical(x.where(out), "url", "host", "path"))
    n, right, blocked = scored.agg(F.count("*"), F.avg((F.col("uf__blocked") == F.col("blocked")).cast("double")), F.avg("blocked")).first()
    print(f"{n} URLs of unseen hosts, {right:.4f} right, {blocked:.4f} blocked by rule")
    assert n > 100 and right >= max(blocked, 1 - blocked) - 0.02
