"""URL filters: rules by host and path, and gradient-boosted trees on lexical features for what no rule decides.

Native: DataFrame functions and Spark's own GBT trees. The trees learn from labelled URLs; the query takes those that
the rules judge. At most TRAIN_URLS distinct ones are used, those of lowest hash, which is a fair sample for any size
of table and bounds both training and the table of suffix statistics, so that table may be broadcast.

Features: length, path depth, share of digits, Shannon entropy of the characters, number of parameters, hyphens, labels
of the host, and the smoothed share of blocked training URLs with the host's last two labels, and with its last one.

Defined results: a URL that is null or has no '://' has an empty host and path, fits no rule, and is judged by the
trees; without labels of both kinds every URL no rule decides is allowed; repeated rows get equal results; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, table
from .decontam import LOWER, UPPER

RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
TRAIN_URLS, TREES, DEPTH, SMOOTHING = 20_000, 10, 3, 10.0
FEATURES = ("length", "depth", "digits", "entropy", "params", "hyphens", "labels", "suffix_rate", "tld_rate")


def parts(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path."""
    rest = F.when(url.contains("://"), F.regexp_extract(url, "(?s)^.*?://(.*)$", 1)).otherwise("")
    host = F.translate(F.regexp_extract(rest, "(?s)^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, "(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def ruled(host: Column, path: Column, rules=RULES) -> Column:
    """struct<rule, verdict> of the longest rule that fits; null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, suffix, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == suffix) | host.endswith("." + suffix)) & path.startswith(prefix)
        out = F.when(fits, F.struct(F.lit(suffix + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def lexical(df: DataFrame, url: str, host: str, path: str) -> DataFrame:
    """Adds the features that need the URL only, each named uf__..., and the host's suffixes."""
    u, h, p = F.coalesce(F.col(url), F.lit("")), F.col(host), F.col(path)
    n = F.greatest(F.length(u), F.lit(1))
    chars = F.array_distinct(F.array_remove(F.split(u, ""), ""))
    repeats = lambda c: (F.length(u) - F.length(F.replace(u, c, F.lit("")))).cast("double")
    entropy = F.log2(n) - F.aggregate(chars, F.lit(0.0), lambda a, c: a + repeats(c) * F.log2(repeats(c))) / n
    cols = {
        "length": F.length(u), "depth": F.size(F.array_remove(F.split(p, "/"), "")), "digits": F.regexp_count(u, F.lit("[0-9]")) / n, "entropy": entropy,
        "params": F.when(F.instr(u, "?") > 0, F.regexp_count(F.substring_index(u, "?", -1), F.lit("=")) + 1).otherwise(0), "hyphens": F.regexp_count(u, F.lit("-")), "labels": F.regexp_count(h, F.lit("[.]")),
    }
    return df.withColumns({f"uf__{k}": v.cast("double") for k, v in cols.items()} | {"uf__suffix": F.substring_index(h, ".", -2), "uf__tld": F.substring_index(h, ".", -1)})


def sample(labelled: DataFrame, bound: int = TRAIN_URLS) -> DataFrame:
    """At most ``bound`` distinct (url, blocked), those of lowest hash; urls with both labels count as blocked."""
    distinct = labelled.where(F.col("url").isNotNull()).groupBy("url").agg(F.max("blocked").alias("blocked"))
    return distinct.orderBy(F.xxhash64("url"), "url").limit(bound)


def rates(train: DataFrame, key: str, name: str) -> DataFrame:
    """Smoothed share of blocked URLs by suffix; as many rows as the sample has suffixes at most."""
    mean = train.agg(F.avg("blocked").alias("mean"))
    by = train.groupBy(key).agg(F.sum("blocked").alias("b"), F.count("*").alias("n"))
    prior = mean.first()["mean"] or 0.0
    return by.select(key, ((F.col("b") + SMOOTHING * prior) / (F.col("n") + SMOOTHING)).alias(name))


def fit(labelled: DataFrame):
    """A function that adds uf__blocked (1.0 or 0.0) to URLs with lexical features; learned from (url, blocked)."""
    host, path = parts(F.col("url"))
    train = checkpointed(lexical(sample(labelled).withColumns({"uf__host": host, "uf__path": path}), "url", "uf__host", "uf__path"))
    found = train.agg(F.count("*"), F.sum("blocked")).first()
    if not found[0] or found[1] in (0, found[0]):
        return lambda df: df.withColumn("uf__blocked", F.lit(0.0))
    by_suffix, by_tld = checkpointed(rates(train, "uf__suffix", "uf__suffix_rate")), checkpointed(rates(train, "uf__tld", "uf__tld_rate"))
    prior = found[1] / found[0]

    def assembled(df: DataFrame) -> DataFrame:
        out = df.join(F.broadcast(by_suffix), "uf__suffix", "left").join(F.broadcast(by_tld), "uf__tld", "left")
        out = out.fillna(prior, ["uf__suffix_rate", "uf__tld_rate"])
        return VectorAssembler(inputCols=[f"uf__{f}" for f in FEATURES], outputCol="uf__vector").transform(out)

    trees = GBTClassifier(featuresCol="uf__vector", labelCol="blocked", predictionCol="uf__blocked", maxIter=TREES, maxDepth=DEPTH, seed=42)
    model = trees.fit(assembled(train).select("uf__vector", F.col("blocked").cast("double").alias("blocked")).coalesce(4))
    return lambda df: model.transform(assembled(df))


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page."""
    host, path = parts(F.col("url"))
    split = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    split = split.withColumn("by_rule", ruled(F.col("host"), F.col("path"), rules))
    blocked = fit(split.where("by_rule is not null").select("url", (F.col("by_rule.verdict") == "block").cast("int").alias("blocked")))
    scored = blocked(lexical(split, "url", "host", "path"))
    by_trees = F.when(F.col("uf__blocked") > 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", F.col("by_rule.rule").alias("rule"), F.coalesce("by_rule.verdict", by_trees).alias("verdict"))


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages").select("page_id", "url"))
