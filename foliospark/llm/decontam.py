"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, looked up for every window of a document.

Native: only DataFrame functions, and one path for a benchmark of any size.

1. A window of n words holds a gram of q = ceil(n / 2) words at one of any n - q + 1 places in a row. So the set has the
   hashes of all grams of the benchmark's windows, and of a document every (n - q + 1)-th gram is looked up: for windows of
   13 words, seven words at every seventh place. No window is missed.
2. The set is broadcast in blocks of at most SET_ROWS hashes, a bound that is counted, and each block takes one reading of
   the documents, whose windows are never shuffled. Only the few places that are in the set go on, by text key.
3. They are verified: the windows around these places are joined with the benchmark's by all their words, which also
   gives the items.
4. Verified hits, gathered by text key, are joined back to the documents.

The text key is the SHA-256 of the text, so copies of a text are looked at once and get equal results.

Defined results: null and empty texts have no words; an item of fewer words than WINDOW, but not none, is one window
of its own length; an item without words is never found; repeated items with one item_id count once, repeated documents
get equal rows; an item with a null item_id hits words but isn't among the items found; very long texts are taken whole;
an empty benchmark finds nothing; an empty table gives no rows; further columns, whatever their names, are ignored, or
kept by ``clean`` and ``without_spans``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, table

WINDOW = 13
#: Least share of hit words, one in SHARE, at which a document is contaminated.
SHARE = 20
#: Hashes of a broadcast block, some 50 MB at most.
SET_ROWS = 1_000_000
#: Text keys, or hits and items, up to which a table of theirs, below 100 bytes each, is broadcast; beyond, documents and
#: it are shuffled by key and one of SALTS salts, so that no task gets all copies of a text.
KEY_ROWS, SALTS = 200_000, 32
HITS = "array<struct<i:int,n:int>>"
PLACES = "array<struct<i:int,n:int,h:bigint>>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words of a text with A-Z lower-cased; other letters keep their case.

    lower() is fast and does the same to a text without other upper-case letters; translate() serves the rest.
    """
    ascii_only = F.octet_length(text) == F.length(text)
    others = text.rlike(r"[[^\x00-\x7F]&&[\p{IsUppercase}\p{Lt}]]")
    plain = F.when(ascii_only, F.lower(text)).when(others, F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))
    return F.array_remove(F.split(F.coalesce(plain, F.lit("")), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def taken(tokens: Column, i: Column, n: Column) -> Column:
    """n words from the i-th on, element by element, since slice() copies the whole array each time."""
    return F.transform(F.sequence(i, i + n - 1), lambda k: F.get(tokens, k - 1))


def gram_words(n: int) -> int:
    return -(-n // 2)


def grams(tokens: Column, n: int, step: int) -> Column:
    """array<struct<i, n, h>>: hash of the gram at every step-th word of a text that has a window of n words."""
    q = gram_words(n)
    starts = F.sequence(F.lit(1), F.size(tokens) - (q - 1), F.lit(step))
    each = F.transform(starts, lambda i: F.struct(i.alias("i"), F.lit(n).alias("n"), F.xxhash64(*(F.get(tokens, i + (k - 1)) for k in range(q))).alias("h")))
    return F.when(F.size(tokens) >= n, each).otherwise(F.expr(f"cast(array() as {PLACES})"))


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """(item_id, w, n) of items with words."""
    items = benchmark.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0).distinct()
    return items.withColumn("n", F.least(F.size("w"), F.lit(WINDOW)))


def benchmark_windows(items: DataFrame) -> DataFrame:
    """Distinct (item_id, n, win), the window's words joined by blanks, which no word holds."""
    starts = F.sequence(F.lit(1), F.size("w") - F.col("n") + 1)
    return items.select("item_id", "n", F.explode(F.transform(starts, lambda i: F.array_join(taken(F.col("w"), i, F.col("n")), " "))).alias("win")).distinct()


def covered(hits: Column) -> Column:
    """Words inside any window; hits by start."""
    end = F.aggregate(hits, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), lambda a, x: F.struct(F.greatest(a["end"], x["i"] + x["n"] - 1).alias("end"), (a["n"] + F.greatest(x["i"] + x["n"] - 1 - F.greatest(a["end"], x["i"] - 1), F.lit(0))).alias("n")))
    return end["n"].cast("long")


def looked_up(texts: DataFrame, items: DataFrame, set_rows: int) -> DataFrame:
    """Distinct (key, i, n) of the places of texts (key, text) whose gram's hash is in the benchmark's set."""
    sizes = sorted(r[0] for r in items.select("n").distinct().collect())  # at most WINDOW values
    if not sizes:
        return texts.select("key", F.lit(0).alias("i"), F.lit(0).alias("n")).limit(0)
    every_gram = F.concat(*(F.when(F.col("n") == n, grams(F.col("w"), n, 1)).otherwise(F.expr(f"cast(array() as {PLACES})")) for n in sizes))
    hashes = checkpointed(items.select(F.explode(every_gram).alias("x")).select("x.h").distinct())
    blocks = max(1, -(-hashes.count() // set_rows))
    tokens = texts.select("key", F.explode(F.array(words(F.col("text")))).alias("w"))  # worked out once a row
    places = tokens.select("key", F.explode(F.concat(*(grams(F.col("w"), n, n - gram_words(n) + 1) for n in sizes))).alias("x")).select("key", "x.*")
    found = [places.join(F.broadcast(hashes.where(F.pmod("h", F.lit(blocks)) == b)), "h", "left_semi") for b in range(blocks)]
    return reduce(DataFrame.unionByName, found).select("key", "i", "n").distinct()


def by_key(left: DataFrame, right: DataFrame, entries: int, how: str, key_rows: int) -> DataFrame:
    """Joins documents with a table of counted size by the text key."""
    if entries <= key_rows:
        return left.join(F.broadcast(right), "key", how)
    left = left.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    right = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(right, ["key", "salt"], how).drop("salt")


def verified(texts: DataFrame, places: DataFrame, windows: DataFrame, key_rows: int) -> DataFrame:
    """(key, hits, found) of texts in which the windows around some place are a benchmark's: starts and sizes, item ids."""
    by_text = places.groupBy("key").agg(F.collect_list(F.struct("i", "n")).alias("x"))  # at most one for each word and size
    keys = places.select("key").distinct()
    one = by_key(texts, keys, keys.count(), "left_semi", key_rows).groupBy("key").agg(F.first("text").alias("text"))
    at = one.join(by_text, "key").select("key", F.explode(F.array(words(F.col("text")))).alias("w"), "x")

    def around(x: Column) -> Column:
        n = x["n"]
        first = F.greatest(F.lit(1), x["i"] - (n - F.ceil(n / 2).cast("int")))
        last = F.least(x["i"], F.size("w") - n + 1)
        return F.when(first <= last, F.transform(F.sequence(first, last), lambda i: F.struct(i.alias("i"), n.alias("n")))).otherwise(F.expr(f"cast(array() as {HITS})"))

    starts = F.array_distinct(F.flatten(F.transform("x", around)))
    wins = F.transform(starts, lambda x: F.struct(x["i"].alias("i"), x["n"].alias("n"), F.array_join(taken(F.col("w"), x["i"], x["n"]), " ").alias("win")))
    true = at.select("key", F.explode(wins).alias("x")).select("key", "x.*").join(windows, ["n", "win"])
    return true.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("i", "n"))).alias("hits"), F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("found"))


def with_hits(docs: DataFrame, benchmark: DataFrame, set_rows: int = SET_ROWS, key_rows: int = KEY_ROWS) -> DataFrame:
    """(row, n_words, hits, found): each document as a struct, its number of words, starts and sizes of the windows that
    occur, and sorted ids of their items."""
    key = F.sha2(F.col("text"), 256).alias("key")
    items = checkpointed(benchmark_items(benchmark))
    windows = checkpointed(benchmark_windows(items))
    texts = docs.where(F.col("text").isNotNull()).select(key, "text")
    places = checkpointed(looked_up(texts, items, set_rows))
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), key, F.size(words(F.col("text"))).cast("long").alias("n_words"))
    true = checkpointed(verified(texts, places, windows, key_rows))
    entries = true.agg(F.sum(F.size("hits") + F.size("found") + 1)).first()[0] or 0
    out = by_key(whole, true, entries, "left", key_rows)
    return out.select("row", "n_words", F.coalesce("hits", F.expr(f"cast(array() as {HITS})")).alias("hits"), F.coalesce("found", F.expr("cast(array() as array<string>)")).alias("found"))


def contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (SHARE * n_hit >= n_words)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = with_hits(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    out = out.select("row.doc_id", "n_words", covered(F.col("hits")).alias("n_hit"), F.size("found").cast("long").alias("n_items"), F.sha2(F.array_join("found", ","), 256).alias("items_sha256"))
    return out.withColumn("contaminated", contaminated(F.col("n_hit"), F.col("n_words")))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents that aren't contaminated, with their own columns."""
    return with_hits(docs, benchmark).where(~contaminated(covered(F.col("hits")), F.col("n_words"))).select("row.*")


def without_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Every document, its words inside hit windows removed; a text with hits becomes its normalised words, blank-joined."""
    out = with_hits(docs, benchmark).withColumn("w", F.explode(F.array(words(F.col("row.text")))))
    hit = F.flatten(F.transform("hits", lambda x: F.sequence(x["i"], x["i"] + x["n"] - 1)))
    rest = F.transform(F.array_except(F.sequence(F.lit(1), F.size("w")), hit), lambda k: F.get("w", k - 1))
    text = F.when(F.size("hits") > 0, F.array_join(rest, " ")).otherwise(F.col("row.text"))
    return out.select(*(text.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, unnest(list_transform(range(1, len(w) - least(len(w), 13) + 2), lambda i: array_to_string(w[i:i + least(len(w), 13) - 1], ' '))) AS win FROM b WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM bw),
p AS (SELECT rid, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d JOIN sizes ON len(w) >= n),
dw AS (SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM p),
hits AS (SELECT rid, i, dw.n, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
pos AS (SELECT rid, count(DISTINCT j) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS j FROM hits) GROUP BY rid),
it AS (SELECT rid, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list_distinct(list(CAST(item_id AS VARCHAR)))), ',') AS ids FROM hits GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (rid) LEFT JOIN it USING (rid)
"""
