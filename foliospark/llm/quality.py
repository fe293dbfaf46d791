"""Quality rules: counts of a text, and the perplexity of its characters under a language's own n-gram model.

The model has order ORDER over characters: code points below 0x800 stand for themselves, those above share 2,048 places
by a hash. Spark counts every n-gram of every document; each task adds up its own first, so what is shuffled are
distinct n-grams. Probabilities follow interpolated modified Kneser-Ney: the highest order uses counts, lower orders the
number of distinct characters seen in front, and each order takes its discounts from its own counts of counts. Spark
works out an n-gram's share and its context's weight for the lower order in one window per order, whose groups are the
followers of one context, 4,096 at most. N-grams of order 3 and more met once only are left out and their share goes to
the lower order: so the model stays small, and a text isn't predicted by what only it contains.

A model is stored as arrays sorted by hash, that is by the n-gram's characters packed into 60 bits: Parquet files in the
shared folder, in order of language, kind and hash, which Spark ships to executors. A worker reads a language's part when
it first meets it and looks n-grams up by binary search. Nothing of it passes through the driver.

A document is rejected if its mean log perplexity, at full length or at the model's lowest order (LEVELS), lies outside
its language's band, median +- BAND_WIDTH robust deviations (1.4826 x median absolute deviation), from a histogram over
all documents of that language. Full length sees order of letters and words; the lowest sees odd characters, even of a
kind of junk so frequent that the longer contexts have learned it.

Defined results: a null text counts as empty; null or blank ``lang`` is a language of its own, named ''; an empty text
has no perplexity and fails the base rule; repeated rows are judged each for itself; texts may be of any length; an
empty table gives no rows. Columns beyond those used are ignored by ``op1_quality`` and kept by ``accepted``, whatever
their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import batches, materialised, shared_dir, shipped, small_batches, table, text_bytes

ORDER, BITS = 5, 12
CHARACTERS = 1 << BITS
#: Least count of an n-gram of order 3 and more; those of lower orders are all kept.
LEAST_COUNT = 2
#: Width of the histogram of log perplexities, in nats; half-width of a band in robust deviations, and its least value.
#: README.md has the measured rejection by width.
BIN, BAND_WIDTH, LEAST_DEVIATION = 0.002, 6.0, 0.02
LEVELS = (1, ORDER)
#: Characters a task gathers before it counts them; n-grams it holds before it passes them on; of a worker: n-grams of a
#: language whose probability it remembers, and languages it holds.
CHUNK, HELD, REMEMBERED, LANGS_HELD = 1 << 21, 3_000_000, 4_000_000, 8

WORD_BREAKS = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
LOGS = tuple(f"log_ppl_{k}" for k in LEVELS)
COUNTS = ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_words")


def codes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams that end at each character, and the texts' lengths. A text starts after ORDER - 1 spaces."""
    lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    pad = " " * (ORDER - 1)
    points = np.frombuffer((pad + pad.join(texts)).encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    points = np.where(points < 0x800, points, 0x800 + (points * 0x9E3779B1 >> 15 & 0x7FF))
    grams = np.zeros(len(points), np.int64)
    for back in range(ORDER):
        grams[back:] |= points[: len(points) - back] << BITS * back
    inside = np.ones(len(points), bool)
    starts = np.concatenate([[0], np.cumsum(lengths + ORDER - 1)[:-1]]).astype(np.int64)
    for k in range(ORDER - 1):
        inside[starts + k] = False
    return grams[inside], lengths


def added(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order, the counts of equal ones summed."""
    order = np.argsort(codes)
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
    return codes[first], np.add.reduceat(counts, first) if len(first) else counts


def count_ngrams(docs: DataFrame) -> DataFrame:
    """(lang_key, code, n) over every character of every document."""
    small_batches(docs.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, list[str]] = {}
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        size = 0

        def count() -> None:
            nonlocal size
            for lang, texts in waiting.items():
                codes, n = np.unique(codes_of(texts)[0], return_counts=True)
                held[lang] = added(np.concatenate([held[lang][0], codes]), np.concatenate([held[lang][1], n])) if lang in held else (codes, n)
            waiting.clear()
            size = 0

        def passed() -> Iterator[pa.RecordBatch]:
            for lang, (codes, n) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(n.astype(np.int64))], names=["lang_key", "code", "n"])
            held.clear()

        for batch in batches(it):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text:
                    waiting.setdefault(lang, []).append(text)
                    size += len(text)
                    if size >= CHUNK:
                        count()
                        if sum(len(c) for c, _ in held.values()) >= HELD:
                            yield from passed()
        count()
        yield from passed()

    keyed = docs.select(language_key().alias("lang_key"), "text")
    return keyed.mapInArrow(run, "lang_key string, code long, n long").groupBy("lang_key", "code").agg(F.sum("n").alias("n"))


def language_key() -> Column:
    """The primary part of a language tag in lower case ('en' of 'en-GB'); '' if null."""
    return F.lower(F.substring_index(F.trim(F.coalesce(F.col("lang"), F.lit(""))), "-", 1))


def shares(grams: DataFrame, order: int) -> DataFrame:
    """(lang_key, kind, code, value) of one order: kind 2 * order, an n-gram and its discounted share; kind 2 * order + 1,
    a context and the weight it leaves to the lower order."""
    seen = lambda k: F.greatest(F.count_if(F.col("n") == k), F.lit(1)).alias(f"n{k}")
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    discount = lambda k: F.least(F.greatest(k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}"), F.lit(0.05 * k)), F.lit(0.95 * k)).alias(f"d{k}")
    taken = materialised(grams.groupBy("lang_key").agg(*map(seen, (1, 2, 3, 4))).select("lang_key", *map(discount, (1, 2, 3))), "discounts")
    context = W.partitionBy("lang_key", "context")
    least = F.lit(LEAST_COUNT if order >= 3 else 1)
    d = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    share = F.when(F.col("n") >= least, (F.col("n") - d) / F.sum("n").over(context))
    rows = grams.withColumn("context", F.shiftright("code", BITS)).join(taken, "lang_key").withColumn("share", share)
    rows = rows.withColumn("left", 1 - F.sum("share").over(context)).withColumn("first", F.row_number().over(context.orderBy("code")) == 1)
    row = lambda kind, code, value: F.struct(F.lit(kind).alias("kind"), F.col(code).alias("code"), F.col(value).cast("float").alias("value"))
    both = F.array(F.when(F.col("share").isNotNull(), row(2 * order, "code", "share")), F.when(F.col("first") & F.col("left").isNotNull(), row(2 * order + 1, "context", "left")))
    return rows.select("lang_key", F.explode(F.filter(both, lambda x: x.isNotNull())).alias("x")).select("lang_key", "x.*")


def train(docs: DataFrame) -> list[str]:
    """Names of the model's files, shipped to all executors."""
    spark = docs.sparkSession
    grams, levels = materialised(count_ngrams(docs), "ngrams"), []
    for order in range(ORDER, 0, -1):
        levels.append(shares(grams, order))
        if order > 1:
            shorter = F.col("code").bitwiseAND(F.lit((1 << BITS * (order - 1)) - 1))
            grams = materialised(grams.groupBy("lang_key", shorter.alias("code")).agg(F.count("*").alias("n")), "ngrams")
    path = shared_dir(spark, "model")
    whole = reduce(DataFrame.union, levels)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    whole.repartitionByRange(parts, "lang_key", "kind", "code").sortWithinPartitions("lang_key", "kind", "code").write.parquet(path)
    return shipped(spark, path)


class Model:
    """One language's arrays: for each kind, hashes in order and their values."""

    def __init__(self, files: list[str], lang: str):
        rows = pa.concat_tables([pq.read_table(f, columns=["kind", "code", "value"], filters=[("lang_key", "=", lang)]) for f in files])
        kind, code, value = (rows.column(c).to_numpy() for c in ("kind", "code", "value"))
        order = np.lexsort((code, kind))
        kind, code, value = kind[order], code[order], value[order]
        cuts = np.searchsorted(kind, np.arange(2, 2 * ORDER + 3))
        self.of = {k: (code[a:b], value[a:b]) for k, a, b in zip(range(2, 2 * ORDER + 2), cuts, cuts[1:])}
        self.forget()

    def forget(self) -> None:
        self.known, self.logs = np.zeros(0, np.int64), np.zeros((len(LEVELS), 0))

    def value(self, kind: int, codes: np.ndarray, absent: float) -> np.ndarray:
        keys, values = self.of[kind]
        if not len(keys):
            return np.full(len(codes), absent)
        at = np.minimum(np.searchsorted(keys, codes), len(keys) - 1)
        return np.where(keys[at] == codes, values[at], absent)

    def log_probs(self, codes: np.ndarray) -> np.ndarray:
        """Log probability of the last character of each n-gram, a row for each of LEVELS."""
        p, out = np.full(len(codes), 1 / CHARACTERS), []
        for k in range(1, ORDER + 1):
            own = codes & (1 << BITS * k) - 1
            p = self.value(2 * k, own, 0.0) + self.value(2 * k + 1, own >> BITS, 1.0) * p
            if k in LEVELS:
                out.append(np.log(np.maximum(p, 1e-30)))
        return np.stack(out)

    def remembered(self, codes: np.ndarray) -> np.ndarray:
        """The same; distinct codes are worked out once while at most REMEMBERED of them are held."""
        distinct, where = np.unique(codes, return_inverse=True)
        if len(self.known) > REMEMBERED:
            self.forget()
        at = np.searchsorted(self.known, distinct)
        new = np.ones(len(distinct), bool)
        if len(self.known):
            new = self.known[np.minimum(at, len(self.known) - 1)] != distinct
        if new.any():
            self.known, self.logs = np.insert(self.known, at[new], distinct[new]), np.insert(self.logs, at[new], self.log_probs(distinct[new]), axis=1)
            at = np.searchsorted(self.known, distinct)
        return self.logs[:, at][:, where]


def repeated_words(ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each text, its words in 5-word windows found twice or more in it. ids: of the words of all texts in a row."""
    n_docs = len(lengths)
    if len(ids) < 5:
        return np.zeros(n_docs, np.int64)
    doc = np.repeat(np.arange(n_docs), lengths)
    m = len(ids) - 4
    mixed = doc[:m].astype(np.uint64)
    for k in range(5):
        mixed = (mixed ^ ids[k : k + m].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    whole = np.flatnonzero(doc[:m] == doc[4:])
    order = whole[np.argsort(mixed[whole], kind="stable")]
    a, b = order[:-1], order[1:]
    same = (mixed[a] == mixed[b]) & (doc[a] == doc[b])
    a, b = a[same], b[same]
    if not len(a):
        return np.zeros(n_docs, np.int64)
    true = np.ones(len(a), bool)
    for k in range(5):
        true &= ids[a + k] == ids[b + k]
    covered = np.zeros(len(ids) + 1, np.int64)
    hits = np.unique(np.concatenate([a[true], b[true]]))
    np.add.at(covered, hits, 1)
    np.add.at(covered, hits + 5, -1)
    return np.bincount(doc[np.cumsum(covered[:-1]) > 0], minlength=n_docs)


def base_counts(texts: list[str | None]) -> dict[str, np.ndarray]:
    """word_chars, n_symbols, n_dup_lines, n_repeat_words and n_words of each text."""
    ids_of: dict[bytes, int] = {}
    ids: list[int] = []
    lengths, chars, symbols, dups = [], [], [], []
    has_word = re.compile(rb"[^ \t\n\x0b\x0c\r]").search
    for text in texts:
        raw = text_bytes(text)
        words = raw.split()  # bytes split at exactly the six ASCII white spaces
        ids += [ids_of.setdefault(w, len(ids_of)) for w in words]
        lengths.append(len(words))
        chars.append(len(text or "") - (len(raw) - len(raw.translate(None, WORD_BREAKS))))
        symbols.append(len(raw) - len(raw.translate(None, SYMBOLS)))
        lines = [x for x in raw.split(b"\n") if has_word(x)]
        dups.append(len(lines) - len(set(lines)))
    lengths_ = np.array(lengths, np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths_)[:-1]]) if len(lengths_) else lengths_
    return {"word_chars": np.array(chars, np.int64), "n_symbols": np.array(symbols, np.int64), "n_dup_lines": np.array(dups, np.int64), "n_repeat_words": repeated_words(np.array(ids, np.int64), starts, lengths_).astype(np.int64), "n_words": lengths_}


def score(docs: DataFrame, model: list[str], keep: list[str]) -> DataFrame:
    """(doc, lang_key, counts..., LOGS...) of every document: ``doc`` is a struct of the columns ``keep``; LOGS are its mean
    log perplexities at each of LEVELS, null for an empty text."""
    small_batches(docs.sparkSession)
    picked = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("doc"), language_key().alias("lang_key"), "text")
    out = StructType([*picked.schema.fields[:2], *StructType.fromDDL(", ".join([*(f"{c} long" for c in COUNTS), *(f"{c} double" for c in LOGS)])).fields])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models: dict[str, Model] = {}
        for batch in batches(it):
            langs, texts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            counts, means = base_counts(texts), np.full((len(LEVELS), len(texts)), np.nan)
            for lang in set(langs):
                rows = [i for i, x in enumerate(langs) if x == lang and texts[i]]
                if not rows:
                    continue
                if lang not in models:
                    if len(models) >= LANGS_HELD:
                        models.clear()
                    models[lang] = Model([SparkFiles.get(f) for f in model], lang)
                codes, lengths = codes_of([texts[i] for i in rows])
                sums = np.add.reduceat(models[lang].remembered(codes), np.concatenate([[0], np.cumsum(lengths)[:-1]]), axis=1)
                means[:, rows] = -sums / lengths
            extra = [*(pa.array(counts[c], pa.int64()) for c in COUNTS), *(pa.array(m, pa.float64(), mask=np.isnan(m)) for m in means)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *extra], names=out.fieldNames())

    return picked.mapInArrow(run, out)


def bands(scored: DataFrame) -> DataFrame:
    """(lang_key, low_k, high_k for each level k) that bound a language's log perplexities, from a histogram of some
    thousand bins."""
    key = ["lang_key", "level"]
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("level"), F.col(c).alias("x")) for k, c in zip(LEVELS, LOGS)))).alias("v")
    bins = scored.select("lang_key", each).select("lang_key", "v.*").where(F.col("x").isNotNull()).groupBy(*key, F.floor(F.col("x") / BIN).alias("bin")).agg(F.count("*").alias("n"))
    bins = materialised(bins.select(*key, ((F.col("bin") + 0.5) * BIN).alias("x"), "n"), "bins")

    def median(rows: DataFrame, value: str, out: str) -> DataFrame:
        whole = W.partitionBy(*key)
        upto = F.sum("n").over(whole.orderBy(value).rowsBetween(W.unboundedPreceding, 0))
        return rows.withColumn("half", upto >= F.sum("n").over(whole) / 2).where("half").groupBy(*key).agg(F.min(value).alias(out))

    middle = median(bins, "x", "middle")
    off = bins.join(middle, key).withColumn("off", F.abs(F.col("x") - F.col("middle")))
    wide = BAND_WIDTH * F.greatest(1.4826 * F.col("spread"), F.lit(LEAST_DEVIATION))
    limits = middle.join(median(off, "off", "spread"), key).withColumn("wide", wide)
    of = lambda k, x: F.max(F.when(F.col("level") == k, x))
    ends = [f(k) for k in LEVELS for f in (lambda k: of(k, F.col("middle") - F.col("wide")).alias(f"low_{k}"), lambda k: of(k, F.col("middle") + F.col("wide")).alias(f"high_{k}"))]
    return limits.groupBy("lang_key").agg(*ends)


def judged(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Scores every document, saves the scores in the shared folder, and adds the limits, base_failed and kept."""
    scored = materialised(score(docs, train(docs), keep), "scores")
    out = scored.join(materialised(bands(scored), "bands"), "lang_key", "left")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    inside = reduce(Column.__and__, (F.coalesce(F.col(c).between(F.col(f"low_{k}"), F.col(f"high_{k}")), F.lit(False)) for k, c in zip(LEVELS, LOGS)))
    return out.withColumns({"base_failed": failed, "kept": ~failed & inside})


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), ["doc_id"])
    shown = [F.exp(c).alias(f"{name}_{k}") for k in LEVELS for c, name in ((f"log_ppl_{k}", "perplexity"), (f"low_{k}", "lower"), (f"high_{k}", "upper"))]
    return out.select("doc.doc_id", *("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"), *shown)


def accepted(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns."""
    return judged(docs, docs.columns).where("kept").select("doc.*")
