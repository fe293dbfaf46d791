"""Phrase collocation mining: n-grams exploded into rows, counted per language, scored in decimals, and cut by rank.

Words are never folded but for A-Z; null texts have none and a null language is ``und``. Pieces of a text without words,
empty texts and empty tables give no rows; repeated rows count again; a very long text is one row's work, as it is split
in one pass. Equal scores and counts go by the phrase's UTF-8 bytes. Extra columns don't matter.

Rows are counted before they are shuffled: a task turns up to FLUSH_WORDS words into the distinct windows of max_n words
(shorter at a piece's end) with their counts. They are dealt by language and a window's first max_n - 1 words, its head, so
windows and heads are summed in one shuffle. Words are counted first; the most frequent ones, DICTIONARY at most, are known to all
tasks and travel as numbers. Where these are all words that occur ``least`` times, the others end a window, as no frequent
phrase has them, and rows are numbers alone; else the others are spelled out. Both ways give the same rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import batches, materialised, shared_dir, shipped, small_batches, table, text_bytes

MAX_N, LEAST, COVERED, TOP, SCALE = 3, 10, 50, 2000, 1_000_000
#: Words that a task counts together, and words that have numbers of BITS bits: bounds on memory, not on what is counted.
FLUSH_WORDS, DICTIONARY, BITS = 1 << 19, 1 << 19, 20
#: Partitions of the windows for each one that Spark is set to: sums of windows take more memory than other rows.
FINER = 4
#: Bytes that end a piece, and the letters folded.
BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + BREAKS, b"abcdefghijklmnopqrstuvwxyz" + b"\xff" * len(BREAKS))  # no text in UTF-8 has 0xFF
END = b"\xff"

NUMBERS = pa.schema([("h", pa.int64()), ("t", pa.int64()), ("n", pa.int64())])
GRAMS = pa.schema([("lang", pa.string()), ("h", pa.int64()), ("head", pa.string()), ("t", pa.int64()), ("tail", pa.string()), ("n", pa.int64())])
DDL = {2: "h long, t long, n long", 5: "lang string, h long, head string, t long, tail string, n long"}


class Dictionary:
    """Numbers of the words of each language, from 1 on; 0 is none. ``last`` is larger than any."""

    def __init__(self, files: list[str], complete: bool):
        rows = pa.concat_tables([pq.read_table(SparkFiles.get(f), columns=["lang", "phrase", "id"]) for f in files])
        self.rows, self.of, self.complete, self.last = rows, {}, complete, rows.num_rows + 1

    def numbers(self, lang: str) -> dict[bytes, int]:
        if lang not in self.of:
            own = self.rows.filter(pc.equal(self.rows["lang"], lang))
            self.of[lang] = dict(zip(own["phrase"].cast(pa.binary()).to_pylist(), own["id"].to_pylist()))
        return self.of[lang]

    def words(self, lang: str) -> dict[int, bytes]:
        return {i: w for w, i in self.numbers(lang).items()}


def followed(ids: np.ndarray, max_n: int) -> list[np.ndarray]:
    """The numbers of each word and of the max_n - 1 after it, 0 from its piece's end on."""
    at = np.flatnonzero(ids)
    rows, on, padded = [ids[at]], np.ones(len(at), bool), np.concatenate([ids, np.zeros(max_n, np.int64)])
    for k in range(1, max_n):
        on = on & (padded[at + k] > 0)
        rows.append(np.where(on, padded[at + k], 0))
    return rows


def windows(words: list[bytes], max_n: int, known: Dictionary, lang: str) -> pa.RecordBatch:
    """The distinct windows of ``words``, in which END ends a piece, and their counts: a window of max_n words has its last
    one as t or tail, a shorter one at a piece's end has none. The others are in h, the first in its lowest bits, or head."""
    of, last, own = known.numbers(lang), known.last, {}
    if known.complete and max_n * BITS < 63:
        rows = followed(np.fromiter((of.get(w, 0) for w in words), np.int64, len(words)), max_n)
        code, n = np.unique(sum(r << BITS * k for k, r in enumerate(rows)), return_counts=True)
        tail = code >> BITS * (max_n - 1)
        return pa.RecordBatch.from_arrays([pa.array(code & (1 << BITS * (max_n - 1)) - 1), pa.array(tail, mask=tail == 0), pa.array(n, pa.int64())], schema=NUMBERS)
    ids = np.fromiter((of.get(w) or (0 if w == END or known.complete else last + own.setdefault(w, len(own))) for w in words), np.int64, len(words))
    rows = followed(ids, max_n)
    code = rows[0]
    for r in rows[1:]:  # equal prefixes get equal numbers, so a code stays far below 64 bits
        code = np.unique(code, return_inverse=True)[1] * (last + len(own)) + r
    _, first, n = np.unique(code, return_index=True, return_counts=True)
    rows, new, old = [r[first] for r in rows], list(own), known.words(lang)
    spell = lambda i: old[i] if i < last else new[i - last]

    def coded(parts: list[np.ndarray]) -> tuple[pa.Array, pa.Array]:
        spelled = np.any([p >= last for p in parts], axis=0) if len(parts) * BITS < 63 else np.ones(len(first), bool)
        number = sum(p << BITS * k for k, p in enumerate(parts) if k * BITS < 63)
        text: list[str | None] = [None] * len(first)
        for i in np.flatnonzero(spelled & (parts[0] > 0)).tolist():
            text[i] = b" ".join(spell(int(p[i])) for p in parts if p[i]).decode()
        return pa.array(number, pa.int64(), mask=spelled | (number == 0)), pa.array(text, pa.string())

    return pa.RecordBatch.from_arrays([pa.array([lang] * len(first), pa.string()), *coded(rows[:-1]), *coded(rows[-1:]), pa.array(n, pa.int64())], schema=GRAMS)


def split(text: str | None) -> list[bytes]:
    """The words of a text, END after each piece."""
    return [*text_bytes(text).translate(FOLD).replace(END, b" \xff ").split(), END]


def in_languages(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")


def counted_words(docs: DataFrame) -> DataFrame:
    """(lang, phrase, n) of all words; a task sends its counts once it holds FLUSH_WORDS words."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, counts in held.items():
                counts.pop(END, None)
                words = [w.decode() for w in counts]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), pa.array(words, pa.string()), pa.array([*counts.values()], pa.int64())], names=["lang", "phrase", "n"])
            held.clear()

        for b in batches(it):
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held.setdefault(lang, Counter()).update(split(text))
            if sum(map(len, held.values())) >= FLUSH_WORDS:
                yield from flush()
        yield from flush()

    rows = in_languages(docs).mapInArrow(run, "lang string, phrase string, n long")
    return rows.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def exploded(docs: DataFrame, max_n: int, files: list[str], complete: bool) -> DataFrame:
    """Each task's windows and their counts: (h, t, n), or (lang, h, head, t, tail, n) where words are spelled out."""
    short = complete and max_n * BITS < 63

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held = Dictionary(files, complete), {}

        def flush(lang: str) -> Iterator[pa.RecordBatch]:
            whole = windows(held.pop(lang), max_n, known, lang)
            yield from (whole.slice(k, 65536) for k in range(0, whole.num_rows, 65536))

        for b in batches(it):
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = held.setdefault(lang, [])
                words += split(text)
                if len(words) >= FLUSH_WORDS:
                    yield from flush(lang)
            if sum(map(len, held.values())) >= FLUSH_WORDS:
                for lang in list(held):
                    yield from flush(lang)
        for lang in list(held):
            yield from flush(lang)

    return in_languages(docs).mapInArrow(run, DDL[2 if short else 5])


def spelled(rows: DataFrame, dictionary: DataFrame, max_n: int) -> DataFrame:
    """(lang, phrase, n): numbers turned into their words. The dictionary has DICTIONARY rows at most, so it is broadcast."""
    out, places = rows, []
    words = F.broadcast(dictionary.select(F.col("id").alias("key"), F.col("phrase").alias("word"), F.col("lang").alias("of")))
    for k in range(max_n):
        code = F.col("t") if k == max_n - 1 else F.shiftright("h", BITS * k).bitwiseAND((1 << BITS) - 1) if k * BITS < 63 else F.lit(None).cast("long")
        out = out.withColumn("key", code).join(words, "key", "left").withColumnsRenamed({"word": f"w{k}", "of": f"of{k}"}).drop("key")
        places.append(f"w{k}")
    lang = F.coalesce("lang", "of0") if "lang" in rows.columns else F.col("of0")
    texts = ["head", *places[:-1], "tail", places[-1]] if "head" in rows.columns else places
    return out.select(lang.alias("lang"), F.concat_ws(" ", *texts).alias("phrase"), "n")


def with_size(phrases: DataFrame) -> DataFrame:
    return phrases.select("lang", "phrase", F.size(F.split("phrase", " ")).alias("words"), "n")


def counted(docs: DataFrame, max_n: int = MAX_N, least: int = LEAST) -> DataFrame:
    """(lang, phrase, words, n): all words, and the phrases of 2 to max_n words that occur ``least`` times or more."""
    spark = docs.sparkSession
    words = materialised(counted_words(docs), "words")
    frequent, path = words.where(F.col("n") >= least), shared_dir(spark, "dictionary")
    # the least count from which on there are DICTIONARY words at most; a row for each count that occurs
    upto = F.sum("c").over(W.orderBy(F.desc("n")).rowsBetween(W.unboundedPreceding, 0))
    sizes = frequent.groupBy("n").agg(F.count("*").alias("c")).withColumn("upto", upto)
    cut = sizes.where(F.col("upto") <= DICTIONARY).agg(F.min("n")).first()[0]
    best = frequent.where(F.col("n") >= cut) if cut is not None else frequent.limit(0)
    best.withColumn("id", F.row_number().over(W.orderBy(F.desc("n"), "lang", "phrase")).cast("long")).write.parquet(path)
    dictionary, files, complete = spark.read.parquet(path), shipped(spark, path), frequent.count() <= DICTIONARY
    dealt = exploded(docs, max_n, files, complete)
    left, right = [[c for c in cols if c in dealt.columns] for cols in (["lang", "h", "head"], ["t", "tail"])]
    dealt = dealt.repartition(FINER * int(spark.conf.get("spark.sql.shuffle.partitions")), *left)
    none = F.struct(*(F.lit(None).cast(dict(dealt.dtypes)[c]).alias(c) for c in right))
    shorter_one = reduce(Column.__and__, (F.col(c).isNull() for c in right))
    both = F.when(shorter_one, F.array(none)).otherwise(F.array(F.struct(*right), none))
    rows = dealt.select(*left, "n", F.explode(both).alias("x")).select(*left, "x.*", "n")
    here = rows.groupBy(*left, *right).agg(F.sum("n").alias("n"))  # all rows of a head lie together
    whole = with_size(spelled(here.where(F.col("n") >= least), dictionary, max_n)).where(F.col("words").between(max(2, max_n - 1), max_n))
    out = with_size(words).union(whole)
    if max_n > 3:  # prefixes shorter than a head
        heads = spelled(here.where(shorter_one), dictionary, max_n)
        each = heads.select("lang", "n", F.split("phrase", " ").alias("w")).where(F.size("w") > 1)
        sizes = F.sequence(F.lit(2), F.least(F.size("w"), F.lit(max_n - 2)))
        shorter = each.select("lang", F.explode(F.transform(sizes, lambda k: F.array_join(F.slice("w", 1, k), " "))).alias("phrase"), "n")
        out = out.union(with_size(shorter.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least)))
    return out


def decimal(x: Column) -> Column:
    return x.cast("decimal(16,0)")


def scored(counts: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, phrase, words, a, l, r, n, score) of all candidates, each by its lowest-scoring cut."""
    frequent = counts.where(F.col("n") >= least)
    parts = F.split("phrase", " ")
    piece = lambda a, n: F.array_join(F.slice(parts, a, n), " ")
    cuts = F.transform(F.sequence(F.lit(1), F.col("words") - 1), lambda k: F.struct(k.alias("k"), piece(F.lit(1), k).alias("first"), piece(k + 1, F.col("words") - k).alias("rest")))
    cut = frequent.where("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"), F.explode(cuts).alias("c")).select("lang", "phrase", "words", "a", "c.*")
    of = lambda name, count: frequent.select("lang", F.col("phrase").alias(name), F.col("n").alias(count))
    both = cut.join(of("first", "l"), ["lang", "first"]).join(of("rest", "r"), ["lang", "rest"])
    a, l, r = (decimal(F.col(c)) for c in "alr")  # noqa: E741
    both = both.withColumns({"x": a * a * F.lit(SCALE).cast("decimal(7,0)"), "y": l * r}).withColumn("score", F.expr("x div y"))
    best = both.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    total = counts.where("words = 1").groupBy("lang").agg(F.sum("n").alias("n"))
    return best.select("lang", "phrase", "words", "a", "b.l", "b.r", "b.score").join(F.broadcast(total), "lang")  # a row for each language


def without_parts(candidates: DataFrame, covered: int = COVERED) -> DataFrame:
    """Candidates that no candidate of one word more holds with ``covered`` percent of their count. A longer one still that
    does so holds one of these, which is as frequent."""
    words = F.split("phrase", " ")
    inner = F.array_distinct(F.array(F.array_join(F.slice(words, 1, F.col("words") - 1), " "), F.array_join(F.slice(words, 2, F.col("words") - 1), " ")))
    longer = candidates.where("words > 2").select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    kept = candidates.join(longer.where(F.col("most").isNotNull()), ["lang", "phrase"], "left")
    return kept.where(F.col("most").isNull() | (100 * F.col("most") < covered * F.col("a"))).drop("most")


def mined(docs: DataFrame, max_n: int = MAX_N, least: int = LEAST, covered: int = COVERED, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases."""
    counts = materialised(counted(docs, max_n, least), "phrases")
    left = without_parts(materialised(scored(counts, least), "candidates"), covered)
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mined(table(spark, sf_dir, "documents").select("lang", "text"))


ORACLE = f"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\n\\x0B\\x0C\\r]')) AS piece FROM documents),
w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^ \\t]+') AS w FROM p),
g AS MATERIALIZED (SELECT lang, k AS words, phrase, count(*) AS n FROM (SELECT lang, k, unnest([array_to_string(w[i:i + k - 1], ' ') FOR i IN range(1, len(w) - k + 2)]) AS phrase FROM w, (SELECT unnest(range(1, {MAX_N + 1})) AS k)) GROUP BY 1, 2, 3),
t AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM g WHERE words = 1 GROUP BY 1),
f AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS s FROM g WHERE n >= {LEAST}),
c AS (SELECT lang, phrase, words, n AS a, k, array_to_string(s[:k], ' ') AS first, array_to_string(s[k + 1:], ' ') AS rest FROM (SELECT *, unnest(range(1, words)) AS k FROM f WHERE words > 1)),
x AS (SELECT c.*, l.n AS l, r.n AS r, CAST((CAST({SCALE} AS HUGEINT) * a * a) // (CAST(l.n AS HUGEINT) * r.n) AS BIGINT) AS score FROM c JOIN f l ON l.lang = c.lang AND l.phrase = first JOIN f r ON r.lang = c.lang AND r.phrase = rest),
b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
u AS (SELECT lang, phrase, max(a) AS most FROM (SELECT lang, a, unnest([array_to_string(s[1:words - 1], ' '), array_to_string(s[2:words], ' ')]) AS phrase FROM (SELECT lang, words, n AS a, s FROM f WHERE words > 2)) GROUP BY 1, 2)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, t.n, score FROM b JOIN t ON t.lang = b.lang LEFT JOIN u ON u.lang = b.lang AND u.phrase = b.phrase WHERE most IS NULL OR 100 * most < {COVERED} * a QUALIFY rank <= {TOP}"""
