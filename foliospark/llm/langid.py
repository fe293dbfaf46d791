"""Language identification: a linear-chain conditional random field over a text's words.

A word's features are its prefixes and suffixes, letter bigrams and trigrams, and itself if it is in the lexicon of
words that the training sample repeats; they are hashed into a fixed table. Transitions between languages are learned
too: training sequences are made of runs of words from several documents, so texts that switch are seen. Weights are
found by adaptive gradient steps on the exact gradient, which forward-backward gives.

Learning uses a bounded sample of the labelled documents: about TRAIN_DOCS / languages of each language, those of lowest
hash, and of each a passage of at most TRAIN_CHARS characters at a place drawn by its hash. So it fits the driver
whatever the corpus, and no language is lost for being rare; beyond TRAIN_DOCS languages the most frequent are learned.
Every document is then labelled, whole: forward-backward gives each word its probabilities, and the language with the
largest expected number of words wins; ``score`` is its share. A long text is cut into chunks whose transfer matrices
are multiplied, which gives the same result as one long pass.

Defined results: null texts and texts without a letter are ``und`` with score 0; without labelled documents all texts
are; equal rows get equal results; of equal sums the language first in order wins; an empty table gives no rows;
further columns are ignored, whatever their names; a null doc_id is not held out and not learned from; texts may be of
any length.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import batches, small_batches, table

TRAIN_DOCS, TRAIN_CHARS = 1200, 4000
TABLE, LEXICON_LEAST, STEPS, SEQUENCES, LENGTH, RATE, DECAY = 1 << 17, 5, 160, 48, 64, 0.5, 1e-5
CHUNK, WORDS_AT_ONCE, REMEMBERED = 512, 400_000, 200_000
#: Factors of the features' hashes, one for each kind: prefixes, suffixes, n-grams, whole words.
KINDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
FOLDS, HELD_OUT = 3, 1

letters = re.compile(r"[^\W\d_]+").findall


def words(text: str | None) -> list[str]:
    return [w for w in letters(text.lower()) if w.isalpha() or any(map(str.isalpha, w))] if text else []


def mixed(h: np.ndarray, kind: int) -> np.ndarray:
    h = (h ^ h >> np.uint64(31)) * KINDS[kind]
    return (h ^ h >> np.uint64(29)).astype(np.int64) & (TABLE - 1)


def features(words: list[str], lexicon: frozenset[str]) -> tuple[np.ndarray, np.ndarray]:
    """Table places of the features of several words, and the word each belongs to: prefixes of 1 to 3 characters,
    suffixes of 1 to 4, all runs of 2 and 3 with the word's ends marked, and the word itself if the lexicon has it."""
    framed = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    begin = np.concatenate([[0], np.cumsum(sizes + 2)[:-1]]).astype(np.int64)  # of the mark before a word
    base, own = np.uint64(0x100000001B3), np.arange(len(words))
    places, owners = [], []

    def add(at: np.ndarray, n: int, kind: int, owner: np.ndarray) -> None:
        h = np.full(len(at), n, np.uint64)
        for k in range(n):
            h = h * base + framed[at + k]
        places.append(mixed(h, kind))
        owners.append(owner)

    for n in (1, 2, 3, 4):
        long_enough = sizes >= n
        at = begin[long_enough] + 1
        if n < 4:
            add(at, n, 0, own[long_enough])
        add(at + sizes[long_enough] - n, n, 1, own[long_enough])
    owner = np.repeat(own, sizes + 2)
    left = np.repeat(begin + sizes + 2, sizes + 2) - np.arange(len(framed))  # characters from here to the end mark
    for n in (2, 3):
        at = np.flatnonzero(left >= n)
        add(at, n, 2, owner[at])
    known = np.array([k for k, w in enumerate(words) if w in lexicon], np.int64)
    if len(known):
        # polynomial hash of whole words: running sums within each word
        h = np.zeros(len(known), np.uint64)
        for step in range(int(sizes[known].max())):
            on = sizes[known] > step
            h[on] = h[on] * base + framed[begin[known[on]] + 1 + step]
        places.append(mixed(h, 3))
        owners.append(known)
    return np.concatenate(places), np.concatenate(owners)


def summed(weights: np.ndarray, places: np.ndarray, owners: np.ndarray, n: int) -> np.ndarray:
    """The weights of each owner's places, added up."""
    return np.stack([np.bincount(owners, weights[places, y], n) for y in range(weights.shape[1])], axis=1)


def marginals(e: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sequences (n, length, labels) of exp emissions: word marginals, and expected transitions summed over all."""
    n, length, k = e.shape
    alpha, now = np.empty_like(e), np.full((n, k), 1 / k)
    for t in range(length):
        now = (now @ a) * e[:, t]
        now /= now.sum(axis=1, keepdims=True)
        alpha[:, t] = now
    moved, beta, out = np.zeros((k, k)), np.ones((n, k)), np.empty_like(e)
    for t in range(length - 1, -1, -1):
        p = alpha[:, t] * beta
        out[:, t] = p / p.sum(axis=1, keepdims=True)
        right = e[:, t] * beta
        before = alpha[:, t - 1] if t else np.full((n, k), 1 / k)
        pair = before[:, :, None] * a[None] * right[:, None, :]
        moved += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        beta = right @ a.T
        beta /= beta.sum(axis=1, keepdims=True)
    return out, moved


def sampled(docs: DataFrame) -> list:
    """(text, lang) of the bounded sample: hashes first, without reading a text, then the passages of those chosen."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS
    usable = docs.where((fold != HELD_OUT) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    usable = usable.withColumn("draw", F.pmod(F.xxhash64(F.col("doc_id")), F.lit(1 << 40)) / (1 << 40))
    sizes = usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(TRAIN_DOCS).collect()
    if not sizes:
        return []
    quota = max(TRAIN_DOCS // len(sizes), 1)
    # the draw is even, so one in n / quota has a draw below quota / n; half as many again, and some, leave none short
    limits = docs.sparkSession.createDataFrame([(r.lang, min(1.0, (1.5 * quota + 8) / r.n)) for r in sizes], "lang string, below double")
    chars = F.length("text")
    start = 1 + F.floor(F.pmod(F.xxhash64("doc_id", "lang"), F.lit(1 << 20)) / (1 << 20) * F.greatest(chars - TRAIN_CHARS + 1, F.lit(1)))
    passage = F.substr("text", start.cast("int"), F.lit(TRAIN_CHARS)).alias("text")
    rows = usable.join(F.broadcast(limits), "lang").where("draw < below").select(passage, "lang", "draw")  # limits: at most TRAIN_DOCS rows
    place = F.row_number().over(W.partitionBy("lang").orderBy("draw", "text"))
    rows = rows.withColumn("place", place).where(F.col("place") <= quota).collect()  # also where one doc_id has very many rows
    out, taken = [], Counter()
    for r in sorted(rows, key=lambda r: (r.draw, r.text, r.lang)):
        if taken[r.lang] < quota:
            taken[r.lang] += 1
            out.append(r)
    return out


def train(docs: DataFrame) -> dict | None:
    """Weights from a bounded sample of the labelled documents that aren't held out."""
    rows = sampled(docs)
    texts = [(w, r.lang) for r in rows if len(w := words(r.text)) >= 4]
    if not texts:
        return None
    langs = sorted({lang for _, lang in texts})
    counts = Counter(x for w, _ in texts for x in w)
    lexicon = frozenset(x for x, n in counts.items() if n >= LEXICON_LEAST)
    by_lang = [[w for w, lang in texts if lang == x] for x in langs]
    k, rng = len(langs), random.Random(7)
    vocabulary = list(counts)
    number = {w: i for i, w in enumerate(vocabulary)}
    places, owners = features(vocabulary, lexicon)
    order = np.argsort(owners, kind="stable")
    places, n_places = places[order], np.bincount(owners, minlength=len(vocabulary))
    ends = np.cumsum(n_places)
    weights, trans = np.zeros((TABLE, k)), np.zeros((k, k))
    seen_w, seen_t = np.full((TABLE, k), 1e-3), np.full((k, k), 1e-3)
    for _ in range(STEPS):
        ids, gold = [], np.zeros((SEQUENCES, LENGTH), np.int64)
        for s in range(SEQUENCES):
            at = 0
            while at < LENGTH:
                y = rng.randrange(k)
                source = rng.choice(by_lang[y])
                n = min(rng.choice((6, 12, 24, 64)), LENGTH - at, len(source))
                first = rng.randrange(len(source) - n + 1)
                ids += map(number.__getitem__, source[first : first + n])
                gold[s, at : at + n] = y
                at += n
        sizes = n_places[ids]
        flat = places[np.repeat(ends[ids] - np.cumsum(sizes), sizes) + np.arange(sizes.sum())]
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        scores = np.add.reduceat(weights[flat], starts, axis=0).reshape(SEQUENCES, LENGTH, k)
        p, moved = marginals(np.exp(scores - scores.max(axis=2, keepdims=True)), np.exp(trans))
        wrong = p
        np.put_along_axis(wrong, gold[..., None], np.take_along_axis(wrong, gold[..., None], 2) - 1, 2)
        spread = np.repeat(wrong.reshape(-1, k), sizes, axis=0)
        own, where = np.unique(flat, return_inverse=True)
        grad = np.stack([np.bincount(where, spread[:, y]) for y in range(k)], axis=1) / SEQUENCES + DECAY * weights[own]
        seen_w[own] += grad**2
        weights[own] -= RATE * grad / np.sqrt(seen_w[own])
        real = np.zeros((k, k))
        np.add.at(real, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1)
        np.add.at(real, (slice(None), gold[:, 0]), 1 / k)
        grad = (moved - real) / SEQUENCES
        seen_t += grad**2
        trans -= RATE * grad / np.sqrt(seen_t)
    return {"langs": langs, "lexicon": lexicon, "weights": weights.astype(np.float32), "transitions": trans}


def expected(e: np.ndarray, lengths: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Expected words of each label in each of several texts; e: exp emissions of all their words in a row."""
    k, n_docs = e.shape[1], len(lengths)
    chunks = -(-lengths // CHUNK)
    first = np.concatenate([[0], np.cumsum(chunks)[:-1]])
    lanes = int(chunks.sum())
    lane = np.repeat(np.arange(n_docs), chunks)
    number = np.arange(lanes) - first[lane]
    size = np.minimum(lengths[lane] - number * CHUNK, CHUNK)
    begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])[lane] + number * CHUNK
    # lanes in order of size, so that those still going at a step are the first ones
    order = np.argsort(-size, kind="stable")
    place = np.empty(lanes, np.int64)
    place[order] = np.arange(lanes)
    size, begin = size[order], begin[order]
    going = np.searchsorted(-size, -np.arange(CHUNK), "left")  # lanes longer than each step
    steps = int(size.max())
    enter, leave = np.full((lanes, k), 1 / k), np.ones((lanes, k))
    if lanes > n_docs:
        parts = np.flatnonzero((chunks > 1)[lane[order]])  # lanes of texts of several chunks, longest first
        whole = np.broadcast_to(np.eye(k), (len(parts), k, k)).copy()
        for t in range(steps):
            n = int(np.searchsorted(-size[parts], -t, "left"))
            step = (whole[:n].reshape(-1, k) @ a).reshape(-1, k, k) * e[begin[parts[:n]] + t, None, :]
            whole[:n] = step / step.max(axis=(1, 2), keepdims=True)
        at_part = np.full(lanes, -1)
        at_part[parts] = np.arange(len(parts))
        for c in range(int(chunks.max()) - 1):
            at = place[first[chunks > c + 1] + c]
            on = np.einsum("nk,nkl->nl", enter[at], whole[at_part[at]])
            enter[place[first[chunks > c + 1] + c + 1]] = on / on.sum(axis=1, keepdims=True)
        for c in range(int(chunks.max()) - 1, 0, -1):
            at = place[first[chunks > c] + c]
            back = np.einsum("nkl,nl->nk", whole[at_part[at]], leave[at])
            leave[place[first[chunks > c] + c - 1]] = back / back.sum(axis=1, keepdims=True)
    alpha, now = [], enter
    for t in range(steps):
        n = going[t]
        now = (now[:n] @ a) * e[begin[:n] + t]
        now /= now.sum(axis=1, keepdims=True)
        alpha.append(now)
    beta, total = leave.copy(), np.zeros((lanes, k))
    for t in range(steps - 1, -1, -1):
        n = going[t]
        p = alpha[t] * beta[:n]
        total[:n] += p / p.sum(axis=1, keepdims=True)
        new = (e[begin[:n] + t] * beta[:n]) @ a.T
        beta[:n] = new / new.sum(axis=1, keepdims=True)
    return np.add.reduceat(total[place], first, axis=0)


class Labeller:
    """Predictions of one worker, which remembers the emissions of words it has met, within a bound."""

    def __init__(self, model: dict):
        self.model, self.moves = model, np.exp(model["transitions"])
        self.forget()

    def forget(self) -> None:
        self.known, self.scores = {}, np.zeros((0, len(self.model["langs"])))

    def predict(self, texts: list[list[str]]) -> list[tuple[str, float]]:
        """Language and score of texts that have words."""
        if len(self.known) > REMEMBERED:
            self.forget()
        new = list(set(chain.from_iterable(texts)).difference(self.known))
        if new:
            self.known |= zip(new, range(len(self.known), len(self.known) + len(new)), strict=True)
            self.scores = np.concatenate([self.scores, summed(self.model["weights"], *features(new, self.model["lexicon"]), len(new))])
        ids = np.fromiter(map(self.known.__getitem__, chain.from_iterable(texts)), np.int64)
        scores = self.scores[ids]
        lengths = np.array([len(t) for t in texts])
        shares = expected(np.exp(scores - scores.max(axis=1, keepdims=True)), lengths, self.moves) / lengths[:, None]
        best = shares.argmax(axis=1)
        return [(self.model["langs"][b], float(min(max(s[b], 0.0), 1.0))) for b, s in zip(best, shares, strict=True)]


def labelled(docs: DataFrame, model: dict | None) -> DataFrame:
    """(doc_id, lang_pred, score) of every document."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value) if shared.value else None
        for batch in batches(it):
            found: list[tuple[str, float]] = [("und", 0.0)] * batch.num_rows
            held: list[tuple[int, list[str]]] = []
            size = 0

            def flush() -> None:
                nonlocal held, size
                if held:
                    for (row, _), got in zip(held, labeller.predict([w for _, w in held]), strict=True):
                        found[row] = got
                held, size = [], 0

            for row, text in enumerate(batch.column(1)):
                own = words(text.as_py()) if labeller else []
                if own:
                    held.append((row, own))
                    size += len(own)
                if size >= WORDS_AT_ONCE:
                    flush()
            flush()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))
    return labelled(docs, train(docs)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
