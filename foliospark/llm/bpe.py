"""BPE encoding and decoding with a vocabulary file of the tokenizers library (word ends marked, lower case).

The frequent words of all documents are counted by Spark, encoded, and compiled into a minimal acyclic transducer: equal
suffixes share their states, and the numbers on a word's arcs add up to its place in the table of id sequences. The
file is put in the shared folder, shipped by Spark, and memory-mapped by each worker. A worker takes the words of a
batch that it hasn't met through the automaton together, one byte of each at a step; those the lexicon lacks are merged
exactly, by rank, also together, one merge of each at a step. It remembers words it has met, within a bound.

Text handling, as the file states: special tokens are found in the raw text; the rest is NFC-normalised, lower-cased
letter by letter, and cut into words by the file's pattern; white space is dropped; bytes stand for themselves under
the byte-level alphabet; decoding joins token strings with one space.

The driver receives at most LEXICON_WORDS words, whatever the corpus: a histogram of the counts, of some hundred rows,
gives the count from which on words are taken.

Defined results: a null or blank text has no tokens and decodes to the empty string; equal rows give equal results; an
empty table gives no rows; further columns are ignored, whatever their names; texts and words may be of any length (a
long word is merged by a heap). Words of equal count enter the lexicon all or none. Lone surrogates count as question
marks.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import batches, materialised, shared_dir, small_batches, table

VOCABULARY = "word_bpe_49k.json"
#: Words of the lexicon; distinct words a counting task holds before it passes them on; words a worker remembers.
LEXICON_WORDS, HELD, REMEMBERED = 1 << 16, 400_000, 400_000
#: Bits of an id in a packed pair; bytes beyond which a word is merged by a heap.
SHIFT = 20
MASK, LONG = (1 << SHIFT) - 1, 100
#: Rank of a pair that doesn't join.
NEVER = np.int32((1 << 31) - 1)


#: Cells of the table in which words are merged together; buckets of counts for each doubling, to find the lexicon's least.
CELLS, BUCKETS = 1 << 18, 16


def plain_text() -> re.Pattern:
    """Matches texts of ASCII and Latin letters up to U+024F whose lower case stays there: they are in NFC already, and
    Python's own regex engine cuts them as the file's pattern does, much faster."""
    latin = [chr(c) for c in range(0xC0, 0x250) if unicodedata.category(chr(c))[0] == "L" and len(chr(c).lower()) == 1 and ord(chr(c).lower()) < 0x250]
    return re.compile(r"[\t-\r\x20-\x7e" + "".join(latin) + "]*")


PLAIN = plain_text().fullmatch
PLAIN_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-\u024f]+|[0-9]|[^\sa-zß-öø-\u024f0-9]+").findall
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_alphabet() -> dict[int, str]:
    """The usual printable stand-in of each byte: itself if it is a visible Latin-1 character, else a letter from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


def newer_characters(content: str) -> dict[str, tuple[str, str]]:
    """Of characters that Python's Unicode tables lack and the regex module's have: lower case and class (L, N or S) that
    the tokenizers library gives them; its tables are of a version between."""
    from tokenizers import Tokenizer

    library, every = Tokenizer.from_str(content), "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
    pieces = lambda x: len(library.pre_tokenizer.pre_tokenize_str(x))
    newer = [c for c in regex.findall(r"\P{Cn}", every) if unicodedata.category(c) == "Cn"]
    return {c: (library.normalizer.normalize_str(c), "L" if pieces(f"a{c}a") == 1 else "N" if pieces(c + c) == 2 else "S") for c in newer}


def pattern_of(source: str, newer: dict[str, tuple[str, str]]) -> regex.Pattern:
    """The file's pattern, without the letters and digits that only the regex module knows."""
    for kind in "LN":
        wrong = [c for c in regex.findall(rf"\p{{{kind}}}", "".join(newer)) if newer[c][1] != kind]
        if wrong:
            source = source.replace(rf"\p{{{kind}}}", rf"[\p{{{kind}}}--[{''.join(wrong)}]]")
    return regex.compile(source, regex.V1)


class Vocabulary:
    """What encoding needs of a vocabulary file."""

    def __init__(self, content: str, newer: dict[str, tuple[str, str]]):
        spec = json.loads(content)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in self.ids.items()}
        self.decimal = {i: str(i) for i in self.tokens}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.end = model["end_of_word_suffix"]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        ids = model["vocab"]
        #: Two ids to the rank and the id of what they become, each pair packed into one number.
        self.joins = {ids[a] << SHIFT | ids[b]: rank << SHIFT | ids[a + b] for rank, (a, b) in enumerate(pairs)}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.find = pattern_of(split["pattern"]["Regex"], newer).findall
        self.lower_newer = {ord(c): low for c, (low, _) in newer.items() if low != c}
        self.plain = split["pattern"]["Regex"] == PATTERN
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        letters = byte_alphabet()
        self.inner, self.last = ({b: ids[c + end] for b, c in letters.items() if c + end in ids} for end in ("", self.end))
        # the same as arrays, to merge many words together: sorted pairs, their ranks, the ids by rank, and pairs of bytes
        self.inner_of, self.last_of = (np.array([t.get(b, 0) for b in range(256)], np.int32) for t in (self.inner, self.last))
        self.pairs = np.sort(np.fromiter(self.joins, np.int64, len(self.joins)))
        values = np.array([self.joins[k] for k in self.pairs.tolist()], np.int64)
        self.rank, self.become = (values >> SHIFT).astype(np.int32), (np.sort(values) & MASK).astype(np.int32)
        self.first = [self.joined(self.inner_of[:, None], right[None]) for right in (self.inner_of, self.last_of)]

    def words(self, text: str) -> Iterator[list[str] | int]:
        """Lists of words, and the ids of special tokens between them."""
        for piece in self.cut(text) if self.cut and any(s in text for s in self.special) else (text,):
            if piece in self.special:
                yield self.special[piece]
            elif self.plain and PLAIN(piece):
                yield PLAIN_WORDS(piece.lower())
            elif piece:
                plain = unicodedata.normalize("NFC", piece)
                plain = plain.lower() if "Σ" not in plain else "".join(c.lower() for c in plain)
                yield self.find(plain.translate(self.lower_newer))

    def joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of parts, NEVER where they don't join; a part of -1 is none."""
        key = left.astype(np.int64) << SHIFT | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where((self.pairs[at] == key) & (left >= 0) & (right >= 0), self.rank[at], NEVER)

    def merged(self, words: list[str]) -> list[list[int]]:
        """The ids of words, each by repeatedly merging its first pair of lowest rank."""
        raws = [w.encode("utf-8", "replace") for w in words]
        out: list = [None] * len(raws)
        order = sorted(range(len(raws)), key=lambda k: len(raws[k]))
        while order and len(raws[order[-1]]) > LONG:
            k = order.pop()
            out[k] = self.merged_by_heap([*map(self.inner.__getitem__, raws[k][:-1]), self.last[raws[k][-1]]])
        while order:
            size = max(1, CELLS // max(len(raws[order[-1]]), 1))
            some, order = order[-size:], order[:-size]
            for k, ids in zip(some, self.merged_together([raws[k] for k in some]), strict=True):
                out[k] = ids
        return out

    def merged_together(self, raws: list[bytes]) -> list[list[int]]:
        """The same for words of similar length: a row each, its parts on the left, and one merge of each row at a step."""
        lengths = np.fromiter(map(len, raws), np.int64, len(raws))
        flat = np.frombuffer(b"".join(raws), np.uint8)
        n, wide = len(raws), int(lengths.max())
        cols, lines = np.arange(wide + 1), np.arange(n)
        raw = np.zeros((n, wide), np.uint8)
        raw[cols[:-1] < lengths[:, None]] = flat
        parts = np.full((n, wide + 1), -1, np.int32)
        parts[:, :-1] = np.where(cols[:-1] < lengths[:, None] - 1, self.inner_of[raw], -1)
        parts[lines, lengths - 1] = self.last_of[raw[lines, lengths - 1]]
        ranks = np.full((n, wide + 1), NEVER, np.int32)
        ranks[:, : wide - 1] = np.where(cols[: wide - 1] < lengths[:, None] - 2, self.first[0][raw[:, :-1], raw[:, 1:]], NEVER)
        two = lengths > 1
        ranks[lines[two], lengths[two] - 2] = self.first[1][raw[lines[two], lengths[two] - 2], raw[lines[two], lengths[two] - 1]]
        row, out = lines, [None] * n
        while len(row):
            at = ranks.argmin(axis=1)
            rank = np.take_along_axis(ranks, at[:, None], 1)[:, 0]
            done = rank == NEVER
            if done.any():
                for k, ids in zip(row[done].tolist(), parts[done].tolist(), strict=True):
                    out[k] = ids[: ids.index(-1)]
                row, parts, ranks, at, rank = (x[~done] for x in (row, parts, ranks, at, rank))
                if not len(row):
                    break
            # each row loses a part, so the table loses a column
            here, lines = cols[: parts.shape[1] - 1] >= at[:, None], np.arange(len(row))
            parts, ranks = np.where(here, parts[:, 1:], parts[:, :-1]), np.where(here, ranks[:, 1:], ranks[:, :-1])
            parts[lines, at] = self.become[rank]
            ranks[lines, at] = NEVER
            more = at < parts.shape[1] - 1
            ranks[lines[more], at[more]] = self.joined(parts[lines[more], at[more]], parts[lines[more], at[more] + 1])
            more = at > 0
            ranks[lines[more], at[more] - 1] = self.joined(parts[lines[more], at[more] - 1], parts[lines[more], at[more]])
        return out

    def merged_by_heap(self, parts: list[int]) -> list[int]:
        """The same for a long word, in n log n steps: open pairs wait in a heap, and one that has changed is passed over."""
        n, join = len(parts), self.joins.get
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(v, k, parts[k], parts[k + 1]) for k in range(n - 1) if (v := join(parts[k] << SHIFT | parts[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            value, k, a, b = heapq.heappop(heap)
            j = after[k]
            if parts[k] != a or j < 0 or parts[j] != b:
                continue
            parts[k], parts[j], after[k] = value & MASK, -1, after[j]
            if after[k] >= 0:
                before[after[k]] = k
            for x, y in ((before[k], k), (k, after[k])):
                if x >= 0 and y >= 0 and (v := join(parts[x] << SHIFT | parts[y])) is not None:
                    heapq.heappush(heap, (v, x, parts[x], parts[y]))
        return [p for p in parts if p >= 0]


def transducer(words: dict[str, list[int]]) -> bytes:
    """The lexicon as one file of 32-bit numbers: five counts, then arrays. An arc's key is its state and label.

    Words enter in byte order; a state is frozen once no later word can change it, and equal frozen states are one.
    """
    keys = sorted((w.encode("utf-8", "replace"), w) for w in words)
    frozen: dict[tuple, int] = {}
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
    reach: list[int] = []  # words that end at or behind a state

    def freeze(node: list) -> int:
        shape = node[0], tuple(node[1])
        if shape not in frozen:
            frozen[shape] = len(states)
            states.append(shape)
            reach.append(shape[0] + sum(reach[t] for _, t in shape[1]))
        return frozen[shape]

    path: list[list] = [[False, []]]  # open states of the latest word
    before = b""
    for raw, _ in keys:
        same = 0
        while same < min(len(raw), len(before)) and raw[same] == before[same]:
            same += 1
        while len(path) > same + 1:
            node = path.pop()
            path[-1][1].append((before[len(path) - 1], freeze(node)))
        path += [[False, []] for _ in raw[same:]]
        path[-1][0] = True
        before = raw
    while len(path) > 1:
        node = path.pop()
        path[-1][1].append((before[len(path) - 1], freeze(node)))
    root = freeze(path[0])

    final, arcs_of, targets, outs = [], [], [], []
    for number, (is_final, arcs) in enumerate(states):
        final.append(int(is_final))
        passed = int(is_final)
        for label, to in arcs:
            arcs_of.append(number << 8 | label)
            targets.append(to)
            outs.append(passed)
            passed += reach[to]
    starts, ids = [0], []
    for _, word in keys:
        ids += words[word]
        starts.append(len(ids))
    head = [root, len(states), len(arcs_of), len(keys), len(ids)]
    return np.array([*head, *final, *arcs_of, *targets, *outs, *starts, *ids], "<u4").tobytes()


class Lexicon:
    """A transducer file, memory-mapped."""

    def __init__(self, path: str):
        whole = np.memmap(path, "<u4", "r")
        self.root, n_states, n_arcs, n_words, n_ids = map(int, whole[:5])
        cuts = np.cumsum([5, n_states, n_arcs, n_arcs, n_arcs, n_words + 1, n_ids])
        self.final, self.arcs, self.targets, self.outs, self.starts, self.ids = (whole[a:b] for a, b in zip(cuts, cuts[1:]))

    def look(self, words: list[str]) -> list[list[int] | None]:
        """The ids of each word, None if the lexicon hasn't it; all words walk the automaton together."""
        raws = [w.encode("utf-8", "replace") for w in words]
        lengths = np.fromiter(map(len, raws), np.int64, len(raws))
        flat = np.frombuffer(b"".join(raws), np.uint8)
        begin = np.cumsum(lengths) - lengths
        states, place, fits = np.full(len(raws), self.root, np.int64), np.zeros(len(raws), np.int64), np.ones(len(raws), bool)
        going, step = np.flatnonzero(lengths > 0), 0
        while len(going) and len(self.arcs):
            key = states[going] << 8 | flat[begin[going] + step]
            arc = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1)
            on = self.arcs[arc] == key
            fits[going[~on]] = False
            going, arc = going[on], arc[on]
            place[going] += self.outs[arc]
            states[going] = self.targets[arc]
            step += 1
            going = going[lengths[going] > step]
        fits &= self.final[states] > 0 if len(self.arcs) else False
        return [self.ids[self.starts[p] : self.starts[p + 1]].tolist() if f else None for p, f in zip(place.tolist(), fits.tolist(), strict=True)]


def read_vocabulary(path: str | None = None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    with open(path, encoding="utf-8") as f:
        return f.read()


def frequent_words(docs: DataFrame, content, n: int = LEXICON_WORDS) -> list[str]:
    """The commonest words over all documents, at most n, met twice at least; all words of a count or none."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, seen = Vocabulary(*content.value), Counter()

        def passed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
            seen.clear()
            return out

        for batch in batches(it):
            for text in batch.column(0):
                for words in vocabulary.words(text.as_py() or ""):
                    if isinstance(words, list):
                        seen.update(words)
                if len(seen) > HELD:
                    yield passed()
        if seen:
            yield passed()

    counted = docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")
    counts = materialised(counted.select("word", F.floor(F.log2("n") * BUCKETS).cast("int").alias("bucket")), "words")
    sizes = {r.bucket: r.size for r in counts.groupBy("bucket").agg(F.count("*").alias("size")).collect()}  # at most 64 * BUCKETS rows
    least, taken = max(sizes, default=0) + 1, 0
    for bucket in sorted(sizes, reverse=True):
        taken += sizes[bucket]
        if taken > n:
            break
        least = bucket
    return [r.word for r in counts.where(F.col("bucket") >= least).select("word").collect()]


def ship(spark: SparkSession, name: str, content: bytes) -> str:
    """Writes a file to the shared folder through Hadoop's file system, and has Spark give it to each executor."""
    path = f"{shared_dir(spark, name)}.bin"
    jvm, jsc = spark._jvm, spark.sparkContext._jsc
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[1]


class Known:
    """The decimal ids and the token strings, blank-joined, of words and special tokens that a worker has met."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None):
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self.ids: dict[str | int, str] = {}
        self.tokens: dict[str | int, str] = {}

    def learn(self, words: Iterable[str | int]) -> None:
        if len(self.ids) >= REMEMBERED:
            self.ids.clear()
            self.tokens.clear()
        new = list(set(words).difference(self.ids))
        plain = [w for w in new if isinstance(w, str)]
        found: dict[str | int, list[int] | None] = {w: [w] for w in new if isinstance(w, int)}
        found |= zip(plain, self.lexicon.look(plain) if self.lexicon and plain else [None] * len(plain), strict=True)
        missing = [w for w in plain if found[w] is None]
        found |= zip(missing, self.vocabulary.merged(missing), strict=True)
        token, decimal = self.vocabulary.tokens.__getitem__, self.vocabulary.decimal.__getitem__
        for word, ids in found.items():
            self.ids[word] = " ".join(map(decimal, ids))
            self.tokens[word] = " ".join(map(token, ids))

    def of(self, texts: list[str | None]) -> Iterator[tuple[str, str]]:
        """Decimal ids and decoded text of each text."""
        cut = [list(chain.from_iterable([w] if isinstance(w, int) else w for w in self.vocabulary.words(t or ""))) for t in texts]
        self.learn(chain.from_iterable(cut))
        ids, tokens = self.ids.__getitem__, self.tokens.__getitem__
        for words in cut:
            yield " ".join(map(ids, words)), " ".join(map(tokens, words))


def encoder(vocabulary: Vocabulary, lexicon: Lexicon | None) -> Callable[[str | None], list[int]]:
    known = Known(vocabulary, lexicon)
    return lambda text: [int(i) for ids, _ in known.of([text]) for i in ids.split()]


DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"
OUTPUTS = "ids array<int>, decoded string"


def encoded(docs: DataFrame, keep: list[str], path: str | None = None, digests: bool = False) -> DataFrame:
    """The columns ``keep`` with ``ids`` and the text ``decoded`` from them; or with the digests of both instead."""
    spark = docs.sparkSession
    small_batches(spark)
    text = read_vocabulary(path)
    newer = newer_characters(text)
    content, vocabulary = spark.sparkContext.broadcast((text, newer)), Vocabulary(text, newer)
    common = frequent_words(docs, content)
    name = ship(spark, "lexicon", transducer(dict(zip(common, vocabulary.merged(common), strict=True))))
    picked = docs.select(*(F.col(f"`{c}`") for c in keep), F.col("text").alias("bpe__text"))
    n = len(keep)
    schema = StructType([*picked.schema.fields[:n], *StructType.fromDDL(DIGESTS if digests else OUTPUTS).fields])
    names = schema.fieldNames()
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # nothing here makes cycles, and looking for them among the remembered words takes long
        vocabulary = Vocabulary(*content.value)
        known = Known(vocabulary, Lexicon(SparkFiles.get(name)))
        for batch in batches(it):
            found = known.of(batch.column(n).to_pylist())
            if digests:
                rows = [(i.count(" ") + 1 if i else 0, digest(i), digest(d)) for i, d in found]
                kinds = pa.int64(), pa.string(), pa.string()
            else:
                rows = [([*map(int, i.split())], d) for i, d in found]
                kinds = pa.list_(pa.int32()), pa.string()
            extra = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *extra], names=names)

    return picked.mapInArrow(run, schema)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"], digests=True)
