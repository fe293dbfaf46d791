"""SimHash near-duplicates: fingerprints, links within a Hamming radius by bit-sliced comparison, components.

1. Each task computes fingerprints of whole texts. Equal ones become one class before anything is compared.
2. A class is listed under several keys, each made of some bits of its fingerprint; classes that share a key are
   compared. With the keys of ``pigeonhole`` every link within the radius shares one; those of ``sampled_keys`` are
   drawn at random, and miss a link with a known small probability.
3. A key's classes are dealt into blocks of about BLOCK, each pair of blocks a group of its own, so no task gets an
   unbounded key. Fingerprints are held as bit planes: word w of plane b has bit b of 64 fingerprints. All distances
   are counted at once by carry-save adders, plane by plane, and a block is abandoned once every lane has exceeded the
   radius. Small groups are compared as one run of rows, each row with those a few places behind it.
4. A group returns a minimum spanning forest of its links, by distance, never all pairs; whatever a radius below the
   given one joins, the forest joins by links within that radius.
5. Components come from alternating large-star and small-star rounds, each checkpointed in the shared folder.

``op8_simhash`` takes 3-word shingles, 64 bits and radius 2, all links found. ``deduplicated`` removes near-duplicates of
five-word Jaccard similarity SIMILARITY or more: candidates are 128-bit fingerprints within NEAR bits that share a key. Where
a share p of the bits differs, a key is shared with probability (1 - p)**KEY_BITS (at similarity 0.8, p = 0.15, 99 % share
one of the 64 keys; at 0.9, all but one in 100,000). Each forest link is then confirmed by the exact similarity of whole texts.

Defined results: a null text is empty; a text without words has fingerprint zero and is linked like any other; one of
fewer words than a shingle has its whole sequence as one shingle; equal rows are linked; the component is the smallest
doc_id reachable, null ids aside; texts may be of any length; an empty table gives no rows; further columns are ignored,
or kept by ``deduplicated``, whatever their names.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import batches, checkpointed, materialised, small_batches, table, text_bytes

SHINGLE, SEED, RADIUS, BLOCK = 3, 42, 2, 1024
#: Of the near-duplicate stage: words of a shingle, least Jaccard similarity, radius of candidates in 128 bits, least bits of
#: a key, share of bits in which texts of that similarity agree, and share of them that have a key in common.
NEAR_SHINGLE, SIMILARITY, NEAR, KEY_BITS, AGREE, MET = 5, 0.8, 30, 16, 0.8465, 0.99
#: Queries compared with a block at once, planes between two looks at whether any lane is still near, rows of a group
#: that is compared by places, rows gathered before a comparison.
QUERIES, LOOK, SMALL, GATHERED = 64, 8, 64, 1 << 16
#: Keys of more than BLOCK classes up to which their table, some 20 bytes each, is broadcast; beyond, it is joined by a shuffle.
HOT_KEYS = 200_000
#: Row numbers up to which their list, 16 bytes each, is broadcast to pick texts; beyond, texts are joined by a shuffle.
ROWS = 4_000_000
#: One class in so many is counted to estimate the sizes of keys.
SIZED = 16
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingles(text: str | None, size: int) -> np.ndarray:
    """XXH64 of each shingle, repeats included; none of a text without words."""
    words = text_bytes(text).lower().split()  # bytes: A-Z only, and exactly the six ASCII white spaces
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    size = min(size, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[: len(words) - size + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=True)], np.uint64)


def majority(h: np.ndarray) -> int:
    """The 64 bits set in over half of the hashes; zero without any."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 16):
        counts += np.unpackbits(h[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None) -> int:
    return majority(shingles(text, SHINGLE))


def signature(text: str | None) -> tuple[int, int, int, int, int]:
    """128 bits over the set of five-word shingles, a digest of the set, and its size."""
    h = np.unique(shingles(text, NEAR_SHINGLE))
    again = (h ^ h >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
    again ^= again >> np.uint64(29)
    digest = xxhash.xxh3_128_intdigest(h.tobytes())
    return majority(h), majority(again), digest >> 64, digest & (1 << 64) - 1, len(h)


def with_fingerprints(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and sh__fp, the fingerprint as a signed long."""
    small_batches(docs.sparkSession)
    names = [*keep, "sh__fp"]
    picked = docs.select(*(F.col(f"`{c}`") for c in keep), F.col("text").alias("sh__text"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it):
            fps = np.array([fingerprint(t.as_py()) for t in batch.column(len(keep))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(fps)], names=names)

    return picked.mapInArrow(run, StructType([*picked.schema.fields[: len(keep)], StructField("sh__fp", LongType())]))


def planes(fps: np.ndarray) -> np.ndarray:
    """Bit planes of n fingerprints, each some words: for each bit a row of ceil(n / 64) words."""
    fps = fps.reshape(len(fps), -1)
    bits = np.zeros((-(-len(fps) // 64) * 64, 64 * fps.shape[1]), np.uint8)
    bits[: len(fps)] = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def exceeding(differences: Iterable[np.ndarray], shape: tuple[int, ...], radius: int) -> np.ndarray:
    """Lanes with more than ``radius`` set bits over all planes. Counters start so high that they overflow beyond it."""
    levels = radius.bit_length()
    start = (1 << levels) - 1 - radius
    counter = [np.full(shape, FULL if start >> k & 1 else 0, np.uint64) for k in range(levels)]
    waiting: list[np.ndarray | None] = [None] * levels
    far = np.zeros(shape, np.uint64)
    for number, carry in enumerate(differences, 1):
        level = 0
        while level < levels and waiting[level] is not None:  # two planes and the counter's make its new plane and a carry
            half = counter[level] ^ waiting[level]
            carry, counter[level], waiting[level] = counter[level] & waiting[level] | half & carry, half ^ carry, None
            level += 1
        if level < levels:
            waiting[level] = carry
        else:
            far |= carry
        if number % LOOK == 0 and (far == FULL).all():
            return far
    for level, carry in enumerate(waiting):
        if carry is not None:
            for k in range(level, levels):
                carry, counter[k] = counter[k] & carry, counter[k] ^ carry
            far |= carry
    return far


def lanes(far: np.ndarray, n: int) -> np.ndarray:
    """The first n lanes that aren't far, as booleans."""
    return ~np.unpackbits(np.ascontiguousarray(far).view(np.uint8), axis=-1, bitorder="little")[..., :n].astype(bool)


def near(queries: np.ndarray, block: np.ndarray, n: int, radius: int = RADIUS) -> np.ndarray:
    """Whether each of n fingerprints, given as planes, is within the radius of each query: a boolean matrix."""
    queries = queries.reshape(len(queries), -1)
    differences = (block[b] ^ np.where(queries[:, b // 64] >> np.uint64(b % 64) & np.uint64(1), FULL, np.uint64(0))[:, None] for b in range(len(block)))
    return lanes(exceeding(differences, (len(queries), block.shape[1]), radius), n)


def near_in_runs(fps: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one group within the radius; groups are runs of at most SMALL rows."""
    every = planes(fps)
    every = np.concatenate([every, np.zeros((len(every), 1), np.uint64)], axis=1)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for step in range(1, min(SMALL, len(fps))):
        same = group[step:] == group[:-step]
        if not same.any():
            break
        up, down = np.uint64(step), np.uint64(64 - step)
        differences = (p[:-1] ^ (p[:-1] >> up | p[1:] << down) for p in every)
        i = np.flatnonzero(lanes(exceeding(differences, (every.shape[1] - 1,), radius), len(same)) & same)
        left.append(i)
        right.append(i + step)
    return np.concatenate(left), np.concatenate(right)


def near_in_blocks(left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of left, row of right) within the radius."""
    block, a, b = planes(right), [], []
    for k in range(0, len(left), QUERIES):
        i, j = np.nonzero(near(left[k : k + QUERIES], block, len(right), radius))
        a.append(i + k)
        b.append(j)
    return np.concatenate(a), np.concatenate(b)


def forest(i: np.ndarray, j: np.ndarray, distance: np.ndarray, n: int) -> np.ndarray:
    """Places of the links of a minimum spanning forest: each tree takes its nearest link, until none is left."""
    label, chosen = np.arange(n), []
    weight = distance.astype(np.int64) * len(i) + np.arange(len(i))
    while True:
        a, b = label[i], label[j]
        going = a != b
        i, j, weight, a, b = (x[going] for x in (i, j, weight, a, b))
        if not len(i):
            return np.unique(np.concatenate([*chosen, np.zeros(0, np.int64)])) % max(len(distance), 1)
        best = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(best, a, weight)
        np.minimum.at(best, b, weight)
        picked = (weight == best[a]) | (weight == best[b])
        chosen.append(weight[picked] % len(distance))
        root, a, b = np.arange(n), a[picked], b[picked]
        while True:
            new, least = root.copy(), np.minimum(root[a], root[b])
            np.minimum.at(new, a, least)
            np.minimum.at(new, b, least)
            new = new[new]
            if (new == root).all():
                break
            root = new
        label = root[label]


def pigeonhole(bits: int, radius: int) -> list[list[int]]:
    """Keys' bits: those of each pair of radius + 2 parts, of which fingerprints within the radius have two in common."""
    parts = np.array_split(np.arange(bits), radius + 2)
    return [[*x.tolist(), *y.tolist()] for x, y in combinations(parts, 2)]


def sampled_keys(bits: int, keys: int, size: int) -> list[list[int]]:
    """Keys' bits, drawn at random, the same in every run."""
    rng = random.Random(SEED)
    return [sorted(rng.sample(range(bits), size)) for _ in range(keys)]


def key_plan(classes: int) -> tuple[int, int]:
    """(keys, bits of each): bits grow with the classes, so that a key holds about BLOCK of them however many there are, and
    keys with the bits, so that links are met as often."""
    bits = max(KEY_BITS, math.ceil(math.log2(max(1, classes) / BLOCK)))
    return math.ceil(math.log(1 - MET) / math.log(1 - AGREE**bits)), bits


def links(classes: DataFrame, keys: list[list[int]], radius: int) -> DataFrame:
    """Links (a, b) of a minimum spanning forest of every group. classes: sh__id, sh__n, then a fingerprint's words.

    Only classes of similar size, sh__n, are linked: the smaller has at least SIMILARITY of the larger's.
    """
    words = classes.columns[2:]
    places = [np.array(k, np.uint64) for k in keys]

    def spread(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it):
            fps = [c.to_numpy(zero_copy_only=False).view(np.uint64) for c in batch.columns[2:]]
            for number, bits in enumerate(places):
                key = np.full(batch.num_rows, number << 40, np.uint64)
                for k, b in enumerate(bits.tolist()):
                    key |= (fps[b // 64] >> np.uint64(b % 64) & np.uint64(1)) << np.uint64(k)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *batch.columns], names=["key", *batch.schema.names])

    keyed = lambda some: some.mapInArrow(spread, StructType([StructField("key", LongType()), *classes.schema.fields]))
    # how many classes a key has only decides how they are dealt, so an estimate from a share of the classes will do
    share = keyed(classes.where(F.pmod(F.xxhash64("sh__id"), F.lit(SIZED)) == 0))
    hot = materialised(share.groupBy("key").agg((F.count("*") * SIZED).alias("n")).where(F.col("n") > BLOCK), "hot-keys")
    if hot.count() <= HOT_KEYS:
        hot = F.broadcast(hot)
    dealt = keyed(classes).join(hot, "key", "left").withColumn("blocks", F.ceil(F.coalesce("n", F.lit(1)) / BLOCK).cast("int")).withColumn("own", F.pmod(F.hash("sh__id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "sh__id", "sh__n", *words)
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(parts, "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "own")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges(ids: np.ndarray, sizes: np.ndarray, fps: np.ndarray, i: np.ndarray, j: np.ndarray) -> Iterator[pa.RecordBatch]:
            fits = (np.minimum(sizes[i], sizes[j]) >= SIMILARITY * np.maximum(sizes[i], sizes[j])) & (ids[i] != ids[j])
            i, j = i[fits], j[fits]
            if len(i):
                at = forest(i, j, np.bitwise_count(fps[i] ^ fps[j]).sum(axis=1), len(ids))
                yield pa.RecordBatch.from_arrays([pa.array(ids[i[at]]), pa.array(ids[j[at]])], names=["a", "b"])

        def compared(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            starts = np.concatenate([[0], np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1)) + 1])
            sizes = np.diff(np.concatenate([starts, [len(rows)]]))
            group = np.repeat(np.arange(len(starts)), sizes)
            small = (sizes <= SMALL) & (rows[starts, 1] == rows[starts, 2])
            few = rows[small[group] & (sizes > 1)[group]]
            of = group[small[group] & (sizes > 1)[group]]
            if len(few):
                fps = np.ascontiguousarray(few[:, 6:]).view(np.uint64)
                yield from edges(few[:, 4], few[:, 5], fps, *near_in_runs(fps, of, radius))
            for k in np.flatnonzero(~small).tolist():
                many = rows[starts[k] : starts[k] + sizes[k]]
                fps = np.ascontiguousarray(many[:, 6:]).view(np.uint64)
                left, right = (np.flatnonzero(many[:, 3] == many[0, c]) for c in (1, 2))
                if len(left) and len(right):
                    i, j = near_in_blocks(fps[left], fps[right], radius)
                    yield from edges(many[:, 4], many[:, 5], fps, left[i], right[j])

        held: list[np.ndarray] = []
        n = 0
        for batch in batches(it):
            held.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1))
            n += batch.num_rows
            if n < GATHERED:
                continue
            rows = np.concatenate(held)
            last = np.flatnonzero((rows[:, :3] != rows[-1, :3]).any(axis=1))
            whole = int(last[-1]) + 1 if len(last) else 0  # the last group may go on
            if whole:
                yield from compared(rows[:whole])
            held, n = [rows[whole:]], len(rows) - whole
        if n:
            yield from compared(np.concatenate(held))

    return dealt.mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node each node of the edges (a, b) reaches, its own roots included."""
    def stars(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if large:
            both = both.union(e.select("b", "a"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        kept = both.where("v > u") if large else both
        out = kept.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        if not large:
            out = out.union(least.select("u", "m"))
        ordered = out.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        return ordered.distinct()

    edges = checkpointed(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before = state(edges)
    while before[0]:
        edges = checkpointed(stars(stars(edges, True), False))
        now = state(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def component_ids(ids: DataFrame) -> DataFrame:
    """(sh__fp, component): the smallest doc_id of all rows that a fingerprint reaches within RADIUS. ids: doc_id, sh__fp."""
    classes = checkpointed(ids.groupBy("sh__fp").agg(F.min("doc_id").alias("first")))
    edges = links(classes.select(F.col("sh__fp").alias("sh__id"), F.lit(1).alias("sh__n"), F.col("sh__fp").alias("sh__f0")), pigeonhole(64, RADIUS), RADIUS)
    roots = components(edges)
    rooted = classes.join(roots, classes.sh__fp == roots.node, "left").select("sh__fp", "first", F.coalesce("root", "sh__fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component"))
    return rooted.join(smallest, "root").select("sh__fp", "component")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = checkpointed(with_fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"]))
    found = component_ids(ids)
    return ids.join(found, "sh__fp").select("doc_id", F.lpad(F.lower(F.hex("sh__fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


SIGNED = ("f0", "f1", "s0", "s1", "n")


def signed(docs: DataFrame) -> DataFrame:
    """(doc, row, f0, f1, s0, s1, n): a document as one struct, a row number, its fingerprint, its set's digest and size."""
    small_batches(docs.sparkSession)
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))
    text_at = docs.columns.index("text")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it):
            found = np.array([signature(t) for t in batch.column(0).field(text_at).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(c)) for c in found.T)], names=["doc", *SIGNED])

    out = whole.mapInArrow(run, StructType([*whole.schema.fields, *(StructField(c, LongType()) for c in SIGNED)]))
    return out.withColumn("row", F.monotonically_increasing_id())


def listed(rows: DataFrame, tag: str) -> DataFrame:
    """Row numbers, saved and counted; broadcast up to ROWS of them."""
    saved = materialised(rows, tag)
    return F.broadcast(saved) if saved.count() <= ROWS else saved


def confirmed(edges: DataFrame, saved: DataFrame) -> DataFrame:
    """The links whose rows have Jaccard similarity SIMILARITY or more, by the shingles of the whole texts."""
    nodes = listed(edges.select(F.col("a").alias("row")).union(edges.select("b")).distinct(), "linked-rows")
    texts = saved.select("row", F.col("doc.text").alias("text")).join(nodes, "row", "left_semi")
    both = edges.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it):
            keep = []
            for pair in zip(*(c.to_pylist() for c in batch.columns[2:])):
                x, y = (np.unique(shingles(t, NEAR_SHINGLE)) for t in pair)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common >= SIMILARITY * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The document with the smallest doc_id of each group of near-duplicates, with its own columns; of equal ids, one row."""
    saved = materialised(signed(docs), "signed")
    order = F.struct(F.col("doc.doc_id").isNull().alias("absent"), F.col("doc.doc_id").alias("id"), "row")
    classes = materialised(saved.groupBy("s0", "s1").agg(F.min(order).alias("first"), F.first("f0").alias("f0"), F.first("f1").alias("f1"), F.first("n").alias("n")).drop("s0", "s1"), "classes")
    found = links(classes.select(F.col("first.row").alias("sh__id"), F.col("n").alias("sh__n"), "f0", "f1"), sampled_keys(128, *key_plan(classes.count())), NEAR)
    found = materialised(found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "candidates")
    roots = components(confirmed(found, saved))
    first = classes.select("first", F.col("first.row").alias("node")).join(roots, "node", "left")
    stay = first.groupBy(F.coalesce("root", "node")).agg(F.min("first").alias("first")).select("first.row")
    gone = listed(saved.select("row").join(stay, "row", "left_anti"), "rows-that-go")  # the fewer ones
    return saved.join(gone, "row", "left_anti").select("doc.*")
