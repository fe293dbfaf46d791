"""A seeded sample that anyone can draw again: a known generator in column arithmetic, and the shuffle it drives."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.operators.ranking import numbered

#: Fixed values of the generator.
STEP, BITS32 = 0x6D2B79F5, 0xFFFFFFFF
#: Swaps worked out at once: the first, where most places move, and a bound on memory.
FIRST, CHUNK = 1 << 12, 1 << 20


def times32(a: Column, b: Column) -> Column:
    """The low 32 bits of a product of two unsigned 32-bit numbers, without leaving 64 bits."""
    low, high = b.bitwiseAND(0xFFFF), F.shiftright(b, 16)
    return (a * low + F.shiftleft((a * high).bitwiseAND(0xFFFF), 16)).bitwiseAND(BITS32)


def draw(seed: Column, k: Column) -> Column:
    """The k-th number, from 1, of the generator mulberry32 with this seed, from 0 up to 1. Any place is reached at once."""
    a = (seed.bitwiseAND(BITS32) + k.bitwiseAND(BITS32) * STEP).bitwiseAND(BITS32)
    t = times32(a.bitwiseXOR(F.shiftright(a, 15)), a.bitwiseOR(F.lit(1)))
    t = t.bitwiseXOR((t + times32(t.bitwiseXOR(F.shiftright(t, 7)), t.bitwiseOR(F.lit(61)))).bitwiseAND(BITS32))
    return t.bitwiseXOR(F.shiftright(t, 14)) / 4294967296.0


def drawn(seed: int, k: np.ndarray) -> np.ndarray:
    """The same numbers in an array."""
    a = (np.uint64(seed & BITS32) + k.astype(np.uint64) * np.uint64(STEP)) & np.uint64(BITS32)
    t = ((a ^ (a >> np.uint64(15))) * (a | np.uint64(1))) & np.uint64(BITS32)
    t ^= (t + (((t ^ (t >> np.uint64(7))) * (t | np.uint64(61))) & np.uint64(BITS32))) & np.uint64(BITS32)
    return (t ^ (t >> np.uint64(14))) / 4294967296.0


def first_places(seed: int, n: int, size: int) -> list[int]:
    """What lies in the first ``size`` places after n things are shuffled, the last place first.

    The swaps are followed backwards from these places: the number of swap i is drawn directly, so no array of n is held.
    """
    at = list(range(min(size, n)))
    low, step = 1, FIRST
    while low < n:
        i = np.arange(low, min(n, low + step))
        j = np.floor(drawn(seed, n - i) * (i + 1)).astype(np.int64)
        todo = np.flatnonzero(np.isin(j, at) | np.isin(i, at))
        while len(todo):
            k, todo = int(todo[0]), todo[1:]
            a, b = int(i[k]), int(j[k])
            if a in at or b in at:
                at = [b if p == a else a if p == b else p for p in at]
                # no later swap is of place a or lower, so what moved there is met only where one draws it
                later = j[k + 1 :]
                todo = np.union1d(todo, k + 1 + np.flatnonzero((later == a) | (later == b)))
        low, step = low + step, min(2 * step, CHUNK)
    return at


def sample_size(n: Column) -> Column:
    """A tenth, ten at most and three at least, of what there is."""
    return F.greatest(F.least(F.lit(3), n), F.least(F.lit(10), F.ceil(n * 0.1)))


def qc_sample(records: DataFrame, project: str, fact: str, order: list[str]) -> DataFrame:
    """(project, place, fact and order columns): each project's sample of records, distinct facts only, in the shuffle's order.

    The seed is the project times 2654435761 plus its number of records; records are numbered by ``order``. A fact with c
    records fills c places at most, so size * c places hold enough facts.
    """
    kind = dict(records.dtypes)[project]
    rest = [c for c in order if c != fact]
    rows = numbered(records.select(project, fact, *rest), [project], order, "number")
    most = rows.groupBy(project, fact).agg(F.count("*").alias("c")).groupBy(project).agg(F.sum("c").alias("n"), F.max("c").alias("c"))
    asked = most.select(project, "n", (sample_size(F.col("n")) * F.col("c")).alias("places"), sample_size(F.col("n")).alias("size"))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = [(p, place, number + 1, size) for p, n, places, size in zip(pdf[project], pdf.n, pdf.places, pdf["size"]) for place, number in enumerate(first_places(int(p) * 2654435761 + int(n), int(n), int(places)))]
            yield pd.DataFrame(out, columns=[project, "place", "number", "size"])

    # a row a project is little to read and long to work on, so Spark would leave all to one task
    asked = asked.repartition(records.sparkSession.sparkContext.defaultParallelism)
    picked = asked.mapInPandas(run, f"`{project}` {kind}, place int, number long, size long").join(rows, [project, "number"])
    first = picked.groupBy(project, fact).agg(F.min(F.struct("place", "size", *rest)).alias("x")).select(project, fact, "x.*")
    return numbered(first, [project], ["place"], "at").where("at <= size").select(project, F.col("at").cast("int").alias("place"), fact, *rest)
