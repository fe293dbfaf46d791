"""Callouts: the marks in a paper's running text that name entries of its bibliography, and whether they can be trusted."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.operators import bibliography
from foliospark.plans.session import small_batches

#: Widest range a mark may name; least distinct ordinals, and least share of the printed entries, of a trusted numbering.
WIDEST, LEAST_ORDINALS, LEAST_SHARE = 40, 5, 0.5
#: Largest share of a text that a bibliography fences off; beyond it the entries are notes all over the text.
FENCED = 0.5
#: A shorter sentence is read with its neighbours; sentences grow up to the larger size.
SHORT, LONG = 40, 600

#: Marks in square and round brackets; what before a round one, or around any, isn't a citation.
SQUARE = re.compile(r"\[([0-9,;\s‐-―-]+)\]")
ROUND = re.compile(r"\(([0-9]{1,3}(?:\s*[,;‐-―-]\s*[0-9]{1,3})*)\)")
NO_LEAD = re.compile(r"(?:\b(?:p\s?H|n|N|eq|ref|fig(?:ure)?|table|scheme|entry|step|no|volume|vol|chapter|eqn|equation)\s*[=.:]?\s*|°C\s*|[=<>~±]\s*)$", re.I)
AFFILIATION = re.compile(r"(?:^|[\s,;])\d{1,2}\s+(?:department|division|institute|universit(?:y|à|é|ät)|laborator(?:y|ies)|faculty|school\s+of|centre|center|hospital|academy|college)\b", re.I)
EQUATION = re.compile(r"\b(?:eqn|eqns|eq|eqs|equation|equations)\b\s*\.?\s*\(?\s*\d", re.I)
ABBREVIATED = re.compile(r"(?:^|[\s(\[])(?:e\.g|i\.e|cf|vs|fig|figs|eq|eqs|ref|refs|no|nos|approx|ca|et al|al|pp|vol|ed|eds|min|max|sec|wt|mol|conc)\.$", re.I)
PLACES = re.compile(r"\d\s+[diulfscha]")
STOP = re.compile(r"[.!?][\"'”’)\]]*\s+(?=\S)")
DASH = "[-‐-―]"


def expanded(interior: Column) -> Column:
    """The ordinals that a mark's inside names, '1, 3-5' for one; null if any part isn't a number or a fair range."""
    items = F.filter(F.transform(F.split(interior, "[,;]"), lambda p: F.trim(p)), lambda p: p != "")

    def one(p: Column) -> Column:
        ends = F.transform(F.split(p, DASH), lambda x: F.trim(x).try_cast("int"))
        a, b = F.get(ends, F.lit(0)), F.get(ends, F.lit(1))
        single = F.when((F.size(ends) == 1) & (a > 0), F.array(a))
        return F.when((F.size(ends) == 2) & (b >= a) & (b - a <= WIDEST), F.sequence(a, b)).otherwise(single)

    lists = F.transform(items, one)
    # most marks name a single number
    alone = F.when(interior.rlike("^[0-9]{1,9}$"), interior).cast("int")
    return F.when(alone > 0, F.array(alone)).when((F.size(items) > 0) & F.forall(lists, lambda x: x.isNotNull()), F.flatten(lists))


def sentence_starts(text: str) -> list[int]:
    """Where sentences begin; a point after an abbreviation ends none."""
    return [0, *(m.end() for m in STOP.finditer(text) if m[0][0] != "." or not ABBREVIATED.search(text[max(0, m.start() - 12) : m.start() + 1]))]


def sentence_at(text: str, starts: list[int], place: int) -> tuple[int, int]:
    """(begin, end) of the sentence around a place, with its neighbours while it is short, and with the one before it if
    the mark itself opens it."""
    ends = [*starts[1:], len(text)]
    a = b = bisect_right(starts, place) - 1
    size = lambda: len(text[starts[a] : ends[b]].strip())
    while size() < SHORT and (a > 0 or b < len(starts) - 1):
        if a > 0:
            a -= 1
        else:
            b += 1
        if size() < SHORT and b < len(starts) - 1:
            b += 1
    if a > 0 and not text[starts[a] : place].strip(" \t\n[(") and ends[b] - starts[a - 1] <= LONG:
        a -= 1
    return starts[a], ends[b]


def healed(text: str) -> str:
    """Lines joined, words broken at a line's end closed up."""
    if "\n" in text:
        text = re.sub(r"\s*\n\s*", " ", re.sub(r"([^\W\d_])[-‐\xad]\s*\n\s*([a-zà-öø-ÿ])", r"\1\2", text))
    return re.sub(r"[ \t]{2,}", " ", text).strip() if "  " in text or "\t" in text else text.strip()


def cites(sentence: str) -> bool:
    """Whether a sentence is neither an affiliation's nor an equation's."""
    low = sentence.lower()
    # in an ASCII text, a number before a letter that begins such a word is sooner seen than the word
    return not ((not low.isascii() or PLACES.search(low)) and AFFILIATION.search(sentence)) and not ("eq" in low and EQUATION.search(sentence))


def paragraphs_of(text: str) -> list[tuple[int, str]]:
    out, at = [], 0
    for part in re.split(r"(\n[ \t]*\n\s*)", text):
        if part.strip():
            out.append((at, part))
        at += len(part)
    return out


def marks_of(text: str, known: set[int], spans: list[tuple[int, int]], fence: tuple[int, int]) -> list[tuple]:
    """(paragraph, at, end, interior, sentence) of each mark outside the bibliography, affiliations and equations."""
    merged: list[list[int]] = []
    for a, b in sorted(s for s in spans if s[1] > s[0] >= 0):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    firsts, out = [a for a, _ in merged], []
    for n, (at, part) in enumerate(paragraphs_of(text)):
        if fence[0] <= at < fence[1]:
            continue
        found = [(m.start(), m.end(), m[1]) for m in SQUARE.finditer(part)]
        for m in ROUND.finditer(part) if "(" in part else ():
            named = ordinals(m[1])
            if named and all(o in known for o in named) and not NO_LEAD.search(part[: m.start()]):
                found.append((m.start(), m.end(), m[1]))
        if not found:
            continue
        starts, last, read = sentence_starts(part), -1, {}
        for a, b, inside in sorted(found, key=lambda x: (x[0], -x[1])):
            i = bisect_right(firsts, at + a) - 1
            if i >= 0 and at + a < merged[i][1]:
                continue
            around = sentence_at(part, starts, a)
            if around not in read:
                sentence = healed(part[slice(*around)])
                read[around] = sentence if cites(sentence) else None
            sentence = read[around]
            if sentence is None or a < last:
                continue
            last = b
            out.append((n, at + a, at + b, inside, sentence))
    return out


def ordinals(interior: str) -> list[int]:
    out: list[int] = []
    for p in filter(None, map(str.strip, re.split("[,;]", interior))):
        ends = [int(x) if x.strip().isdigit() else -1 for x in re.split(DASH, p)]
        if len(ends) == 2 and 0 <= ends[0] <= ends[1] <= ends[0] + WIDEST:
            out += range(ends[0], ends[1] + 1)
        elif len(ends) == 1 and ends[0] > 0:
            out += ends
        else:
            return []
    return out


MARK = [("paragraph", pa.int32()), ("at", pa.int32()), ("end", pa.int32()), ("interior", pa.string()), ("sentence", pa.string())]
NAMES = [k for k, _ in MARK]


def scanned(docs: DataFrame, entries: DataFrame) -> DataFrame:
    """(id, paragraph, at, end, interior, sentence, ordinals) of the marks of each document that has entries.

    Docs: id, text. Entries: id, ordinal, at, end, as ``bibliography.entries`` gives them.
    """
    small_batches(docs.sparkSession)
    own = entries.groupBy("id").agg(F.collect_list(F.struct("ordinal", "at", "end")).alias("entries"))
    rows = docs.select("id", "text").join(own, "id").select("id", "text", F.transform("entries", lambda x: F.array(x["ordinal"], x["at"], x["end"])).alias("entries"))
    kind = dict(docs.dtypes)["id"]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = [(i, *m) for i, text, own in zip(pdf.id, pdf.text, pdf.entries) for m in marks_among(text, own)]
            yield pd.DataFrame(out, columns=["id", *NAMES])

    return rows.mapInPandas(run, f"id {kind}, {bibliography.named(MARK).replace(':', '')}").withColumn("ordinals", expanded(F.col("interior")))


def marks_among(text: str, entries: list) -> list[tuple]:
    """The marks of a text whose entries are (ordinal, at, end); these fence off a part of it, unless they are notes all over it."""
    a, b = min(e[1] for e in entries), max(e[2] for e in entries)
    fence = (a, b) if b - a <= FENCED * len(text) else (-1, -1)
    return marks_of(text, {int(e[0]) for e in entries}, [(e[1], e[2]) for e in entries], fence)


def read(docs: DataFrame) -> DataFrame:
    """(id, printed, known, marks) of each document that has entries: how many, their ordinals, and its marks with what they
    name. Entries and marks are found in one reading of a text, so no text is shuffled or made again."""

    def find(text: str, head: str | None) -> tuple | None:
        own = [(ordinal, at, end) for _, ordinal, _, at, end in bibliography.split_of(text, head)]
        return (len(own), sorted({e[0] for e in own}), [dict(zip(NAMES, m)) for m in marks_among(text, own)]) if own else None

    columns = {"printed": pa.int64(), "known": pa.list_(pa.int32()), "marks": pa.list_(pa.struct(MARK))}
    rows = bibliography.of_each(docs, find, columns, f"printed long, known array<int>, marks array<struct<{bibliography.named(MARK)}>>")
    return rows.withColumn("marks", F.transform("marks", lambda m: F.struct(*(m[k].alias(k) for k in NAMES), expanded(m["interior"]).alias("ordinals"))))


def callouts_of(docs: DataFrame) -> DataFrame:
    """``callouts`` of documents, from one reading."""
    each = read(docs).select("id", "known", F.explode("marks").alias("m"))
    named = F.array_intersect(F.col("m.ordinals"), F.col("known"))
    return each.select("id", "m.paragraph", "m.at", "m.end", F.explode(named).alias("ordinal"), "m.sentence")


def gate_of(docs: DataFrame) -> DataFrame:
    """``gate`` of documents, from one reading."""
    rows = read(docs).select("id", "printed", "known", F.transform("marks", lambda m: m["ordinals"]).alias("each"))
    rows = rows.withColumn("all", F.flatten(F.filter("each", lambda o: o.isNotNull())))
    dangling = F.size(F.filter("all", lambda o: ~F.array_contains("known", o))).cast("long")
    out = rows.select("id", "printed", F.size(F.array_intersect("all", "known")).cast("long").alias("distinct_ordinals"), F.size(F.filter("each", lambda o: o.isNull())).cast("long").alias("malformed"), dangling.alias("dangling"))
    return out.withColumn("accepted", trusted())


def trusted() -> Column:
    return (F.col("distinct_ordinals") >= LEAST_ORDINALS) & (F.col("distinct_ordinals") >= LEAST_SHARE * F.col("printed"))


def callouts(marks: DataFrame, entries: DataFrame) -> DataFrame:
    """(id, paragraph, at, end, ordinal, sentence): a row for each entry that a mark names; numbers of no entry are left out."""
    each = marks.select("id", "paragraph", "at", "end", F.explode(F.array_distinct("ordinals")).alias("ordinal"), "sentence")
    return each.join(entries.select("id", "ordinal").distinct(), ["id", "ordinal"], "left_semi").select("id", "paragraph", "at", "end", "ordinal", "sentence")


def gate(marks: DataFrame, entries: DataFrame) -> DataFrame:
    """(id, printed, distinct_ordinals, malformed, dangling, accepted) of each document with entries: its numbering is
    trusted if enough ordinals, and enough of the printed entries, are named."""
    printed = entries.groupBy("id").agg(F.count("*").alias("printed"), F.collect_set("ordinal").alias("known"))
    each = marks.join(printed.select("id", "known"), "id").select("id", "known", F.explode_outer("ordinals").alias("o"), F.col("ordinals").isNull().alias("bad"))
    named = each.groupBy("id").agg(F.count_distinct(F.when(F.array_contains("known", F.col("o")), F.col("o"))).alias("distinct_ordinals"), F.count_if("bad").alias("malformed"), F.count_if(F.col("o").isNotNull() & ~F.array_contains("known", F.col("o"))).alias("dangling"))
    out = printed.drop("known").join(named, "id", "left").fillna(0, ["distinct_ordinals", "malformed", "dangling"])
    return out.withColumn("accepted", trusted())
