"""Paragraphs and their sections, chunks of neighbouring paragraphs within a budget, and parts of a long source."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.operators.callouts import paragraphs_of
from foliospark.plans.session import small_batches

#: Characters of a token; characters below which a chunk is unsure; of a part of a source, and the most parts.
TOKEN, UNSURE, PART, PARTS = 4, 120, 120_000, 12
#: What a heading is called and the section it opens; words that begin a caption; what is no paragraph.
SECTIONS = (("abstract", r"abstract\b"), ("introduction", r"(introduction|background)\b"), ("methods", r"(materials?\s+and\s+methods?|methods?|experimental(\s+(section|procedures?))?|methodology)\b"), ("results", r"results?\b"), ("discussion", r"discussions?\b"), ("conclusion", r"(conclusions?|summary|concluding\s+remarks)\b"), ("acknowledgements", r"acknowledge?ments?\b"), ("references", r"(references?|bibliography|literature\s+cited|works\s+cited)\b"), ("supplementary", r"(supplementary|supporting\s+information|appendix|appendices)\b"))
CAPTION = re.compile(r"\s*(fig(ure)?\.?|table|scheme|chart|supplementary\s+(fig|table))\s*\.?\s*\d", re.I)
HEADING = re.compile(r"(?:\d+(?:\.\d+)*|[IVXLCDM]+)?[.)]?\s*[A-Za-z][A-Za-z\s/&-]{2,45}?\s*[.:]?\s*")
JUNK = re.compile(r"[\s.…·•\-–—_]+|\s*\d{1,4}\s*")
FRONT = "front"


def kind_of(text: str) -> str:
    if CAPTION.match(text):
        return "caption"
    if len(text) <= 80 and not re.search(r"[.!?;:]$", text) and len(text.split()) <= 12 and re.match(r"(\d+(\.\d+)*\s+)?[A-Z]", text):
        return "heading"
    return "list" if re.match(r"\s*([-*•]|\d+[.)])\s+", text) else "prose"


def section_of(heading: str) -> str | None:
    """The section that a heading opens, its number aside; a sentence that begins with such a word opens none."""
    bare = re.sub(r"\s+", " ", re.sub(r"^\d+(\.\d+)*[.)]?\s+", "", re.sub(r"(?i)^[ivxlcdm]+[.)]\s+", "", heading.strip())))
    for name, pattern in SECTIONS:
        if m := re.match(pattern, bare, re.I):
            rest = bare[m.end() :].strip()
            if not (rest[:1].islower() and (len(rest) > 40 or re.search(r"[.,;:]$", rest))):
                return name
    return None


def segmented(text: str | None) -> list[tuple]:
    """(idx, at, end, kind, section) of the paragraphs between blank lines: exact slices without outer white space; rules,
    dots and bare page numbers aside. A heading's section holds until the next one; after a bibliography's heading, and for
    paragraphs that begin with one, all are references."""
    out, section = [], FRONT
    for at, part in paragraphs_of(text or ""):
        body = part.strip()
        if JUNK.fullmatch(body):
            continue
        start = at + len(part) - len(part.lstrip())
        line = body.split("\n")[0].strip()
        opens = section_of(line) if HEADING.fullmatch(line) else None
        kind = "heading" if opens and line == body else kind_of(body)
        section = opens or section
        out.append((len(out), start, start + len(body), "reference" if section == "references" and kind != "heading" else kind, section))
    return out


def chunked(text: str, paragraphs: list[tuple], budget: int) -> list[tuple]:
    """(idx, first, last, at, end, section, text, tokens, unsure, hash): neighbouring paragraphs of one section, within the
    budget; a longer paragraph is a chunk alone. References and blank paragraphs belong to none."""
    groups: list[list[tuple]] = []
    size = 0
    for p in paragraphs:
        n = p[2] - p[1]
        if p[3] == "reference" or n <= 0:
            continue
        last = groups[-1][-1] if groups else None
        if last is None or last[4] != p[4] or last[0] + 1 != p[0] or size + n > budget:
            groups.append([])
            size = 0
        groups[-1].append(p)
        size += n
    out = []
    for i, g in enumerate(groups):
        body = text[g[0][1] : g[-1][2]]
        out.append((i, g[0][0], g[-1][0], g[0][1], g[-1][2], g[0][4], body, -(-len(body) // TOKEN), len(body.strip()) < UNSURE, hashlib.sha256(body.encode("utf-8", "replace")).hexdigest()))
    return out


def budget_of(max_tokens: int, prefix: str = "") -> int:
    """Characters that fit a model of so many tokens beside a prefix."""
    return max(UNSURE, (max_tokens - 8) * TOKEN - len(prefix))


def rows_of(docs: DataFrame, each: Callable[[str], list[tuple]], columns: str) -> DataFrame:
    """A row for each tuple that ``each`` finds in a document's text, its id first."""
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["id"]
    names = ["id", *(c.split()[0] for c in columns.split(", "))]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pd.DataFrame([(i, *row) for i, text in zip(pdf.id, pdf.text) for row in each(text or "")], columns=names)

    return docs.select("id", "text").mapInPandas(run, f"id {kind}, {columns}")


def paragraphs(docs: DataFrame) -> DataFrame:
    """(id, idx, at, end, kind, section, text)."""
    return rows_of(docs, lambda t: [(*p, t[p[1] : p[2]]) for p in segmented(t)], "idx int, at int, end int, kind string, section string, text string")


def chunks(docs: DataFrame, budget: int) -> DataFrame:
    """(id, idx, first, last, at, end, section, text, tokens, unsure, hash)."""
    return rows_of(docs, lambda t: chunked(t, segmented(t), budget), "idx int, first int, last int, at int, end int, section string, text string, tokens int, unsure boolean, hash string")


def parts_of(sizes: list[int], most: int = PART, separator: int = 2) -> list[tuple[int, int]]:
    """(first piece, characters) of each part that pieces fill in order, a separator between them."""
    out: list[tuple[int, int]] = []
    for i, n in enumerate(sizes):
        if out and out[-1][1] + separator + n <= most:
            out[-1] = (out[-1][0], out[-1][1] + separator + n)
        else:
            out.append((i, n))
    return out


def source_parts(docs: DataFrame, most: int = PART, parts: int = PARTS) -> DataFrame:
    """(id, part, total, first, chars, fits): the parts that a document's paragraphs fill; ``fits`` unless there are too many,
    as part of a source is never taken for all of it."""

    def each(text: str) -> list[tuple]:
        found = parts_of([p[2] - p[1] for p in segmented(text)], most)
        return [(i + 1, len(found), a, n, len(found) <= parts) for i, (a, n) in enumerate(found)]

    return rows_of(docs, each, "part int, total int, first int, chars int, fits boolean")


def summary(docs: DataFrame) -> DataFrame:
    """(id, section, paragraphs, chars) of each document's sections."""
    return paragraphs(docs).groupBy("id", "section").agg(F.count("*").alias("paragraphs"), F.sum(F.length("text")).alias("chars"))
