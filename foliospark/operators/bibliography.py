"""Bibliographies in running text: where the section lies, which splitter cuts it, its entries, and what each one names.

Each document is scanned once, in its own row, for the places of list markers, headings and entry openers; the markers of
each style vote by their longest ascending chain, and where the winning chain leaves most of the section unexplained, lines
that open like an entry cut it instead. Running heads, fields, lettered parts and repeated DOIs are column functions and
aggregates over lines and entries. No text is shuffled but those of documents that repeat a line.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions import bibliographic as B
from foliospark.plans.session import small_batches

STYLES = ("dot", "bracket", "paren", "bare")
#: Largest gap in a chain; least chain that makes a list by itself, or cuts a section; least size of a text, a numbered and another entry.
MAX_GAP, LEAST_RUN, LEAST_CHAIN, LEAST_TEXT, LEAST_NUMBERED, LEAST_OTHER = 3, 8, 3, 500, 12, 30
#: Characters of a gap that parts two lists, of an entry that has run away, of the longest plausible entry, of a probe.
LIST_GAP, RUNAWAY, PLAUSIBLE, PROBE, EARLY = 3000, 1200, 2000, 4000, 0.25

#: What begins a line of each style, and an entry in the middle of a line.
NAME = "[A-Z][A-Za-z'À-ɏ-]"
AT_START = {"dot": r"\s*(\d{1,3})\.\s+(?=\S)", "bracket": r"\s*\[\s*(\d{1,3})\s*\]\s*(?=\S)", "paren": r"\s*\(\s*(\d{1,3})\s*\)\s+(?=\S)", "bare": r"\s*(\d{1,3})\s+(?=[A-Z(\[])"}
WITHIN = {"dot": rf"\s(\d{{1,3}})\.\s+(?={NAME}{{2,}}\s*,\s*[A-Z]\.)", "bracket": rf"\s\[\s*(\d{{1,3}})\s*\]\s+(?={NAME}+\s*,)", "paren": rf"\s\(\s*(\d{{1,3}})\s*\)\s+(?={NAME}+\s*,)", "bare": rf"\s(\d{{1,3}})\s+(?=[A-Z]\.\s*(?:[A-Z]\.\s*)?{NAME}*(?:\s*[¨´`ˆ˜˚˝¯]\s*[A-Za-z'À-ɏ-]+)?[A-Za-z'À-ɏ-]*\s*,)"}
OPENERS = (rf"{NAME}+,\s*[A-Z]\.", rf"\[\s*{NAME}+[^\]]{{0,60}}\d{{4}}[a-z]?\s*\]", rf"(?:[A-Z]\.\s*){{1,3}}{NAME}+[,.]", rf"{NAME}+\s+(?:[A-Z]\.\s+)?{NAME}+\s*[,.]")
#: Headings before and after a bibliography.
HEADING = r"(?i)[\s\d.]*(?:references?\s+and\s+notes?|references?\s+cited|literature\s+cited|bibliographical\s+references?|references?|bibliography|notes\s+and\s+references)\s*:?\s*$"
AFTER = r"(?i)\s*(?:supplementary\s+(?:information|material|data|methods|note)s?|appendix(?:\s*[A-Z\d][.:]?)?|appendices|author\s+(?:information|contributions?)|acknowledge?ments?|competing\s+(?:financial\s+)?interests?|about\s+the\s+authors?|methods?|online\s+methods?|experimental\s+(?:section|procedures?)|materials\s+and\s+methods|conflicts?\s+of\s+interest|funding|data\s+availability|abbreviations|summary|conclusions?)\s*:?\s*$"
AFTER_WITH_TITLE = r"(?:\s*(?i:appendix|appendices|supplementary\s+(?:material|information|note)s?|supplement)\s*[:.]\s*\S|\s*S\s?\d{1,2}\.?\s+[A-Z][A-Za-z])"
#: Page furniture inside entries, with letters that any has, and runs of numbers.
FURNITURE = ((r"(?i)\bPage\s+\d+\s+of\s+\d+\b", "page"), (r"(?i)\bView Article Online\b", "onl"), (r"(?i)\bDownloaded by [^.\n]{0,60}on \d{2}/\d{2}/\d{4}[^.\n]{0,20}\.", "download"))
NUMBERS = r"(?:\b\d{1,3}\b[ \t\n]+){6,}\d{1,3}\b"
#: The year of an entry, initials beside a name, a range of pages, a DOI, and where a citation ends.
YEAR, INITIALS, PAGES, DOI = r"\b(1[89]\d{2}|20\d{2})\b", r"[A-Z][a-z]+,?\s+[A-Z]\.|[A-Z]\.\s*[A-Z]?\.?\s+[A-Z][a-z]+", r"\b\d{1,4}\s*[–—-]\s*\d{1,4}\b", r"\b10\.\d{4,9}/"
TAIL = r"(?:\((?:1[89]\d{2}|20\d{2})\)\s*\.?|\b(?:1[89]\d{2}|20\d{2})\s*[.;]|\d{1,4}\s*[–—-]\s*\d{1,4}\s*\.?|\b10\.\d{4,9}/\S+)"


#: The patterns that a scan of lines tries, and what any place of one must have, which is sooner seen.
STARTS, INSIDE = {k: re.compile(p) for k, p in AT_START.items()}, {k: re.compile(p) for k, p in WITHIN.items()}
ENTRY_INSIDE = re.compile(r"\s(?:\d{1,3}\.?|\[\s*\d{1,3}\s*\]|\(\s*\d{1,3}\s*\))\s+(?=[A-Z])")
HEADS, CLOSERS, OPENS = re.compile(HEADING), (re.compile(AFTER), re.compile(AFTER_WITH_TITLE)), re.compile("|".join(f"(?:{p})" for p in OPENERS))
SPACED = re.compile(r"[A-Z\s.:\d]+")
CLOSER_LETTERS, OPENER_LETTERS = frozenset("acdefmosACDEFMOSſ"), frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ[")


def folded(line: str) -> str:
    return line if line.isascii() else re.sub("[̀-ͯ]", "", unicodedata.normalize("NFKD", line))


def marks_of(text: str | None) -> list[tuple]:
    """(at, num, kind, first) of each marker; of headings, with their line's end as num, and of lines that end a list or
    open an entry. ``first``: the marker counts where styles are mixed."""
    out, at = [], 0
    for line in (text or "").split("\n"):
        bare = line.strip()
        if not bare:
            at += len(line) + 1
            continue
        head = bare[0]
        kinds = ("bracket",) if head == "[" else ("paren",) if head == "(" else ("dot", "bare") if head.isdecimal() else ()
        hits = [(k, m) for k in kinds if (m := STARTS[k].match(line))]
        out += [(at, int(m[1]), k, n == 0) for n, (k, m) in enumerate(hits)]
        if ENTRY_INSIDE.search(line):
            for k, p in INSIDE.items():
                if all(k != x for x, _ in hits):
                    out += [(at + m.start(), int(m[1]), k, not hits) for m in p.finditer(line) if m.start()]
        closed = re.sub(r"\s+", "", bare) if SPACED.fullmatch(bare) else ""
        if HEADS.match(bare) or len(closed) >= 8 and HEADS.match(closed):
            out.append((at, at + len(line) + 1, "heading", False))
        if head in CLOSER_LETTERS and (CLOSERS[0].match(bare) or CLOSERS[1].match(bare)):
            out.append((at, 0, "after", False))
        flat = folded(line)
        if flat[:1] in OPENER_LETTERS and OPENS.match(flat):
            out.append((at, 0, "opener", False))
        at += len(line) + 1
    return sorted(out, key=lambda x: x[0])


def chain_of(nums: list[int]) -> list[int]:
    """Places of the longest chain that begins at MAX_GAP or less and takes each next larger number within MAX_GAP; of
    equally long ones the last. From right to left, so each place is looked at once."""
    nearest: dict[int, int] = {}
    follow, length = [-1] * len(nums), [1] * len(nums)
    best = -1
    for i in range(len(nums) - 1, -1, -1):
        then = min((nearest[nums[i] + d] for d in range(1, MAX_GAP + 1) if nums[i] + d in nearest), default=-1)
        if then >= 0:
            follow[i], length[i] = then, 1 + length[then]
        nearest[nums[i]] = i
        if nums[i] <= MAX_GAP and (best < 0 or length[i] > length[best]):
            best = i
    out = []
    while best >= 0:
        out.append(best)
        best = follow[best]
    return out


def best(marks: list[tuple], kind: str | None, a: int, b: int) -> list[tuple]:
    """The longest chain of a style's markers, or of all styles mixed, from a up to b."""
    own = [m for m in marks if a <= m[0] < b and (m[2] == kind if kind else m[3])]
    return [own[i] for i in chain_of([m[1] for m in own])]


def reads_like_citations(text: str, chain: list[tuple]) -> bool:
    """Half of the first twelve entries, three at least, have a year and initials, pages or a DOI."""
    some = [m[0] for m in chain[:12]]
    parts = [text[a:b] for a, b in zip(some, [*some[1:], some[-1] + 400])] if some else []
    good = sum(bool(re.search(YEAR, t)) and any(re.search(p, t) for p in (INITIALS, PAGES, DOI)) for t in parts)
    return bool(some) and good >= max(3, -(-len(some) // 2))


def located(text: str, marks: list[tuple]) -> tuple[int, int]:
    """(start, stop) of the section, or (-1, -1).

    The last heading that isn't near the front, or that citations follow, begins it; without one, the longest numbered run
    that reads like citations does, from its last large gap on. It ends at a heading of another kind after eight entries.
    """
    start = -1
    for at, after, kind, _ in reversed(marks):
        if kind == "heading":
            near = best(marks, None, after, after + PROBE)
            if at >= EARLY * len(text) or len(near) >= 4 and reads_like_citations(text, near):
                start = after
                break
    if start < 0:
        for run in sorted((best(marks, k, 0, len(text)) for k in STYLES), key=len, reverse=True):
            if len(run) >= LEAST_RUN and reads_like_citations(text, run):
                cut = max((i for i in range(1, len(run)) if run[i][0] - run[i - 1][0] > LIST_GAP), default=0)
                start = run[cut if len(run) - cut >= LEAST_RUN else 0][0]
                break
    if start < 0:
        return -1, -1
    for at, _, kind, _ in marks:
        if kind == "after" and at > start and (len(best(marks, None, start, at)) >= LEAST_RUN or sum(m[2] == "opener" and start <= m[0] < at for m in marks) >= LEAST_RUN):
            return start, at
    return start, len(text)


def cleaned(raw: str, head: str | None) -> str:
    """An entry without running heads and page furniture, cut after its last citation if it has run away."""
    low = raw.lower()
    for pattern, sign in FURNITURE:
        if sign in low:
            raw = re.sub(pattern, " ", raw)
    if re.search(r"\d[ \t\n]+\d", raw):
        raw = re.sub(NUMBERS, " ", raw)
    if head:
        raw = re.sub(r"(?i)\s*\d{0,5}\s*" + r"\s+".join(map(re.escape, head.split())) + r"\s*\d{0,5}", " ", raw)
    raw = re.sub(r"\s+\n", "\n", re.sub(r"[ \t]{2,}", " ", raw)).strip()
    if len(raw) > RUNAWAY:
        end = max((m.end() for m in re.finditer(TAIL, raw) if m.start() <= RUNAWAY), default=-1)
        raw = raw[:end].strip() if end > 40 else raw
    return raw


def cut(text: str, marks: list[tuple], stop: int, head: str | None) -> list[tuple]:
    """(ordinal, raw, at, end) from each marker up to the next; an entry ends where what is left of it would."""
    out = []
    for (at, num, _, _), to in zip(marks, [*(m[0] for m in marks[1:]), stop]):
        raw = cleaned(text[at:to].strip(), head)
        lead = to - at - len(text[at:to].lstrip())
        out.append((num, raw, at, at + min(to - at, lead + len(raw))))
    return out


def opened(text: str, marks: list[tuple], start: int, stop: int) -> list[tuple]:
    """Lines that open an entry once the entry before has ended: with a point or bracket, and a year or pages in it."""
    out: list[tuple] = []
    for at, _, kind, first in marks:
        if kind == "opener" and start <= at < stop:
            tail = folded(text[out[-1][0] : at]).rstrip() if out else ""
            if not out or re.search(r"[.)]$", tail) and re.search(r"\b(1[89]\d{2}|20\d{2})[a-z]?\b|\d{1,4}\s*[–—-]\s*\d{1,4}", tail):
                out.append((at, len(out) + 1, kind, first))
    return out


def coverage(rows: list[tuple], size: int) -> float:
    return sum(len(r[1]) for r in rows if len(r[1]) <= PLAUSIBLE) / size if size > 0 else 0.0


def split_of(text: str, head: str | None) -> list[tuple]:
    """(style, ordinal, raw, at, end) of each entry of a document."""
    if sum(map(len, text.split())) < LEAST_TEXT:
        return []
    marks = marks_of(text)
    start, stop = located(text, marks)
    if start < 0:
        return []

    def by_vote(a: int, b: int) -> tuple[str, list[tuple]]:
        style, run = max(((k, best(marks, k, a, b)) for k in STYLES), key=lambda x: len(x[1]))
        rows = cut(text, run, b, head) if len(run) >= LEAST_CHAIN else []
        share = coverage(rows, b - a)
        if share < 0.5:
            other = [r for r in cut(text, opened(text, marks, a, b), b, head) if r[1]]
            if not rows or coverage(other, b - a) > 1.5 * share and len(other) > len(rows):
                return "author-year", other
        return style, rows

    style, rows = by_vote(start, stop)
    whole = best(marks, None, 0, len(text))
    if len(whole) >= max(LEAST_RUN, 1.5 * len(rows)):
        wide = by_vote(0, len(text))
        if len(wide[1]) > len(rows):
            (style, rows), stop = wide, len(text)
    if rows:
        want, more = max(r[0] for r in rows) + 1, []
        for m in marks:
            if m[3] and m[0] >= stop and m[1] == want + len(more):
                more.append(m)
        rows = rows + [r for r in cut(text, more, len(text), head) if re.search(YEAR, r[1])]
    least = LEAST_OTHER if style == "author-year" else LEAST_NUMBERED
    return [(style, *r) for r in rows if len(" ".join(r[1].split())) >= least]


def running_head(text: Column) -> Column:
    """The line that a document repeats most, three times at least; page numbers at its ends don't count."""
    long = F.filter(F.split(text, "\n"), lambda x: F.length(x) >= 12)
    lines = F.transform(long, lambda x: F.trim(F.regexp_replace(x, r"^\s*\d{1,5}\s+|\s+\d{1,5}\s*$", "")))
    fit = F.array_sort(F.filter(lines, lambda x: F.length(x).between(12, 90) & x.rlike("[A-Za-z]") & ~x.rlike(YEAR)))
    state = lambda last, run, most, head: F.struct(last.alias("last"), run.alias("run"), most.alias("most"), head.alias("head"))

    def step(s: Column, x: Column) -> Column:
        run = F.when(x == s["last"], s["run"] + 1).otherwise(F.lit(1))
        return state(x, run, F.greatest(run, s["most"]), F.when(run >= s["most"], x).otherwise(s["head"]))

    # of lines repeated alike the last in order, as they are sorted
    return F.aggregate(fit, state(F.lit(""), F.lit(0), F.lit(0), F.lit("")), step, lambda s: F.when(s["most"] >= 3, s["head"]))


def headed(docs: DataFrame) -> DataFrame:
    """(id, text, head) of each document; Python workers hold small batches of them."""
    small_batches(docs.sparkSession)
    return docs.select("id", "text", running_head(F.col("text")).alias("head"))


ENTRY = [("style", pa.string()), ("place", pa.int32()), ("ordinal", pa.int32()), ("raw", pa.string()), ("at", pa.int32()), ("end", pa.int32())]


def named(fields: list[tuple]) -> str:
    """Fields of Arrow types as those of a struct in Spark's notation."""
    return ", ".join(f"{k}: {'string' if t == pa.string() else 'int'}" for k, t in fields)


def of_each(docs: DataFrame, read: Callable[[str, str | None], tuple | None], columns: dict[str, pa.DataType], schema: str) -> DataFrame:
    """id and what ``read`` finds in the text and running head of each document; it leaves out a document for which it has none."""
    kind = dict(docs.dtypes)["id"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            ids, texts, heads = batch.columns
            found = [(n, row) for n, (text, head) in enumerate(zip(texts.to_pylist(), heads.to_pylist())) if (row := read(text or "", head or None))]
            made = [pa.array([row[k] for _, row in found], t) for k, t in enumerate(columns.values())]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array([n for n, _ in found], pa.int64())), *made], names=["id", *columns])

    return headed(docs).mapInArrow(run, f"id {kind}, {schema}")


def listed(docs: DataFrame) -> DataFrame:
    """(id, entries): the printed entries of each document that has a bibliography, in one row, as ``entries`` gives them."""
    names = [k for k, _ in ENTRY]

    def read(text: str, head: str | None) -> tuple | None:
        own = [dict(zip(names, (style, n, *rest))) for n, (style, *rest) in enumerate(split_of(text, head))]
        return (own,) if own else None

    return of_each(docs, read, {"entries": pa.list_(pa.struct(ENTRY))}, f"entries array<struct<{named(ENTRY)}>>")


def entries(docs: DataFrame) -> DataFrame:
    """(id, style, place, ordinal, raw, at, end): the printed entries of each document that has a bibliography.

    Columns: id and text; null and empty texts have none. Offsets are code points of the text.
    """
    return listed(docs).select("id", F.explode("entries").alias("e")).select("id", "e.*")


def body_of(flat: Column) -> Column:
    """An entry on one line, folded, without its marker."""
    return F.regexp_replace(F.regexp_replace(flat, r"^\s*(?:\[\s*\d{1,3}\s*\]|\(\s*\d{1,3}\s*\)|\d{1,3}\.)\s*", ""), r"^\s*\d{1,3}\s+", "")


def year_of(body: Column) -> Column:
    """The first year in brackets, else the last one."""
    bracketed = F.filter(F.transform(F.regexp_extract_all(body, F.lit(r"\((\d{4})[a-z]?\)"), 1), lambda y: y.cast("int")), lambda y: y.between(1800, 2100))
    plain = F.transform(F.regexp_extract_all(body, F.lit(YEAR), 1), lambda y: y.cast("int"))
    return F.coalesce(F.get(bracketed, F.lit(0)), F.try_element_at(plain, F.lit(-1)))


def lettered(body: Column) -> Column:
    """The parts of an entry that prints (a) ... (b) ...: label and text; fewer than two of 20 characters are none."""
    cut = F.split(F.regexp_replace(body, r"(?i)^\s*\(a\)\s+", "a) "), r"(?i)\s\((?=[b-h]\)\s)")
    each = F.transform(cut, lambda t: F.struct(F.lower(F.substring(t, 1, 1)).alias("label"), F.trim(F.regexp_replace(t, r"(?i)^[a-h]\)\s*", "")).alias("text")))
    kept = F.filter(each, lambda p: F.length(p["text"]) >= 20)
    none = F.filter(each, lambda p: F.lit(False))
    return F.when(body.rlike(r"(?i)^\s*\(a\)\s+") & (F.size(kept) > 1), kept).otherwise(none)


def authors_of(body: Column) -> Column:
    """What stands before a year in brackets, else up to the last initial of the opening list, else up to a list's last name."""
    dated = F.regexp_extract(body, r"^(.*?)\(\s*(\d{4})[a-z]?\s*\)\s*[.,:]?\s*", 1)
    initials = F.regexp_extract(body, r"^((?:[^.]|\.(?=\s*[A-Z]\.)|[A-Z]\.)*?[A-Z]\.)\s+(?=[A-Z(])", 1)
    listed = F.regexp_extract(body, r"^((?:[^;]+;){1,}[^,;]+),\s+", 1)
    short = lambda x: F.regexp_replace(F.trim(x), r"[,;.\s]+$", "")
    return F.when(F.length(F.trim(dated)) > 3, short(dated)).when((initials != "") & (F.length(initials) < 0.8 * F.length(body)), F.regexp_replace(initials, r"[,;\s]+$", "")).when(listed != "", F.trim(listed))


def references(docs: DataFrame) -> DataFrame:
    """(id, style, place, part, ordinal, raw, at, end, doi, year, surnames): every entry, and every lettered part of one.

    Parts have the ordinal of their entry and no place in the text. A DOI that several references of a document carry
    is its own, printed on its pages, so none keeps it.
    """
    flat = lambda raw: B.unwrapped(B.fold_text(raw))
    row = lambda e, part, raw, at, end, flat, body: F.struct(e["style"].alias("style"), e["place"].alias("place"), part.alias("part"), e["ordinal"].alias("ordinal"), raw.alias("raw"), at.alias("at"), end.alias("end"), flat.alias("flat"), body.alias("body"))
    none = F.lit(-1)
    # each step is made once in its document's row, which no shuffle parts
    rows = listed(docs).withColumn("e", F.transform("entries", lambda e: F.struct(*(e[k].alias(k) for k, _ in ENTRY), flat(e["raw"]).alias("flat"))))
    rows = rows.withColumn("e", F.transform("e", lambda e: row(e, F.lit(None).cast("string"), e["raw"], e["at"], e["end"], e["flat"], body_of(e["flat"]))))
    parts = lambda e: F.transform(lettered(e["body"]), lambda p: row(e, p["label"], p["text"], none, none, flat(p["text"]), p["text"]))
    rows = rows.withColumn("e", F.flatten(F.transform("e", lambda e: F.concat(F.array(e), parts(e)))))
    rows = rows.withColumn("doi", F.transform("e", lambda e: F.get(B.dois_in(e["flat"]), F.lit(0))))
    rows = rows.withColumn("sorted", F.array_sort(F.filter("doi", lambda x: x.isNotNull())))
    rows = rows.withColumn("own", F.array_distinct(F.filter("sorted", lambda x, i: (i > 0) & (x == F.get("sorted", i - 1)))))
    each = rows.select("id", "own", F.explode(F.arrays_zip("e", "doi")).alias("x")).select("id", "x.e.*", F.when(~F.array_contains("own", F.col("x.doi")), F.col("x.doi")).alias("doi"))
    each = each.withColumns({"year": year_of(F.col("body")), "authors": authors_of(F.col("body"))})
    return each.select("id", "style", "place", "part", "ordinal", "raw", "at", "end", "doi", "year", F.coalesce(B.surnames_in(F.col("authors")), F.array().cast("array<string>")).alias("surnames"))
