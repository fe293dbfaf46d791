"""Column functions on text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters with marks, and the base letters that stand for them in searches.
MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
BASES = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"


def search_fold(x: Column) -> Column:
    """For searches: marks off Latin letters, dashes and underscores to blanks, white space to one blank, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.translate(x, MARKED, BASES), "[-–—_]", " "), r"\s+", " "))


def normal_title(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))


def tokens(x: Column, least: int = 3) -> Column:
    """Distinct runs of a-z and 0-9 of ``least`` characters or more, in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit(f"[a-z0-9]{{{least},}}"), 0))


def dice(a: Column, b: Column) -> Column:
    """Dice similarity of two token sets; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), 2.0 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b))).otherwise(0.0)


def fingerprint(*parts: Column) -> Column:
    """Parts trimmed, in lower case, with single blanks, joined by U+001F."""
    return F.concat_ws("\u001f", *(F.trim(F.regexp_replace(F.lower(F.coalesce(p, F.lit(""))), r"\s+", " ")) for p in parts))


def any_needle(query: str, *fields: Column) -> Column:
    """Whether one of the query's alternatives, split by bars, occurs in a field after folding. No alternative: true."""
    needles = [n.strip() for n in query.split("|") if n.strip()]
    out = F.lit(False)
    for n in needles:
        for f in fields:
            out = out | F.coalesce(F.contains(search_fold(f), search_fold(F.lit(n))), F.lit(False))
    return out if needles else F.lit(True)


def csv_cell(x: Column) -> Column:
    """An RFC 4180 cell: quoted if it holds a comma, quote or line break, or begins or ends with a blank; null is empty."""
    text = F.coalesce(x.cast("string"), F.lit(""))
    return F.when(text.rlike('[",\r\n]|^ | $'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def year_of(x: Column, last: int) -> Column:
    """The first four digits in a row as a year from 1400 to ``last``; else absent."""
    y = F.regexp_extract(x.cast("string"), "([0-9]{4})", 1)
    n = F.when(y != "", y.cast("int"))
    return F.when(n.between(1400, last), n)


def count_of(x: Column) -> Column:
    """A positive whole number, cut off at the point; else 0."""
    n = x.cast("string").try_cast("double")
    return F.when(n > 0, F.floor(n)).otherwise(0).cast("long")


def is_absent(x: Column) -> Column:
    """Marks of an absent value: blank, dashes, n.d., n/a, not ..."""
    plain = F.lower(F.trim(F.coalesce(x, F.lit(""))))
    return plain.isin("", "-", "–", "—", "n.d.", "nd", "n/a", "na", "none") | plain.startswith("not ")


def similarity_band(x: Column) -> Column:
    return F.when(x >= 0.7, "close").when(x >= 0.5, "related").when(x.isNotNull(), "weak")


def packed(sizes: Column, budget: int) -> Column:
    """Sizes of chunks: parts are packed in order while a chunk stays within ``budget``; a larger part is a chunk alone."""
    begin = F.struct(F.lit(0).cast("long").alias("now"), F.expr("cast(array() as array<bigint>)").alias("out"))
    step = lambda a, x: F.when((a["now"] > 0) & (a["now"] + x > budget), F.struct(x.alias("now"), F.array_append(a["out"], a["now"]).alias("out"))).otherwise(F.struct((a["now"] + x).alias("now"), a["out"].alias("out")))
    return F.aggregate(F.transform(sizes, lambda x: x.cast("long")), begin, step, lambda a: F.when(a["now"] > 0, F.array_append(a["out"], a["now"])).otherwise(a["out"]))


def reads_as_quantity(x: Column) -> Column:
    """A number, or a figure after words or signs that qualify it."""
    t = F.trim(F.coalesce(x, F.lit("")))
    rest = F.regexp_replace(t, r"(?i)^(?:about|approx\.?|approximately|ca\.?|circa|around|up\s+to|at\s+least|at\s+most|over|under|less\s+than|greater\s+than|more\s+than|no\s+more\s+than)\s+", "")
    return F.regexp_replace(rest, r"^[~≈∼〜<>≤≥⩽⩾=±+\-−\s]+", "").rlike(r"^\.?\d")


def reports_absence(x: Column) -> Column:
    """A phrase that tells of nothing found, which is a result."""
    return F.trim(F.coalesce(x, F.lit(""))).rlike(r"(?i)^(?:n\.?\s*d\.?|nd|no\s+[\w\s]*\b(?:detected|observed|activity|measured|conversion|turnover)\b[\w\s]*|not\s+(?:detected|detectable|observed|measurable|determined|reported|applicable|available|quantifiable)|below\s+(?:the\s+)?(?:limit|detection|quantitation)\b[\w\s]*|undetectable|absent|none\s+detected|n/a)\.?$")


def safe(x: Column, most: int) -> Column:
    """Text without control and direction marks, white space at its ends and what exceeds ``most``; absent if nothing is left."""
    plain = F.trim(F.regexp_replace(x, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f​-‏‪-‮⁦-⁩﻿]", ""))
    return F.nullif(F.substring(plain, 1, most), F.lit(""))


def identifier(x: Column) -> Column:
    """struct(kind, value) of a pasted DOI, arXiv or PubMed id in any of their forms, in this order; null for anything else."""
    v = F.trim(x)
    doi = F.regexp_extract(v, r'(10\.\d{4,9}/[^\s"<>]*[^\s".,;:)\]}<>])', 1)
    linked, named = F.regexp_extract(v, r"(?i)arxiv\.org/(?:abs|pdf)/([^\s?#]+?)(?:\.pdf)?$", 1), F.regexp_extract(v, r"(?i)^arxiv:\s*(.+)$", 1)
    pmid = F.coalesce(F.nullif(F.regexp_extract(v, r"(?i)^pmid:?\s*(\d{1,9})$", 1), F.lit("")), F.nullif(F.regexp_extract(v, r"(?i)pubmed\.ncbi\.nlm\.nih\.gov/(\d{1,9})", 1), F.lit("")), F.when(v.rlike(r"^\d{5,9}$"), v))
    of = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    arxiv = F.when(linked != "", linked).when(named != "", F.trim(named)).when(v.rlike(r"(?i)^\d{4}\.\d{4,5}(v\d+)?$|^[a-z-]+(\.[A-Z]{2})?/\d{7}(v\d+)?$"), v)
    return F.when(doi != "", of("doi", F.lower(doi))).when(arxiv.isNotNull(), of("arxiv", arxiv)).when(pmid.isNotNull(), of("pmid", pmid))


#: Named references of characters that titles and abstracts use.
NAMED = (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("nbsp", " "), ("ndash", "–"), ("mdash", "—"), ("deg", "°"), ("micro", "µ"), ("alpha", "α"), ("beta", "β"), ("gamma", "γ"), ("delta", "δ"), ("times", "×"), ("plusmn", "±"), ("amp", "&"))


def plain_markup(x: Column) -> Column:
    """Markup as text: scripts, styles and comments go, tags become blanks or nothing, named references their characters."""
    t = F.regexp_replace(x, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"(?i)</?(?:p|div|br|li|h[1-6]|title|sec|abstract|jats:\w+)\b[^>]*>", " "), r"</?[A-Za-z!][^>]*>", "")
    for name, char in NAMED:
        t = F.replace(t, F.lit(f"&{name};"), F.lit(char))
    return F.trim(F.regexp_replace(t, r"[\s ]+", " "))
