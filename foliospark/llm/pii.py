"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust their score.

Native: only Spark SQL functions, row by row, without a shuffle. The spans of a pattern follow from the lengths of the
gaps, ``split(text, p)``, and of the matches, ``regexp_extract_all(text, p)``: both walk the same leftmost,
non-overlapping matches. Loops are possessive, so the JVM's regex engine never recurses on long texts, and a
look-behind lets a run of characters be tried from its start only, so a long run costs time in proportion.

Base kinds (email, ip, card, phone) are reported whenever the pattern and its check hold; their score says how sure
that is. The method's own kinds, iban and ssn, need a score of ACCEPT: an IBAN gets it from its mod-97 checksum alone,
a bare social security number only with a context word nearby.

Defined results: a null text is empty and has no spans; offsets count code points, the end is exclusive; equal rows
get equal results; an empty table gives no rows; further columns are ignored, or kept by ``redact``, whatever their names;
a text with very many spans takes time in proportion to find, and more to redact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Kinds in the order of the contract, then the method's own.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: A cheap test that any text with a match passes. All kinds but email also need a digit.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": "+", "iban": "[A-Z]{2}[0-9]{2}", "ssn": "-[0-9]{2}-"}
#: An octet of at most 255: one with a digit other than 0 behind any zeros, or zeros only.
PART = "(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]?)|0++)"
#: Context words that raise a span's score when they begin a word within CONTEXT code points before it.
CONTEXT, RAISE, ACCEPT = 40, 0.35, 0.5
#: Matches whose offsets are added up in one array; arrays of arrays keep the work in proportion to a text's matches.
STEP = 256
WORDS = {
    "email": r"(?i)(?<!\p{L})(?:e-?mail|contact|write|correo|courriel)",
    "ip": r"(?i)(?<!\p{L})(?:ip|address|host|server|adresse)",
    "card": r"(?i)(?<!\p{L})(?:card|visa|mastercard|credit|tarjeta|carte|karte)",
    "phone": r"(?i)(?<!\p{L})(?:phone|tel|call|mobile|fax|teléfono|téléphone|telefon)",
    "iban": r"(?i)(?<!\p{L})(?:iban|bank|account|konto|cuenta|compte)",
    "ssn": r"(?i)(?<!\p{L})(?:ssn|social|security|tax)",
}
PRIOR = {"email": 0.6, "ip": 0.5, "card": 0.6, "phone": 0.5, "iban": 0.6, "ssn": 0.3}


def luhn(digits: Column) -> Column:
    """Whether a string of at most 19 digits has a Luhn checksum."""
    backwards = F.reverse(digits)
    terms = F.transform(
        F.sequence(F.lit(1), F.length(digits)),
        lambda i: F.when(i % 2 == 1, F.substring(backwards, i, F.lit(1)).cast("int")).otherwise(
            F.element_at(F.array(*(F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), F.substring(backwards, i, F.lit(1)).cast("int") + 1)
        ),
    )
    return F.aggregate(terms, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(match: Column) -> Column:
    """Whether an IBAN's check digits hold (remainder 1 of the rearranged number by 97)."""
    plain = F.regexp_replace(match, " ", "")
    turned = F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))
    values = F.filter(F.split(turned, ""), lambda c: c != "")
    rest = F.aggregate(values, F.lit(0), lambda a, c: F.when(F.ascii(c) >= 65, (a * 100 + F.ascii(c) - 55) % 97).otherwise((a * 10 + F.ascii(c) - 48) % 97).cast("int"))
    return (F.length(plain).between(15, 34)) & (rest == 1)


def holds(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return match.rlike(rf"^{PART}(?:\.{PART}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    if kind == "iban":
        return mod97(match)
    if kind == "ssn":
        return ~match.rlike("^(?:000|666|9..)-|-00-|-0000$")
    return F.lit(True)


def spans_of(kind: str, text: Column, digit: Column) -> Column:
    """array<struct<s, e, k, kind, score>> of one kind, in order; s and e in code points. digit: whether the text has one."""
    pattern = F.lit(PATTERNS[kind])
    gaps, found = F.split(text, PATTERNS[kind], -1), F.regexp_extract_all(text, pattern, 0)
    pairs = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(found)).alias("g"), found.alias("m"))
    none = F.expr("cast(array() as array<struct<s:int,e:int,m:string,before:string>>)")

    def step(acc: Column, x: Column) -> Column:
        start, before = acc["p"] + F.length(x["g"]), F.right(F.concat(acc["tail"], x["g"]), F.lit(CONTEXT))
        end = start + F.length(x["m"])
        row = F.struct(start.alias("s"), end.alias("e"), x["m"].alias("m"), before.alias("before"))
        return F.struct(end.alias("p"), F.right(F.concat(before, x["m"]), F.lit(CONTEXT)).alias("tail"), F.concat(acc["out"], F.array(row)).alias("out"))

    def placed(z: Column) -> Column:
        begin = F.array(F.struct(F.lit(0).alias("p"), F.lit("").alias("tail"), none.alias("out")))
        from_ = lambda last: F.struct(last["p"].alias("p"), last["tail"].alias("tail"), none.alias("out"))
        block = lambda acc, i: F.array_append(acc, F.aggregate(F.slice(z, i * STEP + 1, STEP), from_(F.element_at(acc, -1)), step))
        blocks = F.aggregate(F.sequence(F.lit(0), F.floor((F.size(z) - 1) / STEP).cast("int")), begin, block)
        return F.when(F.size(z) > 0, F.flatten(F.transform(blocks, lambda x: x["out"]))).otherwise(none)

    at = F.get(F.transform(F.array(pairs), placed), F.lit(0))  # bound once, or each block would match the text again
    good = F.filter(at, lambda x: holds(kind, x["m"]))

    def scored(x: Column) -> Column:
        score = F.lit(PRIOR[kind]) + F.when(x["before"].rlike(WORDS[kind]), RAISE).otherwise(0.0)
        return F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(KINDS.index(kind)).alias("k"), F.lit(kind).alias("kind"), score.alias("score"))

    out = F.filter(F.transform(good, scored), lambda x: F.lit(kind in BASE) | (x["score"] >= ACCEPT))
    likely = text.contains(NEEDS[kind]) if len(NEEDS[kind]) == 1 else text.rlike(NEEDS[kind])
    return F.when(likely if kind == "email" else digit & likely, out).otherwise(F.expr(f"cast(array() as {SPAN})"))


SPAN = "array<struct<s:int,e:int,k:int,kind:string,score:double>>"


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def spanned(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc, text, spans): a row as one struct, so no column of it clashes, its text, and the spans of all kinds, by start,
    then kind as listed."""
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), whole.alias("text"), whole.rlike("[0-9]").alias("digit"))
    found = F.array_sort(F.concat(*(spans_of(k, F.col("text"), F.col("digit")) for k in KINDS)), lambda a, b: F.when(a["s"] != b["s"], a["s"] - b["s"]).otherwise(a["k"] - b["k"]))
    return rows.select("doc", "text", found.alias("spans"))


def with_spans(docs: DataFrame, text: str = "text", into: str = "pii__spans") -> DataFrame:
    """The same as a column of its own beside a table's columns, none of which has its name."""
    return spanned(docs, text).select("doc.*", F.col("spans").alias(into))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spanned(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col("spans")
    count = lambda kind: F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter(spans, lambda x: x["k"] < len(BASE))
    score = F.array_max(F.transform(spans, lambda x: x["score"])).alias("max_score")
    return docs.select("doc.doc_id", *(count(k) for k in BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(spans).alias("spans"), score)


def redact(docs: DataFrame) -> DataFrame:
    """Every document with each span replaced by its kind in angle brackets; overlapping spans become one, named by the first.

    ``n_chars``, where it is a column, follows the new text. Null texts stay null.
    """
    text, m = F.col("text"), F.col("merged")
    empty = F.expr("cast(array() as array<struct<s:int,e:int,kind:string>>)")
    piece = lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))

    def merge(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        longer = F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"), last["kind"].alias("kind"))
        return F.when((F.size(acc) > 0) & (last["e"] > x["s"]), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(longer))).otherwise(F.concat(acc, F.array(piece(x))))

    rows = spanned(docs).select("doc", "text", F.aggregate("spans", empty, merge).alias("merged"))
    before = lambda i: F.when(i == 0, 0).otherwise(F.get(m, i - 1)["e"])
    parts = F.transform(m, lambda x, i: F.concat(F.substring(text, before(i) + 1, x["s"] - before(i)), F.lit("<"), F.upper(x["kind"]), F.lit(">")))
    new = F.when(F.size(m) > 0, F.concat(F.array_join(parts, ""), F.substr(text, F.try_element_at(m, F.lit(-1))["e"] + 1))).otherwise(F.col("doc")["text"])
    out = rows.select("doc", new.alias("new"))
    kinds = dict(docs.dtypes)
    of = {"text": F.col("new")} | ({"n_chars": F.length("new").cast(kinds["n_chars"])} if "n_chars" in kinds else {})
    return out.select(*(of.get(c, F.col("doc")[c]).alias(c) for c in docs.columns))
