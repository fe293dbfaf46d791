"""Where a quotation is printed: compared by letters and digits alone, in the paragraphs it claims, and cut out of the text."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

#: Letters and digits from which a quotation proves anything; of a piece between ellipses.
PROOF, PIECE = 25, 12
PLACE = S.StructType([S.StructField("at", S.IntegerType()), S.StructField("end", S.IntegerType()), S.StructField("count", S.IntegerType())])


def canon(x: Column) -> Column:
    """Letters and decimal digits in lower case; spacing, marks and signs are the typesetter's."""
    return F.regexp_replace(F.lower(x), r"[^\p{L}\p{Nd}]+", "")


def flat(x: Column) -> Column:
    """Without white space, in lower case, dashes and quotes alike."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(x), "[‐-―−-]", "-"), "[‘’“”]", "'"), r"\s+", "")


def is_printed(quote: Column, text: Column, least: int = PROOF) -> Column:
    """Whether a quotation of enough characters stands in a text, spacing aside; an absent one doesn't."""
    q = flat(quote)
    return F.coalesce((F.length(q) >= least) & F.contains(flat(text), q), F.lit(False))


def place_of(text: str | None, quote: str | None) -> tuple[int, int, int] | None:
    """(at, end, times) of the first place where the letters and digits of a quotation stand in a row."""
    if not text or not quote:
        return None
    keep = lambda s: [(c, i) for i, ch in enumerate(s) for c in ch.lower() if c.isalpha() or c.isdecimal()]
    if text.isascii():  # each character is one in lower case
        line, held = re.sub("[^a-z0-9]+", "", text.lower()), [m.start() for m in re.finditer("[A-Za-z0-9]", text)]
    else:
        pairs = keep(text)
        line, held = "".join(c for c, _ in pairs), [i for _, i in pairs]
    want = "".join(c for c, _ in keep(quote)) if not quote.isascii() else re.sub("[^a-z0-9]+", "", quote.lower())
    at = line.find(want) if want else -1
    if at < 0:
        return None
    times, then = 1, line.find(want, at + 1)
    while then >= 0:
        times, then = times + 1, line.find(want, then + 1)
    return held[at], held[at + len(want) - 1] + 1, times


@F.pandas_udf(PLACE)
def places(text: pd.Series, quote: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([place_of(t, q) or (None, None, None) for t, q in zip(text, quote)], columns=["at", "end", "count"]).astype("Int32")


def located(quotes: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """(quote_id, paragraph, match, ambiguous, at, end) of each quotation that is found.

    quotes: quote_id, id, claimed (places of paragraphs, or null), quote; paragraphs: id, idx, text, and at, their offset.
    The claimed paragraphs, one after the other, come first: contiguous, or stitched from words that all stand there.
    Else, and without a claim, the first paragraph that holds it; then the first that holds its pieces between ellipses in
    order; then the document across its paragraphs. Offsets are those of a contiguous quotation within one paragraph. A quotation that stands more
    than once where it was looked for is ambiguous. Claims that name no paragraph find nothing.
    """
    q = quotes.select("quote_id", "id", "claimed", "quote", canon(F.col("quote")).alias("cq")).where("cq != ''")
    # a document meets its quotations as one row, so its paragraphs are shuffled once and not for each of them
    docs = paragraphs.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("idx", "at", "text"))).alias("rows"))
    docs = docs.select("id", F.transform("rows", lambda r: F.struct(r["idx"], r["at"], r["text"], canon(r["text"]).alias("cp"))).alias("rows"))
    joined = lambda rows: F.array_join(F.transform(rows, lambda r: r["cp"]), "")
    again = lambda text: F.call_function("locate", F.col("cq"), text, F.instr(text, F.col("cq")) + 1) > 0  # noqa: E731  overlaps count
    holding = lambda rows: F.filter(rows, lambda r: F.contains(r["cp"], F.col("cq")))
    x = q.join(docs.hint("merge"), "id").withColumn("own", F.flatten(F.transform("claimed", lambda i: F.filter("rows", lambda r: r["idx"] == i))))
    x = x.where("claimed is null or size(own) > 0").withColumn("joined", joined(F.col("own")))
    words = F.filter(F.transform(F.split("quote", r"[\s;,()\[\]]+"), lambda w: canon(w)), lambda w: w != "")
    whole = F.contains("joined", F.col("cq"))
    x = x.withColumn("match", F.when(whole, "contiguous").when(F.forall(words, lambda w: F.contains(F.col("joined"), w)), "stitched"))
    x = x.withColumn("holders", holding(F.when(F.col("match").isNull(), F.col("rows")).otherwise(F.col("own"))))
    first, free = F.get("holders", F.lit(0)), F.col("claimed").isNull()
    pieces = F.filter(F.transform(F.split("quote", r"\.{3}|…"), lambda w: canon(w)), lambda w: F.length(w) >= PIECE)
    x = x.withColumn("pieces", F.when(free & first.isNull(), pieces))
    ordered = F.when(F.size("pieces") > 1, F.get(F.filter("rows", lambda r: F.rlike(r["cp"], F.array_join("pieces", ".*"))), F.lit(0)))
    x = x.withColumn("ordered", ordered)
    x = x.withColumn("spot", F.when(free & first.isNull() & F.col("ordered").isNull(), F.instr(joined(F.col("rows")), F.col("cq")) - 1))
    before = F.transform("rows", lambda r, i: F.aggregate(F.slice("rows", 1, i), F.lit(0), lambda n, y: n + F.length(y["cp"])))
    across = F.when(F.col("spot") >= 0, F.get("rows", F.size(F.filter(before, lambda b: b <= F.col("spot"))) - 1))
    many = F.when(F.col("match") == "contiguous", again(F.col("joined"))).when(F.col("match").isNull() & ~free, (F.size("holders") > 1) | again(first["cp"]))
    at = F.coalesce(first, F.when(F.col("match").isNotNull(), F.get("own", F.lit(0))), F.col("ordered"), across)
    both = x.select("quote_id", "cq", at.alias("x"), F.when(first.isNotNull() & (F.coalesce("match", F.lit("contiguous")) == "contiguous"), "contiguous").otherwise("stitched").alias("match"), F.coalesce(many, F.lit(False)).alias("ambiguous")).where("x is not null")
    both = both.withColumn("place", places(F.when(F.col("match") == "contiguous", F.col("x.text")), F.col("cq")))
    return both.select("quote_id", F.col("x.idx").alias("paragraph"), "match", "ambiguous", (F.col("x.at") + F.col("place.at")).alias("at"), (F.col("x.at") + F.col("place.end")).alias("end"))
