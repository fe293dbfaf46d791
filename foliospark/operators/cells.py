"""Cells of a table read twice: what was stored beside what the page prints, and how they disagree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Footnote marks, and signs before a figure.
NOTES, SIGNS = "[*†‡§¶#]", "^[~∼≈≤≥<>=]+"


def fold_label(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(x), "[‐-―−]", "-"), r"\s+", " "))


def fold_figure(x: Column) -> Column:
    """A figure without white space and thousands' commas, its signs plain."""
    x = F.replace(F.regexp_replace(F.lower(x), "[−–—]", "-"), F.lit("±"), F.lit("+-"))
    return F.regexp_replace(F.regexp_replace(x, r",(?=\d{3}\b)", ""), r"\s+", "")


def central(x: Column) -> Column:
    return F.substring_index(fold_figure(x), "+-", 1)


def bare(x: Column) -> Column:
    return F.regexp_replace(central(x), NOTES, "")


def figure(x: Column) -> Column:
    """The number of a figure without its error, marks and sign; null if it isn't one."""
    plain = F.regexp_replace(bare(x), SIGNS, "")
    return F.when(plain.rlike(r"^-?\d*\.?\d+(?:e[+-]?\d+)?$"), plain.try_cast("double"))


def is_bound(x: Column) -> Column:
    return bare(x).rlike(SIGNS)


def same_figure(a: Column, b: Column) -> Column:
    """Equal as printed, or in their middle; or as numbers, if both or neither is a bound."""
    na, nb = figure(a), figure(b)
    return (fold_figure(a) == fold_figure(b)) | (central(a) == central(b)) | F.coalesce((na == nb) & (is_bound(a) == is_bound(b)), F.lit(False))


def is_absence(x: Column) -> Column:
    m = F.trim(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), NOTES, ""))
    return (m == "") | m.isin("blank", "absent", "none", "-", "—", "–") | m.rlike(r"^(n\.?\s*d\.?|not\s|below\s)")


def disagreements(stored: DataFrame, read: DataFrame) -> DataFrame:
    """(doc, row, col, stored, printed, kind, under) where a second reading of a cell doesn't bear out the first.

    stored: doc, row, col, value, a row for each value; read: doc, row, col, values, marked, a row for each cell read. Cells
    that weren't read again say nothing. Of cells read twice, that with most values counts, then the first by its values.
    Kinds: value-not-printed, value-not-stored, stored-where-page-marks-absent, value-belongs-to-another-column.
    """
    key = lambda df: df.withColumns({"r": fold_label(F.col("row")), "c": fold_label(F.col("col"))})
    real = F.filter(F.coalesce("values", F.array().cast("array<string>")), lambda v: ~is_absence(v))
    cells = key(read).withColumn("real", real).withColumn("absent", (F.size(real) == 0) & is_absence(F.col("marked")))
    best = F.max_by(F.struct("real", "absent", "marked"), F.struct(F.size("real").alias("n"), (-F.hash("real")).alias("h"))).alias("x")
    seen = cells.groupBy("doc", "r", "c").agg(best).select("doc", "r", "c", "x.*")
    line = cells.select("doc", "r", F.explode("real").alias("v"), "col", "c").groupBy("doc", "r").agg(F.array_sort(F.collect_list(F.struct("c", "col", "v"))).alias("line"))
    own = key(stored).groupBy("doc", "r", "c").agg(F.first("row").alias("row"), F.first("col").alias("col"), F.collect_list("value").alias("stored"))
    # cells are many for each row that Spark judges their size by, so they aren't broadcast
    both = own.join(seen.hint("merge"), ["doc", "r", "c"]).join(line.hint("merge"), ["doc", "r"], "left")
    none = F.coalesce("line", F.array().cast("array<struct<c:string,col:string,v:string>>"))

    def of_stored(v: Column) -> Column:
        where = F.filter(none, lambda x: same_figure(x["v"], v) & (F.col("absent") | (x["c"] != F.col("c"))))
        under = F.get(where, F.lit(0))["col"]
        kind = F.when(under.isNotNull(), "value-belongs-to-another-column").when(F.col("absent"), "stored-where-page-marks-absent").otherwise("value-not-printed")
        said = F.when(F.col("absent"), F.coalesce("marked", F.lit("nothing"))).when(F.size("real") > 0, F.array_join("real", ", "))
        return F.struct(v.alias("stored"), said.alias("printed"), kind.alias("kind"), under.alias("under"))

    def of_printed(v: Column) -> Column:
        return F.struct(F.lit(None).cast("string").alias("stored"), v.alias("printed"), F.lit("value-not-stored").alias("kind"), F.lit(None).cast("string").alias("under"))

    wrong = F.filter("stored", lambda v: F.col("absent") | ~F.exists("real", lambda p: same_figure(p, v)))
    more = F.filter("real", lambda p: ~F.col("absent") & ~F.exists("stored", lambda v: same_figure(v, p)))
    found = F.concat(F.transform(wrong, of_stored), F.transform(more, of_printed))
    return both.select("doc", "row", "col", F.explode(found).alias("x")).select("doc", "row", "col", "x.*")
