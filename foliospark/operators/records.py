"""Extracted records: view, status, matrix, coverage, review and quality checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.operators import units
from foliospark.operators.ranking import numbered

#: Least records of a relation between columns, its tolerance and largest reach in decades; least values of a run and of the
#: others, and decades between their medians, of a shifted scale.
RELATED, TOLERANCE, REACH, RUN_VALUES, OTHERS, SHIFTED = 4, 0.05, 9, 3, 5, 2.0


def canonical(records: DataFrame) -> DataFrame:
    """Adds canonical unit and value, absent if the unit isn't known."""
    return units.canonical(records).drop("scale", "shift")


def status(records: DataFrame) -> DataFrame:
    """conflict before invalid before review before validated."""
    s = F.when(F.col("kind") == "conflict", "conflict").when(F.col("value").isNull(), "invalid").when(F.col("unit").isNull() | (F.col("kind") == "inferred"), "review").otherwise("validated")
    return records.withColumn("status", s)


def reading_key():
    return F.concat_ws("|", F.lower(F.trim("subject")), F.lower(F.trim("conditions")))


def matrix(records: DataFrame, fields: list[str]) -> DataFrame:
    """A row for each work and reading, a column for each field: its first value by (run, ordinal, value)."""
    first = F.min_by("value", F.struct("run_id", "ordinal", "value"))
    return records.groupBy("work_id", reading_key().alias("reading")).pivot("field", fields).agg(first)


def coverage(records: DataFrame, works: DataFrame) -> DataFrame:
    """Works with and without a value, and values, by field; fields without any value stay."""
    total = works.count()
    by = records.groupBy("field").agg(F.count_distinct(F.when(F.col("value").isNotNull(), F.col("work_id"))).alias("with_values"), F.count("value").alias("n_values"))
    return by.select("field", "with_values", (F.lit(total) - F.col("with_values")).alias("without_values"), "n_values")


def unit_outvoted(records: DataFrame, least: int = 5, share: float = 0.8) -> DataFrame:
    """Records of a field whose canonical unit differs from one that holds ``share`` of ``least`` or more records of other runs."""
    known = records.where(F.col("canonical_unit").isNotNull())
    own = known.groupBy("field", "run_id", "canonical_unit").agg(F.count("*").alias("own"))
    units = own.groupBy("field", "canonical_unit").agg(F.sum("own").alias("unit_n"))
    total = units.groupBy("field").agg(F.sum("unit_n").alias("field_n"))
    runs = own.groupBy("field", "run_id").agg(F.sum("own").alias("run_n"))
    pairs = runs.join(units.join(total, "field"), "field").join(own, ["field", "run_id", "canonical_unit"], "left").fillna(0, ["own"])
    others = pairs.withColumns({"others": F.col("field_n") - F.col("run_n"), "others_unit": F.col("unit_n") - F.col("own")})
    main = others.where((F.col("others") >= least) & (F.col("others_unit") >= share * F.col("others"))).select("field", "run_id", F.col("canonical_unit").alias("dominant"))
    return known.join(main, ["field", "run_id"]).where("canonical_unit != dominant")


def error_exceeds(records: DataFrame) -> DataFrame:
    return records.where((F.col("error") >= 0) & (F.abs("error") > F.abs("value")))


def outliers(records: DataFrame, decades: float, least: int = 5) -> DataFrame:
    """Positive values more than ``decades`` outside the span of their peers (same field and unit, other runs)."""
    positive = records.where("value > 0")
    key = ["field", "unit"]
    run = positive.groupBy(*key, "run_id").agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    ends = run.groupBy(*key).agg(F.sum("n").alias("all_n"), F.min(F.struct("lo", "run_id")).alias("first"), F.max(F.struct("hi", "run_id")).alias("last"))
    mine = run.join(ends, key)
    second = mine.groupBy(*key).agg(F.min(F.when(F.col("run_id") != F.col("first.run_id"), F.col("lo"))).alias("lo2"), F.max(F.when(F.col("run_id") != F.col("last.run_id"), F.col("hi"))).alias("hi2"))
    peers = mine.join(second, key).select(*key, "run_id", (F.col("all_n") - F.col("n")).alias("peers"), F.when(F.col("run_id") == F.col("first.run_id"), F.col("lo2")).otherwise(F.col("first.lo")).alias("peer_lo"), F.when(F.col("run_id") == F.col("last.run_id"), F.col("hi2")).otherwise(F.col("last.hi")).alias("peer_hi"))
    off = F.greatest(F.log10(F.col("peer_lo")) - F.log10("value"), F.log10("value") - F.log10(F.col("peer_hi")))
    return positive.join(peers, [*key, "run_id"]).where((F.col("peers") >= least) & (off > decades)).withColumn("decades_off", off)


def duplicates(records: DataFrame) -> DataFrame:
    """Keys of records that occur more than once, and how often."""
    return records.groupBy("work_id", "field", "subject", "conditions", "value", "unit").agg(F.count("*").alias("n")).where("n > 1")


def cell_conflicts(records: DataFrame) -> DataFrame:
    """Cells (work, field, subject, conditions) with more than one value."""
    return records.groupBy("work_id", "field", "subject", "conditions").agg(F.count_distinct("value").alias("n_values")).where("n_values > 1")


def derived_gaps(records: DataFrame, group: str) -> DataFrame:
    """(group, numerator, denominator, result, decades, n): triples of fields where result / (numerator / denominator) is the
    same power of ten, not 1, for RELATED subjects or more; of the orders of one triple the first.

    A subject has a field's first value by run and ordinal; units must be known and scale only.
    """
    known = units.canonical(records.where("value is not null")).where("canonical_unit is not null and shift = 0")
    rows = known.select(group, F.lower(F.trim("subject")).alias("key"), "field", "run_id", "ordinal", (F.col("value") * F.col("scale")).alias("v")).where("key != ''")
    cells = rows.groupBy(group, "key", "field").agg(F.min_by("v", F.struct("run_id", "ordinal", "v")).alias("v")).where("v != 0")
    of = lambda f, v: cells.select(group, "key", F.col("field").alias(f), F.col("v").alias(v))
    trip = of("numerator", "a").join(of("denominator", "b"), [group, "key"]).where("numerator != denominator").join(of("result", "c"), [group, "key"]).where("result != numerator and result != denominator")
    ratio = F.col("c") / (F.col("a") / F.col("b"))
    log = F.when((ratio > 0) & (ratio < float("inf")), F.log10(ratio))
    by = trip.withColumn("l", log).where("l is not null").groupBy(group, "numerator", "denominator", "result").agg(F.min("l").alias("lo"), F.max("l").alias("hi"), F.count("*").alias("n"))
    good = by.withColumn("decades", F.floor(F.col("lo") + 0.5)).where((F.col("n") >= RELATED) & (F.col("decades") != 0) & (F.abs("decades") <= REACH) & (F.col("decades") - F.col("lo") <= TOLERANCE) & (F.col("hi") - F.col("decades") <= TOLERANCE))
    triple = F.array_sort(F.array("numerator", "denominator", "result"))
    first = F.min(F.struct("numerator", "denominator", "result", "decades", "n")).alias("x")
    return good.groupBy(group, triple.alias("triple")).agg(first).select(group, "x.*")


def scale_shifts(records: DataFrame) -> DataFrame:
    """(field, canonical_unit, run_id, n, median, others, others_median, decades): runs whose values' median lies more than
    SHIFTED decades from that of all other runs.

    All values of a field and unit are ranked once. The i-th value of the others is that of rank i plus the run's own
    values before it, so each run's two middle ones are looked up, and no run gathers the others.
    """
    key = ["field", "canonical_unit"]
    rows = canonical(records.where("value is not null")).where("canonical_unit is not null").select(*key, "run_id", F.abs("canonical_value").alias("v")).where("v > 0")
    ranked = numbered(rows, key, ["v", "run_id"], "rank")
    total = ranked.groupBy(*key).agg(F.count("*").alias("total"))
    runs = ranked.groupBy(*key, "run_id").agg(F.array_sort(F.collect_list("rank")).alias("ranks"), F.count("*").alias("n"), F.percentile("v", 0.5).alias("median")).where(F.col("n") >= RUN_VALUES)
    runs = runs.join(total, key).withColumn("others", F.col("total") - F.col("n")).where(F.col("others") >= OTHERS)
    place = lambda i: i + F.size(F.filter(F.transform("ranks", lambda r, j: r - j - 1), lambda before: before < i))
    middle = F.array(F.floor((F.col("others") + 1) / 2), F.floor((F.col("others") + 2) / 2))
    asked = runs.withColumn("rank", F.explode(F.transform(middle, place)))
    found = asked.join(ranked.select(*key, "rank", "v"), [*key, "rank"]).groupBy(*key, "run_id", "n", "median", "others").agg(F.avg("v").alias("others_median"))
    off = F.abs(F.log10(F.col("median") / F.col("others_median")))
    return found.withColumn("decades", off).where(F.col("decades") > SHIFTED)
