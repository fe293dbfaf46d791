"""Extracted records as a reader sees them: the joined view with its status, readings by field, and tables to take away."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliospark.functions import text as T

#: Columns of an exported table, in order.
COLUMNS = ("work_id", "title", "year", "schema_key", "field_key", "subject", "conditions", "quantity", "value", "value_text", "unit", "canonical_unit", "canonical_value", "status", "kind", "quote", "page", "section", "run_id", "fact_id", "measurement_id")
BOM = "﻿"


def status_of(kind: Column, verifier: Column, failed: Column) -> Column:
    """conflict before invalid, where the run's verifier failed, before review, where a check of the record did, before validated."""
    return F.when(kind == "conflict", "conflict").when(verifier == "failed", "invalid").when(failed, "review").otherwise("validated")


def view(facts: DataFrame, runs: DataFrame, measurements: DataFrame, fields: DataFrame, checks: DataFrame, works: DataFrame, spans: DataFrame | None = None) -> DataFrame:
    """One row for each fact and measurement of the current runs: quantity, value and text from the measurement or else the
    fact, the field of either, and the status.

    facts: fact_id, run_id, kind, predicate, subject, value_text, field_id, span_id; runs: run_id, work_id, project_id,
    superseded, verifier, run_type; measurements: measurement_id, fact_id, quantity, value, value_text, unit, conditions,
    field_id; fields: field_id, field_key, schema_key, sort_order; checks: fact_id, measurement_id, status; spans: span_id,
    quote, page, section. A fact without a measurement counts if its run is an extraction.
    """
    bad = checks.where("status = 'failed'")
    by_fact = bad.where("fact_id is not null").select("fact_id").distinct().withColumn("bad_fact", F.lit(True))
    by_measurement = bad.where("measurement_id is not null").select("measurement_id").distinct().withColumn("bad_measurement", F.lit(True))
    f = facts.select("fact_id", "run_id", "kind", "predicate", "subject", F.col("value_text").alias("f_text"), F.col("field_id").alias("f_field"), "span_id")
    m = measurements.select("measurement_id", "fact_id", "quantity", "value", F.col("value_text").alias("m_text"), "unit", "conditions", F.col("field_id").alias("m_field"))
    x = f.join(runs.where("not superseded").drop("superseded"), "run_id").join(m, "fact_id", "left").where("measurement_id is not null or run_type = 'extraction'")
    x = x.withColumns({"field_id": F.coalesce("f_field", "m_field"), "quantity": F.coalesce("quantity", "predicate"), "value_text": F.coalesce("m_text", "f_text")}).drop("f_field", "m_field", "m_text", "f_text", "predicate")
    x = x.join(works.select("work_id", "title", "year"), "work_id").join(F.broadcast(fields), "field_id", "left").join(by_fact, "fact_id", "left").join(by_measurement, "measurement_id", "left")
    if spans is not None:
        x = x.join(spans.select("span_id", "quote", "page", "section"), "span_id", "left")
    failed = F.coalesce("bad_fact", F.lit(False)) | F.coalesce("bad_measurement", F.lit(False))
    return x.withColumn("status", status_of(F.col("kind"), F.col("verifier"), failed)).drop("bad_fact", "bad_measurement")


def in_project(rows: DataFrame, project: int) -> DataFrame:
    """Rows of a project, and of project 0, which every one has."""
    return rows.where(F.col("project_id").isin(project, 0))


def reading() -> Column:
    return F.concat_ws("|", F.lower(F.trim(F.coalesce("subject", F.lit("")))), F.lower(F.trim(F.coalesce("conditions", F.lit("")))))


def readings(rows: DataFrame, order: list[str]) -> DataFrame:
    """(work_id, field_id, reading, ..., depth, paper_level): the first row of each work, field and reading by ``order``.

    depth is the number of a work's readings, 1 at least; a field with one reading in a work with more is the paper's own.
    Rows without a field have no cell; ``unassigned`` gives them.
    """
    own = rows.where("field_id is not null").withColumn("reading", reading())
    rest = [c for c in own.columns if c not in ("work_id", "field_id", "reading")]
    first = own.groupBy("work_id", "field_id", "reading").agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("x")).select("work_id", "field_id", "reading", "x.*")
    depth = first.groupBy("work_id").agg(F.count_distinct("reading").alias("depth"))
    per = first.groupBy("work_id", "field_id").agg(F.count("*").alias("own"))
    x = first.join(depth, "work_id").join(per, ["work_id", "field_id"])
    return x.withColumn("paper_level", (F.col("own") == 1) & (F.col("depth") > 1)).drop("own")


def unassigned(rows: DataFrame) -> DataFrame:
    return rows.where("field_id is null")


def exported(rows: DataFrame) -> DataFrame:
    """The table to take away: all COLUMNS, absent ones null."""
    return rows.select(*(F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in COLUMNS))


def csv_lines(table: DataFrame, order: list[str]) -> DataFrame:
    """(line_no, line) of a CSV file: a header with a byte order mark, then a line for each row in order; every line ends with
    CR and LF. Cells are quoted if they hold a comma, quote or line break or begin or end with white space; absent ones are
    empty. Rows are numbered over all partitions, so no task holds the file."""
    from foliospark.operators.ranking import numbered

    def cell(c: str) -> Column:
        x = F.coalesce(F.col(c).cast("string"), F.lit(""))
        return F.when(x.rlike(r'[",\r\n]|^\s|\s$'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)

    end = F.lit("\r\n")
    rows = numbered(table.select(*order, F.concat(F.concat_ws(",", *(cell(c) for c in table.columns)), end).alias("line")).withColumn("g", F.lit(0)), ["g"], order, "line_no")
    head = table.sparkSession.createDataFrame([(0, BOM + ",".join(table.columns) + "\r\n")], "line_no long, line string")
    return head.union(rows.select("line_no", "line"))


def project_json(projects: DataFrame, members: DataFrame, rows: DataFrame) -> DataFrame:
    """(project_id, json): a project with its works, and each work's records; works and records in order of their ids."""
    record = F.struct("fact_id", "measurement_id", "field_key", "subject", "value", "unit", "status")
    by_work = rows.groupBy("work_id").agg(F.array_sort(F.collect_list(record)).alias("records"))
    work = F.struct("work_id", "inclusion_status", F.coalesce("records", F.array().cast("array<struct<fact_id:bigint,measurement_id:bigint,field_key:string,subject:string,value:double,unit:string,status:string>>")).alias("records"))
    own = members.join(by_work, "work_id", "left").groupBy("project_id").agg(F.array_sort(F.collect_list(work)).alias("works"))
    return projects.join(own, "project_id", "left").select("project_id", F.to_json(F.struct("project_id", "name", "works")).alias("json"))


def number_missing(rows: DataFrame, numeric: list[str]) -> DataFrame:
    """Records of numeric fields without a number, whose text neither reports an absence nor reads as a quantity."""
    return rows.where(F.col("field_key").isin(numeric) & F.col("value").isNull() & ~T.reports_absence(F.col("value_text")) & ~T.reads_as_quantity(F.col("value_text")))


def bound_as_figure(rows: DataFrame) -> DataFrame:
    """Records with a number whose text is one letter before a figure: a sign may have been lost."""
    return rows.where(F.col("value").isNotNull() & F.trim("value_text").rlike(r"^[A-Za-z]\s*[~≈]?\s*\d"))


def sibling_confusion(rows: DataFrame) -> DataFrame:
    """(work_id, fact_id, subject, sibling): facts whose quotation doesn't name their subject but another of the work with the
    same stem and another number; of several the least. Subjects meet by work and stem, not all with all."""
    flat = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")
    x = rows.where("subject is not null").select("work_id", "fact_id", "subject", "quote", flat("subject").alias("s"))
    x = x.withColumns({"stem": F.regexp_extract("s", r"^(.*?)(\d+)$", 1), "num": F.regexp_extract("s", r"^(.*?)(\d+)$", 2)}).where(F.length("stem") >= 2)
    names = x.select("work_id", "stem", F.col("subject").alias("sibling"), F.col("s").alias("z"), F.col("num").alias("n2")).distinct()
    q = x.where("quote is not null").withColumn("q", flat("quote")).where(~F.contains("q", F.col("s")))
    met = q.join(names, ["work_id", "stem"]).where((F.col("num") != F.col("n2")) & (F.col("subject") != F.col("sibling")) & F.contains("q", F.col("z")))
    return met.groupBy("work_id", "fact_id", "subject").agg(F.min("sibling").alias("sibling"))


HEDGE = r"(?i)\b(?:appears?\s+to|appear|may\s+be|might\s+be|seems?\s+to|seems|suggests?|possibly|probably|likely|perhaps|unclear|cannot\s+tell|hard\s+to\s+tell|not\s+certain|uncertain|presumably|apparently|could\s+be)\b"


def settled(verdict: Column, note: Column) -> Column:
    """What an answer counts as: a problem that is hedged isn't one."""
    return F.when(verdict == "ok", "passed").when((verdict == "unclear") | F.coalesce(note, F.lit("")).rlike(HEDGE), "skipped").otherwise("failed")


def batched(questions: DataFrame, size: int = 8) -> DataFrame:
    """Adds ``batch``: questions of one kind about one passage are asked together, ``size`` at a time, in order of their ids."""
    w = W.partitionBy("passage", "kind").orderBy("question_id")
    return questions.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size))
