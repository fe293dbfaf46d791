"""The entities of an evidence corpus as views over the star-schema tables. Absent values are made where a rule says so."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that become many which one task is dealt.
DEALT = 20_000


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt out by their key, before each becomes many: a small file is one task's else. So many tasks as the rows need,
    as Spark would join tasks by the few bytes that the rows have yet."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // DEALT)), F.col(key))


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    abstract = F.when(F.col("p_partkey") % 7 != 0, F.concat_ws(" ", "p_type", "p_name"))
    return p.select(F.col("p_partkey").alias("work_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("venue"), F.col("p_type").alias("work_type"), F.when(F.col("p_partkey") % 13 != 0, F.col("p_size") + 1990).alias("year"), abstract.alias("abstract"))


def authorship(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("work_id"), F.col("l_suppkey").alias("author_id")).distinct()
    names = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("author_id"), F.col("s_name").alias("name"))
    placed = pairs.withColumn("position", F.row_number().over(W.partitionBy("work_id").orderBy("author_id")))
    return placed.join(names, "author_id")


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (citing, cited); self citations included."""
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    a = x.select("l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber"), F.col("l_partkey").alias("citing"))
    return a.join(x.withColumnRenamed("l_partkey", "cited"), ["l_orderkey", "l_linenumber"]).select("citing", "cited").distinct()


def documents_of_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document for each work, two for every third; of these either is preferred, or both."""
    p = table(spark, sf_dir, "part")
    both = p.select(F.col("p_partkey").alias("work_id"), F.explode(F.when(F.col("p_partkey") % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("k"))
    w, k = F.col("work_id"), F.col("k")
    status = F.when((w + k) % 4 == 0, "full_text").when((w + k) % 4 == 1, "abstract_only").otherwise("metadata_only")
    return both.select((w * 2 + k).alias("document_id"), "work_id", status.alias("content_status"), ((w % 3 != 0) | (k == w % 2) | (w % 15 == 0)).alias("is_preferred"))


def memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works of projects: a project for each nation, with the works that its suppliers had in an order."""
    x = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    pairs = x.select(F.col("s_nationkey").alias("project_id"), F.col("l_partkey").alias("work_id")).distinct()
    w, p = F.col("work_id"), F.col("project_id")
    kind = F.when((w + p) % 5 == 0, "unread").when((w + p) % 5 == 1, "included").when((w + p) % 5 == 2, "excluded").when((w + p) % 5 == 3, "uncertain").otherwise("read")
    return pairs.select("project_id", "work_id", F.when((w * 7 + p) % 6 != 0, (w * 37 + p * 11) % 100 / 100).alias("relevance"), kind.alias("inclusion_status"), ((w + p * 3) % 10 == 0).alias("is_reference"))


def project_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A project for each nation; its works are its customers' orders. Relevance is absent on every eleventh."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    inclusion = F.when(F.col("o_orderstatus") == "F", "included").when(F.col("o_orderstatus") == "O", "undecided").otherwise("excluded")
    return o.join(c.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("project_id")), "o_custkey").select("project_id", F.col("o_orderkey").alias("work_id"), F.when(F.col("o_orderkey") % 11 != 0, F.round(F.col("o_totalprice") / 1000, 1)).alias("relevance"), inclusion.alias("inclusion_status"))


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts with a value, from lineitem: the run is the order, superseded for every fifth."""
    x = table(spark, sf_dir, "lineitem")
    way, line = F.col("l_suppkey") % 3, F.col("l_linenumber")
    rate = F.when(way == 0, "min^-1").when(way == 1, "1/min").otherwise("min⁻¹")
    unit = F.when(line == 1, "mM").when(line == 2, F.when(way == 0, "uM").otherwise("µM")).when(line == 3, rate).when(line == 4, F.when(way == 0, "K").otherwise("kelvin")).when(line == 5, "furlong")
    value = F.when(F.col("l_linenumber") != 7, F.col("l_quantity"))
    return x.select(F.col("l_orderkey").alias("run_id"), F.col("l_partkey").alias("work_id"), F.col("l_returnflag").alias("field"), F.col("l_linenumber").alias("ordinal"), value.alias("value"), unit.alias("unit"), (F.col("l_tax") * 100 * F.col("l_discount") * 100).alias("error"), F.col("l_suppkey").cast("string").alias("subject"), F.date_format("l_shipdate", "yyyy-MM").alias("conditions"), (F.col("l_orderkey") % 5 == 0).alias("superseded"), F.col("l_linestatus").alias("kind"))


def letters(x: Column) -> Column:
    """Nine letters made from a text's hash."""
    return F.translate(F.substring(F.md5(x), 1, 9), "0123456789abcdef", "bcdfghjklmnprstv")


def surname(work: Column, k: int) -> Column:
    """The k-th author's surname of a work, one of 211."""
    return letters(F.concat(F.lit("a"), ((work * 7 + k * (k + 31) * work + k) % 211).cast("string")))


def published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works as a bibliography knows them: title, DOI for two of three, one to four authors, year, venue."""
    p = spread(table(spark, sf_dir, "part"), "p_partkey")
    w = F.col("p_partkey")
    word = lambda kind, x: F.translate(F.substring(F.md5(F.concat(F.lit(kind), x.cast("string"))), 1, 7), "0123456789abcdef", "bcdfghjklmnprstv")
    part = F.when(w % 17 == 0, ". II. ").when(w % 17 == 1, ". I. ").otherwise(" of ")
    title = F.concat("p_name", part, word("x", w), F.lit(" and "), word("y", w % 97), F.lit(" in "), word("z", F.floor(w / 2)))
    return p.select(
        w.alias("work_id"), title.alias("title"), F.when(w % 3 != 0, F.concat(F.lit("10.1234/w."), w.cast("string"))).alias("doi"), F.slice(F.array(*(surname(w, k) for k in range(4))), 1, (w % 4 + 1).cast("int")).alias("author_surnames"),
        F.when(w % 13 != 0, F.col("p_size") + 1970).alias("year"), F.concat(F.lit("Journal of "), F.initcap(F.lower("p_type")), F.lit(" "), word("v", w % 23)).alias("venue"),
    )


def bibliographies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References as printed: each customer's orders name a work each, in one of ten manners; none is wholly clean."""
    o, w = table(spark, sf_dir, "orders"), published(spark, sf_dir)
    n = table(spark, sf_dir, "part").agg(F.max("p_partkey") + 1).first()[0]
    rows = o.select((F.col("o_custkey") % n).alias("citing"), F.row_number().over(W.partitionBy(F.col("o_custkey") % n).orderBy("o_orderkey")).alias("ref_index"), (F.col("o_orderkey") * 7919 % n).alias("work_id"), (F.col("o_orderkey") % 10).alias("how"))
    # made texts are many times the file that Spark judges them by, so they aren't broadcast
    x = rows.join(w.hint("merge"), "work_id")
    how, s = F.col("how"), F.col("author_surnames")
    damaged = F.transform(s, lambda a: F.concat(F.substring(a, 1, 2), F.lit("q"), F.substring(a, F.lit(4), F.length(a))))
    cut = F.array_join(F.slice(F.split("title", " "), F.lit(1), F.size(F.split("title", " ")) - 2), " ")
    title = F.when(how.isin(5, 6, 7), None).when(how == 3, F.upper("title")).when(how == 4, cut).otherwise(F.col("title"))
    year = F.when(how == 8, F.col("year") + 1).when(how == 9, F.col("year") + 5).otherwise(F.col("year"))
    venue = F.when(how == 9, "Annals of Nothing").when(how.isin(5, 6), F.regexp_replace("venue", "Journal of ([A-Za-z]{3})[a-z]*", "J. $1.")).otherwise(F.col("venue"))
    raw = F.concat(F.array_join(F.transform(F.when(how == 6, F.slice(s, 1, 1)).otherwise(s), lambda a: F.concat(F.initcap(a), F.lit(", A."))), "; "), F.when(how == 6, " et al. ").otherwise(" "), F.when(how == 7, F.col("title")).otherwise(F.coalesce(title, F.lit(""))), F.lit(" "), venue)
    doi = F.when(how == 0, F.concat(F.lit("https://doi.org/"), F.upper("doi"), F.lit(".")))
    names = F.when(how == 2, damaged).when(how == 7, F.slice(s, 1, 0)).otherwise(s)
    return x.select("citing", "ref_index", doi.alias("doi"), title.alias("title"), names.alias("surnames"), year.alias("year"), venue.alias("venue"), raw.alias("raw"))


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, text): a paper for each bibliography: a paragraph for each reference, then the list in one of five styles, with
    a heading or none, running heads between entries and a section after it."""
    r = bibliographies(spark, sf_dir)
    i, style = F.col("ref_index"), F.col("citing") % 5
    mark = lambda x: F.when(style == 2, F.concat(F.lit("("), x, F.lit(")"))).otherwise(F.concat(F.lit("["), x, F.lit("]")))
    n = lambda k: (i + k).cast("string")
    odd = F.when(i % 5 == 0, F.concat(F.lit(", as eq "), mark(n(0)))).when(i % 5 == 1, F.concat(F.lit(", not "), mark(F.lit("4-400")))).otherwise("")
    said = F.concat(F.lit("Paragraph "), n(0), F.lit(" follows the earlier work "), mark(n(0)), odd, F.lit(" in all that matters here. Others "), mark(F.when(i % 2 == 0, F.concat(n(0), F.lit("-"), n(2))).otherwise(F.concat(n(0), F.lit(", "), n(1)))), F.lit(" found the same in other places."))
    names = F.when(F.size("surnames") > 0, F.array_join(F.transform("surnames", lambda a: F.concat(F.initcap(a), F.lit(", A."))), "; ")).otherwise("Anon, X.")
    entry = F.concat(names, F.lit(" "), F.coalesce("title", F.lit("Abstr.")), F.lit(" "), n(0), F.lit(".\n"), "venue", F.lit(" 12, "), n(100), F.lit("–"), n(110), F.coalesce(F.concat(F.lit(" doi:"), F.regexp_replace(F.lower("doi"), r"^https://doi.org/|\.$", "")), F.lit("")), F.lit(" ("), F.coalesce(F.col("year").cast("string"), F.lit("1999")), F.lit(")."))
    lead = F.when(style == 0, F.concat(n(0), F.lit(". "))).when(style == 1, F.concat(F.lit("["), n(0), F.lit("] "))).when(style == 2, F.concat(F.lit("("), n(0), F.lit(") "))).when(style == 3, F.concat(n(0), F.lit(" "))).otherwise("")
    head = F.when((i % 3 == 0) & (style < 4), F.concat(F.lit("\nImaginary Results Reports "), n(30))).otherwise("")
    row = F.struct("ref_index", said.alias("said"), F.concat(lead, entry, head).alias("entry"))
    all_ = r.groupBy("citing").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    kind = F.col("citing") % 4
    heading = F.when(kind == 0, "References\n").when(kind == 1, "REFERENCES AND NOTES\n").when(kind == 2, "R EFERENCES\n").otherwise("")
    text = F.concat(F.array_join(F.transform("rows", lambda x: x["said"]), "\n\n"), F.lit("\n\n"), heading, F.array_join(F.transform("rows", lambda x: x["entry"]), "\n"), F.lit("\nAcknowledgements\nWe thank all who helped."))
    return all_.select(F.col("citing").alias("id"), text.alias("text"))


def kinetics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three fields of five subjects of each work: a rate, a constant and their quotient, which is off by a power of ten in
    three works of four, and by no power in some."""
    p = spread(table(spark, sf_dir, "part"), "p_partkey")
    w, k = F.col("p_partkey"), F.col("k")
    rows = p.select(w, F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k"))
    a, b = (10 + w * (k + 1) % 7).cast("double"), (1 + (w + k) % 5).cast("double")
    c = a / b * F.pow(F.lit(10.0), w % 4) * F.when((w % 5 == 0) & (k == 2), 1.3).otherwise(1.0)
    row = lambda field, value, unit: F.struct(F.lit(field).alias("field"), value.alias("value"), F.lit(unit).alias("unit"))
    each = rows.select(w.alias("work_id"), w.alias("run_id"), k.alias("ordinal"), F.concat(F.lit(" S"), k).alias("subject"), F.explode(F.array(row("kcat", a, "s^-1"), row("Km", b, "mM"), row("eff", c, "mM  1 s  1"))).alias("x"))
    return each.select("work_id", "run_id", "ordinal", "subject", "x.*")
