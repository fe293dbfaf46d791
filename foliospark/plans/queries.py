"""The library's queries over the driver's tables, each a thin application of operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliospark.functions import text as T
from foliospark.operators import graph, ranking, records, search, vectors
from foliospark.sources import entities as E
from foliospark.streaming import usage

FILTERS = search.Filters(query="ring | plate", venue=("Brand#1", "Brand#2", "Brand#17", "Brand#4"), year=("2020–1995", "2030"), min_citations=5)
UNITED = ("Brand#1",)


def corpus(s: SparkSession, d: str):
    return E.works(s, d), E.citations(s, d), E.authorship(s, d)


def q_search(s, d):
    w, c, a = corpus(s, d)
    return search.search(w, c, a, FILTERS, limit=50, offset=10)


def q_search_count(s, d):
    w, c, _ = corpus(s, d)
    return search.count(w, c, FILTERS)


def q_facets(s, d):
    w, c, _ = corpus(s, d)
    return search.facets(w, c, FILTERS)


def q_project_overview(s, d):
    p = E.project_works(s, d)
    one = lambda c: F.count_if(c)
    return p.groupBy("project_id").agg(F.count("*").alias("works"), F.count("relevance").alias("ranked"), one(F.col("inclusion_status") == "undecided").alias("undecided"), one(F.col("inclusion_status") != "undecided").alias("decided"), one(F.col("inclusion_status") == "included").alias("included"))


def q_normalised_rank(s, d):
    return ranking.normalised_rank(E.project_works(s, d), "project_id", "relevance").select("project_id", "work_id", "relevance", F.round("rank", 6).alias("rank"))


def q_relevance_bands(s, d):
    out = ranking.bands(E.project_works(s, d), "project_id", "relevance")
    return out.groupBy("project_id", "band").agg(F.count("*").alias("n"), F.min("relevance").alias("least"))


def q_top_per_project(s, d):
    order = [F.desc_nulls_last("relevance"), F.asc("work_id")]
    return ranking.top_per_group(E.project_works(s, d), "project_id", order, 5).select("project_id", "work_id", "relevance", "rn")


def q_history(s, d):
    e = E.table(s, d, "events").select("event_id", "user_id", "event_type", "ts", F.get_json_object("props", "$.k").cast("long").alias("k"))
    out = ranking.newest_per_group(e, "user_id", [F.desc("ts"), F.desc("event_id")], ["event_type", "k"], 25)
    return out.select("user_id", "event_id", "event_type", "k", "rn")


def q_text_page(s, d):
    lines = E.table(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("idx", "line"))
    out = ranking.budgeted(lines.withColumn("chars", F.length("line")), "doc_id", "idx", "chars", 2000)
    return out.groupBy("doc_id").agg(F.count("*").alias("lines"), F.sum("chars").cast("long").alias("chars"))


def q_span_merge(s, d):
    x = E.table(s, d, "lineitem")
    start = F.datediff("l_shipdate", F.lit("1992-01-01")).cast("long")
    return ranking.merged_spans(x.select(F.col("l_suppkey").alias("supplier"), start.alias("s"), (start + F.floor(F.col("l_quantity") / 20)).alias("e")), "supplier", "s", "e")


def q_median(s, d):
    m = E.measurements(s, d)
    return m.groupBy("field", "unit").agg(F.round(F.percentile("value", 0.5), 6).alias("median"), F.count("value").alias("n"))


def q_latest_turn(s, d):
    c = E.table(s, d, "conversations")
    return c.groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max_by("role", "turn").alias("role"), F.count("*").alias("turns"))


def q_conversation(s, d):
    c = E.table(s, d, "conversations")
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", F.length("text").alias("n"))))
    return c.groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda x: F.concat_ws(":", x["turn"].cast("string"), x["role"], x["n"].cast("string"))), ",").alias("turns"))


def scored(s, d):
    relevance = F.when(F.col("work_id") % 9 != 0, (F.col("work_id") * 37 % 100) / 100)
    return E.works(s, d).select("work_id", relevance.alias("relevance"))


def q_project_graph(s, d):
    return graph.project_graph(scored(s, d), E.citations(s, d), 0.5, 100)


def q_cited_by(s, d):
    return graph.cited_by(E.citations(s, d), scored(s, d).where("relevance >= 0.3").select("work_id"))


def q_reachable(s, d):
    from foliospark.plans.session import checkpoint_dir

    checkpoint_dir(s)
    e = E.citations(s, d)
    start = E.works(s, d).where("work_id < 3").select(F.col("work_id").alias("node"))
    return graph.reachable(e, start)


def q_records(s, d):
    m = records.status(records.canonical(E.measurements(s, d).where("not superseded")))
    return m.select("run_id", "work_id", "field", "ordinal", "value", "unit", "canonical_unit", F.round("canonical_value", 6).alias("canonical_value"), "subject", "conditions", "status")


def q_status_summary(s, d):
    return records.status(E.measurements(s, d).where("not superseded")).groupBy("status").agg(F.count("*").alias("n"), F.count_distinct("work_id").alias("works"))


def q_matrix(s, d):
    out = records.matrix(E.measurements(s, d).where("not superseded and value is not null"), ["A", "N", "R"])
    return out.select("work_id", "reading", F.col("A").alias("field_a"), F.col("N").alias("field_n"), F.col("R").alias("field_r"))


def q_coverage(s, d):
    return records.coverage(E.measurements(s, d).where("not superseded"), E.works(s, d))


def q_unit_outvoted(s, d):
    m = records.canonical(E.measurements(s, d).where("not superseded"))
    return records.unit_outvoted(m, 5, 0.5).groupBy("field", "canonical_unit", "dominant").agg(F.count("*").alias("n"))


def q_error_exceeds(s, d):
    out = records.error_exceeds(E.measurements(s, d))
    return out.groupBy("field").agg(F.count("*").alias("n"), F.round(F.max("error"), 4).alias("largest"))


def q_outliers(s, d):
    m = E.measurements(s, d).where("value is not null and unit is not null").withColumn("value", F.when((F.col("run_id") == 6) | (F.col("run_id") == 11), F.col("value") * 1e5).otherwise(F.col("value")))
    return records.outliers(m, 3.0).select("field", "unit", "run_id", "work_id", "value", F.round("decades_off", 6).alias("decades_off"))


def q_duplicates(s, d):
    return records.duplicates(E.measurements(s, d).withColumn("work_id", F.col("work_id") % 20))


def q_cell_conflicts(s, d):
    return records.cell_conflicts(E.measurements(s, d).withColumn("subject", (F.col("subject").cast("long") % 10).cast("string")))


def q_fingerprints(s, d):
    m = E.measurements(s, d)
    return m.select("run_id", "ordinal", F.sha2(T.fingerprint(F.col("field"), F.col("subject"), F.col("conditions"), F.col("unit"), F.col("kind")), 256).alias("hash")).groupBy("hash").agg(F.count("*").alias("n"))


def q_membership_hash(s, d):
    return E.project_works(s, d).where("inclusion_status = 'included'").groupBy("project_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_set(F.col("work_id").cast("string"))), ","), 256).alias("hash"))


def q_unplanned_works(s, d):
    planned = E.table(s, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("work_id"))
    return E.project_works(s, d).where("inclusion_status != 'excluded'").join(planned, "work_id", "left_anti").select("project_id", "work_id")


def q_storage(s, d):
    x = E.table(s, d, "orders").groupBy("o_custkey").agg(F.sum(F.round("o_totalprice").cast("long")).alias("bytes"), F.count("*").alias("files")).where("bytes > 500000")
    c = E.table(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("project_id"))
    return c.join(x, "o_custkey", "left").groupBy("project_id").agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.coalesce(F.sum("files"), F.lit(0)).alias("files"))


def q_daily_usage(s, d):
    return usage.daily(E.table(s, d, "events"))


def q_daily_usage_stream(s, d):
    from foliospark.plans.session import checkpoint_dir

    path, name = f"{checkpoint_dir(s)}/usage-{__import__('uuid').uuid4().hex}", "daily_usage"
    batch = s.read.parquet(f"{d}/events.parquet")
    events = s.readStream.schema(batch.schema).parquet(f"{d}/events.parquet*")
    save = lambda sums, number: sums.write.mode("overwrite").parquet(f"{path}/{name}")
    q = usage.daily_stream(events).writeStream.outputMode("complete").foreachBatch(save).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return s.read.schema("day date, event_type string, n long, total double, k_sum long").parquet(f"{path}/{name}")


def q_nearest(s, d):
    e = E.table(s, d, "embeddings")
    return vectors.nearest(e, e.where("vec_id % 100 = 0"), 10).select("query_id", "vec_id", F.col("rn").cast("long").alias("rn"), F.round("score", 4).alias("score"))


def q_preferred_document(s, d):
    doc = E.documents_of_works(s, d)
    best = F.struct(F.when(F.col("is_preferred"), 0).otherwise(1), F.col("document_id"))
    return doc.groupBy("work_id").agg(F.min_by("document_id", best).alias("document_id"), F.min_by("content_status", best).alias("content_status"), F.count("*").alias("documents"))


def q_title_groups(s, d):
    w = E.works(s, d).withColumn("key", T.normal_title(F.col("title")))
    return w.groupBy("key").agg(F.min("work_id").alias("head"), F.count("*").alias("members"), F.max("year").alias("latest"))


def q_token_overlap(s, d):
    b = E.table(s, d, "benchmark").select("item_id", T.tokens(F.col("text")).alias("t"))
    target = F.lit(b.where("item_id = 0").agg(F.min("t")).first()[0])  # the tokens of one text
    out = b.where("item_id != 0").select("item_id", F.size(F.array_intersect("t", target)).cast("long").alias("overlap"), F.round(T.dice(F.col("t"), target), 6).alias("dice"))
    return out.orderBy(F.desc("overlap"), "item_id").limit(8)


def q_page_titles(s, d):
    p = E.table(s, d, "pages")
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return p.select("page_id", title.alias("title"), F.length(F.regexp_replace("html", "<[^>]*>", "")).cast("long").alias("plain_chars"))


def q_csv_rows(s, d):
    c = E.table(s, d, "customer")
    return c.select("c_custkey", F.concat(T.csv_cell(F.col("c_custkey")), F.lit(","), T.csv_cell(F.concat(F.col("c_name"), F.when(F.col("c_custkey") % 3 == 0, ', "x"').otherwise(""))), F.lit(","), T.csv_cell(F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment"))), F.lit("\r\n")).alias("line"))


def q_claim_order(s, d):
    e = E.table(s, d, "events").where("event_type != 'error'")
    blocked = E.table(s, d, "events").where("event_type = 'error'").select("user_id", F.to_date("ts").alias("day")).distinct()
    free = e.withColumn("day", F.to_date("ts")).join(blocked, ["user_id", "day"], "left_anti")
    return free.orderBy("event_type", "event_id").limit(20).select("event_id", "user_id", "event_type")


QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}
