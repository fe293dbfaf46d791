"""Queries on extracted records, their checks and tables, pasted identifiers and jobs, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.functions import text as T
from foliospark.operators import extraction, hits, jobs
from foliospark.plans.corpus import MEMBERS
from foliospark.plans.documents import RUNS, STAGES, history
from foliospark.plans.literature import PUBLISHED, loose
from foliospark.plans.oracle import WORKS
from foliospark.plans.session import checkpoint_dir
from foliospark.sources import entities as E

NOW = "2024-06-01 00:00:00"


def store(s, d):
    """Facts from orders, none to two measurements each, runs of customers, checks from events."""
    o, c = E.table(s, d, "orders"), E.table(s, d, "customer")
    n = E.table(s, d, "part").agg(F.max("p_partkey") + 1).first()[0]
    i, k = F.col("o_orderkey"), F.col("k")
    words = F.when(i % 5 == 0, "not detected").when(i % 5 == 1, "about 12 units").when(i % 5 == 2, "N 95").when(i % 5 == 3, "some text")
    facts = o.select(i.alias("fact_id"), F.col("o_custkey").alias("run_id"), F.when(F.col("o_orderstatus") == "P", "conflict").otherwise("stated").alias("kind"), F.col("o_orderpriority").alias("predicate"), F.concat(F.lit("KE"), (i % 7).cast("string")).alias("subject"), words.alias("value_text"), F.when(i % 5 != 4, i % 5).alias("field_id"), i.alias("span_id"))
    each = o.where("o_orderkey % 3 > 0").select("o_orderkey", "o_totalprice", "o_orderpriority", F.explode(F.sequence(F.lit(0).cast("long"), i % 3 - 1)).alias("k"))
    measurements = each.select((i * 10 + k).alias("measurement_id"), i.alias("fact_id"), F.when(k == 0, "Q").alias("quantity"), F.when(i % 9 != 0, F.floor("o_totalprice").cast("double")).alias("value"), F.when(i % 2 == 0, F.concat(F.lit("b "), i.cast("string"))).alias("value_text"), F.when(k == 0, "mM").otherwise("min^-1").alias("unit"), F.col("o_orderpriority").alias("conditions"), k.alias("field_id"))
    runs = c.select(F.col("c_custkey").alias("run_id"), (F.col("c_custkey") % n).alias("work_id"), F.col("c_nationkey").cast("long").alias("project_id"), (F.col("c_custkey") % 6 == 0).alias("superseded"), F.when(F.col("c_custkey") % 11 == 0, "failed").otherwise("passed").alias("verifier"), F.when(F.col("c_custkey") % 4 != 0, "extraction").otherwise("summary").alias("run_type"))
    e = F.col("event_id")
    checks = E.table(s, d, "events").select(F.when(e % 2 == 0, e).alias("fact_id"), F.when(e % 2 == 1, e * 10).alias("measurement_id"), F.when(e % 3 == 0, "failed").otherwise("passed").alias("status"))
    fields = s.createDataFrame([(0, "yield", "A", 2), (1, "rate", "A", 1), (2, "km", "B", 0), (3, "ph", "B", 1)], "field_id long, field_key string, schema_key string, sort_order int")
    spans = o.select(i.alias("span_id"), F.concat(F.lit("Here KE"), ((i + F.when(i % 4 == 0, 1).otherwise(0)) % 7).cast("string"), F.lit(" is \"seen\", twice")).alias("quote"), (i % 9).cast("int").alias("page"), F.when(i % 2 == 0, "results").alias("section"))
    return extraction.view(facts, runs, measurements, fields, checks, E.works(s, d), spans)


def q_record_view(s, d):
    return store(s, d).select("fact_id", "measurement_id", "work_id", "project_id", "quantity", "value", "value_text", "field_key", "status")


def q_record_status(s, d):
    return extraction.in_project(store(s, d), 3).groupBy("status").agg(F.count("*").alias("n"), F.count_distinct("work_id").alias("works"))


def q_record_readings(s, d):
    out = extraction.readings(store(s, d), ["measurement_id", "fact_id"])
    return out.select("work_id", "field_id", "reading", "fact_id", "measurement_id", "depth", "paper_level")


def q_record_csv(s, d):
    checkpoint_dir(s)
    table = extraction.exported(store(s, d)).select("fact_id", "measurement_id", "subject", "value_text", "quote", "status").withColumn("value_text", F.when(F.col("fact_id") % 3 == 0, F.concat("value_text", F.lit(" "))).otherwise(F.col("value_text")))
    return extraction.csv_lines(table.withColumn("measurement_id", F.coalesce("measurement_id", F.lit(0))), ["fact_id", "measurement_id"])


def q_number_missing(s, d):
    return extraction.number_missing(store(s, d), ["yield", "rate", "ph"]).groupBy("field_key", "value_text").agg(F.count("*").alias("n"))


def q_bound_as_figure(s, d):
    return extraction.bound_as_figure(store(s, d)).select("fact_id", "measurement_id", "value_text")


def q_sibling_confusion(s, d):
    return extraction.sibling_confusion(store(s, d))


def q_identifiers(s, d):
    c = E.table(s, d, "customer").select("c_custkey")
    k = F.col("c_custkey")
    x = k.cast("string")
    how = k % 9
    said = F.when(how == 0, F.concat(F.lit(" https://doi.org/10.1234/AB."), x)).when(how == 1, F.concat(F.lit("arXiv: 2301.0"), F.lpad(x, 4, "0"))).when(how == 2, F.concat(F.lit("https://arxiv.org/pdf/2301.0"), F.lpad(x, 4, "0"), F.lit(".pdf"))).when(how == 3, F.concat(F.lit("PMID: "), x)).when(how == 4, F.concat(F.lit("pubmed.ncbi.nlm.nih.gov/"), x, F.lit("/"))).when(how == 5, F.concat(F.lit("cond-mat/"), F.lpad(x, 7, "0"))).when(how == 6, F.concat(F.lit("27"), F.lpad(x, 6, "0"))).when(how == 7, F.concat(F.lit("A title of "), x))
    return c.select("c_custkey", T.identifier(said).alias("i")).select("c_custkey", "i.kind", "i.value")


def planned(s, d):
    """Jobs of works and stages in all states, and what they wait for."""
    w, n = F.col("work_id"), F.col("n")
    each = E.spread(E.works(s, d), "work_id").select("work_id", F.posexplode(F.array(*(F.lit(x.name) for x in STAGES))).alias("n", "stage")).withColumn("h", (w * 13 + n * 7) % 19)
    status = F.when(F.col("h") < 8, "done").when(F.col("h") < 13, "queued").when(F.col("h") == 13, "running").when(F.col("h") == 14, "failed").when(F.col("h") < 18, "cancelled").otherwise("review")
    all_ = each.select((w * 10 + n).alias("job_id"), "work_id", (w % 5).alias("project_id"), "stage", status.alias("status"), (w % 17 == 0).alias("cancel_requested"), F.when(w % 6 == 0, F.lit("2024-07-01").cast("timestamp")).alias("run_after"), (w % 7).cast("int").alias("attempts"), (w % 3).cast("int").alias("priority"))
    return all_, jobs.dependencies(all_, STAGES)


def q_planned_jobs(s, d):
    all_, _ = planned(s, d)
    runs, _, _ = history(s, d)
    works = E.spread(E.works(s, d), "work_id").select("work_id", (F.col("work_id") % 5).alias("project_id"))
    return jobs.planned(works, STAGES, all_.withColumn("job_key", jobs.key()), runs.where("not superseded")).groupBy("stage").agg(F.count("*").alias("n"), F.sum("work_id").alias("ids"))


def q_blocked_jobs(s, d):
    return jobs.blocked(*planned(s, d)).where("status = 'queued'").select("job_id", "live_blockers", "dead_blockers")


def q_ready_jobs(s, d):
    return jobs.ready(*planned(s, d), STAGES, NOW).where("turn <= 5").select("project_id", "turn", "job_id", "stage")


def q_retried_jobs(s, d):
    checkpoint_dir(s)
    all_, waits = planned(s, d)
    return jobs.retried(all_, waits, all_.where("status = 'failed'").select("job_id")).groupBy("stage", "status").agg(F.count("*").alias("n"), F.sum("job_id").alias("ids"))


def q_stage_rollup(s, d):
    return jobs.rollup(planned(s, d)[0])


def found(s, d):
    """Hits of a search, from orders: some are works by DOI or title, some are new, some are nothing."""
    p, o = E.published(s, d), E.table(s, d, "orders")
    n = E.table(s, d, "part").agg(F.max("p_partkey") + 1).first()[0]
    i = F.col("o_orderkey")
    x = o.select(i.alias("hit_id"), (i * 7919 % (n * 2)).alias("work_id"), (i % 6).alias("how")).join(p, "work_id", "left")
    how = F.col("how")
    doi = F.when(how == 0, F.upper("doi")).when(how == 1, F.concat(F.lit("https://doi.org/10.1101/"), (F.col("work_id") % 50).cast("string")))
    title = F.when(how == 2, F.upper("title")).when(how == 3, F.concat(F.lit("New title "), (F.col("work_id") % 40).cast("string"))).when(how == 4, F.col("title"))
    return x.select("hit_id", title.alias("title"), doi.alias("doi"), F.when(how != 4, 2001).alias("year"), F.when(how == 4, "Elsewhere").alias("venue"), F.concat(F.lit("Abstract "), F.col("hit_id").cast("string")).alias("abstract"))


def known(s, d):
    return E.published(s, d).select("work_id", "title", "doi", "year", "venue", F.lit(None).cast("string").alias("abstract"))


def q_hits_resolved(s, d):
    members = E.memberships(s, d).where("project_id = 3")
    out = hits.in_project(found(s, d), known(s, d), members)
    return out.select("hit_id", "work_id", "member", hits.is_preprint(F.col("doi")).alias("preprint"))


def q_works_upserted(s, d):
    checkpoint_dir(s)
    return hits.upserted(known(s, d), found(s, d)).select("work_id", "title", "doi", "year", "venue", "abstract")


DESK = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}

VIEW = f"""{WORKS}, fa AS (SELECT *, o_orderkey AS fact_id, CASE WHEN o_orderkey % 5 <> 4 THEN o_orderkey % 5 END AS ff, CASE o_orderkey % 5 WHEN 0 THEN 'not detected' WHEN 1 THEN 'about 12 units' WHEN 2 THEN 'N 95' WHEN 3 THEN 'some text' END AS words FROM orders),
me AS (SELECT o_orderkey AS fact_id, k, o_orderkey * 10 + k AS measurement_id, CASE WHEN o_orderkey % 9 <> 0 THEN floor(o_totalprice) END AS value, CASE WHEN o_orderkey % 2 = 0 THEN 'b ' || o_orderkey END AS mt FROM orders, (SELECT unnest([0, 1]) AS k) WHERE k < o_orderkey % 3),
ru2 AS (SELECT c_custkey AS run_id, c_custkey % (SELECT max(p_partkey) + 1 FROM part) AS work_id, c_nationkey AS project_id, c_custkey % 11 = 0 AS bad_run, c_custkey % 4 <> 0 AS ext FROM customer WHERE c_custkey % 6 <> 0),
fi AS (SELECT unnest([0, 1, 2, 3]) AS field_id, unnest(['yield', 'rate', 'km', 'ph']) AS field_key), bad AS (SELECT event_id FROM events WHERE event_id % 3 = 0),
vw AS MATERIALIZED (SELECT fa.fact_id, measurement_id, ru2.work_id, CAST(ru2.project_id AS BIGINT) AS project_id, coalesce(CASE WHEN k = 0 THEN 'Q' END, o_orderpriority) AS quantity, value, coalesce(mt, words) AS value_text, coalesce(ff, k) AS field_id, 'KE' || (fa.fact_id % 7) AS subject, CASE WHEN k IS NOT NULL THEN o_orderpriority END AS conditions, 'Here KE' || ((fa.fact_id + CASE WHEN fa.fact_id % 4 = 0 THEN 1 ELSE 0 END) % 7) || ' is "seen", twice' AS quote,
CASE WHEN o_orderstatus = 'P' THEN 'conflict' WHEN bad_run THEN 'invalid' WHEN fa.fact_id % 2 = 0 AND fa.fact_id IN (FROM bad) OR measurement_id % 10 = 0 AND (measurement_id // 10) % 2 = 1 AND measurement_id // 10 IN (FROM bad) THEN 'review' ELSE 'validated' END AS status
FROM fa JOIN ru2 ON run_id = o_custkey JOIN works w ON w.work_id = ru2.work_id LEFT JOIN me USING (fact_id) WHERE measurement_id IS NOT NULL OR ext)"""
READING = "lower(trim(coalesce(subject, ''))) || '|' || lower(trim(coalesce(conditions, '')))"
PLAN = f"""{WORKS}, st AS (SELECT unnest(range(0, 7)) AS n, unnest(['fetch', 'parse', 'clean', 'segment', 'references', 'embed', 'callouts']) AS stage), wt AS (SELECT unnest([1, 2, 3, 3, 4, 4, 5, 6, 6]) AS a, unnest([0, 1, 1, 2, 1, 2, 3, 3, 4]) AS b),
jo0 AS (SELECT work_id, n, stage, (work_id * 13 + n * 7) % 19 AS h FROM works, st), jo AS MATERIALIZED (SELECT work_id * 10 + n AS job_id, work_id, n, work_id % 5 AS project_id, stage, CASE WHEN h < 8 THEN 'done' WHEN h < 13 THEN 'queued' WHEN h = 13 THEN 'running' WHEN h = 14 THEN 'failed' WHEN h < 18 THEN 'cancelled' ELSE 'review' END AS status FROM jo0),
dp AS MATERIALIZED (SELECT x.job_id, y.job_id AS on_id, y.status AS on_status FROM jo x JOIN wt ON a = x.n JOIN jo y ON y.work_id = x.work_id AND y.n = b)"""
CELL = "CASE WHEN regexp_matches({0}, '[\",\\r\\n]|^\\s|\\s$') THEN '\"' || replace({0}, '\"', '\"\"') || '\"' ELSE coalesce({0}, '') END"
VT = "(CASE WHEN fact_id % 3 = 0 THEN value_text || ' ' ELSE value_text END)"
HITS = f"""{PUBLISHED}, h0 AS (SELECT o_orderkey AS hit_id, o_orderkey * 7919 % (2 * (SELECT max(p_partkey) + 1 FROM part)) AS w, o_orderkey % 6 AS how FROM orders),
h AS MATERIALIZED (SELECT hit_id, CASE how WHEN 2 THEN upper(title) WHEN 3 THEN 'New title ' || (work_id % 40) WHEN 4 THEN title END AS title, CASE how WHEN 0 THEN upper(doi) WHEN 1 THEN 'https://doi.org/10.1101/' || (w % 50) END AS doi, CASE WHEN how <> 4 THEN 2001 END AS year, CASE WHEN how = 4 THEN 'Elsewhere' END AS venue, 'Abstract ' || hit_id AS abstract FROM (SELECT h0.*, pub.*, h0.w AS work_id FROM h0 LEFT JOIN (SELECT * EXCLUDE (work_id), work_id AS pw FROM pub) pub ON pw = w)),
hk AS (SELECT *, lower(regexp_replace(doi, '^https://doi.org/', '')) AS dk, {loose('title')} AS tk FROM h), wt AS (SELECT {loose('title')} AS tk, min(work_id) AS work_id, arg_min(coalesce(doi, ''), work_id) AS d FROM pub GROUP BY 1),
hr AS MATERIALIZED (SELECT hk.*, coalesce(pub.work_id, CASE WHEN NOT coalesce(dk <> nullif(wt.d, ''), false) THEN wt.work_id END) AS of FROM hk LEFT JOIN pub ON pub.doi = dk LEFT JOIN wt USING (tk))"""
DESK_ORACLE = {
    "hits_resolved": f"WITH {HITS}, {MEMBERS} SELECT hit_id, of AS work_id, coalesce(of IN (SELECT work_id FROM mb WHERE project_id = 3), false) AS member, coalesce(dk LIKE '10.1101/%', false) AS preprint FROM hr",
    "works_upserted": f"""WITH {HITS}, ad AS (SELECT of, min(hit_id) AS hit, arg_min(year, hit_id) FILTER (year IS NOT NULL) AS year, arg_min(venue, hit_id) FILTER (venue IS NOT NULL) AS venue, arg_min(abstract, hit_id) AS abstract, arg_min(doi, hit_id) FILTER (doi IS NOT NULL) AS doi FROM hr WHERE of IS NOT NULL GROUP BY 1),
nw AS (SELECT coalesce('doi:' || dk, 'title:' || tk) AS k, min(hit_id) AS hit, arg_min(title, hit_id) FILTER (title IS NOT NULL) AS title, arg_min(doi, hit_id) FILTER (doi IS NOT NULL) AS doi, arg_min(year, hit_id) FILTER (year IS NOT NULL) AS year, arg_min(venue, hit_id) FILTER (venue IS NOT NULL) AS venue, arg_min(abstract, hit_id) AS abstract FROM hr WHERE of IS NULL AND (dk IS NOT NULL OR tk IS NOT NULL) GROUP BY 1)
SELECT work_id, title, coalesce(pub.doi, ad.doi) AS doi, coalesce(pub.year, ad.year) AS year, coalesce(pub.venue, ad.venue) AS venue, abstract FROM pub LEFT JOIN ad ON of = work_id UNION ALL SELECT (SELECT max(work_id) FROM pub) + row_number() OVER (ORDER BY hit), title, doi, year, venue, abstract FROM nw""",
    "record_view": f"WITH {VIEW} SELECT fact_id, measurement_id, work_id, project_id, quantity, value, value_text, field_key, status FROM vw LEFT JOIN fi USING (field_id)",
    "record_status": f"WITH {VIEW} SELECT status, count(*) AS n, count(DISTINCT work_id) AS works FROM vw WHERE project_id IN (0, 3) GROUP BY 1",
    "record_readings": f"WITH {VIEW}, r AS (SELECT *, {READING} AS reading FROM vw WHERE field_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY work_id, field_id, {READING} ORDER BY measurement_id NULLS FIRST, fact_id) = 1), p AS (SELECT work_id, count(DISTINCT reading) AS depth FROM r GROUP BY 1) SELECT work_id, field_id, reading, fact_id, measurement_id, depth, count(*) OVER (PARTITION BY work_id, field_id) = 1 AND depth > 1 AS paper_level FROM r JOIN p USING (work_id)",
    "record_csv": f"WITH {VIEW} SELECT 0 AS line_no, chr(65279) || 'fact_id,measurement_id,subject,value_text,quote,status' || chr(13) || chr(10) AS line UNION ALL SELECT row_number() OVER (ORDER BY fact_id, coalesce(measurement_id, 0)), fact_id || ',' || coalesce(measurement_id, 0) || ',' || subject || ',' || {CELL.format(VT)} || ',' || {CELL.format('quote')} || ',' || status || chr(13) || chr(10) FROM vw",
    "number_missing": f"WITH {VIEW} SELECT field_key, value_text, count(*) AS n FROM vw JOIN fi USING (field_id) WHERE field_key IN ('yield', 'rate', 'ph') AND value IS NULL AND coalesce(value_text, '') NOT IN ('not detected', 'about 12 units') GROUP BY 1, 2",
    "bound_as_figure": f"WITH {VIEW} SELECT fact_id, measurement_id, value_text FROM vw WHERE value IS NOT NULL AND regexp_matches(value_text, '^[A-Za-z]\\s*\\d')",
    "sibling_confusion": f"WITH {VIEW} SELECT a.work_id, a.fact_id, a.subject, min(b.subject) AS sibling FROM vw a JOIN vw b ON b.work_id = a.work_id AND b.subject <> a.subject WHERE NOT contains(a.quote, a.subject) AND contains(a.quote, b.subject) GROUP BY 1, 2, 3",
    "identifiers": "SELECT c_custkey, CASE c_custkey % 9 WHEN 0 THEN 'doi' WHEN 1 THEN 'arxiv' WHEN 2 THEN 'arxiv' WHEN 3 THEN 'pmid' WHEN 4 THEN 'pmid' WHEN 5 THEN 'arxiv' WHEN 6 THEN 'pmid' END AS kind, CASE c_custkey % 9 WHEN 0 THEN '10.1234/ab.' || c_custkey WHEN 1 THEN '2301.0' || lpad(CAST(c_custkey AS VARCHAR), 4, '0') WHEN 2 THEN '2301.0' || lpad(CAST(c_custkey AS VARCHAR), 4, '0') WHEN 3 THEN CAST(c_custkey AS VARCHAR) WHEN 4 THEN CAST(c_custkey AS VARCHAR) WHEN 5 THEN 'cond-mat/' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') WHEN 6 THEN '27' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') END AS value FROM customer",
    "planned_jobs": f"WITH {PLAN}, {RUNS[len(WORKS) + 2 :]} SELECT stage, count(*) AS n, CAST(sum(work_id) AS BIGINT) AS ids FROM jo WHERE status NOT IN ('queued', 'running') AND NOT EXISTS (SELECT 1 FROM ru WHERE ru.work_id = jo.work_id AND ru.stage = jo.stage AND NOT superseded AND ru.status IN ('succeeded', 'empty', 'skipped', 'refused')) GROUP BY 1",
    "blocked_jobs": f"WITH {PLAN} SELECT jo.job_id, coalesce(string_agg(CAST(on_id AS VARCHAR), ',' ORDER BY on_id) FILTER (on_status NOT IN ('done', 'review', 'failed', 'cancelled')), '') AS live_blockers, coalesce(string_agg(CAST(on_id AS VARCHAR), ',' ORDER BY on_id) FILTER (on_status IN ('failed', 'cancelled')), '') AS dead_blockers FROM jo LEFT JOIN dp USING (job_id) WHERE status = 'queued' GROUP BY 1",
    "ready_jobs": f"WITH {PLAN} SELECT project_id, CAST(row_number() OVER (PARTITION BY project_id ORDER BY work_id % 3, n, job_id) AS INTEGER) AS turn, job_id, stage FROM jo WHERE status = 'queued' AND work_id % 17 <> 0 AND work_id % 6 <> 0 AND work_id % 7 < 5 AND job_id NOT IN (SELECT job_id FROM dp WHERE on_status NOT IN ('done', 'review')) QUALIFY turn <= 5",
    "retried_jobs": f"WITH RECURSIVE {PLAN}, rv AS (SELECT job_id FROM jo WHERE status = 'failed' UNION SELECT dp.job_id FROM rv JOIN dp ON on_id = rv.job_id JOIN jo ON jo.job_id = dp.job_id AND jo.status = 'cancelled') SELECT stage, CASE WHEN job_id IN (SELECT job_id FROM rv) THEN 'queued' ELSE status END AS status, count(*) AS n, CAST(sum(job_id) AS BIGINT) AS ids FROM jo GROUP BY 1, 2",
    "stage_rollup": f"WITH {PLAN} SELECT project_id, stage, ['done', 'cancelled', 'waiting', 'running', 'failed'][max(CASE status WHEN 'failed' THEN 5 WHEN 'running' THEN 4 WHEN 'queued' THEN 3 WHEN 'cancelled' THEN 2 ELSE 1 END)] AS cell, count(*) AS n FROM jo GROUP BY 1, 2",
}
