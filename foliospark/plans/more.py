"""Further queries: changes and staleness, matching, review, scopes, sets and cleaning; each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliospark.functions import text as T
from foliospark.operators import changes, matching, ranking, records, search
from foliospark.plans.oracle import CITES, DOCS, M, PW, TEXT, W5, WORKS
from foliospark.plans.queries import FILTERS
from foliospark.sources import entities as E


def balances(s, d):
    old = E.table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("amount"))
    new = E.table(s, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_totalprice").alias("amount"))
    return old, new


def q_upserted(s, d):
    old, new = balances(s, d)
    return changes.upserted(old, new.where("amount > 100000"), ["id"])


def q_inserted(s, d):
    p = E.project_works(s, d)
    old = p.where("inclusion_status = 'included'").groupBy("project_id").agg(F.min("work_id").alias("work_id"), F.max("relevance").alias("relevance"))
    return changes.inserted(old.select("project_id", "work_id", "relevance"), p.select("project_id", "work_id", "relevance"), ["project_id", "work_id"]).groupBy("project_id").agg(F.count("*").alias("n"), F.sum("work_id").alias("ids"), F.round(F.max("relevance"), 4).alias("most"))


def q_retired(s, d):
    gone = E.table(s, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("run_id"))
    return changes.retired(E.measurements(s, d), gone, ["run_id"]).groupBy("field").agg(F.count("*").alias("n"), F.count_distinct("run_id").alias("runs"))


def q_superseded(s, d):
    runs = E.measurements(s, d).select("work_id", "field", "run_id").distinct()
    return changes.superseded(runs, ["work_id", "field"], "run_id").groupBy("field", "is_current").agg(F.count("*").alias("n"), F.sum("run_id").alias("runs"))


def q_stale_fingerprints(s, d):
    works = E.works(s, d).select("work_id", "year")
    cited = E.citations(s, d).join(works.withColumnRenamed("work_id", "cited"), "cited").select(F.col("citing").alias("work_id"), F.coalesce("year", F.lit(0)).alias("stamp"))
    now = changes.stamped(works.select("work_id"), cited, "work_id", "stamp", "v2")
    before = changes.stamped(works.where("year is null or year < 2030").select("work_id"), cited.where("stamp < 2035"), "work_id", "stamp", "v2")
    return changes.stale(now, before, "work_id", "fingerprint")


def q_stale_dossiers(s, d):
    p = E.project_works(s, d).where("inclusion_status = 'included'")
    digest = F.sha2(F.array_join(F.array_sort(F.collect_set(F.col("work_id").cast("string"))), ","), 256).alias("hash")
    return changes.stale(p.groupBy("project_id").agg(digest), p.where("relevance > 10").groupBy("project_id").agg(digest), "project_id", "hash")


def q_in_scope(s, d):
    owner = E.table(s, d, "supplier").select(F.col("s_suppkey").cast("string").alias("subject"), F.col("s_nationkey").alias("project_id"))
    return changes.in_scope(E.measurements(s, d).join(owner, "subject"), E.table(s, d, "nation").select(F.col("n_nationkey").alias("project_id")))


def q_null_safe_pairs(s, d):
    w = E.works(s, d)
    all_, told = w.groupBy("venue", "year").agg(F.count("*").alias("works")), w.where("abstract is not null").groupBy("venue", "year").agg(F.count("*").alias("told"))
    same = all_.venue.eqNullSafe(told.venue) & all_.year.eqNullSafe(told.year)
    return all_.join(told, same).select(all_.venue, all_.year, "works", "told")


def lines(s, d):
    return E.table(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("idx", "line"))


def q_passages(s, d):
    w = W.partitionBy("doc_id").orderBy("idx")
    near = F.concat_ws("\n", F.lag("line").over(w), "line", F.lead("line").over(w))
    found = lines(s, d).withColumn("passage", near).where(F.col("line").rlike("[0-9]{4}"))
    return found.select("doc_id", "idx", F.length("passage").alias("chars"), F.sha2("passage", 256).alias("hash"))


def q_packed_chunks(s, d):
    doc = E.table(s, d, "documents").where("text is not null")
    chunks = T.packed(F.transform(F.split("text", "\n"), lambda x: F.length(x)), 600)
    return doc.select("doc_id", F.size(chunks).cast("long").alias("chunks"), F.array_max(chunks).alias("longest"), F.aggregate(chunks, F.lit(0).cast("long"), lambda a, x: a + x).alias("chars"))


def q_points_in_spans(s, d):
    x = E.table(s, d, "lineitem")
    day = lambda c: F.datediff(c, F.lit("1992-01-01")).cast("long")
    spans = ranking.merged_spans(x.select(F.col("l_suppkey").alias("supplier"), day("l_shipdate").alias("s"), (day("l_shipdate") + F.floor(F.col("l_quantity") / 20)).alias("e")), "supplier", "s", "e")
    points = E.table(s, d, "orders").join(x, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("l_suppkey").alias("supplier"), day("o_orderdate").alias("at"))
    met = points.join(spans, "supplier").where(F.col("at").between(F.col("span_start"), F.col("span_end")))
    return met.groupBy("supplier").agg(F.count("*").alias("points"), F.count_distinct("span_start").alias("spans"))


def q_high_floor(s, d):
    by = E.project_works(s, d).where("relevance is not null").groupBy("project_id", "relevance").agg(F.count("*").alias("n"))
    w = W.partitionBy("project_id")
    at = F.greatest(F.lit(1), F.floor(F.sum("n").over(w) / 3 + 0.5))
    upto = F.sum("n").over(w.orderBy(F.desc("relevance")).rowsBetween(W.unboundedPreceding, 0))
    return by.withColumn("reached", upto >= at).where("reached").groupBy("project_id").agg(F.max("relevance").alias("floor"))


def q_review_queue(s, d):
    kind = F.when(F.col("ordinal") == 6, "conflict").when(F.col("ordinal") == 5, "inferred").otherwise("stated")
    m = E.measurements(s, d).where("not superseded").withColumn("kind", kind)
    failed = records.error_exceeds(m).select("run_id", "ordinal").distinct().withColumn("failed", F.lit(True))
    reason = F.when(F.col("kind") == "conflict", "conflict").when(F.col("kind") == "inferred", "inferred").when(F.col("failed"), "check")
    return m.join(failed, ["run_id", "ordinal"], "left").withColumn("reason", reason).where("reason is not null").select("run_id", "ordinal", "work_id", "field", "reason")


def q_missing_fields(s, d):
    m = E.measurements(s, d).where("value is not null")
    every = F.array(*map(F.lit, ("A", "N", "R")))
    rest = F.array_join(F.array_sort(F.array_except(every, F.collect_set("field"))), ",")
    return m.groupBy("work_id", "subject").agg(rest.alias("missing")).where("missing != ''")


def q_unit_missing(s, d):
    return E.measurements(s, d).where("value is not null and unit is null").groupBy("field").agg(F.count("*").alias("n"), F.count_distinct("run_id").alias("runs"))


def q_value_under_two_fields(s, d):
    return E.measurements(s, d).where("value is not null").groupBy("work_id", "subject", "value").agg(F.count_distinct("field").alias("fields")).where("fields > 1")


def q_cells_to_read(s, d):
    m = E.measurements(s, d).groupBy("subject", "field").agg(F.count_distinct("conditions").alias("cells"), F.count("*").alias("n"))
    return m.where("cells >= 4")


def q_content_status(s, d):
    doc = E.documents_of_works(s, d)
    best = F.struct(F.when(F.col("is_preferred"), 0).otherwise(1), F.col("document_id"))
    status = doc.groupBy("work_id").agg(F.min_by("content_status", best).alias("content_status"))
    full = status.where("content_status in ('full_text', 'abstract_only')")
    return E.works(s, d).join(full, "work_id", "left_semi").groupBy("venue").agg(F.count("*").alias("n"), F.min("work_id").alias("first"))


def q_search_by_author(s, d):
    by = search.written_by(E.authorship(s, d), ("00001", "00007 "))
    hits = search.with_citations(E.works(s, d), E.citations(s, d)).where(search.predicates(search.Filters(query=FILTERS.query, year_from=1995, year_to=2035)))
    return hits.join(by, "work_id", "left_semi").select("work_id", "year", "n_citations")


def q_identity_groups(s, d):
    rows = E.works(s, d).select(F.col("work_id").alias("id"), F.when(F.col("work_id") % 3 == 0, F.concat(F.lit("10.1/W"), F.col("work_id") % 50)).alias("doi"), F.when(F.col("work_id") % 5 != 0, F.col("title")).otherwise("ab").alias("title"))
    return matching.identity_groups(rows)


def q_ego_expansion(s, d):
    e = E.citations(s, d).where("citing != cited")
    seed = E.project_works(s, d).orderBy(F.desc_nulls_last("relevance"), "work_id").limit(5).select(((F.col("work_id") % 200) + 1).alias("node")).distinct()
    out = e.join(seed, e.citing == seed.node, "left_semi").select(F.col("cited").alias("node"))
    into = e.join(seed, e.cited == seed.node, "left_semi").select(F.col("citing").alias("node"))
    return seed.union(out).union(into).distinct()


def q_relevance_blend(s, d):
    shift = F.when(F.col("inclusion_status") == "included", 0.05).when(F.col("inclusion_status") == "excluded", -0.05).otherwise(0.0)
    p = E.project_works(s, d).where("relevance is not null").withColumn("score", F.least(F.col("relevance") / 500, F.lit(1.0)))
    return p.groupBy("project_id").agg(F.round(F.avg(0.05 + F.col("score") * 0.9 + shift), 6).alias("priority"), F.count("score").alias("n"))


def q_id_sets(s, d):
    e = E.citations(s, d)
    a, b = e.select(F.col("citing").alias("id")).distinct(), e.where("cited > citing").select(F.col("cited").alias("id")).distinct()
    named = lambda x, how: x.agg(F.count("*").alias("n"), F.sum("id").alias("ids")).select(F.lit(how).alias("how"), "n", "ids")
    return named(a.union(b).distinct(), "union").unionAll(named(a.intersect(b), "intersect")).unionAll(named(a.subtract(b), "except"))


def q_cleaned_fields(s, d):
    c = E.table(s, d, "customer")
    raw = F.when(F.col("c_custkey") % 7 == 0, "n.d.").when(F.col("c_custkey") % 7 == 1, " ").when(F.col("c_custkey") % 7 == 2, "Not reported").otherwise(F.concat(F.lit("c. "), F.col("c_custkey") + 1300, F.lit("a")))
    share = F.col("c_acctbal") / 10000
    return c.select("c_custkey", T.year_of(raw, 2028).alias("year"), T.count_of(F.col("c_acctbal")).alias("count"), T.is_absent(raw).alias("absent"), T.similarity_band(share).alias("band"), F.round(share * 100, 4).alias("percent"))


def q_containment(s, d):
    b = E.table(s, d, "benchmark").select("item_id", T.tokens(F.col("text")).alias("t"))
    first = F.lit(b.agg(F.min_by("t", "item_id")).first()[0])  # the tokens of one text
    return b.select("item_id", F.round(matching.containment(first, F.col("t")), 6).alias("share"))


MORE = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}

STAMP = "sha256('v2|' || coalesce((SELECT string_agg(y, ',' ORDER BY y) FROM (SELECT DISTINCT CAST(coalesce(c.year, 0) AS VARCHAR) AS y FROM cites JOIN works c ON c.work_id = cited WHERE citing = w.work_id{0})), ''))"
DOSSIER = "SELECT project_id, sha256(string_agg(w, ',' ORDER BY w)) AS hash FROM (SELECT DISTINCT project_id, CAST(work_id AS VARCHAR) AS w FROM pw WHERE inclusion_status = 'included'{0}) GROUP BY 1"
RAW = "CASE c_custkey % 7 WHEN 0 THEN 'n.d.' WHEN 1 THEN ' ' WHEN 2 THEN 'Not reported' ELSE 'c. ' || (c_custkey + 1300) || 'a' END"

MORE_ORACLE = {
    "packed_chunks": "WITH RECURSIVE s AS (SELECT doc_id, [length(x) FOR x IN string_split(text, chr(10))] AS n FROM documents WHERE text IS NOT NULL), f AS (SELECT doc_id, n, 1 AS i, CAST(n[1] AS BIGINT) AS now, CAST([] AS BIGINT[]) AS done FROM s UNION ALL SELECT doc_id, n, i + 1, CASE WHEN now > 0 AND now + n[i + 1] > 600 THEN n[i + 1] ELSE now + n[i + 1] END, CASE WHEN now > 0 AND now + n[i + 1] > 600 THEN list_append(done, now) ELSE done END FROM f WHERE i < len(n)), z AS (SELECT doc_id, CASE WHEN now > 0 THEN list_append(done, now) ELSE done END AS c FROM f WHERE i = len(n)) SELECT doc_id, CAST(len(c) AS BIGINT) AS chunks, list_max(c) AS longest, CAST(coalesce(list_sum(c), 0) AS BIGINT) AS chars FROM z",
    "upserted": "WITH n AS (SELECT o_custkey AS id, max(o_totalprice) AS amount FROM orders GROUP BY 1 HAVING max(o_totalprice) > 100000) SELECT c_custkey AS id, coalesce(n.amount, c_acctbal) AS amount FROM customer LEFT JOIN n ON n.id = c_custkey UNION ALL SELECT * FROM n WHERE id NOT IN (SELECT c_custkey FROM customer)",
    "inserted": f"WITH {PW}, o AS (SELECT project_id, min(work_id) AS work_id, max(relevance) AS relevance FROM pw WHERE inclusion_status = 'included' GROUP BY 1), a AS (SELECT * FROM o UNION ALL SELECT project_id, work_id, min(relevance) FROM pw WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.project_id = pw.project_id AND o.work_id = pw.work_id) GROUP BY 1, 2) SELECT project_id, count(*) AS n, CAST(sum(work_id) AS BIGINT) AS ids, round(max(relevance), 4) AS most FROM a GROUP BY 1",
    "retired": f"WITH {M} SELECT field, count(*) AS n, count(DISTINCT run_id) AS runs FROM m WHERE run_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1",
    "superseded": f"WITH {M}, r AS (SELECT DISTINCT work_id, field, run_id FROM m), x AS (SELECT *, run_id = max(run_id) OVER (PARTITION BY work_id, field) AS is_current FROM r) SELECT field, is_current, count(*) AS n, CAST(sum(run_id) AS BIGINT) AS runs FROM x GROUP BY 1, 2",
    "stale_fingerprints": f"WITH {WORKS}, {CITES}, a AS (SELECT work_id, {STAMP.format('')} AS f FROM works w), b AS (SELECT work_id, {STAMP.format(' AND coalesce(c.year, 0) < 2035')} AS f FROM works w WHERE year IS NULL OR year < 2030) SELECT a.work_id, CASE WHEN b.work_id IS NULL THEN 'missing' ELSE 'changed' END AS reason FROM a LEFT JOIN b USING (work_id) WHERE b.work_id IS NULL OR a.f <> b.f",
    "stale_dossiers": f"WITH {PW}, a AS ({DOSSIER.format('')}), b AS ({DOSSIER.format(' AND relevance > 10')}) SELECT a.project_id, CASE WHEN b.project_id IS NULL THEN 'missing' ELSE 'changed' END AS reason FROM a LEFT JOIN b USING (project_id) WHERE b.project_id IS NULL OR a.hash <> b.hash",
    "in_scope": "WITH m AS (SELECT s_nationkey AS p FROM lineitem JOIN supplier ON s_suppkey = l_suppkey), ps AS (SELECT n_nationkey AS p FROM nation WHERE n_nationkey <> 0) SELECT ps.p AS project_id, count(m.p) AS n FROM ps LEFT JOIN m ON m.p = ps.p OR m.p = 0 GROUP BY 1",
    "null_safe_pairs": f"WITH {WORKS}, a AS (SELECT venue, year, count(*) AS works FROM works GROUP BY 1, 2), b AS (SELECT venue, year, count(*) AS told FROM works WHERE abstract IS NOT NULL GROUP BY 1, 2) SELECT a.venue, a.year, works, told FROM a JOIN b ON a.venue IS NOT DISTINCT FROM b.venue AND a.year IS NOT DISTINCT FROM b.year",
    "passages": "WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents), l AS (SELECT doc_id, unnest(range(0, len(x))) AS idx, unnest(x) AS line FROM s), p AS (SELECT doc_id, idx, line, concat_ws(chr(10), lag(line) OVER w, line, lead(line) OVER w) AS passage FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY idx)) SELECT doc_id, CAST(idx AS INTEGER) AS idx, CAST(length(passage) AS INTEGER) AS chars, sha256(passage) AS hash FROM p WHERE regexp_matches(line, '[0-9]{4}')",
    "points_in_spans": """WITH y AS (SELECT l_suppkey AS supplier, CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS s, CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) + floor(l_quantity / 20) AS BIGINT) AS e FROM lineitem),
z AS (SELECT *, max(e) OVER (PARTITION BY supplier ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM y), i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY supplier ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM z), sp AS (SELECT supplier, min(s) AS a, max(e) AS b FROM i GROUP BY supplier, island),
p AS (SELECT l_suppkey AS supplier, date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS t FROM orders JOIN lineitem ON o_orderkey = l_orderkey) SELECT p.supplier, count(*) AS points, count(DISTINCT a) AS spans FROM p JOIN sp ON sp.supplier = p.supplier AND t BETWEEN a AND b GROUP BY 1""",
    "high_floor": f"WITH {PW}, s AS (SELECT project_id, list_reverse_sort(list(relevance) FILTER (relevance IS NOT NULL)) AS v FROM pw GROUP BY 1) SELECT project_id, v[greatest(1, CAST(floor(len(v) / 3 + 0.5) AS BIGINT))] AS floor FROM s WHERE len(v) > 0",
    "review_queue": f"WITH {M}, f AS (SELECT DISTINCT run_id, ordinal FROM m WHERE NOT superseded AND error >= 0 AND abs(error) > abs(value)), k AS (SELECT m.*, CASE WHEN ordinal = 6 THEN 'conflict' WHEN ordinal = 5 THEN 'inferred' WHEN EXISTS (SELECT 1 FROM f WHERE f.run_id = m.run_id AND f.ordinal = m.ordinal) THEN 'check' END AS reason FROM m WHERE NOT superseded) SELECT run_id, ordinal, work_id, field, reason FROM k WHERE reason IS NOT NULL",
    "missing_fields": f"WITH {M}, g AS (SELECT work_id, subject, list(DISTINCT field) AS f FROM m WHERE value IS NOT NULL GROUP BY 1, 2) SELECT work_id, subject, array_to_string(list_filter(['A', 'N', 'R'], lambda x: NOT list_contains(f, x)), ',') AS missing FROM g WHERE len(f) < 3",
    "unit_missing": f"WITH {M} SELECT field, count(*) AS n, count(DISTINCT run_id) AS runs FROM m WHERE value IS NOT NULL AND unit IS NULL GROUP BY 1",
    "value_under_two_fields": f"WITH {M} SELECT work_id, subject, value, count(DISTINCT field) AS fields FROM m WHERE value IS NOT NULL GROUP BY 1, 2, 3 HAVING count(DISTINCT field) > 1",
    "cells_to_read": f"WITH {M} SELECT subject, field, count(DISTINCT conditions) AS cells, count(*) AS n FROM m GROUP BY 1, 2 HAVING count(DISTINCT conditions) >= 4",
    "content_status": f"WITH {DOCS}, b AS (SELECT work_id, arg_min(content_status, (NOT is_preferred, document_id)) AS s FROM docs GROUP BY 1) SELECT p_brand AS venue, count(*) AS n, min(p_partkey) AS first FROM part JOIN b ON work_id = p_partkey WHERE s IN ('full_text', 'abstract_only') GROUP BY 1",
    "search_by_author": f"WITH {W5} SELECT work_id, year, n_citations FROM wc WHERE {TEXT} AND year BETWEEN 1995 AND 2035 AND work_id IN (SELECT l_partkey FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE contains(lower(s_name), '00001') OR contains(lower(s_name), '00007'))",
    "identity_groups": "WITH r AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN '10.1/W' || (p_partkey % 50) END AS doi, CASE WHEN p_partkey % 5 <> 0 THEN p_name ELSE 'ab' END AS title FROM part), t AS (SELECT *, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS n FROM r) SELECT CASE WHEN doi IS NOT NULL THEN 'doi:' || lower(doi) WHEN length(n) >= 8 THEN 'title:' || n ELSE 'row:' || id END AS key, min(id) AS head, count(*) AS members, max(doi) AS doi FROM t GROUP BY 1",
    "ego_expansion": f"WITH {CITES}, {PW}, e AS (SELECT * FROM cites WHERE citing <> cited), n AS (SELECT DISTINCT work_id % 200 + 1 AS node FROM (SELECT work_id FROM pw ORDER BY relevance DESC NULLS LAST, work_id LIMIT 5)) SELECT node FROM n UNION SELECT cited FROM e WHERE citing IN (SELECT node FROM n) UNION SELECT citing FROM e WHERE cited IN (SELECT node FROM n)",
    "relevance_blend": f"WITH {PW}, x AS (SELECT project_id, least(relevance / 500, 1.0::DOUBLE) AS score, CASE inclusion_status WHEN 'included' THEN 0.05 WHEN 'excluded' THEN -0.05 ELSE 0.0 END AS shift FROM pw WHERE relevance IS NOT NULL) SELECT project_id, round(avg(0.05 + score * 0.9 + shift), 6) AS priority, count(*) AS n FROM x GROUP BY 1",
    "id_sets": f"WITH {CITES}, a AS (SELECT DISTINCT citing AS id FROM cites), b AS (SELECT DISTINCT cited AS id FROM cites WHERE cited > citing) SELECT 'union' AS how, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM (FROM a UNION FROM b) UNION ALL SELECT 'intersect', count(*), CAST(sum(id) AS BIGINT) FROM (FROM a INTERSECT FROM b) UNION ALL SELECT 'except', count(*), CAST(sum(id) AS BIGINT) FROM (FROM a EXCEPT FROM b)",
    "cleaned_fields": f"WITH x AS (SELECT *, {RAW} AS raw, TRY_CAST(nullif(regexp_extract({RAW}, '([0-9]{{4}})', 1), '') AS INTEGER) AS y FROM customer) SELECT c_custkey, CASE WHEN y BETWEEN 1400 AND 2028 THEN y END AS year, CAST(CASE WHEN c_acctbal > 0 THEN floor(c_acctbal) ELSE 0 END AS BIGINT) AS count, c_custkey % 7 < 3 AS absent, CASE WHEN c_acctbal / 10000 >= 0.7 THEN 'close' WHEN c_acctbal / 10000 >= 0.5 THEN 'related' ELSE 'weak' END AS band, round(c_acctbal / 10000 * 100, 4) AS percent FROM x",
    "containment": "WITH b AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{3,}')) AS t FROM benchmark), x AS (SELECT item_id, t, (SELECT t FROM b ORDER BY item_id LIMIT 1) AS t0 FROM b) SELECT item_id, round(CASE WHEN len(t0) > 0 THEN len(list_intersect(t0, t)) / len(t0)::DOUBLE ELSE 0 END, 6) AS share FROM x",
}
