"""Queries on a project's corpus: scoped search, counts, absent papers, roles and cells, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.functions import roles
from foliospark.operators import cells, changes, matching, projects, search
from foliospark.plans.oracle import CITES, DOCS, FOLD, WORKS
from foliospark.sources import entities as E

PROJECT = 3
SCOPED = search.Filters(query="ring|plate | gear", year=("2030–2000", "1999"), min_citations=2, inclusion_status=("included", "read", " "), content_status=("full_text", "abstract_only"), sort="relevance")


def people(s, d):
    members = E.memberships(s, d).where(F.col("project_id") == PROJECT)
    return search.population(E.works(s, d), E.citations(s, d), E.documents_of_works(s, d), members)


def q_scoped_search(s, d):
    return search.page(people(s, d), SCOPED, True, 40, 2)


def q_scoped_count(s, d):
    return search.total(people(s, d), SCOPED, True)


def q_scoped_facets(s, d):
    return search.buckets(people(s, d), SCOPED, True)


def jobs_of(s, d):
    """A job for each event: of a project, or of project 0; its run superseded for some."""
    e = E.table(s, d, "events")
    n = E.table(s, d, "part").agg(F.max("p_partkey") + 1).first()[0]
    i = F.col("event_id")
    status = F.when(i % 7 == 0, "failed").when(i % 7 == 1, "error").when(i % 7 == 2, "running").when(i % 7 == 3, "queued").otherwise("done")
    jobs = e.select(F.when(i % 5 == 0, 0).otherwise(i % 25).alias("project_id"), F.when(i % 13 != 0, i * 31 % n).alias("work_id"), status.alias("status"), F.when(i % 17 == 0, "skipped").alias("outcome"), (i % 4 == 0).alias("dismissed"), F.when(i % 9 != 0, i).alias("run_id"))
    return jobs, e.select(i.alias("run_id"), (i % 3 == 0).alias("superseded"))


def q_project_counts(s, d):
    jobs, runs = jobs_of(s, d)
    facts = E.measurements(s, d).where("not superseded").select((F.col("run_id") % 25).alias("project_id"), "work_id")
    return projects.overview(E.table(s, d, "nation").select(F.col("n_nationkey").alias("project_id")), E.memberships(s, d), facts, jobs, runs)


def absent(s, d):
    """References to papers that aren't there: some by DOI, some by title, some by neither."""
    r = E.bibliographies(s, d)
    i = F.col("citing") * 1000 + F.col("ref_index")
    status = F.when(i % 6 == 0, "failed").when(i % 6 == 1, "retrieving").when(i % 6 == 2, "retrieved").when(i % 6 == 3, None).otherwise("none")
    return r.select(i.alias("id"), "citing", "doi", "title", status.alias("status"))


def q_unresolved_merged(s, d):
    out = matching.merged(absent(s, d))
    return out.select("key", "head", "title", "doi", "status", F.array_join(F.transform("citing", lambda x: x.cast("string")), ",").alias("citing"), F.size("members").alias("n"))


def q_promoted_edges(s, d):
    rows, edges = absent(s, d).select("id", "citing"), E.citations(s, d)
    resolved = rows.where("id % 4 = 0").select("id", (F.col("id") % 97).alias("work_id"))
    contexts = rows.select((F.col("id") * 10).alias("context_id"), "citing", F.col("id").alias("ref_id"), F.lit(None).cast("long").alias("cited"))
    out = matching.promoted(edges, rows, contexts, resolved)
    named = lambda x, what, ids: x.agg(F.count("*").alias("n"), F.sum(ids).alias("ids")).select(F.lit(what).alias("part"), "n", "ids")
    return named(out[0], "edges", "cited").union(named(out[1], "absent", "id")).union(named(out[2], "contexts", "context_id")).union(named(out[2].where("cited is not null"), "moved", "cited"))


SAID = ("This was reviewed in [3] at length", "We fitted it using the method of [2]", "Structures were taken from PDB entry 1ABC [4]", "In contrast to others [5] we saw none", "The result is consistent with [6, 7]", "The rate is higher than that reported [8]", "The rate is 40 times higher than that reported [8] for KE07", "It remains a major challenge [1]", "Others looked at it [9]", "See ref. 12, lower than KE70")


def q_citation_roles(s, d):
    e = E.table(s, d, "events").select("event_id", F.get(F.array(*map(F.lit, SAID)), (F.col("event_id") % len(SAID)).cast("int")).alias("said"), F.when(F.col("event_id") % 3 == 0, "introduction").otherwise("results").alias("section"))
    return e.select("event_id", "section", roles.role(F.col("said"), F.col("section")).alias("r")).select("event_id", "section", "r.role", "r.cue")


def readings(s, d):
    """Two columns of each work's subjects, as stored and as read again in seven manners."""
    p = E.spread(E.table(s, d, "part"), "p_partkey").select(F.col("p_partkey").alias("doc"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    w, k = F.col("doc"), F.col("k")
    a, b = (10 + w % 90 + k).cast("string"), F.concat((1 + w % 8).cast("string"), F.lit(","), F.lpad((w * 7 % 1000).cast("string"), 3, "0"))
    row = F.concat(F.lit("Row "), k)
    stored = p.select("doc", row.alias("row"), F.explode(F.array(F.struct(F.lit("Rate").alias("col"), a.alias("value")), F.struct(F.lit("K m").alias("col"), b.alias("value")))).alias("x")).select("doc", "row", "x.*")
    how = (w * 3 + k) % 7
    none = F.array().cast("array<string>")
    rate = F.when(how == 1, F.array(F.concat(a, F.lit(" ± 0.5")))).when(how == 2, none).when(how == 3, F.array(b)).when(how == 4, F.array((10 + w % 90 + k + 1).cast("string"))).when(how == 6, F.array(a, F.lit("> 7"))).otherwise(F.array(a))
    km = F.when(how == 3, F.array(a)).when(how == 2, F.array(a)).otherwise(F.array(F.replace(b, F.lit(","), F.lit(""))))
    cell = lambda col, v, mark: F.struct(F.lit(col).alias("col"), v.alias("values"), mark.alias("marked"))
    read = p.where(how != 5).select("doc", F.upper(row).alias("row"), F.explode(F.array(cell("RATE", rate, F.when(how == 2, "n.d.")), cell("k  m", km, F.lit(None).cast("string")))).alias("x")).select("doc", "row", "x.*")
    return stored, read


def q_cell_disagreements(s, d):
    return cells.disagreements(*readings(s, d))


def q_retired_cascade(s, d):
    tables = {t: E.table(s, d, t) for t in ("customer", "orders", "lineitem")}
    gone = {"customer": tables["customer"].where("c_acctbal < 0").select("c_custkey"), "orders": tables["orders"].where("o_orderstatus = 'P'").select("o_orderkey")}
    left = changes.cascaded(tables, gone, [("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey")])
    each = [x.agg(F.count("*").alias("n")).select(F.lit(t).alias("part"), "n") for t, x in left.items()]
    return each[0].union(each[1]).union(each[2])


CORPUS = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}

MEMBERS = "mb AS MATERIALIZED (SELECT *, CASE WHEN (work_id * 7 + project_id) % 6 <> 0 THEN (work_id * 37 + project_id * 11) % 100 / 100e0 END AS relevance, CASE (work_id + project_id) % 5 WHEN 0 THEN 'unread' WHEN 1 THEN 'included' WHEN 2 THEN 'excluded' WHEN 3 THEN 'uncertain' ELSE 'read' END AS inclusion_status, (work_id + project_id * 3) % 10 = 0 AS is_reference FROM (SELECT DISTINCT s_nationkey AS project_id, l_partkey AS work_id FROM lineitem JOIN supplier ON s_suppkey = l_suppkey))"
PEOPLE = f"{WORKS}, {CITES}, {DOCS}, {MEMBERS}, pe AS MATERIALIZED (SELECT works.*, coalesce(n, 0) AS n_citations, cs, relevance, inclusion_status FROM works JOIN mb ON mb.work_id = works.work_id AND project_id = {PROJECT} LEFT JOIN (SELECT cited, count(*) AS n FROM cites GROUP BY 1) ON cited = works.work_id LEFT JOIN (SELECT work_id AS dw, list(DISTINCT content_status) AS cs FROM docs WHERE is_preferred GROUP BY 1) ON dw = works.work_id)"
TEXT = "(" + " OR ".join(f"coalesce(contains({FOLD.format(x=f)}, '{n}'), false)" for n in ("ring", "plate", "gear") for f in ("title", "abstract", "venue")) + ")"
CLAUSES = {"year": "coalesce(year = 1999 OR year BETWEEN 2000 AND 2030, false)", "inclusion_status": "inclusion_status IN ('included', 'read')", "content_status": "coalesce(list_has_any(cs, ['full_text', 'abstract_only']), false)"}


def where(without: str = "") -> str:
    return " AND ".join([TEXT, "n_citations >= 2", *(c for k, c in CLAUSES.items() if k != without)])


ABSENT = "ab AS MATERIALIZED (SELECT citing * 1000 + ref_index AS id, citing, doi, title, CASE (citing * 1000 + ref_index) % 6 WHEN 0 THEN 'failed' WHEN 1 THEN 'retrieving' WHEN 2 THEN 'retrieved' WHEN 3 THEN NULL ELSE 'none' END AS status FROM bib)"
JOBS = "jb AS MATERIALIZED (SELECT CASE WHEN event_id % 5 = 0 THEN 0 ELSE event_id % 25 END AS project_id, CASE WHEN event_id % 13 <> 0 THEN event_id * 31 % (SELECT max(p_partkey) + 1 FROM part) END AS work_id, CASE event_id % 7 WHEN 0 THEN 'failed' WHEN 1 THEN 'error' WHEN 2 THEN 'running' WHEN 3 THEN 'queued' ELSE 'done' END AS status, event_id % 17 = 0 AS settled, event_id % 4 = 0 AS dismissed, event_id % 9 <> 0 AND event_id % 3 <> 0 AS live FROM events)"


def touched(rows: str) -> str:
    return f"(SELECT project_id, count(DISTINCT work_id) AS n FROM (SELECT project_id, work_id FROM {rows} WHERE project_id <> 0 AND work_id IS NOT NULL UNION SELECT mb.project_id, mb.work_id FROM mb JOIN (SELECT * FROM {rows} WHERE project_id = 0) x ON x.work_id = mb.work_id) GROUP BY 1)"


def role_sql() -> str:
    bare = "regexp_replace(regexp_replace(regexp_replace(said, '\\[[0-9,;\\s–-]+\\]', ' ', 'g'), '(?i)\\bref\\.?\\s*\\d+(?:\\s*[,–-]\\s*\\d+)*', ' ', 'g'), '\\b[A-Za-z][^\\s.,;:)]*\\d[^\\s.,;:)]*', ' ', 'g')"
    rule = lambda cue, p: f"regexp_matches(said, '(?i){p}')" + (f" AND regexp_matches({bare}, '\\d')" if cue == roles.FIGURED else "")
    pick = lambda of, last: "CASE " + " ".join(f"WHEN {rule(c, p)} THEN '{of(c, r)}'" for c, r, p in roles.RULES) + f" WHEN section = 'introduction' THEN '{last}' END"
    said = ", ".join("'" + x + "'" for x in SAID)
    return f"WITH x AS (SELECT event_id, [{said}][event_id % {len(SAID)} + 1] AS said, CASE WHEN event_id % 3 = 0 THEN 'introduction' ELSE 'results' END AS section FROM events) SELECT event_id, section, {pick(lambda c, r: r, 'background')} AS role, {pick(lambda c, r: c, 'r8-intro-default')} AS cue FROM x"


def corpus_oracle() -> dict[str, str]:
    from foliospark.plans.literature import DOI, PRINTED, PUBLISHED, loose

    bib = f"{PUBLISHED}, {PRINTED}, {ABSENT}"
    facet = lambda k, v, source="pe": f"SELECT '{k}' AS facet, {v} AS value, count(*) AS n FROM {source} WHERE {where(k)} AND {v} IS NOT NULL GROUP BY 2"
    return {
        "scoped_search": f"WITH {PEOPLE} SELECT CAST(place AS INTEGER) AS place, work_id, title, year, venue, work_type, n_citations, substr(abstract, 1, 200) AS snippet FROM (SELECT *, row_number() OVER (ORDER BY relevance DESC NULLS LAST, lower(title), work_id) AS place FROM pe WHERE {where()}) WHERE place BETWEEN 3 AND 42",
        "scoped_count": f"WITH {PEOPLE} SELECT count(*) AS n FROM pe WHERE {where()}",
        "scoped_facets": f"WITH {PEOPLE} " + " UNION ALL ".join([facet("venue", "venue"), facet("work_type", "work_type"), facet("year", "CAST(year AS VARCHAR)"), facet("inclusion_status", "inclusion_status"), facet("content_status", "c", "(SELECT *, unnest(cs) AS c FROM pe)")]),
        "project_counts": f"WITH {MEMBERS}, {JOBS}, fa AS (SELECT DISTINCT l_orderkey % 25 AS project_id, l_partkey AS work_id FROM lineitem WHERE l_orderkey % 5 <> 0), fl AS (SELECT * FROM jb WHERE status IN ('failed', 'error') AND NOT dismissed AND live), bz AS (SELECT * FROM jb WHERE status IN ('running', 'queued') AND NOT settled), ex AS (SELECT mb.project_id, count(DISTINCT mb.work_id) AS n FROM mb JOIN fa ON fa.work_id = mb.work_id AND fa.project_id IN (0, mb.project_id) GROUP BY 1), m AS (SELECT project_id, count(*) AS works, count(relevance) AS ranked, count(*) FILTER (is_reference) AS reference, count(*) FILTER (inclusion_status = 'unread') AS unread, count(*) FILTER (inclusion_status IN ('read', 'uncertain')) AS undecided, count(*) FILTER (inclusion_status IN ('included', 'excluded')) AS decided FROM mb GROUP BY 1) SELECT n_nationkey AS project_id, coalesce(works, 0) AS works, coalesce(ranked, 0) AS ranked, coalesce(reference, 0) AS reference, coalesce(ex.n, 0) AS extracted, coalesce(unread, 0) AS unread, coalesce(undecided, 0) AS undecided, coalesce(decided, 0) AS decided, coalesce(f.n, 0) AS failed, coalesce(b.n, 0) AS processing FROM nation LEFT JOIN m ON m.project_id = n_nationkey LEFT JOIN ex ON ex.project_id = n_nationkey LEFT JOIN {touched('fl')} f ON f.project_id = n_nationkey LEFT JOIN {touched('bz')} b ON b.project_id = n_nationkey",
        "unresolved_merged": f"WITH {bib}, k AS (SELECT *, CASE WHEN trim(doi) <> '' THEN 'doi:' || {DOI} WHEN length({loose('title')}) >= 8 THEN 'title:' || {loose('title')} ELSE 'row:' || id END AS key, coalesce(list_position(['none', 'failed', 'retrieving', 'retrieved'], status), 1) AS r FROM ab) SELECT key, min(id) AS head, arg_min(CASE WHEN title IS NULL THEN [] ELSE [title] END, id)[1] AS title, arg_min(CASE WHEN doi IS NULL THEN [] ELSE [doi] END, id)[1] AS doi, ['none', 'failed', 'retrieving', 'retrieved'][max(r)] AS status, array_to_string(list_sort(list(DISTINCT citing)), ',') AS citing, CAST(count(*) AS INTEGER) AS n FROM k GROUP BY 1",
        "promoted_edges": f"WITH {bib}, {CITES}, rs AS (SELECT id, citing, id % 97 AS w FROM ab WHERE id % 4 = 0), e AS (SELECT citing, cited FROM cites UNION SELECT citing, w FROM rs WHERE citing <> w), c AS (SELECT id * 10 AS context_id, w AS cited FROM ab LEFT JOIN rs USING (id) WHERE w IS NULL OR w <> ab.citing) SELECT 'edges' AS part, count(*) AS n, CAST(sum(cited) AS BIGINT) AS ids FROM e UNION ALL SELECT 'absent', count(*), CAST(sum(id) AS BIGINT) FROM ab WHERE id % 4 <> 0 UNION ALL SELECT 'contexts', count(*), CAST(sum(context_id) AS BIGINT) FROM c UNION ALL SELECT 'moved', count(cited), CAST(sum(cited) AS BIGINT) FROM c",
        "citation_roles": role_sql(),
        "cell_disagreements": """WITH p AS (SELECT p_partkey AS doc, k, (p_partkey * 3 + k) % 7 AS how, CAST(10 + p_partkey % 90 + k AS VARCHAR) AS a, (1 + p_partkey % 8) || ',' || lpad(CAST(p_partkey * 7 % 1000 AS VARCHAR), 3, '0') AS b, CAST(11 + p_partkey % 90 + k AS VARCHAR) AS up, 'Row ' || k AS row FROM part, (SELECT unnest(range(0, 4)) AS k))
SELECT doc, row, 'Rate' AS col, a AS stored, 'n.d.' AS printed, 'value-belongs-to-another-column' AS kind, 'k  m' AS under FROM p WHERE how = 2 UNION ALL SELECT doc, row, 'K m', b, a, 'value-not-printed', NULL FROM p WHERE how = 2 UNION ALL SELECT doc, row, 'K m', NULL, a, 'value-not-stored', NULL FROM p WHERE how = 2
UNION ALL SELECT doc, row, 'Rate', a, b, 'value-belongs-to-another-column', 'k  m' FROM p WHERE how = 3 UNION ALL SELECT doc, row, 'Rate', NULL, b, 'value-not-stored', NULL FROM p WHERE how = 3 UNION ALL SELECT doc, row, 'K m', b, a, 'value-belongs-to-another-column', 'RATE' FROM p WHERE how = 3 UNION ALL SELECT doc, row, 'K m', NULL, a, 'value-not-stored', NULL FROM p WHERE how = 3
UNION ALL SELECT doc, row, 'Rate', a, up, 'value-not-printed', NULL FROM p WHERE how = 4 UNION ALL SELECT doc, row, 'Rate', NULL, up, 'value-not-stored', NULL FROM p WHERE how = 4 UNION ALL SELECT doc, row, 'Rate', NULL, '> 7', 'value-not-stored', NULL FROM p WHERE how = 6""",
        "retired_cascade": "WITH c AS (SELECT * FROM customer WHERE c_acctbal >= 0), o AS (SELECT * FROM orders WHERE o_orderstatus <> 'P' AND (o_custkey IN (SELECT c_custkey FROM c) OR o_custkey NOT IN (SELECT c_custkey FROM customer))), l AS (SELECT * FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o) OR l_orderkey NOT IN (SELECT o_orderkey FROM orders)) SELECT 'customer' AS part, count(*) AS n FROM c UNION ALL SELECT 'orders', count(*) FROM o UNION ALL SELECT 'lineitem', count(*) FROM l",
    }


CORPUS_ORACLE = corpus_oracle()
