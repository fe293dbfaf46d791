"""Queries on passages, quotations, the reference tree, semantic search, stages and archives, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.operators import archive, graph, passages, quotes, stages, vectors
from foliospark.plans.literature import PAPERS
from foliospark.plans.oracle import CITES, WORKS
from foliospark.plans.session import checkpoint_dir
from foliospark.sources import entities as E

BUDGET = 400
STAGES = [
    stages.Stage("fetch", (), ("file",), 0),
    stages.Stage("parse", ("file",), ("text",), 1),
    stages.Stage("clean", ("text",), ("text",), 2, "text"),
    stages.Stage("segment", ("text",), ("paragraphs",), 3),
    stages.Stage("references", ("text",), ("entries",), 4),
    stages.Stage("embed", ("paragraphs",), ("vectors",), 5),
    stages.Stage("callouts", ("paragraphs", "entries"), ("contexts",), 6),
]
RELATIONS = [archive.Relation("customer", "c_nationkey", "nation", True), archive.Relation("orders", "o_custkey", "customer", True), archive.Relation("lineitem", "l_orderkey", "orders", True), archive.Relation("nation", "n_regionkey", "region"), archive.Relation("lineitem", "l_partkey", "part"), archive.Relation("lineitem", "l_suppkey", "supplier"), archive.Relation("supplier", "s_nationkey", "nation")]
KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "orders": "o_orderkey", "lineitem": "l_orderkey", "part": "p_partkey", "supplier": "s_suppkey"}


def q_chunks(s, d):
    return passages.chunks(E.papers(s, d), BUDGET).drop("text")


def q_paper_sections(s, d):
    return passages.summary(E.papers(s, d))


def quotations(s, d):
    """A quotation from each paragraph of the papers, in six manners of being claimed and copied."""
    checkpoint_dir(s)
    p = passages.paragraphs(E.papers(s, d)).select("id", "idx", "at", "text").checkpoint()
    after = p.select("id", (F.col("idx") - 1).alias("idx"), F.col("text").alias("after"))
    i, t, how = F.col("idx"), F.col("text"), F.col("idx") % 6
    tail = lambda n: F.substring(t, F.length(t) - n + 1, F.lit(n))
    claimed = F.when(how == 0, F.array(i)).when(how == 1, F.array(i + 1)).when(how == 4, F.array(i, i + 1)).when(how == 5, F.array(F.lit(999)))
    quote = F.when(how == 0, F.upper(F.substring(t, 1, 60))).when(how == 2, F.replace(F.substring(t, 1, 70), F.lit(" "), F.lit("  "))).when(how == 3, F.concat(F.substring(t, 1, 40), F.lit(" ... "), tail(40))).when(how == 4, F.concat(tail(30), F.lit(" "), F.substring(F.coalesce("after", F.lit("")), 1, 30))).otherwise(F.substring(t, 1, 50))
    return p.join(after, ["id", "idx"], "left").select((F.col("id") * 100000 + i).alias("quote_id"), "id", claimed.alias("claimed"), quote.alias("quote")), p


def q_quotes_located(s, d):
    return quotes.located(*quotations(s, d))


def tree(s, d):
    """Works of a venue and those they cite in it, not published later."""
    w = E.works(s, d)
    of = lambda name: w.select(F.col("work_id").alias(name), F.col("venue").alias(f"v_{name}"), F.col("year").alias(f"y_{name}"))
    e = E.citations(s, d).join(of("citing"), "citing").join(of("cited"), "cited").where("v_citing = v_cited and coalesce(y_cited <= y_citing, true)")
    return w, e.select("citing", "cited")


def q_tree_depth(s, d):
    checkpoint_dir(s)
    return graph.depths(*tree(s, d))


def embedded(s, d):
    n = E.table(s, d, "part").agg(F.max("p_partkey") + 1).first()[0]
    return E.table(s, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), (F.col("vec_id") * 7 % n).alias("work_id"), F.when(F.col("vec_id") % 9 == 0, "old").otherwise("v1").alias("space"), "embedding")


def q_semantic_search(s, d):
    w = E.works(s, d)
    out = vectors.semantic_search(embedded(s, d), E.table(s, d, "embeddings").where("vec_id % 100 = 0"), w, "v1", 5, w.where("venue in ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4')"))
    return out.withColumn("score", F.round("score", 4))


def q_vector_coverage(s, d):
    w = E.works(s, d)
    return vectors.coverage(embedded(s, d), w, w.where("abstract is not null"), "v1", "venue")


def history(s, d):
    """Runs of stages, what they would be made from now, and jobs in the queue."""
    w, n = F.col("work_id"), F.col("n")
    each = E.spread(E.works(s, d), "work_id").select("work_id", F.posexplode(F.array(*(F.lit(x.name) for x in STAGES))).alias("n", "stage")).withColumn("h", (w * 31 + n * 17) % 23)
    status = F.when(F.col("h") == 3, "failed").when(F.col("h") == 4, "empty").when(F.col("h") == 5, "refused").when(F.col("h") == 6, "running").otherwise("succeeded")
    runs = each.where("h > 2 and work_id % 8 != 0 and n < 2 + work_id % 6").select("work_id", "stage", status.alias("status"), F.concat(F.lit("f"), (w % 5).cast("string")).alias("fingerprint"), (F.col("h") == 7).alias("superseded"), F.lit(None).cast("string").alias("error"))
    now = each.select("work_id", "stage", F.concat(F.lit("f"), F.when((w + n) % 7 == 0, 9).otherwise(w % 5).cast("string")).alias("fingerprint"))
    jobs = each.where("(work_id + n) % 11 = 0").select("work_id", "stage", F.when(w % 2 == 0, "queued").otherwise("done").alias("status"))
    return runs, now, jobs


def q_stale_works(s, d):
    runs, now, jobs = history(s, d)
    return stages.stale(E.works(s, d), STAGES, runs.where("not superseded"), now, jobs)


def q_superseded_cascade(s, d):
    runs, _, _ = history(s, d)
    origins = E.spread(E.works(s, d), "work_id").select("work_id", F.when(F.col("work_id") % 3 == 0, "parse").when(F.col("work_id") % 3 == 1, "clean").otherwise("segment").alias("stage"))
    return stages.superseded(runs, STAGES, origins).groupBy("stage", "status", "superseded").agg(F.count("*").alias("n"), F.count("error").alias("errors"))


def archived(s, d, nation):
    tables = {t: E.table(s, d, t) for t in KEYS}
    return tables, archive.closure(tables, KEYS, RELATIONS, {"nation": s.createDataFrame([(nation,)], "n_nationkey long")})


def q_project_rows(s, d):
    checkpoint_dir(s)
    _, rows = archived(s, d, 3)
    each = [x.agg(F.count("*").alias("n"), F.sum(KEYS[t]).alias("ids")).select(F.lit(t).alias("part"), "n", "ids") for t, x in rows.items()]
    out = each[0]
    for x in each[1:]:
        out = out.union(x)
    return out


def q_project_restored(s, d):
    """A project's customers and orders taken out, put back under other ids, and counted by nation."""
    checkpoint_dir(s)
    keys = {t: KEYS[t] for t in ("region", "nation", "customer", "orders")}
    relations = [r for r in RELATIONS if r.table in keys and r.target in keys]
    tables = {t: E.table(s, d, t) for t in keys}
    part = archive.closure(tables, keys, relations, {"nation": s.createDataFrame([(3,)], "n_nationkey long")})
    rest = {t: tables[t] if t in ("region", "nation") else tables[t].join(part[t].select(keys[t]), keys[t], "left_anti") for t in keys}
    back = archive.restored(rest, part, keys, relations, {"region": ["r_name"], "nation": ["n_name"]})
    joined = back["orders"].join(back["customer"], F.col("o_custkey") == F.col("c_custkey")).join(back["nation"], F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.count("*").alias("orders"), F.count_distinct("o_orderkey").alias("ids"), F.count_distinct("c_custkey").alias("customers"), F.round(F.sum("o_totalprice"), 2).alias("total"))


DOCUMENTS = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}

BLOCKS = f"""{PAPERS}, b0 AS (SELECT id, unnest(range(0, len(string_split(text, chr(10) || chr(10))))) AS idx, unnest(string_split(text, chr(10) || chr(10))) AS t FROM papers),
blocks AS MATERIALIZED (SELECT *, coalesce(sum(length(t) + 2) OVER (PARTITION BY id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos, CASE WHEN id % 4 < 2 AND idx = max(idx) OVER (PARTITION BY id) THEN 'references' ELSE 'front' END AS section FROM b0)"""
CANONED = "regexp_replace(lower({0}), '[^\\p{{L}}\\p{{Nd}}]+', '', 'g')"
LOCATED = f"""{BLOCKS}, p AS MATERIALIZED (SELECT id, idx, t, pos, {CANONED.format('t')} AS cp FROM blocks),
q0 AS (SELECT p.id * 100000 + p.idx AS quote_id, p.id, p.idx % 6 AS how, p.idx, p.t, n.t AS after FROM p LEFT JOIN p n ON n.id = p.id AND n.idx = p.idx + 1),
q AS MATERIALIZED (SELECT *, {CANONED.format('quote')} AS cq FROM (SELECT quote_id, id, CASE how WHEN 0 THEN [idx] WHEN 1 THEN [idx + 1] WHEN 4 THEN [idx, idx + 1] WHEN 5 THEN [999] END AS claimed, CASE how WHEN 0 THEN upper(t[1:60]) WHEN 2 THEN replace(t[1:70], ' ', '  ') WHEN 3 THEN t[1:40] || ' ... ' || right(t, 40) WHEN 4 THEN right(t, 30) || ' ' || coalesce(after[1:30], '') ELSE t[1:50] END AS quote FROM q0)),
own AS (SELECT q.quote_id, q.id, quote, cq, list(p.idx ORDER BY c.k) AS idxs, string_agg(cp, '' ORDER BY c.k) AS joined, list(cp ORDER BY c.k) AS cps FROM (SELECT quote_id, unnest(claimed) AS idx, unnest(range(0, len(claimed))) AS k FROM q WHERE claimed IS NOT NULL) c JOIN q USING (quote_id) JOIN p ON p.id = q.id AND p.idx = c.idx GROUP BY ALL),
own1 AS MATERIALIZED (SELECT *, contains(joined, cq) AS whole, len(list_filter(string_split_regex(quote, '[\\s;,()\\[\\]]+'), lambda w: NOT contains(joined, {CANONED.format('w')}))) = 0 AS words, list_filter(range(1, len(idxs) + 1), lambda k: contains(cps[k], cq))[1] AS hold FROM own),
found AS (SELECT quote_id, id, cq, coalesce(idxs[hold], idxs[1]) AS paragraph, CASE WHEN hold IS NULL OR NOT whole THEN 'stitched' ELSE 'contiguous' END AS match, whole AND len(list_filter(range(1, length(joined) + 1), lambda i: substr(joined, i, length(cq)) = cq)) > 1 AS ambiguous FROM own1 WHERE whole OR words),
free AS (SELECT quote_id, id, quote, cq, true AS was FROM own1 WHERE NOT (whole OR words) UNION ALL SELECT quote_id, id, quote, cq, false FROM q WHERE claimed IS NULL),
met AS (SELECT f.*, p.idx, cp, contains(cp, cq) AS has, (SELECT count(*) > 1 FROM (SELECT unnest(string_split(quote, '...')) AS w) WHERE length({CANONED.format('w')}) >= 12) AND regexp_matches(cp, array_to_string(list_filter([{CANONED.format('w')} FOR w IN string_split(quote, '...')], lambda w: length(w) >= 12), '.*')) AS ord FROM free f JOIN p USING (id)),
alls AS (SELECT id, string_agg(cp, '' ORDER BY idx) AS whole FROM p GROUP BY 1), ends AS (SELECT id, idx, sum(length(cp)) OVER (PARTITION BY id ORDER BY idx) - length(cp) AS b FROM p),
rest AS (SELECT m.quote_id, m.id, m.cq, any_value(was) AS was, min(idx) FILTER (has) AS first, count(*) FILTER (has) AS holders, min(idx) FILTER (ord) AS ord, any_value(strpos(whole, m.cq)) - 1 AS spot FROM met m JOIN alls USING (id) GROUP BY 1, 2, 3),
rest1 AS (SELECT quote_id, id, cq, coalesce(first, CASE WHEN NOT was THEN coalesce(ord, CASE WHEN spot >= 0 THEN (SELECT max(idx) FROM ends e WHERE e.id = rest.id AND b <= spot) END) END) AS paragraph, CASE WHEN first IS NOT NULL THEN 'contiguous' ELSE 'stitched' END AS match, was AND holders > 1 AS ambiguous FROM rest),
loc AS (SELECT * FROM found UNION ALL SELECT * FROM rest1 WHERE paragraph IS NOT NULL)"""
GRAPH = f"""{WORKS}, {CITES}, e AS MATERIALIZED (SELECT citing AS c, cited AS p FROM cites JOIN works a ON a.work_id = citing JOIN works b ON b.work_id = cited WHERE a.venue = b.venue AND coalesce(b.year <= a.year, true) AND citing <> cited),
big AS (SELECT max(n) + 1 AS n FROM (SELECT count(*) AS n FROM works GROUP BY venue)), reach AS (SELECT work_id AS node, 0 AS k FROM works UNION SELECT c, k + 1 FROM reach JOIN e ON p = node JOIN big ON k < n),
stuck AS MATERIALIZED (SELECT node, year IS NULL AS absent, year FROM reach JOIN big ON k = n JOIN works ON work_id = node),
pl AS (SELECT node, row_number() OVER (ORDER BY absent, year, node) AS r FROM stuck), kept AS MATERIALIZED (SELECT c, p FROM e LEFT JOIN pl a ON a.node = c LEFT JOIN pl b ON b.node = p WHERE a.r IS NULL OR b.r IS NULL OR b.r < a.r),
deep AS (SELECT work_id AS node, 0 AS k FROM works UNION SELECT c, k + 1 FROM deep JOIN kept ON p = node), dep AS MATERIALIZED (SELECT node, max(k) AS depth FROM deep GROUP BY 1),
par AS (SELECT c, arg_max(p, (d2.depth, -p)) AS parent FROM e JOIN dep d1 ON d1.node = c JOIN dep d2 ON d2.node = p WHERE d2.depth < d1.depth GROUP BY 1), bk AS (SELECT e.c, count(*) AS n FROM e JOIN pl a ON a.node = e.c JOIN pl b ON b.node = e.p WHERE b.r > a.r GROUP BY 1)"""
EMBEDDED = "ch AS MATERIALIZED (SELECT vec_id AS chunk_id, vec_id * 7 % (SELECT max(p_partkey) + 1 FROM part) AS work_id, CASE WHEN vec_id % 9 = 0 THEN 'old' ELSE 'v1' END AS space, embedding FROM embeddings)"
RUNS = f"""{WORKS}, names AS (SELECT unnest(range(0, 7)) AS n, unnest(['fetch', 'parse', 'clean', 'segment', 'references', 'embed', 'callouts']) AS stage, unnest([[], [['fetch']], [['parse']], [['parse', 'clean']], [['parse', 'clean']], [['segment']], [['segment'], ['references']]]) AS needs),
ea AS (SELECT work_id, n, stage, needs, (work_id * 31 + n * 17) % 23 AS h FROM works, names), ru AS MATERIALIZED (SELECT work_id, stage, CASE h WHEN 3 THEN 'failed' WHEN 4 THEN 'empty' WHEN 5 THEN 'refused' WHEN 6 THEN 'running' ELSE 'succeeded' END AS status, 'f' || (work_id % 5) AS fp, h = 7 AS superseded FROM ea WHERE h > 2 AND work_id % 8 <> 0 AND n < 2 + work_id % 6)"""
DOCUMENTS_ORACLE = {
    "chunks": f"""WITH RECURSIVE {BLOCKS}, el AS MATERIALIZED (SELECT * FROM blocks WHERE section <> 'references'), f AS (SELECT id, idx, 0 AS chunk, length(t) AS size FROM el WHERE idx = 0 UNION ALL SELECT el.id, el.idx, CASE WHEN size + length(t) > {BUDGET} THEN chunk + 1 ELSE chunk END, CASE WHEN size + length(t) > {BUDGET} THEN length(t) ELSE size + length(t) END FROM f JOIN el ON el.id = f.id AND el.idx = f.idx + 1),
g AS (SELECT f.id, chunk, min(f.idx) AS first, max(f.idx) AS last, min(pos) AS a, max(pos + length(t)) AS b FROM f JOIN el ON el.id = f.id AND el.idx = f.idx GROUP BY 1, 2)
SELECT g.id, chunk AS idx, CAST(first AS INTEGER) AS first, CAST(last AS INTEGER) AS last, CAST(a AS INTEGER) AS "at", CAST(b AS INTEGER) AS "end", 'front' AS section, CAST(ceil((b - a) / 4e0) AS INTEGER) AS tokens, b - a < 120 AS unsure, sha256(substr(text, CAST(a AS BIGINT) + 1, CAST(b - a AS BIGINT))) AS hash FROM g JOIN papers USING (id)""",
    "paper_sections": f"WITH {BLOCKS} SELECT id, section, count(*) AS paragraphs, CAST(sum(length(t)) AS BIGINT) AS chars FROM blocks GROUP BY 1, 2",
    "quotes_located": f"""WITH {LOCATED}, al AS (SELECT loc.*, pos, CASE WHEN match = 'contiguous' THEN list_filter(range(1, length(t) + 1), lambda i: regexp_matches(t[i], '[\\p{{L}}\\p{{Nd}}]')) END AS ks, strpos(cp, cq) AS s FROM loc JOIN p ON p.id = loc.id AND p.idx = loc.paragraph)
SELECT quote_id, CAST(paragraph AS INTEGER) AS paragraph, match, ambiguous, CAST(pos + ks[s] - 1 AS INTEGER) AS "at", CAST(pos + ks[s + length(cq) - 1] AS INTEGER) AS "end" FROM al""",
    "tree_depth": f"WITH RECURSIVE {GRAPH} SELECT node AS work_id, depth, parent, coalesce(bk.n, 0) AS back_edges FROM dep LEFT JOIN par ON par.c = node LEFT JOIN bk ON bk.c = node",
    "semantic_search": f"WITH {WORKS}, {EMBEDDED}, s AS (SELECT q.vec_id AS query_id, chunk_id, ch.work_id, title, year, round(list_cosine_similarity(q.embedding::DOUBLE[], ch.embedding::DOUBLE[]), 6) AS x FROM embeddings q JOIN ch ON space = 'v1' JOIN works ON works.work_id = ch.work_id AND venue IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4') WHERE q.vec_id % 100 = 0) SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rn, chunk_id, work_id, title, year, round(x, 4) AS score FROM s WINDOW w AS (PARTITION BY query_id ORDER BY x DESC, chunk_id) QUALIFY row_number() OVER w <= 5",
    "vector_coverage": f"WITH {WORKS}, {EMBEDDED}, o AS (SELECT work_id, count(*) FILTER (space = 'v1') AS fresh, count(*) FILTER (space <> 'v1') AS old FROM ch GROUP BY 1) SELECT venue, count(*) AS works_total, count(abstract) AS works_with_text, count(*) FILTER (fresh > 0) AS works_embedded, count(*) FILTER (fresh = 0 AND old > 0) AS works_stale_only, CAST(coalesce(sum(fresh), 0) AS BIGINT) AS chunks, CAST(coalesce(sum(old), 0) AS BIGINT) AS stale_chunks FROM works LEFT JOIN o USING (work_id) GROUP BY 1",
    "stale_works": f"""WITH {RUNS}, cur AS (SELECT * FROM ru WHERE NOT superseded), sat AS (SELECT work_id, list(stage) FILTER (status IN ('succeeded', 'empty', 'skipped')) AS ok FROM cur GROUP BY 1), st AS (SELECT e.work_id, e.n, e.stage FROM ea e LEFT JOIN cur c ON c.work_id = e.work_id AND c.stage = e.stage JOIN sat ON sat.work_id = e.work_id WHERE NOT ((e.work_id + e.n) % 11 = 0 AND e.work_id % 2 = 0) AND coalesce(c.status, 'succeeded') IN ('succeeded', 'empty', 'skipped', 'refused')
AND CASE WHEN c.stage IS NULL THEN len(list_filter(needs, lambda ch: NOT list_has_any(ch, coalesce(ok, [])))) = 0 ELSE c.fp <> 'f' || CASE WHEN (e.work_id + e.n) % 7 = 0 THEN 9 ELSE e.work_id % 5 END END) SELECT work_id, string_agg(stage, ',' ORDER BY n) AS stages FROM st GROUP BY 1""",
    "superseded_cascade": f"""WITH {RUNS}, og AS (SELECT work_id, CASE work_id % 3 WHEN 0 THEN 'parse' WHEN 1 THEN 'clean' ELSE 'segment' END AS o FROM works), live AS (SELECT DISTINCT og.* FROM og JOIN ru ON ru.work_id = og.work_id AND ru.stage = o AND NOT superseded),
x AS (SELECT ru.*, NOT superseded AND o IS NOT NULL AND CASE o WHEN 'parse' THEN ru.stage <> 'fetch' WHEN 'clean' THEN ru.stage = 'clean' ELSE ru.stage IN ('segment', 'embed', 'callouts') END AS falls FROM ru LEFT JOIN live USING (work_id)) SELECT stage, CASE WHEN falls AND status = 'running' THEN 'failed' ELSE status END AS status, superseded OR falls AS superseded, count(*) AS n, count(*) FILTER (falls AND status = 'running') AS errors FROM x GROUP BY 1, 2, 3""",
    "project_rows": """WITH c AS (SELECT * FROM customer WHERE c_nationkey = 3), o AS (SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c)), l AS (SELECT * FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o)), p AS (SELECT * FROM part WHERE p_partkey IN (SELECT l_partkey FROM l)), s AS (SELECT * FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM l)), n AS (SELECT * FROM nation WHERE n_nationkey = 3 OR n_nationkey IN (SELECT s_nationkey FROM s)), r AS (SELECT * FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM n))
SELECT 'customer' AS part, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS ids FROM c UNION ALL SELECT 'orders', count(*), CAST(sum(o_orderkey) AS BIGINT) FROM o UNION ALL SELECT 'lineitem', count(*), CAST(sum(l_orderkey) AS BIGINT) FROM l UNION ALL SELECT 'part', count(*), CAST(sum(p_partkey) AS BIGINT) FROM p UNION ALL SELECT 'supplier', count(*), CAST(sum(s_suppkey) AS BIGINT) FROM s UNION ALL SELECT 'nation', count(*), CAST(sum(n_nationkey) AS BIGINT) FROM n UNION ALL SELECT 'region', count(*), CAST(sum(r_regionkey) AS BIGINT) FROM r""",
    "project_restored": "SELECT n_name, count(*) AS orders, count(DISTINCT o_orderkey) AS ids, count(DISTINCT c_custkey) AS customers, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
}
