"""The same queries in DuckDB's SQL."""

from __future__ import annotations

WORKS = """works AS (SELECT p_partkey AS work_id, p_name AS title, p_brand AS venue, p_type AS work_type, CASE WHEN p_partkey % 13 <> 0 THEN p_size + 1990 END AS year, CASE WHEN p_partkey % 7 <> 0 THEN p_type || ' ' || p_name END AS abstract FROM part)"""
CITES = """cites AS (SELECT DISTINCT a.l_partkey AS citing, b.l_partkey AS cited FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1)"""
PW = """pw AS (SELECT c_nationkey AS project_id, o_orderkey AS work_id, CASE WHEN o_orderkey % 11 <> 0 THEN round(o_totalprice / 1000, 1) END AS relevance, CASE o_orderstatus WHEN 'F' THEN 'included' WHEN 'O' THEN 'undecided' ELSE 'excluded' END AS inclusion_status FROM orders JOIN customer ON o_custkey = c_custkey)"""
M = """m AS (SELECT l_orderkey AS run_id, l_partkey AS work_id, l_returnflag AS field, l_linenumber AS ordinal, CASE WHEN l_linenumber <> 7 THEN l_quantity END AS value, CASE l_linenumber WHEN 1 THEN 'mM' WHEN 2 THEN CASE WHEN l_suppkey % 3 = 0 THEN 'uM' ELSE 'µM' END WHEN 3 THEN CASE l_suppkey % 3 WHEN 0 THEN 'min^-1' WHEN 1 THEN '1/min' ELSE 'min⁻¹' END WHEN 4 THEN CASE WHEN l_suppkey % 3 = 0 THEN 'K' ELSE 'kelvin' END WHEN 5 THEN 'furlong' END AS unit, l_tax * 100 * l_discount * 100 AS error, CAST(l_suppkey AS VARCHAR) AS subject, strftime(l_shipdate, '%Y-%m') AS conditions, l_orderkey % 5 = 0 AS superseded, l_linestatus AS kind FROM lineitem)"""
DOCS = "docs AS (SELECT p_partkey AS work_id, p_partkey * 2 + k AS document_id, CASE (p_partkey + k) % 4 WHEN 0 THEN 'full_text' WHEN 1 THEN 'abstract_only' ELSE 'metadata_only' END AS content_status, p_partkey % 3 <> 0 OR k = p_partkey % 2 OR p_partkey % 15 = 0 AS is_preferred FROM part, (SELECT unnest([0, 1]) AS k) WHERE k = 0 OR p_partkey % 3 = 0)"
FOLD = "lower(regexp_replace(regexp_replace(translate({x}, 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ', 'aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY'), '[-–—_]', ' ', 'g'), '\\s+', ' ', 'g'))"
TEXT = "(" + " OR ".join(f"coalesce(contains({FOLD.format(x=f)}, '{n}'), false)" for n in ("ring", "plate") for f in ("title", "abstract", "venue")) + ")"
VENUE = "venue IN ('Brand#1', 'Brand#2', 'Brand#17', 'Brand#4')"
YEAR = "coalesce(year = 2030 OR year BETWEEN 1995 AND 2020, false)"
W5 = f"{WORKS}, {CITES}, wc AS (SELECT works.*, coalesce(n, 0) AS n_citations FROM works LEFT JOIN (SELECT cited, count(*) AS n FROM cites GROUP BY cited) ON cited = work_id)"
CANON = "CASE WHEN unit IN ('mM', 'uM', 'µM') THEN 'M' WHEN unit IN ('min^-1', '1/min', 'min⁻¹') THEN 's^-1' WHEN unit IN ('K', 'kelvin') THEN '°C' END"
CANONICAL = "CASE WHEN unit = 'mM' THEN value * 1e-3 WHEN unit IN ('uM', 'µM') THEN value * 1e-6 WHEN unit IN ('min^-1', '1/min', 'min⁻¹') THEN value / 60 WHEN unit IN ('K', 'kelvin') THEN value - 273.15 END"
STATUS = "CASE WHEN kind = 'conflict' THEN 'conflict' WHEN value IS NULL THEN 'invalid' WHEN unit IS NULL OR kind = 'inferred' THEN 'review' ELSE 'validated' END"

ORACLE = {
    "search": f"""WITH {W5}, au AS (SELECT work_id, string_agg(name, '; ' ORDER BY author_id) AS authors FROM (SELECT DISTINCT l_partkey AS work_id, l_suppkey AS author_id, s_name AS name FROM lineitem JOIN supplier ON s_suppkey = l_suppkey) GROUP BY work_id)
SELECT p.work_id, title, year, venue, n_citations, substr(abstract, 1, 200) AS snippet, coalesce(authors, '') AS authors FROM (SELECT * FROM wc WHERE {TEXT} AND {VENUE} AND {YEAR} AND n_citations >= 5 ORDER BY n_citations DESC, year DESC NULLS LAST, title, work_id LIMIT 50 OFFSET 10) p LEFT JOIN au ON au.work_id = p.work_id""",
    "search_count": f"WITH {W5} SELECT count(*) AS n FROM wc WHERE {TEXT} AND {VENUE} AND {YEAR} AND n_citations >= 5",
    "facets": f"""WITH {W5} SELECT 'venue' AS facet, venue AS value, count(*) AS n FROM wc WHERE {TEXT} AND {YEAR} AND n_citations >= 5 AND venue IS NOT NULL GROUP BY venue
UNION ALL SELECT 'work_type', work_type, count(*) FROM wc WHERE {TEXT} AND {VENUE} AND {YEAR} AND n_citations >= 5 AND work_type IS NOT NULL GROUP BY work_type
UNION ALL SELECT 'year', CAST(year AS VARCHAR), count(*) FROM wc WHERE {TEXT} AND {VENUE} AND n_citations >= 5 AND year IS NOT NULL GROUP BY year""",
    "project_overview": f"WITH {PW} SELECT project_id, count(*) AS works, count(relevance) AS ranked, count(*) FILTER (inclusion_status = 'undecided') AS undecided, count(*) FILTER (inclusion_status <> 'undecided') AS decided, count(*) FILTER (inclusion_status = 'included') AS included FROM pw GROUP BY project_id",
    "normalised_rank": f"WITH {PW} SELECT project_id, work_id, relevance, CASE WHEN relevance IS NOT NULL THEN round(1 - percent_rank() OVER (PARTITION BY project_id, relevance IS NULL ORDER BY relevance DESC), 6) END AS rank FROM pw",
    "relevance_bands": f"""WITH {PW}, s AS (SELECT project_id, list_reverse_sort(list(relevance) FILTER (relevance IS NOT NULL)) AS v FROM pw GROUP BY project_id),
c AS (SELECT project_id, v[CAST(floor(len(v) * 0.2) AS BIGINT) + 1] AS hi, v[CAST(floor(len(v) * 0.5) AS BIGINT) + 1] AS mid FROM s)
SELECT project_id, CASE WHEN relevance >= hi THEN 'high' WHEN relevance >= mid THEN 'medium' WHEN relevance IS NOT NULL THEN 'low' END AS band, count(*) AS n, min(relevance) AS least FROM pw JOIN c USING (project_id) GROUP BY 1, 2""",
    "top_per_project": f"WITH {PW} SELECT * FROM (SELECT project_id, work_id, relevance, CAST(row_number() OVER (PARTITION BY project_id ORDER BY relevance DESC NULLS LAST, work_id) AS INTEGER) AS rn FROM pw) WHERE rn <= 5",
    "history": """WITH e AS (SELECT event_id, user_id, event_type, ts, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events), l AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, k ORDER BY ts DESC, event_id DESC) AS r FROM e)
SELECT user_id, event_id, event_type, k, rn FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INTEGER) AS rn FROM l WHERE r = 1) WHERE rn <= 25""",
    "text_page": """WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents), l AS (SELECT doc_id, unnest(range(1, len(x) + 1)) AS idx, unnest(x) AS line FROM s),
c AS (SELECT *, length(line) AS chars, sum(length(line)) OVER (PARTITION BY doc_id ORDER BY idx) AS upto FROM l) SELECT doc_id, count(*) AS lines, CAST(sum(chars) AS BIGINT) AS chars FROM c WHERE upto <= 2000 OR idx = 1 GROUP BY doc_id""",
    "span_merge": """WITH x AS (SELECT l_suppkey AS supplier, CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS s, CAST(floor(l_quantity / 20) AS BIGINT) AS q FROM lineitem), y AS (SELECT supplier, s, s + q AS e FROM x),
z AS (SELECT *, max(e) OVER (PARTITION BY supplier ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM y), i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY supplier ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM z)
SELECT supplier, min(s) AS span_start, max(e) AS span_end, count(*) AS n FROM i GROUP BY supplier, island""",
    "median": f"WITH {M} SELECT field, unit, round(quantile_cont(value, 0.5), 6) AS median, count(value) AS n FROM m GROUP BY field, unit",
    "latest_turn": "SELECT conv_id, max(turn) AS turn, max_by(role, turn) AS role, count(*) AS turns FROM conversations GROUP BY conv_id",
    "conversation": "SELECT conv_id, string_agg(CAST(turn AS VARCHAR) || ':' || role || ':' || CAST(length(text) AS VARCHAR), ',' ORDER BY turn, role, length(text)) AS turns FROM conversations GROUP BY conv_id",
    "project_graph": f"""WITH {CITES}, e AS (SELECT * FROM cites WHERE citing <> cited), n AS (SELECT * FROM (SELECT p_partkey AS work_id, CASE WHEN p_partkey % 9 <> 0 THEN (p_partkey * 37 % 100) / 100 END AS relevance FROM part) WHERE coalesce(relevance, 0) >= 0.5 ORDER BY relevance DESC NULLS LAST, work_id LIMIT 100),
i AS (SELECT * FROM e WHERE citing IN (SELECT work_id FROM n) AND cited IN (SELECT work_id FROM n))
SELECT work_id, relevance, (SELECT count(*) FROM e WHERE cited = work_id) AS in_degree, (SELECT count(*) FROM e WHERE citing = work_id) AS out_degree, (SELECT count(*) FROM i WHERE cited = work_id) AS inner_in, (SELECT count(*) FROM i WHERE citing = work_id) AS inner_out FROM n""",
    "cited_by": f"""WITH {CITES}, n AS (SELECT p_partkey AS work_id FROM part WHERE p_partkey % 9 <> 0 AND (p_partkey * 37 % 100) / 100 >= 0.3) SELECT cited, count(DISTINCT citing) AS n_citing FROM cites WHERE citing <> cited AND citing IN (SELECT work_id FROM n) AND cited IN (SELECT work_id FROM n) GROUP BY cited""",
    "reachable": f"""WITH RECURSIVE {CITES}, r AS (SELECT p_partkey AS node, 0 AS hops FROM part WHERE p_partkey < 3 UNION SELECT cited, hops + 1 FROM r JOIN cites ON node = citing WHERE hops < 60) SELECT node, min(hops) AS hops FROM r GROUP BY node""",
    "records": f"""WITH {M} SELECT run_id, work_id, field, ordinal, value, unit, {CANON} AS canonical_unit, round({CANONICAL}, 6) AS canonical_value, subject, conditions, {STATUS} AS status FROM m WHERE NOT superseded""",
    "status_summary": f"WITH {M} SELECT {STATUS} AS status, count(*) AS n, count(DISTINCT work_id) AS works FROM m WHERE NOT superseded GROUP BY 1",
    "matrix": f"""WITH {M}, k AS (SELECT *, lower(trim(subject)) || '|' || lower(trim(conditions)) AS reading FROM m WHERE NOT superseded AND value IS NOT NULL), f AS (SELECT *, row_number() OVER (PARTITION BY work_id, reading, field ORDER BY run_id, ordinal, value) AS rn FROM k)
SELECT work_id, reading, max(value) FILTER (field = 'A') AS field_a, max(value) FILTER (field = 'N') AS field_n, max(value) FILTER (field = 'R') AS field_r FROM f WHERE rn = 1 GROUP BY work_id, reading""",
    "coverage": f"WITH {M} SELECT field, count(DISTINCT CASE WHEN value IS NOT NULL THEN work_id END) AS with_values, (SELECT count(*) FROM part) - count(DISTINCT CASE WHEN value IS NOT NULL THEN work_id END) AS without_values, count(value) AS n_values FROM m WHERE NOT superseded GROUP BY field",
    "unit_outvoted": f"""WITH {M}, k AS (SELECT *, {CANON} AS cu FROM m WHERE NOT superseded), o AS (SELECT field, run_id, cu, count(*) AS own FROM k WHERE cu IS NOT NULL GROUP BY ALL), r AS (SELECT field, run_id, sum(own) AS run_n FROM o GROUP BY ALL), u AS (SELECT field, cu, sum(own) AS un FROM o GROUP BY ALL), t AS (SELECT field, sum(un) AS tn FROM u GROUP BY ALL),
p AS (SELECT r.field, r.run_id, u.cu, tn - run_n AS others, un - coalesce(own, 0) AS ou FROM r JOIN u USING (field) JOIN t USING (field) LEFT JOIN o ON o.field = r.field AND o.run_id = r.run_id AND o.cu = u.cu), d AS (SELECT field, run_id, cu AS dominant FROM p WHERE others >= 5 AND ou >= 0.5 * others)
SELECT k.field, k.cu AS canonical_unit, dominant, count(*) AS n FROM k JOIN d ON k.field = d.field AND k.run_id = d.run_id AND k.cu <> dominant GROUP BY ALL""",
    "error_exceeds": f"WITH {M} SELECT field, count(*) AS n, round(max(error), 4) AS largest FROM m WHERE error >= 0 AND abs(error) > abs(value) GROUP BY field",
    "outliers": f"""WITH {M}, k AS (SELECT field, unit, run_id, work_id, CASE WHEN run_id IN (6, 11) THEN value * 1e5 ELSE value END AS value FROM m WHERE value > 0 AND unit IS NOT NULL), r AS (SELECT field, unit, run_id, count(*) AS n, min(value) AS lo, max(value) AS hi FROM k GROUP BY ALL),
p AS (SELECT *, sum(n) OVER w AS peers, min(lo) OVER w AS plo, max(hi) OVER w AS phi FROM r WINDOW w AS (PARTITION BY field, unit ORDER BY run_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE CURRENT ROW))
SELECT k.field, k.unit, k.run_id, work_id, value, round(greatest(log10(plo) - log10(value), log10(value) - log10(phi)), 6) AS decades_off FROM k JOIN p ON k.field = p.field AND k.unit = p.unit AND k.run_id = p.run_id WHERE peers >= 5 AND greatest(log10(plo) - log10(value), log10(value) - log10(phi)) > 3""",
    "duplicates": f"WITH {M} SELECT work_id % 20 AS work_id, field, subject, conditions, value, unit, count(*) AS n FROM m GROUP BY ALL HAVING count(*) > 1",
    "cell_conflicts": f"WITH {M} SELECT work_id, field, CAST(CAST(subject AS BIGINT) % 10 AS VARCHAR) AS subject, conditions, count(DISTINCT value) AS n_values FROM m GROUP BY ALL HAVING count(DISTINCT value) > 1",
    "fingerprints": f"WITH {M} SELECT sha256(concat_ws(chr(31), lower(field), subject, conditions, lower(coalesce(unit, '')), lower(kind))) AS hash, count(*) AS n FROM m GROUP BY 1",
    "membership_hash": f"WITH {PW} SELECT project_id, sha256(string_agg(w, ',' ORDER BY w)) AS hash FROM (SELECT DISTINCT project_id, CAST(work_id AS VARCHAR) AS w FROM pw WHERE inclusion_status = 'included') GROUP BY project_id",
    "unplanned_works": f"WITH {PW} SELECT project_id, work_id FROM pw WHERE inclusion_status <> 'excluded' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = work_id AND l_quantity > 45)",
    "storage": """WITH x AS (SELECT o_custkey, CAST(sum(CAST(round(o_totalprice) AS BIGINT)) AS BIGINT) AS bytes, count(*) AS files FROM orders GROUP BY o_custkey HAVING sum(CAST(round(o_totalprice) AS BIGINT)) > 500000) SELECT c_nationkey AS project_id, CAST(coalesce(sum(bytes), 0) AS BIGINT) AS bytes, CAST(coalesce(sum(files), 0) AS BIGINT) AS files FROM customer LEFT JOIN x ON o_custkey = c_custkey GROUP BY c_nationkey""",
    "daily_usage": "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 2) AS total, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum FROM events GROUP BY 1, 2",
    "nearest": "SELECT * FROM (SELECT q.vec_id AS query_id, v.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) DESC, v.vec_id) AS rn, round(round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6), 4) AS score FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0) WHERE rn <= 10",
    "preferred_document": f"WITH {DOCS} SELECT work_id, arg_min(document_id, (NOT is_preferred, document_id)) AS document_id, arg_min(content_status, (NOT is_preferred, document_id)) AS content_status, count(*) AS documents FROM docs GROUP BY 1",
    "title_groups": f"WITH {WORKS} SELECT trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS key, min(work_id) AS head, count(*) AS members, max(year) AS latest FROM works GROUP BY 1",
    "token_overlap": """WITH b AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{3,}')) AS t FROM benchmark), x AS (SELECT item_id, t, (SELECT t FROM b WHERE item_id = 0) AS t0 FROM b WHERE item_id <> 0)
SELECT item_id, CAST(len(list_intersect(t, t0)) AS BIGINT) AS overlap, round(CASE WHEN len(t) > 0 AND len(t0) > 0 THEN 2.0::DOUBLE * len(list_intersect(t, t0)) / (len(t) + len(t0)) ELSE 0 END, 6) AS dice FROM x ORDER BY overlap DESC, item_id LIMIT 8""",
    "page_titles": "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, length(regexp_replace(html, '<[^>]*>', '', 'g')) AS plain_chars FROM pages",
    "csv_rows": """WITH x AS (SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS a, c_name || CASE WHEN c_custkey % 3 = 0 THEN ', "x"' ELSE '' END AS b, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment ELSE '' END AS c FROM customer) SELECT c_custkey, a || ',' || CASE WHEN c_custkey % 3 = 0 THEN '"' || replace(b, '"', '""') || '"' ELSE b END || ',' || c || chr(13) || chr(10) AS line FROM x""",
    "claim_order": "SELECT event_id, user_id, event_type FROM events e WHERE event_type <> 'error' AND NOT EXISTS (SELECT 1 FROM events b WHERE b.event_type = 'error' AND b.user_id = e.user_id AND CAST(b.ts AS DATE) = CAST(e.ts AS DATE)) ORDER BY event_type, event_id LIMIT 20",
}

ORACLE["daily_usage_stream"] = ORACLE["daily_usage"]
