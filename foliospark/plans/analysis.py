"""Queries on units, relations between fields, samples and reviews, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.operators import records, review, sampling, units
from foliospark.plans.oracle import CANON, CANONICAL, STATUS, M
from foliospark.plans.session import checkpoint_dir
from foliospark.sources import entities as E


def q_canonical_units(s, d):
    m = E.measurements(s, d).select("unit").union(E.kinetics(s, d).select("unit"))
    return units.canonical(m.withColumn("value", F.lit(1.0))).groupBy("unit").agg(F.first("canonical_unit").alias("canonical_unit"), F.round(F.max("scale"), 12).alias("scale"), F.max("shift").alias("shift"), F.count("*").alias("n"))


def q_dimension_mismatch(s, d):
    """Fields declared in mM, s^-1 or degrees, and records of another dimension."""
    declared = s.createDataFrame([("A", "mM"), ("N", "s^-1"), ("R", "°C")], "field string, declared string")
    fields = units.canonical(declared.withColumn("value", F.lit(1.0)), "declared").select("field", F.col("canonical_unit").alias("of"))
    m = records.canonical(E.measurements(s, d)).join(F.broadcast(fields), "field")
    return m.withColumn("fits", units.compatible(F.col("of"), F.col("canonical_unit"))).groupBy("field", "unit", "fits").agg(F.count("*").alias("n"))


def q_derived_gaps(s, d):
    return records.derived_gaps(E.kinetics(s, d), "work_id")


def q_scale_shifts(s, d):
    checkpoint_dir(s)
    run = F.col("subject").cast("long")
    m = E.measurements(s, d).withColumn("run_id", run).withColumn("value", F.when(run % 10 == 0, F.col("value") * 10000).otherwise(F.col("value")))
    out = records.scale_shifts(m)
    return out.select("field", "canonical_unit", "run_id", "n", F.round("median", 9).alias("median"), "others", F.round("others_median", 9).alias("others_median"), F.round("decades", 6).alias("decades"))


def with_projects(s, d):
    owner = E.table(s, d, "supplier").select(F.col("s_suppkey").cast("string").alias("subject"), F.col("s_nationkey").alias("project_id"))
    kind = F.when(F.col("ordinal") == 6, "conflict").when((F.col("ordinal") == 5) & (F.col("run_id") % 3 == 0), "inferred").otherwise("stated")
    return E.measurements(s, d).where("not superseded").withColumn("kind", kind).withColumn("fact_id", F.col("run_id") * 10 + F.col("ordinal")).join(owner, "subject")


def q_qc_sample(s, d):
    checkpoint_dir(s)
    good = records.status(with_projects(s, d)).where("status = 'validated'")
    return sampling.qc_sample(good, "project_id", "fact_id", ["fact_id"])


def reviewed(s, d):
    facts = with_projects(s, d)
    verifier = facts.where("run_id % 11 = 0").select("fact_id", F.when(F.col("run_id") % 2 == 0, "partial").otherwise("passed").alias("result"))
    checks = records.error_exceeds(facts).select("fact_id").distinct()
    sample = sampling.qc_sample(records.status(facts).where("status = 'validated'"), "project_id", "fact_id", ["fact_id"])
    verdicts = facts.where("run_id % 7 = 0").select((F.col("run_id") * 100 + F.col("ordinal")).alias("verdict_id"), F.when(F.col("run_id") % 14 == 0, F.col("fact_id")).otherwise(-1).alias("fact_id"), review.fingerprint(), F.when(F.col("run_id") % 3 == 0, "accept").otherwise("correct").alias("verdict"))
    return facts, verifier, checks, sample, verdicts


def q_review_items(s, d):
    checkpoint_dir(s)
    return review.queue(*reviewed(s, d)).select("project_id", "fact_id", "reason", "verdict", "stale")


def q_review_count(s, d):
    checkpoint_dir(s)
    return review.count(*reviewed(s, d))


ANALYSIS = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}

KINETICS = """kin AS (SELECT p_partkey AS work_id, p_partkey AS run_id, k AS ordinal, 's' || k AS key, unnest(['kcat', 'Km', 'eff']) AS field, unnest([CAST(10 + p_partkey * (k + 1) % 7 AS DOUBLE), 1 + (p_partkey + k) % 5, CAST(10 + p_partkey * (k + 1) % 7 AS DOUBLE) / (1 + (p_partkey + k) % 5) * pow(10, p_partkey % 4) * CASE WHEN p_partkey % 5 = 0 AND k = 2 THEN 1.3e0 ELSE 1e0 END]) AS value, unnest(['s^-1', 'mM', 'mM  1 s  1']) AS unit, unnest(['s^-1', 'M', 'M^-1 s^-1']) AS cu, unnest([1e0, 1e-3, 1e3]) AS scale FROM part, (SELECT unnest(range(0, 5)) AS k))"""
FACTS = f"{M}, facts AS MATERIALIZED (SELECT * REPLACE (CASE WHEN ordinal = 6 THEN 'conflict' WHEN ordinal = 5 AND run_id % 3 = 0 THEN 'inferred' ELSE 'stated' END AS kind), run_id * 10 + ordinal AS fact_id, s_nationkey AS project_id FROM m JOIN supplier ON s_suppkey = CAST(subject AS BIGINT) WHERE NOT superseded)"
MUL = "((({0} & 4294967295) * ({1} & 65535) + ((({0} & 4294967295) * (({1} & 4294967295) >> 16)) & 65535) * 65536) & 4294967295)"
SAMPLE = f"""{FACTS}, good AS MATERIALIZED (SELECT project_id, fact_id, row_number() OVER (PARTITION BY project_id ORDER BY fact_id) - 1 AS num FROM facts WHERE ({STATUS}) = 'validated'),
sizes AS (SELECT project_id, count(*) AS n, max(c) AS c, greatest(least(3, count(*)), least(10, CAST(ceil(count(*) * 0.1) AS BIGINT))) AS size FROM (SELECT *, count(*) OVER (PARTITION BY project_id, fact_id) AS c FROM good) GROUP BY 1),
k0 AS (SELECT project_id, n, unnest(range(1, n)) AS i FROM sizes), k1 AS (SELECT *, (CAST((project_id * 2654435761 + n) AS HUGEINT) + CAST(n - i AS HUGEINT) * 1831565813) % 4294967296 AS a FROM k0),
k2 AS (SELECT project_id, i, CAST(a AS BIGINT) AS a FROM k1), k3 AS (SELECT *, {MUL.format('xor(a, a >> 15)', '(a | 1)')} AS t FROM k2), k4 AS (SELECT *, xor(t, (t + {MUL.format('xor(t, t >> 7)', '(t | 61)')}) & 4294967295) AS u FROM k3),
swap AS MATERIALIZED (SELECT project_id, i, CAST(floor(xor(u, u >> 14) / 4294967296e0 * (i + 1)) AS BIGINT) AS j FROM k4),
tr AS (SELECT project_id, unnest(range(0, least(size * c, n))) AS place, unnest(range(0, least(size * c, n))) AS at, 1 AS i FROM sizes UNION ALL SELECT tr.project_id, place, CASE at WHEN s.i THEN s.j WHEN s.j THEN s.i ELSE at END, tr.i + 1 FROM tr JOIN swap s ON s.project_id = tr.project_id AND s.i = tr.i),
sampled AS MATERIALIZED (SELECT project_id, CAST(p AS INTEGER) AS place, fact_id FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY place) AS p FROM (SELECT project_id, fact_id, min(place) AS place, any_value(size) AS size FROM (SELECT tr.project_id, place, size, fact_id FROM tr JOIN sizes USING (project_id) JOIN good ON good.project_id = tr.project_id AND good.num = tr.at WHERE i = n) GROUP BY 1, 2)) WHERE p <= size)"""
SAMPLE = SAMPLE.replace("tr.place", "place").replace(" at,", " pos,").replace("AS at,", "AS pos,").replace("CASE at WHEN", "CASE pos WHEN").replace("ELSE at END", "ELSE pos END").replace("= tr.at ", "= tr.pos ")
PRINT = "array_to_string([trim(regexp_replace(lower(coalesce(x, '')), '\\s+', ' ', 'g')) FOR x IN [field, subject, conditions, unit, CAST(value AS VARCHAR)]], chr(31))"
QUEUE = f"""{SAMPLE}, verifier AS (SELECT DISTINCT fact_id, CASE WHEN run_id % 2 = 0 THEN 'partial' ELSE 'passed' END AS result FROM facts WHERE run_id % 11 = 0), bad AS (SELECT DISTINCT fact_id FROM facts WHERE error >= 0 AND abs(error) > abs(value)), ids AS (SELECT DISTINCT fact_id FROM sampled),
printed AS MATERIALIZED (SELECT *, {PRINT} AS fp FROM facts), said AS (SELECT run_id * 100 + ordinal AS verdict_id, CASE WHEN run_id % 14 = 0 THEN fact_id ELSE -1 END AS fact_id, fp, CASE WHEN run_id % 3 = 0 THEN 'accept' ELSE 'correct' END AS verdict FROM printed WHERE run_id % 7 = 0),
exact AS (SELECT fact_id, max_by(verdict, verdict_id) AS verdict FROM said GROUP BY 1), alike AS (SELECT fp, max_by(verdict, verdict_id) AS verdict FROM said GROUP BY 1),
reasons AS (SELECT p.*, CASE WHEN kind = 'conflict' THEN 'conflict' WHEN v.result = 'failed' THEN 'failed' WHEN v.result = 'partial' THEN 'partial' WHEN b.fact_id IS NOT NULL THEN 'check' WHEN kind = 'inferred' THEN 'inferred' WHEN s.fact_id IS NOT NULL THEN 'sample' END AS reason FROM printed p LEFT JOIN verifier v USING (fact_id) LEFT JOIN ids s USING (fact_id) LEFT JOIN bad b USING (fact_id)),
items AS (SELECT r.project_id, r.fact_id, reason, coalesce(e.verdict, a.verdict) AS verdict, e.verdict IS NULL AND a.verdict IS NOT NULL AS stale FROM reasons r LEFT JOIN exact e USING (fact_id) LEFT JOIN alike a USING (fp) WHERE reason IS NOT NULL)"""
ANALYSIS_ORACLE = {
    "canonical_units": f"WITH {M}, {KINETICS}, u AS (SELECT unit, {CANON} AS c, CASE WHEN unit = 'mM' THEN 1e-3 WHEN unit IN ('uM', 'µM') THEN 1e-6 WHEN unit LIKE '%min%' THEN 1e0 / 60 WHEN unit IN ('K', 'kelvin') THEN 1e0 END AS scale FROM m UNION ALL SELECT unit, cu, scale FROM kin) SELECT unit, any_value(c) AS canonical_unit, round(max(scale), 12) AS scale, CASE WHEN unit IN ('K', 'kelvin') THEN -273.15e0 WHEN any_value(c) IS NOT NULL THEN 0e0 END AS shift, count(*) AS n FROM u GROUP BY unit",
    "dimension_mismatch": f"WITH {M}, x AS (SELECT field, unit, {CANON} AS c FROM m) SELECT field, unit, c = CASE field WHEN 'A' THEN 'M' WHEN 'N' THEN 's^-1' ELSE '°C' END AS fits, count(*) AS n FROM x GROUP BY 1, 2, 3",
    "derived_gaps": f"WITH {KINETICS}, c AS (SELECT work_id, key, field, value * scale AS v FROM kin), t AS (SELECT a.work_id, a.field AS numerator, b.field AS denominator, c.field AS result, log10(c.v / (a.v / b.v)) AS l FROM c a JOIN c b ON b.work_id = a.work_id AND b.key = a.key AND b.field <> a.field JOIN c ON c.work_id = a.work_id AND c.key = a.key AND c.field <> a.field AND c.field <> b.field), g AS (SELECT work_id, numerator, denominator, result, CAST(floor(min(l) + 0.5) AS BIGINT) AS decades, count(*) AS n FROM t GROUP BY 1, 2, 3, 4 HAVING count(*) >= 4 AND abs(floor(min(l) + 0.5)) BETWEEN 1 AND 9 AND abs(min(l) - floor(min(l) + 0.5)) <= 0.05 AND abs(max(l) - floor(min(l) + 0.5)) <= 0.05) SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY work_id, list_sort([numerator, denominator, result]) ORDER BY numerator, denominator, result) = 1",
    "scale_shifts": f"WITH {M}, v AS MATERIALIZED (SELECT field, {CANON} AS cu, CAST(subject AS BIGINT) AS run_id, abs({CANONICAL}) AS v FROM (SELECT * REPLACE (CASE WHEN CAST(subject AS BIGINT) % 10 = 0 THEN value * 10000 ELSE value END AS value) FROM m) WHERE {CANON} IS NOT NULL AND abs({CANONICAL}) > 0), r AS (SELECT field, cu, run_id, count(*) AS n, median(v) AS med FROM v GROUP BY 1, 2, 3 HAVING count(*) >= 3), o AS (SELECT r.field, r.cu, r.run_id, any_value(n) AS n, any_value(med) AS med, count(*) AS others, median(v) AS omed FROM r JOIN v ON v.field = r.field AND v.cu = r.cu AND v.run_id <> r.run_id GROUP BY 1, 2, 3 HAVING count(*) >= 5) SELECT field, cu AS canonical_unit, run_id, n, round(med, 9) AS median, others, round(omed, 9) AS others_median, round(abs(log10(med / omed)), 6) AS decades FROM o WHERE abs(log10(med / omed)) > 2",
    "qc_sample": f"WITH RECURSIVE {SAMPLE} SELECT * FROM sampled",
    "review_items": f"WITH RECURSIVE {QUEUE} SELECT * FROM items",
    "review_count": f"WITH RECURSIVE {QUEUE} SELECT project_id, count(*) AS n FROM items GROUP BY 1",
}
