"""Skill repository queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from veil.operators import skills as K
from veil.plans.derived import DERIVED
from veil.plans.registry import query

DERIVED["skill_refs"] = "SELECT l_orderkey AS skill_id, l_suppkey AS dep_id FROM lineitem"
DERIVED["skill_parts"] = "SELECT l_orderkey AS skill_id, l_partkey AS dep_id FROM lineitem"
DERIVED["versions"] = """
SELECT l_orderkey AS skill_id, l_linenumber AS version, max(l_extendedprice) AS payload FROM lineitem GROUP BY l_orderkey, l_linenumber"""
DERIVED["phases"] = """
SELECT profile_id AS cycle, round AS phase, CAST(floor(privacy_score * 10 + 0.5) AS INT) % 2 AS new_skills FROM rounds"""


@query("orphan_skills", "J10", "SELECT skill_id FROM skill_rows s WHERE category = 'atomic' AND NOT EXISTS (SELECT 1 FROM skill_refs r WHERE r.dep_id = s.skill_id)")
def _(t):
    return K.orphans(t.skill_rows, t.skill_refs).select("skill_id")


@query("dependents_of_skill", "J11", "SELECT DISTINCT skill_id FROM skill_refs WHERE dep_id = 7")
def _(t):
    return K.dependents(t.skill_refs, 7)


@query("unused_skills", "J13", """
SELECT s.skill_id, count(dep_id) AS uses FROM skill_rows s LEFT JOIN skill_refs r ON r.dep_id = s.skill_id WHERE category = 'atomic' GROUP BY s.skill_id""")
def _(t):
    return K.dependency_counts(t.skill_rows, t.skill_refs)


@query("coupled_skills", "J12", """
WITH d AS (SELECT DISTINCT skill_id, dep_id FROM skill_parts), s AS (SELECT skill_id, list_sort(list(dep_id)) AS deps FROM d GROUP BY skill_id HAVING count(*) > 1),
g AS (SELECT deps, count(*) AS members, min(skill_id) AS rep FROM s GROUP BY deps),
tok AS (SELECT rep, unnest(deps) AS dep, len(deps) AS n, members FROM g),
o AS (SELECT a.rep AS rep_a, b.rep AS rep_b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb, any_value(a.members) AS ma, any_value(b.members) AS mb
  FROM tok a JOIN tok b ON a.dep = b.dep AND a.rep < b.rep GROUP BY a.rep, b.rep)
SELECT rep_a, rep_b, round(c / (na + nb - c), 6) AS jaccard, ma * mb AS pairs FROM o WHERE c / (na + nb - c) > 0.5
UNION ALL SELECT rep, rep, 1, CAST(members * (members - 1) / 2 AS BIGINT) FROM g WHERE members > 1""")
def _(t):
    return K.coupled_sets(t.skill_parts).withColumn("jaccard", F.round("jaccard", 6))


@query("repository_statistics", "G27", """
WITH l AS (SELECT * FROM skill_rows WHERE status <> 'deprecated')
SELECT category, status, method, count(*) AS skills, round(avg(quality), 6) AS avg_quality, CASE WHEN category IS NULL AND status IS NULL AND method IS NULL THEN
 (SELECT count(*) FROM skill_rows s WHERE category = 'atomic' AND NOT EXISTS (SELECT 1 FROM skill_refs r WHERE r.dep_id = s.skill_id)) END AS orphans
FROM l GROUP BY GROUPING SETS ((), (category), (status), (method))""")
def _(t):
    return K.statistics(t.skill_rows, t.skill_refs)


_SCORE = """
WITH a AS (SELECT skill_id, avg(CAST(success AS INT)) AS sr, avg(execution_time) AS tm, avg(CAST(timeout_exceeded AS INT)) AS tr, count(*) AS n FROM executions GROUP BY skill_id)"""


@query("execution_quality", "G28", f"""
{_SCORE} SELECT skill_id, round(sr, 6) AS success_rate, round(tm, 6) AS avg_time, round(sr * 0.6 + greatest(0, 1 - tm / 5) * 0.2 + (1 - tr * 0.5) * 0.2, 6) AS score, n AS executions FROM a""")
def _(t):
    return K.execution_quality(t.executions).select(
        "skill_id", *[F.round(c, 6).alias(c) for c in ("success_rate", "avg_time", "score")], "executions"
    )


@query("skill_scores_with_default", "G28", f"""
{_SCORE} SELECT s.skill_id, round(coalesce(sr * 0.6 + greatest(0, 1 - tm / 5) * 0.2 + (1 - tr * 0.5) * 0.2, 0.5), 6) AS score FROM skill_rows s LEFT JOIN a USING (skill_id)""")
def _(t):
    return K.with_quality(t.skill_rows, t.executions).select("skill_id", F.round("score", 6).alias("score"))


@query("error_types", "G29", """
SELECT skill_id, CASE WHEN timeout_exceeded THEN 'timeout' WHEN error_message LIKE 'Key%' THEN 'key_error' WHEN error_message LIKE 'Value%' THEN 'value_error'
  WHEN error_message LIKE 'Type%' THEN 'type_error' ELSE 'runtime_error' END AS error_type, count(*) AS n FROM executions WHERE NOT success GROUP BY ALL""")
def _(t):
    return K.error_types(t.executions)


@query("common_errors", "G29", """
WITH f AS (SELECT skill_id, error_message AS message, min(record_id) AS first FROM executions WHERE NOT success GROUP BY ALL)
SELECT skill_id, CAST(row_number() OVER (PARTITION BY skill_id ORDER BY first) AS INT) AS rank, message FROM f QUALIFY row_number() OVER (PARTITION BY skill_id ORDER BY first) <= 3""")
def _(t):
    return K.common_errors(t.executions)


@query("error_severity", "G29", """
SELECT skill_id, round(avg(CASE WHEN success THEN 0 ELSE 1 END), 6) AS failure_rate, CASE WHEN avg(CASE WHEN success THEN 0 ELSE 1 END) > 0.8 THEN 'critical'
 WHEN avg(CASE WHEN success THEN 0 ELSE 1 END) > 0.5 THEN 'high' WHEN avg(CASE WHEN success THEN 0 ELSE 1 END) > 0.2 THEN 'medium' ELSE 'low' END AS severity FROM executions GROUP BY skill_id""")
def _(t):
    return K.severity(t.executions).withColumn("failure_rate", F.round("failure_rate", 6))


# the words of part names and types stand for capability keywords here
_DOMAINS = {"warm": ["red", "hot"], "things": ["widget", "ring"], "prices": ["economy", "promo"], "none": ["zebra"]}


@query("domain_coverage", "G30", """
SELECT bool_or(regexp_matches(x, 'red|hot')) AS warm, bool_or(regexp_matches(x, 'widget|ring')) AS things, bool_or(regexp_matches(x, 'economy|promo')) AS prices, bool_or(contains(x, 'zebra')) AS none,
  (bool_or(regexp_matches(x, 'red|hot'))::INT + bool_or(regexp_matches(x, 'widget|ring'))::INT + bool_or(regexp_matches(x, 'economy|promo'))::INT + bool_or(contains(x, 'zebra'))::INT) / 4 AS coverage
FROM (SELECT lower(concat(p_name, ' ', p_type)) AS x FROM part) p""")
def _(t):
    return K.domain_coverage(t.skill_rows, _DOMAINS)


@query("repository_gaps", "G31", """
WITH x AS (SELECT lower(concat(name, '|', description)) AS x, category FROM skill_rows),
k AS (SELECT * FROM (VALUES ('error_handling', 'try|except|error|handle'), ('logging', 'log|record|track'), ('caching', 'cache|memoize'), ('batch', 'batch|bulk|parallel'), ('validation', 'validate|verify|check')) AS v(g, w))
SELECT concat('missing_', g) AS gap, 'medium' AS priority FROM k WHERE NOT EXISTS (SELECT 1 FROM x WHERE regexp_matches(x, w))
UNION ALL SELECT 'functional_shortage', 'high' FROM (SELECT count(*) FILTER (WHERE category = 'functional') AS f, count(*) FILTER (WHERE category = 'atomic') AS a FROM x) c WHERE f < a * 0.5""")
def _(t):
    return K.gaps(t.skill_rows)


@query("review_actions", "G32", "SELECT event_type AS action, count(*) AS n FROM events GROUP BY event_type")
def _(t):
    return t.events.groupBy(F.col("event_type").alias("action")).agg(F.count(F.lit(1)).alias("n"))


@query("exploration_totals", "G33", """
SELECT count(*) AS explorations, CAST(sum(n) AS BIGINT) AS skills, round(sum(s), 4) AS seconds, round(avg(n), 6) AS avg_skills, round(avg(s), 6) AS avg_seconds
FROM (SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS s FROM lineitem GROUP BY l_orderkey) e""")
def _(t):
    runs = t.lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("s"))
    return runs.agg(
        F.count(F.lit(1)).alias("explorations"), F.sum("n").alias("skills"), F.round(F.sum("s"), 4).alias("seconds"),
        F.round(F.avg("n"), 6).alias("avg_skills"), F.round(F.avg("s"), 6).alias("avg_seconds"),
    )


@query("skill_feedback", "G34", """
WITH h AS (SELECT *, row_number() OVER (PARTITION BY skill_id ORDER BY ts DESC, record_id DESC) AS rn FROM executions QUALIFY rn <= 10),
e AS (SELECT *, row_number() OVER (PARTITION BY skill_id ORDER BY rn) AS k FROM h WHERE NOT success)
SELECT skill_id, string_agg(CASE WHEN k <= 3 THEN error_message END, '; ' ORDER BY k) AS common_errors, string_agg(CASE WHEN k <= 2 THEN error_message END, ', ' ORDER BY k) AS improve FROM e GROUP BY skill_id""")
def _(t):
    return K.feedback(t.executions)


@query("cycle_statistics", "G35", """
SELECT round(avg(quality), 6) AS avg_quality, round(avg(success_rate), 6) AS avg_success_rate, avg(quality) >= 0.5 AS target_reached FROM skill_rows""")
def _(t):
    return K.final_statistics(t.skill_rows, 0.5)


@query("phases_until_stall", "W11", """
WITH f AS (SELECT *, sum(new_skills) OVER (PARTITION BY cycle ORDER BY phase ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 0 AS stalled FROM phases),
b AS (SELECT *, coalesce(max(stalled::INT) OVER (PARTITION BY cycle ORDER BY phase ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM f)
SELECT cycle, phase, CAST(new_skills AS INT) AS new_skills, stalled FROM b WHERE before = 0""")
def _(t):
    return K.phases_until_stall(t.phases)


@query("latest_skill_versions", "W09", "SELECT skill_id, max(version) AS version, arg_max(payload, version) AS payload FROM versions GROUP BY skill_id")
def _(t):
    return K.latest_versions(t.versions)


@query("skills_as_of_version", "W09", "SELECT skill_id, max(version) AS version, arg_max(payload, version) AS payload FROM versions WHERE version <= 3 GROUP BY skill_id")
def _(t):
    return K.as_of(t.versions, 3)


@query("restored_skill_versions", "W09", """
SELECT skill_id, version, payload FROM versions UNION ALL SELECT v.skill_id, CAST(m.m + 1 AS INT), payload FROM versions v JOIN (SELECT skill_id, max(version) AS m FROM versions GROUP BY skill_id) m USING (skill_id) WHERE version = 2""")
def _(t):
    return K.restored(t.versions, 2)


@query("skills_for_review", "P26", "SELECT skill_id FROM skill_rows WHERE needs_review OR quality >= 0.7 OR method = 'ai_generated'")
def _(t):
    return K.for_review(t.skill_rows, 0.7).select("skill_id")


@query("skill_search", "X21", "SELECT skill_id FROM skill_rows WHERE contains(lower(name), 'ring') OR contains(lower(description), 'ring')")
def _(t):
    return K.search(t.skill_rows, "RING").select("skill_id")


_SPECS = {
    "status": {"required": True, "options": ["F", "O"]},
    "price": {"required": True, "type": "float", "min": 1000, "max": 400000},
    "customer": {"type": "int", "max_length": 3},
    "priority": {"required": True, "min_length": 6, "pattern": "[1-4]-"},
}


@query("parameter_errors", "P28", r"""
SELECT o_orderkey, error FROM (
 SELECT o_orderkey, 'status: not an option' AS error FROM orders WHERE o_orderstatus NOT IN ('F', 'O')
 UNION ALL SELECT o_orderkey, 'price: below 1000' FROM orders WHERE o_totalprice < 1000 UNION ALL SELECT o_orderkey, 'price: above 400000' FROM orders WHERE o_totalprice > 400000
 UNION ALL SELECT o_orderkey, 'customer: longer than 3' FROM orders WHERE o_custkey > 999
 UNION ALL SELECT o_orderkey, 'priority: missing' FROM orders WHERE o_orderpriority = '4-NOT SPECIFIED'
 UNION ALL SELECT o_orderkey, 'priority: shorter than 6' FROM orders WHERE length(o_orderpriority) < 6 UNION ALL SELECT o_orderkey, 'priority: no match' FROM orders WHERE o_orderpriority = '5-LOW') e""")
def _(t):
    given = F.map_filter(
        F.create_map(
            F.lit("status"), F.col("o_orderstatus"), F.lit("price"), F.col("o_totalprice").cast("string"),
            F.lit("customer"), F.col("o_custkey").cast("string"), F.lit("priority"), F.nullif("o_orderpriority", F.lit("4-NOT SPECIFIED")),
        ),
        lambda _, v: v.isNotNull(),
    )
    return K.parameter_errors(t.orders.select("o_orderkey", given.alias("params")), "o_orderkey", "params", _SPECS)
