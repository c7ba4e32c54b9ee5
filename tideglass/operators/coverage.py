"""Detection, mitigation and defence coverage."""

from tideglass.functions.sqlop import Op

_D = "(SELECT DISTINCT technique FROM {detects})"
_M = "(SELECT DISTINCT technique FROM {mitigates})"
_TACTICS = f"tactics AS (SELECT tactic, count(*) AS total, count(d.technique) AS covered, 100.0 * count(d.technique) / count(*) AS pct FROM {{techniques}} AS t LEFT JOIN {_D} AS d ON t.technique = d.technique GROUP BY tactic)"
_GROUPS = f"groups_ AS (SELECT actor, count(*) AS total, count(d.technique) AS covered, 100.0 * count(d.technique) / count(*) AS pct FROM {{uses}} AS u LEFT JOIN {_D} AS d ON u.technique = d.technique GROUP BY actor)"
_GAPS = f"gaps AS (SELECT t.technique, t.tactic, CASE WHEN t.tactic IN :priority THEN 'critical' ELSE 'high' END AS priority FROM {{techniques}} AS t LEFT JOIN {_M} AS m ON t.technique = m.technique WHERE m.technique IS NULL AND NOT t.is_sub ORDER BY t.technique LIMIT :top)"
_IMPROVE = "improvements AS (SELECT tactic, count(*) AS n_gaps, round(count(*) * 2.5, 1) AS expected FROM gaps GROUP BY tactic)"
# COUNTERS is derived: a defence implements a mitigation, which mitigates techniques.
_COUNTERS = "counters AS (SELECT DISTINCT mitigation % 17 AS defence, technique, CAST(CASE WHEN mitigation % 3 = 0 THEN 0.8 ELSE 0.5 + (mitigation % 5) / 10.0 END AS DOUBLE) AS confidence FROM {mitigates})"
_PRIORITY = ["ECONOMY", "STANDARD"]

OPS = {
    "c01_summary": Op(
        "Totals and overall detection coverage.",
        f"SELECT CAST(count(*) AS BIGINT) AS techniques, CAST(count(d.technique) AS BIGINT) AS covered, round(100.0 * count(d.technique) / count(*), 2) AS coverage_pct, (SELECT CAST(count(DISTINCT actor) AS BIGINT) FROM {{uses}}) AS actors, (SELECT CAST(count(*) AS BIGINT) FROM {{flow_reports}}) AS flows FROM {{techniques}} AS t LEFT JOIN {_D} AS d ON t.technique = d.technique",
    ),
    "c02_tactics": Op("Coverage by tactic; without sub-techniques, NULL flags are kept.", f"SELECT tactic, CAST(count(*) AS BIGINT) AS total, CAST(count(d.technique) AS BIGINT) AS covered, round(100.0 * count(d.technique) / count(*), 2) AS pct FROM {{techniques}} AS t LEFT JOIN {_D} AS d ON t.technique = d.technique WHERE :include_sub OR is_sub = FALSE OR is_sub IS NULL GROUP BY tactic", include_sub=False),
    "c02_tactic_gaps": Op("Five uncovered techniques of each tactic.", f"SELECT tactic, technique, CAST(rn AS BIGINT) AS position FROM (SELECT t.tactic, t.technique, row_number() OVER (PARTITION BY t.tactic ORDER BY t.technique) AS rn FROM {{techniques}} AS t LEFT JOIN {_D} AS d ON t.technique = d.technique WHERE d.technique IS NULL) AS r WHERE rn <= :top", top=5),
    "c03_groups": Op("The ten actors with the least coverage of what they use.", f"WITH {_GROUPS} SELECT actor, CAST(total AS BIGINT) AS total, CAST(covered AS BIGINT) AS covered, round(pct, 2) AS pct FROM groups_ ORDER BY pct, actor LIMIT :top", top=10),
    "c03_group_gaps": Op("Five uncovered techniques of each actor.", f"SELECT actor, technique FROM (SELECT u.actor, u.technique, row_number() OVER (PARTITION BY u.actor ORDER BY u.technique) AS rn FROM {{uses}} AS u LEFT JOIN {_D} AS d ON u.technique = d.technique WHERE d.technique IS NULL) AS r WHERE rn <= :top", top=5),
    "c04_recommendations": Op(
        "The worst tactics and actors below thresholds.",
        f"WITH {_TACTICS}, {_GROUPS}, t AS (SELECT 'tactic' AS scope, tactic AS name, pct FROM tactics WHERE pct < :tactic_below ORDER BY pct, tactic LIMIT 3), g AS (SELECT 'actor' AS scope, actor AS name, pct FROM groups_ WHERE pct < :group_below ORDER BY pct, actor LIMIT 2) SELECT scope, name, round(pct, 2) AS pct, CASE WHEN pct < 50 THEN 'high' ELSE 'medium' END AS priority FROM (SELECT * FROM t UNION ALL SELECT * FROM g) AS u",
        tactic_below=70,
        group_below=60,
    ),
    "c05_critical_gaps": Op("Techniques without mitigation, by priority of their tactic.", f"WITH {_GAPS} SELECT technique, tactic, priority FROM gaps", priority=_PRIORITY, top=20),
    "c06_improvements": Op("Expected gain by tactic of the gaps.", f"WITH {_GAPS}, {_IMPROVE} SELECT tactic, CAST(n_gaps AS BIGINT) AS n_gaps, CAST(expected AS DOUBLE) AS expected FROM improvements", priority=_PRIORITY, top=20),
    "c07_impact": Op("Effort and risk of all improvements together.", f"WITH {_GAPS}, {_IMPROVE} SELECT CAST(sum(n_gaps) AS BIGINT) AS techniques, CAST(sum(expected) AS DOUBLE) AS expected, CASE WHEN sum(expected) < 20 THEN '2-4 weeks' ELSE '4-8 weeks' END AS effort, CASE WHEN sum(expected) > 30 THEN 'High' ELSE 'Medium' END AS risk_reduction FROM improvements", priority=_PRIORITY, top=20),
    "c08_plan": Op("The first five improvements, numbered.", f"WITH {_GAPS}, {_IMPROVE} SELECT CAST(row_number() OVER (ORDER BY expected DESC, tactic) AS BIGINT) AS step, tactic, CAST(n_gaps AS BIGINT) AS n_gaps FROM improvements ORDER BY expected DESC, tactic LIMIT 5", priority=_PRIORITY, top=20),
    "c09_technique_stats": Op("Counts of techniques, sub-techniques and revoked ones.", "SELECT CAST(count(*) AS BIGINT) AS total, CAST(sum(CASE WHEN is_sub THEN 1 ELSE 0 END) AS BIGINT) AS subs, CAST(sum(CASE WHEN coalesce(revoked, FALSE) THEN 1 ELSE 0 END) AS BIGINT) AS revoked, CAST(count(DISTINCT tactic) AS BIGINT) AS tactics FROM {techniques}"),
    "c09_group_stats": Op("Techniques by actor, summarised.", "SELECT CAST(count(*) AS BIGINT) AS actors, round(avg(n), 1) AS avg_techniques, CAST(max(n) AS BIGINT) AS most, CAST(min(n) AS BIGINT) AS least FROM (SELECT actor, count(*) AS n FROM {uses} GROUP BY actor) AS g"),
    "c09_flow_stats": Op("Steps by flow, summarised.", "SELECT CAST(count(*) AS BIGINT) AS flows, round(avg(n), 1) AS avg_steps, CAST(max(n) AS BIGINT) AS longest FROM (SELECT episode, count(*) AS n FROM {actions} GROUP BY episode) AS f"),
    "c09_defence_stats": Op("Counters by defence, summarised.", f"WITH {_COUNTERS} SELECT CAST(count(DISTINCT defence) AS BIGINT) AS defences, CAST(count(*) AS BIGINT) AS counters, CAST(count(DISTINCT technique) AS BIGINT) AS techniques, round(avg(confidence), 2) AS avg_confidence FROM counters"),
    "c09_quality_stats": Op("Confidence of actions, summarised.", "SELECT round(avg(confidence), 2) AS avg_confidence, CAST(count(confidence) AS BIGINT) AS rated, CAST(count(*) AS BIGINT) AS actions FROM {actions}"),
    "c10_report": Op("Sections of the coverage report that are computed: coverage, detection, mitigation and gaps by tactic.", f"WITH {_TACTICS} SELECT tactics.tactic, CAST(total AS BIGINT) AS total, round(pct, 1) AS detected_pct, round(100.0 * m.n / total, 1) AS mitigated_pct FROM tactics LEFT JOIN (SELECT tactic, count(*) AS n FROM {{techniques}} AS t JOIN {_M} AS m ON t.technique = m.technique GROUP BY tactic) AS m ON tactics.tactic = m.tactic"),
    "j01_technique_coverage": Op("Coverage status of every technique: strategies, mitigations, status.", "SELECT t.technique, CAST(coalesce(s, 0) AS BIGINT) AS strategies, CAST(coalesce(n, 0) AS BIGINT) AS mitigations, CASE WHEN s IS NULL THEN 'uncovered' WHEN n IS NULL THEN 'partial' ELSE 'covered' END AS status FROM {techniques} AS t LEFT JOIN (SELECT technique, count(*) AS s FROM {detects} GROUP BY technique) AS d ON t.technique = d.technique LEFT JOIN (SELECT technique, count(*) AS n FROM {mitigates} GROUP BY technique) AS m ON t.technique = m.technique WHERE :include_revoked OR NOT coalesce(revoked, FALSE)", include_revoked=False),
    "j02_aggregated_coverage": Op("Coverage of parent techniques by tactic.", f"SELECT tactic, CAST(count(DISTINCT t.technique) AS BIGINT) AS total, CAST(count(DISTINCT d.technique) AS BIGINT) AS covered, CAST(0 AS BIGINT) AS partial FROM {{techniques}} AS t LEFT JOIN {_D} AS d ON t.technique = d.technique WHERE NOT is_sub AND NOT coalesce(revoked, FALSE) GROUP BY tactic"),
    "j03_log_source_gaps": Op(
        "Required keys of analytics against what log sources supply: a missing source is critical, missing more than half is high.",
        """WITH required AS (SELECT * FROM {required_keys}), supplied AS (SELECT * FROM {supplied_keys}),
        known AS (SELECT DISTINCT source FROM supplied), j AS (SELECT analytic, r.source, count(*) AS required, count(s.k) AS present, max(CASE WHEN known.source IS NULL THEN 1 ELSE 0 END) AS no_source FROM required AS r LEFT JOIN supplied AS s ON r.source = s.source AND r.k = s.k LEFT JOIN known ON r.source = known.source GROUP BY analytic, r.source)
        SELECT analytic, source, CAST(required AS BIGINT) AS required, CAST(required - present AS BIGINT) AS missing, CASE WHEN no_source = 1 THEN 'critical' WHEN (required - present) * 2 > required THEN 'high' ELSE 'medium' END AS severity FROM j WHERE required > present""",
    ),
    "j04_strategies": Op("Detection strategies with what they detect.", "SELECT strategy, CAST(count(*) AS BIGINT) AS n_techniques, min(d.technique) AS first_technique, CAST(count(DISTINCT tactic) AS BIGINT) AS n_tactics FROM {detects} AS d JOIN {techniques} AS t ON d.technique = t.technique WHERE NOT coalesce(revoked, FALSE) GROUP BY strategy"),
    "j05_overrides": Op("Analytics' settings with an environment's overrides applied.", "SELECT s.analytic, 'threshold' AS field, coalesce(o.setting, s.setting) AS setting, o.setting IS NOT NULL AS overridden FROM {analytics} AS s LEFT JOIN {environment} AS o ON s.analytic = o.analytic"),
    "j08_rule_search": Op("Rules by status, level and text, best match first.", "SELECT rule, title, CAST((CASE WHEN contains(lower(title), :word) THEN 2 ELSE 0 END) + (CASE WHEN contains(lower(body), :word) THEN 1 ELSE 0 END) AS BIGINT) AS score FROM {rules} WHERE level >= :least AND (contains(lower(title), :word) OR contains(lower(body), :word)) ORDER BY score DESC, rule LIMIT :top", word="standard", least=10, top=50),
    "j09_counters": Op("Techniques that each defence counters, through the mitigations it implements.", f"WITH {_COUNTERS} SELECT defence, technique, round(max(confidence), 6) AS confidence FROM counters GROUP BY defence, technique"),
    "j10_defences": Op("Defences of each technique, most confident first.", f"WITH {_COUNTERS} SELECT technique, defence, confidence, CAST(position AS BIGINT) AS position FROM (SELECT technique, defence, max(confidence) AS confidence, row_number() OVER (PARTITION BY technique ORDER BY max(confidence) DESC, defence) AS position FROM counters GROUP BY technique, defence) AS r"),
    "j12_flow_overlay": Op("Defended actions of each flow.", "SELECT s.episode AS flow, CAST(count(*) AS BIGINT) AS actions, CAST(count(m.technique) AS BIGINT) AS defended, round(100.0 * count(m.technique) / count(*), 2) AS defended_pct FROM {path_steps} AS s LEFT JOIN (SELECT DISTINCT technique FROM {mitigates}) AS m ON s.technique = m.technique GROUP BY s.episode"),
    "j13_defence_list": Op("Defences with the number and strength of their counters.", f"WITH {_COUNTERS} SELECT defence, CAST(count(DISTINCT technique) AS BIGINT) AS n, CASE WHEN count(DISTINCT technique) >= 3 THEN 'high' WHEN count(DISTINCT technique) >= 1 THEN 'medium' ELSE 'low' END AS strength FROM counters GROUP BY defence"),
    "j14_verify": Op("Overall defence coverage, and how many techniques have enough counters.", f"WITH {_COUNTERS}, n AS (SELECT t.technique, count(c.defence) AS n FROM {{techniques}} AS t LEFT JOIN counters AS c ON t.technique = c.technique GROUP BY t.technique) SELECT CAST(count(*) AS BIGINT) AS techniques, CAST(sum(CASE WHEN n > 0 THEN 1 ELSE 0 END) AS BIGINT) AS covered, round(100.0 * sum(CASE WHEN n >= :least THEN 1 ELSE 0 END) / count(*), 2) AS adequate_pct FROM n", least=2),
    "p17_overlay_quality": Op("Counters per live technique.", f"WITH {_COUNTERS}, n AS (SELECT t.technique, count(c.defence) AS n FROM {{techniques}} AS t LEFT JOIN counters AS c ON t.technique = c.technique WHERE NOT coalesce(revoked, FALSE) GROUP BY t.technique) SELECT round(avg(n), 4) AS avg_counters, CAST(min(n) AS BIGINT) AS least, CAST(max(n) AS BIGINT) AS most, round(100.0 * sum(CASE WHEN n >= :least THEN 1 ELSE 0 END) / count(*), 2) AS adequacy_pct, avg(n) >= :least AS passed FROM n", least=2),
    "p18_critical_coverage": Op("A list of critical families by prefix: counters and verdict.", f"WITH {_COUNTERS}, wanted AS (SELECT * FROM (VALUES ('Brand#1'), ('Brand#2'), ('Brand#99')) AS v(prefix)) SELECT prefix, CAST(count(DISTINCT t.technique) AS BIGINT) AS techniques, CAST(count(DISTINCT c.technique) AS BIGINT) AS countered, count(DISTINCT c.technique) > 0 AS passed FROM wanted LEFT JOIN {{techniques}} AS t ON substr(t.family, 1, length(prefix)) = prefix LEFT JOIN counters AS c ON t.technique = c.technique GROUP BY prefix"),
    "p19_detection_lookup": Op("Detections by family prefix: covered, uncovered or no technique.", "SELECT v.prefix, CAST(count(DISTINCT t.technique) AS BIGINT) AS techniques, CAST(count(DISTINCT d.strategy) AS BIGINT) AS strategies, CASE WHEN count(t.technique) = 0 THEN 'no_technique' WHEN count(d.strategy) = 0 THEN 'uncovered' ELSE 'covered' END AS status FROM (VALUES ('Brand#11'), ('Brand#5'), ('Brand#77')) AS v(prefix) LEFT JOIN {techniques} AS t ON substr(t.family, 1, length(v.prefix)) = v.prefix LEFT JOIN {detects} AS d ON t.technique = d.technique GROUP BY v.prefix"),
}


def _defence_cover(mitigates, lineitem):
    """Minimal defences of each flow by greedy cover; flows are orders, whose size is bounded."""
    from pyspark.sql import functions as F

    from tideglass.operators.clustering import greedy_cover

    edges = lineitem.select(F.col("l_orderkey").cast("string").alias("flow"), F.col("l_partkey").alias("technique")).distinct().join(mitigates.select((F.col("mitigation") % 17).alias("item"), "technique").distinct(), "technique")
    return greedy_cover(edges, "flow")


FUNCTIONS = {"j11_minimal_defence_set": (_defence_cover, ["mitigates", "lineitem"], None)}
