"""Drift, model quality, latency, cost and compliance metrics. Times are judged as of a given moment, never now."""

from tideglass.functions.sqlop import Op
from tideglass.sources.stix import RELATIONSHIPS

_ASOF = "2024-01-31 00:00:00"
_SPLIT = "CAST(:as_of AS TIMESTAMP)"
_SPEC = "CASE WHEN coalesce(spec_version, '2.1') <> '2.1' THEN 1 ELSE 0 END"
_REL = f"CASE WHEN type = 'relationship' AND relationship_type NOT IN ({', '.join(repr(r) for r in RELATIONSHIPS)}) THEN 1 ELSE 0 END"

OPS = {
    "k01_version_drift": Op("Objects by version; drift is the share outside the most common one.", "WITH v AS (SELECT source, lang, count(*) AS n FROM {documents} GROUP BY source, lang) SELECT source, CAST(count(*) AS BIGINT) AS versions, CAST(sum(n) AS BIGINT) AS total, round(1 - CAST(max(n) AS DOUBLE) / sum(n), 6) AS drift, CASE WHEN count(*) > 2 THEN 'high' WHEN count(*) > 1 THEN 'medium' ELSE 'none' END AS severity FROM v GROUP BY source"),
    "k02_confidence_drift": Op(
        "Mean confidence before and since a cutoff; significant when it fell by more than a share.",
        f"WITH s AS (SELECT event_type, avg(CASE WHEN ts < {_SPLIT} - INTERVAL 7 DAY THEN value END) AS base, stddev_samp(CASE WHEN ts < {_SPLIT} - INTERVAL 7 DAY THEN value END) AS sd, avg(CASE WHEN ts >= {_SPLIT} - INTERVAL 7 DAY THEN value END) AS recent FROM {{events}} GROUP BY event_type) SELECT event_type, round(base, 6) AS baseline, round(sd, 6) AS deviation, round(recent, 6) AS recent, round(abs(recent - base) / nullif(base, 0), 6) AS drift, recent < base AND abs(recent - base) / nullif(base, 0) > :threshold AS significant FROM s",
        as_of=_ASOF,
        threshold=0.15,
    ),
    "k03_quality_drift": Op(
        "Quality of the last days against as many days before.",
        f"WITH s AS (SELECT avg(CASE WHEN ts >= {_SPLIT} - INTERVAL 10 DAY AND ts < {_SPLIT} THEN value END) AS recent, avg(CASE WHEN ts >= {_SPLIT} - INTERVAL 20 DAY AND ts < {_SPLIT} - INTERVAL 10 DAY THEN value END) AS before FROM {{events}}) SELECT round(before, 6) AS before, round(recent, 6) AS recent, CASE WHEN recent >= before THEN 'none' WHEN (before - recent) / before > 0.4 THEN 'critical' WHEN (before - recent) / before > 0.3 THEN 'high' WHEN (before - recent) / before > 0.2 THEN 'medium' ELSE 'none' END AS severity FROM s",
        as_of=_ASOF,
    ),
    "k04_schema_drift": Op(
        "Shapes of records by type (the ordered set of their JSON keys), the most common one, how many records differ from it, and how many keys that is on average.",
        """WITH s AS (SELECT event_type, array_join(array_sort(coalesce(json_object_keys(props), array())), ',') AS shape, count(*) AS n FROM {events} GROUP BY event_type, array_join(array_sort(coalesce(json_object_keys(props), array())), ',')),
        r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, shape) AS rn, sum(n) OVER (PARTITION BY event_type) AS total FROM s)
        SELECT event_type, CAST(count(*) AS BIGINT) AS shapes, max(CASE WHEN rn = 1 THEN shape END) AS usual_shape, CAST(sum(CASE WHEN rn > 1 THEN n ELSE 0 END) AS BIGINT) AS deviating, round(sum(CASE WHEN shape = '' THEN 0 ELSE 1 + length(shape) - length(replace(shape, ',', '')) END * CAST(n AS DOUBLE)) / max(total), 6) AS avg_keys FROM r GROUP BY event_type""",
    ).against("""WITH k AS (SELECT event_type, coalesce(list_sort(json_keys(props)), []) AS ks FROM {events}), m AS (SELECT event_type, ks, count(*) AS n FROM k GROUP BY ALL), u AS (SELECT event_type, arg_min(array_to_string(ks, ','), (-n, array_to_string(ks, ','))) AS usual_shape, count(*) AS shapes, sum(n) - max(n) AS deviating FROM m GROUP BY event_type)
        SELECT event_type, shapes::BIGINT AS shapes, usual_shape, deviating::BIGINT AS deviating, round((SELECT avg(len(ks)) FROM k WHERE k.event_type = u.event_type), 6) AS avg_keys FROM u"""),
    "k05_status": Op("Overall drift status by source.", "WITH s AS (SELECT d.source, avg(CAST(quality AS DOUBLE)) AS q, avg(CAST(toxic AS DOUBLE)) AS t FROM {documents} AS d JOIN {labels} AS l ON d.doc_id = l.doc_id GROUP BY d.source) SELECT source, CASE WHEN q < 0.5 THEN 'critical' WHEN q < 0.8 THEN 'major' WHEN t > 0.1 THEN 'minor' ELSE 'stable' END AS status FROM s"),
    "k06_precision_recall": Op(
        "Macro precision, recall and their F1 by model; classes without predictions or without truth are left out of each.",
        """WITH c AS (SELECT model_type, truth AS class, count(*) AS actual, 0 AS predicted, sum(CASE WHEN truth = predicted THEN 1 ELSE 0 END) AS hit FROM {predictions} GROUP BY model_type, truth UNION ALL SELECT model_type, predicted, 0, count(*), 0 FROM {predictions} GROUP BY model_type, predicted),
        g AS (SELECT model_type, class, sum(actual) AS actual, sum(predicted) AS predicted, sum(hit) AS hit FROM c GROUP BY model_type, class), m AS (SELECT model_type, avg(CAST(hit AS DOUBLE) / nullif(predicted, 0)) AS p, avg(CAST(hit AS DOUBLE) / nullif(actual, 0)) AS r FROM g GROUP BY model_type)
        SELECT model_type, round(p, 3) AS "precision", round(r, 3) AS recall, round(2 * p * r / nullif(p + r, 0), 3) AS f1 FROM m""".replace('"precision"', "macro_precision"),
    ),
    "k07_calibration": Op("Accuracy and confidence in five bins, and each bin's part of the expected calibration error; confidence 1.0 is in no bin.", "WITH b AS (SELECT model_type, CAST(floor(confidence * 5) AS BIGINT) AS bin, confidence, CASE WHEN truth = predicted THEN 1.0 ELSE 0.0 END AS hit, count(*) OVER (PARTITION BY model_type) AS n_all FROM {predictions}) SELECT model_type, bin, CAST(count(*) AS BIGINT) AS n, round(avg(CAST(hit AS DOUBLE)), 6) AS accuracy, round(avg(confidence), 6) AS confidence, round(abs(avg(CAST(hit AS DOUBLE)) - avg(confidence)) * count(*) / max(n_all), 6) AS error_part FROM b WHERE confidence < 1 GROUP BY model_type, bin").against(
        "WITH n AS (SELECT model_type, count(*) AS n FROM {predictions} GROUP BY model_type) SELECT p.model_type, bin, count(*)::BIGINT AS n, round(count(*) FILTER (truth = predicted) / count(*)::DOUBLE, 6) AS accuracy, round(avg(confidence), 6) AS confidence, round(abs(sum(confidence) - count(*) FILTER (truth = predicted)) / any_value(n.n), 6) AS error_part FROM {predictions} AS p JOIN n USING (model_type), (VALUES (0::BIGINT), (1), (2), (3), (4)) AS bins(bin) WHERE confidence >= bin / 5.0::DOUBLE AND confidence < (bin + 1) / 5.0::DOUBLE GROUP BY p.model_type, bin"
    ),
    "k08_approval": Op("Shares of accepted, edited and rejected items by type.", "SELECT type, CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN status = 'approved' THEN 1.0 ELSE 0.0 END), 3) AS accepted, round(avg(CASE WHEN status = 'rejected' THEN 1.0 ELSE 0.0 END), 3) AS rejected FROM {candidates} GROUP BY type"),
    "k09_gap_metrics": Op("Gaps by severity.", "SELECT CASE WHEN s < 10 THEN 'high' WHEN s < 30 THEN 'medium' ELSE 'low' END AS severity, CAST(count(*) AS BIGINT) AS n, round(count(*) / 100.0, 2) AS gap_rate FROM (SELECT technique, count(*) AS s FROM {mitigates} GROUP BY technique) AS g GROUP BY CASE WHEN s < 10 THEN 'high' WHEN s < 30 THEN 'medium' ELSE 'low' END"),
    "k10_latency": Op(
        "Percentiles of the last thousand calls by endpoint: the element at floor(n p / 100) of the sorted values.",
        "WITH last AS (SELECT event_type, value FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM {events}) AS r WHERE rn <= :most), s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM last) SELECT event_type, max(CASE WHEN i = least(n - 1, floor(n * 50 / 100)) THEN value END) AS p50, max(CASE WHEN i = least(n - 1, floor(n * 95 / 100)) THEN value END) AS p95, max(CASE WHEN i = least(n - 1, floor(n * 99 / 100)) THEN value END) AS p99 FROM s GROUP BY event_type",
        most=1000,
    ),
    "k11_counters": Op("Calls, errors and mean size by endpoint.", "SELECT event_type, CAST(count(*) AS BIGINT) AS calls, round(avg(CASE WHEN value < 5 THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS error_rate, round(avg(value), 6) AS avg_value FROM {events} GROUP BY event_type"),
    "k13_compliance": Op(
        "Compliance report: a point each for a compliance rate of 95 %, no wrong spec version, no unknown relationship, 70 % of techniques detected, and at most 20 % of decisions that reject.",
        f"""WITH v AS (SELECT CAST(count(*) AS DOUBLE) AS n, sum({_SPEC}) AS spec, sum({_REL}) AS rel, sum(greatest({_SPEC}, {_REL})) AS bad FROM {{stix_objects}}),
        c AS (SELECT 100.0 * count(DISTINCT d.technique) / nullif(count(DISTINCT t.technique), 0) AS pct FROM {{techniques}} AS t LEFT JOIN {{detects}} AS d ON t.technique = d.technique),
        r AS (SELECT CAST(sum(CASE WHEN status = 'rejected' THEN 1 ELSE 0 END) AS DOUBLE) / nullif(sum(CASE WHEN status IN ('approved', 'rejected') THEN 1 ELSE 0 END), 0) AS rate FROM {{candidates}}),
        s AS (SELECT 1 - bad / n AS rate, spec, rel, pct, r.rate AS rejects, (CASE WHEN 1 - bad / n >= 0.95 THEN 1 ELSE 0 END) + (CASE WHEN spec = 0 THEN 1 ELSE 0 END) + (CASE WHEN rel = 0 THEN 1 ELSE 0 END) + (CASE WHEN pct >= 70 THEN 1 ELSE 0 END) + (CASE WHEN coalesce(r.rate, 0) <= 0.2 THEN 1 ELSE 0 END) AS points FROM v CROSS JOIN c CROSS JOIN r)
        SELECT round(rate, 6) AS compliance_rate, CAST(spec AS BIGINT) AS spec_violations, CAST(rel AS BIGINT) AS relationship_violations, round(CAST(pct AS DOUBLE), 4) AS coverage_pct, round(rejects, 6) AS reject_rate, CAST(points AS BIGINT) AS points, CASE WHEN points >= 4 THEN 'COMPLIANT' WHEN points >= 2 THEN 'NEEDS_ATTENTION' ELSE 'NON_COMPLIANT' END AS status FROM s""",
    ),
    "k15_cost": Op("Cost by day and model at a price list.", "SELECT CAST(ts AS DATE) AS day, event_type AS model, CAST(count(*) AS BIGINT) AS calls, round(sum(value / 1000 * CAST(CASE event_type WHEN 'click' THEN 0.5 WHEN 'view' THEN 0.1 ELSE 0.2 END AS DOUBLE)), 7) AS cost FROM {events} GROUP BY CAST(ts AS DATE), event_type"),
    "p30_budget": Op("Running cost of each day and whether the next call would pass the budget.", "WITH c AS (SELECT event_id, CAST(ts AS DATE) AS day, ts, CAST(floor(value * 100) AS BIGINT) AS cents FROM {events}) SELECT event_id, CAST(total AS BIGINT) AS total_cents, total > :budget AS over_budget FROM (SELECT event_id, sum(cents) OVER (PARTITION BY day ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS total FROM c) AS w", budget=200000),
}

# For the check: the same rules in another shape.
CHECKS = {
    "k13_compliance": """WITH o AS (SELECT spec_version IS NOT NULL AND spec_version <> '2.1' AS s, coalesce(relationship_type, 'uses') NOT IN ('uses', 'mitigates') AS r FROM {stix_objects}), m AS (SELECT count(*) FILTER (NOT s AND NOT r) / count(*)::DOUBLE AS rate, count(*) FILTER (s) AS spec, count(*) FILTER (r) AS rel FROM o),
        k AS (SELECT rate, spec, rel, 100 * (SELECT count(*) FROM {techniques} WHERE technique IN (SELECT technique FROM {detects})) / (SELECT count(*) FROM {techniques})::DOUBLE AS pct, (SELECT avg((status = 'rejected')::INT) FROM {candidates} WHERE status IN ('approved', 'rejected')) AS rejects FROM m), p AS (SELECT *, (rate >= 0.95)::INT + (spec = 0)::INT + (rel = 0)::INT + (pct >= 70)::INT + (rejects <= 0.2)::INT AS points FROM k)
        SELECT round(rate, 6) AS compliance_rate, spec AS spec_violations, rel AS relationship_violations, round(pct, 4) AS coverage_pct, round(rejects, 6) AS reject_rate, points::BIGINT AS points, ['NON_COMPLIANT', 'NON_COMPLIANT', 'NEEDS_ATTENTION', 'NEEDS_ATTENTION', 'COMPLIANT', 'COMPLIANT'][points + 1] AS status FROM p""",
    "k06_precision_recall": """WITH c AS (SELECT DISTINCT model_type, unnest([truth, predicted]) AS class FROM {predictions}), m AS (SELECT c.model_type, c.class, count(*) FILTER (truth = class AND predicted = class) AS tp, count(*) FILTER (predicted = class) AS pp, count(*) FILTER (truth = class) AS ap FROM c JOIN {predictions} AS p ON p.model_type = c.model_type GROUP BY c.model_type, c.class),
        a AS (SELECT model_type, avg(tp / pp::DOUBLE) FILTER (pp > 0) AS p, avg(tp / ap::DOUBLE) FILTER (ap > 0) AS r FROM m GROUP BY model_type) SELECT model_type, round(p, 3) AS macro_precision, round(r, 3) AS recall, CASE WHEN p + r > 0 THEN round(2 / (1 / nullif(p, 0) + 1 / nullif(r, 0)), 3) END AS f1 FROM a""",
    "k10_latency": "WITH l AS (SELECT event_type, list(value ORDER BY ts DESC, event_id DESC)[:1000] AS vs FROM {events} GROUP BY event_type), s AS (SELECT event_type, list_sort(vs) AS vs, len(vs) AS n FROM l) SELECT event_type, vs[1 + least(n - 1, n * 50 // 100)] AS p50, vs[1 + least(n - 1, n * 95 // 100)] AS p95, vs[1 + least(n - 1, n * 99 // 100)] AS p99 FROM s",
    "p30_budget": "SELECT e.event_id, sum(floor(o.value * 100))::BIGINT AS total_cents, sum(floor(o.value * 100)) > :budget AS over_budget FROM {events} AS e JOIN {events} AS o ON o.ts::DATE = e.ts::DATE AND (o.ts, o.event_id) <= (e.ts, e.event_id) GROUP BY e.event_id",
}
for _name, _text in CHECKS.items():
    OPS[_name].against(_text)
