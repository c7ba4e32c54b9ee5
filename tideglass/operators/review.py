"""Review queues, feedback, provenance, reports and flow listings."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideglass.functions import scratch
from tideglass.functions.sqlop import Op

_ASOF = "2024-01-31 00:00:00"
_AT = "CAST(:as_of AS TIMESTAMP)"

OPS = {
    "l01_auto_approval": Op("Status that a new candidate gets from its confidence.", "SELECT candidate, CASE WHEN confidence >= :threshold THEN 'auto_approved' ELSE 'pending' END AS status FROM {candidates}", threshold=95),
    "l02_queue": Op("A page of the queue, newest first.", "SELECT candidate, type, confidence FROM {candidates} WHERE status = :status AND confidence >= :least ORDER BY created DESC, candidate LIMIT :top OFFSET :skip", status="pending", least=50, top=50, skip=20),
    "l03_decisions": Op("Candidates after a batch of decisions (candidate, decision).", "SELECT c.candidate, coalesce(d.decision, c.status, 'pending') AS status FROM {candidates} AS c LEFT JOIN {decisions} AS d ON c.candidate = d.candidate").against(
        "SELECT candidate, decision AS status FROM {decisions} SEMI JOIN {candidates} USING (candidate) UNION ALL SELECT candidate, ifnull(status, 'pending') FROM {candidates} ANTI JOIN {decisions} USING (candidate)"
    ),
    "l04_queue_statistics": Op("Count and confidence by status, and the last day's arrivals.", f"SELECT coalesce(status, 'pending') AS status, CAST(count(*) AS BIGINT) AS n, round(avg(confidence), 4) AS avg_confidence, min(confidence) AS least, max(confidence) AS most, CAST(sum(CASE WHEN created >= {_AT} - INTERVAL 24 HOUR THEN 1 ELSE 0 END) AS BIGINT) AS last_day FROM {{candidates}} GROUP BY coalesce(status, 'pending')", as_of=_ASOF),
    "l05_similar_patterns": Op(
        "Techniques like a candidate's first word, by where the word is. The ten lowest ids are scored, as SURVEY L5 has it; with most NULL, all.",
        "SELECT technique, score FROM (SELECT technique, round((CASE WHEN contains(lower(name), :word) THEN 1.0 ELSE 0.5 END) * (CASE WHEN contains(lower(tactic), :word) THEN 1.0 ELSE 0.8 END), 4) AS score, row_number() OVER (ORDER BY technique) AS rn FROM {techniques} WHERE contains(lower(name), :word) OR contains(lower(tactic), :word)) AS t WHERE (:most IS NULL OR rn <= :most) AND score >= :threshold",
        word="part",
        threshold=0.8,
        most=10,
    ),
    "l06_candidate_stats": Op("Candidates by status with rates; NULL status is pending.", f"SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN coalesce(status, 'pending') = 'pending' THEN 1 ELSE 0 END) AS BIGINT) AS pending, round(avg(CASE WHEN coalesce(status, 'pending') = 'pending' THEN confidence END), 4) AS pending_confidence, CAST(sum(CASE WHEN created >= {_AT} - INTERVAL 7 DAY THEN 1 ELSE 0 END) AS BIGINT) AS last_week, round(100.0 * sum(CASE WHEN status = 'approved' THEN 1 ELSE 0 END) / count(*), 2) AS promotion_rate, round(100.0 * sum(CASE WHEN status = 'rejected' THEN 1 ELSE 0 END) / count(*), 2) AS rejection_rate FROM {{candidates}}", as_of=_ASOF),
    "l07_archive": Op("Old candidates by status that an archive run takes.", f"SELECT candidate FROM {{candidates}} WHERE created < {_AT} - INTERVAL 20 DAY AND status = :status", as_of=_ASOF, status="rejected"),
    "l08_latest_decision": Op("Newest decision on each object.", "SELECT user_id AS object_id, event_type AS decision, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM {events}) AS r WHERE rn = 1"),
    "l09_review_counts": Op("Decisions by report and action.", "SELECT user_id AS report_id, CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS BIGINT) AS approved, CAST(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS BIGINT) AS edited, CAST(count(*) AS BIGINT) AS total FROM {events} GROUP BY user_id"),
    "l10_entity_review": Op("Entities after review: rejected ones go, edited confidences (candidate, adjusted) replace.", "SELECT c.candidate, coalesce(e.adjusted, c.confidence) AS confidence FROM {candidates} AS c LEFT JOIN {entity_edits} AS e ON c.candidate = e.candidate WHERE coalesce(c.status, 'pending') <> 'rejected'").against(
        "SELECT candidate, coalesce((SELECT adjusted FROM {entity_edits} AS e WHERE e.candidate = c.candidate), confidence) AS confidence FROM {candidates} AS c WHERE status IS DISTINCT FROM 'rejected'"
    ),
    "l11_feedback": Op("Feedback rows by kind with their score.", "SELECT event_id AS feedback_id, user_id AS analyst, CASE WHEN value < 20 THEN 'correction' WHEN value < 60 THEN 'relevance' ELSE 'quality' END AS kind, round(value / 20, 4) AS score FROM {events}"),
    "l12_feedback_days": Op("Feedback by day over the last week.", f"SELECT CAST(created AS DATE) AS day, CAST(count(*) AS BIGINT) AS n FROM {{candidates}} WHERE created >= {_AT} - INTERVAL 7 DAY GROUP BY CAST(created AS DATE)", as_of=_ASOF),
    "l12_contributors": Op("Ten busiest contributors.", "SELECT user_id, CAST(count(*) AS BIGINT) AS n FROM {events} WHERE user_id <> 0 GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10"),
    "l13_aggregate_confidence": Op("Confidence of an object from its sources and relations.", "WITH s AS (SELECT technique, avg(confidence / 100) AS c FROM {actions} WHERE confidence IS NOT NULL GROUP BY technique), r AS (SELECT technique, avg(coalesce(nullif(mitigation % 10 / 10.0, 0), 0.5)) AS c FROM {brand_mitigates} GROUP BY technique) SELECT coalesce(s.technique, r.technique) AS technique, round(CASE WHEN s.c IS NULL THEN r.c WHEN r.c IS NULL THEN s.c ELSE 0.7 * s.c + 0.3 * r.c END, 6) AS confidence FROM s FULL OUTER JOIN r ON s.technique = r.technique"),
    "l14_relations": Op("Up to fifty relations of each technique in either direction.", "SELECT technique, kind, other FROM (SELECT technique, kind, other, row_number() OVER (PARTITION BY technique, kind ORDER BY other) AS rn FROM (SELECT technique, 'detects' AS kind, strategy AS other FROM {detects} UNION ALL SELECT technique, 'mitigates', mitigation FROM {mitigates}) AS u) AS r WHERE rn <= 50"),
    "l15_warnings": Op("Objects whose evidence is thin or whose confidence is low.", "SELECT technique, CASE WHEN avg(coalesce(confidence, 50)) / 100 < 0.5 THEN 'low confidence' WHEN count(*) < 2 THEN 'sparse evidence' WHEN avg(coalesce(confidence, 50)) / 100 < 0.6 THEN 'moderate confidence' ELSE 'none' END AS warning FROM {actions} GROUP BY technique"),
    "l17_validation": Op("Validation status from the latest check and the votes.", "WITH v AS (SELECT user_id AS object_id, max_by(event_type, ts) AS latest, sum(CASE WHEN value >= 50 THEN 1 ELSE 0 END) AS approvals, sum(CASE WHEN value < 50 THEN 1 ELSE 0 END) AS rejections FROM (SELECT *, row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id) AS rn FROM {events}) AS e WHERE rn = 1 GROUP BY user_id) SELECT object_id, CASE WHEN latest = 'error' THEN 'invalid' WHEN rejections > approvals THEN 'rejected' WHEN approvals > 0 THEN 'approved' ELSE 'unvalidated' END AS status FROM v"),
    "l18_timeline": Op("Objects of a trace in order.", "SELECT user_id AS trace, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS step FROM {events}"),
    "l19_sources": Op("Registered sources by content hash: first id and number of copies.", "SELECT md5(text) AS content_hash, CAST(min(doc_id) AS BIGINT) AS source_id, CAST(count(*) AS BIGINT) AS copies FROM {documents} GROUP BY md5(text)"),
    "l20_report_list": Op("A page of reports of a status, with or without campaign.", "SELECT report_id, source FROM {reports} WHERE status = :status AND campaign IS NOT NULL ORDER BY ingested DESC, report_id LIMIT :top OFFSET :skip", status="completed", top=20, skip=10),
    "l22_report_statistics": Op("Reports by status, campaigns, last week and averages.", f"SELECT status, CAST(count(*) AS BIGINT) AS n, CAST(count(campaign) AS BIGINT) AS with_campaign, CAST(sum(CASE WHEN ingested >= {_AT} - INTERVAL 7 DAY THEN 1 ELSE 0 END) AS BIGINT) AS last_week, round(avg(coalesce(n_chars, 0)), 4) AS avg_chars FROM {{reports}} GROUP BY status", as_of="2024-02-20 00:00:00"),
    "l23_flow_dump": Op("Flows of reports in a time range, its end left out.", "SELECT flow, report_id, created FROM {flow_reports} WHERE created >= CAST(:since AS TIMESTAMP) AND created < CAST(:until AS TIMESTAMP)", since="1995-01-01 00:00:00", until="1996-01-01 00:00:00").against(
        "SELECT flow, report_id, created FROM {flow_reports} WHERE NOT (created < CAST(:since AS TIMESTAMP) OR created >= CAST(:until AS TIMESTAMP))"
    ),
    "l24_flow_filters": Op("Flows of a kind that have a technique of a family.", "SELECT DISTINCT f.flow FROM {flow_reports} AS f JOIN {et} AS e ON f.flow = e.episode WHERE f.status = :status AND e.technique LIKE :suffix", status="O", suffix="%#23"),
    "l25_flow_list": Op("A page of flows, newest first.", "SELECT flow, status FROM {flow_reports} ORDER BY created DESC, flow LIMIT :top OFFSET :skip", top=20, skip=40),
    "l26_flow_overlap": Op(
        "Flows like a given one, itself left out: the share of its techniques that they have, and the cosine of the technique sets, above a threshold.",
        """WITH q AS (SELECT DISTINCT technique FROM {et} WHERE episode = :flow), n AS (SELECT CAST(count(*) AS DOUBLE) AS k FROM q), z AS (SELECT episode, count(*) AS size FROM {et} GROUP BY episode),
        s AS (SELECT e.episode, count(*) AS shared FROM {et} AS e JOIN q ON e.technique = q.technique WHERE e.episode <> :flow GROUP BY e.episode)
        SELECT s.episode, round(shared / k, 6) AS overlap, round(shared / sqrt(k * size), 6) AS cosine FROM s JOIN z ON s.episode = z.episode CROSS JOIN n WHERE shared / sqrt(k * size) >= :least""",
        flow=1,
        least=0.3,
    ).against("""WITH f AS (SELECT episode, list(technique) AS ts FROM {et} GROUP BY episode), q AS (SELECT ts AS wanted FROM f WHERE episode = :flow), c AS (SELECT episode, len(list_intersect(ts, wanted)) AS s, len(ts) AS n, len(wanted) AS k FROM f, q WHERE episode <> :flow)
        SELECT episode, round(s / k::DOUBLE, 6) AS overlap, round(s / (sqrt(k) * sqrt(n)), 6) AS cosine FROM c WHERE s > 0 AND s / (sqrt(k) * sqrt(n)) >= :least"""),
    "l27_describes": Op("Edges from reports to what they describe, without repeats.", "SELECT DISTINCT report, object FROM {described}"),
    "l28_campaign_merge": Op("Edges of campaigns after several are merged (campaign, merged).", "SELECT DISTINCT coalesce(m.merged, u.actor) AS campaign, u.technique FROM {uses} AS u LEFT JOIN {campaign_merges} AS m ON u.actor = m.campaign").against(
        "SELECT m.merged AS campaign, technique FROM {uses} JOIN {campaign_merges} AS m ON actor = campaign UNION SELECT actor, technique FROM {uses} WHERE actor NOT IN (SELECT campaign FROM {campaign_merges})"
    ),
    "l29_flow_nodes": Op("Nodes and edges of normalised flows.", "SELECT episode, CAST(count(*) AS BIGINT) AS nodes, CAST(count(*) - 1 AS BIGINT) AS edges FROM {actions} GROUP BY episode"),
    "l32_scenario_starts": Op("Start techniques by any of several routes: a family, what an actor uses, what a mitigation is for.", "SELECT technique FROM {techniques} WHERE family = :family UNION SELECT technique FROM {uses} WHERE actor = :actor UNION SELECT technique FROM {mitigates} WHERE mitigation = :mitigation", family="Brand#11", actor="NATION_5", mitigation=7).against(
        "SELECT technique FROM {techniques} WHERE family = :family OR technique IN (SELECT technique FROM {uses} WHERE actor = :actor) OR technique IN (SELECT technique FROM {mitigates} WHERE mitigation = :mitigation)"
    ),
    "p01_attribution": Op(
        "The ten actors of each flow that use most of its techniques, with a confidence of fifteen for each one, at most 95.",
        """WITH o AS (SELECT f.episode AS flow, u.actor, count(*) AS overlap FROM {part_use} AS f JOIN {uses} AS u ON f.technique = u.technique GROUP BY f.episode, u.actor),
        r AS (SELECT *, row_number() OVER (PARTITION BY flow ORDER BY overlap DESC, actor) AS rn FROM o)
        SELECT flow, actor, CAST(overlap AS BIGINT) AS overlap, CAST(least(95, 15 * overlap) AS BIGINT) AS confidence FROM r WHERE rn <= :top""",
        top=10,
    ).against("""WITH t AS (SELECT technique, list(DISTINCT actor) AS actors FROM {uses} GROUP BY technique), f AS (SELECT episode AS flow, unnest(actors) AS actor FROM {part_use} AS p JOIN t USING (technique)), o AS (SELECT flow, actor, count(*)::BIGINT AS overlap FROM f GROUP BY flow, actor)
        SELECT flow, actor, overlap, least(95, 15 * overlap)::BIGINT AS confidence FROM o QUALIFY row_number() OVER (PARTITION BY flow ORDER BY overlap DESC, actor) <= :top"""),
    "p13_campaign_span": Op("First and last sight of campaigns, merged ones (campaign, merged) as one.", "SELECT coalesce(m.merged, a.actor) AS campaign, min(f.created) AS first_seen, max(f.created) AS last_seen FROM {attribution} AS a JOIN {flow_reports} AS f ON a.episode = f.flow LEFT JOIN {campaign_merges} AS m ON a.actor = m.campaign GROUP BY coalesce(m.merged, a.actor)").against(
        "WITH s AS (SELECT actor, min(created) AS a, max(created) AS b FROM {attribution} JOIN {flow_reports} ON episode = flow GROUP BY actor), n AS (SELECT ifnull((SELECT m.merged FROM {campaign_merges} AS m WHERE m.campaign = actor), actor) AS campaign, a, b FROM s) SELECT campaign, min(a) AS first_seen, max(b) AS last_seen FROM n GROUP BY campaign"
    ),
    "p14_campaign_list": Op("Campaigns that are not provisional (campaign), with techniques and flows.", "SELECT a.actor AS campaign, CAST(count(DISTINCT e.technique) AS BIGINT) AS techniques, CAST(count(DISTINCT a.episode) AS BIGINT) AS flows FROM {attribution} AS a LEFT ANTI JOIN {provisional} AS p ON a.actor = p.campaign LEFT JOIN {et} AS e ON a.episode = e.episode GROUP BY a.actor").against(
        "WITH k AS (SELECT actor, episode FROM {attribution} WHERE actor NOT IN (SELECT campaign FROM {provisional})) SELECT actor AS campaign, len(list(DISTINCT technique) FILTER (technique IS NOT NULL)) AS techniques, len(list(DISTINCT k.episode)) AS flows FROM k LEFT JOIN {et} AS e ON e.episode = k.episode GROUP BY actor"
    ),
    "p15_report_list": Op("Reports without a provisional campaign (campaign), with how many entities (report_id, entity) each has.", "SELECT r.report_id, CAST(count(DISTINCT e.entity) AS BIGINT) AS entities FROM {reports} AS r LEFT ANTI JOIN {provisional} AS p ON r.campaign = p.campaign LEFT JOIN {report_entities} AS e ON r.report_id = e.report_id GROUP BY r.report_id").against(
        "SELECT report_id, (SELECT count(DISTINCT entity) FROM {report_entities} AS e WHERE e.report_id = r.report_id) AS entities FROM {reports} AS r WHERE campaign IS NULL OR campaign NOT IN (SELECT campaign FROM {provisional})"
    ),
    "p16_report_objects": Op("What each report describes, by type.", "SELECT d.report, CAST(count(DISTINCT CASE WHEN t.is_sub THEN d.object END) AS BIGINT) AS subs, CAST(count(DISTINCT CASE WHEN NOT t.is_sub THEN d.object END) AS BIGINT) AS parents FROM {described} AS d JOIN {techniques} AS t ON d.object = t.technique GROUP BY d.report"),
    "p24_evidence": Op("Best evidence of each technique.", "SELECT technique, episode, action_id FROM (SELECT *, row_number() OVER (PARTITION BY technique ORDER BY coalesce(confidence, 0) DESC, ts DESC, episode, action_id) AS rn FROM {actions}) AS r WHERE rn <= :top", top=5),
    "p28_provenance_confidence": Op("Weighted confidence: sources ranked by strength count 1 / rank.", "WITH w AS (SELECT technique, coalesce(confidence, 0) * (CASE WHEN ord = 1 THEN 1.0 WHEN ord = 2 THEN 0.9 WHEN ord = 3 THEN 0.7 ELSE 0.5 END) AS c, episode, action_id FROM {actions}), r AS (SELECT technique, c, row_number() OVER (PARTITION BY technique ORDER BY c DESC, episode, action_id) AS rn FROM w) SELECT technique, round(least(100.0, sum(c / rn) / sum(1.0 / rn)), 4) AS confidence FROM r GROUP BY technique"),
    "p29_confidence_histogram": Op("Actions by quarter of confidence.", "SELECT CASE WHEN confidence <= 25 THEN '0-25' WHEN confidence <= 50 THEN '25-50' WHEN confidence <= 75 THEN '50-75' ELSE '75-100' END AS bin, CAST(count(*) AS BIGINT) AS n FROM {actions} GROUP BY CASE WHEN confidence <= 25 THEN '0-25' WHEN confidence <= 50 THEN '25-50' WHEN confidence <= 75 THEN '50-75' ELSE '75-100' END"),
    "p38_review_applied": Op("Items after review: status of their decision (episode, action_id, status, confidence), edited confidences replace; without a decision they are approved.", "SELECT a.episode, a.action_id, coalesce(d.status, 'approved') AS status, coalesce(d.confidence, a.confidence) AS confidence FROM {actions} AS a LEFT JOIN {action_reviews} AS d ON a.episode = d.episode AND a.action_id = d.action_id").against(
        "SELECT episode, action_id, ifnull(d.status, 'approved') AS status, CASE WHEN d.confidence IS NULL THEN a.confidence ELSE d.confidence END AS confidence FROM {action_reviews} AS d RIGHT JOIN {actions} AS a USING (episode, action_id)"
    ),
    "p39_change_preview": Op("Nodes that a review would create or link.", "SELECT CAST(sum(CASE WHEN d.technique IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS to_create, CAST(sum(CASE WHEN d.technique IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS to_link, CAST(count(*) AS BIGINT) AS edges FROM (SELECT DISTINCT technique FROM {uses}) AS u LEFT JOIN (SELECT DISTINCT technique FROM {detects}) AS d ON u.technique = d.technique"),
    "p40_duplicate_results": Op("Of duplicate job results the one with most techniques, the earliest of equals.", "SELECT job, result, techniques FROM (SELECT report_id AS job, flow AS result, n AS techniques, row_number() OVER (PARTITION BY report_id ORDER BY n DESC, created, flow) AS rn FROM {flow_reports} AS f JOIN (SELECT episode, CAST(count(*) AS BIGINT) AS n FROM {et} GROUP BY episode) AS c ON f.flow = c.episode) AS r WHERE rn = 1"),
}

#: Actors that one mask tells apart.
MASK = 62


def _attribution(part_use: DataFrame, uses: DataFrame, top: int) -> DataFrame:
    """Actors that use most of a flow's techniques. A technique's actors are bits of masks, so a flow's technique is one
    row for each MASK actors and not one for each actor; bits are added up where a flow's rows are."""
    order = F.row_number().over(Window.orderBy("actor")) - 1
    uses = scratch.written(uses.select("actor", "technique"), "uses")
    actors = scratch.written(uses.select("actor").distinct().withColumn("place", order.cast("long")), "actors")
    placed = uses.join(F.broadcast(actors.withColumnRenamed("actor", "known")), F.col("actor").eqNullSafe(F.col("known")))
    bit = F.expr(f"shiftleft(1L, CAST(place % {MASK} AS INT))")
    masks = placed.groupBy("technique", F.floor(F.col("place") / MASK).alias("word")).agg(F.bit_or(bit).alias("mask"))
    met = part_use.select(F.col("episode").alias("flow"), "technique").join(masks, "technique").select("flow", "word", "mask")

    def added(rows: pa.Table) -> pa.RecordBatch:
        """Of each flow and word of some whole flows the `top` actors."""
        rows = rows.combine_chunks()
        word, mask = rows.column("word").to_numpy(), rows.column("mask").to_numpy()
        flow = rows.column("flow").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        begin = np.flatnonzero(np.r_[True, (flow[1:] != flow[:-1]) | (word[1:] != word[:-1])])
        counts = np.stack([np.add.reduceat((mask >> b) & 1, begin) for b in range(MASK)], axis=1)
        # Actors are in order, and a stable sort keeps it among equal counts.
        best = np.argsort(-counts, axis=1, kind="stable")[:, :top]
        overlap = np.take_along_axis(counts, best, 1)
        at, _ = np.nonzero(overlap)
        place = (word[begin][:, None] * MASK + best)[overlap > 0]
        return pa.record_batch([rows.column("flow").combine_chunks().take(pa.array(begin[at])), pa.array(place), pa.array(overlap[overlap > 0])], names=["flow", "place", "overlap"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in (b for b in batches if b.num_rows):
            own = pa.Table.from_batches([batch])
            held = own if held is None else pa.concat_tables([held, own])
            flow = batch.column(0).dictionary_encode(null_encoding="encode").indices.to_numpy()
            last = int(np.flatnonzero(flow != flow[-1])[-1]) + 1 if (flow != flow[-1]).any() else 0  # the last flow may go on
            if last:
                whole = held.num_rows - len(flow) + last
                yield added(held.slice(0, whole))
                held = held.slice(whole)
        if held is not None:
            yield added(held)

    kind = met.schema["flow"].dataType.simpleString()
    found = met.repartition("flow").sortWithinPartitions("flow", "word").mapInArrow(run, f"flow {kind}, place long, overlap long")
    if actors.count() > MASK:
        rank = F.row_number().over(Window.partitionBy("flow").orderBy(F.desc("overlap"), "place"))
        found = found.withColumn("rn", rank).where(F.col("rn") <= top)
    named = found.join(F.broadcast(actors), "place")
    return named.select("flow", "actor", "overlap", F.least(F.lit(95), 15 * F.col("overlap")).cast("bigint").alias("confidence"))


OPS["p01_attribution"].by(_attribution)

# For the check: the same rules in another shape.
CHECKS = {
    "l13_aggregate_confidence": "WITH t AS (SELECT DISTINCT technique FROM {actions} UNION SELECT technique FROM {brand_mitigates}), v AS (SELECT technique, (SELECT avg(confidence) / 100 FROM {actions} AS a WHERE a.technique = t.technique) AS s, (SELECT avg(CASE WHEN mitigation % 10 = 0 THEN 0.5::DOUBLE ELSE (mitigation % 10) / 10.0::DOUBLE END) FROM {brand_mitigates} AS m WHERE m.technique = t.technique) AS r FROM t) SELECT technique, round(CASE WHEN s IS NOT NULL AND r IS NOT NULL THEN (7 * s + 3 * r) / 10 ELSE coalesce(s, r) END, 6) AS confidence FROM v WHERE s IS NOT NULL OR r IS NOT NULL",
    "p28_provenance_confidence": "WITH g AS (SELECT technique, list_reverse_sort(list(coalesce(confidence, 0)::DOUBLE * CASE ord WHEN 1 THEN 1 WHEN 2 THEN 0.9::DOUBLE WHEN 3 THEN 0.7::DOUBLE ELSE 0.5 END)) AS cs FROM {actions} GROUP BY technique) SELECT technique, round(least(100, list_sum(list_transform(cs, lambda c, i: c / i)) / list_sum(list_transform(cs, lambda c, i: 1 / i))), 4) AS confidence FROM g",
    "l07_archive": "SELECT candidate FROM {candidates} WHERE date_diff('microsecond', created, CAST(:as_of AS TIMESTAMP)) > 20 * 86400000000 AND status = :status",
}
for _name, _text in CHECKS.items():
    OPS[_name].against(_text)
