"""Technique sequences of episodes, transition statistics, transition graphs, triage and verdicts."""

from tideglass.functions.sqlop import Op

# The first action of each technique in an episode, in order; then neighbours.
_SEQ = """
firsts AS (SELECT episode, technique, ord, action_id, confidence FROM (SELECT *, row_number() OVER (PARTITION BY episode, technique ORDER BY coalesce(ord, 999), action_id) AS rn FROM {actions} WHERE technique IS NOT NULL) AS r WHERE rn = 1),
seq AS (SELECT episode, technique, confidence, row_number() OVER (PARTITION BY episode ORDER BY coalesce(ord, 999), action_id) AS pos, count(*) OVER (PARTITION BY episode) AS len, lead(technique) OVER (PARTITION BY episode ORDER BY coalesce(ord, 999), action_id) AS nxt FROM firsts),
steps AS (SELECT * FROM seq WHERE len >= 2)"""
_STATS = _SEQ + """,
counts AS (SELECT technique, CAST(count(*) AS DOUBLE) AS c FROM steps GROUP BY technique),
vocab AS (SELECT CAST(count(*) AS DOUBLE) AS v FROM counts),
dir AS (SELECT technique AS a, nxt AS b, CAST(count(*) AS DOUBLE) AS n FROM steps WHERE nxt IS NOT NULL GROUP BY technique, nxt),
stats AS (SELECT dir.a, dir.b, dir.n, (dir.n + 1) / (ca.c + v) AS p, (coalesce(rev.n, 0) + 1) / (cb.c + v) AS p_rev, ca.c AS c_a, cb.c AS c_b, v FROM dir JOIN counts AS ca ON dir.a = ca.technique JOIN counts AS cb ON dir.b = cb.technique LEFT JOIN dir AS rev ON rev.a = dir.b AND rev.b = dir.a CROSS JOIN vocab)"""
# Tactic order stands in for the kill chain: forward by one or two is likely, the same tactic less, others hardly.
_PRIOR = "CASE WHEN tb.tactic_order IS NULL OR ta.tactic_order IS NULL THEN 0.1 WHEN ta.tactic = tb.tactic THEN 0.3 WHEN tb.tactic_order = ta.tactic_order + 1 THEN 0.8 WHEN abs(tb.tactic_order - ta.tactic_order) <= 1 THEN 0.2 WHEN tb.tactic_order > ta.tactic_order THEN 0.15 ELSE 0.05 END"
_TACTICS = "tac AS (SELECT p.technique, p.tactic, r.tactic_order FROM {primary_tactic} AS p JOIN {tactic_rank} AS r ON p.tactic = r.tactic)"
_LOGIT = "ln(greatest(least({x}, 1 - 0.00000001), 0.00000001) / (1 - greatest(least({x}, 1 - 0.00000001), 0.00000001)))"
_PTG = _STATS + f""", {_TACTICS},
every AS (SELECT x.technique AS a, y.technique AS b, x.c AS c_a FROM counts AS x JOIN counts AS y ON x.technique <> y.technique),
prior AS (SELECT e.a, e.b, (coalesce(s.n, 0) + 1) / (e.c_a + vocab.v) AS cond, {_PRIOR} AS prior, coalesce(s.n, 0) AS n, CASE WHEN s.n IS NULL THEN 0.0 ELSE least(s.n / 100, 1.0) END AS seen FROM every AS e LEFT JOIN stats AS s ON e.a = s.a AND e.b = s.b LEFT JOIN tac AS ta ON e.a = ta.technique LEFT JOIN tac AS tb ON e.b = tb.technique CROSS JOIN vocab),
score AS (SELECT a, b, n, cond, prior, seen, :alpha * {_LOGIT.replace('{x}', 'cond')} + :beta * {_LOGIT.replace('{x}', 'prior')} + :delta * seen AS score FROM prior),
soft AS (SELECT *, exp(score - max(score) OVER (PARTITION BY a)) AS e FROM score),
edges AS (SELECT a, b, n, cond, prior, seen, score, e / sum(e) OVER (PARTITION BY a) AS p FROM soft),
ranked AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(p, 10) DESC, b) AS rn FROM edges)"""
#: A tactic, and the one that usually comes with it.
IMPLIED = (("initial-access", "persistence"), ("credential-access", "lateral-movement"), ("collection", "exfiltration"), ("lateral-movement", "discovery"))
_W = {"alpha": 1.0, "beta": 0.5, "delta": 0.7}
_TRIAGE = _STATS + f""", {_TACTICS}, judged AS (SELECT s.a, s.b, s.n, abs(s.p - s.p_rev) AS asym, s.p, s.p_rev, ta.tactic_order AS oa, tb.tactic_order AS ob FROM stats AS s LEFT JOIN tac AS ta ON s.a = ta.technique LEFT JOIN tac AS tb ON s.b = tb.technique),
prio AS (SELECT *, (1 - asym) + least(n / 10, 1.0) + CASE WHEN oa <> ob THEN 0.3 / greatest(abs(oa - ob), 1) ELSE 0.0 END + 0.2 * (1 - abs(p - p_rev)) AS priority FROM judged WHERE asym <= :most_asymmetry AND n >= :least)"""
_VERDICTS = "verdicts AS (SELECT * FROM {pair_verdicts})"

OPS = {
    "d01_sequences": Op("Order of techniques in each episode: first occurrences, next technique, mean confidence of the episode.", f"WITH {_SEQ} SELECT episode, technique, CAST(pos AS BIGINT) AS position, nxt AS next_technique, round(avg(coalesce(confidence, 50)) OVER (PARTITION BY episode) / 100, 6) AS episode_confidence FROM steps"),
    "d02_pair_statistics": Op("Directed neighbour counts, smoothed conditional probability and asymmetry.", f"WITH {_STATS} SELECT a, b, CAST(n AS BIGINT) AS n, round(p, 6) AS probability, round(abs(p - p_rev), 6) AS asymmetry FROM stats"),
    "d03_scoped_counts": Op(
        "Neighbour counts by actor and over all.",
        f"WITH {_SEQ}, scoped AS (SELECT actor AS scope, technique, nxt FROM steps JOIN {{attribution}} AS att ON steps.episode = att.episode WHERE nxt IS NOT NULL UNION ALL SELECT 'global', technique, nxt FROM steps WHERE nxt IS NOT NULL) SELECT scope, technique AS a, nxt AS b, CAST(count(*) AS BIGINT) AS n FROM scoped GROUP BY scope, technique, nxt",
    ),
    "d04_ambiguous_pairs": Op("Pairs whose direction is unclear.", f"WITH {_STATS} SELECT a, b, CAST(n AS BIGINT) AS n, round(abs(p - p_rev), 6) AS asymmetry FROM stats WHERE abs(p - p_rev) <= :threshold AND n >= :least", threshold=0.15, least=3),
    "d06_edge_scores": Op("Score of every ordered pair: smoothed probability, tactic prior and observation.", f"WITH {_PTG} SELECT a, b, round(score, 6) AS score FROM score", **_W),
    "d07_transition_graph": Op("Softmax of scores by source; the most likely few, not renormalised.", f"WITH {_PTG} SELECT a, b, CAST(rn AS BIGINT) AS position, round(p, 6) AS probability FROM ranked WHERE rn <= :most AND p >= :least", **_W, most=5, least=0.01),
    "d08_edge_features": Op("What an edge of the transition graph rests on.", f"WITH {_PTG} SELECT a, b, CAST(n AS BIGINT) AS pair_count, round(cond, 6) AS conditional, round(prior, 6) AS prior, CASE WHEN p >= 0.3 THEN 'high' WHEN p <= 0.1 THEN 'low' ELSE 'medium' END AS level, concat(a, ' to ', b, ', seen ', CAST(CAST(n AS BIGINT) AS VARCHAR(20))) AS rationale FROM ranked WHERE rn <= :most AND p >= :least", **_W, most=5, least=0.01),
    "d09_observed_edges": Op("Mean probability of observed transitions, 0.5 where none or zero is known.", "SELECT src, dst, CAST(count(*) AS BIGINT) AS n, round(CASE WHEN coalesce(avg(p), 0) = 0 THEN 0.5 ELSE avg(p) END, 6) AS p FROM {next_edges} GROUP BY src, dst"),
    "d10_latest_model": Op("Newest stored model of each scope.", "SELECT scope, model, created FROM (SELECT scope, model, created, row_number() OVER (PARTITION BY scope ORDER BY created DESC, model DESC) AS rn FROM {stored_models}) AS r WHERE rn = 1").against(
        "SELECT scope, arg_max(model, (created, model)) AS model, max(created) AS created FROM {stored_models} GROUP BY scope"
    ),
    "d11_validation_rates": Op("Shares of validated and unknown transitions.", f"WITH {_VERDICTS} SELECT CAST(count(*) AS BIGINT) AS judged, round(avg(CASE WHEN verdict <> 'unknown' THEN 1.0 ELSE 0.0 END), 6) AS validated_rate, round(avg(CASE WHEN verdict = 'unknown' THEN 1.0 ELSE 0.0 END), 6) AS unknown_rate FROM verdicts"),
    "l30_model_edges": Op("Edges of a model above a probability.", "SELECT src, dst, n, round(p, 6) AS p FROM {ptg_edges} WHERE p >= :least", least=0.2),
    "l31_graph_statistics": Op("Nodes, edges, degree and density of a transition graph.", "SELECT CAST(n AS BIGINT) AS nodes, CAST(e AS BIGINT) AS edges, round(CAST(e AS DOUBLE) / n, 2) AS avg_degree, round(CAST(e AS DOUBLE) / (n * (n - 1)), 4) AS density FROM (SELECT count(*) AS e FROM {ptg_edges}) AS x CROSS JOIN (SELECT count(DISTINCT t) AS n FROM (SELECT src AS t FROM {ptg_edges} UNION ALL SELECT dst FROM {ptg_edges}) AS u) AS y"),
    "l31_degree_histogram": Op("How many nodes have each out-degree.", "SELECT CAST(degree AS BIGINT) AS degree, CAST(count(*) AS BIGINT) AS nodes FROM (SELECT src, count(*) AS degree FROM {ptg_edges} GROUP BY src) AS d GROUP BY degree"),
    "l33_triage": Op("Unclear pairs by priority for review.", f"WITH {_TRIAGE} SELECT a, b, CAST(n AS BIGINT) AS n, round(priority, 6) AS priority FROM (SELECT *, row_number() OVER (ORDER BY round(priority, 9) DESC, a, b) AS rn FROM prio ORDER BY round(priority, 9) DESC, a, b LIMIT :top) AS r", most_asymmetry=0.15, least=3, top=50),
    "l34_verdict_scores": Op("Verdicts as scores between -1 and 1.", f"WITH {_VERDICTS} SELECT src, dst, verdict, round(greatest(-1.0, least(1.0, (CASE verdict WHEN 'forward' THEN confidence WHEN 'reverse' THEN -confidence WHEN 'bidirectional' THEN 0.5 * confidence ELSE 0.1 END) * (0.8 * confidence + 0.2 * least(1.0, 2.0 * cited / available)))), 6) AS score FROM verdicts"),
    "l35_categorised": Op("Transitions by verdict; reversed ones swapped, bidirectional ones twice.", f"WITH {_VERDICTS} SELECT src, dst, 'forward' AS category, confidence FROM verdicts WHERE verdict = 'forward' UNION ALL SELECT dst, src, 'reversed', confidence FROM verdicts WHERE verdict = 'reverse' UNION ALL SELECT src, dst, 'bidirectional', CAST(0.5 AS DOUBLE) FROM verdicts WHERE verdict = 'bidirectional' UNION ALL SELECT dst, src, 'bidirectional', CAST(0.5 AS DOUBLE) FROM verdicts WHERE verdict = 'bidirectional' UNION ALL SELECT src, dst, 'uncertain', CAST(0.1 AS DOUBLE) FROM verdicts WHERE verdict = 'unknown'"),
    "l37_judge_cache": Op("Stored verdicts by age and use: entries, hits, what a cleanup would drop.", "SELECT status, CAST(count(*) AS BIGINT) AS entries, CAST(sum(accesses) AS BIGINT) AS accesses, CAST(sum(CASE WHEN created < CAST(:before AS TIMESTAMP) AND accesses < :least THEN 1 ELSE 0 END) AS BIGINT) AS to_drop FROM {judge_cache} GROUP BY status", before="1998-01-01 00:00:00", least=2).against(
        "SELECT status, count(*) AS entries, sum(accesses)::BIGINT AS accesses, count(*) FILTER (created < CAST(:before AS TIMESTAMP) AND accesses < :least) AS to_drop FROM {judge_cache} GROUP BY status"
    ),
    "l39_tactic_prior": Op("Prior of every pair of tactics.", f"SELECT ta.tactic AS src, tb.tactic AS dst, CAST({_PRIOR} AS DOUBLE) AS prior FROM {{tactic_rank}} AS ta CROSS JOIN {{tactic_rank}} AS tb"),
    "l42_adjacency": Op("Which ordered technique pairs are ever neighbours.", f"WITH {_SEQ} SELECT DISTINCT technique AS a, nxt AS b FROM steps WHERE nxt IS NOT NULL"),
    "l42_alignment": Op("Tactics that two techniques share.", "SELECT x.technique AS a, y.technique AS b, CAST(count(*) AS BIGINT) AS shared FROM {technique_tactic} AS x JOIN {technique_tactic} AS y ON x.tactic = y.tactic AND x.technique < y.technique GROUP BY x.technique, y.technique"),
    "p21_order_check": Op("Steps that go back more than two tactics or jump more than four.", f"WITH {_SEQ}, {_TACTICS}, w AS (SELECT episode, pos, tactic_order, lag(tactic_order) OVER (PARTITION BY episode ORDER BY pos) AS prev FROM steps JOIN tac ON steps.technique = tac.technique) SELECT episode, CAST(pos AS BIGINT) AS position, CASE WHEN tactic_order < prev - 2 THEN 'backward' ELSE 'jump' END AS warning FROM w WHERE tactic_order < prev - 2 OR tactic_order > prev + 4"),
    "p22_missing_tactics": Op(
        "Tactics that those of an episode imply and it lacks: four rules.",
        f"""WITH rules AS (SELECT * FROM (VALUES {', '.join(f"('{has}', '{lacks}')" for has, lacks in IMPLIED)}) AS r(has, lacks)), t AS (SELECT DISTINCT e.episode, k.tactic FROM {{et}} AS e JOIN {{kill_chain}} AS k ON e.technique = k.technique)
        SELECT t.episode, r.lacks AS suggested FROM t JOIN rules AS r ON t.tactic = r.has LEFT JOIN t AS o ON o.episode = t.episode AND o.tactic = r.lacks WHERE o.tactic IS NULL""",
    ).against(
        f"WITH t AS (SELECT episode, list(DISTINCT tactic) AS ts FROM {{et}} JOIN {{kill_chain}} USING (technique) GROUP BY episode) SELECT episode, unnest(list_filter([{', '.join(f"CASE WHEN list_contains(ts, '{has}') AND NOT list_contains(ts, '{lacks}') THEN '{lacks}' END" for has, lacks in IMPLIED)}], lambda x: x IS NOT NULL)) AS suggested FROM t"
    ),
    "d05_persisted_statistics": Op(
        "Transition counts of each scope (all episodes, and each actor's) as one row with a JSON object, keys in order.",
        f"""WITH {_SEQ}, pairs AS (SELECT 'global' AS scope, technique, nxt FROM steps WHERE nxt IS NOT NULL UNION ALL SELECT a.actor, s.technique, s.nxt FROM steps AS s JOIN {{attribution}} AS a ON s.episode = a.episode WHERE s.nxt IS NOT NULL),
        n AS (SELECT scope, concat(technique, '→', nxt) AS pair, count(*) AS n FROM pairs GROUP BY scope, concat(technique, '→', nxt))
        SELECT scope, CAST(count(*) AS BIGINT) AS pairs, CAST(sum(n) AS BIGINT) AS transitions, to_json(map_from_entries(array_sort(collect_list(struct(pair, n))))) AS statistics FROM n GROUP BY scope""",
    ).against(
        f"""WITH {_SEQ}, n AS (SELECT scope, technique || '→' || nxt AS pair, count(*) AS n FROM (SELECT unnest(['global', actor]) AS scope, technique, nxt FROM steps JOIN {{attribution}} USING (episode) WHERE nxt IS NOT NULL) AS u GROUP BY ALL)
        SELECT scope, count(*)::BIGINT AS pairs, sum(n)::BIGINT AS transitions, '{{' || string_agg('"' || pair || '":' || n, ',' ORDER BY pair) || '}}' AS statistics FROM n GROUP BY scope"""
        .replace("'{'", "'{'")
    ),
    "p25_pair_context": Op("Directional strength and how natural a transition is.", f"WITH {_STATS}, {_TACTICS} SELECT s.a, s.b, round(p - p_rev, 6) AS strength, CASE WHEN {_PRIOR} > 0.5 THEN 'natural' WHEN {_PRIOR} > 0.2 THEN 'possible' ELSE 'unlikely' END AS progression, CAST(coalesce(abs(ta.tactic_order - tb.tactic_order), -1) AS BIGINT) AS distance FROM stats AS s LEFT JOIN tac AS ta ON s.a = ta.technique LEFT JOIN tac AS tb ON s.b = tb.technique"),
    "p26_shared_actors": Op("Actors that use both techniques of a pair.", "WITH ua AS (SELECT DISTINCT actor, technique FROM {eta}) SELECT x.technique AS a, y.technique AS b, CAST(count(*) AS BIGINT) AS actors FROM ua AS x JOIN ua AS y ON x.actor = y.actor AND x.technique < y.technique GROUP BY x.technique, y.technique"),
    "p27_model_comparison": Op("Edges that two models share, gained or lost.", "SELECT coalesce(b.src, o.src) AS src, coalesce(b.dst, o.dst) AS dst, CASE WHEN b.src IS NULL THEN 'new' WHEN o.src IS NULL THEN 'removed' ELSE 'modified' END AS change, round(coalesce(o.p, 0) - coalesce(b.p, 0), 6) AS delta FROM {base_model} AS b FULL OUTER JOIN {other_model} AS o ON b.src = o.src AND b.dst = o.dst").against(
        "WITH u AS (SELECT src, dst, p AS b, NULL AS o FROM {base_model} UNION ALL SELECT src, dst, NULL, p FROM {other_model}) SELECT src, dst, CASE WHEN count(b) = 0 THEN 'new' WHEN count(o) = 0 THEN 'removed' ELSE 'modified' END AS change, round(coalesce(sum(o), 0) - coalesce(sum(b), 0), 6) AS delta FROM u GROUP BY src, dst"
    ),
    "p34_proposals": Op("Verdicts above a confidence, best first.", f"WITH {_VERDICTS} SELECT src, dst, verdict, confidence FROM verdicts WHERE confidence >= :least ORDER BY confidence DESC, src, dst LIMIT 100", least=0.5),
    "p35_actors_with_models": Op("Actors with the number of techniques and strong edges of their sequences.", f"WITH {_SEQ}, e AS (SELECT actor, technique, nxt, count(*) AS n FROM steps JOIN {{attribution}} AS att ON steps.episode = att.episode WHERE nxt IS NOT NULL GROUP BY actor, technique, nxt), p AS (SELECT actor, technique, nxt, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY actor, technique) AS p FROM e) SELECT actor, CAST(count(DISTINCT technique) AS BIGINT) AS techniques, CAST(sum(CASE WHEN p >= 0.06 THEN 1 ELSE 0 END) AS BIGINT) AS strong_edges FROM p GROUP BY actor"),
    "p36_transition_provenance": Op("Newest flow of each transition and how many flows have it.", "SELECT src, dst, CAST(count(DISTINCT flow) AS BIGINT) AS flows, CAST(max(flow) AS BIGINT) AS newest FROM {next_edges} GROUP BY src, dst"),
    "p37_episode_sequences": Op("Length, first and last technique of each episode's sequence.", f"WITH {_SEQ} SELECT episode, CAST(max(len) AS BIGINT) AS length, max(CASE WHEN pos = 1 THEN technique END) AS first_technique, max(CASE WHEN nxt IS NULL THEN technique END) AS last_technique FROM steps GROUP BY episode"),
}

# For the check: the same rules in another shape.
CHECKS = {
    "d02_pair_statistics": """WITH f AS (SELECT episode, technique, min((coalesce(ord, 999), action_id)) AS place FROM {actions} WHERE technique IS NOT NULL GROUP BY episode, technique), l AS (SELECT episode, list(technique ORDER BY place) AS ts FROM f GROUP BY episode HAVING count(*) > 1),
        c AS (SELECT t, count(*) AS c FROM (SELECT unnest(ts) AS t FROM l) AS u GROUP BY t), d AS (SELECT ts[i] AS a, ts[i + 1] AS b, count(*) AS n FROM l, range(1, 100) AS r(i) WHERE i < len(ts) GROUP BY a, b), v AS (SELECT count(*) AS v FROM c)
        SELECT d.a, d.b, d.n::BIGINT AS n, round((d.n + 1) / (x.c + v)::DOUBLE, 6) AS probability, round(abs((d.n + 1) / (x.c + v)::DOUBLE - (coalesce(e.n, 0) + 1) / (y.c + v)::DOUBLE), 6) AS asymmetry FROM d JOIN c AS x ON x.t = d.a JOIN c AS y ON y.t = d.b LEFT JOIN d AS e ON e.a = d.b AND e.b = d.a, v""",
    "d09_observed_edges": "WITH g AS (SELECT src, dst, list(p) AS ps FROM {next_edges} GROUP BY src, dst) SELECT src, dst, len(ps)::BIGINT AS n, round(coalesce(nullif(list_avg(ps), 0), 0.5), 6) AS p FROM g",
    "d11_validation_rates": "SELECT count(*) AS judged, round(count(*) FILTER (verdict <> 'unknown') / count(*)::DOUBLE, 6) AS validated_rate, round(count(*) FILTER (verdict = 'unknown') / count(*)::DOUBLE, 6) AS unknown_rate FROM {pair_verdicts}",
    "l34_verdict_scores": "SELECT src, dst, verdict, round(least(1, greatest(-1, c * (4 * confidence + list_min([1, 2 * cited / available::DOUBLE])) / 5)), 6) AS score FROM (SELECT *, coalesce(confidence * map {'forward': 1.0::DOUBLE, 'reverse': -1.0, 'bidirectional': 0.5}[verdict], 0.1) AS c FROM {pair_verdicts})",
    "l35_categorised": "SELECT a AS src, b AS dst, category, coalesce(fixed, confidence) AS confidence FROM {pair_verdicts} JOIN (VALUES ('forward', 'forward', FALSE, NULL::DOUBLE), ('reverse', 'reversed', TRUE, NULL), ('bidirectional', 'bidirectional', FALSE, 0.5), ('bidirectional', 'bidirectional', TRUE, 0.5), ('unknown', 'uncertain', FALSE, 0.1)) AS k(verdict, category, turned, fixed) USING (verdict), LATERAL (SELECT CASE WHEN turned THEN dst ELSE src END AS a, CASE WHEN turned THEN src ELSE dst END AS b)",
    "p34_proposals": "SELECT src, dst, verdict, confidence FROM {pair_verdicts} WHERE confidence >= :least QUALIFY row_number() OVER (ORDER BY confidence DESC, src, dst) <= 100",
}
for _name, _text in CHECKS.items():
    OPS[_name].against(_text)
