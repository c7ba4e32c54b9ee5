"""Construction of attack flows: order of steps, edges between them, and their statistics."""

from tideglass.functions.sqlop import Op

# Temporal words come from the order's line here; steps are the actions of an episode with a tactic.
_STEPS = """
steps AS (SELECT a.episode, a.action_id, a.technique, a.confidence, p.tactic, coalesce(r.tactic_order, 7) AS tactic_order, CASE WHEN a.ord = 1 THEN 1 WHEN a.ord >= 6 THEN 3 ELSE 2 END AS temporal FROM {actions} AS a LEFT JOIN {primary_tactic} AS p ON a.technique = p.technique LEFT JOIN {tactic_rank} AS r ON p.tactic = r.tactic),
ordered AS (SELECT *, row_number() OVER (PARTITION BY episode ORDER BY temporal, tactic_order, coalesce(confidence, 0) DESC, technique, action_id) AS pos FROM steps)"""
_EDGES = _STEPS + """,
nb AS (SELECT episode, pos, technique, tactic, tactic_order, confidence, lead(technique) OVER w AS t2, lead(tactic) OVER w AS tactic2, lead(tactic_order) OVER w AS order2, lead(confidence) OVER w AS c2 FROM ordered WINDOW w AS (PARTITION BY episode ORDER BY pos)),
hist AS (SELECT technique AS h1, t2 AS h2 FROM nb WHERE t2 IS NOT NULL GROUP BY technique, t2 HAVING count(*) >= 50),
edges AS (SELECT nb.*, greatest(0.1, least(1.0, 0.6 + (CASE WHEN h1 IS NULL THEN 0.0 ELSE 0.2 END) + (CASE WHEN tactic = tactic2 THEN 0.1 ELSE 0.0 END) - (CASE WHEN tactic_order - order2 > 3 THEN 0.1 ELSE 0.0 END) + (CASE WHEN (coalesce(confidence, 50) + coalesce(c2, 50)) / 2 > 80 THEN 0.05 WHEN (coalesce(confidence, 50) + coalesce(c2, 50)) / 2 < 40 THEN -0.05 ELSE 0.0 END))) AS probability FROM nb LEFT JOIN hist ON nb.technique = h1 AND nb.t2 = h2 WHERE t2 IS NOT NULL)"""
_FIRSTS = "acts AS (SELECT episode, technique, tactic, row_number() OVER (PARTITION BY episode, tactic ORDER BY action_id) AS rn, count(*) OVER (PARTITION BY episode, tactic) AS n, action_id, tactic_order FROM steps)"

OPS = {
    "f01_step_order": Op("Steps by temporal word, tactic, confidence and name.", f"WITH {_STEPS} SELECT episode, action_id, CAST(pos AS BIGINT) AS position FROM ordered"),
    "f02_next_edges": Op("Probability of each step following the one before.", f"WITH {_EDGES} SELECT episode, CAST(pos AS BIGINT) AS position, technique AS src, t2 AS dst, round(probability, 6) AS probability FROM edges"),
    "f03_rationale": Op("Why an edge has its probability.", f"WITH {_EDGES} SELECT episode, CAST(pos AS BIGINT) AS position, concat(CASE WHEN probability >= 0.8 THEN 'high' WHEN probability >= 0.6 THEN 'moderate' ELSE 'low' END, ' confidence, ', CASE WHEN tactic = tactic2 THEN 'same tactic' WHEN order2 > tactic_order THEN 'tactic progression' ELSE 'temporal sequence' END) AS rationale FROM edges"),
    "f04_cooccurrence_edges": Op(
        "Edges within a tactic (all pairs of few actions, else from the first) and between the first actions of neighbouring tactics.",
        f"""WITH {_STEPS}, {_FIRSTS}
        SELECT x.episode, x.action_id AS src, y.action_id AS dst, CAST(0.3 AS DOUBLE) AS p FROM acts AS x JOIN acts AS y ON x.episode = y.episode AND x.tactic = y.tactic AND x.rn < y.rn WHERE x.n <= 5
        UNION ALL SELECT x.episode, x.action_id, y.action_id, CAST(0.25 AS DOUBLE) FROM acts AS x JOIN acts AS y ON x.episode = y.episode AND x.tactic = y.tactic AND x.rn = 1 AND y.rn > 1 WHERE x.n > 5
        UNION ALL SELECT x.episode, x.action_id, y.action_id, CAST(0.4 AS DOUBLE) FROM acts AS x JOIN acts AS y ON x.episode = y.episode AND y.tactic_order = x.tactic_order + 1 AND x.rn = 1 AND y.rn = 1""",
    ),
    "f05_flow_steps": Op("Steps of flows built from an actor's techniques.", "SELECT u.actor, t.tactic, CAST(row_number() OVER (PARTITION BY u.actor ORDER BY t.tactic, u.technique) AS BIGINT) AS position, u.technique FROM {uses} AS u JOIN {techniques} AS t ON u.technique = t.technique"),
    "f06_episode_stats": Op("Steps, edges and mean probability of each flow.", f"WITH {_EDGES}, e AS (SELECT episode, count(*) AS edges, avg(probability) AS p FROM edges GROUP BY episode), s AS (SELECT episode, count(*) AS steps, avg(confidence) AS c FROM ordered GROUP BY episode) SELECT s.episode, CAST(steps AS BIGINT) AS steps, CAST(coalesce(edges, 0) AS BIGINT) AS edges, round(c, 4) AS avg_confidence, round(p, 4) AS avg_probability FROM s LEFT JOIN e ON s.episode = e.episode"),
    "f07_resolve": Op("Identifiers as technique id or family name; what neither knows drops out.", "WITH wanted AS (SELECT * FROM (VALUES ('17'), ('Brand#22'), ('no such')) AS v(id)) SELECT id, min(coalesce(a.technique, b.technique)) AS technique FROM wanted LEFT JOIN {techniques} AS a ON wanted.id = CAST(a.technique AS VARCHAR(20)) LEFT JOIN {techniques} AS b ON wanted.id = b.family WHERE coalesce(a.technique, b.technique) IS NOT NULL GROUP BY id"),
    "l40_deterministic_flow": Op(
        "Claims merged by technique, ordered by tactic and position, with tiers for edges.",
        """WITH claims AS (SELECT episode, technique, max(coalesce(confidence, 0)) AS confidence, min(coalesce(ord, 999999)) AS line FROM {actions} GROUP BY episode, technique), o AS (SELECT c.episode, c.technique, c.line, t.tactic, r.tactic_order, row_number() OVER (PARTITION BY c.episode ORDER BY r.tactic_order, c.line, c.technique) AS pos FROM claims AS c JOIN {primary_tactic} AS t ON c.technique = t.technique JOIN {tactic_rank} AS r ON t.tactic = r.tactic),
        n AS (SELECT *, lead(technique) OVER w AS t2, lead(tactic_order) OVER w AS o2, lead(line) OVER w AS l2 FROM o WINDOW w AS (PARTITION BY episode ORDER BY pos))
        SELECT episode, technique AS src, t2 AS dst, CASE WHEN o2 > tactic_order AND l2 > line THEN 'high' WHEN o2 = tactic_order THEN 'medium' ELSE 'low' END AS tier, CAST(CASE WHEN o2 > tactic_order AND l2 > line THEN 0.8 WHEN o2 = tactic_order THEN 0.5 ELSE 0.25 END AS DOUBLE) AS p FROM n WHERE t2 IS NOT NULL""",
    ),
    "p43_bulk_flows": Op(
        "One flow for each actor's techniques, as edges: within a tactic (all pairs of few techniques, else from the first) and between the first techniques of neighbouring tactics.",
        """WITH acts AS (SELECT u.actor, u.technique, r.tactic_order, row_number() OVER (PARTITION BY u.actor, t.tactic ORDER BY u.technique) AS rn, count(*) OVER (PARTITION BY u.actor, t.tactic) AS n FROM {uses} AS u JOIN {techniques} AS t ON u.technique = t.technique JOIN {tactic_rank} AS r ON t.tactic = r.tactic),
        heads AS (SELECT * FROM acts WHERE rn = 1)
        SELECT x.actor AS flow, x.technique AS src, y.technique AS dst, CAST(0.3 AS DOUBLE) AS p FROM acts AS x JOIN acts AS y ON x.actor = y.actor AND x.tactic_order = y.tactic_order AND x.rn < y.rn WHERE x.n <= 5
        UNION ALL SELECT x.actor, x.technique, y.technique, CAST(0.25 AS DOUBLE) FROM heads AS x JOIN acts AS y ON x.actor = y.actor AND x.tactic_order = y.tactic_order AND y.rn > 1 WHERE x.n > 5
        UNION ALL SELECT x.actor, x.technique, y.technique, CAST(0.4 AS DOUBLE) FROM heads AS x JOIN heads AS y ON x.actor = y.actor AND y.tactic_order = x.tactic_order + 1""",
    ).against("""WITH g AS (SELECT actor, p_type AS tactic, list(technique ORDER BY technique) AS ts FROM {uses} JOIN part ON technique = p_partkey GROUP BY ALL), o AS (SELECT g.*, r.tactic_order AS o FROM g JOIN {tactic_rank} AS r USING (tactic))
        SELECT actor AS flow, ts[i] AS src, ts[j] AS dst, 0.3::DOUBLE AS p FROM o, range(1, 6) AS a(i), range(1, 6) AS b(j) WHERE len(ts) <= 5 AND i < j AND j <= len(ts)
        UNION ALL SELECT actor, ts[1], unnest(ts[2:]), 0.25::DOUBLE FROM o WHERE len(ts) > 5 UNION ALL SELECT x.actor, x.ts[1], y.ts[1], 0.4::DOUBLE FROM o AS x JOIN o AS y ON x.actor = y.actor AND y.o - x.o = 1"""),
}
