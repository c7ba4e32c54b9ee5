"""Path simulation, value iteration, reachability and choke points over transition graphs."""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideglass.functions.sqlop import Op

_COUNTERS = "(SELECT technique, count(*) AS n FROM {brand_mitigates} GROUP BY technique)"

OPS = {
    "e01_start_techniques": Op("Start techniques of an actor in a fixed pseudo-random order.", "SELECT technique FROM {uses} WHERE actor = :actor ORDER BY (technique * 7919 + 104729) % 10007, technique LIMIT :top", actor="NATION_3", top=5),
    "e02_next_techniques": Op("Ten most likely next states of each, from observed transitions and how often they were seen.", "SELECT src, dst, round(p, 6) AS p FROM (SELECT src, dst, p, row_number() OVER (PARTITION BY src ORDER BY round(p, 9) DESC, dst) AS rn FROM (SELECT src, dst, CASE WHEN p IS NULL THEN 0.3 ELSE least(p + least(n / 10.0, 0.2), 0.95) END AS p FROM {transitions}) AS t WHERE p > :least) AS r WHERE rn <= :top", least=0.05, top=10),
    "e03_defence_reduction": Op("How much counters lower a technique's chance.", f"SELECT t.technique, round(least(0.15 * coalesce(c.n, 0), 0.75), 6) AS reduction FROM {{primary_tactic}} AS t LEFT JOIN {_COUNTERS} AS c ON t.technique = c.technique"),
    "e06_path_cost": Op("Length of each episode's path plus a half for each sub-technique.", "SELECT s.episode, round(count(*) + 0.5 * sum(CASE WHEN is_sub THEN 1 ELSE 0 END), 4) AS cost FROM {path_steps} AS s JOIN {techniques} AS t ON s.technique = t.technique GROUP BY s.episode"),
    "e07_transition_matrix": Op("Mean transition probability between the most frequent states.", "WITH top AS (SELECT src AS s FROM {next_edges} GROUP BY src ORDER BY count(*) DESC, src LIMIT :top) SELECT e.src, e.dst, round(avg(coalesce(p, 0)), 3) AS p FROM {next_edges} AS e JOIN top AS a ON e.src = a.s JOIN top AS b ON e.dst = b.s GROUP BY e.src, e.dst", top=50),
    "e09_predict_next": Op(
        "Next states of the current ones by mean probability, half as much again where a group that uses a current state uses the next one; with frequency, and a confidence that is the share of wanted predictions found.",
        """WITH g AS (SELECT DISTINCT event_type AS state FROM {events} WHERE :group IS NOT NULL AND user_id = :group), ok AS (SELECT :group IS NULL OR count(*) > 0 AS ok FROM g WHERE state IN :current),
        n AS (SELECT e.dst, avg(coalesce(e.p, 0.5) * (CASE WHEN g.state IS NULL THEN 1.0 ELSE 1.5 END)) AS mean_p, count(*) AS n FROM {next_edges} AS e LEFT JOIN g ON e.dst = g.state CROSS JOIN ok WHERE ok AND e.src IN :current AND e.dst NOT IN :current GROUP BY e.dst),
        r AS (SELECT *, row_number() OVER (ORDER BY round(mean_p, 9) DESC, dst) AS rn FROM n)
        SELECT dst, round(mean_p, 6) AS p, round(least(1.0, n / 100.0), 4) AS frequency, round(least(1.0, count(*) OVER () / CAST(:top AS DOUBLE)), 6) AS confidence FROM r WHERE rn <= :top""",
        current=["click", "view"],
        group=3,
        top=5,
    ).against("""WITH u AS (SELECT list(DISTINCT event_type) AS own FROM {events} WHERE user_id = :group), e AS (SELECT dst, coalesce(p, 0.5) * CASE WHEN list_contains(own, dst) THEN 1.5::DOUBLE ELSE 1 END AS w FROM {next_edges}, u WHERE src IN :current AND dst NOT IN :current AND list_has_any(own, ['click', 'view'])),
        t AS (SELECT dst, avg(w) AS p, count(*) AS n FROM e GROUP BY dst ORDER BY round(avg(w), 9) DESC, dst LIMIT :top) SELECT dst, round(p, 6) AS p, round(least(1, n / 100.0::DOUBLE), 4) AS frequency, round(least(1, (SELECT count(*) FROM t) / :top::DOUBLE), 6) AS confidence FROM t"""),
    "e10_technique_statistics": Op("Uses, actors and most frequent follower of each technique.", "WITH f AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY n DESC, dst) AS rn FROM {transitions}), u AS (SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM {events} GROUP BY event_type) SELECT event_type, CAST(u.n AS BIGINT) AS uses, CAST(users AS BIGINT) AS flows, f.dst AS top_next, round(least(1.0, u.n / 100.0), 4) AS frequency FROM u LEFT JOIN f ON u.event_type = f.src AND f.rn = 1"),
    "e11_group_patterns": Op("Most frequent first three actions of an actor's episodes.", "WITH s AS (SELECT episode, max(CASE WHEN action_id = 1 THEN technique END) AS a, max(CASE WHEN action_id = 2 THEN technique END) AS b, max(CASE WHEN action_id = 3 THEN technique END) AS c FROM {actions} GROUP BY episode) SELECT a, b, c, CAST(count(*) AS BIGINT) AS n FROM s JOIN {attribution} AS att ON s.episode = att.episode WHERE actor = :actor GROUP BY a, b, c ORDER BY n DESC, a, b, c LIMIT :top", actor="NATION_3", top=50),
    "e13_compare_paths": Op(
        "Overlap of the sets of states of flows (a user's day). Flows with equal sets are one class, so what is compared and returned are pairs of classes, with the number of flows of each; membership is the class's name.",
        """WITH f AS (SELECT user_id, CAST(ts AS DATE) AS day, array_sort(collect_set(event_type)) AS states FROM {events} GROUP BY user_id, CAST(ts AS DATE)), c AS (SELECT states, array_join(states, '+') AS class, count(*) AS flows FROM f GROUP BY states)
        SELECT a.class AS class_a, b.class AS class_b, CAST(a.flows AS BIGINT) AS flows_a, CAST(b.flows AS BIGINT) AS flows_b, CAST(size(array_intersect(a.states, b.states)) AS BIGINT) AS shared, round(size(array_intersect(a.states, b.states)) / CAST(size(array_union(a.states, b.states)) AS DOUBLE), 6) AS jaccard
        FROM c AS a JOIN c AS b ON a.class < b.class AND arrays_overlap(a.states, b.states)""",
    ).against("""WITH s AS (SELECT DISTINCT concat(user_id, '/', ts::DATE) AS flow, event_type FROM {events}), f AS (SELECT flow, string_agg(event_type, '+' ORDER BY event_type) AS class FROM s GROUP BY flow), n AS (SELECT class, count(*) AS flows FROM f GROUP BY class), m AS (SELECT DISTINCT class, event_type FROM s JOIN f USING (flow)), k AS (SELECT class, count(*) AS k FROM m GROUP BY class),
        p AS (SELECT x.class AS a, y.class AS b, count(*) AS shared FROM m AS x JOIN m AS y ON x.event_type = y.event_type AND x.class < y.class GROUP BY x.class, y.class)
        SELECT a AS class_a, b AS class_b, x.flows::BIGINT AS flows_a, y.flows::BIGINT AS flows_b, shared::BIGINT AS shared, round(shared / (j.k + l.k - shared)::DOUBLE, 6) AS jaccard FROM p JOIN n AS x ON x.class = a JOIN n AS y ON y.class = b JOIN k AS j ON j.class = a JOIN k AS l ON l.class = b"""),
    "e15_compare_rollouts": Op("Change in how often states occur between two halves of the flows.", "WITH a AS (SELECT event_type, count(*) AS n FROM {events} WHERE user_id % 2 = 0 GROUP BY event_type), b AS (SELECT event_type, count(*) AS n FROM {events} WHERE user_id % 2 = 1 GROUP BY event_type) SELECT coalesce(a.event_type, b.event_type) AS event_type, CAST(coalesce(b.n, 0) - coalesce(a.n, 0) AS BIGINT) AS delta FROM a FULL OUTER JOIN b ON a.event_type = b.event_type"),
    "e17_mitigated_edges": Op("Edges after a state is removed and others are hampered, normalised by source.", "WITH m AS (SELECT src, dst, p * (CASE WHEN dst = :hampered THEN 1 - :penalty ELSE 1.0 END) AS p FROM {ptg_edges} WHERE src <> :removed AND dst <> :removed) SELECT src, dst, round(p / sum(p) OVER (PARTITION BY src), 6) AS p FROM m WHERE p > 0", removed="error", hampered="view", penalty=0.5),
    "e22_graph_export": Op(
        "A transition graph as nodes and edges in JSON, for display.",
        """WITH d AS (SELECT id, sum(i) AS n_in, sum(o) AS n_out FROM (SELECT src AS id, 0 AS i, 1 AS o FROM {ptg_edges} UNION ALL SELECT dst, 1, 0 FROM {ptg_edges}) AS u GROUP BY id)
        SELECT 'node' AS kind, id, to_json(named_struct('id', id, 'in', CAST(n_in AS INT), 'out', CAST(n_out AS INT))) AS body FROM d UNION ALL SELECT 'edge', concat(src, '→', dst), to_json(named_struct('source', src, 'target', dst, 'n', n)) FROM {ptg_edges}""",
    ).against("""WITH s AS (SELECT src AS id FROM {ptg_edges} UNION SELECT dst FROM {ptg_edges})
        SELECT 'node' AS kind, id, json_object('id', id, 'in', (SELECT count(*) FROM {ptg_edges} AS e WHERE e.dst = s.id)::INT, 'out', (SELECT count(*) FROM {ptg_edges} AS e WHERE e.src = s.id)::INT)::VARCHAR AS body FROM s UNION ALL SELECT 'edge', src || '→' || dst, json_object('source', src, 'target', dst, 'n', n)::VARCHAR FROM {ptg_edges}"""),
    "e23_interdiction_candidates": Op("States by weighted degree with the cost of mitigating them.", "WITH d AS (SELECT t, sum(n) AS w FROM (SELECT src AS t, n FROM {ptg_edges} UNION ALL SELECT dst, n FROM {ptg_edges}) AS u GROUP BY t) SELECT t AS state, CAST(w AS BIGINT) AS weight, CAST(CASE WHEN length(t) <= 5 THEN 2.0 ELSE 1.0 END AS DOUBLE) AS cost FROM d"),
}


def paths_from(edges: DataFrame, starts: list[str], max_depth: int, min_probability: float = 0.0, blocked: list[str] | None = None, most: int | None = None) -> DataFrame:
    """Paths without repeats from the starts: path (array), p, evidence (array of n), least (step). With `most` only
    that many of each depth go on, the likeliest: enough for the `most` likeliest of all, as no path is likelier than
    its beginning. Without it the number of paths is bounded by the states, not by the rows behind the edges."""
    step = edges.select("src", "dst", F.col("p").alias("q"), F.col("n").cast("double").alias("seen")).where(~F.col("dst").isin(blocked or []))
    front = edges.sparkSession.createDataFrame([([s], 1.0, [], 1.0) for s in starts if s not in (blocked or [])], "path array<string>, p double, evidence array<double>, least double")
    found: DataFrame | None = None
    for _ in range(max_depth):
        grown = front.join(step, F.element_at("path", -1) == F.col("src")).where(~F.array_contains("path", F.col("dst")) & (F.col("p") * F.col("q") >= min_probability))
        front = grown.select(F.concat("path", F.array("dst")).alias("path"), (F.col("p") * F.col("q")).alias("p"), F.concat("evidence", F.array("seen")).alias("evidence"), F.least("least", "q").alias("least"))
        if most is not None:
            front = front.orderBy(F.round("p", 9).desc(), F.array_join("path", ">")).limit(most)
        found = front if found is None else found.unionByName(front)
    return found


def best_paths(edges: DataFrame, starts: list[str], max_depth: int = 5, min_probability: float = 0.01, max_paths: int = 50) -> DataFrame:
    """The likeliest paths without repeats from the starts, each at least as likely as a minimum: path, depth, p."""
    found = paths_from(edges, starts, max_depth, min_probability, most=max_paths)
    named = found.select(F.array_join("path", ">").alias("path"), (F.size("path") - 1).cast("bigint").alias("depth"), F.round("p", 9).alias("p"))
    return named.orderBy(F.desc("p"), "path").limit(max_paths)


def what_if(edges: DataFrame, compromised: list[str], blocked: list[str], critical: list[str], max_depth: int = 5, min_probability: float = 0.0) -> DataFrame:
    """Paths from compromised states that avoid blocked ones: path, p, and how many critical states are on it."""
    found = paths_from(edges, compromised, max_depth, min_probability, blocked)
    hit = F.size(F.array_intersect("path", F.array(*[F.lit(c) for c in critical])))
    return found.select(F.array_join("path", ">").alias("path"), F.round("p", 9).alias("p"), hit.cast("bigint").alias("critical"))


def path_confidence(edges: DataFrame, starts: list[str], max_depth: int = 5, min_probability: float = 0.0) -> DataFrame:
    """Paths with their confidence: lowered for thin evidence, unlikely steps and more than seven steps; hypothetical
    below 0.4."""
    found = paths_from(edges, starts, max_depth, min_probability)
    mean = F.aggregate("evidence", F.lit(0.0), lambda a, x: a + x) / F.size("evidence")
    thin = F.when(mean < 2, 0.7).when(mean < 5, 0.85).otherwise(1.0)
    sure = F.col("p") * thin * F.when(F.col("least") < 0.2, 0.8).otherwise(1.0) * F.when(F.size("path") - 1 > 7, 0.9).otherwise(1.0)
    return found.select(F.array_join("path", ">").alias("path"), F.round(sure, 9).alias("confidence"), (sure < 0.4).alias("hypothetical"))


def interdiction_impact(edges: DataFrame, sources: list[str], targets: list[str], max_depth: int = 6) -> DataFrame:
    """For each state that is no source or target, the share of paths from sources to targets that it is on, in percent."""
    ends = paths_from(edges, sources, max_depth).where(F.element_at("path", -1).isin(targets)).select(F.monotonically_increasing_id().alias("id"), "path")
    inner = ends.select(F.explode("path").alias("state")).where(~F.col("state").isin(sources + targets)).groupBy("state").agg(F.count(F.lit(1)).alias("hit"))
    return inner.crossJoin(F.broadcast(ends.agg(F.count(F.lit(1)).alias("n")))).select("state", F.round(100.0 * F.col("hit") / F.col("n"), 6).alias("pct"))


MOST_EDGES = 1_000_000


def bounded(edges: DataFrame, most: int = MOST_EDGES) -> list:
    """src, dst, p of a transition graph, which is as large as its states let it be and not as the rows behind it; a
    table of more than `most` edges is none and is refused."""
    rows = edges.select("src", "dst", "p").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} edges: not a transition graph")
    return rows


def rollouts(edges: DataFrame, starts: list[str], targets: list[str], n: int = 2000, max_depth: int = 8, seed: int = 7) -> DataFrame:
    """Weighted random walks with repeats of a state ending them: path, reached, n. Each walk has its own seed."""
    graph: dict[str, tuple[list[str], np.ndarray]] = {}
    rows = bounded(edges)
    for s in {r["src"] for r in rows}:
        out = sorted((r["dst"], r["p"]) for r in rows if r["src"] == s)
        graph[s] = ([d for d, _ in out], np.cumsum([p for _, p in out]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            walks = []
            for i in pdf["id"]:
                rng = np.random.default_rng((seed, int(i)))
                path = [starts[int(i) % len(starts)]]
                while len(path) <= max_depth and path[-1] not in targets and path[-1] in graph:
                    names, sums = graph[path[-1]]
                    nxt = names[min(int(np.searchsorted(sums, rng.random() * sums[-1], "right")), len(names) - 1)]
                    if nxt in path:
                        break
                    path.append(nxt)
                walks.append((">".join(path), path[-1] in targets))
            yield pd.DataFrame(walks, columns=["path", "reached"])

    walked = edges.sparkSession.range(n).mapInPandas(run, "path string, reached boolean")
    return walked.groupBy("path", "reached").agg(F.count(F.lit(1)).alias("n"))


def value_iteration(edges: DataFrame, terminal: list[str], gamma: float = 0.95, epsilon: float = 1e-10, reward: float = -0.1, goal: float = 10.0, most: int = 400) -> DataFrame:
    """Values of states by Jacobi rounds to the fixed point: state, value, action. The state graph is bounded by the
    techniques it is about, so a round works on arrays; the joins before it are distributed."""
    rows = bounded(edges)
    states = sorted({r[k] for r in rows for k in ("src", "dst")})
    index = {s: i for i, s in enumerate(states)}
    src, dst = (np.array([index[r[k]] for r in rows], int) for k in ("src", "dst"))
    p = np.array([r["p"] for r in rows])
    gain = np.array([goal if s in terminal else reward for s in states])
    done = np.array([s in terminal for s in states])
    value = np.where(done, goal, 0.0)
    for _ in range(most):
        q = gain[dst] + gamma * p * value[dst]
        new = np.full(len(states), -np.inf)
        np.maximum.at(new, src, q)
        new = np.where(done, goal, np.where(np.isinf(new), reward, new))
        if np.abs(new - value).max() < epsilon:
            break
        value = new
    q = gain[dst] + gamma * p * value[dst]
    best = {}
    for i in np.argsort(-np.round(q, 9), kind="stable"):
        best.setdefault(int(src[i]), states[dst[i]])
    out = [(s, round(float(value[i]), 6), None if done[i] else best.get(i)) for i, s in enumerate(states)]
    return edges.sparkSession.createDataFrame(out, "state string, value double, action string")


def optimal_paths(edges: DataFrame, starts: list[str], terminal: list[str], max_depth: int = 10) -> DataFrame:
    """The path that the best actions give from each start."""
    policy = {r["state"]: r["action"] for r in value_iteration(edges, terminal).collect()}
    out = []
    for s in starts:
        path = [s]
        while len(path) <= max_depth and policy.get(path[-1]) and policy[path[-1]] not in path:
            path.append(policy[path[-1]])
        out.append((s, ">".join(path), path[-1] in terminal))
    return edges.sparkSession.createDataFrame(out, "start string, path string, reached boolean")


def reachability(edges: DataFrame, starts: list[str], max_hops: int = 5) -> DataFrame:
    """Fewest hops to each state: state, hops. A hop joins what is reached with the edges and a way to stay, and keeps
    the least of each state, so the plan grows by one join a hop and all hops are one job."""
    ways = edges.select("src", "dst").distinct().withColumn("cost", F.lit(1).cast("bigint"))
    ways = ways.unionByName(edges.select(F.explode(F.array("src", "dst")).alias("src")).distinct().select("src", F.col("src").alias("dst"), F.lit(0).cast("bigint").alias("cost")))
    seen = edges.sparkSession.createDataFrame([(s, 0) for s in starts], "state string, hops long")
    for _ in range(max_hops):
        seen = seen.join(ways, F.col("state") == F.col("src")).groupBy(F.col("dst").alias("state")).agg(F.min(F.col("hops") + F.col("cost")).alias("hops"))
    return seen


def choke_points(edges: DataFrame, sources: list[str], targets: list[str], k_paths: int = 50, cutoff: int = 10) -> DataFrame:
    """Betweenness (by -ln p), articulation, dominance of source-target paths, minimum cut and criticality by state.
    A model's graph is one bounded group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        graph: dict[str, dict[str, float]] = defaultdict(dict)
        for s, d, p in pdf[["src", "dst", "p"]].sort_values(["src", "dst"]).itertuples(index=False):
            graph[s][d] = -math.log(p) if p > 0 else 1000.0
        nodes = sorted({*graph, *(d for v in graph.values() for d in v)})
        between = betweenness(graph, nodes)
        art = articulation({n: set(graph[n]) | {m for m in nodes if n in graph[m]} for n in nodes}, nodes)
        dom: dict[str, int] = defaultdict(int)
        for s in sources:
            for t in targets:
                paths = simple_paths(graph, s, t, cutoff, k_paths)
                if paths:
                    for n in set.intersection(*map(set, paths)) - {s, t}:
                        dom[n] += 1
        cut = min_node_cut(graph, nodes, sources, targets)
        rows = [(n, round(between[n], 6), n in art, dom[n], n in cut, round(10 * between[n] + 5 * (n in art) + 3 * dom[n] + 4 * (n in cut), 6)) for n in nodes]
        return pd.DataFrame(rows, columns=["state", "betweenness", "articulation", "dominates", "in_cut", "criticality"])

    one = edges.sparkSession.createDataFrame([(r["src"], r["dst"], r["p"]) for r in bounded(edges, 100_000)], "src string, dst string, p double").withColumn("model", F.lit(0))
    return one.groupBy("model").applyInPandas(run, "state string, betweenness double, articulation boolean, dominates long, in_cut boolean, criticality double")


def betweenness(graph: dict, nodes: list) -> dict:
    """Weighted node betweenness, normalised for directed graphs."""
    total = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        dist, count, before, order = {s: 0.0}, defaultdict(float, {s: 1.0}), defaultdict(list), []
        done, heap = set(), [(0.0, s)]
        while heap:
            d, v = heapq.heappop(heap)
            if v in done:
                continue
            done.add(v)
            order.append(v)
            for w, cost in graph.get(v, {}).items():
                new = d + cost
                if w not in dist or new < dist[w] - 1e-12:
                    dist[w], count[w], before[w] = new, count[v], [v]
                    heapq.heappush(heap, (new, w))
                elif abs(new - dist[w]) <= 1e-12 and w not in done:
                    count[w] += count[v]
                    before[w].append(v)
        part = defaultdict(float)
        for w in reversed(order):
            for v in before[w]:
                part[v] += count[v] / count[w] * (1 + part[w])
            if w != s:
                total[w] += part[w]
    n = len(nodes)
    scale = 1 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    return {k: v * scale for k, v in total.items()}


def articulation(graph: dict, nodes: list) -> set:
    """Nodes whose removal cuts an undirected connected graph; none if it is not connected."""

    def parts(without: object) -> int:
        left, n = {x for x in nodes if x != without}, 0
        while left:
            n += 1
            todo = [left.pop()]
            while todo:
                for m in graph[todo.pop()]:
                    if m in left:
                        left.discard(m)
                        todo.append(m)
        return n

    return {n for n in nodes if parts(n) > 1} if len(nodes) > 2 and parts(None) == 1 else set()


def simple_paths(graph: dict, s: str, t: str, cutoff: int, most: int) -> list[list[str]]:
    found, stack = [], [[s]]
    while stack and len(found) < most:
        path = stack.pop()
        if path[-1] == t and len(path) > 1:
            found.append(path)
        elif len(path) <= cutoff:
            stack += [[*path, m] for m in sorted(graph.get(path[-1], {}), reverse=True) if m not in path]
    return found


def min_node_cut(graph: dict, nodes: list, sources: list[str], targets: list[str]) -> set:
    """Fewest states (no source, no target) that separate sources from targets, by augmenting paths over split nodes."""
    free = {*sources, *targets}
    cap: dict = defaultdict(lambda: defaultdict(int))
    for n in nodes:
        cap[n, 0][n, 1] = len(nodes) if n in free else 1
        for m in graph.get(n, {}):
            cap[n, 1][m, 0] = len(nodes)
    for s in sources:
        cap["S"][s, 0] = len(nodes)
    for t in targets:
        cap[t, 1]["T"] = len(nodes)
    flow = 0
    while flow < len(nodes):
        before, todo = {"S": None}, ["S"]
        while todo and "T" not in before:
            v = todo.pop(0)
            for w in list(cap[v]):
                if cap[v][w] > 0 and w not in before:
                    before[w] = v
                    todo.append(w)
        if "T" not in before:
            return {n for n in nodes if n not in free and (n, 0) in before and (n, 1) not in before}
        w = "T"
        while before[w] is not None:
            cap[before[w]][w] -= 1
            cap[w][before[w]] += 1
            w = before[w]
        flow += 1
    return set()


def select_interdictions(candidates: DataFrame, budget: float = 3.0, method: str = "greedy", most: int = 20_000) -> DataFrame:
    """Choose states (state, weight, cost) under a budget: greedy by weight, balanced by weight per cost, or the best
    set by 0/1 knapsack, with costs in tenths. Candidates are states of a model; more than `most` are refused."""
    rows = [(r["state"], float(r["weight"]), float(r["cost"])) for r in candidates.orderBy(F.desc("weight"), "state").limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"more than {most} candidates; a model's states are fewer")
    if method == "optimal":
        cap = int(round(budget * 10))
        best: list[tuple[float, tuple]] = [(0.0, ())] * (cap + 1)
        for state, w, c in rows:
            k = int(round(c * 10))
            for b in range(cap, k - 1, -1):
                if best[b - k][0] + w > best[b][0]:
                    best[b] = (best[b - k][0] + w, (*best[b - k][1], (state, w, c)))
        chosen = list(best[cap][1])
    else:
        order = rows if method == "greedy" else sorted(rows, key=lambda r: (-r[1] / r[2], r[0]))
        chosen, spent = [], 0.0
        for r in order:
            if spent + r[2] <= budget + 1e-9:
                chosen.append(r)
                spent += r[2]
    return candidates.sparkSession.createDataFrame([(method, *r) for r in chosen], "method string, state string, weight double, cost double")


def _interdict(candidates: DataFrame) -> DataFrame:
    out = None
    for m in ("greedy", "optimal", "balanced"):
        one = select_interdictions(candidates, 3.0, m)
        out = one if out is None else out.unionByName(one)
    return out


def _states(edges: DataFrame) -> DataFrame:
    w = edges.select(F.col("src").alias("state"), "n").unionByName(edges.select(F.col("dst").alias("state"), "n")).groupBy("state").agg(F.sum("n").alias("weight"))
    return w.withColumn("cost", F.when(F.length("state") <= 5, 2.0).otherwise(1.0))


_WALK = """WITH RECURSIVE walk AS (SELECT [s] AS path, 1::DOUBLE AS p, 0::DOUBLE AS seen, 1::DOUBLE AS lowest FROM (VALUES {starts}) AS v(s)
UNION ALL SELECT list_append(path, dst), walk.p * e.p, seen + n, least(lowest, e.p) FROM walk JOIN ptg_edges AS e ON path[-1] = src WHERE len(path) <= {depth} AND NOT list_contains(path, dst){extra}), found AS (SELECT array_to_string(path, '>') AS name, * FROM walk WHERE len(path) > 1)"""
_FROM_TWO = "('click'), ('view')"
_HOPS = "WITH RECURSIVE walk AS (SELECT 'click' AS state, CAST(0 AS BIGINT) AS hops UNION SELECT dst, hops + 1 FROM walk JOIN ptg_edges ON state = src WHERE hops < 5) SELECT state, min(hops) AS hops FROM walk GROUP BY state"
_BEST = _WALK + " SELECT name AS path, (len(path) - 1)::BIGINT AS depth, round(p, 9) AS p FROM found ORDER BY round(p, 9) DESC, name LIMIT {most}"
# Values by unrolled rounds of the recursion, as many as the fixed point takes at this discount.
_VALUES = """WITH RECURSIVE st AS (SELECT src AS state FROM ptg_edges UNION SELECT dst FROM ptg_edges), r AS (SELECT 0 AS i, map_from_entries(list((state, CASE WHEN state = 'purchase' THEN 10::DOUBLE ELSE 0 END))) AS v FROM st
UNION ALL SELECT i + 1, (SELECT map_from_entries(list((s.state, CASE WHEN s.state = 'purchase' THEN 10::DOUBLE ELSE coalesce((SELECT max(CASE WHEN e.dst = 'purchase' THEN 10::DOUBLE ELSE -0.1 END + 0.95 * e.p * r.v[e.dst]) FROM ptg_edges AS e WHERE e.src = s.state), -0.1) END))) FROM st AS s) FROM r WHERE i < 60),
last AS (SELECT v FROM r ORDER BY i DESC LIMIT 1), q AS (SELECT src, dst, CASE WHEN dst = 'purchase' THEN 10::DOUBLE ELSE -0.1 END + 0.95 * p * v[dst] AS q FROM ptg_edges, last),
best AS (SELECT src, dst FROM q WHERE src <> 'purchase' QUALIFY row_number() OVER (PARTITION BY src ORDER BY round(q, 9) DESC, dst) = 1)"""

# For the check: the same rules in another shape.
CHECKS = {
    "e02_next_techniques": "WITH s AS (SELECT src, dst, coalesce(least(p + least(n, 2) / 10.0::DOUBLE, 0.95), 0.3)::DOUBLE AS p FROM {transitions}) SELECT src, t.dst AS dst, round(t.p, 6) AS p FROM (SELECT src, unnest(list({'dst': dst, 'p': p} ORDER BY round(p, 9) DESC, dst)[:10]) AS t FROM (SELECT src, dst, p FROM s WHERE p > :least) AS f GROUP BY src) AS u",
    "e07_transition_matrix": "WITH t AS (SELECT mode AS s FROM (SELECT src AS mode, count(*) AS n FROM {next_edges} GROUP BY src) AS c QUALIFY row_number() OVER (ORDER BY n DESC, mode) <= :top) SELECT src, dst, round(sum(CASE WHEN p IS NULL THEN 0 ELSE p END) / count(*), 3) AS p FROM {next_edges} WHERE src IN (SELECT s FROM t) AND dst IN (SELECT s FROM t) GROUP BY src, dst",
    "e17_mitigated_edges": "WITH k AS (SELECT src, dst, CASE dst WHEN :hampered THEN p * (1 - :penalty) ELSE p END AS p FROM {ptg_edges} WHERE :removed NOT IN (src, dst)) SELECT k.src, k.dst, round(k.p / (SELECT sum(o.p) FROM k AS o WHERE o.src = k.src), 6) AS p FROM k WHERE k.p <> 0",
    "e23_interdiction_candidates": "WITH s AS (SELECT unnest([src, dst]) AS state, n FROM {ptg_edges}) SELECT state, sum(n)::BIGINT AS weight, (1 + (length(state) < 6)::INT)::DOUBLE AS cost FROM s GROUP BY state",
    "e15_compare_rollouts": "SELECT event_type, (count(*) FILTER (user_id & 1 = 1) - count(*) FILTER (user_id & 1 = 0))::BIGINT AS delta FROM {events} GROUP BY event_type",
}
for _name, _text in CHECKS.items():
    OPS[_name].against(_text)

FUNCTIONS = {
    "e04_best_paths": (lambda e: best_paths(e, ["click"], 4), ["ptg_edges"], _BEST.format(starts="('click')", depth=4, extra=" AND walk.p * e.p >= 0.01", most=50)),
    "e08_what_if": (lambda e: what_if(e, ["click"], ["error"], ["purchase"]), ["ptg_edges"], _WALK.format(starts="('click')", depth=5, extra=" AND dst <> 'error'") + " SELECT name AS path, round(p, 9) AS p, list_contains(path, 'purchase')::BIGINT AS critical FROM found"),
    "e12_path_confidence": (
        lambda e: path_confidence(e, ["click", "view"]),
        ["ptg_edges"],
        _WALK.format(starts=_FROM_TWO, depth=5, extra="") + ", c AS (SELECT name, p * (CASE WHEN seen / (len(path) - 1) < 2 THEN 0.7::DOUBLE WHEN seen / (len(path) - 1) < 5 THEN 0.85 ELSE 1 END) * (CASE WHEN lowest < 0.2::DOUBLE THEN 0.8::DOUBLE ELSE 1 END) * (CASE WHEN len(path) > 8 THEN 0.9::DOUBLE ELSE 1 END) AS c FROM found) SELECT name AS path, round(c, 9) AS confidence, c < 0.4::DOUBLE AS hypothetical FROM c",
    ),
    "e25_interdiction_impact": (
        lambda e: interdiction_impact(e, ["click"], ["purchase"]),
        ["ptg_edges"],
        _WALK.format(starts="('click')", depth=6, extra="") + ", t AS (SELECT path FROM found WHERE path[-1] = 'purchase') SELECT state, round(100 * count(*) / (SELECT count(*) FROM t)::DOUBLE, 6) AS pct FROM (SELECT unnest(path) AS state FROM t) AS u WHERE state NOT IN ('click', 'purchase') GROUP BY state",
    ),
    "e05_monte_carlo": (lambda e: rollouts(e, ["click", "view"], [], 3000, 4), ["ptg_edges"], None),
    "e14_rollouts": (lambda e: rollouts(e, ["click"], ["purchase"], 2000, 8), ["ptg_edges"], None),
    "e16_value_iteration": (lambda e: value_iteration(e, ["purchase"]), ["ptg_edges"], _VALUES + " SELECT state, round(v[state], 6) AS value, dst AS action FROM st CROSS JOIN last LEFT JOIN best ON src = state"),
    "e18_optimal_paths": (lambda e: optimal_paths(e, ["click", "view", "signup"], ["purchase"]), ["ptg_edges"], _VALUES + ", w AS (SELECT s AS start, [s] AS path FROM (VALUES ('click'), ('view'), ('signup')) AS v(s)), w1 AS (SELECT start, CASE WHEN dst IS NULL OR list_contains(path, dst) THEN path ELSE list_append(path, dst) END AS path FROM w LEFT JOIN best ON src = path[-1]), w2 AS (SELECT start, CASE WHEN dst IS NULL OR list_contains(path, dst) THEN path ELSE list_append(path, dst) END AS path FROM w1 LEFT JOIN best ON src = path[-1]), w3 AS (SELECT start, CASE WHEN dst IS NULL OR list_contains(path, dst) THEN path ELSE list_append(path, dst) END AS path FROM w2 LEFT JOIN best ON src = path[-1]), w4 AS (SELECT start, CASE WHEN dst IS NULL OR list_contains(path, dst) THEN path ELSE list_append(path, dst) END AS path FROM w3 LEFT JOIN best ON src = path[-1]) SELECT start, array_to_string(path, '>') AS path, path[-1] = 'purchase' AS reached FROM w4"),
    "e19_choke_points": (lambda e: choke_points(e, ["click"], ["purchase"]), ["ptg_edges"], None),
    "e20_path_analysis": (lambda e: best_paths(e, ["click", "view"], 3, 0.0, 100), ["ptg_edges"], _BEST.format(starts=_FROM_TWO, depth=3, extra="", most=100)),
    "e21_reachability": (lambda e: reachability(e, ["click"]), ["ptg_edges"], _HOPS),
    "e24_interdiction_selection": (lambda e: _interdict(_states(e)), ["ptg_edges"], None),
}
