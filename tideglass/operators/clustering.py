"""Technique clusters and detection bundles."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideglass.functions import scratch
from tideglass.functions.sqlop import Op

# Pairs come from each episode's ordered array, equal arrays counted once with a weight, and not from joining episodes.
_EDGES = "graph AS (SELECT a, b, n, n * total / (x.c * y.c) AS lift, ln(n * total / (x.c * y.c)) AS pmi, CASE WHEN n * total <= x.c * y.c THEN 0.0 ELSE ln(n * total / (x.c * y.c)) / nullif(-ln(n / total), 0) END AS npmi FROM pairs JOIN marg AS x ON a = x.technique JOIN marg AS y ON b = y.technique CROSS JOIN tot)"
_GRAPH = f"""
sets AS (SELECT ts, count(*) AS w FROM (SELECT array_sort(collect_set(technique)) AS ts FROM {{et}} GROUP BY episode) AS e GROUP BY ts),
firsts AS (SELECT ts, w, i, a FROM sets LATERAL VIEW posexplode(ts) AS i, a),
pairs AS (SELECT a, b, CAST(sum(w) AS DOUBLE) AS n FROM firsts LATERAL VIEW explode(slice(ts, i + 2, size(ts))) AS b GROUP BY a, b HAVING sum(w) >= 2),
marg AS (SELECT technique, CAST(sum(w) AS DOUBLE) AS c FROM sets LATERAL VIEW explode(ts) AS technique GROUP BY technique),
tot AS (SELECT CAST(sum(w) AS DOUBLE) AS total FROM sets),
{_EDGES}"""
# For the check: episodes joined with themselves.
_CHECK_GRAPH = f"""
pairs AS (SELECT a.technique AS a, b.technique AS b, CAST(count(*) AS DOUBLE) AS n FROM {{et}} AS a JOIN {{et}} AS b ON a.episode = b.episode AND a.technique < b.technique GROUP BY a.technique, b.technique HAVING count(*) >= 2),
marg AS (SELECT technique, CAST(count(*) AS DOUBLE) AS c FROM {{et}} GROUP BY technique),
tot AS (SELECT CAST(count(DISTINCT episode) AS DOUBLE) AS total FROM {{et}}),
{_EDGES}"""
_MEMBERS = "members AS (SELECT DISTINCT technique, tactic AS cluster FROM {primary_tactic})"

OPS = {
    "b01_weighted_graph": Op("Weighted co-occurrence graph, natural logarithms, all episodes as the base.", f"WITH {_GRAPH} SELECT a AS technique_a, b AS technique_b, CAST(n AS BIGINT) AS weight, round(lift, 6) AS lift, round(pmi, 6) AS pmi, round(npmi, 6) AS npmi FROM graph"),
    "b03_cluster_stats": Op(
        "Size, density, cohesion and hubs of clusters.",
        f"""WITH {_GRAPH}, {_MEMBERS}, inner_edges AS (SELECT x.cluster, a, b, n FROM graph JOIN members AS x ON a = x.technique JOIN members AS y ON b = y.technique AND x.cluster = y.cluster),
        size AS (SELECT cluster, count(*) AS size FROM members GROUP BY cluster), e AS (SELECT cluster, count(*) AS edges, avg(n) AS cohesion FROM inner_edges GROUP BY cluster),
        deg AS (SELECT cluster, technique, sum(n) AS strength FROM (SELECT cluster, a AS technique, n FROM inner_edges UNION ALL SELECT cluster, b, n FROM inner_edges) AS u GROUP BY cluster, technique),
        hub AS (SELECT cluster, technique FROM (SELECT cluster, technique, row_number() OVER (PARTITION BY cluster ORDER BY strength DESC, technique) AS rn FROM deg) AS r WHERE rn = 1)
        SELECT size.cluster, CAST(size AS BIGINT) AS size, CAST(coalesce(edges, 0) AS BIGINT) AS edges, round(coalesce(edges, 0) / nullif(size * (size - 1) / 2.0, 0), 6) AS density, round(cohesion, 6) AS cohesion, hub.technique AS hub FROM size LEFT JOIN e ON size.cluster = e.cluster LEFT JOIN hub ON size.cluster = hub.cluster""",
    ),
    "b05_cluster_profiles": Op(
        "Actors, detection coverage and priority of clusters.",
        f"""WITH {_GRAPH}, {_MEMBERS}, size AS (SELECT cluster, count(*) AS size FROM members GROUP BY cluster),
        act AS (SELECT cluster, count(DISTINCT actor) AS actors FROM {{eta}} AS e JOIN members ON e.technique = members.technique GROUP BY cluster),
        cov AS (SELECT cluster, 100.0 * count(DISTINCT d.technique) / count(DISTINCT members.technique) AS coverage FROM members LEFT JOIN {{brand_detects}} AS d ON members.technique = d.technique GROUP BY cluster),
        den AS (SELECT x.cluster, count(*) AS edges FROM graph JOIN members AS x ON a = x.technique JOIN members AS y ON b = y.technique AND x.cluster = y.cluster GROUP BY x.cluster)
        SELECT size.cluster, CAST(size AS BIGINT) AS size, CAST(coalesce(actors, 0) AS BIGINT) AS actors, round(coverage, 4) AS coverage_pct, round(coalesce(actors, 0) * 10 + size * 2 + (100 - coverage) * 0.5 + coalesce(coalesce(edges, 0) / nullif(size * (size - 1) / 2.0, 0), 0) * 20, 4) AS priority
        FROM size LEFT JOIN act ON size.cluster = act.cluster LEFT JOIN cov ON size.cluster = cov.cluster LEFT JOIN den ON size.cluster = den.cluster""",
    ),
    "b06_cluster_gaps": Op(
        "Techniques that lack detection, mitigation or both, by family.",
        """SELECT family, gap, CAST(count(*) AS BIGINT) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY family), 4) AS pct FROM (
        SELECT t.family, t.technique, CASE WHEN d.technique IS NULL AND m.technique IS NULL THEN 'neither' WHEN d.technique IS NULL THEN 'no_detection' WHEN m.technique IS NULL THEN 'no_mitigation' ELSE 'covered' END AS gap
        FROM {techniques} AS t LEFT JOIN (SELECT DISTINCT technique FROM {detects}) AS d ON t.technique = d.technique LEFT JOIN (SELECT DISTINCT technique FROM {mitigates}) AS m ON t.technique = m.technique) AS g GROUP BY family, gap""",
    ),
    "b07_detection_bundle": Op(
        "For the techniques of a family: the strategy that covers most wins each technique, mitigations take some of the rest.",
        """WITH wanted AS (SELECT technique FROM {techniques} WHERE family = :family), hits AS (SELECT strategy, d.technique, count(*) OVER (PARTITION BY strategy) AS breadth FROM {detects} AS d JOIN wanted ON d.technique = wanted.technique),
        won AS (SELECT technique, strategy FROM (SELECT technique, strategy, row_number() OVER (PARTITION BY technique ORDER BY breadth DESC, strategy) AS rn FROM hits) AS r WHERE rn = 1),
        rest AS (SELECT technique, mitigation FROM (SELECT m.technique, mitigation, row_number() OVER (PARTITION BY m.technique ORDER BY mitigation) AS rn FROM {mitigates} AS m JOIN wanted ON m.technique = wanted.technique LEFT JOIN won ON m.technique = won.technique WHERE won.technique IS NULL) AS r WHERE rn = 1 ORDER BY technique LIMIT :max_mitigations)
        SELECT technique, strategy AS source, 'detection' AS kind, CAST(0.8 AS DOUBLE) AS confidence, 'medium' AS cost FROM won UNION ALL SELECT technique, mitigation, 'mitigation', CAST(0.6 AS DOUBLE), 'high' FROM rest""",
        family="Brand#11",
        max_mitigations=20,
    ),
    "b09_coverage_report": Op(
        "Detected and mitigated techniques that are not sub-techniques (NULL flags drop out), by tactic.",
        """SELECT tactic, CAST(count(*) AS BIGINT) AS total, CAST(count(d.technique) AS BIGINT) AS detected, CAST(count(m.technique) AS BIGINT) AS mitigated, CAST(sum(CASE WHEN d.technique IS NULL AND m.technique IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS gaps, round(100.0 * (count(d.technique) + count(m.technique)) / (2 * count(*)), 4) AS overall_pct
        FROM {techniques} AS t LEFT JOIN (SELECT DISTINCT technique FROM {detects}) AS d ON t.technique = d.technique LEFT JOIN (SELECT DISTINCT technique FROM {mitigates}) AS m ON t.technique = m.technique WHERE NOT is_sub GROUP BY tactic""",
    ),
}
for _op in OPS.values():
    if _GRAPH in _op.text:
        _op.against(_op.text.replace(_GRAPH, _CHECK_GRAPH))


def louvain(edges: pd.DataFrame, resolution: float = 1.0) -> dict[str, int]:
    """Communities of an undirected weighted graph (a, b, w) by greedy modularity moves and aggregation; ties by name."""
    graph: dict[object, dict[object, float]] = defaultdict(lambda: defaultdict(float))
    for a, b, w in edges.itertuples(index=False):
        graph[a][b] += w
        graph[b][a] += w
    members = {n: {n} for n in graph}
    while True:
        total = sum(sum(v.values()) for v in graph.values())
        if not total:
            break
        degree = {n: sum(v.values()) for n, v in graph.items()}
        where = {n: n for n in graph}
        weight = dict(degree)
        moved, improved = True, False
        while moved:
            moved = False
            for n in sorted(graph, key=str):
                near: dict[object, float] = defaultdict(float)
                for m, w in graph[n].items():
                    if m != n:
                        near[where[m]] += w
                own = where[n]
                weight[own] -= degree[n]
                gain = lambda c: near.get(c, 0.0) - resolution * degree[n] * weight[c] / total  # noqa: B023, E731
                best = max(sorted(near.keys() | {own}, key=str), key=lambda c: (round(gain(c), 12), c == own))
                weight[best] += degree[n]
                if best != own:
                    where[n], moved, improved = best, True, True
        if not improved:
            break
        merged: dict[object, dict[object, float]] = defaultdict(lambda: defaultdict(float))
        grown: dict[object, set] = defaultdict(set)
        for n, c in where.items():
            grown[c] |= members[n]
            for m, w in graph[n].items():
                merged[c][where[m]] += w
        graph, members = merged, grown
    ranked = sorted(members.values(), key=lambda s: (-len(s), min(map(str, s))))
    return {t: i for i, s in enumerate(ranked) for t in s}


MOST_EDGES = 2_000_000


def communities(et: DataFrame, resolution: float = 1.0) -> DataFrame:
    """Louvain communities of the co-occurrence graph, singletons dropped: technique, cluster. The graph has at most
    one edge for each pair of techniques, so one group holds it whatever the number of episodes; more than MOST_EDGES
    are refused."""
    graph = OPS["b01_weighted_graph"](et=et).where("npmi > 0").select("technique_a", "technique_b", "npmi").limit(MOST_EDGES + 1)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > MOST_EDGES:
            raise ValueError(f"more than {MOST_EDGES} edges: not a graph of techniques")
        found = louvain(pdf[["technique_a", "technique_b", "npmi"]].sort_values(["technique_a", "technique_b"]), resolution)
        sizes = pd.Series(found).value_counts()
        rows = [(t, c) for t, c in sorted(found.items()) if sizes[c] > 1]
        return pd.DataFrame(rows, columns=["technique", "cluster"])

    return graph.withColumn("graph", F.lit(0)).groupBy("graph").applyInPandas(run, "technique string, cluster long")


def connected(edges: DataFrame, min_weight: float = 1.0) -> DataFrame:
    """Components of size two or more of edges (a, b, weight) above a weight: node, component (the least node).

    Large-star and small-star rounds: every node's greater neighbours are linked to its least neighbour, then its lesser
    ones too, until stars are left; a path of n nodes takes about log n rounds.
    """
    now = edges.where((F.col("weight") >= min_weight) & (F.col("a") != F.col("b"))).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().checkpoint()
    mark = None
    while True:
        new = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if new == mark or not new[0]:
            break
        mark = new
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        met = large.join(low, "u")
        now = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(met.select("u", F.col("m").alias("v"))).where("u != v").distinct().checkpoint()
    members = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def greedy_cover(edges: DataFrame, scope: str, most: int = 10) -> DataFrame:
    """Greedy set cover within each scope of edges (scope, item, technique): the item with most new techniques is next,
    ties by overall breadth, then id. A scope's edges, which the domain bounds, meet in one row; rows go in batches."""

    def cover(pairs: list[dict]) -> Iterator[tuple[int, object, int, int]]:
        sets: dict[object, set] = defaultdict(set)
        for x in pairs:
            sets[x["item"]].add(x["technique"])
        order = sorted(sets, key=lambda k: (-len(sets[k]), k))
        todo = set().union(*sets.values())
        for step in range(1, most + 1):
            best = max(order, key=lambda k: len(sets[k] & todo))
            new = len(sets[best] & todo)
            if not new:
                return
            todo -= sets[best]
            yield step, best, new, len(todo)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(s, *r) for s, pairs in zip(*(c.to_pylist() for c in batch.columns), strict=True) for r in cover(pairs)]
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["scope", "step", "item", "newly_covered", "left"])

    named = edges.select(F.col(scope).cast("string").alias("scope"), F.col("item").cast("bigint").alias("item"), "technique").distinct()
    grouped = named.groupBy("scope").agg(F.collect_list(F.struct("item", "technique")).alias("pairs"))
    return grouped.mapInArrow(run, "scope string, step long, item long, newly_covered long, left long")


def actor_bundles(eta: DataFrame, most: int = 5, top: int = 10) -> DataFrame:
    """Per actor, frequent episode technique sets, most frequent first, each with at least two techniques not seen before."""
    sets = eta.groupBy("actor", "episode").agg(F.array_join(F.sort_array(F.collect_set("technique")), "|").alias("techniques")).groupBy("actor", "techniques").agg(F.count(F.lit(1)).alias("n"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, seen = [], set()
        best = pdf.sort_values(["n", "techniques"], ascending=[False, True]).head(top)
        for actor, techniques, n in best[["actor", "techniques", "n"]].itertuples(index=False):
            new = set(techniques.split("|")) - seen
            if len(new) >= 2 and len(rows) < most:
                rows.append((actor, len(rows) + 1, "|".join(sorted(new)), n))
                seen |= new
        return pd.DataFrame(rows, columns=["actor", "position", "techniques", "n_episodes"])

    # Only the best sets of an actor can be chosen, so only those travel.
    from pyspark.sql import Window

    ranked = sets.where(F.size(F.split("techniques", "[|]")) >= 2).withColumn("rn", F.row_number().over(Window.partitionBy("actor").orderBy(F.desc("n"), "techniques"))).where(F.col("rn") <= top).drop("rn")
    return ranked.groupBy("actor").applyInPandas(run, "actor string, position long, techniques string, n_episodes long")


def _components(et: DataFrame) -> DataFrame:
    pairs = OPS["b01_weighted_graph"](et=et).select(F.col("technique_a").alias("a"), F.col("technique_b").alias("b"), "weight")
    return with_checkpoints(et, lambda: connected(pairs, 2.0))


def with_checkpoints(df: DataFrame, make):
    """Run an iteration that checkpoints, in the folder that the session names; one of our own only on one machine."""
    import tempfile

    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = context.getConf().get("spark.checkpoint.dir") or df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tideglass-checkpoints-"))
    return make()


def written(df: DataFrame) -> DataFrame:
    """df written once, compressed, in the shared folder until the driver ends."""
    return scratch.written(df, "step")


def _minimal_sets(detects: DataFrame, techniques: DataFrame) -> DataFrame:
    edges = detects.join(techniques.select("technique", "family"), "technique").select("family", F.col("strategy").alias("item"), "technique")
    return greedy_cover(edges, "family")


FUNCTIONS = {
    "b02_louvain": (communities, ["et"], None),
    "b04_connected_components": (
        _components,
        ["et"],
        "WITH RECURSIVE pairs AS (SELECT a.technique AS a, b.technique AS b FROM et AS a JOIN et AS b ON a.episode = b.episode AND a.technique <> b.technique GROUP BY a.technique, b.technique HAVING count(*) >= 2), reach AS (SELECT a AS node, a AS seen FROM pairs UNION SELECT node, b FROM reach JOIN pairs ON seen = a) SELECT node, min(seen) AS component FROM reach GROUP BY node",
    ),
    "b08_actor_bundles": (actor_bundles, ["eta"], None),
    "b10_minimal_detection_set": (_minimal_sets, ["detects", "techniques"], None),
}
