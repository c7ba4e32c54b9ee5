"""Neighbourhoods, paths, lineage and lookups over typed edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideglass.functions import scratch
from tideglass.functions.sqlop import Op

_EDGES = "edges AS (SELECT 'detects' AS type, strategy AS src, technique AS dst FROM {detects} UNION ALL SELECT 'mitigates', mitigation, technique FROM {mitigates})"
RELATIONS = ("detects", "mitigates")
#: Nodes that are broadcast to the edges; beyond, edges and nodes are shuffled to each other.
FEW = 100_000

OPS = {
    "i01_subgraph": Op("Up to ten strategies and mitigations of each live technique of a family.", f"WITH {_EDGES} SELECT technique, type, src FROM (SELECT t.technique, type, src, row_number() OVER (PARTITION BY t.technique, type ORDER BY src) AS rn FROM {{techniques}} AS t JOIN edges ON t.technique = edges.dst WHERE family = :family AND NOT revoked) AS r WHERE rn <= :top", family="Brand#11", top=10),
    "i02_neighbours": Op("Neighbours of a node in both directions by type.", f"WITH {_EDGES} SELECT type, dst AS neighbour, 'outgoing' AS direction FROM edges WHERE src = :node UNION ALL SELECT type, src, 'incoming' FROM edges WHERE dst = :node", node=17),
    "i05_induced": Op("Edges between given nodes, one for each pair and type.", f"WITH {_EDGES} SELECT DISTINCT type, src, dst FROM edges WHERE src IN :nodes AND dst IN :nodes", nodes=list(range(1, 80))),
    "i06_actor_search": Op("Actors by part of a name.", "SELECT actor, name FROM {actors} WHERE contains(lower(name), :part) ORDER BY actor LIMIT :top", part="n_1", top=20),
    "i07_technique_lookup": Op("Techniques with their primary tactic.", "SELECT n.technique, n.name, p.tactic FROM {technique_names} AS n LEFT JOIN {primary_tactic} AS p ON n.technique = p.technique"),
    "i08_by_tactic": Op("Techniques of each tactic by flag.", "SELECT tactic, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN is_sub THEN 1 ELSE 0 END) AS BIGINT) AS subs, min(technique) AS first_technique FROM {techniques} WHERE NOT coalesce(revoked, FALSE) GROUP BY tactic"),
    "i09_autocomplete": Op("Names that contain what was typed, shortest first.", "SELECT technique, name FROM {techniques} WHERE contains(lower(name), :part) ORDER BY length(name), technique LIMIT :top", part="part_1", top=10),
    "i10_history": Op("Newest queries of each user.", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM {events}) AS r WHERE rn <= :top", top=20),
    "i11_sub_techniques": Op("Sub-techniques of each family.", "SELECT family, CAST(count(*) AS BIGINT) AS subs FROM {techniques} WHERE is_sub GROUP BY family"),
}


def checked(types: list[str] | None) -> list[str]:
    """Relation types that are known; others are refused rather than put into a query."""
    wanted = list(types or RELATIONS)
    if unknown := set(wanted) - set(RELATIONS):
        raise ValueError(f"unknown relation types: {sorted(unknown)}")
    return wanted


def shortest(edges: DataFrame, source: object, max_length: int = 5) -> DataFrame:
    """Undirected distances from a node of edges (src, dst): node, hops. Each round keeps the edges that touch the last
    one's nodes: a hub's edges pass one by one and are never held together. Each node is reached once, in rounds that only
    the last two can have met before."""
    spark = edges.sparkSession
    kind = edges.schema["src"].dataType.simpleString()
    held = scratch.written(edges.select("src", F.col("dst").cast(kind).alias("dst")).distinct(), "edges")
    found = held.agg(F.approx_count_distinct("src").alias("src"), F.approx_count_distinct("dst").alias("dst")).first()
    last, front = None, spark.createDataFrame([(source, 0)], f"node {kind}, hops long")
    seen = [front]
    n = 1

    def touched(near: str, far: str) -> DataFrame:
        own = front.select(F.col("node").alias(near))
        if n > FEW and found[near] <= FEW:
            # Few nodes are at this end, so only they are looked for, and edges aren't dealt by them.
            own = held.select(near).distinct().join(own, near, "left_semi")
        small = min(n, found[near]) <= FEW
        return held.join(F.broadcast(own) if small else own, near, "left_semi").select(F.col(far).alias("node"))

    for hop in range(1, max_length + 1):
        fresh = touched("src", "dst").unionByName(touched("dst", "src")).distinct()
        for before in [x for x in (last, front) if x is not None]:
            known = before.select(F.col("node").alias("known"))
            fresh = fresh.join(known, F.col("node").eqNullSafe(F.col("known")), "left_anti")
        last, front = front, scratch.written(fresh.select("node", F.lit(hop).cast("long").alias("hops")), "front")
        n = front.count()
        if not n:
            break
        seen.append(front)
    return reduce(DataFrame.unionByName, seen)


def _paths(transitions: DataFrame) -> DataFrame:
    return shortest(transitions.select("src", "dst"), "click")


def _lineage(et: DataFrame) -> DataFrame:
    """Upstream and downstream objects of an episode within three steps: episodes and techniques as one graph."""
    edges = et.select(F.concat(F.lit("e"), "episode").alias("src"), F.col("technique").alias("dst"))
    return shortest(edges, "e1", 3)


FUNCTIONS = {
    "i04_shortest_path": (_paths, ["transitions"], "WITH RECURSIVE b AS (SELECT src, dst FROM transitions UNION SELECT dst, src FROM transitions), w AS (SELECT 'click' AS node, CAST(0 AS BIGINT) AS hops UNION SELECT dst, hops + 1 FROM w JOIN b ON node = src WHERE hops < 5) SELECT node, min(hops) AS hops FROM w GROUP BY node"),
    "l16_lineage": (_lineage, ["et"], "WITH RECURSIVE a AS (SELECT 'e' || episode AS src, technique AS dst FROM et), b AS (SELECT src, dst FROM a UNION SELECT dst, src FROM a), w AS (SELECT 'e1' AS node, CAST(0 AS BIGINT) AS hops UNION SELECT dst, hops + 1 FROM w JOIN b ON node = src WHERE hops < 3) SELECT node, min(hops) AS hops FROM w GROUP BY node"),
}
