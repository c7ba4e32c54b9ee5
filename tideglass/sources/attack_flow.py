"""Attack-flow bundles: actions, edges, and what runs under given conditions."""

from __future__ import annotations

import re
from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def actions(objects: DataFrame) -> DataFrame:
    return objects.where(F.col("type") == "attack-action").select(F.col("id").alias("action_id"), "name", "technique_id", F.coalesce("confidence", F.lit(50.0)).alias("confidence"))


def edges(objects: DataFrame) -> DataFrame:
    """Edges of a flow: effects of actions and operators, branches of conditions, relationships."""
    many = lambda column, kind: objects.select(F.col("id").alias("src"), F.explode(column).alias("dst"), F.lit(kind).alias("kind"))
    direct = objects.where(F.col("type") == "relationship").select(F.col("source_ref").alias("src"), F.col("target_ref").alias("dst"), F.lit("relationship").alias("kind"))
    return many("effect_refs", "effect").unionByName(many("on_true_refs", "true")).unionByName(many("on_false_refs", "false")).unionByName(direct)


def holds(pattern: str | None, given: dict[str, str]) -> bool:
    """A condition `key == 'v'`, or parts joined by AND or OR; what can't be read holds."""
    if not pattern:
        return True
    if len(parts := re.split(r"\s+OR\s+", pattern)) > 1:
        return any(holds(p, given) for p in parts)
    if len(parts := re.split(r"\s+AND\s+", pattern)) > 1:
        return all(holds(p, given) for p in parts)
    if m := re.fullmatch(r"\s*(\w+)\s*==\s*['\"]?([^'\"]*?)['\"]?\s*", pattern):
        return str(given.get(m[1], "")) == m[2]
    return True


def simulate(objects: DataFrame, flow: str, given: dict[str, str], most: int | None = None) -> DataFrame:
    """Actions of each flow in the order they run: breadth first from the flow's start, each object once.
    objects has a column that names the flow; a flow is one bounded group. With `most` a flow stops after as many actions
    (SURVEY P20 has 100); without, it ends by itself, as no object runs twice."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        by_id = {r.id: r for r in pdf.itertuples(index=False)}
        linked: dict[str, list[str]] = {}
        for r in pdf.itertuples(index=False):
            if r.type == "relationship":
                linked.setdefault(r.source_ref, []).append(r.target_ref)
        todo = deque(x for r in by_id.values() if r.type == "attack-flow" for x in (r.start_refs if r.start_refs is not None else []))
        seen: set[str] = set()
        ran = []
        while todo and (most is None or len(ran) < most):
            at = todo.popleft()
            if at in seen or at not in by_id:
                continue
            seen.add(at)
            r = by_id[at]
            refs = lambda x: list(x) if x is not None else []
            if r.type == "attack-condition":
                todo += refs(r.on_true_refs if holds(r.pattern, given) else r.on_false_refs)
                continue
            if r.type == "attack-action":
                ran.append((pdf[flow].iloc[0], len(ran) + 1, at, r.technique_id))
            todo += refs(r.effect_refs) + linked.get(at, [])
        return pd.DataFrame(ran, columns=["flow", "step", "action_id", "technique_id"])

    return objects.groupBy(flow).applyInPandas(run, "flow string, step long, action_id string, technique_id string")
