"""Every query of the engine, over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tideglass.functions.sqlop import Op
from tideglass.operators import clustering, cooccurrence, coverage, extraction, flows, graph, matching, monitoring, names, quantised, review, search, sequences, simulation, state, textindex
from tideglass.plans import bindings
from tideglass.sources import markup, versions, yaml_rules
from tideglass.streaming import windows

MODULES = (cooccurrence, clustering, coverage, sequences, simulation, flows, search, graph, monitoring, review, extraction, matching, names, quantised, state, textindex, versions, windows, yaml_rules, markup)


def _run(op: Op) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        known: dict[str, DataFrame] = {}
        return op(**{t: bindings.frame(spark, sf_dir, t, known) for t in op.tables})

    return query


def _bound(fn: Callable[..., DataFrame], tables: list[str]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        known: dict[str, DataFrame] = {}
        return fn(*[bindings.frame(spark, sf_dir, t, known) for t in tables])

    return query


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for module in MODULES:
        found |= {name: _run(op) for name, op in getattr(module, "OPS", {}).items()}
        found |= {name: _bound(fn, tables) for name, (fn, tables, _) in getattr(module, "FUNCTIONS", {}).items()}
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for module in MODULES:
        found |= {name: bindings.oracle(op.tables, op.oracle()) for name, op in getattr(module, "OPS", {}).items()}
        for name, (_, tables, text) in getattr(module, "FUNCTIONS", {}).items():
            if text:
                found[name] = bindings.oracle(tables, text)
    return found
