"""The catalogue of queries: each module of plans adds (name, builder, DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import artifacts, captures, chains, daily, lineage, manifests, network, posts, registry, upkeep

FLAGSHIP = "entity_support_positions"
MODULES = (network, posts, daily, artifacts, registry, captures, lineage, chains, upkeep, manifests)


def _rows():
    for m in MODULES:
        yield from m.QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: build for name, build, _ in _rows()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, _, sql in _rows() if sql}
