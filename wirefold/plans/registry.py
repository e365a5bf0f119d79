"""Query registry: name -> (Spark callable, oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    """Register a query; ``oracle`` is DuckDB SQL over the same tables (None = rows-only check)."""

    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle.strip()
        return fn

    return deco


def load_all() -> tuple[dict[str, QueryFn], dict[str, str]]:
    """Import every query module so the registry is complete."""
    from wirefold.plans import network_queries, packet_queries, sampling_queries, scoring_queries, vector_queries  # noqa: F401

    return QUERIES, ORACLES
