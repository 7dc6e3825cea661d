"""Named queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Build = Callable[[SparkSession, str], DataFrame]

BUILDS: dict[str, Build] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Build], Build]:
    """Register a query builder, and its SQL where SQL can say the same."""

    def keep(build: Build) -> Build:
        BUILDS[name] = build
        if oracle is not None:
            ORACLES[name] = oracle
        return build

    return keep
