"""Named queries over the driver's tables, each with the DuckDB SQL for the same rows where SQL
can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millwright.plans import access, costs, demand, flows, ground, sites, solve, spatial, supply, texts, tracks
from millwright.streaming import events

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
for _module in (demand, supply, spatial, sites, costs, texts, access, ground, flows, tracks, solve, events):
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
