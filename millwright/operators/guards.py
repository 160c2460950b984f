"""Joins and lookups that must match exactly, or refuse by name.

A refusal is one small aggregate over the keys; nothing but a count and a few example keys
comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Refusal(ValueError):
    """A named reason why an input cannot be used."""

    def __init__(self, name: str, count: int, examples: list):
        self.name, self.count, self.examples = name, count, examples
        super().__init__(f"{name}: {count} ({', '.join(map(str, examples))})")


def refuse(rows: DataFrame, name: str, keys: list[str]) -> None:
    """Raises Refusal if `rows` has any row."""
    key = F.concat_ws("/", *(F.col(k).cast("string") for k in keys))
    count, least, most = rows.agg(F.count("*"), F.min(key), F.max(key)).first()
    if count:
        raise Refusal(name, count, sorted({least, most}))


def require_unique(rows: DataFrame, keys: list[str], name: str = "duplicate key") -> DataFrame:
    """`rows`, if no two of them agree on `keys`."""
    refuse(rows.groupBy(*keys).count().where("count > 1"), name, keys)
    return rows


def require_no_orphans(rows: DataFrame, of: DataFrame, keys: list[str], name: str = "unknown key") -> DataFrame:
    """`rows`, if each of its keys is in `of`."""
    refuse(rows.select(*keys).distinct().join(of.select(*keys), keys, "left_anti"), name, keys)
    return rows


def require_one(rows: DataFrame, name: str) -> DataFrame:
    """`rows`, if it is exactly one row."""
    n = rows.limit(2).count()
    if n != 1:
        raise Refusal(name, n, [])
    return rows


def matched_one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join of two tables that must have the same keys, each once."""
    require_unique(left, keys, "duplicate on the left")
    require_unique(right, keys, "duplicate on the right")
    require_no_orphans(left, right, keys, "missing on the right")
    require_no_orphans(right, left, keys, "missing on the left")
    return left.join(right, keys)
