"""URL filtering: host and path rules, then exact list membership by a cascade of Bloom filters.

A cascade answers "is this key listed?" without a join and without error for every key of a
known universe. Level 1 encodes the listed keys; level 2 encodes the unlisted keys of the
universe that level 1 wrongly accepts; level 3 the listed keys that level 2 accepts; and so
on until a level has no false positives left. A key is listed if the number of leading
levels that accept it is odd.

The keys are hosts. A list names hosts, and a listed host holds for its subdomains too, so a url's
keys are the trailing parts of its host, up to as many labels as the longest listed host has. The
universe is all keys of all urls of the corpus.

Scale: keys are reduced to distinct 128-bit hashes first, so a host with a third of all rows
counts once. Every level is one distributed pass that makes (word, bits) pairs, combined by
bit_or; only the finished words come to the driver, and their size is known beforehand from
the key counts. Beyond `max_filter_bytes` nothing is broadcast and a join of the distinct hosts
with the listed keys answers instead.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millwright.session import staged, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (action, host, path), as the contract of op3 states them.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

#: The list of the query: hosts that are blocked with their subdomains.
LISTED_HOSTS = [
    "ads-track.example.com", "ads-track.example.net", "ads-track.example.org", "adult-x.example.com", "adult-x.example.net", "adult-x.example.org",
    "casino-win.example.com", "casino-win.example.net", "casino-win.example.org", "cheap-pills.example.com", "cheap-pills.example.net", "cheap-pills.example.org",
    "free-bets.example.com", "free-bets.example.net", "free-bets.example.org", "spam-farm.example.com", "spam-farm.example.net", "spam-farm.example.org",
]

MAX_LEVELS = 64


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end; empty where there is no host part."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, as (rule, action) columns; null where none fits."""
    rule = action = F.lit(None).cast("string")
    for act, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, action = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(act)).otherwise(action)
    return rule, action


@dataclass
class Level:
    """One Bloom filter: `k` probes into `bits` bits held as 64-bit words."""

    seed: int
    bits: int
    k: int
    words: np.ndarray | None = None

    def positions(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bit positions of keys given by two 64-bit hashes, one row per probe."""
        mix = np.uint64((self.seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
        x = (a ^ mix) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        y = (b + mix) * np.uint64(0x94D049BB133111EB) | np.uint64(1)
        y ^= (y >> np.uint64(32)) << np.uint64(1)
        probes = np.arange(self.k, dtype=np.uint64)[:, None]
        return (x + probes * y + probes * probes) % np.uint64(self.bits)

    def accepts(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        at = self.positions(a, b)
        return ((self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=0)


def sized(seed: int, n: int, rate: float) -> Level:
    """An empty filter for n keys with the given rate of false positives."""
    k = max(1, round(math.log2(1 / rate)))
    return Level(seed, max(64, 64 * math.ceil(n * k / math.log(2) / 64)), k)


def leading(levels: list[Level], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many leading levels accept each key."""
    count, alive = np.zeros(len(a), np.int32), np.ones(len(a), bool)
    for level in levels:
        alive &= level.accepts(a, b)
        count += alive
    return count


def _u64(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.asarray(column, dtype=np.int64).view(np.uint64)


def key_hashes(key: Column) -> tuple[Column, Column]:
    """128 bits of a key as two longs."""
    return F.xxhash64(key), F.xxhash64(F.lit("second"), key)


def build_cascade(universe: DataFrame, key: str, listed: str, first_rate: float | None = None, max_filter_bytes: int = 64 << 20) -> list[Level] | None:
    """Levels for the boolean column `listed` over all values of `key`; a null key is the
    empty string, and a key listed once is listed. None if level 1 would pass
    `max_filter_bytes`. Empty universe or empty list: no levels, so nothing is listed."""
    k = F.coalesce(F.col(key).cast("string"), F.lit(""))
    keys = universe.select(k.alias("k"), F.coalesce(F.col(listed), F.lit(False)).alias("listed")).groupBy("k").agg(F.max("listed").alias("listed"))
    a, b = key_hashes(F.col("k"))
    keys = staged(keys.select(a.alias("a"), b.alias("b"), "listed"), "url-keys")
    sizes = {r["listed"]: r["count"] for r in keys.groupBy("listed").count().collect()}  # two rows
    n, rest = sizes.get(True, 0), sizes.get(False, 0)
    levels: list[Level] = []
    while n:
        if len(levels) == MAX_LEVELS:
            raise ValueError("two keys with equal 128-bit hashes, one listed and one not")
        rate = (first_rate or min(0.5, max(1e-6, n * math.sqrt(2) / max(rest, 1)))) if not levels else 0.5
        level = sized(len(levels), n, rate)
        if level.bits // 8 > max_filter_bytes:
            return None
        level.words = _filled(keys, levels, level)
        levels.append(level)
        n = _accepted(keys, levels)
    return levels


def _side(keys: DataFrame, levels: list[Level]) -> DataFrame:
    """The keys that level len(levels) + 1 encodes (or is tested against one level on)."""
    return keys.where(F.col("listed") == F.lit(len(levels) % 2 == 0))


def _filled(keys: DataFrame, levels: list[Level], level: Level) -> np.ndarray:
    """Words of a new level from the keys of its side that all earlier levels accept."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros(level.bits // 64, np.uint64)
        for batch in batches:
            a, b = _u64(batch["a"]), _u64(batch["b"])
            a, b = (x[leading(levels, a, b) == len(levels)] for x in (a, b))
            at = level.positions(a, b).ravel()
            np.bitwise_or.at(words, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        on = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(on), pa.array(words[on].view(np.int64))], names=["word", "bits"])

    rows = _side(keys, levels).select("a", "b").mapInArrow(bits, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    words = np.zeros(level.bits // 64, np.uint64)  # at most max_filter_bytes, checked before
    words[rows["word"].to_numpy(np.int64)] = _u64(rows["bits"])
    return words


def _accepted(keys: DataFrame, levels: list[Level]) -> int:
    """How many keys of the other side all levels accept: the next level's size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = sum(int((leading(levels, _u64(x["a"]), _u64(x["b"])) == len(levels)).sum()) for x in batches)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return _side(keys, levels).select("a", "b").mapInArrow(count, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def is_listed(spark: SparkSession, levels: list[Level], keys: Column) -> Column:
    """Boolean column: whether any key of an array is listed; exact for every key of the universe
    that the cascade was built over. An empty array is not."""
    shared = spark.sparkContext.broadcast(levels)

    @F.arrow_udf("boolean")
    def test(a: pa.Array, b: pa.Array) -> pa.Array:
        hit = leading(shared.value, _u64(a.flatten()), _u64(b.flatten())) % 2 == 1
        found = np.zeros(len(a), bool)
        found[a.value_parent_indices().to_numpy()[hit]] = True
        return pa.array(found)

    return test(F.transform(keys, lambda k: key_hashes(k)[0]), F.transform(keys, lambda k: key_hashes(k)[1]))


def trailing(host: Column, labels: int) -> Column:
    """The distinct last 1, 2, ... `labels` labels of a host, the host itself where it has fewer."""
    return F.array_distinct(F.array(*(F.substring_index(host, ".", -i) for i in range(1, labels + 1))))


def _free(names: list[str], wish: str) -> str:
    """A column name that is not among `names`."""
    while wish in names:
        wish += "_"
    return wish


def filter_urls(pages: DataFrame, listed: DataFrame, url: str = "url", rules: list[tuple[str, str, str]] = RULES, max_filter_bytes: int = 64 << 20) -> DataFrame:
    """Every row of `pages` with host, path, rule and verdict added.

    `listed` has the listed hosts in a column `host`, of any size; null and empty ones are left
    out, letter case does not count. A null url or one without `://` has an empty host and path.
    Columns of `pages` named like an added column are replaced. Repeated rows stay; an empty table
    gives an empty result."""
    added = ("host", "path", "rule", "verdict")
    at = F.col(f"`{url}`")
    rows = pages.select(*(F.col(f"`{c}`") for c in pages.columns if c not in added), host_of(at).alias("host"), path_of(at).alias("path"))
    names = listed.select(F.translate("host", UPPER, LOWER).alias("k")).where("k <> ''").distinct()
    labels = names.agg(F.coalesce(F.max(F.size(F.split("k", "[.]"))), F.lit(1))).first()[0]
    hosts = rows.select("host").distinct()
    keys = hosts.select(F.explode(trailing(F.col("host"), labels)).alias("k"), F.lit(False).alias("listed"))
    levels = build_cascade(keys.unionByName(names.withColumn("listed", F.lit(True))), "k", "listed", max_filter_bytes=max_filter_bytes)
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    if levels is None:
        own, mark = _free(rows.columns, "listed_host"), _free(rows.columns, "listed_mark")
        hit_hosts = hosts.select(F.col("host").alias(own), F.explode(trailing(F.col("host"), labels)).alias("k")).join(names, "k", "left_semi").select(own).distinct().withColumn(mark, F.lit(True))
        rows = rows.join(hit_hosts, F.col("host") == F.col(f"`{own}`"), "left").drop(own)
        hit = F.col(f"`{mark}`").isNotNull()
        return rows.withColumn("rule", rule).withColumn("verdict", F.coalesce(action, F.when(hit, "block").otherwise("allow"))).drop(mark)
    hit = is_listed(pages.sparkSession, levels, trailing(F.col("host"), labels))
    return rows.withColumn("rule", rule).withColumn("verdict", F.coalesce(action, F.when(hit, "block").otherwise("allow")))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts for every page: page_id, host, path, rule, verdict."""
    listed = spark.createDataFrame([(h,) for h in LISTED_HOSTS], "host string")
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), listed).select("page_id", "host", "path", "rule", "verdict")


OP3_SQL = rf"""
WITH listed(name) AS (VALUES {', '.join(f"('{h}')" for h in LISTED_HOSTS)}),
parts AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), '{UPPER}', '{LOWER}') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM parts)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow'
    WHEN rule IS NOT NULL THEN 'block'
    WHEN EXISTS (SELECT 1 FROM listed WHERE host = name OR ends_with(host, '.' || name)) THEN 'block'
    ELSE 'allow' END AS verdict
FROM ruled
"""
