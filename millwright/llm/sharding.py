"""Byte-balanced shards by Karmarkar-Karp differencing.

A partial partition is a list of k part sums. Differencing takes the two partial partitions
with the largest spread (largest less smallest sum) and adds them oppositely ordered, the
largest part of one to the smallest of the other, until one is left. That balances far better
than giving the next group to the lightest shard.

One heap over all groups would be one task, so differencing runs as a tree. Groups are dealt
to cells by hash, every cell is differenced by itself to one partial partition of k sums, and
beyond `top` cells these are differenced again, `fan` in a task. The last step differences,
as single items, the parts of the top cells, all groups larger than 1/`top` of an even share
(at most k * `top` of them) and the groups of one cell, whose small sizes even out the rest;
its size is bounded whatever the input. A level keeps only k rows for each cell; the shard of
a group is found by following its part up the levels.

Groups are indivisible: equal texts share a shard, so a group larger than an even share fixes
the largest shard. Copies are counted before any shuffle of groups, and rows are numbered in
cells of their own, so a group with a third of all rows never meets in one task.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millwright.session import staged, table


def difference(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Karmarkar-Karp over the rows of `sums` (n partial partitions of k parts).

    Returns the k final sums and, for each row, the final part that each of its parts went to.
    Ties in spread go to the row that came first."""
    n, k = sums.shape
    if not n:
        return np.zeros(k, np.int64), np.zeros((0, k), np.int64)
    heap = [(-int(s.max() - s.min()), i) for i, s in enumerate(sums)]
    heapq.heapify(heap)
    held = list(sums.astype(np.int64))
    joins: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        down, up = np.argsort(-held[a], kind="stable"), np.argsort(held[b], kind="stable")
        total = held[a][down] + held[b][up]
        joins.append((a, b, down, up))
        held.append(total)
        heapq.heappush(heap, (-int(total.max() - total.min()), len(held) - 1))
    to: list[np.ndarray | None] = [None] * len(held)
    last = heap[0][1]
    to[last] = np.arange(k)
    for at in range(len(joins) - 1, -1, -1):
        a, b, down, up = joins[at]
        above = to[n + at]
        to[a], to[b] = np.empty(k, np.int64), np.empty(k, np.int64)
        to[a][down], to[b][up] = above, above
    return held[last], np.array(to[:n])


def _grouped(rows: DataFrame, columns: list[str], work, schema: str) -> DataFrame:
    """`work` over all rows of each value of `cell`; rows arrive as one Arrow table."""

    def run(t: pa.Table) -> pa.Table:
        return pa.Table.from_pydict(work(*(t[c].to_numpy() for c in ("cell", *columns))))

    return rows.groupBy("cell").applyInArrow(run, schema)


def balanced(groups: DataFrame, key: str, size: str, shards: int, cell_groups: int = 4096, fan: int = 256, top: int = 256) -> DataFrame:
    """(key, shard) for every row of `groups` (one row for each key) so that the sums of
    `size` are near equal. No rows: no rows."""
    n, total = groups.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    cells = max(1, math.ceil(n / cell_groups))
    cell = F.pmod(F.xxhash64(F.lit("cell"), F.col(key)), F.lit(cells)).cast("int")
    dealt = groups.select(cell.alias("cell"), key, F.col(size).cast("long").alias("sum"))
    loose = (F.col("sum") > total // (shards * top)) | (F.col("cell") == 0)
    single = dealt.where(loose).select(key, F.lit(-1).alias("top"), F.lit(-1).alias("to"), "sum")

    def first(at: np.ndarray, keys: np.ndarray, sizes: np.ndarray) -> dict:
        order = np.argsort(keys, kind="stable")
        order = order[np.argsort(-sizes[order], kind="stable")]
        one = np.zeros((len(keys), shards), np.int64)
        one[:, 0] = sizes[order]
        sums, to = difference(one)
        return {"cell": np.full(len(keys), at[0], np.int32), key: keys[order], "part": to[:, 0].astype(np.int32), "sum": sums[to[:, 0]]}

    def join(above: np.ndarray, own: np.ndarray, part: np.ndarray, sums: np.ndarray) -> dict:
        cell, row = np.unique(own, return_inverse=True)
        each = np.zeros((len(cell), shards), np.int64)
        each[row, part] = sums
        joined, to = difference(each)
        to = to.ravel()
        return {"cell": np.repeat(cell, shards).astype(np.int32), "part": np.tile(np.arange(shards, dtype=np.int32), len(cell)), "above": np.full(len(to), above[0], np.int32), "to": to.astype(np.int32), "sum": joined[to]}

    kind = dict(groups.dtypes)[key]
    placed = staged(_grouped(dealt.where(~loose), [key, "sum"], first, f"cell int, {key} {kind}, part int, sum long"), "shard-cells")
    parts = placed.groupBy("cell", "part").agg(F.max("sum").alias("sum"))
    paths = parts.select("cell", "part", F.col("cell").alias("top"), F.col("part").alias("to"))
    while cells > top:
        members = parts.select((F.col("cell") / F.lit(fan)).cast("int").alias("cell"), F.col("cell").alias("own"), "part", "sum")
        level = staged(_grouped(members, ["own", "part", "sum"], join, "cell int, part int, above int, to int, sum long"), "shard-level")
        up = level.select(F.col("cell").alias("top"), F.col("part").alias("to"), "above", F.col("to").alias("__to"))
        paths = paths.join(up, ["top", "to"]).select("cell", "part", F.col("above").alias("top"), F.col("__to").alias("to"))
        parts = level.groupBy(F.col("above").alias("cell"), F.col("to").alias("part")).agg(F.max("sum").alias("sum"))
        cells = math.ceil(cells / fan)

    def last(keys: np.ndarray, at: np.ndarray, part: np.ndarray, sizes: np.ndarray) -> dict:
        order = np.array(sorted(range(len(sizes)), key=lambda i: (-sizes[i], at[i], part[i], keys[i] or "")))
        one = np.zeros((len(order), shards), np.int64)
        one[:, 0] = sizes[order]
        return {key: keys[order], "top": at[order], "to": part[order], "shard": difference(one)[1][:, 0].astype(np.int32)}

    items = single.unionByName(parts.select(F.lit(None).cast(kind).alias(key), F.col("cell").alias("top"), F.col("part").alias("to"), "sum"))
    final = items.groupBy(F.lit(0).alias("cell")).applyInArrow(lambda t: pa.Table.from_pydict(last(*(t[c].to_numpy() for c in (key, "top", "to", "sum")))), f"{key} {kind}, top int, to int, shard int")
    final = staged(final, "shard-final")
    rest = placed.join(paths, ["cell", "part"]).join(final.where("top >= 0").drop(key), ["top", "to"]).select(key, "shard")
    return final.where("top < 0").select(key, "shard").unionByName(rest)


def numbered(rows: DataFrame, group: str, order: list[Column], spread: Column, name: str, cell_rows: int = 1024) -> DataFrame:
    """`rows` with a gapless number from 0 in each group, column `name`.

    A group is numbered in cells given by `spread`, each with an offset, so the size of a
    group bounds no task."""
    cells = max(1, math.ceil(rows.count() / cell_rows))
    rows = rows.withColumn("__cell", F.pmod(spread, F.lit(cells)).cast("int"))
    counts = rows.groupBy(group, "__cell").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(group).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(group, "__cell", F.coalesce(before, F.lit(0)).alias("__first"))
    inside = F.row_number().over(Window.partitionBy("__cell", group).orderBy(*order)) - 1
    return rows.withColumn("__in", inside).join(offsets, ["__cell", group]).withColumn(name, (F.col("__first") + F.col("__in")).cast("long")).drop("__cell", "__in", "__first")


def shard_documents(docs: DataFrame, shards: int = 40, overhead: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row of `docs` (doc_id, text).

    Size is the text's UTF-8 bytes plus `overhead`; a null text counts as empty. Equal texts
    share a shard; equal rows get slots of their own. An empty table gives an empty result."""
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = staged(docs.select("doc_id", (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("text_key")), "shard-rows")
    groups = staged(rows.groupBy("text_key").agg(F.sum("size").alias("bytes")), "shard-groups")
    placed = rows.join(balanced(groups, "text_key", "bytes", shards), "text_key")
    # `row` is fixed once it is written; it deals equal rows to different cells.
    placed = staged(placed.select("doc_id", "size", "text_crc32", "text_key", F.col("shard").cast("int").alias("shard"), F.monotonically_increasing_id().alias("row")), "shard-placed")
    return numbered(placed, "shard", [F.col("doc_id"), F.col("text_key"), F.col("row")], F.xxhash64("row"), "slot").drop("row")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 39 under the law `bytes`."""
    rows = shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
