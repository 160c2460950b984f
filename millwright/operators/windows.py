"""Ordered operators: phases, runs, allocation and next-greater lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def densified(rows: DataFrame, item: str, phase: str, value: str) -> DataFrame:
    """Every item in every phase, missing values as zero. Phases are few by nature."""
    phases = rows.select(phase).distinct()
    grid = rows.select(item).distinct().join(F.broadcast(phases))
    return grid.join(rows.select(item, phase, value), [item, phase], "left").na.fill({value: 0})


def phased(rows: DataFrame, item: str, phase: str, value: str) -> DataFrame:
    """rows with previous, running, remaining (after this phase), growth and its kind."""
    order = Window.partitionBy(item).orderBy(phase)
    every = Window.partitionBy(item)
    previous = F.lag(value).over(order)
    running = F.sum(value).over(order.rowsBetween(Window.unboundedPreceding, 0))
    out = rows.select(item, phase, value, previous.alias("previous"), running.alias("running"), (F.sum(value).over(every) - running).alias("remaining"))
    kind = F.when((F.col(value) > 0) & (F.coalesce("previous", F.lit(0)) == 0), "new").when(F.col("previous") > 0, "ratio").otherwise("none")
    return out.withColumn("kind", kind).withColumn("growth", F.when(F.col("kind") == "ratio", F.col(value) / F.col("previous")))


def islands(rows: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """by, run, value, first, last, n: runs of equal values in order."""
    w = Window.partitionBy(*by).orderBy(order)
    begins = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    run = rows.withColumn("__b", begins).withColumn("run", F.sum("__b").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy(*by, "run", value).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))


def layered(rows: DataFrame, by: list[str], height: str, gap: float) -> DataFrame:
    """by, layer, level, members: sorted heights, a new layer wherever they are more than
    `gap` apart, each at its median."""
    w = Window.partitionBy(*by).orderBy(height)
    begins = F.when(F.col(height) - F.lag(height).over(w) <= gap, 0).otherwise(1)
    of = rows.withColumn("__b", begins).withColumn("layer", F.sum("__b").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return of.groupBy(*by, "layer").agg(F.median(height).alias("level"), F.count("*").alias("members"))


def clearances(layers: DataFrame, by: list[str], least: float) -> DataFrame:
    """Layers with the gap to the next above (null if it is under `least` or there is none)."""
    gap = F.lead("level").over(Window.partitionBy(*by).orderBy("layer")) - F.col("level")
    return layers.withColumn("gap", gap).withColumn("clearance", F.when(F.col("gap") >= least, F.col("gap"))).drop("gap")


def allocated(units: DataFrame, by: list[str], order: list[str | Column], capacity: str, need: str) -> DataFrame:
    """units with `taken`: the need is met by the units in order, each up to its capacity, and
    `short`: what is left after all."""
    w = Window.partitionBy(*by).orderBy(*order)
    before = F.coalesce(F.sum(capacity).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = F.greatest(F.lit(0.0), F.least(F.col(capacity), F.col(need) - before))
    total = F.sum(capacity).over(Window.partitionBy(*by))
    return units.withColumn("taken", taken).withColumn("short", F.greatest(F.lit(0.0), F.col(need) - total))


def sufficient(rows: DataFrame, rate: str, marks: DataFrame, capacity: str, mark: str) -> DataFrame:
    """rows with the smallest mark whose capacity reaches the rate, else the largest, and
    whether it reaches. `marks` is a small ladder; it becomes one sorted array in the plan."""
    ladder = marks.agg(F.sort_array(F.collect_list(F.struct(F.col(capacity).alias("c"), F.col(mark).alias("m")))).alias("ladder"))
    joined = rows.join(F.broadcast(ladder))  # one row
    fit = F.filter("ladder", lambda x: x["c"] >= F.col(rate))
    best = F.when(F.size(fit) > 0, F.element_at(fit, 1)).otherwise(F.element_at("ladder", -1))
    return joined.withColumn("__best", best).withColumn("mark", F.col("__best.m")).withColumn("mark_capacity", F.col("__best.c")).withColumn("reaches", F.col("mark_capacity") >= F.col(rate)).drop("ladder", "__best")


def top(rows: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The k first rows of each group, with their rank."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
