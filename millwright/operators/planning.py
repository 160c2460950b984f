"""Planning operators: ledgers, caps, machines, lanes, power, netting and pacing.

All are joins, grouped sums and column arithmetic over rows keyed by run, site or scenario, so
many what-ifs are more rows of one plan. A null cap is unlimited, which is not zero.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millwright.functions.scalars import EPS, whole

INF = float("inf")


def ledger(flows: dict[str, DataFrame], signs: dict[str, int], by: list[str]) -> DataFrame:
    """by, one column for each kind of flow, and `left`: their signed sum. Each flow has the
    keys and qty."""
    every = reduce(DataFrame.unionByName, (f.select(*by, F.lit(k).alias("kind"), F.col("qty").cast("double").alias("qty")) for k, f in flows.items()))
    sums = [F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("qty"))), F.lit(0.0)).alias(k) for k in flows]
    out = every.groupBy(*by).agg(*sums)
    return out.withColumn("left", reduce(lambda a, b: a + b, (F.col(k) * signs[k] for k in flows)))


def filled_caps(items: DataFrame, caps: DataFrame, draws: DataFrame | None = None) -> DataFrame:
    """item, cap of every item: summed caps, zero where there are none, less the draws."""
    have = items.select("item").join(caps.groupBy("item").agg(F.sum("cap").alias("cap")), "item", "left").na.fill({"cap": 0.0})
    if draws is None:
        return have
    return have.join(draws.groupBy("item").agg(F.sum("draw").alias("draw")), "item", "left").select("item", (F.col("cap") - F.coalesce("draw", F.lit(0.0))).alias("cap"))


def pooled(caps: DataFrame, by: list[str]) -> DataFrame:
    """Caps summed over sites; one unlimited cap makes the sum unlimited."""
    return caps.groupBy(*by).agg(F.sum(F.coalesce("cap", F.lit(INF))).alias("cap")).withColumn("cap", F.when(F.col("cap") != INF, F.col("cap")))


def ceiling(coefficients: DataFrame, caps: DataFrame, by: list[str]) -> DataFrame:
    """by, scale, binding: how many units the caps allow for a forced route: the least cap over
    coefficient, and the first item that attains it."""
    room = coefficients.where("per_target > 0").join(caps, "item").where(F.col("cap").isNotNull()).withColumn("room", F.col("cap") / F.col("per_target"))
    return room.groupBy(*by).agg(F.min(F.struct("room", "item")).alias("m")).select(*by, F.col("m.room").alias("scale"), F.col("m.item").alias("binding"))


def lanes(demand: Column, capacity: Column, per_machine: Column) -> dict[str, Column]:
    """Whole machines for a demand, how many fit on a lane, and the lanes they take."""
    machines, fit = whole(demand / per_machine), F.greatest(F.lit(1), F.floor(capacity / per_machine)).cast("long")
    return {"machines": machines, "per_lane": fit, "lanes": F.ceil(machines / fit).cast("long")}


def decomposed(rows: DataFrame, machines: str, lane_count: str) -> DataFrame:
    """One row for each lane, numbered from 1, machines spread so that they differ by one at
    most."""
    lane = rows.where(F.col(lane_count) > 0).withColumn("lane", F.explode(F.sequence(F.lit(1).cast("long"), F.col(lane_count))))
    extra = F.col("lane") <= F.col(machines) % F.col(lane_count)
    return lane.withColumn("lane_machines", F.floor(F.col(machines) / F.col(lane_count)) + extra.cast("long"))


def shares(rows: DataFrame, by: list[str], draw: str) -> DataFrame:
    """rows with their share of their group's draw; null in a group that draws nothing."""
    total = F.sum(draw).over(Window.partitionBy(*by))
    return rows.withColumn("share", F.when(total != 0, F.col(draw) / total))


def netted(need: DataFrame, have: DataFrame, by: list[str]) -> DataFrame:
    """by, need, have, owed, surplus over all keys of either side."""
    both = need.join(have, by, "full").na.fill({"need": 0, "have": 0})
    return both.select(*by, "need", "have", F.greatest(F.col("need") - F.col("have"), F.lit(0)).alias("owed"), F.greatest(F.col("have") - F.col("need"), F.lit(0)).alias("surplus"))


def paced(bill: DataFrame, rates: DataFrame, by: list[str]) -> DataFrame:
    """bill (by, qty) with rate and minutes: infinite where nothing is made but something is
    owed."""
    out = bill.join(rates, by, "left").na.fill({"rate": 0.0})
    return out.withColumn("minutes", F.when(F.col("qty") <= 0, 0.0).when(F.col("rate") > EPS, F.col("qty") / F.col("rate")).otherwise(INF))


def two_segment_finish(qty: Column, first_rate: Column, until: Column, then_rate: Column) -> Column:
    """Minutes to a quantity at one rate until a moment and another one after."""
    early = first_rate * until
    return F.when(qty <= early, F.when(first_rate > 0, qty / first_rate).otherwise(F.lit(0.0))).when(then_rate > 0, until + (qty - early) / then_rate).otherwise(F.lit(INF))


def feasible_clock(demand: Column, per_machine: Column, machines: Column) -> Column:
    """Clock in percent at which so many machines meet a demand."""
    return F.when(machines > 0, 100 * demand / (per_machine * machines))
