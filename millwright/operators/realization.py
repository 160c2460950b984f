"""Buses: whole machines sized from the last product down, level by level.

A bus makes one item for all that use it. Its demand is what goes outside plus what the whole
machines of its users draw, so users are sized first; buses of one level are one join and one
grouped sum. A cycle is refused by the levels, never iterated to a fixed point.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millwright.functions.scalars import whole
from millwright.operators import graph
from millwright.session import staged


def sized(recipes: DataFrame, edges: DataFrame, external: DataFrame) -> DataFrame:
    """item, level, demand, machines, supply, residual of every item that is asked for.

    `recipes` has item and per_machine (made a minute); `edges` has parent, child and qty (of
    child for one parent); `external` has item and rate. Items without a recipe are taken from
    outside: no machines, supply as demanded."""
    order = staged(graph.levels(edges.select(F.col("parent").alias("a"), F.col("child").alias("b"))), "bus-levels")
    last = order.agg(F.max("level")).first()[0] or 0
    flows = staged(external.select("item", F.col("rate").cast("double").alias("rate")), "bus-flows")
    done = None
    for level in range(last + 1):
        own = flows.join(order.where(F.col("level") == level), flows["item"] == order["node"]).groupBy("item").agg(F.sum("rate").alias("demand"))
        rows = own.join(recipes, "item", "left").withColumn("machines", F.when(F.col("per_machine").isNotNull(), whole(F.col("demand") / F.col("per_machine"))))
        rows = rows.withColumn("supply", F.coalesce(F.col("machines") * F.col("per_machine"), F.col("demand")))
        rows = staged(rows.select("item", F.lit(level).alias("level"), "demand", "machines", "supply", (F.col("supply") - F.col("demand")).alias("residual")), "bus-rows")
        drawn = rows.where("machines IS NOT NULL").join(edges, F.col("item") == F.col("parent")).select(F.col("child").alias("item"), (F.col("supply") * F.col("qty")).alias("rate"))
        flows = staged(flows.unionByName(drawn), "bus-flows")
        done = rows if done is None else done.unionByName(rows)
    return done


def integral_widths(rows: DataFrame, rate: str, draws: str, widest: int = 12) -> DataFrame:
    """rows with `widths`: lane widths whose output is a multiple of every draw (an array)."""
    fits = lambda w: F.forall(F.col(draws), lambda x: F.abs(w * F.col(rate) / x - F.rint(w * F.col(rate) / x)) <= 1e-9)
    return rows.withColumn("widths", F.filter(F.sequence(F.lit(1), F.lit(widest)), fits))


def speed_profile(steps: DataFrame, by: str, order: str, top: float = 30.0, gain: float = 4.0, loss: float = 6.0) -> DataFrame:
    """(by, minutes, length): time along routes whose speed may rise by `gain` and fall by
    `loss` a step. `steps` has length and limit.

    After a forward pass a step's speed is the least of every earlier limit plus the gains since,
    after a backward pass the least of every later one plus the losses until, so both are running
    minima."""
    forth = Window.partitionBy(by).orderBy(order)
    rows = steps.withColumn("_i", F.row_number().over(forth)).withColumn("_v", F.least(F.lit(top), F.col("limit")))
    up = rows.withColumn("_u", gain * F.col("_i") + F.min(F.col("_v") - gain * F.col("_i")).over(Window.partitionBy(by).orderBy("_i")))
    speed = up.withColumn("_s", F.min(F.col("_u") + loss * F.col("_i")).over(Window.partitionBy(by).orderBy(F.col("_i").desc())) - loss * F.col("_i"))
    return speed.groupBy(by).agg(F.sum(F.col("length") / F.col("_s")).alias("minutes"), F.sum("length").alias("length"))


def rasterized(triangles: DataFrame, size: float) -> DataFrame:
    """(id, r, c, z): cells whose centre a triangle covers, with its height there. `triangles`
    has id and x0, y0, z0 to x2, y2, z2; upright ones cover nothing."""
    lo = lambda k: F.floor(F.least(f"{k}0", f"{k}1", f"{k}2") / size).cast("int")
    hi = lambda k: F.floor(F.greatest(f"{k}0", f"{k}1", f"{k}2") / size).cast("int")
    cells = triangles.withColumn("c", F.explode(F.sequence(lo("x"), hi("x")))).withColumn("r", F.explode(F.sequence(lo("y"), hi("y"))))
    x, y = (F.col("c") + 0.5) * size, (F.col("r") + 0.5) * size
    v = F.col
    area = (v("y1") - v("y2")) * (v("x0") - v("x2")) + (v("x2") - v("x1")) * (v("y0") - v("y2"))
    a = ((v("y1") - v("y2")) * (x - v("x2")) + (v("x2") - v("x1")) * (y - v("y2"))) / v("area")
    b = ((v("y2") - v("y0")) * (x - v("x2")) + (v("x0") - v("x2")) * (y - v("y2"))) / v("area")
    at = cells.withColumn("area", area).where("area <> 0").withColumn("a", a).withColumn("b", b).withColumn("g", 1 - F.col("a") - F.col("b"))
    return at.where("a >= 0 AND b >= 0 AND g >= 0").select("id", "r", "c", (v("a") * v("z0") + v("b") * v("z1") + v("g") * v("z2")).alias("z"))


def patched(cells: DataFrame, patch: DataFrame) -> DataFrame:
    """Cells (r, c, z) under a patch (r, c, known, passable, floor): passable cells take its
    floor, blocked ones lose their height, unknown ones stay."""
    z = F.when(F.col("known") & F.col("passable"), F.col("floor")).when(F.col("known") & ~F.col("passable"), F.lit(None).cast("double")).otherwise(F.col("z"))
    return cells.join(patch, ["r", "c"], "left").select("r", "c", z.alias("z"))


def principal_span(x: str, y: str) -> Column:
    """Four standard deviations along the main axis of points: the larger root of their 2 x 2
    covariance."""
    a, b, c = F.var_pop(x), F.covar_pop(x, y), F.var_pop(y)
    return 4 * F.sqrt(F.greatest(F.lit(0.0), (a + c) / 2 + F.sqrt(F.pow((a - c) / 2, 2) + b * b)))


def alternatives(edges: DataFrame, source: object, target: object, count: int = 3, penalty: float = 1.0) -> DataFrame:
    """(rank, step, node, cost) of the cheapest path and further ones, each found with the edges
    of all earlier ones made dearer by `penalty` of their cost; cost is without penalties."""
    spark, out = edges.sparkSession, None
    kind = dict(edges.dtypes)["a"]
    now = edges = staged(edges.select("a", "b", "cost"), "alternative-all")
    for rank in range(count):
        best = graph.shortest(now, spark.createDataFrame([(source,)], f"source {kind}"))
        path = staged(graph.paths(best, spark.createDataFrame([(source, target)], f"source {kind}, target {kind}")).select("step", "node"), "alternative")
        legs = path.alias("p").join(path.alias("q"), F.col("q.step") == F.col("p.step") + 1).select(F.col("p.node").alias("a"), F.col("q.node").alias("b"))
        cost = legs.join(edges, ["a", "b"]).agg(F.sum("cost").alias("total"))
        rows = path.join(F.broadcast(cost)).select(F.lit(rank).alias("rank"), "step", "node", F.col("total").alias("cost"))
        out = rows if out is None else out.unionByName(rows)
        now = staged(now.join(legs.withColumn("used", F.lit(True)), ["a", "b"], "left").select("a", "b", F.when(F.col("used"), F.col("cost") * (1 + penalty)).otherwise(F.col("cost")).alias("cost")), "alternative-edges")
    return out

