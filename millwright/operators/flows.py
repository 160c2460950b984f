"""Flows of a plan: generators and extraction, buses and their flags, dispositions, what-ifs, trees,
bootstraps, goals, caps in use and carried builds. Rows are keyed by run, site or scenario."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millwright.functions.scalars import EPS
from millwright.session import staged


def folded_in(flows: DataFrame, more: DataFrame, by: list[str], value: str) -> DataFrame:
    """Two sets of flows as one, summed by key."""
    return flows.select(*by, value).unionByName(more.select(*by, value)).groupBy(*by).agg(F.sum(value).alias(value))


def generation(standing: DataFrame, classes: DataFrame, by: list[str]) -> DataFrame:
    """by, mw, fuel: what standing generators (by, class, units) give and burn."""
    return standing.join(classes, "class").groupBy(*by).agg(F.sum(F.col("units") * F.col("mw")).alias("mw"), F.sum(F.col("units") * F.col("burn")).alias("fuel"))


def extraction_power(segments: DataFrame, draws: DataFrame) -> DataFrame:
    """item, cap, share, mw: each raw's segments (item, cap, mw at full draw) at the share of the
    cap that a plan draws, at most all of it."""
    own = segments.groupBy("item").agg(F.sum("cap").alias("cap"), F.sum("mw").alias("full"))
    share = F.when(F.col("cap") > 0, F.least(F.lit(1.0), F.coalesce("draw", F.lit(0.0)) / F.col("cap"))).otherwise(0.0)
    return own.join(draws, "item", "left").withColumn("share", share).select("item", "cap", "share", (F.col("full") * F.col("share")).alias("mw"))


def sums_to_cap(segments: DataFrame, caps: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """item, cap, made, ok: whether each raw's segments sum to its cap; an unlimited cap always
    holds."""
    made = segments.groupBy("item").agg(F.sum("cap").alias("made"))
    rows = caps.join(made, "item", "left").na.fill({"made": 0.0})
    return rows.select("item", "cap", "made", F.coalesce(F.abs(F.col("cap") - F.col("made")) <= tolerance * F.greatest(F.lit(1.0), F.col("cap")), F.lit(True)).alias("ok"))


def out_of_scope(draws: DataFrame, declared: DataFrame) -> DataFrame:
    """item, draw, users: what is drawn of items that no bus declares."""
    return draws.join(declared, "item", "left_anti").groupBy("item").agg(F.sum("draw").alias("draw"), F.count("*").alias("users"))


def merged(lines: DataFrame, edges: DataFrame) -> DataFrame:
    """item, rate, lines, consumers: declared lines (item, rate) as one bus an item, with who takes
    from it among the declared."""
    bus = lines.groupBy("item").agg(F.sum("rate").alias("rate"), F.count("*").alias("lines"))
    used = edges.join(bus.select(F.col("item").alias("parent")), "parent", "left_semi").groupBy(F.col("child").alias("item")).agg(F.count_distinct("parent").alias("consumers"))
    return bus.join(used, "item", "left").na.fill({"consumers": 0})


def binding_rate(out_rate: Column, in_rate: Column, trunk: Column) -> tuple[Column, Column]:
    """The larger side of a recipe on a trunk, and how many of it fit."""
    side = F.greatest(out_rate, in_rate)
    return F.when(in_rate > out_rate, "input").otherwise("output"), F.when(side > 0, F.floor(trunk / side + EPS))


def disposition(owner: Column, stores: Column, withdrawal: Column, storage: Column) -> Column:
    """What becomes of a bus's output: used by machines, withdrawn, stored, or nothing of it."""
    return F.when(owner == "none", "unowned").when(stores & (withdrawal > 0), "store and withdraw").when(stores & (storage > 0), "store").when(withdrawal > 0, "withdraw").otherwise("automated")


def is_stable(kind: Column) -> Column:
    """Whether a draw of that disposition does not change by itself."""
    return kind.isin("automated", "unowned")


def drawn(kind: Column, automated: Column, withdrawal: Column, storage: Column) -> dict[str, Column]:
    """Draw, peak and use of a consumer by its disposition."""
    takes, fills = kind.isin("withdraw", "store and withdraw"), kind.isin("store", "store and withdraw")
    draw = automated + F.when(takes, withdrawal).otherwise(0.0)
    return {"draw": draw, "peak": draw + F.when(fills, storage).otherwise(0.0), "use": F.when(takes | fills, "manual").otherwise("machine")}


def bus_flags(demand: Column, supply: Column, peak: Column, storing: Column, machines: Column, exact: Column) -> dict[str, Column]:
    """Derived columns of a sized bus."""
    return {
        "shortfall": F.greatest(F.lit(0.0), peak - supply), "utilisation": F.when(supply > 0, demand / supply), "tax": machines - exact, "in_deficit": supply < demand - EPS,
        "stores_nothing": storing & (demand >= supply - EPS), "backing_mw": F.least(F.lit(1.0), F.when(supply > 0, demand / supply).otherwise(0.0)) * 4.0 * machines,
    }


def feasibility(flags: dict[str, Column]) -> Column:
    """Names of the flags that hold, in order, as one text."""
    return F.concat_ws(",", F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in flags.items()))))


def replaced(edges: DataFrame, parent: int, children: DataFrame) -> DataFrame:
    """Edges with one parent's replaced by others (child, qty)."""
    return edges.where(F.col("parent") != parent).unionByName(children.select(F.lit(parent).cast("long").alias("parent"), "child", "qty"))


def flattened(tree: DataFrame) -> DataFrame:
    """node, depth, path of a forest (node, parent; roots without one), depth first by path. Every
    round goes one level down; a level without rows ends it."""
    tree = staged(tree.select("node", "parent"), "tree")
    level = staged(tree.where("parent IS NULL").select("node", F.lit(0).alias("depth"), F.array("node").alias("path")), "tree-level")
    levels = []
    while not level.isEmpty():
        levels.append(level)
        above = level.select(F.col("node").alias("parent"), F.col("depth").alias("up"), F.col("path").alias("way"))
        down = tree.join(above, "parent").where(~F.array_contains("way", F.col("node")))
        level = staged(down.select("node", (F.col("up") + 1).alias("depth"), F.concat("way", F.array("node")).alias("path")), "tree-level")
    return reduce(DataFrame.unionByName, levels or [level])


def chained(start: DataFrame, steps: list[DataFrame]) -> DataFrame:
    """item, amount, made: amounts turned by several steps (item, made, ratio) one after another."""
    rows = start.select("item", "amount", F.col("item").alias("made"))
    for step in steps:
        rows = rows.join(step.select(F.col("item").alias("made"), F.col("made").alias("next"), "ratio"), "made").select("item", (F.col("amount") * F.col("ratio")).alias("amount"), F.col("next").alias("made"))
    return rows


def bootstrap(recipes: DataFrame, before: DataFrame, producers: DataFrame) -> DataFrame:
    """building, n: one building for each recipe that was not open before, by the class that runs
    it."""
    return recipes.join(before, "recipe", "left_anti").join(producers, "recipe").groupBy("building").agg(F.count("*").alias("n"))


def projected(goals: DataFrame, rates: DataFrame) -> DataFrame:
    """item, total, rate, minutes of each goal: infinite where nothing makes it."""
    rows = goals.join(rates.groupBy("item").agg(F.sum("rate").alias("rate")), "item", "left").na.fill({"rate": 0.0})
    return rows.withColumn("minutes", F.when(F.col("total") <= 0, 0.0).when(F.col("rate") > EPS, F.col("total") / F.col("rate")).otherwise(float("inf")))


def cap_use(caps: DataFrame, draws: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """item, cap, draw, use, binding: draws against caps; an unlimited one never binds, and an empty
    one binds where something is drawn."""
    rows = caps.join(draws, "item", "left").na.fill({"draw": 0.0})
    use = F.when(F.col("cap") > 0, F.col("draw") / F.col("cap"))
    binding = F.when(F.col("cap").isNull(), False).when(F.col("cap") == 0, F.col("draw") > tolerance).otherwise(F.col("draw") >= F.col("cap") * (1 - tolerance))
    return rows.select("item", "cap", "draw", use.alias("use"), binding.alias("binding"))


def carried(needs: DataFrame, by: list[str], order: str, need: str) -> DataFrame:
    """needs with `standing` (built before), `new` and `spare`: what is built for one phase stands
    in all later ones."""
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    standing = F.coalesce(F.max(need).over(before), F.lit(0.0))
    return needs.withColumn("standing", standing).withColumn("new", F.greatest(F.lit(0.0), F.col(need) - F.col("standing"))).withColumn("spare", F.greatest(F.lit(0.0), F.col("standing") - F.col(need)))


def scheduled(costs: DataFrame, by: list[str], order: list[str], cost: str, income: Column) -> DataFrame:
    """costs with `starts` and `paid`: minutes at which each in order begins to be paid and is."""
    w = Window.partitionBy(*by).orderBy(*order)
    total = F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return costs.withColumn("starts", (total - F.col(cost)) / income).withColumn("paid", total / income)
