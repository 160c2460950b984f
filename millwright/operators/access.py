"""What a plan may use: unlocks, classes, marks and options, each a join that matches as it must
or refuses by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millwright.operators.guards import refuse, require_unique


def granted(schematics: DataFrame, unlocks: DataFrame, buildings: DataFrame, owned: Column) -> DataFrame:
    """building: what the owned schematics unlock, by their recipes (schematic, recipe) and the
    buildings that these make (recipe, building), each once."""
    own = schematics.where(owned).select("schematic")
    return unlocks.join(own, "schematic", "left_semi").join(buildings, "recipe").select("building").distinct()


def first_obtained(classes: DataFrame, recipes: DataFrame, held: DataFrame) -> DataFrame:
    """class, rank of the held classes in the order (ord) in which they come; a class that no
    recipe (class) makes is refused."""
    refuse(classes.join(recipes.select("class").distinct(), "class", "left_anti"), "class without a recipe", ["class"])
    rows = classes.join(held.select("class").distinct(), "class", "left_semi").groupBy("class").agg(F.min("ord").alias("ord"))
    return rows.select("class", F.row_number().over(Window.orderBy("ord", "class")).alias("rank"))  # one row a class


def matched_once(rows: DataFrame, to: DataFrame, keys: list[str], name: str) -> DataFrame:
    """`rows` joined with `to`, of which each row must match exactly one."""
    require_unique(to, keys, f"{name}: several matches")
    refuse(rows.join(to.select(*keys), keys, "left_anti"), f"{name}: no match", keys)
    return rows.join(to, keys)


def highest(marks: DataFrame, by: list[str], capacity: str) -> DataFrame:
    """by, mark, capacity: the largest of each group, the smallest mark among equals."""
    best = marks.groupBy(*by).agg(F.max(F.struct(capacity, (-F.col("mark")).alias("no"))).alias("m"))
    return best.select(*by, (-F.col("m.no")).alias("mark"), F.col(f"m.{capacity}").alias(capacity))


def ladder(marks: DataFrame, by: list[str], capacity: str) -> DataFrame:
    """by, marks: all marks of each group in order of capacity."""
    return marks.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(capacity, "mark"))), lambda x: x["mark"]).alias("marks"))


def with_fallback(rows: DataFrame, exact: DataFrame, loose: DataFrame, keys: list[str], loose_keys: list[str], value: str) -> DataFrame:
    """`rows` with the value of the exact key, or that of the looser one."""
    a = rows.join(exact.select(*keys, F.col(value).alias("_exact")), keys, "left")
    b = a.join(loose.select(*loose_keys, F.col(value).alias("_loose")), loose_keys, "left")
    return b.withColumn(value, F.coalesce("_exact", "_loose")).drop("_exact", "_loose")


def stepped_down(options: DataFrame, by: list[str], draw: str, top: str) -> DataFrame:
    """by, option, rate: the slowest option that still meets the draw within the power of the
    largest; none where even that one is too slow."""
    fits = options.where((F.col("rate") >= F.col(draw)) & (F.col("mw") <= F.col(top)))
    return fits.groupBy(*by).agg(F.min(F.struct("rate", "option")).alias("m")).select(*by, "m.option", "m.rate")


def held_reason(recipe: Column, granted: Column, withheld: Column, pool: Column) -> Column:
    """Why a recipe is not held; null for one that is."""
    return F.when(granted & ~withheld, F.lit(None).cast("string")).when(withheld, "withheld").when(pool, "in the pool").otherwise("unlocked later")


def rivals(inputs: DataFrame, outputs: DataFrame, of: DataFrame) -> DataFrame:
    """item, recipe: recipes that make an item of `of` (item, avoid) without taking the item that
    it is to avoid."""
    makes = outputs.join(of, "item").select("item", "avoid", "recipe")
    takes = inputs.select("recipe", F.col("item").alias("avoid"))
    return makes.join(takes, ["recipe", "avoid"], "left_anti").select("item", "recipe")


def partitioned(rows: DataFrame, order: str) -> DataFrame:
    """item, recipe: each item's recipe as first declared; an item with several is refused."""
    several = rows.groupBy("item").agg(F.count_distinct("recipe").alias("n")).where("n > 1")
    refuse(several, "item with several recipes", ["item"])
    return rows.groupBy("item").agg(F.min(F.struct(order, "recipe")).alias("m")).select("item", "m.recipe")


def covered(bus: DataFrame, consumers: DataFrame) -> DataFrame:
    """item, consumer, problem: consumers that no bus serves, and served ones that do not exist."""
    keys = ["item", "consumer"]
    missing = consumers.select(*keys).join(bus, keys, "left_anti").withColumn("problem", F.lit("unserved"))
    return missing.unionByName(bus.select(*keys).join(consumers, keys, "left_anti").withColumn("problem", F.lit("unknown")))


def claimed(claims: DataFrame) -> DataFrame:
    """socket, sites: sockets that several sites claim."""
    return claims.groupBy("socket").agg(F.array_sort(F.collect_set("site")).alias("sites")).where(F.size("sites") > 1)


def earliest(needs: DataFrame) -> DataFrame:
    """recipe, tier: the earliest schematic that gives a recipe; null if any gives it for free."""
    return needs.groupBy("recipe").agg(F.when(~F.bool_or("free"), F.min("tier")).alias("tier"))
