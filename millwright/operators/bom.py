"""Bills of material: recursive explosion, closure, census and what-if variants.

From given targets, explosion is a loop over levels. Each level joins the frontier with the edges
and sums by (variant, target, item) before the next, so shared sub-assemblies are expanded once,
not once for each path. For all items at once it doubles instead: paths of up to k edges, followed
by those of exactly k, are paths of up to 2k, so the depth takes a logarithm of rounds. Every
round is a written table and the loop ends when one is empty. No chain is too deep; only one
longer than there are items is refused, as it must be a cycle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwright.operators.guards import Refusal
from millwright.session import staged

#: Depth at which items are counted, to tell a cycle from a deep chain.
FIRST_COUNT = 8


def _summed(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.sum("qty").alias("qty"), F.min("depth").alias("depth"))


def _no_cycle(edges: DataFrame, keys: list[str], depth: int, checked: int) -> int:
    """How deep paths may get, counted when they pass `checked`; refuses those that pass it."""
    if depth <= checked:
        return checked
    longest = edges.groupBy(*keys).agg(F.count_distinct("parent").alias("n")).agg(F.max("n")).first()[0]
    if depth > longest:
        raise Refusal("cycle in the bill of material", depth, [])
    return longest


def explode(edges: DataFrame, targets: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """keys, target, item, per_target, depth: how much of each item one unit of each target
    takes over all paths, and the shortest path's length.

    `edges` has keys, parent, child, qty (of child for one parent). `targets` (keys, target)
    limits the targets; by default every parent is one. Repeated edges add up; no edges give no
    rows; a cycle below a target is refused."""
    keys = keys or []
    by = [*keys, "target", "item"]
    edges = staged(edges.select(*keys, "parent", "child", "qty"), "bom-edges")
    own = edges.select(*keys, F.col("parent").alias("target"), F.col("child").alias("item"), F.col("qty").cast("double").alias("qty"), F.lit(1).alias("depth"))
    every = _doubled(own, edges, keys, by) if targets is None else _levelled(own, edges, targets, keys, by)
    return every.select(*by, F.col("qty").alias("per_target"), "depth")


def _doubled(own: DataFrame, edges: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """All paths, by paths of exactly 1, 2, 4, ... edges."""
    exact = upto = staged(_summed(own, by), "bom-paths")
    length, deepest = 1, FIRST_COUNT
    while not exact.isEmpty():
        deepest = _no_cycle(edges, keys, length, deepest)
        last = exact.select(*keys, F.col("target").alias("item"), F.col("item").alias("to"), F.col("qty").alias("each"))
        on = lambda rows: rows.join(last, [*keys, "item"]).select(*keys, "target", F.col("to").alias("item"), (F.col("qty") * F.col("each")).alias("qty"), (F.col("depth") + length).alias("depth"))  # noqa: B023, E731
        more = staged(_summed(upto.unionByName(on(upto)), by), "bom-paths", instead_of=None if upto is exact else upto)
        exact = staged(_summed(on(exact), by), "bom-exact", instead_of=exact)
        upto, length = more, 2 * length
    return upto


def _levelled(own: DataFrame, edges: DataFrame, targets: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Paths from the targets, level by level."""
    level = staged(_summed(own.join(targets.distinct(), [*keys, "target"]), by), "bom-level")
    below = edges.select(*keys, F.col("parent").alias("item"), "child", F.col("qty").alias("each"))
    levels, deepest = [], FIRST_COUNT
    while not level.isEmpty():
        levels.append(level)
        deepest = _no_cycle(edges, keys, len(levels), deepest)
        down = level.join(below, [*keys, "item"]).select(*keys, "target", F.col("child").alias("item"), (F.col("qty") * F.col("each")).alias("qty"), (F.col("depth") + 1).alias("depth"))
        level = staged(_summed(down, by), "bom-level")
    return _summed(reduce(DataFrame.unionByName, levels or [level]), by)


def taken(edges: DataFrame, wanted: DataFrame, plans: list[str]) -> DataFrame:
    """item and plans: how much of each item all of `wanted` (item, plans) takes over all paths in
    each plan, without what is wanted itself. `edges` has parent, child and what a plan takes of child
    for one parent under the plan's name (0: the plan has no such edge); a cycle below what is wanted
    is refused.

    Amounts go down level by level and are summed by item at each, so a level has no more rows than
    there are items, and no pair of a target and an item is made."""
    edges = staged(edges.select("parent", "child", *(F.col(p).cast("double").alias(f"each_{p}") for p in plans)), "bom-edges")
    level = wanted.select("item", *(F.col(p).cast("double").alias(p) for p in plans))
    levels, deepest = [], FIRST_COUNT
    while True:
        down = level.join(edges, F.col("item") == F.col("parent")).groupBy(F.col("child").alias("item")).agg(*(F.sum(F.col(p) * F.col(f"each_{p}")).alias(p) for p in plans))
        level = staged(down.where(reduce(Column.__or__, (F.col(p) != 0 for p in plans))), "bom-taken")
        if level.isEmpty():
            return reduce(DataFrame.unionByName, levels or [level]).groupBy("item").agg(*(F.sum(p).alias(p) for p in plans))
        levels.append(level)
        deepest = _no_cycle(edges, [], len(levels), deepest)


def closure(recipes: DataFrame, known: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, item, round: items that can be made from `known` (keys, item), where a recipe
    (keys, recipe, direction, item) runs once all its inputs are reachable. Round 0 is known. Goes
    on until a round adds nothing, which it must, as every other one adds an item."""
    keys = keys or []
    inputs = staged(recipes.where("direction = 'input'").select(*keys, "recipe", "item").distinct(), "closure-inputs")
    outputs = staged(recipes.where("direction = 'output'").select(*keys, "recipe", "item").distinct(), "closure-outputs")
    needs = outputs.select(*keys, "recipe").distinct().join(inputs.groupBy(*keys, "recipe").agg(F.count("*").alias("needs")), [*keys, "recipe"], "left").na.fill({"needs": 0})
    needs = staged(needs, "closure-needs")
    reached, step = staged(known.select(*keys, "item").distinct().withColumn("round", F.lit(0)), "closure"), 0
    while True:
        step += 1
        have = inputs.join(reached.select(*keys, "item"), [*keys, "item"]).groupBy(*keys, "recipe").agg(F.count("*").alias("have"))
        ready = needs.join(have, [*keys, "recipe"], "left").where(F.coalesce("have", F.lit(0)) == F.col("needs"))
        new = outputs.join(ready.select(*keys, "recipe"), [*keys, "recipe"]).select(*keys, "item").distinct().join(reached.select(*keys, "item"), [*keys, "item"], "left_anti")
        new = staged(new.withColumn("round", F.lit(step)), "closure")
        if new.isEmpty():
            return reached
        reached = staged(reached.unionByName(new), "closure")


def census(producers: DataFrame) -> DataFrame:
    """item, producers, primary, first: how many recipes make an item, how many as their first
    output, and the first recipe by id. `producers` has item, recipe, ord."""
    return producers.groupBy("item").agg(F.count_distinct("recipe").alias("producers"), F.count_distinct(F.when(F.col("ord") == 1, F.col("recipe"))).alias("primary"), F.min("recipe").alias("first"))


def routed(edges: DataFrame, alternates: DataFrame, exclude: DataFrame | None = None) -> DataFrame:
    """Edges with one producer for each parent: an alternate's edges replace its parent's; the
    parents in `exclude` lose theirs."""
    kept = edges.join(alternates.select("parent").distinct(), "parent", "left_anti").unionByName(alternates.select(*edges.columns))
    return kept if exclude is None else kept.join(exclude.select("parent"), "parent", "left_anti")


def compared(base: DataFrame, other: DataFrame, on: list[str], value: str, tolerance: float = 1e-9) -> DataFrame:
    """on, before, after, change, ratio: two sets of coefficients side by side."""
    a, b = base.select(*on, F.col(value).alias("before")), other.select(*on, F.col(value).alias("after"))
    both = a.join(b, on, "full")
    change = F.when(F.col("before").isNull(), "new").when(F.col("after").isNull(), "removed").when(F.abs(F.col("after") - F.col("before")) > tolerance, "changed").otherwise("same")
    return both.select(*on, "before", "after", change.alias("change"), F.when(F.col("before") != 0, F.col("after") / F.col("before")).alias("ratio"))


def swept(per: DataFrame, alternates: DataFrame, tolerance: float = 1e-6, zero: float = 1e-9) -> DataFrame:
    """variant, changed, new, removed, same: for each alternate (parent, child, qty) alone, how the
    coefficients `per` (target, item, per_target, as of `explode`) would move. A parent has one
    alternate."""
    per = staged(per.select("target", "item", "per_target"), "sweep-per")
    alts = staged(alternates.select("parent", "child", "qty"), "sweep-alternates")
    below = per.select(F.col("target").alias("of"), "item", "per_target")
    deeper = alts.join(below, F.col("child") == F.col("of")).select(F.col("parent").alias("variant"), "item", (F.col("qty") * F.col("per_target")).alias("q"))
    before = alts.select("parent").distinct().join(below, F.col("parent") == F.col("of")).select(F.col("parent").alias("variant"), "item", (-F.col("per_target")).alias("q"))
    move = alts.select(F.col("parent").alias("variant"), F.col("child").alias("item"), F.col("qty").alias("q")).unionByName(deeper).unionByName(before).groupBy("variant", "item").agg(F.sum("q").alias("move"))
    takes = per.select("target", F.col("item").alias("variant"), F.col("per_target").alias("takes")).unionByName(alts.select(F.col("parent").alias("target"), F.col("parent").alias("variant"), F.lit(1.0).alias("takes")).distinct())
    hit = move.join(takes, "variant").join(per, ["target", "item"], "left").withColumn("by", F.col("takes") * F.col("move"))
    hit = hit.where(F.col("per_target").isNotNull() | (F.col("by") > zero))
    kind = F.when(F.col("per_target").isNull(), "new").when(F.abs(F.col("per_target") + F.col("by")) <= zero, "removed").when(F.abs("by") > tolerance, "changed").otherwise("same")
    n = lambda *k: F.count_if(F.col("kind").isin(*k))
    whole = per.count()
    return hit.withColumn("kind", kind).groupBy("variant").agg(n("changed").alias("changed"), n("new").alias("new"), n("removed").alias("removed"), (F.lit(whole) - n("changed", "removed")).alias("same"))
