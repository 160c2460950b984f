"""Demand queries: explosion, phases, scenarios, alternates, reachability."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millwright.functions.scalars import scaled_input
from millwright.operators import bom, windows
from millwright.plans import domain as d
from millwright.plans.domain import sql

BOM = """expansion AS (
  SELECT parent AS target, child AS item, qty, 1 AS depth FROM edge
  UNION ALL SELECT x.target, e.child, x.qty * e.qty, x.depth + 1 FROM expansion x JOIN edge e ON e.parent = x.item),
"""
SCENARIOS = [("half", 0.5), ("base", 1.0), ("more", 1.25), ("double", 2.0)]


def bom_direct_edges(spark: SparkSession, sf: str) -> DataFrame:
    return d.edges(spark, sf).select("parent", "child", F.round("qty", 6).alias("qty"))


def bom_explosion(spark: SparkSession, sf: str) -> DataFrame:
    return bom.explode(d.edges(spark, sf)).select("target", "item", F.round("per_target", 6).alias("per_target"), "depth")


def scenario_io(spark: SparkSession, sf: str) -> DataFrame:
    """Recipe inputs under every scenario: amounts rounded by form, per one output."""
    rows = spark.createDataFrame(SCENARIOS, "scenario string, factor double")
    io = d.recipe_io(spark, sf).join(F.broadcast(rows))  # four rows
    unit = F.when(F.col("child") % 5 == 0, "m3").otherwise("items")
    return io.select("scenario", "parent", "child", "ord", F.col("amount").cast("double").alias("amount"), scaled_input(F.col("amount") * 0.7, F.col("factor"), unit).alias("scaled"), "made")


def recipe_scaled_rounding(spark: SparkSession, sf: str) -> DataFrame:
    return scenario_io(spark, sf).select("scenario", "parent", "child", "ord", F.round("scaled", 3).alias("scaled"))


def bom_scenario_scaled(spark: SparkSession, sf: str) -> DataFrame:
    """Explosion of all items under every scenario in one run, level by level: amounts are multiplied
    from the target down as in the SQL, so the many ties of the rounding, which is done on doubles as there,
    fall alike where there is one path."""
    edges = scenario_io(spark, sf).select("scenario", "parent", "child", (F.col("scaled") / F.col("made")).alias("qty"))
    every = edges.select("scenario", F.col("parent").alias("target"))
    return bom.explode(edges, every, keys=["scenario"]).select("scenario", "target", "item", (F.round(F.col("per_target") * 10000) / 10000).alias("per_target"), "depth")


def route_pins_override(spark: SparkSession, sf: str) -> DataFrame:
    """One producer for each item after alternates replace and exclusions remove recipes."""
    gone = d.items(spark, sf).where("item % 11 = 0").select(F.col("item").alias("parent"))
    return bom.routed(d.edges(spark, sf), d.alternates(spark, sf), gone).select("parent", "child", F.round("qty", 6).alias("qty"))


def route_census(spark: SparkSession, sf: str) -> DataFrame:
    """How many recipes make each item, alternates included."""
    base = d.recipe_io(spark, sf).select(F.col("parent").alias("item"), F.col("parent").alias("recipe"), F.lit(1).alias("ord")).distinct()
    alt = d.alternates(spark, sf).select(F.col("parent").alias("item"), (F.col("parent") + 1000000).alias("recipe"), F.lit(1).alias("ord"))
    side = d.alternates(spark, sf).select(F.col("child").alias("item"), (F.col("parent") + 1000000).alias("recipe"), F.lit(2).alias("ord"))
    return bom.census(base.unionByName(alt).unionByName(side))


def coproduct_leaves(spark: SparkSession, sf: str) -> DataFrame:
    """Items that recipes only make beside their first output."""
    side = d.alternates(spark, sf).select(F.col("child").alias("item")).distinct()
    return side.join(d.recipe_io(spark, sf).select(F.col("parent").alias("item")).distinct(), "item", "left_anti")


def demand(spark: SparkSession, sf: str) -> DataFrame:
    """phase, item, qty: deliveries and all that they take."""
    due = d.deliveries(spark, sf)
    per = bom.explode(d.edges(spark, sf))
    below = due.join(per.withColumnRenamed("item", "part"), due["item"] == per["target"]).select("phase", F.col("part").alias("item"), (F.col("qty") * F.col("per_target")).alias("qty"))
    return due.select("phase", "item", "qty").unionByName(below).groupBy("phase", "item").agg(F.sum("qty").alias("qty"))


def phase_demand(spark: SparkSession, sf: str) -> DataFrame:
    return demand(spark, sf).select("phase", "item", F.round("qty", 4).alias("qty"))


def phase_growth(spark: SparkSession, sf: str) -> DataFrame:
    rows = windows.phased(windows.densified(d.deliveries(spark, sf), "item", "phase", "qty"), "item", "phase", "qty")
    return rows.select("item", "phase", "qty", "previous", "kind", F.round("growth", 6).alias("growth"))


def phase_cumulative_remaining(spark: SparkSession, sf: str) -> DataFrame:
    rows = windows.phased(windows.densified(d.deliveries(spark, sf), "item", "phase", "qty"), "item", "phase", "qty")
    return rows.select("item", "phase", "running", "remaining")


def first_last_phase(spark: SparkSession, sf: str) -> DataFrame:
    has = F.when(F.col("qty") > 0, F.col("phase"))
    return demand(spark, sf).groupBy("item").agg(F.min(has).alias("first_phase"), F.max(has).alias("last_phase"))


def alt_sensitivity(spark: SparkSession, sf: str) -> DataFrame:
    """All coefficients with all alternates against those without."""
    base = bom.explode(d.edges(spark, sf))
    other = bom.explode(bom.routed(d.edges(spark, sf), d.alternates(spark, sf)))
    rows = bom.compared(base, other, ["target", "item"], "per_target", 1e-6)
    return rows.select("target", "item", "change", F.round("before", 6).alias("before"), F.round("after", 6).alias("after"), F.round("ratio", 6).alias("ratio"))


def alt_sweep_summary(spark: SparkSession, sf: str) -> DataFrame:
    """For each alternate on its own: coefficients changed, new, removed and same over all items.

    One recipe's change moves a coefficient by what the target takes of its product times the
    difference of the two recipes' own coefficients, so no variant is expanded again."""
    alts = d.alternates(spark, sf)
    return bom.swept(bom.explode(d.edges(spark, sf)), alts)


#: What-if plans: the alternates are dealt to so many by number.
PLANS = 8


def variant_regret_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Eight plans, each with an eighth of all alternates: for every two how much more raw
    resource one takes for all deliveries than the other. Deliveries go down each plan's bill as
    sums by item, which needs no explosion of all items."""
    plans = [f"v{k}" for k in range(PLANS)]
    at = lambda x: [F.when(x(k), F.col("qty")).otherwise(0.0).alias(p) for k, p in enumerate(plans)]
    alts = d.alternates(spark, sf).withColumn("variant", F.expr(f"parent div 7 % {PLANS}"))
    own = d.edges(spark, sf).join(alts.select("parent", "variant").distinct(), "parent", "left")
    kept = own.select("parent", "child", *at(lambda k: ~F.col("variant").eqNullSafe(F.lit(k)))).unionByName(alts.select("parent", "child", *at(lambda k: F.col("variant") == k)))
    due = d.deliveries(spark, sf).groupBy("item").agg(F.sum("qty").alias("qty")).select("item", *at(lambda _: F.lit(True)))
    raw = bom.taken(kept, due, plans).where(F.col("item") < d.RAW).agg(*(F.sum(p).alias(p) for p in plans))
    raw = raw.select(F.explode(F.array(*(F.struct(F.lit(k).cast("long").alias("variant"), F.col(p).alias("raw")) for k, p in enumerate(plans)))).alias("e")).select("e.*")
    a, b = raw.select(F.col("variant").alias("a"), F.col("raw").alias("ra")), raw.select(F.col("variant").alias("b"), F.col("raw").alias("rb"))
    return a.join(F.broadcast(b), F.col("a") < F.col("b")).select("a", "b", F.round(F.col("ra") / F.col("rb"), 6).alias("ratio"), (F.col("ra") > F.col("rb")).alias("regret"))


def _recipes(spark: SparkSession, sf: str) -> DataFrame:
    io = d.recipe_io(spark, sf)
    return io.select(F.col("parent").alias("recipe"), F.lit("input").alias("direction"), F.col("child").alias("item")).unionByName(io.select(F.col("parent").alias("recipe"), F.lit("output").alias("direction"), F.col("parent").alias("item")).distinct())


def reachability_closure(spark: SparkSession, sf: str) -> DataFrame:
    """What can be made with every third raw resource missing."""
    known = d.items(spark, sf).where("raw AND item % 3 <> 0").select("item")
    return bom.closure(_recipes(spark, sf), known)


def unlock_hints_whatif(spark: SparkSession, sf: str) -> DataFrame:
    """For each missing raw resource, how many more items it would open."""
    recipes = _recipes(spark, sf)
    raws = d.items(spark, sf).where("raw").select("item")
    missing = raws.where("item % 3 = 0").select(F.col("item").alias("added"))
    base = bom.closure(recipes, raws.where("item % 3 <> 0")).count()
    every = recipes.join(F.broadcast(missing))
    known = raws.where("item % 3 <> 0").join(F.broadcast(missing)).select("added", "item").unionByName(missing.select("added", F.col("added").alias("item")))
    return bom.closure(every, known, ["added"]).groupBy("added").agg((F.count("*") - base).alias("opens"))


QUERIES = {f.__name__: f for f in (bom_direct_edges, bom_explosion, recipe_scaled_rounding, bom_scenario_scaled, route_pins_override, route_census, coproduct_leaves, phase_demand, phase_growth, phase_cumulative_remaining, first_last_phase, alt_sensitivity, alt_sweep_summary, variant_regret_matrix, reachability_closure, unlock_hints_whatif)}

_PER = BOM + """per AS (SELECT target, item, sum(qty) AS per_target FROM expansion GROUP BY 1, 2)"""
_DEMAND = _PER + """, needs AS (SELECT phase, item, qty FROM delivery UNION ALL SELECT phase, p.item, d.qty * per_target FROM delivery d JOIN per p ON d.item = p.target),
due AS (SELECT phase, item, sum(qty) AS qty FROM needs GROUP BY 1, 2)
"""
_DENSE = """dense AS (SELECT i.item, p.phase, coalesce(d.qty, 0) AS qty FROM (SELECT DISTINCT item FROM delivery) i CROSS JOIN (SELECT DISTINCT phase FROM delivery) p LEFT JOIN delivery d ON d.item = i.item AND d.phase = p.phase)
"""
_SCALED = """scenario(scenario, factor) AS (VALUES ('half', 0.5), ('base', 1.0), ('more', 1.25), ('double', 2.0)),
exact AS (SELECT scenario, parent, child, ord, made, factor, (amount * 0.7)::DECIMAL(18,6) * factor::DECIMAL(9,4) AS x, (amount * 0.7) AS raw, child % 5 = 0 AS fluid FROM recipe_io, scenario),
scaled AS (SELECT scenario, parent, child, ord, made, CASE WHEN fluid THEN round(x, 3) WHEN factor < 1 AND raw >= 1 THEN greatest(round(x, 0), 1) ELSE round(x, 0) END::DOUBLE AS scaled FROM exact)
"""
SQL = {
    "bom_direct_edges": sql("recipe_io edge", "SELECT parent, child, round(qty, 6) AS qty FROM edge"),
    "bom_explosion": sql("recipe_io edge", BOM.rstrip().rstrip(",") + " SELECT target, item, round(sum(qty), 6) AS per_target, min(depth) AS depth FROM expansion GROUP BY 1, 2", True),
    "recipe_scaled_rounding": sql("recipe_io", _SCALED + "SELECT scenario, parent, child, ord, round(scaled, 3) AS scaled FROM scaled"),
    "bom_scenario_scaled": sql("recipe_io", _SCALED.rstrip() + """,
expansion AS (SELECT scenario, parent AS target, child AS item, scaled / made AS qty, 1 AS depth FROM scaled
  UNION ALL SELECT x.scenario, x.target, e.child, x.qty * (e.scaled / e.made), x.depth + 1 FROM expansion x JOIN scaled e ON e.parent = x.item AND e.scenario = x.scenario)
SELECT scenario, target, item, round(sum(qty), 4) AS per_target, min(depth) AS depth FROM expansion GROUP BY 1, 2, 3""", True),
    "route_pins_override": sql("recipe_io edge alternate", "SELECT parent, child, round(qty, 6) AS qty FROM (SELECT * FROM edge WHERE parent NOT IN (SELECT parent FROM alternate) UNION ALL SELECT * FROM alternate) WHERE parent % 11 <> 0"),
    "route_census": sql("recipe_io alternate", """r AS (SELECT DISTINCT parent AS item, parent AS recipe, 1 AS ord FROM recipe_io UNION ALL SELECT parent, parent + 1000000, 1 FROM alternate UNION ALL SELECT child, parent + 1000000, 2 FROM alternate)
SELECT item, count(DISTINCT recipe) AS producers, count(DISTINCT recipe) FILTER (ord = 1) AS "primary", min(recipe) AS first FROM r GROUP BY 1"""),
    "coproduct_leaves": sql("recipe_io alternate", "SELECT DISTINCT child AS item FROM alternate WHERE child NOT IN (SELECT parent FROM recipe_io)"),
    "phase_demand": sql("recipe_io edge delivery", _DEMAND + "SELECT phase, item, round(qty, 4) AS qty FROM due", True),
    "phase_growth": sql("delivery", _DENSE.rstrip() + ", w AS (SELECT item, phase, qty, lag(qty) OVER (PARTITION BY item ORDER BY phase) AS previous FROM dense) SELECT item, phase, qty, previous, CASE WHEN qty > 0 AND coalesce(previous, 0) = 0 THEN 'new' WHEN previous > 0 THEN 'ratio' ELSE 'none' END AS kind, CASE WHEN NOT (qty > 0 AND coalesce(previous, 0) = 0) AND previous > 0 THEN round(qty / previous, 6) END AS growth FROM w"),
    "phase_cumulative_remaining": sql("delivery", _DENSE + "SELECT item, phase, sum(qty) OVER (PARTITION BY item ORDER BY phase) AS running, sum(qty) OVER (PARTITION BY item) - sum(qty) OVER (PARTITION BY item ORDER BY phase) AS remaining FROM dense"),
    "first_last_phase": sql("recipe_io edge delivery", _DEMAND + "SELECT item, min(phase) FILTER (qty > 0) AS first_phase, max(phase) FILTER (qty > 0) AS last_phase FROM due GROUP BY 1", True),
    "alt_sensitivity": sql("recipe_io edge alternate", """route AS (SELECT *, 'before' AS v FROM edge UNION ALL SELECT *, 'after' FROM edge WHERE parent NOT IN (SELECT parent FROM alternate) UNION ALL SELECT *, 'after' FROM alternate),
expansion AS (SELECT v, parent AS target, child AS item, qty FROM route UNION ALL SELECT x.v, x.target, e.child, x.qty * e.qty FROM expansion x JOIN route e ON e.parent = x.item AND e.v = x.v),
per AS (SELECT target, item, sum(qty) FILTER (v = 'before') AS b, sum(qty) FILTER (v = 'after') AS a FROM expansion GROUP BY 1, 2)
SELECT target, item, CASE WHEN b IS NULL THEN 'new' WHEN a IS NULL THEN 'removed' WHEN abs(a - b) > 1e-6 THEN 'changed' ELSE 'same' END AS change, round(b, 6) AS before, round(a, 6) AS after, CASE WHEN b <> 0 THEN round(a / b, 6) END AS ratio FROM per""", True),
    "alt_sweep_summary": sql("recipe_io edge alternate", _PER + """,
own AS (SELECT a.parent AS v, a.child AS item, a.qty AS q FROM alternate a UNION ALL SELECT a.parent, p.item, a.qty * p.per_target FROM alternate a JOIN per p ON p.target = a.child UNION ALL SELECT a.parent, p.item, -p.per_target FROM (SELECT DISTINCT parent FROM alternate) a JOIN per p ON p.target = a.parent),
move AS (SELECT v, item, sum(q) AS q FROM own GROUP BY 1, 2),
takes AS (SELECT target, item AS v, per_target AS q FROM per UNION ALL SELECT DISTINCT parent, parent, 1.0 FROM alternate),
hit AS (SELECT m.v, CASE WHEN p.per_target IS NULL THEN 'new' WHEN abs(p.per_target + t.q * m.q) <= 1e-9 THEN 'removed' WHEN abs(t.q * m.q) > 1e-6 THEN 'changed' ELSE 'same' END AS kind FROM move m JOIN takes t ON t.v = m.v LEFT JOIN per p ON p.target = t.target AND p.item = m.item WHERE p.per_target IS NOT NULL OR t.q * m.q > 1e-9)
SELECT v AS variant, count(*) FILTER (kind = 'changed') AS changed, count(*) FILTER (kind = 'new') AS new, count(*) FILTER (kind = 'removed') AS removed, (SELECT count(*) FROM per) - count(*) FILTER (kind IN ('changed', 'removed')) AS same FROM hit GROUP BY 1""", True),
    "variant_regret_matrix": sql("recipe_io edge alternate delivery", """plan AS (SELECT unnest(range(8)) AS v), route AS (SELECT v, e.parent, e.child, e.qty FROM edge e, plan WHERE NOT EXISTS (SELECT 1 FROM alternate a WHERE a.parent = e.parent AND a.parent // 7 % 8 = v) UNION ALL SELECT parent // 7 % 8, parent, child, qty FROM alternate),
expansion AS (SELECT v, parent AS target, child AS item, qty FROM route UNION ALL SELECT x.v, x.target, e.child, x.qty * e.qty FROM expansion x JOIN route e ON e.parent = x.item AND e.v = x.v),
raw AS (SELECT v, sum(x.qty * d.qty) AS r FROM expansion x JOIN (SELECT item, sum(qty) AS qty FROM delivery GROUP BY 1) d ON d.item = x.target WHERE x.item < 25 GROUP BY 1)
SELECT x.v AS a, y.v AS b, round(x.r / y.r, 6) AS ratio, x.r > y.r AS regret FROM raw x JOIN raw y ON x.v < y.v""", True),
    "reachability_closure": sql("recipe_io item", """down AS (SELECT DISTINCT parent AS target, child AS item, 1 AS depth FROM recipe_io UNION SELECT d.target, r.child, d.depth + 1 FROM down d JOIN recipe_io r ON r.parent = d.item),
made AS (SELECT target AS item, max(depth) AS round FROM down GROUP BY 1 HAVING count(*) FILTER (item < 25 AND item % 3 = 0) = 0) SELECT item, round::INT AS round FROM made UNION ALL SELECT item, 0 FROM item WHERE raw AND item % 3 <> 0""", True),
    "unlock_hints_whatif": sql("recipe_io item", """down AS (SELECT DISTINCT parent AS target, child AS item FROM recipe_io UNION SELECT d.target, r.child FROM down d JOIN recipe_io r ON r.parent = d.item),
lack AS (SELECT target, min(item) AS one FROM down WHERE item < 25 AND item % 3 = 0 GROUP BY 1 HAVING count(*) = 1)
SELECT i.item AS added, 1 + count(target) AS opens FROM item i LEFT JOIN lack ON one = i.item WHERE raw AND i.item % 3 = 0 GROUP BY 1""", True),
}
