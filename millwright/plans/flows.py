"""Flow queries: generators, extraction, buses, dispositions, what-ifs, goals and bills."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millwright.functions.scalars import clock_power, whole
from millwright.operators import bom, flows, guards, planning
from millwright.plans import domain as d
from millwright.plans.domain import sql
from millwright.plans.supply import _caps, _lines, packing_recipes
from millwright.session import table


def _classes(spark: SparkSession) -> DataFrame:
    return spark.range(7).select(F.concat(F.lit("Gen_"), F.col("id").cast("string")).alias("class"), (30.0 + F.col("id") * 20).alias("mw"), (F.col("id") + 1.0).alias("burn"))


def _standing(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("site"), F.concat(F.lit("Gen_"), (F.col("s_suppkey") % 7).cast("string")).alias("class")).agg(F.count("*").alias("units"))


def standing_generation(spark: SparkSession, sf: str) -> DataFrame:
    """Power and fuel of each site's standing generators."""
    return flows.generation(_standing(spark, sf), guards.require_unique(_classes(spark), ["class"]), ["site"])


def flows_with_generators(spark: SparkSession, sf: str) -> DataFrame:
    """Items drawn by recipes and, as fuel, by generators, in one set of flows."""
    need = d.edges(spark, sf).groupBy(F.col("child").alias("item")).agg(F.sum("qty").alias("qty"))
    fuel = _standing(spark, sf).join(_classes(spark), "class").select((F.substring_index("class", "_", -1).cast("long") + 10).alias("item"), (F.col("units") * F.col("burn")).alias("qty"))
    return flows.folded_in(need, fuel, ["item"], "qty").select("item", F.round("qty", 6).alias("qty"))


def _segments(spark: SparkSession, sf: str) -> DataFrame:
    rate = F.when(F.col("purity") == 0, 30.0).when(F.col("purity") == 1, 60.0).otherwise(120.0)
    return d.sockets(spark, sf).groupBy(F.col("item").cast("long").alias("item"), "purity").agg(F.sum(rate).alias("cap"), clock_power(F.lit(15.0), F.lit(100.0), F.lit(1.321929), F.count("*")).alias("mw"))


def extraction_at_share(spark: SparkSession, sf: str) -> DataFrame:
    """Power of the extractors at the share of each raw that recipes draw."""
    draws = d.edges(spark, sf).where(F.col("child") < d.RAW).groupBy(F.col("child").alias("item")).agg((F.sum("qty") * 40).alias("draw"))
    return flows.extraction_power(_segments(spark, sf), draws).select("item", F.round("cap", 4).alias("cap"), F.round("share", 6).alias("share"), F.round("mw", 4).alias("mw"))


def segment_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Whether each raw's segments sum to its cap; water is pumped without one."""
    caps = _segments(spark, sf).groupBy("item").agg(F.sum("cap").alias("cap")).withColumn("cap", F.when(F.col("item") == 3, F.lit(None).cast("double")).when(F.col("item") == 5, F.col("cap") + 1).otherwise(F.col("cap")))
    return flows.sums_to_cap(_segments(spark, sf), caps)


def site_extraction(spark: SparkSession, sf: str) -> DataFrame:
    """Each site's caps: its sockets, what is supplied to it, and water without a limit."""
    at = _segments(spark, sf).select((F.col("item") % 4).alias("site"), "item", "cap")
    supply = table(spark, sf, "supplier").select((F.col("s_nationkey") % 4).cast("long").alias("site"), (F.col("s_suppkey") % 25).alias("item"), (5.0 + F.col("s_suppkey") % 3).alias("cap"))
    water = spark.range(4).select(F.col("id").alias("site"), F.lit(3).cast("long").alias("item"), F.lit(None).cast("double").alias("cap"))
    rows = at.unionByName(supply).unionByName(water)
    return planning.pooled(rows, ["site", "item"]).select("site", "item", F.round("cap", 4).alias("cap"))


def lane_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Lines by supplier nation and item form: lanes, flow of the lanes, what stands at the close and
    what is still to build."""
    li = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey", "l_quantity", "l_linestatus")
    rows = li.join(table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("bus")), F.col("l_suppkey") == F.col("s_suppkey")).join(d.items(spark, sf), F.col("l_partkey") == F.col("item"))
    out = rows.groupBy("bus", "form").agg(F.count("*").alias("lanes"), F.sum("l_quantity").cast("long").alias("flow"), F.count_if(F.col("l_linestatus") == "F").alias("standing"))
    return out.withColumn("to_build", F.col("lanes") - F.col("standing"))


def out_of_scope_draw(spark: SparkSession, sf: str) -> DataFrame:
    """What recipes draw of items that no bus declares: the solids are declared."""
    draws = d.edges(spark, sf).select(F.col("child").alias("item"), F.col("qty").alias("draw"))
    return flows.out_of_scope(draws, d.items(spark, sf).where("form = 'solid'").select("item")).select("item", F.round("draw", 6).alias("draw"), "users")


def merged_buses(spark: SparkSession, sf: str) -> DataFrame:
    """Ordered lines as one bus an item, with who takes from it."""
    lines = table(spark, sf, "lineitem").where("l_returnflag = 'N'").select(F.col("l_partkey").alias("item"), F.col("l_quantity").alias("rate"))
    return flows.merged(lines, d.edges(spark, sf))


def binding_sides(spark: SparkSession, sf: str) -> DataFrame:
    """The side of each recipe that fills a trunk first and how many machines one carries."""
    io = d.recipe_io(spark, sf).groupBy(F.col("parent").alias("item")).agg(F.max("amount").alias("takes"), F.max("made").alias("made"))
    cycles = 60.0 / (2 + F.col("item") % 10)
    side, fit = flows.binding_rate(F.col("made") * cycles, F.col("takes") * cycles, F.lit(270.0))
    return io.select("item", side.alias("side"), fit.cast("long").alias("machines"))


def _sized(spark: SparkSession, sf: str) -> DataFrame:
    """item, demand, supply, machines, exact, peak, kind and draws of each bus."""
    exact = F.col("demand") / F.col("per_machine")
    rows = _lines(spark, sf).withColumn("exact", exact).withColumn("machines", whole(exact)).withColumn("supply", F.col("machines") * F.col("per_machine"))
    rows = rows.withColumn("owner", F.when(F.col("item") % 13 == 0, "none").otherwise("site")).withColumn("stores", F.col("item") % 3 == 0).withColumn("withdrawal", F.when(F.col("item") % 4 == 0, 5.0).otherwise(0.0)).withColumn("storage", F.when(F.col("item") % 5 == 0, 7.0).otherwise(0.0))
    rows = rows.withColumn("kind", flows.disposition(F.col("owner"), F.col("stores"), F.col("withdrawal"), F.col("storage")))
    return rows.select("*", *(c.alias(k) for k, c in flows.drawn(F.col("kind"), F.col("demand"), F.col("withdrawal"), F.col("storage")).items()))


def bus_dispositions(spark: SparkSession, sf: str) -> DataFrame:
    """What becomes of each bus's output, its draw and peak, and whether that is stable."""
    return _sized(spark, sf).select("item", "kind", F.round("draw", 4).alias("draw"), F.round("peak", 4).alias("peak"), "use", flows.is_stable(F.col("kind")).alias("stable"))


def bus_feasibility(spark: SparkSession, sf: str) -> DataFrame:
    """Shortfall, utilisation and the price of whole machines of each bus, and its warnings."""
    made = flows.bus_flags(F.col("draw"), F.col("supply"), F.col("peak"), F.col("stores"), F.col("machines"), F.col("exact"))
    rows = _sized(spark, sf).select("item", *(c.alias(k) for k, c in made.items()))
    warning = flows.feasibility({"deficit": F.col("in_deficit"), "peak": F.col("shortfall") > 0, "stores nothing": F.col("stores_nothing")})
    return rows.select("item", *(F.round(k, 7).alias(k) for k in ("shortfall", "utilisation", "tax", "backing_mw")), warning.alias("warnings"))


def objective_terms(spark: SparkSession, sf: str) -> DataFrame:
    """A plan's weighted objective by form: machines, power and raw draw."""
    rows = _sized(spark, sf).join(d.items(spark, sf), "item")
    return rows.groupBy("form").agg(F.round(F.sum(2 * F.col("machines") + 0.5 * F.col("machines") * 4 + F.when(F.col("raw"), F.col("demand")).otherwise(0.0)), 3).alias("objective"), F.sum("machines").alias("machines"))


def plan_warnings(spark: SparkSession, sf: str) -> DataFrame:
    """Plans by site with named warnings: nothing made, an idle unit, raws at their cap."""
    rows = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("site")).agg(F.count("*").alias("units"), F.min("s_acctbal").alias("least"), F.sum("s_acctbal").alias("total"))
    return rows.select("site", flows.feasibility({"few units": F.col("units") < 4, "in debt": F.col("least") < 0, "rich": F.col("total") > 20000}).alias("warnings"))


def replaced_recipe(spark: SparkSession, sf: str) -> DataFrame:
    """What the deliveries take of each raw when the most used part is made of one raw instead."""
    edges = d.edges(spark, sf)
    most = d.deliveries(spark, sf).where(F.col("item") >= d.RAW).groupBy("item").agg(F.sum("qty").alias("qty")).agg(F.max(F.struct("qty", (-F.col("item")).alias("no"))).alias("m")).select((-F.col("m.no")).alias("item")).first()[0]
    other = spark.createDataFrame([(7, 4.0)], "child long, qty double")
    due = d.deliveries(spark, sf).groupBy("item").agg(F.sum("qty").alias("due"))
    total = lambda e, name: bom.explode(e).where(F.col("item") < d.RAW).join(due.withColumnRenamed("item", "target"), "target").groupBy("item").agg(F.sum(F.col("per_target") * F.col("due")).alias(name))
    return total(edges, "before").join(total(flows.replaced(edges, most, other), "after"), "item", "full").select("item", *(F.round(k, 2).alias(k) for k in ("before", "after")))


def scaled_external(spark: SparkSession, sf: str) -> DataFrame:
    """Whole machines for all deliveries at several scales, and the price of whole ones."""
    factors = spark.createDataFrame([(0.5,), (1.0,), (2.5,)], "factor double")
    rows = _lines(spark, sf).join(F.broadcast(factors))  # three rows
    exact = F.col("demand") * F.col("factor") / F.col("per_machine")
    return rows.groupBy("factor").agg(F.sum(whole(exact)).alias("machines"), F.round(F.sum(whole(exact)) - F.sum(exact), 4).alias("tax"))


def flattened_tree(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as a tree by half their number, every node with its depth and path."""
    tree = table(spark, sf, "part").select(F.col("p_partkey").alias("node"), F.when(F.col("p_partkey") >= d.RAW, F.expr("p_partkey div 2")).alias("parent"))
    return flows.flattened(tree).select("node", "depth", F.concat_ws("/", F.transform("path", lambda x: x.cast("string"))).alias("path"))


def packaged_fuels(spark: SparkSession, sf: str) -> DataFrame:
    """The one recipe that packs each liquid, whether it can be unpacked, and whether its sink is
    unlocked."""
    rows = packing_recipes(spark, sf).where("kind = 'pack' AND direction = 'input'").select("item", "recipe")
    guards.require_unique(rows, ["item"], "several packers")
    back = packing_recipes(spark, sf).where("kind = 'unpack' AND direction = 'output'").select("item", F.lit(True).alias("back"))
    tiers = d.schematics(spark, sf).select(F.col("recipe").alias("item"), "tier")
    return rows.join(back, "item", "left").join(tiers, "item").select("item", "recipe", F.coalesce("back", F.lit(False)).alias("unpacks"), (F.col("tier") <= 4).alias("sink"))


def biofuel_chains(spark: SparkSession, sf: str) -> DataFrame:
    """Deliveries of gases turned into fuel in three steps, by the last product."""
    start = d.deliveries(spark, sf).where("phase = 2").join(d.items(spark, sf).where("form = 'gas' AND NOT raw"), "item").select("item", F.col("qty").alias("amount"))
    step = d.edges(spark, sf).groupBy(F.col("parent").alias("item")).agg(F.min(F.struct("child", "qty")).alias("m")).select("item", F.col("m.child").alias("made"), F.col("m.qty").alias("ratio"))
    return flows.chained(start, [step, step, step]).groupBy("made").agg(F.round(F.sum("amount"), 4).alias("amount"), F.count("*").alias("chains"))


def new_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    """Buildings to start the recipes that a tier adds, with those that extraction needs, as one
    bill."""
    s = d.schematics(spark, sf)
    producers = table(spark, sf, "part").select(F.col("p_partkey").alias("recipe"), F.col("p_brand").alias("building"))
    first = flows.bootstrap(s.where("tier <= 5").select("recipe"), s.where("tier <= 4").select("recipe"), producers)
    extra = d.sockets(spark, sf).groupBy(F.concat(F.lit("Brand#"), (F.col("item") + 1).cast("string")).alias("building")).agg(F.count("*").alias("n"))
    return flows.folded_in(first, extra, ["building"], "n")


def projected_goals(spark: SparkSession, sf: str) -> DataFrame:
    """Minutes to each goal at the rates that returned lines leave; some are never reached."""
    goals = d.deliveries(spark, sf).where("phase = 5").select("item", F.col("qty").alias("total"))
    rates = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("item"), (F.col("l_quantity") / 10).alias("rate"))
    return flows.projected(goals, rates).select("item", "total", F.round("rate", 4).alias("rate"), F.when(F.col("minutes") < float("inf"), F.round("minutes", 4)).alias("minutes"))


def cap_binding(spark: SparkSession, sf: str) -> DataFrame:
    """Raws' caps against draws: use and what binds."""
    caps = d.items(spark, sf).where("raw").select("item").join(_caps(spark, sf).groupBy("item").agg(F.sum("cap").alias("cap")), "item", "left").withColumn("cap", F.when(F.col("item") % 6 != 5, F.coalesce("cap", F.lit(0.0))))
    draws = d.edges(spark, sf).where(F.col("child") < d.RAW).groupBy(F.col("child").alias("item")).agg((F.sum("qty") * 50).alias("draw"))
    return flows.cap_use(caps, draws).select("item", F.round("cap", 4).alias("cap"), F.round("draw", 4).alias("draw"), F.round("use", 6).alias("use"), "binding")


def carried_power(spark: SparkSession, sf: str) -> DataFrame:
    """Power by scenario and phase: built anew, standing from before, and spare."""
    scenarios = spark.createDataFrame([("base", 1.0), ("hard", 1.5)], "scenario string, factor double")
    need = d.deliveries(spark, sf).groupBy("phase").agg((F.sum("qty") / 100).alias("mw")).join(F.broadcast(scenarios)).withColumn("mw", F.col("mw") * F.when(F.col("phase") % 2 == 0, F.col("factor")).otherwise(1.0))
    return flows.carried(need, ["scenario"], "phase", "mw").select("scenario", "phase", *(F.round(k, 4).alias(k) for k in ("mw", "standing", "new", "spare")))


def carry_estimate(spark: SparkSession, sf: str) -> DataFrame:
    """What a phase's rates make in the gap before the next one, against what that one owes."""
    due = d.deliveries(spark, sf)
    prior = due.select((F.col("phase") + 1).alias("phase"), "item", (F.col("qty") / 600).alias("rate"))
    rows = due.join(prior, ["phase", "item"]).withColumn("carry", F.col("rate") * 45)
    return rows.select("phase", "item", F.round("carry", 6).alias("carry"), F.round(F.greatest(F.lit(0.0), F.col("qty") - F.col("carry")), 6).alias("left"))


def energy_split(spark: SparkSession, sf: str) -> DataFrame:
    """Megawatt-minutes of each phase's bill: making, ore and oil, water."""
    per = bom.explode(d.edges(spark, sf)).select(F.col("target").alias("of"), F.col("item").alias("below"), "per_target")
    due = d.deliveries(spark, sf)
    flow = due.join(per, F.col("item") == F.col("of")).select("phase", F.col("below").alias("item"), (F.col("qty") * F.col("per_target")).alias("qty")).unionByName(due.select("phase", "item", "qty"))
    kind = F.when(F.col("item") == 3, "water").when(F.col("item") < d.RAW, "ore").otherwise("making")
    mw = F.when(kind == "making", F.col("qty") * (4 + F.col("item") % 9)).otherwise(F.col("qty") * 0.5)
    rows = flow.select("phase", kind.alias("kind"), mw.alias("mw"))
    return rows.groupBy("phase").agg(*(F.round(F.sum(F.when(F.col("kind") == k, F.col("mw")).otherwise(0.0)), 2).alias(k) for k in ("making", "ore", "water")))


def phase_work(spark: SparkSession, sf: str) -> DataFrame:
    """Work of each phase under two multipliers against the base, and the raws' pressure."""
    scenarios = spark.createDataFrame([("cheap", 0.5), ("dear", 2.0)], "scenario string, factor double")
    due = d.deliveries(spark, sf).groupBy("phase").agg(F.sum("qty").alias("qty"), F.sum(F.pow(F.col("qty") / 100, 2)).alias("pressure"))
    rows = due.join(F.broadcast(scenarios))  # two rows
    return rows.select("scenario", "phase", F.round(F.col("qty") * F.pow("factor", F.col("phase") / 5), 4).alias("work"), F.round("pressure", 4).alias("pressure"))


def phase_bills(spark: SparkSession, sf: str) -> DataFrame:
    """Bills of each phase by where they come from: deliveries, milestones, research."""
    due = d.deliveries(spark, sf).select("phase", F.lit("delivery").alias("kind"), "item", "qty")
    cost = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_suppkey").alias("item"), F.col("l_quantity").alias("qty"))
    rows = cost.join(d.schematics(spark, sf).select("id", "tier"), "id").where("tier BETWEEN 1 AND 5")
    more = rows.select(F.col("tier").cast("int").alias("phase"), F.when(F.col("id") % 2 == 0, "milestone").otherwise("research").alias("kind"), "item", "qty")
    return due.unionByName(more).groupBy("phase", "kind").agg(F.sum("qty").cast("long").alias("units"), F.count_distinct("item").alias("items"))


def milestone_schedule(spark: SparkSession, sf: str) -> DataFrame:
    """When each tier's milestones begin to be paid and are, in order, at the tier's income."""
    cost = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.sum("l_quantity").alias("cost"))
    rows = cost.join(d.schematics(spark, sf).select("id", "tier"), "id")
    return flows.scheduled(rows, ["tier"], ["cost", "id"], "cost", 10.0 + F.col("tier")).select("tier", "id", "cost", F.round("starts", 4).alias("starts"), F.round("paid", 4).alias("paid"))


def infrastructure_net(spark: SparkSession, sf: str) -> DataFrame:
    """Declared power steps less what stands, by site and class."""
    need = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("site"), F.concat(F.lit("Gen_"), (F.col("c_custkey") % 7).cast("string")).alias("class")).agg(F.ceil(F.count("*") / 4).cast("long").alias("need"))
    return planning.netted(need, _standing(spark, sf).withColumnRenamed("units", "have"), ["site", "class"])


def alternate_relief(spark: SparkSession, sf: str) -> DataFrame:
    """How much raw each alternate saves for one of its product, and the raw it relieves most."""
    per = bom.explode(d.edges(spark, sf)).where(F.col("item") < d.RAW).select(F.col("target").alias("of"), F.col("item").alias("raw"), "per_target")
    alts = d.alternates(spark, sf)
    after = alts.join(per, F.col("child") == F.col("of"), "left").select("parent", F.coalesce("raw", "child").alias("raw"), (F.col("qty") * F.coalesce("per_target", F.lit(1.0))).alias("change"))
    before = alts.select("parent").join(per, F.col("parent") == F.col("of")).select("parent", "raw", (-F.col("per_target")).alias("change"))
    rows = after.unionByName(before).groupBy("parent", "raw").agg(F.sum("change").alias("change"))
    return rows.groupBy("parent").agg(F.round(-F.sum("change"), 6).alias("saved"), F.min(F.struct(F.round("change", 6).alias("c"), "raw"))["raw"].alias("relieved"))


def stage_inventory(spark: SparkSession, sf: str) -> DataFrame:
    """What stands at the close of each stage: its own lanes on top of the earlier ones'."""
    due = d.deliveries(spark, sf).withColumn("lanes", F.ceil(F.col("qty") / 40).cast("long"))
    w = Window.partitionBy("item").orderBy("phase").rowsBetween(Window.unboundedPreceding, 0)
    return due.select("phase", "item", "lanes", F.max("lanes").over(w).alias("standing"))


QUERIES = {f.__name__: f for f in (
    standing_generation, flows_with_generators, extraction_at_share, segment_checks, site_extraction, lane_totals, out_of_scope_draw, merged_buses, binding_sides, bus_dispositions, bus_feasibility, objective_terms, plan_warnings, replaced_recipe, scaled_external, flattened_tree,
    packaged_fuels, biofuel_chains, new_bootstrap, projected_goals, cap_binding, carried_power, carry_estimate, energy_split, phase_work, phase_bills, milestone_schedule, infrastructure_net, alternate_relief, stage_inventory,
)}

_GEN = "g AS (SELECT s_nationkey AS site, s_suppkey % 7 AS k, count(*) AS units FROM supplier GROUP BY 1, 2)"
_SEG = "seg AS (SELECT item::BIGINT AS item, purity, sum(CASE purity WHEN 0 THEN 30.0::DOUBLE WHEN 1 THEN 60.0 ELSE 120.0 END) AS cap, 15.0::DOUBLE * count(*) AS mw FROM socket GROUP BY 1, 2)"
_LINE = "line AS (SELECT item, demand, per FROM (SELECT l_partkey AS item, sum(l_quantity) / 8 AS demand FROM lineitem GROUP BY 1) JOIN (SELECT p_partkey AS item, 60.0::DOUBLE / (2 + p_size % 10) AS per FROM part) USING (item))"
_BUS = _LINE + """, b0 AS (SELECT *, demand / per AS exact, ceil(demand / per - 1e-9::DOUBLE)::BIGINT AS machines, item % 3 = 0 AS stores, CASE WHEN item % 4 = 0 THEN 5.0::DOUBLE ELSE 0 END AS wd, CASE WHEN item % 5 = 0 THEN 7.0::DOUBLE ELSE 0 END AS st FROM line),
b1 AS (SELECT *, machines * per AS supply, CASE WHEN item % 13 = 0 THEN 'unowned' WHEN stores AND wd > 0 THEN 'store and withdraw' WHEN stores AND st > 0 THEN 'store' WHEN wd > 0 THEN 'withdraw' ELSE 'automated' END AS kind FROM b0),
b2 AS (SELECT *, kind IN ('withdraw', 'store and withdraw') AS t, kind IN ('store', 'store and withdraw') AS f FROM b1), bus AS (SELECT *, demand + CASE WHEN t THEN wd ELSE 0 END AS draw, demand + CASE WHEN t THEN wd ELSE 0 END + CASE WHEN f THEN st ELSE 0 END AS peak FROM b2)"""
_EXP = "expansion AS (SELECT parent AS target, child AS item, qty FROM edge UNION ALL SELECT x.target, e.child, x.qty * e.qty FROM expansion x JOIN edge e ON e.parent = x.item)"

SQL = {
    "standing_generation": f"WITH {_GEN} SELECT site, sum(units * (30.0::DOUBLE + k * 20)) AS mw, sum(units * (k + 1.0::DOUBLE)) AS fuel FROM g GROUP BY 1",
    "flows_with_generators": sql("recipe_io edge", _GEN + ", u AS (SELECT child AS item, sum(qty) AS qty FROM edge GROUP BY 1 UNION ALL SELECT k + 10, units * (k + 1.0::DOUBLE) FROM g) SELECT item, round(sum(qty), 6) AS qty FROM u GROUP BY 1"),
    "extraction_at_share": sql("recipe_io edge socket", _SEG + ", s AS (SELECT item, sum(cap) AS cap, sum(mw) AS f FROM seg GROUP BY 1), w AS (SELECT child AS item, sum(qty) * 40 AS draw FROM edge WHERE child < 25 GROUP BY 1), h AS (SELECT item, cap, f, CASE WHEN cap > 0 THEN least(1.0, coalesce(draw, 0) / cap) ELSE 0 END AS share FROM s LEFT JOIN w USING (item)) SELECT item, round(cap, 4) AS cap, round(share, 6) AS share, round(f * share, 4) AS mw FROM h"),
    "segment_checks": sql("socket", _SEG + ", s AS (SELECT item, sum(cap) AS made FROM seg GROUP BY 1) SELECT item, CASE WHEN item = 3 THEN NULL WHEN item = 5 THEN made + 1 ELSE made END AS cap, made, item <> 5 AS ok FROM s"),
    "site_extraction": sql("socket", _SEG + ", u AS (SELECT item % 4 AS site, item, cap FROM seg UNION ALL SELECT s_nationkey % 4, s_suppkey % 25, 5.0::DOUBLE + s_suppkey % 3 FROM supplier UNION ALL SELECT k, 3, NULL FROM range(4) t(k)) SELECT site, item, CASE WHEN count(*) = count(cap) THEN round(sum(cap), 4) END AS cap FROM u GROUP BY 1, 2"),
    "lane_totals": sql("item", "SELECT s_nationkey AS bus, form, count(*) AS lanes, sum(l_quantity)::BIGINT AS flow, count(*) FILTER (l_linestatus = 'F') AS standing, count(*) FILTER (l_linestatus <> 'F') AS to_build FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN item ON l_partkey = item GROUP BY 1, 2"),
    "out_of_scope_draw": sql("item recipe_io edge", "SELECT child AS item, round(sum(qty), 6) AS draw, count(*) AS users FROM edge WHERE child NOT IN (SELECT item FROM item WHERE form = 'solid') GROUP BY 1"),
    "merged_buses": sql("recipe_io edge", "b AS (SELECT l_partkey AS item, sum(l_quantity) AS rate, count(*) AS lines FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1), u AS (SELECT child AS item, count(DISTINCT parent) AS consumers FROM edge WHERE parent IN (SELECT item FROM b) GROUP BY 1) SELECT item, rate, lines, coalesce(consumers, 0) AS consumers FROM b LEFT JOIN u USING (item)"),
    "binding_sides": sql("recipe_io", "r AS (SELECT parent AS item, max(amount) AS t, max(made) AS m, 60.0::DOUBLE / (2 + parent % 10) AS c FROM recipe_io GROUP BY 1) SELECT item, CASE WHEN t > m THEN 'input' ELSE 'output' END AS side, floor(270.0::DOUBLE / greatest(m * c, t * c) + 1e-9::DOUBLE)::BIGINT AS machines FROM r"),
    "bus_dispositions": f"WITH {_BUS} SELECT item, kind, round(draw, 4) AS draw, round(peak, 4) AS peak, CASE WHEN t OR f THEN 'manual' ELSE 'machine' END AS use, kind IN ('automated', 'unowned') AS stable FROM bus",
    "bus_feasibility": f"""WITH {_BUS} SELECT item, round(greatest(0.0, peak - supply), 7) AS shortfall, CASE WHEN supply > 0 THEN round(draw / supply, 7) END AS utilisation, round(machines - exact, 7) AS tax, round(least(1.0, CASE WHEN supply > 0 THEN draw / supply ELSE 0 END) * 4 * machines, 7) AS backing_mw,
concat_ws(',', CASE WHEN supply < draw - 1e-9::DOUBLE THEN 'deficit' END, CASE WHEN greatest(0.0, peak - supply) > 0 THEN 'peak' END, CASE WHEN stores AND draw >= supply - 1e-9::DOUBLE THEN 'stores nothing' END) AS warnings FROM bus""",
    "objective_terms": sql("item", _BUS + " SELECT form, round(sum(2 * machines + 0.5::DOUBLE * machines * 4 + CASE WHEN raw THEN demand ELSE 0 END), 3) AS objective, sum(machines)::BIGINT AS machines FROM bus JOIN item USING (item) GROUP BY 1"),
    "plan_warnings": "SELECT s_nationkey AS site, concat_ws(',', CASE WHEN count(*) < 4 THEN 'few units' END, CASE WHEN min(s_acctbal) < 0 THEN 'in debt' END, CASE WHEN sum(s_acctbal) > 20000 THEN 'rich' END) AS warnings FROM supplier GROUP BY 1",
    "replaced_recipe": sql("recipe_io edge delivery", """due AS (SELECT item, sum(qty) AS due FROM delivery GROUP BY 1), top AS (SELECT item FROM due WHERE item >= 25 ORDER BY due DESC, item LIMIT 1),
route AS (SELECT 0 AS v, parent, child, qty FROM edge UNION ALL SELECT 1, parent, child, qty FROM edge WHERE parent <> (SELECT item FROM top) UNION ALL SELECT 1, item, 7, 4.0::DOUBLE FROM top),
x AS (SELECT v, parent AS target, child AS item, qty FROM route UNION ALL SELECT x.v, x.target, r.child, x.qty * r.qty FROM x JOIN route r ON r.parent = x.item AND r.v = x.v)
SELECT x.item, round(sum(qty * due) FILTER (v = 0), 2) AS before, round(sum(qty * due) FILTER (v = 1), 2) AS after FROM x JOIN due d ON d.item = x.target WHERE x.item < 25 GROUP BY 1""", True),
    "scaled_external": f"WITH {_LINE}, f(factor) AS (VALUES (0.5::DOUBLE), (1.0), (2.5)) SELECT factor, sum(ceil(demand * factor / per - 1e-9::DOUBLE)::BIGINT)::BIGINT AS machines, round(sum(ceil(demand * factor / per - 1e-9::DOUBLE)) - sum(demand * factor / per), 4) AS tax FROM line, f GROUP BY 1",
    "flattened_tree": "WITH RECURSIVE t AS (SELECT p_partkey AS node, 0 AS depth, p_partkey::VARCHAR AS path FROM part WHERE p_partkey < 25 UNION ALL SELECT p_partkey, t.depth + 1, t.path || '/' || p_partkey FROM t JOIN part ON p_partkey >= 25 AND p_partkey // 2 = t.node) SELECT * FROM t",
    "packaged_fuels": sql("item schematic", "SELECT item, item + 2000000 AS recipe, item % 4 <> 0 AS unpacks, tier <= 4 AS sink FROM item JOIN schematic s ON s.recipe = item WHERE form = 'liquid'"),
    "biofuel_chains": sql("item recipe_io edge delivery", "s AS (SELECT parent AS item, arg_min(child, (child, qty)) AS made, arg_min(qty, (child, qty)) AS ratio FROM edge GROUP BY 1), a AS (SELECT item, qty FROM delivery JOIN item USING (item) WHERE phase = 2 AND form = 'gas' AND NOT raw) SELECT z.made, round(sum(a.qty * x.ratio * y.ratio * z.ratio), 4) AS amount, count(*) AS chains FROM a JOIN s x ON x.item = a.item JOIN s y ON y.item = x.made JOIN s z ON z.item = y.made GROUP BY 1"),
    "new_bootstrap": sql("schematic socket", "u AS (SELECT p_brand AS building, count(*) AS n FROM part JOIN schematic ON recipe = p_partkey WHERE tier = 5 GROUP BY 1 UNION ALL SELECT 'Brand#' || (item + 1), count(*) FROM socket GROUP BY 1) SELECT building, sum(n)::BIGINT AS n FROM u GROUP BY 1"),
    "projected_goals": sql("delivery", "r AS (SELECT l_partkey AS item, sum(l_quantity / 10) AS rate FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) SELECT d.item, qty AS total, round(coalesce(rate, 0), 4) AS rate, CASE WHEN rate > 1e-9 THEN round(qty / rate, 4) END AS minutes FROM delivery d LEFT JOIN r USING (item) WHERE phase = 5"),
    "cap_binding": sql("recipe_io edge item socket", """c AS (SELECT item::BIGINT AS item, sum(CASE purity WHEN 0 THEN 30.0::DOUBLE WHEN 1 THEN 60.0 ELSE 120.0 END * 1.5::DOUBLE * 0.9::DOUBLE) AS cap FROM socket GROUP BY 1), w AS (SELECT child AS item, sum(qty) * 50 AS draw FROM edge WHERE child < 25 GROUP BY 1),
k AS (SELECT i.item, CASE WHEN i.item % 6 <> 5 THEN coalesce(cap, 0) END AS cap, coalesce(draw, 0) AS draw FROM item i LEFT JOIN c ON c.item = i.item LEFT JOIN w ON w.item = i.item WHERE raw)
SELECT item, round(cap, 4) AS cap, round(draw, 4) AS draw, CASE WHEN cap > 0 THEN round(draw / cap, 6) END AS use, CASE WHEN cap IS NULL THEN FALSE WHEN cap = 0 THEN draw > 1e-6::DOUBLE ELSE draw >= cap * (1 - 1e-6::DOUBLE) END AS binding FROM k"""),
    "carried_power": sql("delivery", """n AS (SELECT scenario, phase, sum(qty) / 100 * CASE WHEN phase % 2 = 0 THEN factor::DOUBLE ELSE 1.0 END AS mw FROM delivery, (VALUES ('base', 1.0), ('hard', 1.5)) s(scenario, factor) GROUP BY scenario, factor, phase),
s AS (SELECT *, coalesce(max(mw) OVER (PARTITION BY scenario ORDER BY phase ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS standing FROM n) SELECT scenario, phase, round(mw, 4) AS mw, round(standing, 4) AS standing, round(greatest(0.0, mw - standing), 4) AS new, round(greatest(0.0, standing - mw), 4) AS spare FROM s"""),
    "carry_estimate": sql("delivery", "SELECT d.phase, d.item, round(p.qty / 600 * 45, 6) AS carry, round(greatest(0.0, d.qty - p.qty / 600 * 45), 6) AS \"left\" FROM delivery d JOIN delivery p ON p.phase + 1 = d.phase AND p.item = d.item"),
    "energy_split": sql("recipe_io edge delivery", _EXP + """, f AS (SELECT phase, item, qty FROM delivery UNION ALL SELECT phase, x.item, d.qty * x.qty FROM delivery d JOIN expansion x ON x.target = d.item)
SELECT phase, round(sum(CASE WHEN item >= 25 THEN qty * (4 + item % 9) ELSE 0 END), 2) AS making, round(sum(CASE WHEN item < 25 AND item <> 3 THEN qty * 0.5::DOUBLE ELSE 0 END), 2) AS ore, round(sum(CASE WHEN item = 3 THEN qty * 0.5::DOUBLE ELSE 0 END), 2) AS water FROM f GROUP BY 1""", True),
    "phase_work": sql("delivery", "SELECT scenario, phase, round(sum(qty) * power(factor::DOUBLE, phase / 5), 4) AS work, round(sum(power(qty / 100, 2)), 4) AS pressure FROM delivery, (VALUES ('cheap', 0.5), ('dear', 2.0)) s(scenario, factor) GROUP BY scenario, factor, phase"),
    "phase_bills": sql("delivery schematic", "u AS (SELECT phase, 'delivery' AS kind, item, qty FROM delivery UNION ALL SELECT tier, CASE WHEN id % 2 = 0 THEN 'milestone' ELSE 'research' END, l_suppkey, l_quantity FROM lineitem JOIN schematic ON id = l_partkey WHERE tier BETWEEN 1 AND 5) SELECT phase, kind, sum(qty)::BIGINT AS units, count(DISTINCT item) AS items FROM u GROUP BY 1, 2"),
    "milestone_schedule": sql("schematic", "c AS (SELECT l_partkey AS id, sum(l_quantity) AS cost FROM lineitem GROUP BY 1), s AS (SELECT tier, id, cost, sum(cost) OVER (PARTITION BY tier ORDER BY cost, id ROWS UNBOUNDED PRECEDING) AS t FROM c JOIN schematic USING (id)) SELECT tier, id, cost, round((t - cost) / (10.0::DOUBLE + tier), 4) AS starts, round(t / (10.0::DOUBLE + tier), 4) AS paid FROM s"),
    "infrastructure_net": f"WITH {_GEN}, n AS (SELECT c_nationkey AS site, c_custkey % 7 AS k, ceil(count(*) / 4)::BIGINT AS need FROM customer GROUP BY 1, 2), j AS (SELECT coalesce(n.site, g.site) AS site, coalesce(n.k, g.k) AS k, coalesce(need, 0) AS need, coalesce(units, 0) AS have FROM n FULL JOIN g ON n.site = g.site AND n.k = g.k) SELECT site, 'Gen_' || k AS class, need, have, greatest(need - have, 0) AS owed, greatest(have - need, 0) AS surplus FROM j",
    "alternate_relief": sql("recipe_io edge alternate", _EXP + """, per AS (SELECT target, item AS raw, sum(qty) AS q FROM expansion WHERE item < 25 GROUP BY 1, 2), u AS (SELECT parent, coalesce(raw, child) AS raw, qty * coalesce(q, 1) AS c FROM alternate LEFT JOIN per ON target = child UNION ALL SELECT parent, raw, -q FROM (SELECT DISTINCT parent FROM alternate) JOIN per ON target = parent),
s AS (SELECT parent, raw, sum(c) AS c FROM u GROUP BY 1, 2) SELECT parent, round(-sum(c), 6) AS saved, arg_min(raw, (round(c, 6), raw)) AS relieved FROM s GROUP BY 1""", True),
    "stage_inventory": sql("delivery", "l AS (SELECT phase, item, ceil(qty / 40)::BIGINT AS lanes FROM delivery) SELECT phase, item, lanes, max(lanes) OVER (PARTITION BY item ORDER BY phase) AS standing FROM l"),
}
