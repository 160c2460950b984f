"""Supply queries: unlocks, availability, caps, ledgers, power, machines, lanes and pacing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millwright.functions.scalars import clock_power, largest_part, normalised, unlock_milestone, unlock_tier, whole
from millwright.operators import guards, planning, windows
from millwright.plans import domain as d
from millwright.plans.domain import sql
from millwright.session import table

TIER = 5
MARKS = [(1, 60.0), (2, 120.0), (3, 270.0), (4, 480.0), (5, 780.0), (6, 1200.0)]
BELTS = ", ".join(f"({m}, {c})" for m, c in MARKS)


def _marks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MARKS, "mark int, capacity double")


# Joins and availability -------------------------------------------------------------------


def socket_assignment_join(spark: SparkSession, sf: str) -> DataFrame:
    """Sockets joined one to one with their assignments; anything else is refused."""
    at = d.sockets(spark, sf)
    left, right = at.select("id", "x", "y", "z"), at.select("id", "item", "purity")
    return guards.matched_one_to_one(left, right, ["id"]).select("id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), "item", "purity")


def orphan_sockets_anti(spark: SparkSession, sf: str) -> DataFrame:
    """Sockets without an assignment, with assignments thinned out."""
    at = d.sockets(spark, sf)
    return at.join(at.where("id % 37 <> 0").select("id"), "id", "left_anti").select("id", "item")


def unlock_grants(spark: SparkSession, sf: str) -> DataFrame:
    """By tier: schematics, recipes granted up to it, and the first schematic by id."""
    s = d.schematics(spark, sf)
    tiers = s.groupBy("tier").agg(F.count("*").alias("own"), F.min("id").alias("first"))
    below = tiers.select(F.col("tier").alias("t"), F.col("own").alias("n"))
    return tiers.join(F.broadcast(below), F.col("t") <= F.col("tier")).groupBy("tier", "own", "first").agg(F.sum("n").alias("granted"))


def pool_bands(spark: SparkSession, sf: str) -> DataFrame:
    """Names resolved over normalised keys: one match each, and the band's largest number."""
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("Alternate: "), "p_name", F.lit(" "), F.col("p_partkey").cast("string")).alias("name"), F.concat(F.lit("band_"), F.col("p_size").cast("string"), F.lit("_"), (F.col("p_partkey") % 10).cast("string")).alias("band"))
    slugs = part.where("id % 13 = 0").select(F.regexp_replace(F.lower(F.regexp_replace("name", "^Alternate: ", "")), " ", "-").alias("slug"))
    named = part.select("id", "band", normalised(F.col("name")).alias("key"))
    guards.require_unique(named, ["key"], "ambiguous name")
    return slugs.select("slug", normalised(F.col("slug")).alias("key")).join(named, "key").select("slug", "id", largest_part(F.col("band")).alias("top"))


def recipe_status(spark: SparkSession, sf: str) -> DataFrame:
    """Every recipe's status at a tier: granted, declared, pool, withheld or later."""
    s = d.schematics(spark, sf)
    flags = s.select("recipe", (F.col("tier") <= TIER).alias("granted"), (F.col("recipe") % 9 == 0).alias("declared"), (F.col("recipe") % 7 == 0).alias("pool"), (F.col("recipe") % 41 == 0).alias("withheld"))
    status = F.when(F.col("withheld"), "withheld").when(F.col("granted"), "granted").when(F.col("declared"), "declared").when(F.col("pool"), "pool").otherwise("later")
    return flags.select("recipe", status.alias("status"))


def extractors_open_semi(spark: SparkSession, sf: str) -> DataFrame:
    """Extractor classes whose building, under a derived key, is unlocked at the tier."""
    built = d.schematics(spark, sf).where(F.col("tier") <= TIER).select(F.concat(F.lit("Build_"), F.col("id").cast("string")).alias("building"))
    classes = table(spark, sf, "supplier").select(F.concat(F.lit("Desc_"), F.col("s_suppkey").cast("string")).alias("descriptor"), "s_nationkey")
    return classes.withColumn("building", F.concat(F.lit("Build_"), F.substring_index("descriptor", "_", -1))).join(built, "building", "left_semi").select("descriptor", F.col("s_nationkey").alias("nation"))


def schematic_costs_by_tier(spark: SparkSession, sf: str) -> DataFrame:
    """Cost units by tier and kind, from lines as cost rows."""
    cost = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("id"), "l_quantity")
    return cost.join(d.schematics(spark, sf), "id").groupBy("tier", "kind").agg(F.sum("l_quantity").cast("long").alias("units"), F.count_distinct("id").alias("schematics"))


def unlock_text(spark: SparkSession, sf: str) -> DataFrame:
    """Tier and milestone parsed out of unlock texts; texts of another form give nulls."""
    text = F.when(F.col("tier") == 9, F.lit("MAM research")).otherwise(F.concat(F.lit("Tier "), F.col("tier").cast("string"), F.lit(" - "), "kind"))
    return d.schematics(spark, sf).select("id", text.alias("t")).select("id", unlock_tier(F.col("t")).alias("tier"), unlock_milestone(F.col("t")).alias("milestone"))


def packing_recipes(spark: SparkSession, sf: str) -> DataFrame:
    """kind, recipe, direction, item, packed: every liquid is packed into an item of its own, and most
    are unpacked again. Numbers are told apart by kind and packed, not by how large they are."""
    liquid = d.items(spark, sf).where("form = 'liquid'").select("item")
    side = lambda direction, packed: F.struct(F.lit(direction).alias("direction"), (F.col("item") + 2000000 * int(packed)).alias("item"), F.lit(packed).alias("packed"))
    two = lambda rows, kind, base, *sides: rows.select(F.lit(kind).alias("kind"), (F.col("item") + base).alias("recipe"), F.explode(F.array(*sides)).alias("e")).select("kind", "recipe", "e.*")
    pack = two(liquid, "pack", 2000000, side("input", False), side("output", True))
    return pack.unionByName(two(liquid.where("item % 4 <> 0"), "unpack", 3000000, side("input", True), side("output", False)))


def inverse_recipes(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of recipes that undo each other: what one takes the other makes, and back."""
    own = lambda direction, item: d.recipe_io(spark, sf).select(F.lit("make").alias("kind"), F.col("parent").alias("recipe"), F.lit(direction).alias("direction"), F.col(item).alias("item"), F.lit(False).alias("packed"))
    rows = own("input", "child").unionByName(own("output", "parent")).unionByName(packing_recipes(spark, sf))
    side = lambda k: F.array_sort(F.collect_set(F.when(F.col("direction") == k, F.struct("item", "packed")))).alias(k)
    signed = rows.groupBy("kind", "recipe").agg(side("input"), side("output"))
    other = signed.select(F.col("recipe").alias("back"), F.col("output").alias("input"), F.col("input").alias("output"))
    return signed.join(other, ["input", "output"]).where("recipe < back").select("recipe", "back")


# Caps, ledgers, bills ---------------------------------------------------------------------


def _caps(spark: SparkSession, sf: str) -> DataFrame:
    """item, cap from sockets: purity weight times clock, less a reserve."""
    weight = F.when(F.col("purity") == 0, 30.0).when(F.col("purity") == 1, 60.0).otherwise(120.0)
    return d.sockets(spark, sf).select(F.col("item").cast("long").alias("item"), (weight * 1.5 * 0.9).alias("cap"))


def resource_caps_outer_fill(spark: SparkSession, sf: str) -> DataFrame:
    raw = d.items(spark, sf).where("raw").select("item")
    return planning.filled_caps(raw, _caps(spark, sf)).select("item", F.round("cap", 4).alias("cap"))


def extraction_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Sockets by item and purity: count, summed rate and power at the clock."""
    rate = F.when(F.col("purity") == 0, 30.0).when(F.col("purity") == 1, 60.0).otherwise(120.0)
    mw = clock_power(F.lit(15.0), F.lit(150.0), F.lit(1.321929), F.count("*"))
    return d.sockets(spark, sf).withColumn("rate", rate * 1.5).groupBy("item", "purity").agg(F.count("*").alias("n"), F.round(F.sum("rate"), 4).alias("rate"), F.round(mw, 4).alias("mw"))


def purity_weight_guard(spark: SparkSession, sf: str) -> DataFrame:
    """One weight for each purity, refused if there were several."""
    weight = F.when(F.col("purity") == 0, 0.5).when(F.col("purity") == 1, 1.0).otherwise(2.0)
    rows = d.sockets(spark, sf).select("purity", weight.alias("weight")).distinct()
    return guards.require_unique(rows, ["purity"], "several weights")


def bill_compose(spark: SparkSession, sf: str) -> DataFrame:
    """Deliveries of three phases and schematic costs of two tiers in one bill."""
    phases = d.deliveries(spark, sf).where("phase <= 3").select("item", "qty")
    cost = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_quantity").alias("qty"))
    tiers = cost.join(d.schematics(spark, sf).where("tier IN (1, 2)").select("id"), "id", "left_semi").select(F.col("id").alias("item"), "qty")
    return phases.unionByName(tiers).groupBy("item").agg(F.sum("qty").cast("long").alias("units"))


def item_flow_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Per item: produced, consumed, shipped, returned and what is left."""
    li = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("item"), F.col("l_quantity").alias("qty"), "l_returnflag", "l_linestatus")
    flows = {"produced": li.where("l_linestatus = 'F'"), "consumed": li.where("l_linestatus = 'O'"), "shipped": li.where("l_returnflag = 'A'"), "returned": li.where("l_returnflag = 'R'")}
    return planning.ledger(flows, {"produced": 1, "consumed": -1, "shipped": -1, "returned": 1}, ["item"])


def byproduct_disposition(spark: SparkSession, sf: str) -> DataFrame:
    """What happens to each surplus: sink, package, burn, store or refuse."""
    left = item_flow_ledger(spark, sf).where("left > 0.5").select("item", "left").join(d.items(spark, sf), "item")
    way = F.when(F.col("raw"), "store").when(F.col("form") == "solid", "sink").when((F.col("form") == "liquid") & (F.col("item") % 2 == 0), "package").when(F.col("form") == "gas", "burn").otherwise("refuse")
    points = F.when(way == "sink", F.col("left") * (F.col("item") % 12 + 1)).otherwise(0.0)
    return left.select("item", "form", "left", way.alias("way"), points.alias("points"))


def fixed_route_ceiling(spark: SparkSession, sf: str) -> DataFrame:
    """How many of each target per minute the raw caps allow, and the raw that binds."""
    from millwright.operators import bom

    per = bom.explode(d.edges(spark, sf))
    raw = d.items(spark, sf).where("raw").select("item")
    caps = planning.filled_caps(raw, _caps(spark, sf)).withColumn("cap", F.when(F.col("item") < 10, F.col("cap")))  # others unlimited
    return planning.ceiling(per, caps, ["target"]).select("target", F.round("scale", 4).alias("scale"), "binding")


# Machines, lanes, power -------------------------------------------------------------------


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    """item, demand (per minute), per_machine."""
    qty = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("item")).agg((F.sum("l_quantity") / 8).alias("demand"))
    return qty.join(table(spark, sf, "part").select(F.col("p_partkey").alias("item"), (60.0 / (2 + F.col("p_size") % 10)).alias("per_machine")), "item")


def machine_counts_ceil(spark: SparkSession, sf: str) -> DataFrame:
    m = whole(F.col("demand") / F.col("per_machine"))
    return _lines(spark, sf).select("item", "demand", m.alias("machines"), F.round(planning.feasible_clock(F.col("demand"), F.col("per_machine"), m), 4).alias("clock"))


def lane_decomposition(spark: SparkSession, sf: str) -> DataFrame:
    """Machines spread over lanes of one belt each."""
    parts = planning.lanes(F.col("demand"), F.lit(120.0), F.col("per_machine"))
    rows = _lines(spark, sf).select("item", *(c.alias(k) for k, c in parts.items()))
    return planning.decomposed(rows, "machines", "lanes").select("item", "lane", "lane_machines", "per_lane")


def minimum_sufficient_mark(spark: SparkSession, sf: str) -> DataFrame:
    return windows.sufficient(_lines(spark, sf), "demand", _marks(spark), "capacity", "mark").select("item", "mark", "mark_capacity", "reaches")


def belt_lanes(spark: SparkSession, sf: str) -> DataFrame:
    """Lanes of the largest mark, then the smallest mark that carries one lane."""
    lines = _lines(spark, sf).withColumn("lanes", F.greatest(F.lit(1), whole(F.col("demand") / 1200.0))).withColumn("flow", F.col("demand") / F.col("lanes"))
    return windows.sufficient(lines, "flow", _marks(spark), "capacity", "mark").select("item", "lanes", "mark")


def consumer_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Each supplier's share of an item's draw."""
    draw = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("item"), F.col("l_suppkey").alias("consumer")).agg(F.sum("l_quantity").alias("draw"))
    return planning.shares(draw, ["item"], "draw").select("item", "consumer", "draw", "share")


def residual_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Supply of whole machines against demand and a withdrawal: residual, covered, and the
    minutes in which the residual pays a bill of 500."""
    m = whole(F.col("demand") / F.col("per_machine"))
    rows = _lines(spark, sf).withColumn("residual", F.round(m * F.col("per_machine") - F.col("demand"), 6))
    return rows.select("item", "residual", (F.col("residual") >= 2 - 1e-9).alias("covered"), F.when(F.col("residual") > 1e-6, F.round(500 / F.col("residual"), 3)).alias("minutes"))


def clock_power_curve(spark: SparkSession, sf: str) -> DataFrame:
    """Power of each line at several clocks."""
    clocks = spark.createDataFrame([(50.0,), (100.0,), (150.0,), (250.0,)], "clock double")
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("item"), (4.0 + F.col("p_size") % 30).alias("mw")).join(F.broadcast(clocks))
    return rows.select("item", "clock", F.round(clock_power(F.col("mw"), F.col("clock"), F.lit(1.321929), F.lit(1)), 4).alias("power"))


def _generators(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier")
    return s.select(F.col("s_nationkey").alias("site"), F.col("s_suppkey").alias("unit"), (30.0 + F.col("s_suppkey") % 7 * 20).alias("mw"))


def power_need_generators(spark: SparkSession, sf: str) -> DataFrame:
    """Whole generators of 75 MW that each site's need takes, less its standing ones."""
    need = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("site")).agg((F.count("*") * 12.5).alias("need"))
    have = _generators(spark, sf).groupBy("site").agg(F.sum("mw").alias("have"))
    rows = need.join(have, "site", "left").na.fill({"have": 0.0})
    return rows.select("site", "need", "have", F.greatest(F.lit(0), whole((F.col("need") - F.col("have")) / 75.0)).alias("generators"))


def power_stack_allocation(spark: SparkSession, sf: str) -> DataFrame:
    """Each site's need met by its standing units in order, with what stays open."""
    need = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("site")).agg((F.count("*") * 1.5).alias("need"))
    return windows.allocated(_generators(spark, sf).join(need, "site"), ["site"], ["unit"], "mw", "need").select("site", "unit", "mw", "taken", "short")


def supply_check(spark: SparkSession, sf: str) -> DataFrame:
    """Per site: generator fuel needed, available, and whether all fuels pass."""
    need = _generators(spark, sf).groupBy("site").agg(F.sum(F.col("mw") * 0.2).alias("need"))
    have = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("site")).agg((F.count("*") * 0.9).alias("have"))
    rows = need.join(have, "site", "left").na.fill({"have": 0.0})
    return rows.select("site", F.round("need", 4).alias("need"), F.round("have", 4).alias("have"), F.when(F.col("have") >= F.col("need"), "fed").otherwise("short").alias("verdict"))


# Netting and pacing -----------------------------------------------------------------------


def _need_have(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    li = table(spark, sf, "lineitem")
    need = li.where("l_partkey % 5 <> 0").groupBy(F.col("l_partkey").alias("item")).agg(F.sum("l_quantity").cast("long").alias("need"))
    have = li.where("l_partkey % 3 <> 0 AND l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("item")).agg((3 * F.sum("l_quantity")).cast("long").alias("have"))
    return need, have


def net_stock_owed_surplus(spark: SparkSession, sf: str) -> DataFrame:
    need, have = _need_have(spark, sf)
    return planning.netted(need, have, ["item"])


def net_lanes_full_outer(spark: SparkSession, sf: str) -> DataFrame:
    """Lanes of two plans side by side: to build, to keep, to drop."""
    need, have = _need_have(spark, sf)
    rows = planning.netted(need, have, ["item"])
    build = F.ceil(F.col("owed") / 100).cast("long")
    return rows.select("item", build.alias("build"), F.least(F.col("need"), F.col("have")).alias("keep"), F.when(F.col("need") == 0, F.col("have")).otherwise(0).alias("unbilled"))


def pay_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    """A bootstrap paid from stock first: paid, left in stock, still owed."""
    need, have = _need_have(spark, sf)
    rows = planning.netted(need, have, ["item"])
    return rows.select("item", F.least("have", "need").alias("paid"), (F.col("have") - F.least("have", "need")).alias("stock"), "owed")


def phase_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Rates that finish each phase when its anchor, the largest delivery, is made at 10 a
    minute."""
    due = d.deliveries(spark, sf)
    anchor = due.groupBy("phase").agg((F.max("qty") / 10).alias("minutes"))
    return due.join(F.broadcast(anchor), "phase").select("phase", "item", F.round(F.col("qty") / F.col("minutes"), 6).alias("rate"), "minutes")


def lag_table(spark: SparkSession, sf: str) -> DataFrame:
    """Goals against shares of open time: finish, and the rate that catches up."""
    shares = spark.createDataFrame([(0.1,), (0.25,), (0.5,)], "open double")
    due = d.deliveries(spark, sf).where("phase = 1").join(F.broadcast(shares))
    return due.select("item", "open", F.round(F.col("qty") / (10 * (1 - F.col("open"))), 4).alias("finish"), F.round(10 / (1 - F.col("open")), 4).alias("catch_up"))


def pa_duration_banks(spark: SparkSession, sf: str) -> DataFrame:
    """Finish of each delivery made at one rate until a bank fills and a higher one after, and
    the phase's finish."""
    due = d.deliveries(spark, sf)
    fill = 100.0 + F.col("item") % 7 * 10
    rows = due.withColumn("minutes", planning.two_segment_finish(F.col("qty"), F.lit(4.0), fill, F.lit(9.0)))
    from pyspark.sql import Window

    return rows.select("phase", "item", F.round("minutes", 4).alias("minutes"), F.round(F.max("minutes").over(Window.partitionBy("phase")), 4).alias("phase_minutes"))


def storage_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Storage of 24 slots per solid: capacity, minutes to fill at the spare rate, share of a
    two-hour bill."""
    rows = _lines(spark, sf).join(d.items(spark, sf).where("form = 'solid'"), "item")
    spare = F.col("per_machine") * 0.1
    cap = 24 * F.col("stack")
    return rows.select("item", cap.cast("long").alias("capacity"), F.round(cap / spare, 4).alias("fill_minutes"), F.round(F.least(F.lit(1.0), spare * 120 / cap), 6).alias("share"))


def chain_boundary_draw(spark: SparkSession, sf: str) -> DataFrame:
    """What a chain of items, all gases, draws from outside itself, by item drawn."""
    members = d.items(spark, sf).where("form = 'gas'").select("item")
    io = d.edges(spark, sf)
    inside = io.join(members, io["parent"] == members["item"], "left_semi")
    return inside.join(members, inside["child"] == members["item"], "left_anti").groupBy(F.col("child").alias("item")).agg(F.round(F.sum("qty"), 6).alias("draw"), F.count("*").alias("users"))


def poi_state_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Places by kind and state: destroyed if a matching record says so, else collected if
    another does, else open."""
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 50).alias("cell"), F.col("p_type").alias("kind"))
    gone = part.where("id % 6 = 0").select("cell", "id").withColumn("gone", F.lit(True))
    got = part.where("id % 4 = 1").select("cell", "id").withColumn("got", F.lit(True))
    rows = part.join(gone, ["cell", "id"], "left").join(got, ["cell", "id"], "left")
    state = F.when(F.col("gone"), "destroyed").when(F.col("got"), "collected").otherwise("open")
    return rows.groupBy("kind", state.alias("state")).agg(F.count("*").alias("n"))


def newest_save(spark: SparkSession, sf: str) -> DataFrame:
    """The newest event of every user, the smallest id among equals."""
    return windows.top(table(spark, sf, "events"), ["user_id"], [F.col("ts").desc(), F.col("event_id")], 1).select("user_id", "event_id", "event_type")


def manifest_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Two listings compared by key and digest: added, removed, changed."""
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("path"), F.sha2(F.concat_ws("|", F.col("o_custkey").cast("string"), "o_orderstatus"), 256).alias("sha"))
    before = orders.where("path % 10 <> 3")
    after = orders.where("path % 10 <> 4").withColumn("sha", F.when(F.col("path") % 17 == 0, F.lit("edited")).otherwise(F.col("sha")))
    both = before.withColumnRenamed("sha", "a").join(after.withColumnRenamed("sha", "b"), "path", "full")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return both.select("path", change.alias("change")).where("change IS NOT NULL")


QUERIES = {f.__name__: f for f in (
    socket_assignment_join, orphan_sockets_anti, unlock_grants, pool_bands, recipe_status, extractors_open_semi, schematic_costs_by_tier, unlock_text, inverse_recipes, resource_caps_outer_fill, extraction_segments, purity_weight_guard, bill_compose,
    item_flow_ledger, byproduct_disposition, fixed_route_ceiling, machine_counts_ceil, lane_decomposition, minimum_sufficient_mark, belt_lanes, consumer_shares, residual_coverage, clock_power_curve, power_need_generators, power_stack_allocation, supply_check,
    net_stock_owed_surplus, net_lanes_full_outer, pay_bootstrap, phase_rates, lag_table, pa_duration_banks, storage_fill, chain_boundary_draw, poi_state_counts, newest_save, manifest_diff,
)}

_CAPS = "cap AS (SELECT item::BIGINT AS item, sum(CASE purity WHEN 0 THEN 30.0::DOUBLE WHEN 1 THEN 60.0 ELSE 120.0 END * 1.5::DOUBLE * 0.9::DOUBLE) AS cap FROM socket GROUP BY 1)"
_LINES = "line AS (SELECT item, demand, per_machine FROM (SELECT l_partkey AS item, sum(l_quantity) / 8 AS demand FROM lineitem GROUP BY 1) JOIN (SELECT p_partkey AS item, 60.0::DOUBLE / (2 + p_size % 10) AS per_machine FROM part) USING (item)), mach AS (SELECT *, ceil(demand / per_machine - 1e-9::DOUBLE)::BIGINT AS machines FROM line)"
_LEDGER = """led AS (SELECT l_partkey AS item, coalesce(sum(l_quantity) FILTER (l_linestatus = 'F'), 0) AS produced, coalesce(sum(l_quantity) FILTER (l_linestatus = 'O'), 0) AS consumed, coalesce(sum(l_quantity) FILTER (l_returnflag = 'A'), 0) AS shipped, coalesce(sum(l_quantity) FILTER (l_returnflag = 'R'), 0) AS returned FROM lineitem GROUP BY 1),
ledger AS (SELECT *, produced - consumed - shipped + returned AS "left" FROM led)"""
_GEN = "gen AS (SELECT s_nationkey AS site, s_suppkey AS unit, 30.0::DOUBLE + s_suppkey % 7 * 20 AS mw FROM supplier)"
_NET = """net AS (SELECT coalesce(n.item, h.item) AS item, coalesce(need, 0) AS need, coalesce(have, 0) AS have FROM (SELECT l_partkey AS item, sum(l_quantity)::BIGINT AS need FROM lineitem WHERE l_partkey % 5 <> 0 GROUP BY 1) n
FULL JOIN (SELECT l_partkey AS item, (3 * sum(l_quantity))::BIGINT AS have FROM lineitem WHERE l_partkey % 3 <> 0 AND l_returnflag = 'R' GROUP BY 1) h ON n.item = h.item)"""

SQL = {
    "socket_assignment_join": sql("socket", "SELECT id, round(x, 3) AS x, round(y, 3) AS y, item, purity FROM socket"),
    "orphan_sockets_anti": sql("socket", "SELECT id, item FROM socket WHERE id % 37 = 0"),
    "unlock_grants": sql("schematic", 't AS (SELECT tier, count(*) AS own, min(id) AS first FROM schematic GROUP BY 1) SELECT tier, own, first, (SELECT sum(own) FROM t u WHERE u.tier <= t.tier)::BIGINT AS granted FROM t'),
    "pool_bands": "SELECT lower(replace(p_name || ' ' || p_partkey, ' ', '-')) AS slug, p_partkey AS id, greatest(p_size, p_partkey % 10)::INT AS top FROM part WHERE p_partkey % 13 = 0",
    "recipe_status": sql("schematic", f"SELECT recipe, CASE WHEN recipe % 41 = 0 THEN 'withheld' WHEN tier <= {TIER} THEN 'granted' WHEN recipe % 9 = 0 THEN 'declared' WHEN recipe % 7 = 0 THEN 'pool' ELSE 'later' END AS status FROM schematic"),
    "extractors_open_semi": f"SELECT 'Desc_' || s_suppkey AS descriptor, s_nationkey AS nation FROM supplier WHERE s_suppkey IN (SELECT p_partkey FROM part WHERE p_size % 10 <= {TIER})",
    "schematic_costs_by_tier": sql("schematic", "SELECT tier, kind, sum(l_quantity)::BIGINT AS units, count(DISTINCT id) AS schematics FROM lineitem JOIN schematic ON l_partkey = id GROUP BY 1, 2"),
    "unlock_text": sql("schematic", "SELECT id, CASE WHEN tier <> 9 THEN tier END AS tier, CASE WHEN tier <> 9 THEN kind END AS milestone FROM schematic"),
    "inverse_recipes": sql("item", "SELECT item + 2000000 AS recipe, item + 3000000 AS back FROM item WHERE form = 'liquid' AND item % 4 <> 0"),
    "resource_caps_outer_fill": sql("item socket", _CAPS + " SELECT i.item, round(coalesce(cap, 0), 4) AS cap FROM item i LEFT JOIN cap USING (item) WHERE raw"),
    "extraction_segments": sql("socket", "SELECT item, purity, count(*) AS n, round(sum(CASE purity WHEN 0 THEN 30.0::DOUBLE WHEN 1 THEN 60.0 ELSE 120.0 END * 1.5::DOUBLE), 4) AS rate, round(15.0::DOUBLE * power(1.5::DOUBLE, 1.321929::DOUBLE) * count(*), 4) AS mw FROM socket GROUP BY 1, 2"),
    "purity_weight_guard": sql("socket", "SELECT DISTINCT purity, CASE purity WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 1.0 ELSE 2.0 END AS weight FROM socket"),
    "bill_compose": sql("delivery schematic", "b AS (SELECT item, qty FROM delivery WHERE phase <= 3 UNION ALL SELECT l_partkey, l_quantity FROM lineitem WHERE l_partkey IN (SELECT id FROM schematic WHERE tier IN (1, 2))) SELECT item, sum(qty)::BIGINT AS units FROM b GROUP BY 1"),
    "item_flow_ledger": f"WITH {_LEDGER} SELECT * FROM ledger",
    "byproduct_disposition": sql("item", _LEDGER + """, w AS (SELECT l.item, form, "left", CASE WHEN raw THEN 'store' WHEN form = 'solid' THEN 'sink' WHEN form = 'liquid' AND l.item % 2 = 0 THEN 'package' WHEN form = 'gas' THEN 'burn' ELSE 'refuse' END AS way FROM ledger l JOIN item USING (item) WHERE "left" > 0.5)
SELECT item, form, "left", way, CASE WHEN way = 'sink' THEN "left" * (item % 12 + 1) ELSE 0.0 END AS points FROM w"""),
    "fixed_route_ceiling": sql("recipe_io edge item socket", _CAPS + """, x AS (SELECT parent AS target, child AS item, qty FROM edge UNION ALL SELECT x.target, e.child, x.qty * e.qty FROM x JOIN edge e ON e.parent = x.item),
room AS (SELECT target, i.item, coalesce(cap, 0) / sum(qty) AS room FROM x JOIN item i ON i.item = x.item LEFT JOIN cap c ON c.item = i.item WHERE raw AND i.item < 10 GROUP BY target, i.item, cap)
SELECT target, round(min(room), 4) AS scale, min(item) FILTER (room <= m) AS binding FROM (SELECT *, min(room) OVER (PARTITION BY target) AS m FROM room) GROUP BY 1""", True),
    "machine_counts_ceil": f"WITH {_LINES} SELECT item, demand, machines, CASE WHEN machines > 0 THEN round(100 * demand / (per_machine * machines), 4) END AS clock FROM mach",
    "lane_decomposition": f"WITH {_LINES}, l AS (SELECT item, machines, greatest(1, floor(120.0::DOUBLE / per_machine))::BIGINT AS per_lane FROM mach), n AS (SELECT *, ceil(machines / per_lane)::BIGINT AS lanes FROM l), e AS (SELECT *, unnest(range(1, lanes + 1)) AS lane FROM n) SELECT item, lane, machines // lanes + (lane <= machines % lanes)::INT AS lane_machines, per_lane FROM e",
    "minimum_sufficient_mark": f"WITH {_LINES}, m(mark, capacity) AS (VALUES {BELTS}), f AS (SELECT item, demand, (SELECT min(mark) FROM m WHERE capacity >= demand) AS mark FROM line), g AS (SELECT item, demand, coalesce(mark, 6) AS mark FROM f) SELECT item, mark, capacity::DOUBLE AS mark_capacity, capacity >= demand AS reaches FROM g JOIN m USING (mark)",
    "belt_lanes": f"WITH {_LINES}, m(mark, capacity) AS (VALUES {BELTS}), f AS (SELECT item, demand, greatest(1, ceil(demand / 1200.0::DOUBLE - 1e-9::DOUBLE))::BIGINT AS lanes FROM line) SELECT item, lanes, (SELECT min(mark) FROM m WHERE capacity >= demand / lanes) AS mark FROM f",
    "consumer_shares": "WITH d AS (SELECT l_partkey AS item, l_suppkey AS consumer, sum(l_quantity) AS draw FROM lineitem GROUP BY 1, 2) SELECT item, consumer, draw, draw / sum(draw) OVER (PARTITION BY item) AS share FROM d",
    "residual_coverage": f"WITH {_LINES}, r AS (SELECT item, round(machines * per_machine - demand, 6) AS residual FROM mach) SELECT item, residual, residual >= 2 - 1e-9::DOUBLE AS covered, CASE WHEN residual > 1e-6::DOUBLE THEN round(500 / residual, 3) END AS minutes FROM r",
    "clock_power_curve": "SELECT p_partkey AS item, clock::DOUBLE AS clock, round((4.0::DOUBLE + p_size % 30) * power(clock::DOUBLE / 100, 1.321929::DOUBLE), 4) AS power FROM part, (VALUES (50.0), (100.0), (150.0), (250.0)) v(clock)",
    "power_need_generators": f"WITH {_GEN} SELECT c_nationkey AS site, count(*) * 12.5::DOUBLE AS need, coalesce(max(have), 0) AS have, greatest(0, ceil((count(*) * 12.5::DOUBLE - coalesce(max(have), 0)) / 75.0::DOUBLE - 1e-9::DOUBLE))::BIGINT AS generators FROM customer LEFT JOIN (SELECT site, sum(mw) AS have FROM gen GROUP BY 1) ON site = c_nationkey GROUP BY 1",
    "power_stack_allocation": f"""WITH {_GEN}, n AS (SELECT c_nationkey AS site, count(*) * 1.5::DOUBLE AS need FROM customer GROUP BY 1),
r AS (SELECT site, unit, mw, need, coalesce(sum(mw) OVER (PARTITION BY site ORDER BY unit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(mw) OVER (PARTITION BY site) AS total FROM gen JOIN n USING (site))
SELECT site, unit, mw, greatest(0.0, least(mw, need - before)) AS taken, greatest(0.0, need - total) AS short FROM r""",
    "supply_check": f"WITH {_GEN}, n AS (SELECT site, sum(mw * 0.2::DOUBLE) AS need FROM gen GROUP BY 1), h AS (SELECT c_nationkey AS site, count(*) * 0.9::DOUBLE AS have FROM customer GROUP BY 1) SELECT site, round(need, 4) AS need, round(coalesce(have, 0), 4) AS have, CASE WHEN coalesce(have, 0) >= need THEN 'fed' ELSE 'short' END AS verdict FROM n LEFT JOIN h USING (site)",
    "net_stock_owed_surplus": f"WITH {_NET} SELECT item, need, have, greatest(need - have, 0) AS owed, greatest(have - need, 0) AS surplus FROM net",
    "net_lanes_full_outer": f"WITH {_NET} SELECT item, ceil(greatest(need - have, 0) / 100)::BIGINT AS build, least(need, have) AS keep, CASE WHEN need = 0 THEN have ELSE 0 END AS unbilled FROM net",
    "pay_bootstrap": f"WITH {_NET} SELECT item, least(have, need) AS paid, have - least(have, need) AS stock, greatest(need - have, 0) AS owed FROM net",
    "phase_rates": sql("delivery", "SELECT phase, item, round(qty / (max(qty) OVER (PARTITION BY phase) / 10), 6) AS rate, max(qty) OVER (PARTITION BY phase) / 10 AS minutes FROM delivery"),
    "lag_table": sql("delivery", "SELECT item, open::DOUBLE AS open, round(qty / (10 * (1 - open::DOUBLE)), 4) AS finish, round(10 / (1 - open::DOUBLE), 4) AS catch_up FROM delivery, (VALUES (0.1), (0.25), (0.5)) v(open) WHERE phase = 1"),
    "pa_duration_banks": sql("delivery", "f AS (SELECT phase, item, qty, 100.0::DOUBLE + item % 7 * 10 AS fill FROM delivery), m AS (SELECT phase, item, CASE WHEN qty <= 4 * fill THEN qty / 4 ELSE fill + (qty - 4 * fill) / 9 END AS minutes FROM f) SELECT phase, item, round(minutes, 4) AS minutes, round(max(minutes) OVER (PARTITION BY phase), 4) AS phase_minutes FROM m"),
    "storage_fill": sql("item", _LINES + " SELECT item, (24 * stack)::BIGINT AS capacity, round(24 * stack / (per_machine * 0.1::DOUBLE), 4) AS fill_minutes, round(least(1.0::DOUBLE, per_machine * 0.1::DOUBLE * 120 / (24 * stack)), 6) AS share FROM line JOIN item USING (item) WHERE form = 'solid'"),
    "chain_boundary_draw": sql("item recipe_io edge", "g AS (SELECT item FROM item WHERE form = 'gas') SELECT child AS item, round(sum(qty), 6) AS draw, count(*) AS users FROM edge WHERE parent IN (FROM g) AND child NOT IN (FROM g) GROUP BY 1"),
    "poi_state_counts": "SELECT p_type AS kind, CASE WHEN p_partkey % 6 = 0 THEN 'destroyed' WHEN p_partkey % 4 = 1 THEN 'collected' ELSE 'open' END AS state, count(*) AS n FROM part GROUP BY 1, 2",
    "newest_save": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) = 1",
    "manifest_diff": "WITH o AS (SELECT o_orderkey AS path, sha256(o_custkey || '|' || o_orderstatus) AS sha FROM orders), b AS (SELECT * FROM o WHERE path % 10 <> 3), a AS (SELECT path, CASE WHEN path % 17 = 0 THEN 'edited' ELSE sha END AS sha FROM o WHERE path % 10 <> 4), j AS (SELECT coalesce(b.path, a.path) AS path, CASE WHEN b.sha IS NULL THEN 'added' WHEN a.sha IS NULL THEN 'removed' WHEN a.sha <> b.sha THEN 'changed' END AS change FROM b FULL JOIN a ON a.path = b.path) SELECT * FROM j WHERE change IS NOT NULL",
}
