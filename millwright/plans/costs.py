"""Cost and scope queries: what sets of buildings, schematics and deliveries take, which sets of
recipes a tier enables, what plans leave over, and corridors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millwright.functions.scalars import half_away
from millwright.operators import corridors, graph, spatial, windows
from millwright.plans import domain as d
from millwright.plans.domain import sql
from millwright.session import table

TIER = 4


def building_costs(spark: SparkSession, sf: str) -> DataFrame:
    """Items that so many machines of each part cost to build."""
    machines = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("parent")).agg(F.ceil(F.sum("l_quantity") / 500).cast("long").alias("machines"))
    return machines.join(d.recipe_io(spark, sf), "parent").groupBy(F.col("child").alias("item")).agg(F.sum(F.col("machines") * F.col("amount")).cast("long").alias("cost"))


def unlock_cost(spark: SparkSession, sf: str) -> DataFrame:
    """Units that the schematics of the tiers up to one cost, by item form."""
    own = d.schematics(spark, sf).where(F.col("tier") <= TIER).select("id")
    cost = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("id"), "l_quantity").join(own, "id", "left_semi")
    return cost.join(d.items(spark, sf).withColumnRenamed("item", "id"), "id").groupBy("form").agg(F.sum("l_quantity").cast("long").alias("units"))


def assembly_cost(spark: SparkSession, sf: str) -> DataFrame:
    """Deliveries under a quarter of their size, rounded half away from zero, by phase."""
    rows = d.deliveries(spark, sf).withColumn("units", half_away(F.col("qty") * 0.25).cast("long"))
    return rows.groupBy("phase").agg(F.sum("units").alias("units"), F.max("units").alias("largest"))


def tier_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes of a tier's recipe sets and of what they share."""
    s = d.schematics(spark, sf)
    granted, declared, pool = (s.where(c).select("recipe") for c in (F.col("tier") <= TIER, F.col("recipe") % 9 == 0, F.col("recipe") % 7 == 0))
    enabled = granted.union(declared).distinct()
    sets = {"enabled": enabled, "pool_only": pool.exceptAll(enabled.intersect(pool)), "withheld": granted.where("recipe % 41 = 0"), "shared": granted.intersect(declared)}
    out = None
    for name, rows in sets.items():
        one = rows.agg(F.lit(name).alias("set"), F.count("*").alias("n"), F.min("recipe").alias("first"))
        out = one if out is None else out.unionByName(one)
    return out


def surplus_output(spark: SparkSession, sf: str) -> DataFrame:
    """What surplus machines would make over an hour, by output form."""
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("item")).agg(F.ceil(F.sum("l_quantity") / 300).cast("long").alias("standing"), F.ceil(F.sum(F.when(F.col("l_returnflag") == "N", F.col("l_quantity")).otherwise(0.0)) / 300).cast("long").alias("used"))
    rate = 60.0 / (2 + F.col("p_size") % 10)
    joined = rows.join(table(spark, sf, "part").select(F.col("p_partkey").alias("item"), rate.alias("rate")), "item").join(d.items(spark, sf), "item")
    return joined.where("standing > used").groupBy("form").agg(F.round(F.sum((F.col("standing") - F.col("used")) * F.col("rate") * 60), 3).alias("made"), F.count("*").alias("lines"))


def balance_check(spark: SparkSession, sf: str) -> DataFrame:
    """Declared demand of each item against what the other recipes draw of it."""
    declared = table(spark, sf, "part").select(F.col("p_partkey").alias("item"), (F.col("p_size") % 20).cast("double").alias("declared"))
    drawn = d.edges(spark, sf).groupBy(F.col("child").alias("item")).agg(F.sum("qty").alias("drawn"))
    rows = declared.join(drawn, "item", "left").na.fill({"drawn": 0.0})
    return rows.select("item", "declared", F.round("drawn", 4).alias("drawn"), F.round(F.col("declared") - F.col("drawn"), 4).alias("delta"))


def band_monotone(spark: SparkSession, sf: str) -> DataFrame:
    """Clusters in order with their largest tier so far, and whether it ever falls."""
    rows = d.schematics(spark, sf).groupBy((F.col("id") % 30).alias("cluster")).agg(F.max("tier").alias("band"))
    w = Window.orderBy("cluster")  # thirty rows
    return rows.select("cluster", "band", F.max("band").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("so_far"), F.coalesce(F.col("band") >= F.lag("band").over(w), F.lit(True)).alias("rises"))


def transfer_lanes(spark: SparkSession, sf: str) -> DataFrame:
    """Transfers by ordered pair of nations: solids as stacks a minute, fluids as cubic metres."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey", "l_quantity")
    order = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    cust, supp = table(spark, sf, "customer").select("c_custkey", "c_nationkey"), table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    rows = li.join(order, F.col("l_orderkey") == F.col("o_orderkey")).join(cust, F.col("o_custkey") == F.col("c_custkey")).join(supp, F.col("l_suppkey") == F.col("s_suppkey")).join(d.items(spark, sf), F.col("l_partkey") == F.col("item"))
    solid = F.sum(F.when(F.col("form") == "solid", F.col("l_quantity") / F.col("stack")))
    fluid = F.sum(F.when(F.col("form") != "solid", F.col("l_quantity")))
    return rows.groupBy(F.col("s_nationkey").alias("source"), F.col("c_nationkey").alias("target")).agg(F.round(F.coalesce(solid, F.lit(0.0)), 4).alias("stacks"), F.coalesce(fluid, F.lit(0.0)).cast("long").alias("fluid"))


def snap_to_valid(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest passable cell of each point that stands on a blocked one, within four cells."""
    cells = d.terrain(spark, sf).select("id", F.col("r").cast("double").alias("y"), F.col("c").cast("double").alias("x"), "z")
    blocked, valid = cells.where("z > 150").select("id", "x", "y"), cells.where("z < 20").select("id", "x", "y")
    rows = spatial.radius_join(blocked, valid, 4.0)
    return windows.top(rows, ["l_id"], [F.round(F.col("dist") * F.col("dist")), F.col("r_id")], 1).select(F.col("l_id").alias("id"), F.col("r_id").alias("cell"), F.round(F.col("dist") * F.col("dist")).cast("long").alias("d2"))


def corridor_graph(spark: SparkSession, sf: str) -> DataFrame:
    """Centre lines of open ground as edges with length and clearance, regions of 30 cells on."""
    cells = d.terrain(spark, sf).where("z < 90")
    label = graph.components(cells.select("id"), spatial.cell_edges(cells.select("id", "r", "c")))
    rows = cells.join(label.hint("merge"), "id").select(F.col("component").alias("region"), "r", "c")  # a row a cell, however well both compress
    big = rows.groupBy("region").count().where("count >= 30").select("region")
    out = corridors.corridor_edges(rows.join(big, "region"), "region")
    return out.select("region", "edge", "r0", "c0", "r1", "c1", *(F.round(k, 4).alias(k) for k in ("length", "narrowest", "median")))


QUERIES = {f.__name__: f for f in (building_costs, unlock_cost, assembly_cost, tier_sets, surplus_output, balance_check, band_monotone, transfer_lanes, snap_to_valid, corridor_graph)}

SQL = {
    "building_costs": sql("recipe_io", "m AS (SELECT l_partkey AS parent, ceil(sum(l_quantity) / 500)::BIGINT AS machines FROM lineitem GROUP BY 1) SELECT child AS item, sum(machines * amount)::BIGINT AS cost FROM m JOIN recipe_io USING (parent) GROUP BY 1"),
    "unlock_cost": sql("item schematic", f"SELECT form, sum(l_quantity)::BIGINT AS units FROM lineitem JOIN item ON l_partkey = item WHERE l_partkey IN (SELECT id FROM schematic WHERE tier <= {TIER}) GROUP BY 1"),
    "assembly_cost": sql("delivery", "u AS (SELECT phase, floor(qty * 0.25 + 0.5)::BIGINT AS units FROM delivery) SELECT phase, sum(units)::BIGINT AS units, max(units) AS largest FROM u GROUP BY 1"),
    "tier_sets": sql("schematic", f"""f AS (SELECT recipe, tier <= {TIER} AS g, recipe % 9 = 0 AS c, recipe % 7 = 0 AS p FROM schematic) SELECT 'enabled' AS "set", count(*) AS n, min(recipe) AS first FROM f WHERE g OR c
UNION ALL SELECT 'pool_only', count(*), min(recipe) FROM f WHERE p AND NOT (g OR c) UNION ALL SELECT 'withheld', count(*), min(recipe) FROM f WHERE g AND recipe % 41 = 0 UNION ALL SELECT 'shared', count(*), min(recipe) FROM f WHERE g AND c"""),
    "surplus_output": sql("item", "m AS (SELECT l_partkey AS item, ceil(sum(l_quantity) / 300)::BIGINT AS standing, ceil(coalesce(sum(l_quantity) FILTER (l_returnflag = 'N'), 0) / 300)::BIGINT AS used FROM lineitem GROUP BY 1) SELECT form, round(sum((standing - used) * (60.0::DOUBLE / (2 + p_size % 10)) * 60), 3) AS made, count(*) AS lines FROM m JOIN item USING (item) JOIN part ON p_partkey = m.item WHERE standing > used GROUP BY 1"),
    "balance_check": sql("recipe_io edge", "w AS (SELECT child, sum(qty) AS drawn FROM edge GROUP BY 1) SELECT p_partkey AS item, (p_size % 20)::DOUBLE AS declared, round(coalesce(drawn, 0), 4) AS drawn, round(p_size % 20 - coalesce(drawn, 0), 4) AS delta FROM part LEFT JOIN w ON child = p_partkey"),
    "band_monotone": sql("schematic", "b AS (SELECT id % 30 AS cluster, max(tier) AS band FROM schematic GROUP BY 1) SELECT cluster, band, max(band) OVER (ORDER BY cluster) AS so_far, coalesce(band >= lag(band) OVER (ORDER BY cluster), TRUE) AS rises FROM b"),
    "transfer_lanes": sql("item", "SELECT s_nationkey AS source, c_nationkey AS target, round(coalesce(sum(l_quantity / stack) FILTER (form = 'solid'), 0), 4) AS stacks, coalesce(sum(l_quantity) FILTER (form <> 'solid'), 0)::BIGINT AS fluid FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN item ON l_partkey = item GROUP BY 1, 2"),
    "snap_to_valid": sql("terrain", "p AS (SELECT a.id, b.id AS cell, (a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c) AS d2 FROM terrain a JOIN terrain b ON a.z > 150 AND b.z < 20 AND abs(a.r - b.r) <= 4 AND abs(a.c - b.c) <= 4) SELECT id, cell, d2 FROM p WHERE d2 <= 16 QUALIFY row_number() OVER (PARTITION BY id ORDER BY d2, cell) = 1"),
}
