"""Access queries: what a tier, a state or a site lets a plan use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millwright.functions.scalars import normalised
from millwright.operators import access, guards
from millwright.plans import domain as d
from millwright.plans.domain import sql
from millwright.plans.supply import MARKS, TIER
from millwright.session import table

LADDER = ", ".join(f"({m}, {c})" for m, c in MARKS)


def _buildings(spark: SparkSession, sf: str) -> DataFrame:
    """recipe, building: every third recipe makes a building."""
    return table(spark, sf, "part").where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("recipe"), F.concat(F.lit("Build_"), F.col("p_brand")).alias("building"))


def buildings_unlocked(spark: SparkSession, sf: str) -> DataFrame:
    """Buildings that the schematics up to a tier unlock."""
    s = d.schematics(spark, sf).withColumnRenamed("id", "schematic")
    return access.granted(s.select("schematic", "tier"), s.select("schematic", "recipe"), _buildings(spark, sf), F.col("tier") <= 1)


def _generator_classes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select(F.concat(F.lit("Gen_"), (F.col("s_suppkey") % 40).cast("string")).alias("class"), F.col("s_suppkey").alias("ord"), (F.col("s_suppkey") % 40).alias("part"))


def generators_open(spark: SparkSession, sf: str) -> DataFrame:
    """Generator classes that the tier opens, in the order in which they come, each once."""
    classes = _generator_classes(spark, sf)
    made = d.schematics(spark, sf).select(F.col("recipe").alias("part"), "tier")
    recipes = classes.select("class", "part").distinct().join(made, "part")
    return access.first_obtained(classes.select("class", "ord"), recipes, recipes.where(F.col("tier") <= TIER))


def generators_owned(spark: SparkSession, sf: str) -> DataFrame:
    """Fuel rows of the generators that each site owns: class, units, power and fuel a minute."""
    own = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("site"), F.concat(F.lit("Gen_"), (F.col("s_suppkey") % 7).cast("string")).alias("class"))
    fuels = spark.range(5).select(F.concat(F.lit("Gen_"), F.col("id").cast("string")).alias("class"), (30.0 + F.col("id") * 20).alias("mw"), (60.0 / (F.col("id") + 2)).alias("burn"))
    rows = guards.require_unique(fuels, ["class"], "two figures for one class")
    return own.join(F.broadcast(rows), "class").groupBy("site", "class").agg(F.count("*").alias("units"), F.sum("mw").alias("mw"), F.round(F.sum("burn"), 6).alias("burn"))  # five rows


def logistics_marks(spark: SparkSession, sf: str) -> DataFrame:
    """Marks by the milestone and tier that unlock them, each matched once; at every tier the
    highest and all in order."""
    marks = spark.createDataFrame(MARKS, "mark int, capacity double").select("mark", "capacity", (F.col("mark") + 1).alias("tier"), F.concat(F.lit("Belt "), F.col("mark").cast("string")).alias("milestone"))
    milestones = spark.range(1, 10).select((F.col("id") + 1).cast("int").alias("tier"), F.concat(F.lit("Belt "), F.col("id").cast("string")).alias("milestone"), (F.col("id") * 10).alias("schematic"))
    known = access.matched_once(marks, milestones, ["milestone", "tier"], "milestone")
    tiers = d.schematics(spark, sf).select(F.col("tier").alias("at")).distinct()
    open_ = tiers.join(F.broadcast(known), F.col("tier") <= F.col("at"))  # six rows
    return access.highest(open_, ["at"], "capacity").join(access.ladder(open_, ["at"], "capacity"), "at").select("at", "mark", "capacity", F.concat_ws(",", F.transform("marks", lambda x: x.cast("string"))).alias("marks"))


def producer_buildings(spark: SparkSession, sf: str) -> DataFrame:
    """The building of each producer class under its rewritten key; one without is refused."""
    part = table(spark, sf, "part")
    producers = part.select(F.col("p_partkey").alias("item"), F.concat(F.lit("Desc_"), F.lower("p_brand"), F.lit("_C")).alias("producer"))
    built = part.select(F.concat(F.lit("Build_"), F.lower("p_brand"), F.lit("_C")).alias("building")).distinct()
    rows = producers.withColumn("building", F.regexp_replace("producer", "^Desc_", "Build_"))
    guards.refuse(rows.join(built, "building", "left_anti"), "producer without a building", ["producer"])
    return rows.join(built, "building").select("item", "producer", "building")


def extractor_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Rate of each socket: by resource and purity, where there is such a row, else by purity."""
    loose = spark.createDataFrame([(0, 30.0), (1, 60.0), (2, 120.0)], "purity int, rate double")
    exact = d.sockets(spark, sf).where("item % 3 = 0").select("item", "purity").distinct().withColumn("rate", 25.0 * (F.col("purity") + 1) + F.col("item"))
    guards.require_unique(loose, ["purity"], "two rates")
    return access.with_fallback(d.sockets(spark, sf).select("id", "item", "purity"), guards.require_unique(exact, ["item", "purity"], "two rates"), loose, ["item", "purity"], ["purity"], "rate").select("id", "item", "rate")


def _options(spark: SparkSession, sf: str) -> DataFrame:
    """id, option, rate, mw, top: three extractors for each socket, dearer as they get faster."""
    steps = spark.createDataFrame([(1, 1.0, 5.0), (2, 2.0, 12.0), (3, 4.0, 30.0)], "option int, factor double, power double")
    at = d.sockets(spark, sf).select("id", F.when(F.col("purity") == 0, 30.0).when(F.col("purity") == 1, 60.0).otherwise(120.0).alias("base"), (F.col("id") % 200).cast("double").alias("draw"))
    rows = at.join(F.broadcast(steps))  # three rows
    return rows.select("id", "option", (F.col("base") * F.col("factor")).alias("rate"), F.col("power").alias("mw"), "draw", F.when(F.col("id") % 5 == 0, 12.0).otherwise(30.0).alias("top"))


def extractor_options(spark: SparkSession, sf: str) -> DataFrame:
    """Options of each socket in order of rate, and the highest."""
    rows = _options(spark, sf).where("mw <= top")
    return access.ladder(rows.withColumnRenamed("option", "mark"), ["id"], "rate").join(access.highest(rows.withColumnRenamed("option", "mark"), ["id"], "rate"), "id").select("id", F.concat_ws(",", F.transform("marks", lambda x: x.cast("string"))).alias("options"), F.col("mark").alias("highest"), "rate")


def extractor_step_down(spark: SparkSession, sf: str) -> DataFrame:
    """The slowest extractor that still meets each socket's draw."""
    return access.stepped_down(_options(spark, sf), ["id"], "draw", "top")


def _flags(spark: SparkSession, sf: str) -> DataFrame:
    s = d.schematics(spark, sf)
    return s.select("recipe", (F.col("tier") <= TIER).alias("granted"), (F.col("recipe") % 41 == 0).alias("withheld"), (F.col("recipe") % 7 == 0).alias("pool"))


def fuel_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Recipes that make a gas: whether each is held, and why not."""
    gas = d.items(spark, sf).where("form = 'gas' AND NOT raw").select(F.col("item").alias("recipe"))
    rows = gas.join(_flags(spark, sf), "recipe")
    reason = access.held_reason(F.col("recipe"), F.col("granted"), F.col("withheld"), F.col("pool"))
    return rows.select("recipe", reason.isNull().alias("held"), reason.alias("reason"))


def invalidating_unlocks(spark: SparkSession, sf: str) -> DataFrame:
    """Alternates that make an item without what its own recipe takes first."""
    io = d.recipe_io(spark, sf)
    alts = d.alternates(spark, sf)
    inputs = alts.select((F.col("parent") + 1000000).alias("recipe"), F.col("child").alias("item"))
    outputs = alts.select((F.col("parent") + 1000000).alias("recipe"), F.col("parent").alias("item"))
    return access.rivals(inputs, outputs, io.where("ord = 2").select(F.col("parent").alias("item"), F.col("child").alias("avoid")))


def phase_producers(spark: SparkSession, sf: str) -> DataFrame:
    """Each delivered item with the recipes that make it, their status and what unlocks them."""
    made = d.edges(spark, sf).select(F.col("parent").alias("item"), F.col("parent").alias("recipe")).distinct().unionByName(d.alternates(spark, sf).select(F.col("parent").alias("item"), (F.col("parent") + 1000000).alias("recipe")))  # both are unlocked with their item
    flags = d.schematics(spark, sf).select(F.col("recipe").alias("item"), "tier", "kind")
    rows = made.join(flags, "item")
    text = F.concat_ws(":", F.col("recipe").cast("string"), F.when(F.col("tier") <= TIER, "held").otherwise("later"), F.col("kind"))
    own = rows.withColumn("text", text).groupBy("item").agg(F.array_sort(F.collect_list(F.struct("recipe", "text"))).alias("all"))
    due = d.deliveries(spark, sf).where("phase = 1").select("item")
    return due.join(own, "item").select("item", F.concat_ws("; ", F.transform("all", lambda x: x["text"])).alias("producers"))


def playthrough_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Declared names as ids, each once; an unknown one is refused."""
    known = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), normalised(F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string"))).alias("key"), (F.col("p_size") % 10).alias("tier"))
    named = table(spark, sf, "part").where("p_partkey % 9 = 0").select(F.explode(F.array(F.concat_ws(" ", F.upper("p_name"), F.col("p_partkey").cast("string")), F.concat_ws("  ", "p_name", F.col("p_partkey").cast("string")))).alias("name"))
    keys = named.select(normalised(F.col("name")).alias("key")).distinct()
    guards.require_no_orphans(keys, known, ["key"], "unknown name")
    return known.join(keys, "key", "left_semi").groupBy("tier").agg(F.count("*").alias("n"), F.min("id").alias("first"))


def bus_partition(spark: SparkSession, sf: str) -> DataFrame:
    """Recipes of the buses as first declared, one for each item."""
    rows = d.recipe_io(spark, sf).select(F.col("parent").alias("item"), F.col("parent").alias("recipe"), "ord")
    return access.partitioned(rows, "ord")


def partition_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Consumers that no bus serves and served ones that are none."""
    consumers = d.recipe_io(spark, sf).select(F.col("child").alias("item"), F.col("parent").alias("consumer")).distinct()
    bus = consumers.where("(item + consumer) % 23 <> 0").unionByName(d.items(spark, sf).where("item % 50 = 7").select("item", (F.col("item") * 2 + 5000000).alias("consumer")))
    return access.covered(bus, consumers)


def socket_claims(spark: SparkSession, sf: str) -> DataFrame:
    """Sockets that several sites claim: a site claims what is near its own."""
    at = d.sockets(spark, sf)
    claims = at.select(F.col("id").alias("socket"), (F.col("item") % 4).cast("long").alias("site")).unionByName(at.where("z > 0").select(F.col("id").alias("socket"), (F.col("id") % 4).alias("site")))
    return access.claimed(claims).select("socket", F.concat_ws(",", F.transform("sites", lambda x: x.cast("string"))).alias("sites"))


def recipe_needs(spark: SparkSession, sf: str) -> DataFrame:
    """Earliest tier of each recipe over all schematics that give it; null where one is free.
    Schematics that come with another are owned by the one in their id."""
    part = table(spark, sf, "part")
    ids = part.select(F.concat(F.lit("S"), F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("_of_"), F.expr("p_partkey div 2").cast("string"))).otherwise("")).alias("sid"), F.col("p_partkey").alias("id"), (F.col("p_size") % 10).alias("tier"), F.expr("p_partkey div 3").alias("recipe"))
    owner = F.when(F.col("sid").contains("_of_"), F.regexp_extract("sid", r"_of_(\d+)$", 1).cast("long")).otherwise(F.col("id"))
    rows = ids.select("id", "recipe", owner.alias("owner")).join(ids.select(F.col("id").alias("owner"), F.col("tier")), "owner")
    return access.earliest(rows.select("recipe", "tier", (F.col("tier") == 0).alias("free")))


def tier_products(spark: SparkSession, sf: str) -> DataFrame:
    """What the recipes of a tier make that is no raw resource, in the items' order; power and
    amounts scaled."""
    held = d.schematics(spark, sf).where(F.col("tier") <= TIER).select(F.col("recipe").alias("item"))
    items = d.items(spark, sf).where("NOT raw").join(held, "item", "left_semi")
    first = d.recipe_io(spark, sf).groupBy(F.col("parent").alias("item")).agg(F.min(F.struct("ord", "child")).alias("m"))
    return items.join(first, "item").select("item", "form", F.col("m.child").alias("first_input"), (F.col("item") % 7 == 0).alias("alternate"), ((4.0 + F.col("item") % 9) * 1.5).alias("mw"))


def catalog_choices(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct choices with names, by kind: tiers, forms and resolutions on offer."""
    tiers = d.schematics(spark, sf).select(F.lit("tier").alias("kind"), F.col("tier").cast("string").alias("choice"))
    forms = d.items(spark, sf).select(F.lit("form").alias("kind"), F.col("form").alias("choice"))
    sizes = table(spark, sf, "part").select(F.lit("resolution").alias("kind"), (F.col("p_size") % 3 * 5).cast("string").alias("choice"))
    rows = tiers.unionByName(forms).unionByName(sizes)
    return rows.groupBy("kind", "choice").agg(F.count("*").alias("n"))


def poi_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """Places with the facts that some have: ids once, keys once, counts by kind."""
    places = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("kind"), F.concat(F.lit("k"), F.col("c_custkey").cast("string")).alias("key"))
    guards.require_unique(guards.require_unique(places, ["id"], "id twice"), ["key"], "key twice")
    facts = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("orders"), F.max(F.struct("o_orderdate", "o_orderkey"))["o_orderkey"].alias("last"))
    facts = facts.withColumn("snapped", F.col("orders") % 2 == 0)
    rows = places.join(facts, "id", "left")
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.count("orders").alias("with_facts"), F.count(F.when(F.col("snapped"), F.col("last"))).alias("snapped"), F.max(F.when(F.col("snapped"), F.col("last"))).alias("newest"))


def pod_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Flags by cell and leaf of each record's path: opened, looted."""
    rows = table(spark, sf, "events").select(F.concat_ws(".", F.lit("world"), (F.col("user_id") % 20).cast("string"), F.concat(F.lit("pod_"), (F.col("event_id") % 9).cast("string"))).alias("path"), (F.col("event_type") == "click").alias("opened"), (F.col("value") > 100).alias("looted"))
    part = F.split("path", "[.]")
    return rows.groupBy(F.element_at(part, 2).alias("cell"), F.element_at(part, -1).alias("leaf")).agg(F.bool_or("opened").alias("opened"), F.bool_or("looted").alias("looted"), F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    buildings_unlocked, generators_open, generators_owned, logistics_marks, producer_buildings, extractor_rates, extractor_options, extractor_step_down, fuel_sources, invalidating_unlocks, phase_producers, playthrough_sets, bus_partition, partition_gaps, socket_claims,
    recipe_needs, tier_products, catalog_choices, poi_catalog, pod_flags,
)}

_OPT = "opt AS (SELECT id, o AS option, CASE id % 3 WHEN 0 THEN 30.0::DOUBLE WHEN 1 THEN 60.0 ELSE 120.0 END * f AS rate, p::DOUBLE AS mw, (id % 200)::DOUBLE AS draw, CASE WHEN id % 5 = 0 THEN 12.0 ELSE 30.0 END AS top FROM socket, (VALUES (1, 1.0, 5.0), (2, 2.0, 12.0), (3, 4.0, 30.0)) v(o, f, p))"

SQL = {
    "buildings_unlocked": "SELECT DISTINCT 'Build_' || p_brand AS building FROM part WHERE p_partkey % 3 = 0 AND p_size % 10 <= 1",
    "generators_open": f"WITH c AS (SELECT s_suppkey % 40 AS k, min(s_suppkey) AS ord FROM supplier GROUP BY 1) SELECT 'Gen_' || k AS class, row_number() OVER (ORDER BY ord, 'Gen_' || k)::INT AS rank FROM c JOIN part ON p_partkey = k WHERE p_size % 10 <= {TIER}",
    "generators_owned": "SELECT s_nationkey AS site, 'Gen_' || s_suppkey % 7 AS class, count(*) AS units, count(*) * (30.0::DOUBLE + s_suppkey % 7 * 20) AS mw, round(count(*) * (60.0::DOUBLE / (s_suppkey % 7 + 2)), 6) AS burn FROM supplier WHERE s_suppkey % 7 < 5 GROUP BY s_nationkey, s_suppkey % 7",
    "logistics_marks": f"WITH m(mark, capacity) AS (VALUES {LADDER}) SELECT p_size % 10 AS at_, max(mark)::INT AS mark, max(capacity)::DOUBLE AS capacity, string_agg(DISTINCT mark::VARCHAR, ',' ORDER BY mark::VARCHAR) AS marks FROM part JOIN m ON mark + 1 <= p_size % 10 GROUP BY 1".replace("at_", '"at"'),
    "producer_buildings": "SELECT p_partkey AS item, 'Desc_' || lower(p_brand) || '_C' AS producer, 'Build_' || lower(p_brand) || '_C' AS building FROM part",
    "extractor_rates": sql("socket", "SELECT id, item, CASE WHEN item % 3 = 0 THEN 25.0::DOUBLE * (purity + 1) + item ELSE CASE purity WHEN 0 THEN 30.0 WHEN 1 THEN 60.0 ELSE 120.0 END END AS rate FROM socket"),
    "extractor_options": sql("socket", _OPT + " SELECT id, string_agg(option::VARCHAR, ',' ORDER BY rate) AS options, max(option)::INT AS highest, max(rate) AS rate FROM opt WHERE mw <= top GROUP BY 1"),
    "extractor_step_down": sql("socket", _OPT + " SELECT id, option::INT AS option, rate FROM opt WHERE rate >= draw AND mw <= top QUALIFY row_number() OVER (PARTITION BY id ORDER BY rate, option) = 1"),
    "fuel_sources": sql("item schematic", f"SELECT item AS recipe, tier <= {TIER} AND item % 41 <> 0 AS held, CASE WHEN tier <= {TIER} AND item % 41 <> 0 THEN NULL WHEN item % 41 = 0 THEN 'withheld' WHEN item % 7 = 0 THEN 'in the pool' ELSE 'unlocked later' END AS reason FROM item JOIN schematic ON recipe = item WHERE form = 'gas' AND NOT raw"),
    "invalidating_unlocks": sql("alternate", "SELECT parent AS item, parent + 1000000 AS recipe FROM alternate WHERE child <> parent // 3"),
    "phase_producers": sql("delivery schematic", f"""m AS (SELECT p_partkey AS item, p_partkey AS recipe FROM part WHERE p_partkey >= 25 UNION ALL SELECT p_partkey, p_partkey + 1000000 FROM part WHERE p_partkey >= 25 AND p_partkey % 7 = 0)
SELECT m.item, string_agg(m.recipe || ':' || CASE WHEN tier <= {TIER} THEN 'held' ELSE 'later' END || ':' || kind, '; ' ORDER BY m.recipe) AS producers FROM m JOIN schematic s ON s.id = m.item WHERE m.item IN (SELECT item FROM delivery WHERE phase = 1) GROUP BY 1"""),
    "playthrough_sets": "SELECT p_size % 10 AS tier, count(*) AS n, min(p_partkey) AS first FROM part WHERE p_partkey % 9 = 0 GROUP BY 1",
    "bus_partition": "SELECT p_partkey AS item, p_partkey AS recipe FROM part WHERE p_partkey >= 25",
    "partition_gaps": sql("recipe_io item", "c AS (SELECT DISTINCT child AS item, parent AS consumer FROM recipe_io) SELECT item, consumer, 'unserved' AS problem FROM c WHERE (item + consumer) % 23 = 0 UNION ALL SELECT item, item * 2 + 5000000, 'unknown' FROM item WHERE item % 50 = 7"),
    "socket_claims": sql("socket", "SELECT id AS socket, least(item % 4, id % 4) || ',' || greatest(item % 4, id % 4) AS sites FROM socket WHERE z > 0 AND item % 4 <> id % 4"),
    "recipe_needs": "WITH o AS (SELECT p_partkey // 3 AS recipe, CASE WHEN p_partkey % 4 = 1 THEN p_partkey // 2 ELSE p_partkey END AS owner FROM part) SELECT recipe, CASE WHEN NOT bool_or(p_size % 10 = 0) THEN min(p_size % 10) END AS tier FROM o JOIN part ON p_partkey = owner GROUP BY 1",
    "tier_products": sql("item schematic", f"SELECT item, form, item // 2 AS first_input, item % 7 = 0 AS alternate, (4.0::DOUBLE + item % 9) * 1.5 AS mw FROM item JOIN schematic ON recipe = item WHERE NOT raw AND tier <= {TIER}"),
    "catalog_choices": sql("item schematic", "SELECT 'tier' AS kind, tier::VARCHAR AS choice, count(*) AS n FROM schematic GROUP BY 2 UNION ALL SELECT 'form', form, count(*) FROM item GROUP BY 2 UNION ALL SELECT 'resolution', (p_size % 3 * 5)::VARCHAR, count(*) FROM part GROUP BY 2"),
    "poi_catalog": "WITH f AS (SELECT o_custkey AS id, count(*) AS orders, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last FROM orders GROUP BY 1) SELECT c_mktsegment AS kind, count(*) AS n, count(orders) AS with_facts, count(last) FILTER (orders % 2 = 0) AS snapped, max(last) FILTER (orders % 2 = 0) AS newest FROM customer LEFT JOIN f ON id = c_custkey GROUP BY 1",
    "pod_flags": "SELECT (user_id % 20)::VARCHAR AS cell, 'pod_' || event_id % 9 AS leaf, bool_or(event_type = 'click') AS opened, bool_or(value > 100) AS looted, count(*) AS n FROM events GROUP BY 1, 2",
}
