"""Site queries: buses, clusters, rankings, patches, simulations and records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millwright.functions.scalars import leaf
from millwright.operators import graph, realization, spatial, windows
from millwright.plans import domain as d
from millwright.plans.domain import _CC, _LINKS, _PATHS, sql
from millwright.session import table


def _external(spark: SparkSession, sf: str) -> DataFrame:
    return d.targets(spark, sf).select(F.col("target").alias("item"), (2.0 + F.col("target") % 5).alias("rate"))


def _recipes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").where(F.col("p_partkey") >= d.RAW).select(F.col("p_partkey").alias("item"), (60.0 / (2 + F.col("p_size") % 10)).alias("per_machine"))


def bus_sizing(spark: SparkSession, sf: str) -> DataFrame:
    """Whole machines of every item that the targets need, from the targets down."""
    rows = realization.sized(_recipes(spark, sf), d.edges(spark, sf), _external(spark, sf))
    return rows.select("item", F.round("demand", 4).alias("demand"), "machines", F.round("residual", 4).alias("residual"))


def integral_lane_widths(spark: SparkSession, sf: str) -> DataFrame:
    draws = d.edges(spark, sf).groupBy(F.col("child").alias("item")).agg(F.array_sort(F.collect_set("qty")).alias("draws"))
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("item"), (F.col("p_size") % 6 + 1).cast("double").alias("rate")).join(draws, "item")
    wide = realization.integral_widths(rows, "rate", "draws")
    return wide.select("item", F.size("widths").alias("n"), F.array_min("widths").alias("least"))


def component_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """Components of customers ranked by size: total balance, and the commonest segment."""
    from millwright.plans.spatial import connected_components

    cust = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal", "c_mktsegment")
    rows = connected_components(spark, sf).join(cust, "id")
    seg = windows.top(rows.groupBy("component", "c_mktsegment").count(), ["component"], [F.col("count").desc(), F.col("c_mktsegment")], 1).select("component", F.col("c_mktsegment").alias("segment"))
    size = rows.groupBy("component").agg(F.count("*").alias("n"), F.round(F.sum(F.col("c_acctbal").cast("decimal(18,2)")), 2).cast("double").alias("balance"))
    first = size.orderBy(F.col("n").desc(), "component").limit(50)  # a sorted limit; the window sees fifty rows
    ranked = first.select("component", "n", "balance", F.row_number().over(Window.orderBy(F.col("n").desc(), "component")).alias("rank"))
    return ranked.join(seg, "component")


def sector_offsets(spark: SparkSession, sf: str) -> DataFrame:
    """Ids local to sectors made global: each sector starts after all before it. Sectors are summed
    in blocks of 1,024 first, so one row a block meets in a task."""
    cells = d.terrain(spark, sf).where("z > 20").withColumn("sector", F.floor(F.col("r") / 10).cast("long"))
    count = cells.groupBy("sector").agg(F.count("*").alias("n")).withColumn("block", F.floor(F.col("sector") / 1024).cast("long"))
    earlier = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = count.groupBy("block").agg(F.sum("n").alias("n")).select("block", earlier(Window.orderBy("block")).alias("before"))
    first = count.withColumn("inside", earlier(Window.partitionBy("block").orderBy("sector"))).join(blocks, "block").select("sector", (F.col("before") + F.col("inside")).alias("first"))
    local = F.row_number().over(Window.partitionBy("sector").orderBy("id")) - 1
    return cells.withColumn("local", local).join(first, "sector").select("id", (F.col("first") + F.col("local")).alias("global_id"))


def gateway_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Borders between two kinds of ground, clustered where cells touch, with their spread and
    a rank for each pair."""
    cells = d.terrain(spark, sf)
    right = cells.select("r", (F.col("c") - 1).alias("c"), F.col("kind").alias("o"), F.col("z").alias("oz"))
    cross = cells.join(right, ["r", "c"]).where("kind <> o").select("id", "r", "c", F.concat_ws("/", F.least("kind", "o"), F.greatest("kind", "o")).alias("pair"), F.abs(F.col("z") - F.col("oz")).alias("dz"))
    label = graph.components(cross.select("id"), spatial.cell_edges(cross, ["pair"]))
    rows = cross.join(label, "id").groupBy("pair", "component").agg(F.count("*").alias("n"), F.avg("dz").alias("mean"), F.median("dz").alias("median"), F.percentile("dz", F.lit(0.9)).alias("p90"), realization.principal_span("c", "r").alias("span"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("pair").orderBy(F.col("n").desc(), "component")))
    return ranked.select("pair", "component", "n", *(F.round(k, 4).alias(k) for k in ("mean", "median", "p90", "span")), "rank")


def corridor_alternatives(spark: SparkSession, sf: str) -> DataFrame:
    """Three ways from the first nation to the last, each avoiding those before it."""
    links = d.trade(spark, sf)
    a, b = links.agg(F.min("a"), F.max("b")).first()
    return realization.alternatives(links, a, b)


def distance_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Least cost from each of the first five nations to all others, one column a nation."""
    links = d.trade(spark, sf)
    best = graph.shortest(links, links.where("a < 5").select(F.col("a").alias("source")).distinct())
    wide = best.groupBy("node").pivot("source", [0, 1, 2, 3, 4]).agg(F.min("cost"))
    return wide.select("node", *(F.col(str(k)).alias(f"from_{k}") for k in range(5)))


def triangle_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Cells of 20 under triangles of three sockets each."""
    at = d.sockets(spark, sf).select(F.floor(F.col("id") / 3).cast("long").alias("id"), (F.col("id") % 3).alias("k"), "x", "y", "z")
    pick = lambda c, k: F.max(F.when(F.col("k") == k, F.col(c))).alias(f"{c}{k}")
    tri = at.groupBy("id").agg(*(pick(c, k) for c in "xyz" for k in range(3)))
    return realization.rasterized(tri, 20.0).select("id", "r", "c", F.round("z", 3).alias("z"))


def patched_raster(spark: SparkSession, sf: str) -> DataFrame:
    cells = d.terrain(spark, sf)
    patch = cells.where("c < 30").select("r", "c", (F.col("id") % 3 != 0).alias("known"), (F.col("id") % 2 == 0).alias("passable"), F.floor("z").cast("double").alias("floor"))
    return realization.patched(cells.select("r", "c", "z"), patch)


def dilated_mask(spark: SparkSession, sf: str) -> DataFrame:
    """High ground widened by two cells each way."""
    mask = d.terrain(spark, sf).withColumn("m", (F.col("z") > 200).cast("int"))
    return spatial.box(mask.select("r", "c", "m"), 2, "m").where("box_max = 1").select("r", "c")


def power_variants(spark: SparkSession, sf: str) -> DataFrame:
    """Least, mean and greatest power of machines whose power varies."""
    low, high = 4.0 + F.col("p_size"), 4.0 + 3 * F.col("p_size")
    each = F.array(F.struct(F.lit("min").alias("kind"), low.alias("mw")), F.struct(F.lit("mean").alias("kind"), ((low + high) / 2).alias("mw")), F.struct(F.lit("max").alias("kind"), high.alias("mw")))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("item"), F.explode(each).alias("e")).select("item", "e.kind", "e.mw")


def stock_simulation(spark: SparkSession, sf: str) -> DataFrame:
    """Minute by minute over two hours: need so far, stock left, and the start stock that would
    have lasted."""
    use = table(spark, sf, "events").select((F.col("event_id") % 120).alias("minute"), F.col("event_type").alias("item"), F.floor("value").cast("long").alias("need"))
    minutes = spark.range(120).select(F.col("id").alias("minute"))
    grid = minutes.join(F.broadcast(use.select("item").distinct())).join(use.groupBy("minute", "item").agg(F.sum("need").alias("need")), ["minute", "item"], "left").na.fill({"need": 0})
    at = Window.partitionBy("item").orderBy("minute").rowsBetween(Window.unboundedPreceding, 0)
    made = 60 * (F.col("minute") + 1)
    rows = grid.withColumn("spent", F.sum("need").over(at))
    return rows.select("item", "minute", "spent", (made - F.col("spent")).alias("stock"), F.max(F.greatest(F.lit(0), F.col("spent") - made)).over(at).alias("start_stock"))


def trade_cycles(spark: SparkSession, sf: str) -> DataFrame:
    """Nations by the set of nations that they reach and that reach them."""
    links = d.trade(spark, sf)
    reach = graph.shortest(links.select("a", "b", F.lit(1.0).alias("cost")), links.select(F.col("a").alias("source")).unionByName(links.select(F.col("b").alias("source"))).distinct()).select("source", "node")
    back = reach.select(F.col("node").alias("source"), F.col("source").alias("node"))
    return reach.join(back, ["source", "node"]).groupBy(F.col("source").alias("nation")).agg(F.min("node").alias("cycle"), F.count("*").alias("n"))


def why_not(spark: SparkSession, sf: str) -> DataFrame:
    """The first component in which two neighbouring plans differ, and how many items only one
    of them has."""
    sets = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_suppkey")).alias("items"), F.max("l_linestatus").alias("status"), F.count("*").alias("n"))
    nxt = sets.select((F.col("l_orderkey") - 1).alias("l_orderkey"), F.col("items").alias("i2"), F.col("status").alias("s2"), F.col("n").alias("n2"))
    both = sets.join(nxt, "l_orderkey")
    reason = F.when(F.col("status") != F.col("s2"), "status").when(F.col("n") != F.col("n2"), "count").when(F.col("items") != F.col("i2"), "items").otherwise("same")
    apart = F.size(F.array_except("items", "i2")) + F.size(F.array_except("i2", "items"))
    return both.select(F.col("l_orderkey").alias("plan"), reason.alias("reason"), apart.alias("apart"))


def speed_profiles(spark: SparkSession, sf: str) -> DataFrame:
    """Minutes along each user's events with speeds that rise and fall by steps."""
    steps = table(spark, sf, "events").select("user_id", "event_id", (5 + F.col("event_id") % 7).cast("double").alias("length"), (4 + F.floor("value") % 25).cast("double").alias("limit"))
    return realization.speed_profile(steps, "user_id", "event_id").select("user_id", F.round("minutes", 5).alias("minutes"), "length")


def obtained_order(spark: SparkSession, sf: str) -> DataFrame:
    """Kinds in the order in which their first part is unlocked."""
    first = d.schematics(spark, sf).groupBy("kind").agg(F.min(F.struct("tier", "id")).alias("f"))
    rows = first.select("kind", F.col("f.tier").alias("tier"), F.col("f.id").alias("id"))
    return rows.withColumn("rank", F.row_number().over(Window.orderBy("tier", "id")).cast("long"))  # one row a kind


def recipe_signatures(spark: SparkSession, sf: str) -> DataFrame:
    """Recipes that take the same set of inputs."""
    sets = d.recipe_io(spark, sf).groupBy("parent").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_set("child")), lambda x: x.cast("string"))).alias("inputs"))
    return sets.groupBy("inputs").agg(F.count("*").alias("n"), F.min("parent").alias("first")).where("n > 1")


def record_digests(spark: SparkSession, sf: str) -> DataFrame:
    """Canonical JSON records with their digests."""
    record = F.to_json(F.struct(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("key"), F.col("p_name").alias("name"), F.col("p_size").alias("size")))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("key"), record.alias("record"), F.sha2(record, 256).alias("sha256"), leaf(F.regexp_replace("p_name", " ", ".")).alias("leaf"))


def event_props(spark: SparkSession, sf: str) -> DataFrame:
    """Fields parsed out of JSON text under a schema."""
    props = F.from_json("props", "k LONG")
    return table(spark, sf, "events").select("event_id", props["k"].alias("k")).groupBy("k").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    bus_sizing, integral_lane_widths, component_ranking, sector_offsets, gateway_clusters, corridor_alternatives, distance_matrix, triangle_cells, patched_raster, dilated_mask, power_variants, stock_simulation, trade_cycles, why_not, speed_profiles, obtained_order,
    recipe_signatures, record_digests, event_props,
)}

LEVELS = 18


def _bus_sql() -> str:
    """Level by level, as recursion sees no sums: so many levels as parts below 25 * 2 ** LEVELS
    can have."""
    out = ["w AS (SELECT DISTINCT parent AS node, 0 AS level FROM recipe_io UNION SELECT DISTINCT child, 0 FROM recipe_io UNION SELECT i.child, w.level + 1 FROM w JOIN recipe_io i ON i.parent = w.node), lev AS (SELECT node, max(level) AS level FROM w GROUP BY 1), mk AS (SELECT p_partkey AS item, 60.0::DOUBLE / (2 + p_size % 10) AS per FROM part WHERE p_partkey >= 25)"]
    out.append("f0 AS (SELECT target AS item, 2.0::DOUBLE + target % 5 AS rate FROM target)")
    for k in range(LEVELS):
        out.append(f"r{k} AS MATERIALIZED (SELECT f.item, sum(rate) AS demand FROM f{k} f JOIN lev ON node = f.item WHERE level = {k} GROUP BY 1)")
        out.append(f"s{k} AS MATERIALIZED (SELECT r.item, demand, per, ceil(demand / per - 1e-9::DOUBLE)::BIGINT AS machines FROM r{k} r LEFT JOIN mk USING (item))")
        out.append(f"f{k + 1} AS MATERIALIZED (SELECT * FROM f{k} UNION ALL SELECT child, machines * per * qty FROM s{k} JOIN edge ON parent = item WHERE machines IS NOT NULL)")
    return ",\n".join(out) + " SELECT item, round(demand, 4) AS demand, machines, round(coalesce(machines * per, demand) - demand, 4) AS residual FROM (" + " UNION ALL ".join(f"SELECT * FROM s{k}" for k in range(LEVELS)) + ")"

SQL = {
    "integral_lane_widths": sql("recipe_io edge", """r AS (SELECT p_partkey AS item, (p_size % 6 + 1)::DOUBLE AS rate FROM part WHERE p_partkey IN (SELECT child FROM edge)), w AS (SELECT item, rate, unnest(range(1, 13)) AS w FROM r),
f AS (SELECT item, w FROM w WHERE NOT EXISTS (SELECT 1 FROM edge e WHERE e.child = w.item AND abs(w.w * w.rate / e.qty - round_even(w.w * w.rate / e.qty, 0)) > 1e-9))
SELECT r.item, count(w)::INT AS n, min(w)::INT AS least FROM r LEFT JOIN f USING (item) GROUP BY 1"""),
    "bus_sizing": sql("recipe_io edge target", _bus_sql(), True),
    "component_ranking": sql("", _LINKS + """,
m AS (SELECT comp AS component, c_acctbal, c_mktsegment FROM cc JOIN customer ON c_custkey = id),
s AS (SELECT component, c_mktsegment AS segment FROM m GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY component ORDER BY count(*) DESC, c_mktsegment) = 1),
z AS (SELECT component, count(*) AS n, sum(c_acctbal::DECIMAL(18,2))::DOUBLE AS balance, row_number() OVER (ORDER BY count(*) DESC, component) AS rank FROM m GROUP BY 1)
SELECT component, n, balance, rank, segment FROM z JOIN s USING (component) WHERE rank <= 50""", True),
    "gateway_clusters": sql("terrain", """x AS (SELECT a.id, a.r, a.c, least(a.kind, b.kind) || '/' || greatest(a.kind, b.kind) AS pair, abs(a.z - b.z) AS dz FROM terrain a JOIN terrain b ON b.r = a.r AND b.c = a.c + 1 WHERE a.kind <> b.kind),
node AS (SELECT id FROM x), link AS (SELECT i.id AS a, j.id AS b FROM x i JOIN x j ON i.pair = j.pair AND (i.r = j.r AND abs(i.c - j.c) = 1 OR i.c = j.c AND abs(i.r - j.r) = 1)), """ + _CC + """,
g AS (SELECT pair, comp AS component, count(*) AS n, avg(dz) AS mean, median(dz) AS median, quantile_cont(dz, 0.9) AS p90, var_pop(c) AS va, covar_pop(c, r) AS vb, var_pop(r) AS vc FROM x JOIN cc USING (id) GROUP BY 1, 2)
SELECT pair, component, n, round(mean, 4) AS mean, round(median, 4) AS median, round(p90, 4) AS p90, round(4 * sqrt(greatest(0, (va + vc) / 2 + sqrt(power((va - vc) / 2, 2) + vb * vb))), 4) AS span, row_number() OVER (PARTITION BY pair ORDER BY n DESC, component)::INT AS rank FROM g""", True),
    "speed_profiles": """WITH s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, (5 + event_id % 7)::DOUBLE AS length, least(30.0::DOUBLE, 4 + floor(value)::BIGINT % 25) AS v FROM events),
f AS (SELECT *, 4 * i + min(v - 4 * i) OVER (PARTITION BY user_id ORDER BY i) AS up FROM s), g AS (SELECT *, -6 * i + min(up + 6 * i) OVER (PARTITION BY user_id ORDER BY i DESC) AS speed FROM f)
SELECT user_id, round(sum(length / speed), 5) AS minutes, sum(length) AS length FROM g GROUP BY 1""",
    "sector_offsets": sql("terrain", "SELECT id, row_number() OVER (ORDER BY r // 10, id) - 1 AS global_id FROM terrain WHERE z > 20"),
    "distance_matrix": sql("trade", _PATHS + " SELECT node, " + ", ".join(f"min(cost) FILTER (source = {k}) AS from_{k}" for k in range(5)) + " FROM p WHERE source < 5 GROUP BY 1", True),
    "triangle_cells": sql("socket", """t AS (SELECT id // 3 AS id, """ + ", ".join(f"max({c}) FILTER (id % 3 = {k}) AS {c}{k}" for c in "xyz" for k in range(3)) + """ FROM socket GROUP BY 1),
g AS (SELECT *, unnest(range(floor(least(x0, x1, x2) / 20)::INT, floor(greatest(x0, x1, x2) / 20)::INT + 1)) AS c FROM t), h AS (SELECT *, unnest(range(floor(least(y0, y1, y2) / 20)::INT, floor(greatest(y0, y1, y2) / 20)::INT + 1)) AS r FROM g),
k AS (SELECT *, (y1 - y2) * (x0 - x2) + (x2 - x1) * (y0 - y2) AS area, (c + 0.5::DOUBLE) * 20 AS x, (r + 0.5::DOUBLE) * 20 AS y FROM h),
b AS (SELECT *, ((y1 - y2) * (x - x2) + (x2 - x1) * (y - y2)) / area AS a, ((y2 - y0) * (x - x2) + (x0 - x2) * (y - y2)) / area AS b FROM k WHERE area <> 0)
SELECT id, r, c, round(a * z0 + b * z1 + (1 - a - b) * z2, 3) AS z FROM b WHERE a >= 0 AND b >= 0 AND 1 - a - b >= 0"""),
    "patched_raster": sql("terrain", "SELECT r, c, CASE WHEN c < 30 AND id % 3 <> 0 THEN CASE WHEN id % 2 = 0 THEN floor(z) END ELSE z END AS z FROM terrain"),
    "dilated_mask": sql("terrain", "SELECT DISTINCT a.r, a.c FROM terrain a JOIN terrain b ON b.z > 200 AND abs(a.r - b.r) <= 2 AND abs(a.c - b.c) <= 2"),
    "power_variants": "SELECT p_partkey AS item, kind, CASE kind WHEN 'min' THEN 4.0::DOUBLE + p_size WHEN 'max' THEN 4.0::DOUBLE + 3 * p_size ELSE (4.0::DOUBLE + p_size + 4.0::DOUBLE + 3 * p_size) / 2 END AS mw FROM part, (VALUES ('min'), ('mean'), ('max')) v(kind)",
    "stock_simulation": """WITH u AS (SELECT event_id % 120 AS minute, event_type AS item, sum(floor(value)::BIGINT) AS need FROM events GROUP BY 1, 2),
g AS (SELECT m.minute, i.item, coalesce(need, 0) AS need FROM (SELECT unnest(range(120)) AS minute) m CROSS JOIN (SELECT DISTINCT item FROM u) i LEFT JOIN u ON u.minute = m.minute AND u.item = i.item),
s AS (SELECT item, minute, (sum(need) OVER (PARTITION BY item ORDER BY minute))::BIGINT AS spent FROM g)
SELECT item, minute, spent, 60 * (minute + 1) - spent AS stock, max(greatest(0, spent - 60 * (minute + 1))) OVER (PARTITION BY item ORDER BY minute) AS start_stock FROM s""",
    "trade_cycles": sql("trade", "l AS (SELECT a, b FROM trade), node AS (SELECT a AS id FROM l UNION SELECT b FROM l), reach AS (SELECT id AS a, id AS b FROM node UNION SELECT r.a, l.b FROM reach r JOIN l ON l.a = r.b) SELECT x.a AS nation, min(x.b) AS cycle, count(*) AS n FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a GROUP BY 1", True),
    "why_not": """WITH s AS (SELECT l_orderkey AS k, list_sort(list(DISTINCT l_suppkey)) AS items, max(l_linestatus) AS status, count(*) AS n FROM lineitem GROUP BY 1)
SELECT a.k AS plan, CASE WHEN a.status <> b.status THEN 'status' WHEN a.n <> b.n THEN 'count' WHEN a.items <> b.items THEN 'items' ELSE 'same' END AS reason, (len(a.items) + len(b.items) - 2 * len(list_intersect(a.items, b.items)))::INT AS apart FROM s a JOIN s b ON b.k = a.k + 1""",
    "obtained_order": sql("schematic", "f AS (SELECT kind, min((tier, id)) AS f FROM schematic GROUP BY 1) SELECT kind, f[1] AS tier, f[2] AS id, row_number() OVER (ORDER BY f) AS rank FROM f"),
    "recipe_signatures": sql("recipe_io", "s AS (SELECT parent, string_agg(DISTINCT child::VARCHAR, ',' ORDER BY child::VARCHAR) AS x, list_sort(list(DISTINCT child)) AS l FROM recipe_io GROUP BY 1) SELECT array_to_string(l, ',') AS inputs, count(*) AS n, min(parent) AS first FROM s GROUP BY 1 HAVING count(*) > 1"),
    "record_digests": """WITH r AS (SELECT p_partkey AS key, '{"brand":"' || p_brand || '","key":' || p_partkey || ',"name":"' || p_name || '","size":' || p_size || '}' AS record, p_name FROM part) SELECT key, record, sha256(record) AS sha256, list_last(string_split(p_name, ' ')) AS leaf FROM r""",
    "event_props": "SELECT (props->>'k')::BIGINT AS k, count(*) AS n FROM events GROUP BY 1",
}
