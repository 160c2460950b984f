"""Spatial queries: neighbourhoods, rasters, regions, components and paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millwright.functions.scalars import graded, shape_class, size_class, turn_steps
from millwright.operators import graph, spatial, windows
from millwright.plans import domain as d
from millwright.plans.domain import _CC, _LINKS, _PATHS, sql
from millwright.session import table

RADIUS = 50.0


def _near(spark: SparkSession, sf: str) -> DataFrame:
    at = d.sockets(spark, sf)
    return spatial.radius_join(at.select("id", "x", "y"), at.select("id", "x", "y", "item", "purity"), RADIUS)


def radius_neighborhoods(spark: SparkSession, sf: str) -> DataFrame:
    """Sockets with at least two others in reach: how many, of how many items, how far."""
    rows = _near(spark, sf).groupBy(F.col("l_id").alias("id")).agg(F.count("*").alias("n"), F.count_distinct("r_item").alias("items"), F.round(F.max("dist"), 4).alias("reach"))
    return rows.where("n >= 3")


def neighborhood_purity_counts(spark: SparkSession, sf: str) -> DataFrame:
    n = lambda p: F.count_if(F.col("r_purity") == p).alias(f"purity_{p}")
    return _near(spark, sf).groupBy(F.col("l_id").alias("id"), F.col("r_item").alias("item")).agg(n(0), n(1), n(2))


def topk_snap_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """The three nearest sockets of other items within reach, by distance and id."""
    rows = _near(spark, sf).where("l_id <> r_id")
    return windows.top(rows, ["l_id"], [F.round("dist", 6), F.col("r_id")], 3).select(F.col("l_id").alias("id"), "rank", F.col("r_id").alias("near"), F.round("dist", 4).alias("dist"))


def nearest_route_point(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest point of a route for each socket near it, and its detour class."""
    at = d.sockets(spark, sf)
    route = at.where("id % 25 = 0").select("id", "x", "y")
    rows = windows.top(spatial.radius_join(at.select("id", "x", "y"), route, 100.0), ["l_id"], [F.round("dist", 6), F.col("r_id")], 1)
    kind = graded(F.col("dist"), [(60.0, "detour"), (25.0, "near")], "on route")
    return rows.select(F.col("l_id").alias("id"), F.col("r_id").alias("point"), F.round("dist", 4).alias("dist"), kind.alias("kind"))


def single_link_deposits(spark: SparkSession, sf: str) -> DataFrame:
    """Sockets of one item linked at 40 or less, as components."""
    at = d.sockets(spark, sf).select("id", "x", "y", "item")
    pairs = spatial.radius_join(at, at, 40.0).where("l_id < r_id AND l_item = r_item").select(F.col("l_id").alias("a"), F.col("r_id").alias("b"))
    return graph.components(at.select("id"), pairs)


# Rasters ----------------------------------------------------------------------------------


def raster_block_stats(spark: SparkSession, sf: str) -> DataFrame:
    rows = spatial.block_stats(d.terrain(spark, sf), 10)
    return rows.select("br", "bc", "n", "valid", *(F.round(c, 4).alias(c) for c in ("least", "most", "mean", "median", "p90")))


def raster_box_mean(spark: SparkSession, sf: str) -> DataFrame:
    """Mean over a 7 x 7 square around each cell."""
    return spatial.box(d.terrain(spark, sf), 3).select("r", "c", "box_n", F.round(F.col("box_sum") / F.col("box_n"), 4).alias("mean"))


def footprint_relief(spark: SparkSession, sf: str) -> DataFrame:
    """Relief over a 5 x 5 square, where it is whole."""
    return spatial.box(d.terrain(spark, sf), 2).where("box_n = 25").select("r", "c", F.round(F.col("box_max") - F.col("box_min"), 4).alias("relief"))


def plane_clearance_window(spark: SparkSession, sf: str) -> DataFrame:
    """Platform height and clearance of every 4 x 3 footprint."""
    rows = spatial.footprint(d.terrain(spark, sf), 4, 3)
    return rows.select("r", "c", F.round("platform", 4).alias("platform"), F.round("clearance", 4).alias("clearance"), F.round("mean", 4).alias("mean"))


def best_placement(spark: SparkSession, sf: str) -> DataFrame:
    """Per cell the largest of three footprints whose clearance is at most 150, the lowest
    clearance among equals."""
    every = None
    for w, h in ((2, 2), (3, 2), (4, 3)):
        rows = spatial.footprint(d.terrain(spark, sf), w, h).where("clearance <= 150").select("r", "c", F.lit(w * h).alias("area"), F.round("clearance", 4).alias("clearance"))
        every = rows if every is None else every.unionByName(rows)
    return windows.top(every, ["r", "c"], [F.col("area").desc(), F.col("clearance")], 1).drop("rank")


def passability(spark: SparkSession, sf: str) -> DataFrame:
    """Grade by central difference and whether it can be passed."""
    rows = spatial.gradient(d.terrain(spark, sf), 5.0)
    return rows.select("r", "c", F.round("grade", 6).alias("grade"), (F.col("grade") <= 15).alias("passable"))


def elevation_band_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return d.terrain(spark, sf).groupBy(F.floor(F.col("z") / 25).cast("long").alias("band"), "kind").agg(F.count("*").alias("n"))


def regions_by_band(spark: SparkSession, sf: str) -> DataFrame:
    """4-connected regions of one band of 50: size and box, regions of two cells at least."""
    cells = d.terrain(spark, sf).withColumn("band", F.floor(F.col("z") / 50).cast("long"))
    label = graph.components(cells.select("id"), spatial.cell_edges(cells, ["band"]))
    rows = cells.join(label, "id").groupBy(F.col("component").alias("region"), "band").agg(F.count("*").alias("n"), F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1"))
    return rows.where("n >= 2")


def size_shape_classify(spark: SparkSession, sf: str) -> DataFrame:
    """Size and shape class of each region by the sides of its box."""
    rows = regions_by_band(spark, sf).select("region", (F.col("r1") - F.col("r0") + 1).alias("h"), (F.col("c1") - F.col("c0") + 1).alias("w"))
    size = size_class(F.greatest("h", "w"), F.least("h", "w"), [("large", 8, 4), ("medium", 4, 2), ("small", 2, 1)])
    return rows.select("region", "h", "w", size.alias("size"), shape_class(F.col("w").cast("double"), F.col("h").cast("double")).alias("shape"))


def label_adjacency_counts(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.borders(d.terrain(spark, sf), "kind")


def region_boundary(spark: SparkSession, sf: str) -> DataFrame:
    """Cells of high ground at its edge."""
    return spatial.boundary(d.terrain(spark, sf).where("z > 30"))


def row_delta_decode(spark: SparkSession, sf: str) -> DataFrame:
    """Whole heights decoded from row-wise differences."""
    cells = d.terrain(spark, sf).withColumn("h", F.floor("z").cast("long"))
    before = F.lag("h").over(Window.partitionBy("r").orderBy("c"))
    deltas = cells.select("r", "c", (F.col("h") - F.coalesce(before, F.lit(0))).alias("delta"))
    return spatial.decoded(deltas).select("r", "c", F.col("value").cast("long").alias("value"))


def _columns(spark: SparkSession, sf: str) -> DataFrame:
    return d.terrain(spark, sf).select((F.col("id") % 500).alias("cell"), "z")


def layer_gap_islands(spark: SparkSession, sf: str) -> DataFrame:
    """Layers of each column of heights, wherever two are more than 20 apart."""
    return windows.layered(_columns(spark, sf), ["cell"], "z", 20.0).select("cell", "layer", F.round("level", 4).alias("level"), "members")


def layer_clearance_lead(spark: SparkSession, sf: str) -> DataFrame:
    rows = windows.clearances(windows.layered(_columns(spark, sf), ["cell"], "z", 20.0), ["cell"], 40.0)
    return rows.select("cell", "layer", F.round("clearance", 4).alias("clearance"))


def run_lengths(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of one kind along the rows of the raster."""
    return windows.islands(d.terrain(spark, sf), ["r"], "c", "kind")


def band_crossings(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbours within a band: pairs of layers of adjoining columns at most 10 apart, the two
    nearest each way."""
    layers = windows.layered(_columns(spark, sf), ["cell"], "z", 20.0)
    a, b = layers.select("cell", F.col("layer").alias("la"), F.col("level").alias("za")), layers.select((F.col("cell") - 1).alias("cell"), F.col("layer").alias("lb"), F.col("level").alias("zb"))
    near = a.join(b, "cell").withColumn("dz", F.round(F.abs(F.col("za") - F.col("zb")), 6)).where("dz <= 10")
    one = windows.top(near, ["cell", "la"], [F.col("dz"), F.col("lb")], 2).select("cell", "la", "lb", "dz")
    two = windows.top(near, ["cell", "lb"], [F.col("dz"), F.col("la")], 2).select("cell", "la", "lb", "dz")
    return one.unionByName(two).distinct()


# Graphs -----------------------------------------------------------------------------------


def edge_aggregate_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return graph.pair_summary(d.trade(spark, sf), "cost")


def connected_components(spark: SparkSession, sf: str) -> DataFrame:
    """Customers linked by orders of one day and priority: components over the key's chain."""
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("cust"), F.concat_ws("/", F.col("o_orderdate").cast("date").cast("string"), "o_orderpriority").alias("k"), "o_orderkey")
    nxt = F.lead("cust").over(Window.partitionBy("k").orderBy("cust", "o_orderkey"))
    edges = orders.select(F.col("cust").alias("a"), nxt.alias("b")).where("b IS NOT NULL AND a <> b").distinct()
    return graph.components(orders.select(F.col("cust").alias("id")).distinct(), edges)


def shortest_paths_relax(spark: SparkSession, sf: str) -> DataFrame:
    """Least cost between all nations that trade lets one reach."""
    links = d.trade(spark, sf)
    return graph.shortest(links, links.select(F.col("a").alias("source")).distinct()).select("source", "node", "cost")


def path_segments_lag(spark: SparkSession, sf: str) -> DataFrame:
    """Events of each user as a route: lagged step, cumulative length, grade class."""
    at = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf, "events").select("user_id", "event_id", "ts", "value", F.lag("value").over(at).alias("before"))
    rows = rows.withColumn("rise", F.round(F.col("value") - F.coalesce("before", "value"), 4)).withColumn("length", F.round(F.sum(F.abs("rise")).over(at.rowsBetween(Window.unboundedPreceding, 0)), 3))
    return rows.select("user_id", "event_id", "rise", "length", graded(F.abs("rise"), [(100.0, "steep"), (20.0, "sloped")], "flat").alias("grade"))


def sizing_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Order in which items are sized: the longest way down from a part nothing else uses."""
    io = d.edges(spark, sf).select(F.col("parent").alias("a"), F.col("child").alias("b"))
    return graph.levels(io)


def turn_costs(spark: SparkSession, sf: str) -> DataFrame:
    """Turn between successive directions of each user's events."""
    at = Window.partitionBy("user_id").orderBy("ts", "event_id")
    way = F.floor(F.col("value")).cast("int") % 8
    rows = table(spark, sf, "events").select("user_id", "event_id", way.alias("way"), F.lag(way).over(at).alias("was"))
    return rows.select("user_id", "event_id", turn_steps(F.col("way"), F.col("was")).alias("turn"))


QUERIES = {f.__name__: f for f in (
    radius_neighborhoods, neighborhood_purity_counts, topk_snap_candidates, nearest_route_point, single_link_deposits, raster_block_stats, raster_box_mean, footprint_relief, plane_clearance_window, best_placement, passability, elevation_band_histogram,
    regions_by_band, size_shape_classify, label_adjacency_counts, region_boundary, row_delta_decode, layer_gap_islands, layer_clearance_lead, run_lengths, band_crossings, edge_aggregate_pairs, connected_components, shortest_paths_relax, path_segments_lag,
    sizing_levels, turn_costs,
)}

_NEAR = "near AS (SELECT l.id AS l_id, r.id AS r_id, r.item AS r_item, l.item AS l_item, r.purity AS r_purity, sqrt(power(l.x - r.x, 2) + power(l.y - r.y, 2)) AS dist FROM socket l JOIN socket r ON abs(l.x - r.x) <= 100 AND abs(l.y - r.y) <= 100)"
_FOOT = "SELECT a.r, a.c, max(b.z) AS platform, max(b.z) - min(b.z) AS clearance, avg(b.z) AS mean FROM terrain a JOIN terrain b ON b.r BETWEEN a.r AND a.r + {h} - 1 AND b.c BETWEEN a.c AND a.c + {w} - 1 GROUP BY 1, 2 HAVING count(b.z) = {w} * {h}"
_LAYERS = """lay0 AS (SELECT id % 500 AS cell, z, CASE WHEN z - lag(z) OVER (PARTITION BY id % 500 ORDER BY z) <= 20 THEN 0 ELSE 1 END AS b FROM terrain),
lay1 AS (SELECT cell, z, sum(b) OVER (PARTITION BY cell ORDER BY z ROWS UNBOUNDED PRECEDING)::BIGINT AS layer FROM lay0), layers AS (SELECT cell, layer, median(z) AS level, count(*) AS members FROM lay1 GROUP BY 1, 2)"""
_REACH = """reach AS (SELECT id AS a, id AS b FROM node UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b)"""

_REGIONS = """cell AS (SELECT id, r, c, floor(z / 50)::BIGINT AS band FROM terrain), node AS (SELECT id FROM cell),
link AS (SELECT x.id AS a, y.id AS b FROM cell x JOIN cell y ON x.band = y.band AND (x.r = y.r AND abs(x.c - y.c) = 1 OR x.c = y.c AND abs(x.r - y.r) = 1)),
""" + _CC + """, regions AS (SELECT comp AS region, band, r, c FROM cell JOIN cc USING (id))"""

SQL = {
    "radius_neighborhoods": sql("socket", _NEAR + " SELECT l_id AS id, count(*) AS n, count(DISTINCT r_item) AS items, round(max(dist), 4) AS reach FROM near WHERE dist <= 50 GROUP BY 1 HAVING count(*) >= 3"),
    "neighborhood_purity_counts": sql("socket", _NEAR + " SELECT l_id AS id, r_item AS item, count(*) FILTER (r_purity = 0) AS purity_0, count(*) FILTER (r_purity = 1) AS purity_1, count(*) FILTER (r_purity = 2) AS purity_2 FROM near WHERE dist <= 50 GROUP BY 1, 2"),
    "topk_snap_candidates": sql("socket", _NEAR + ", k AS (SELECT *, row_number() OVER (PARTITION BY l_id ORDER BY round(dist, 6), r_id) AS rank FROM near WHERE dist <= 50 AND l_id <> r_id) SELECT l_id AS id, rank, r_id AS near, round(dist, 4) AS dist FROM k WHERE rank <= 3"),
    "nearest_route_point": sql("socket", _NEAR + ", k AS (SELECT *, row_number() OVER (PARTITION BY l_id ORDER BY round(dist, 6), r_id) AS rank FROM near WHERE dist <= 100 AND r_id % 25 = 0) SELECT l_id AS id, r_id AS point, round(dist, 4) AS dist, CASE WHEN dist >= 60 THEN 'detour' WHEN dist >= 25 THEN 'near' ELSE 'on route' END AS kind FROM k WHERE rank = 1"),
    "single_link_deposits": sql("socket", _NEAR + ", node AS (SELECT id FROM socket), link AS (SELECT l_id AS a, r_id AS b FROM near WHERE dist <= 40 AND l_item = r_item AND l_id <> r_id), " + _REACH + " SELECT a AS id, min(b) AS component FROM reach GROUP BY 1", True),
    "regions_by_band": sql("terrain", _REGIONS + " SELECT region, band, count(*) AS n, min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1 FROM regions GROUP BY 1, 2 HAVING count(*) >= 2", True),
    "size_shape_classify": sql("terrain", _REGIONS + """, b AS (SELECT region, max(r) - min(r) + 1 AS h, max(c) - min(c) + 1 AS w FROM regions GROUP BY 1 HAVING count(*) >= 2)
SELECT region, h, w, CASE WHEN greatest(h, w) >= 8 AND least(h, w) >= 4 THEN 'large' WHEN greatest(h, w) >= 4 AND least(h, w) >= 2 THEN 'medium' WHEN greatest(h, w) >= 2 AND least(h, w) >= 1 THEN 'small' ELSE 'none' END AS size,
CASE WHEN greatest(h, w) / least(h, w) < 1.5 THEN 'compact' WHEN greatest(h, w) / least(h, w) < 3 THEN 'oblong' ELSE 'strip' END AS shape FROM b""", True),
    "connected_components": sql("", _LINKS + " SELECT id, comp AS component FROM cc", True),
    "raster_block_stats": sql("terrain", "SELECT r // 10 AS br, c // 10 AS bc, count(*) AS n, count(z) AS valid, round(min(z), 4) AS least, round(max(z), 4) AS most, round(avg(z), 4) AS mean, round(median(z), 4) AS median, round(quantile_cont(z, 0.9), 4) AS p90 FROM terrain GROUP BY 1, 2"),
    "raster_box_mean": sql("terrain", "SELECT a.r, a.c, count(b.z) AS box_n, round(sum(b.z) / count(b.z), 4) AS mean FROM terrain a JOIN terrain b ON b.r BETWEEN a.r - 3 AND a.r + 3 AND b.c BETWEEN a.c - 3 AND a.c + 3 GROUP BY 1, 2"),
    "footprint_relief": sql("terrain", "SELECT a.r, a.c, round(max(b.z) - min(b.z), 4) AS relief FROM terrain a JOIN terrain b ON b.r BETWEEN a.r - 2 AND a.r + 2 AND b.c BETWEEN a.c - 2 AND a.c + 2 GROUP BY 1, 2 HAVING count(b.z) = 25"),
    "plane_clearance_window": sql("terrain", "f AS (" + _FOOT.format(w=4, h=3) + ") SELECT r, c, round(platform, 4) AS platform, round(clearance, 4) AS clearance, round(mean, 4) AS mean FROM f"),
    "best_placement": sql("terrain", "f AS (" + " UNION ALL ".join(f"SELECT r, c, {w * h} AS area, round(clearance, 4) AS clearance FROM ({_FOOT.format(w=w, h=h)})" for w, h in ((2, 2), (3, 2), (4, 3))) + ") SELECT r, c, area, clearance FROM f WHERE clearance <= 150 QUALIFY row_number() OVER (PARTITION BY r, c ORDER BY area DESC, clearance) = 1"),
    "passability": sql("terrain", """g AS (SELECT a.r, a.c, sqrt(power((s.z - n.z) / 10, 2) + power((e.z - w.z) / 10, 2)) AS grade FROM terrain a LEFT JOIN terrain n ON n.r = a.r - 1 AND n.c = a.c LEFT JOIN terrain s ON s.r = a.r + 1 AND s.c = a.c LEFT JOIN terrain w ON w.r = a.r AND w.c = a.c - 1 LEFT JOIN terrain e ON e.r = a.r AND e.c = a.c + 1)
SELECT r, c, round(grade, 6) AS grade, grade <= 15 AS passable FROM g"""),
    "elevation_band_histogram": sql("terrain", "SELECT floor(z / 25)::BIGINT AS band, kind, count(*) AS n FROM terrain GROUP BY 1, 2"),
    "label_adjacency_counts": sql("terrain", "p AS (SELECT a.kind AS k, b.kind AS o, 1 AS across FROM terrain a JOIN terrain b ON b.r = a.r AND b.c = a.c + 1 UNION ALL SELECT a.kind, b.kind, 0 FROM terrain a JOIN terrain b ON b.r = a.r + 1 AND b.c = a.c) SELECT least(k, o) AS a, greatest(k, o) AS b, sum(across)::BIGINT AS across, sum(1 - across)::BIGINT AS along, count(*) AS n FROM p WHERE k <> o GROUP BY 1, 2"),
    "region_boundary": sql("terrain", "h AS (SELECT r, c FROM terrain WHERE z > 30) SELECT r, c FROM h a WHERE (SELECT count(*) FROM h b WHERE abs(b.r - a.r) + abs(b.c - a.c) = 1) < 4"),
    "row_delta_decode": sql("terrain", "SELECT r, c, floor(z)::BIGINT AS value FROM terrain"),
    "layer_gap_islands": sql("terrain", _LAYERS + " SELECT cell, layer, round(level, 4) AS level, members FROM layers"),
    "layer_clearance_lead": sql("terrain", _LAYERS + ", g AS (SELECT cell, layer, lead(level) OVER (PARTITION BY cell ORDER BY layer) - level AS gap FROM layers) SELECT cell, layer, CASE WHEN gap >= 40 THEN round(gap, 4) END AS clearance FROM g"),
    "run_lengths": sql("terrain", "b AS (SELECT r, c, kind, CASE WHEN kind = lag(kind) OVER (PARTITION BY r ORDER BY c) THEN 0 ELSE 1 END AS s FROM terrain), g AS (SELECT r, c, kind, sum(s) OVER (PARTITION BY r ORDER BY c ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM b) SELECT r, run, kind, min(c) AS first, max(c) AS last, count(*) AS n FROM g GROUP BY 1, 2, 3"),
    "band_crossings": sql("terrain", _LAYERS + """, n AS (SELECT a.cell, a.layer AS la, b.layer AS lb, round(abs(a.level - b.level), 6) AS dz FROM layers a JOIN layers b ON b.cell = a.cell + 1 WHERE abs(a.level - b.level) <= 10),
k AS (SELECT *, row_number() OVER (PARTITION BY cell, la ORDER BY dz, lb) AS x, row_number() OVER (PARTITION BY cell, lb ORDER BY dz, la) AS y FROM n) SELECT cell, la, lb, dz FROM k WHERE x <= 2 OR y <= 2"""),
    "edge_aggregate_pairs": sql("trade", "SELECT least(a, b) AS a, greatest(a, b) AS b, count(*) AS n, min(cost) AS least, max(cost) AS most, sum(cost) AS total FROM trade GROUP BY 1, 2"),
    "shortest_paths_relax": sql("trade", _PATHS + " SELECT source, node, cost FROM p", True),
    "path_segments_lag": "WITH e AS (SELECT user_id, event_id, ts, value, round(value - coalesce(lag(value) OVER w, value), 4) AS rise FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id, event_id, rise, round(sum(abs(rise)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 3) AS length, CASE WHEN abs(rise) >= 100 THEN 'steep' WHEN abs(rise) >= 20 THEN 'sloped' ELSE 'flat' END AS grade FROM e",
    "sizing_levels": sql("recipe_io", "w AS (SELECT DISTINCT parent AS node, 0 AS level FROM recipe_io UNION SELECT DISTINCT child, 0 FROM recipe_io UNION SELECT i.child, w.level + 1 FROM w JOIN recipe_io i ON i.parent = w.node) SELECT node, max(level) AS level FROM w GROUP BY 1", True),
    "turn_costs": "WITH e AS (SELECT user_id, event_id, floor(value)::INT % 8 AS way, lag(floor(value)::INT % 8) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events) SELECT user_id, event_id, CASE WHEN was IS NOT NULL THEN least(abs(way - was) % 8, 8 - abs(way - was) % 8) END AS turn FROM e",
}
