"""Ground queries: grids, planes, checks, crossings, anchors, coverage and routes as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millwright.functions import routes
from millwright.functions.scalars import shape_class, size_class
from millwright.operators import graph, ground, spatial, windows
from millwright.plans import domain as d
from millwright.plans.domain import _CC, sql
from millwright.session import table


def _grid(spark: SparkSession, sf: str) -> DataFrame:
    cells = d.terrain(spark, sf).withColumn("z", F.when(F.col("id") % 11 != 0, F.col("z")))
    return ground.obstruction_grid(cells, 5, 0.8)


def sweep_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Obstructions of blocks of five cells: how much is known, the top, the spread."""
    return _grid(spark, sf).select("br", "bc", F.round("valid", 4).alias("valid"), F.round("top", 4).alias("top"), F.round("spread", 4).alias("spread"), "usable")


def plane_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """How much of the grid each plane clears, and whether that ever falls."""
    planes = spark.range(0, 20).select((F.col("id") * 25.0).alias("plane"))
    return ground.planes_swept(_grid(spark, sf).where("usable"), planes).select("plane", "usable", "n", F.round("share", 6).alias("share"), "rises")


def plane_regions(spark: SparkSession, sf: str) -> DataFrame:
    """Regions of blocks below each of three planes: size, box, class and spread of heights."""
    planes = spark.createDataFrame([(1, 100.0), (2, 150.0), (3, 200.0)], "k int, plane double")
    rows = _grid(spark, sf).where("usable").join(F.broadcast(planes), F.col("top") <= F.col("plane"))  # three rows
    cells = rows.select((F.col("k") * 10000000 + F.col("br") * 20 + F.col("bc")).alias("id"), F.col("br").alias("r"), (F.col("k") * 1000 + F.col("bc")).alias("c"), "plane", "top")
    label = graph.components(cells.select("id"), spatial.cell_edges(cells.select("id", "r", "c")))
    out = cells.join(label, "id").groupBy("plane", F.col("component").alias("region")).agg(F.count("*").alias("n"), (F.max("r") - F.min("r") + 1).alias("h"), (F.max("c") - F.min("c") + 1).alias("w"), F.round(F.avg("top"), 4).alias("mean"), F.round(F.max("top"), 4).alias("most"))
    size = size_class(F.greatest("h", "w"), F.least("h", "w"), [("large", 4, 3), ("medium", 2, 2), ("small", 1, 1)])
    return out.withColumn("size", size).withColumn("shape", shape_class(F.col("w").cast("double"), F.col("h").cast("double")))


def calibration_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Each kind of ground held against thresholds: PASS or FAIL, and what fails."""
    rows = d.terrain(spark, sf).groupBy("kind").agg(F.count("*").alias("n"), F.avg("z").alias("mean"), F.max("z").alias("most"))
    result, why = ground.verdict({"count": F.col("n") >= 100, "mean": F.col("mean").between(40, 60), "most": F.col("most") <= 600})
    return rows.select("kind", result.alias("result"), why.alias("why"))


def route_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's route: FAIL over the steepest grade, WARN with too many steep steps."""
    at = Window.partitionBy("user_id").orderBy("event_id")
    steps = table(spark, sf, "events").select("user_id", F.abs(F.col("value") - F.lag("value").over(at)).alias("grade"))
    rows = steps.groupBy("user_id").agg(F.coalesce(F.max("grade"), F.lit(0.0)).alias("most"), F.count_if(F.col("grade") > 100).alias("steep"), F.count("*").alias("steps"))
    result, why = ground.verdict({"grade": F.col("most") <= 400}, {"steep": F.col("steep") * 4 <= F.col("steps")})
    return rows.select("user_id", F.round("most", 4).alias("most"), "steep", result.alias("result"), why.alias("why"))


def surface_variants(spark: SparkSession, sf: str) -> DataFrame:
    """Variants on offer by resolution and tolerance, each with its files and the newest."""
    rows = table(spark, sf, "part").select((F.col("p_size") % 3 * 5).alias("resolution"), (F.col("p_size") % 4).alias("tolerance"), F.col("p_partkey").alias("file"))
    return rows.groupBy("resolution", "tolerance").agg(F.count("*").alias("files"), F.max("file").alias("newest"))


def reverse_routes(spark: SparkSession, sf: str) -> DataFrame:
    """Every user's route from its end, with the way so far."""
    at = Window.partitionBy("user_id").orderBy("event_id")
    rows = table(spark, sf, "events").select("user_id", (F.row_number().over(at) - 1).alias("step"), F.col("event_id").alias("node"), (1.0 + F.col("event_id") % 5).alias("length"))
    rows = rows.withColumn("length", F.when(F.col("step") == 0, 0.0).otherwise(F.col("length")))
    return ground.reversed_route(rows, "user_id")


def _points(spark: SparkSession, sf: str) -> DataFrame:
    return d.sockets(spark, sf).select("id", "x", "y", "item", (F.col("purity") == 2).alias("primary"))


def resolved_anchors(spark: SparkSession, sf: str) -> DataFrame:
    """A cell for each anchor: primary ones near by first, then any, then none."""
    at = _points(spark, sf)
    return ground.anchored(at.where("item = 0"), at.where("item <> 0"), 80.0, 25.0)


def endpoint_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Cells of an anchor's surroundings that are clear and not under deep water, with their
    component, by distance."""
    at = _points(spark, sf)
    rows = spatial.radius_join(at.where("item = 1").select("id", "x", "y"), at.select("id", "x", "y", "item", "primary"), 60.0).where("l_id <> r_id")
    wet = routes.deep_water(F.col("r_item") == 2, F.when(F.col("r_primary"), 5.0), 3.0)
    rows = rows.where(~wet).withColumn("rank", F.row_number().over(Window.partitionBy("l_id").orderBy(F.round("dist", 6), "r_id")))
    return rows.select(F.col("l_id").alias("anchor"), F.col("r_id").alias("cell"), F.col("r_item").alias("component"), F.round("dist", 4).alias("dist"), "rank")


def region_crossings(spark: SparkSession, sf: str) -> DataFrame:
    """Steps between sectors of ten rows joined to regions by kind: crossings by pair of regions
    with the cheapest and the number."""
    cells = d.terrain(spark, sf).select("id", "r", "c", "z", "kind")
    edges = spatial.cell_edges(cells.select("id", "r", "c")).join(cells.select(F.col("id").alias("a"), F.col("z").alias("za")), "a").join(cells.select(F.col("id").alias("b"), F.col("z").alias("zb")), "b").select("a", "b", F.abs(F.col("za") - F.col("zb")).alias("grade"))
    rows = ground.crossings(edges, cells.select("id", F.concat_ws(":", F.floor(F.col("r") / 10).cast("string"), "kind").alias("label")))
    return rows.groupBy(F.least("label_a", "label_b").alias("a"), F.greatest("label_a", "label_b").alias("b")).agg(F.count("*").alias("n"), F.round(F.min("grade"), 7).alias("least"), F.round(F.avg("grade"), 7).alias("mean"))


def layer_edges(spark: SparkSession, sf: str) -> DataFrame:
    """By direction: edges between cells whose floors nearly meet, and portals where they do not."""
    cells = d.terrain(spark, sf).select("r", "c", "z")
    out = None
    for dr, dc in ((0, 1), (1, 0)):
        edges, doors = ground.portals(cells, cells, dr, dc, 20.0)
        rows = edges.agg(F.count("*").alias("edges"), F.round(F.avg(F.abs(F.col("z") - F.col("to_z"))), 6).alias("mean")).join(F.broadcast(doors.agg(F.count("*").alias("portals"), F.min(F.struct("r", "c"))["c"].alias("first"))))
        rows = rows.select(F.lit(f"{dr},{dc}").alias("direction"), "edges", "mean", "portals", "first")
        out = rows if out is None else out.unionByName(rows)
    return out


def window_shards(spark: SparkSession, sf: str) -> DataFrame:
    """Shards of the raster whose box meets a window, and the cells of theirs inside it."""
    cells = d.terrain(spark, sf).withColumn("shard", F.floor(F.col("r") / 16) * 10 + F.floor(F.col("c") / 16))
    boxes = cells.groupBy("shard").agg(F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1"))
    hit = boxes.where("r1 >= 10 AND r0 <= 45 AND c1 >= 20 AND c0 <= 60")
    inside = cells.where("r BETWEEN 10 AND 45 AND c BETWEEN 20 AND 60").groupBy("shard").agg(F.count("*").alias("cells"))
    return hit.join(inside, "shard", "left").select(F.col("shard").cast("long").alias("shard"), "r0", "r1", "c0", "c1", F.coalesce("cells", F.lit(0)).alias("cells"))


def pair_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """Box with a margin around the sockets of the two items of each pair of letters asked for."""
    rows = d.sockets(spark, sf).select(F.substring(F.lit("ABCDEFGHIJ"), (F.col("item") + 1).cast("int"), F.lit(1)).alias("letter"), "x", "y")
    asked = spark.createDataFrame([("AB",), ("CD",), ("AJ",)], "pair string").select("pair", F.explode(F.split("pair", "")).alias("letter")).where("letter <> ''")
    return rows.join(F.broadcast(asked), "letter").groupBy("pair").agg(*(F.round(f, 3).alias(n) for n, f in (("x0", F.min("x") - 50), ("x1", F.max("x") + 50), ("y0", F.min("y") - 50), ("y1", F.max("y") + 50))))


def path_pads(spark: SparkSession, sf: str) -> DataFrame:
    """How far each user's path leaves the box of its ends."""
    rows = table(spark, sf, "events").select("user_id", "event_id", F.col("value").alias("x"), (F.col("event_id") % 50).cast("double").alias("y"))
    ends = rows.groupBy("user_id").agg(F.min(F.struct("event_id", "x", "y")).alias("a"), F.max(F.struct("event_id", "x", "y")).alias("b"))
    steps = rows.join(ends, "user_id").select("user_id", "x", "y", F.col("a.x").alias("ax"), F.col("a.y").alias("ay"), F.col("b.x").alias("bx"), F.col("b.y").alias("by_"))
    return ground.path_excess(steps, "user_id").select("user_id", F.round("pad", 4).alias("pad"))


def ramp_components(spark: SparkSession, sf: str) -> DataFrame:
    """Components of ground under three limits of grade: how many, and the largest."""
    cells = d.terrain(spark, sf).select("id", "r", "c", "z")
    edges = spatial.cell_edges(cells.select("id", "r", "c")).join(cells.select(F.col("id").alias("a"), F.col("z").alias("za")), "a").join(cells.select(F.col("id").alias("b"), F.col("z").alias("zb")), "b").select("a", "b", F.abs(F.col("za") - F.col("zb")).alias("grade"))
    limits = spark.createDataFrame([(1, 5.0), (2, 10.0), (3, 20.0)], "k int, limit double")
    span = 1 << 40
    keyed = lambda c: F.col("k") * span + F.col(c)
    nodes = cells.select("id").join(F.broadcast(limits)).select(keyed("id").alias("id"))  # three rows
    kept = edges.join(F.broadcast(limits), F.col("grade") <= F.col("limit")).select(keyed("a").alias("a"), keyed("b").alias("b"))
    size = graph.components(nodes, kept).groupBy((F.expr(f"component div {span}")).alias("k"), "component").count()
    return size.groupBy("k").agg(F.count("*").alias("n"), F.max("count").alias("largest")).select(F.col("k").cast("int").alias("k"), "n", "largest")


def painted_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Cells under the clear footprints of 3 x 2, the least clearance first: how many cells each of
    ten labels keeps."""
    foot = spatial.footprint(d.terrain(spark, sf), 3, 2).where("clearance <= 40")
    rows = foot.select("r", "c", F.lit(2).alias("height"), F.lit(3).alias("width"), ((F.col("r") + F.col("c")) % 10).alias("label"), F.struct(F.round("clearance", 6).alias("k"), "r", "c").alias("order"))
    return ground.painted(rows, "order").groupBy("label").agg(F.count("*").alias("cells"), F.min("r").alias("first"))


def zone_seeds(spark: SparkSession, sf: str) -> DataFrame:
    """The highest cell of each key in a disc around a hub, and the disc's own least and most."""
    cells = d.terrain(spark, sf).where("(r - 40L) * (r - 40) + (c - 50) * (c - 50) <= 900")  # on longs, as rows are many
    seed = cells.groupBy((F.floor(F.col("r") / 8) * 20 + F.floor(F.col("c") / 8)).cast("long").alias("key")).agg(F.max(F.struct(F.round("z", 6).alias("z"), (-F.col("id")).alias("no"))).alias("m"), F.count("*").alias("n"))
    return seed.select("key", (-F.col("m.no")).alias("seed"), F.col("m.z").alias("z"), "n")


def footprint_passable(spark: SparkSession, sf: str) -> DataFrame:
    """Cells on whose 3 x 3 surroundings, whole and each within 60 of the cell, a vehicle fits."""
    rows = spatial.box(d.terrain(spark, sf), 1)
    ok = (F.col("box_n") == 9) & (F.col("box_max") - F.col("z") <= 60) & (F.col("z") - F.col("box_min") <= 60)
    return rows.select("r", "c", ok.alias("fits"))


def representative_heights(spark: SparkSession, sf: str) -> DataFrame:
    """One height for each block at three resolutions: the median of what is known."""
    sizes = spark.createDataFrame([(4,), (8,), (16,)], "size int")
    cells = d.terrain(spark, sf).join(F.broadcast(sizes))  # three rows
    return cells.groupBy("size", F.floor(F.col("r") / F.col("size")).cast("long").alias("br"), F.floor(F.col("c") / F.col("size")).cast("long").alias("bc")).agg(F.round(F.median("z"), 4).alias("z"), F.count("*").alias("n"))


def overlay_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Corners of the quads over low ground of some kinds, a little above it."""
    rows = d.terrain(spark, sf).where(F.col("kind").isin("click", "view") & (F.col("z") < 40))
    return rows.select("id", (F.col("c") * 5.0).alias("x0"), (F.col("c") * 5.0 + 5).alias("x1"), (F.col("r") * 5.0).alias("y0"), (F.col("r") * 5.0 + 5).alias("y1"), F.round(F.col("z") + 0.5, 4).alias("z"))


def pair_routes(spark: SparkSession, sf: str) -> DataFrame:
    """Links both ways, found without bridges where that goes and with them where not."""
    links = d.trade(spark, sf)
    tries = links.select("a", "b", F.lit(1).alias("policy"), F.col("cost"), (F.col("cost") <= 40).alias("found")).unionByName(links.select("a", "b", F.lit(2).alias("policy"), (F.col("cost") * 2).alias("cost"), F.lit(True).alias("found")))
    best = ground.first_success(tries, ["a", "b"], "policy", "found")
    return ground.directed(best, "a", "b").select("a", "b", "policy", "cost", "solved")


def long_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Longest run of low cells in each row of at least three."""
    cells = d.terrain(spark, sf).withColumn("low", F.col("z") < 60)
    runs = windows.islands(cells, ["r"], "c", "low").where("low AND n >= 3")
    return runs.groupBy("r").agg(F.max(F.struct("n", (-F.col("first")).alias("no"), "last")).alias("m")).select("r", (-F.col("m.no")).alias("first"), F.col("m.last").alias("last"), F.col("m.n").alias("n"))


QUERIES = {f.__name__: f for f in (
    sweep_grid, plane_sweep, plane_regions, calibration_checks, route_checks, surface_variants, reverse_routes, resolved_anchors, endpoint_candidates, region_crossings, layer_edges, window_shards, pair_bounds, path_pads, ramp_components, painted_coverage, zone_seeds,
    footprint_passable, representative_heights, overlay_cells, pair_routes, long_runs,
)}

_GRID = "t AS (SELECT r, c, CASE WHEN id % 11 <> 0 THEN z END AS z FROM terrain), grid AS (SELECT r // 5 AS br, c // 5 AS bc, count(z) / 25 AS valid, max(z) AS top, max(z) - min(z) AS spread, count(z) / 25 >= 0.8::DOUBLE AS usable FROM t GROUP BY 1, 2)"
_STEPS = "e AS (SELECT a.id AS a, b.id AS b, abs(a.z - b.z) AS grade, a.r AS ar, a.kind AS ak, b.r AS br, b.kind AS bk FROM terrain a JOIN terrain b ON (b.r = a.r AND b.c = a.c + 1) OR (b.c = a.c AND b.r = a.r + 1))"

SQL = {
    "sweep_grid": sql("terrain", _GRID + " SELECT br, bc, round(valid, 4) AS valid, round(top, 4) AS top, round(spread, 4) AS spread, usable FROM grid"),
    "plane_sweep": sql("terrain", _GRID + ", p AS (SELECT k * 25.0::DOUBLE AS plane FROM range(20) t(k)), n AS (SELECT plane, count(*) FILTER (top <= plane) AS usable, count(*) AS n FROM grid, p WHERE usable GROUP BY 1) SELECT plane, usable, n, round(usable / n, 6) AS share, coalesce(usable >= lag(usable) OVER (ORDER BY plane), TRUE) AS rises FROM n"),
    "plane_regions": sql("terrain", _GRID + """, cell AS (SELECT k * 10000000 + br * 20 + bc AS id, br AS r, k * 1000 + bc AS c, plane::DOUBLE AS plane, top FROM grid JOIN (VALUES (1, 100.0), (2, 150.0), (3, 200.0)) v(k, plane) ON top <= plane WHERE usable), node AS (SELECT id FROM cell),
link AS (SELECT x.id AS a, y.id AS b FROM cell x JOIN cell y ON (x.r = y.r AND abs(x.c - y.c) = 1) OR (x.c = y.c AND abs(x.r - y.r) = 1)), """ + _CC + """,
g AS (SELECT plane, comp AS region, count(*) AS n, max(r) - min(r) + 1 AS h, max(c) - min(c) + 1 AS w, round(avg(top), 4) AS mean, round(max(top), 4) AS most FROM cell JOIN cc USING (id) GROUP BY 1, 2)
SELECT *, CASE WHEN greatest(h, w) >= 4 AND least(h, w) >= 3 THEN 'large' WHEN greatest(h, w) >= 2 AND least(h, w) >= 2 THEN 'medium' ELSE 'small' END AS size, CASE WHEN greatest(h, w) / least(h, w) < 1.5 THEN 'compact' WHEN greatest(h, w) / least(h, w) < 3 THEN 'oblong' ELSE 'strip' END AS shape FROM g""", True),
    "calibration_checks": sql("terrain", "k AS (SELECT kind, count(*) AS n, avg(z) AS mean, max(z) AS most FROM terrain GROUP BY 1) SELECT kind, CASE WHEN n >= 100 AND mean BETWEEN 40 AND 60 AND most <= 600 THEN 'PASS' ELSE 'FAIL' END AS result, concat_ws(',', CASE WHEN n < 100 THEN 'count' END, CASE WHEN mean NOT BETWEEN 40 AND 60 THEN 'mean' END, CASE WHEN most > 600 THEN 'most' END) AS why FROM k"),
    "route_checks": "WITH s AS (SELECT user_id, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id)) AS grade FROM events), g AS (SELECT user_id, coalesce(max(grade), 0) AS most, count(*) FILTER (grade > 100) AS steep, count(*) AS steps FROM s GROUP BY 1) SELECT user_id, round(most, 4) AS most, steep, CASE WHEN most > 400 THEN 'FAIL' WHEN steep * 4 > steps THEN 'WARN' ELSE 'PASS' END AS result, concat_ws(',', CASE WHEN most > 400 THEN 'grade' END, CASE WHEN steep * 4 > steps THEN 'steep' END) AS why FROM g",
    "surface_variants": "SELECT p_size % 3 * 5 AS resolution, p_size % 4 AS tolerance, count(*) AS files, max(p_partkey) AS newest FROM part GROUP BY 1, 2",
    "reverse_routes": """WITH f AS (SELECT user_id, event_id AS node, row_number() OVER w AS i, count(*) OVER (PARTITION BY user_id) AS n, lead(1.0::DOUBLE + event_id % 5) OVER w AS nxt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, (n - i)::INT AS step, node, coalesce(nxt, 0.0) AS length, sum(coalesce(nxt, 0.0)) OVER (PARTITION BY user_id ORDER BY i DESC) AS total FROM f""",
    "resolved_anchors": sql("socket", """k AS (SELECT a.id, b.id AS cell, b.purity = 2 AS p, sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) AS dist FROM socket a JOIN socket b ON a.item = 0 AND b.item <> 0 AND abs(a.x - b.x) <= 80 AND abs(a.y - b.y) <= 80),
t AS (SELECT *, CASE WHEN p AND dist <= 25 THEN 0 WHEN p THEN 1 ELSE 2 END AS tier FROM k WHERE dist <= 80), f AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY id ORDER BY tier, round(dist, 6), cell) = 1)
SELECT s.id, cell, round(dist, 6) AS dist, tier FROM socket s LEFT JOIN f USING (id) WHERE item = 0"""),
    "endpoint_candidates": sql("socket", """k AS (SELECT a.id AS anchor, b.id AS cell, b.item AS component, sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) AS dist FROM socket a JOIN socket b ON a.item = 1 AND a.id <> b.id AND abs(a.x - b.x) <= 60 AND abs(a.y - b.y) <= 60 WHERE b.item <> 2)
SELECT anchor, cell, component, round(dist, 4) AS dist, row_number() OVER (PARTITION BY anchor ORDER BY round(dist, 6), cell)::INT AS rank FROM k WHERE dist <= 60"""),
    "region_crossings": sql("terrain", _STEPS + ", l AS (SELECT ar // 10 || ':' || ak AS x, br // 10 || ':' || bk AS y, grade FROM e) SELECT least(x, y) AS a, greatest(x, y) AS b, count(*) AS n, round(min(grade), 7) AS least, round(avg(grade), 7) AS mean FROM l WHERE x <> y GROUP BY 1, 2"),
    "layer_edges": sql("terrain", " UNION ALL ".join(f"SELECT '{a},{b}' AS direction, count(*) FILTER (abs(x.z - y.z) <= 20) AS edges, round(avg(abs(x.z - y.z)) FILTER (abs(x.z - y.z) <= 20), 6) AS mean, count(*) FILTER (y.z IS NULL OR abs(x.z - y.z) > 20) AS portals, arg_min(x.c, (x.r, x.c)) FILTER (y.z IS NULL OR abs(x.z - y.z) > 20) AS first FROM terrain x LEFT JOIN terrain y ON y.r = x.r + {a} AND y.c = x.c + {b}" for a, b in ((0, 1), (1, 0)))),
    "window_shards": sql("terrain", "b AS (SELECT r // 16 * 10 + c // 16 AS shard, min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1, count(*) FILTER (r BETWEEN 10 AND 45 AND c BETWEEN 20 AND 60) AS cells FROM terrain GROUP BY 1) SELECT * FROM b WHERE r1 >= 10 AND r0 <= 45 AND c1 >= 20 AND c0 <= 60"),
    "pair_bounds": sql("socket", "p(pair, item) AS (VALUES ('AB', 0), ('AB', 1), ('CD', 2), ('CD', 3), ('AJ', 0), ('AJ', 9)) SELECT pair, round(min(x) - 50, 3) AS x0, round(max(x) + 50, 3) AS x1, round(min(y) - 50, 3) AS y0, round(max(y) + 50, 3) AS y1 FROM socket JOIN p USING (item) GROUP BY 1"),
    "path_pads": "WITH g AS (SELECT user_id, max(value) AS hx, min(value) AS lx, max(event_id % 50) AS hy, min(event_id % 50) AS ly, arg_min(value, event_id) AS ax, arg_max(value, event_id) AS bx, min(event_id) % 50 AS ay, max(event_id) % 50 AS by_ FROM events GROUP BY 1) SELECT user_id, round(greatest(hx - greatest(ax, bx), least(ax, bx) - lx, hy - greatest(ay, by_), least(ay, by_) - ly, 0), 4) AS pad FROM g",
    "ramp_components": sql("terrain", _STEPS + """, lim(k, top) AS (VALUES (1, 5.0), (2, 10.0), (3, 20.0)), node AS (SELECT k * 1099511627776 + id AS id FROM terrain, lim), one AS (SELECT k * 1099511627776 + a AS a, k * 1099511627776 + b AS b FROM e JOIN lim ON grade <= top), link AS (SELECT a, b FROM one UNION ALL SELECT b, a FROM one), """ + _CC + """,
s AS (SELECT comp // 1099511627776 AS k, comp, count(*) AS n FROM cc GROUP BY 1, 2) SELECT k::INT AS k, count(*) AS n, max(n) AS largest FROM s GROUP BY 1""", True),
    "painted_coverage": sql("terrain", """f AS (SELECT a.r, a.c, max(b.z) - min(b.z) AS k FROM terrain a JOIN terrain b ON b.r BETWEEN a.r AND a.r + 1 AND b.c BETWEEN a.c AND a.c + 2 GROUP BY 1, 2 HAVING count(b.z) = 6),
p AS (SELECT f.r + i AS r, f.c + j AS c, arg_min((f.r + f.c) % 10, (round(k, 6), f.r, f.c)) AS label FROM f, range(2) x(i), range(3) y(j) WHERE k <= 40 GROUP BY 1, 2) SELECT label::INT AS label, count(*) AS cells, min(r)::INT AS first FROM p GROUP BY 1"""),
    "zone_seeds": sql("terrain", "SELECT r // 8 * 20 + c // 8 AS key, arg_max(id, (round(z, 6), -id)) AS seed, round(max(z), 6) AS z, count(*) AS n FROM terrain WHERE (r - 40) * (r - 40) + (c - 50) * (c - 50) <= 900 GROUP BY 1"),
    "footprint_passable": sql("terrain", "SELECT a.r, a.c, count(b.z) = 9 AND max(b.z) - a.z <= 60 AND a.z - min(b.z) <= 60 AS fits FROM terrain a JOIN terrain b ON b.r BETWEEN a.r - 1 AND a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1 GROUP BY a.r, a.c, a.z"),
    "representative_heights": sql("terrain", "SELECT s AS size, r // s AS br, c // s AS bc, round(median(z), 4) AS z, count(*) AS n FROM terrain, (VALUES (4), (8), (16)) v(s) GROUP BY 1, 2, 3"),
    "overlay_cells": sql("terrain", "SELECT id, c * 5.0::DOUBLE AS x0, c * 5.0::DOUBLE + 5 AS x1, r * 5.0::DOUBLE AS y0, r * 5.0::DOUBLE + 5 AS y1, round(z + 0.5::DOUBLE, 4) AS z FROM terrain WHERE kind IN ('click', 'view') AND z < 40"),
    "pair_routes": sql("trade", "b AS (SELECT a, b, CASE WHEN cost <= 40 THEN 1 ELSE 2 END AS policy, CASE WHEN cost <= 40 THEN cost ELSE cost * 2 END AS cost FROM trade) SELECT a, b, policy, cost, 'forward' AS solved FROM b UNION ALL SELECT b, a, policy, cost, 'reverse' FROM b"),
    "long_runs": sql("terrain", "g AS (SELECT r, c, c - row_number() OVER (PARTITION BY r ORDER BY c) AS k FROM terrain WHERE z < 60) SELECT r, min(c) AS first, max(c) AS last, count(*) AS n FROM g GROUP BY r, k HAVING count(*) >= 3 QUALIFY row_number() OVER (PARTITION BY r ORDER BY count(*) DESC, min(c)) = 1"),
}
