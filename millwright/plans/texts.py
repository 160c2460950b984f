"""Scalar queries: keys and labels, records, edge classes, cells, moves and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millwright.functions import routes, texts
from millwright.functions.scalars import half_away, turn_steps
from millwright.operators import windows
from millwright.plans import domain as d
from millwright.plans.domain import sql
from millwright.session import table

LABELS = {"0": "Depot", "1": "Mine", "2": "Well"}


def place_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Key, label and file token of every place from its source id."""
    rows = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("world:"), "s_name").alias("source"), (F.col("s_nationkey") % 4).cast("string").alias("kind"))
    return rows.select("id", texts.match_key(F.col("source")).alias("key"), texts.label_of(F.col("kind"), F.col("source"), LABELS).alias("label"), texts.file_token(F.col("source")).alias("token"))


def place_centimetres(spark: SparkSession, sf: str) -> DataFrame:
    """Places in whole axes of another frame: centimetres, north down, no negative zero."""
    at = d.sockets(spark, sf).select("id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), F.round("z", 4).alias("z"))
    return at.select("id", texts.centimetres(F.col("x")).alias("x"), texts.centimetres(-F.col("y")).alias("y"), texts.centimetres(F.col("z")).alias("z"))


def hazard_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Facts of each record's JSON: a length in metres, flags by the map's keys, and the record
    written again."""
    k = F.from_json("props", "k LONG")["k"]
    hazards = F.create_map(F.col("event_type"), k, F.concat(F.lit("gas_"), (F.col("event_id") % 3).cast("string")), F.lit(1).cast("long"))
    rows = table(spark, sf, "events").select("event_id", k.alias("k"), hazards.alias("hazards"))
    again = F.to_json(F.struct(F.col("event_id").alias("id"), F.col("k").alias("strength")))
    return rows.select("event_id", texts.metres(F.col("k").cast("string")).alias("radius"), texts.any_key(F.col("hazards"), "click").alias("click"), texts.any_key(F.col("hazards"), "gas_2").alias("gas"), again.alias("record"))


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    """Steps from each cell to the next one right, below and right below."""
    cell = d.terrain(spark, sf).select("r", "c", "z", (F.col("kind") == "click").alias("road"), (F.col("z") < 30).alias("band"))
    step = F.explode(F.array(*(F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in ((0, 1), (1, 0), (1, 1)))))
    to = cell.select(step.alias("s"), "*").select("s.*", (F.col("r") - F.col("s.dr")).alias("r"), (F.col("c") - F.col("s.dc")).alias("c"), F.col("z").alias("to_z"), F.col("road").alias("to_road"), F.col("band").alias("to_band"))
    return cell.join(to, ["r", "c"]).withColumn("kind", routes.road_class(F.col("road"), F.col("band"), F.col("to_road"), F.col("to_band"))).withColumn("way", routes.direction(F.col("dr"), F.col("dc")))


def edge_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Class and direction of every step, and the flags of both ends."""
    return _edges(spark, sf).select("r", "c", "way", "kind", (F.col("road") | F.col("to_road")).alias("any_road"), (F.col("band") | F.col("to_band")).alias("any_band"))


def edge_penalties(spark: SparkSession, sf: str) -> DataFrame:
    """What each step costs after one that came from the west: road factor, turn and seam."""
    turn = turn_steps(F.col("way"), F.lit(2))
    rows = _edges(spark, sf).withColumn("turn", turn).withColumn("rise", F.col("to_z") - F.col("z")).withColumn("plan", F.when((F.col("dr") != 0) & (F.col("dc") != 0), 1.5).otherwise(1.0))
    seam = F.when(F.col("c") % 10 != 9, "none").when(F.col("r") % 2 == 0, "same").otherwise("cross")
    grade = F.abs("rise") / 100
    cost = F.col("plan") * routes.road_factor(F.col("kind"), F.col("turn")) + routes.by_turn(F.col("turn"), [0, 1, 4]) + routes.seam_penalty(seam, F.col("kind"), grade, F.col("turn"))
    return rows.select("r", "c", "way", F.round(cost, 9).alias("cost"), F.round(routes.connector_cost(F.col("plan"), F.col("rise")), 9).alias("connector"), F.round(routes.crossing_cost(F.col("plan"), F.col("rise"), F.greatest(F.lit(0.0), grade - 0.3)), 9).alias("crossing"))


def shadow_texts(spark: SparkSession, sf: str) -> DataFrame:
    """What caps are worth, as texts."""
    price, limit = F.col("p_size") / 64, F.col("p_retailprice")
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("item"), F.when(F.col("p_size") % 8 == 0, 0.0).otherwise(price).alias("price"), limit.alias("limit"))
    return rows.select("item", texts.per_unit(F.col("price"), F.col("limit")).alias("unit"), texts.per_mw(F.col("price"), F.lit(16.0)).alias("mw"), texts.horizon(F.col("price"), F.lit(0.5), F.lit(8.0)).alias("horizon"), F.round(texts.significant(F.col("limit")), 6).alias("short"))


def config_ids(spark: SparkSession, sf: str) -> DataFrame:
    """An id of each recipe's configuration and why an alternate stands in it."""
    alt = F.col("p_partkey") % 7 == 0
    ident = F.concat_ws("/", F.concat(F.lit("r"), F.col("p_partkey").cast("string")), F.when(alt, "alt"), F.concat(F.lit("x"), texts.fixed(1 + F.col("p_size") % 4 * 0.25, 2)), F.when(F.col("p_size") % 3 == 1, "m3"))
    reason = F.when(alt & (F.col("p_size") % 10 > 5), "unlocks late").when(alt, "fewer inputs").otherwise("")
    return table(spark, sf, "part").where(F.col("p_partkey") >= d.RAW).select(F.col("p_partkey").alias("item"), ident.alias("config"), reason.alias("reason"))


def exact_fractions(spark: SparkSession, sf: str) -> DataFrame:
    """Prices as exact fractions of their decimal texts."""
    text = F.col("p_retailprice").cast("decimal(18,2)").cast("string")
    top, bottom = texts.fraction(F.col("t"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("item"), text.alias("t")).select("item", top.alias("top"), bottom.alias("bottom"))


def nation_documents(spark: SparkSession, sf: str) -> DataFrame:
    """One JSON document for each nation: its name, the links it has and what they cost, in order."""
    links = d.trade(spark, sf).join(table(spark, sf, "nation").select(F.col("n_nationkey").alias("b"), F.col("n_name").alias("to")), "b")
    own = links.groupBy("a").agg(F.array_sort(F.collect_list(F.struct("to", F.col("cost").cast("long").alias("cost")))).alias("links"))
    rows = table(spark, sf, "nation").join(own, F.col("n_nationkey") == F.col("a"), "left")
    doc = F.to_json(F.struct(F.lit("site/1").alias("schema"), F.col("n_name").alias("name"), F.coalesce("links", F.array().cast("array<struct<to:string,cost:bigint>>")).alias("links")))
    return rows.select(F.col("n_nationkey").alias("nation"), doc.alias("doc"), F.sha2(doc, 256).alias("sha256"))


def window_shapes(spark: SparkSession, sf: str) -> DataFrame:
    """Cells of each footprint at a resolution, sides swapped where it lies across."""
    part = table(spark, sf, "part")
    wide, deep = (routes.span_cells(x, 2.5) for x in (F.col("p_size").cast("double"), F.col("p_size") % 7 + 1.0))
    across = F.col("p_partkey") % 2 == 1
    return part.select(F.col("p_partkey").alias("item"), F.when(across, deep).otherwise(wide).alias("width"), F.when(across, wide).otherwise(deep).alias("height"))


def plane_sequence(spark: SparkSession, sf: str) -> DataFrame:
    """Planes to try in each block: steps of 25 that cover its heights, with their file tokens."""
    block = d.terrain(spark, sf).groupBy(F.floor(F.col("r") / 20).cast("long").alias("br"), F.floor(F.col("c") / 20).cast("long").alias("bc")).agg(F.min("z").alias("least"), F.max("z").alias("most"))
    plane = F.explode(F.sequence(F.floor(F.col("least") / 25).cast("long"), F.ceil(F.col("most") / 25).cast("long")))
    rows = block.select("br", "bc", plane.alias("k")).withColumn("plane", F.col("k") * 25.0)
    return rows.select("br", "bc", "plane", F.concat(F.when(F.col("plane") < 0, "m").otherwise("p"), F.lpad(F.abs("plane").cast("long").cast("string"), 5, "0")).alias("token"))


def map_crop(spark: SparkSession, sf: str) -> DataFrame:
    """Pixels of one colour, rows that have enough of them, and the longest run of such rows."""
    pixel = d.terrain(spark, sf).select("r", "c", (F.col("id") * 7 % 256).alias("red"), (F.col("id") * 13 % 256).alias("green"), (F.col("id") * 29 % 256).alias("blue"))
    own = (F.col("red") > 90) & (F.col("blue") > 90) & (F.col("green") < F.col("red")) & (F.col("green") < F.col("blue"))
    rows = pixel.groupBy(F.lit("row").alias("axis"), F.col("r").alias("at")).agg(F.count_if(own).alias("n")).unionByName(pixel.groupBy(F.lit("column").alias("axis"), F.col("c").alias("at")).agg(F.count_if(own).alias("n")))
    total = Window.partitionBy("axis")
    rows = rows.withColumn("on", F.col("n") >= F.avg("n").over(total))  # one row for each row or column of the raster
    runs = windows.islands(rows, ["axis"], "at", "on").where("on")
    best = runs.groupBy("axis").agg(F.max(F.struct("n", (-F.col("first")).alias("no"), "last")).alias("m"))
    return best.select("axis", (-F.col("m.no")).alias("first"), F.col("m.last").alias("last"), F.col("m.n").alias("n"))


def move_poses(spark: SparkSession, sf: str) -> DataFrame:
    """Where each event's move ends and how long it takes."""
    turn = (F.col("event_id") % 3 - 1).cast("double")
    rows = table(spark, sf, "events").select("event_id", (F.col("user_id") % 10).cast("double").alias("x"), (F.col("user_id") % 7).cast("double").alias("y"), (F.col("event_id") % 8 * 0.785).alias("h"), (10.0 + F.col("event_id") % 5 * 10).alias("radius"), turn.alias("turn"), (4.0 + F.col("event_id") % 4).alias("length"))
    end = routes.end_pose(F.col("x"), F.col("y"), F.col("h"), F.col("radius"), F.col("turn"), F.col("length"))
    minutes = routes.travel_minutes(F.col("length"), (F.col("event_id") % 6) / 10, F.when(F.col("turn") != 0, F.col("radius")).otherwise(0.0))
    inside = routes.rectangle_distance(F.col("x"), F.col("y"), F.lit(0.0), F.lit(0.0), F.lit(8.0), F.lit(6.0))
    return rows.select("event_id", *(F.round(end[k], 6).alias(f"to_{k}") for k in ("x", "y", "heading")), F.round(minutes, 6).alias("minutes"), inside.alias("inside"))


def grid_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Ground under each socket: the raster's cell that its coordinates round to, half to even."""
    at = d.sockets(spark, sf).select("id", "x", "y", "z")
    rows = at.withColumn("c", F.pmod(routes.grid_index(F.col("x"), 0.0, 8.0), F.lit(100))).withColumn("r", F.pmod(routes.grid_index(F.col("y"), 0.0, 8.0), F.lit(40)))
    cell = d.terrain(spark, sf).select("r", "c", F.col("id").alias("cell"), F.col("z").alias("ground"), "kind")
    place = F.struct(routes.grid_place(F.col("c"), 0.0, 8.0).alias("east"), routes.grid_place(F.col("r"), 0.0, 8.0).alias("north"))
    out = rows.join(cell, ["r", "c"], "left").withColumn("p", place)
    return out.select("id", "cell", routes.cell_row(F.col("cell"), 100).alias("row"), routes.cell_column(F.col("cell"), 100).alias("column"), "kind", F.round(F.col("z") - F.col("ground"), 4).alias("above"), "p.east", "p.north")


def water_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Cells under deep water by kind: too deep, or of unknown depth."""
    rows = d.terrain(spark, sf).select("kind", routes.deep_water(F.col("z") > 60, F.when(F.col("id") % 5 != 0, F.col("z") - 60), 40.0).alias("deep"), (F.col("z") > 60).alias("wet"))
    return rows.groupBy("kind").agg(F.count_if("deep").alias("deep"), F.count_if(F.col("wet") & ~F.col("deep")).alias("shallow"), F.count("*").alias("n"))


def rounded_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Money rounded half away from zero beside half to even, by order status."""
    price = F.col("o_totalprice") / 1000
    return table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.sum(half_away(price)).cast("long").alias("away"), F.sum(F.rint(price)).cast("long").alias("even"), F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (place_labels, place_centimetres, hazard_facts, edge_classes, edge_penalties, shadow_texts, config_ids, exact_fractions, nation_documents, window_shapes, plane_sequence, map_crop, move_poses, grid_samples, water_cells, rounded_totals)}

_EDGES = """cell AS (SELECT r, c, z, kind = 'click' AS road, z < 30 AS band FROM terrain),
step AS (SELECT a.r, a.c, a.z, b.z AS to_z, a.road, a.band, b.road AS to_road, b.band AS to_band, b.r - a.r AS dr, b.c - a.c AS dc, CASE WHEN b.r = a.r THEN 2 WHEN b.c = a.c THEN 4 ELSE 3 END AS way,
  CASE WHEN a.road AND b.road THEN 'road' WHEN (a.road OR a.band) AND (b.road OR b.band) THEN 'band' WHEN (b.road OR b.band) THEN 'enter' WHEN (a.road OR a.band) THEN 'leave' ELSE 'open' END AS kind
  FROM cell a JOIN cell b ON b.r - a.r IN (0, 1) AND b.c - a.c IN (0, 1) AND b.r - a.r + b.c - a.c > 0)"""


def _fixed(x: str, places: int) -> str:
    return f"round(({x})::DECIMAL(28,9), {places})::DECIMAL(28,{places})::VARCHAR"


SQL = {
    "place_labels": "SELECT s_suppkey AS id, s_name AS key, CASE s_nationkey % 4 WHEN 0 THEN 'Depot' WHEN 1 THEN 'Mine' WHEN 2 THEN 'Well' ELSE '3' END || ' ' || split_part(s_name, '#', 2) AS label, regexp_replace('world:' || s_name, '[^A-Za-z0-9-]+', '_', 'g') AS token FROM supplier",
    "place_centimetres": sql("socket", "SELECT id, round(round(x, 4) * 100, 3) + 0.0 AS x, round(-round(y, 4) * 100, 3) + 0.0 AS y, round(round(z, 4) * 100, 3) + 0.0 AS z FROM socket"),
    "hazard_facts": """WITH e AS (SELECT event_id, event_type, (props->>'k')::BIGINT AS k FROM events) SELECT event_id, round(k / 100, 3) AS radius, contains(event_type, 'click') AS click, event_id % 3 = 2 AS gas, '{"id":' || event_id || ',"strength":' || k || '}' AS record FROM e""",
    "edge_classes": sql("terrain", _EDGES + " SELECT r, c, way, kind, road OR to_road AS any_road, band OR to_band AS any_band FROM step"),
    "edge_penalties": sql("terrain", _EDGES + """, g AS (SELECT r, c, way, kind, way - 2 AS turn, to_z - z AS rise, CASE WHEN way = 3 THEN 1.5::DOUBLE ELSE 1.0 END AS plan, abs(to_z - z) / 100 AS grade FROM step)
SELECT r, c, way, round(plan * CASE WHEN kind = 'road' AND turn = 0 THEN 0.6::DOUBLE WHEN kind = 'road' THEN 0.8 WHEN kind = 'band' THEN 0.9 WHEN kind IN ('enter', 'leave') THEN 1.1 ELSE 1.0 END + CASE turn WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 4 END
  + CASE WHEN c % 10 <> 9 THEN 0.0::DOUBLE WHEN r % 2 = 0 THEN 4.0 ELSE 12.0 END * CASE kind WHEN 'road' THEN 0.5::DOUBLE WHEN 'band' THEN 0.75 ELSE 1.0 END * (1 + least(grade, 1.0)) * (1 + 0.25::DOUBLE * turn), 9) AS cost,
  CASE WHEN abs(rise) <= 60 THEN round(plan + 2 * abs(rise) + 5 * ceil(abs(rise) / 8), 9) END AS connector, round(greatest(sqrt(plan * plan + rise * rise), 1.0) * (1 + greatest(0.0, grade - 0.3::DOUBLE) * 2), 9) AS crossing FROM g"""),
    "shadow_texts": f"""WITH p AS (SELECT p_partkey AS item, CASE WHEN p_size % 8 = 0 THEN 0.0::DOUBLE ELSE p_size / 64.0::DOUBLE END AS price, p_retailprice AS l FROM part)
SELECT item, CASE WHEN abs(price) < 1e-9 THEN 'slack' ELSE {_fixed('price', 4)} || ' per unit at ' || {_fixed('l', 1)} END AS unit, {_fixed('price * 16', 3)} || ' for 16 MW' AS mw, '2.00 -> ' || {_fixed('1 / (0.5::DOUBLE + price * 8)', 2)} || ' min' AS horizon, round(round(l / power(10.0::DOUBLE, floor(log10(l))), 3) * power(10.0::DOUBLE, floor(log10(l))), 6) AS short FROM p""",
    "config_ids": f"SELECT p_partkey AS item, concat_ws('/', 'r' || p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'alt' END, 'x' || {_fixed('1 + p_size % 4 * 0.25::DOUBLE', 2)}, CASE WHEN p_size % 3 = 1 THEN 'm3' END) AS config, CASE WHEN p_partkey % 7 = 0 AND p_size % 10 > 5 THEN 'unlocks late' WHEN p_partkey % 7 = 0 THEN 'fewer inputs' ELSE '' END AS reason FROM part WHERE p_partkey >= 25",
    "exact_fractions": "WITH p AS (SELECT p_partkey AS item, (p_retailprice::DECIMAL(18,2) * 100)::BIGINT AS n FROM part) SELECT item, n // gcd(n, 100) AS top, 100 // gcd(n, 100) AS bottom FROM p",
    "nation_documents": sql("trade", """l AS (SELECT a, string_agg('{"to":"' || n_name || '","cost":' || cost::BIGINT || '}', ',' ORDER BY n_name, cost) AS links FROM trade JOIN nation ON n_nationkey = b GROUP BY 1),
d AS (SELECT n_nationkey AS nation, '{"schema":"site/1","name":"' || n_name || '","links":[' || coalesce(links, '') || ']}' AS doc FROM nation LEFT JOIN l ON a = n_nationkey) SELECT nation, doc, sha256(doc) AS sha256 FROM d"""),
    "window_shapes": "WITH s AS (SELECT p_partkey AS item, ceil(p_size / 2.5::DOUBLE - 1e-9::DOUBLE)::BIGINT AS w, ceil((p_size % 7 + 1) / 2.5::DOUBLE - 1e-9::DOUBLE)::BIGINT AS h FROM part) SELECT item, CASE WHEN item % 2 = 1 THEN h ELSE w END AS width, CASE WHEN item % 2 = 1 THEN w ELSE h END AS height FROM s",
    "plane_sequence": sql("terrain", "b AS (SELECT r // 20 AS br, c // 20 AS bc, floor(min(z) / 25)::BIGINT AS l, ceil(max(z) / 25)::BIGINT AS h FROM terrain GROUP BY 1, 2), k AS (SELECT br, bc, unnest(range(l, h + 1)) AS k FROM b) SELECT br::BIGINT AS br, bc::BIGINT AS bc, k * 25.0::DOUBLE AS plane, CASE WHEN k < 0 THEN 'm' ELSE 'p' END || lpad((abs(k) * 25)::VARCHAR, 5, '0') AS token FROM k"),
    "map_crop": sql("terrain", """p AS (SELECT r, c, id * 7 % 256 AS red, id * 13 % 256 AS green, id * 29 % 256 AS blue FROM terrain), o AS (SELECT r, c, (red > 90 AND blue > 90 AND green < red AND green < blue)::INT AS own FROM p),
n AS (SELECT 'row' AS axis, r AS k, sum(own) AS n FROM o GROUP BY 2 UNION ALL SELECT 'column', c, sum(own) FROM o GROUP BY 2), m AS (SELECT axis, k, n >= avg(n) OVER (PARTITION BY axis) AS hit FROM n),
g AS (SELECT axis, k, k - row_number() OVER (PARTITION BY axis ORDER BY k) AS run FROM m WHERE hit) SELECT axis, min(k) AS first, max(k) AS last, count(*) AS n FROM g GROUP BY axis, run QUALIFY row_number() OVER (PARTITION BY axis ORDER BY count(*) DESC, min(k)) = 1"""),
    "move_poses": """WITH e AS (SELECT event_id, (user_id % 10)::DOUBLE AS x, (user_id % 7)::DOUBLE AS y, event_id % 8 * 0.785::DOUBLE AS h, 10.0::DOUBLE + event_id % 5 * 10 AS q, event_id % 3 - 1 AS t, 4.0::DOUBLE + event_id % 4 AS l, (event_id % 6) / 10.0::DOUBLE AS g FROM events),
s AS (SELECT *, CASE WHEN t = 0 THEN h ELSE h + t * l / q END AS w FROM e)
SELECT event_id, round(CASE WHEN t = 0 THEN x + l * cos(h) ELSE x + t * q * (sin(w) - sin(h)) END, 6) AS to_x, round(CASE WHEN t = 0 THEN y + l * sin(h) ELSE y - t * q * (cos(w) - cos(h)) END, 6) AS to_y, round(w - 2 * pi() * floor(w / (2 * pi())), 6) AS to_heading,
round(l / least(30.0, CASE WHEN t <> 0 THEN sqrt(2 * q) ELSE 30.0 END, CASE WHEN g > 0 THEN 4 / g ELSE 30.0 END) / 60, 6) AS minutes, least(x, 8 - x, y, 6 - y) AS inside FROM s""",
    "grid_samples": sql("socket terrain", """s AS (SELECT id, z, ((round_even(x / 8, 0)::BIGINT % 100) + 100) % 100 AS c, ((round_even(y / 8, 0)::BIGINT % 40) + 40) % 40 AS r FROM socket)
SELECT s.id, t.id AS cell, t.id // 100 AS row, t.id % 100 AS "column", kind, round(s.z - t.z, 4) AS above, s.c * 8.0::DOUBLE AS east, s.r * 8.0::DOUBLE AS north FROM s LEFT JOIN terrain t ON t.r = s.r AND t.c = s.c"""),
    "water_cells": sql("terrain", "SELECT kind, count(*) FILTER (z > 60 AND (id % 5 = 0 OR z - 60 >= 40)) AS deep, count(*) FILTER (z > 60 AND NOT (id % 5 = 0 OR z - 60 >= 40)) AS shallow, count(*) AS n FROM terrain GROUP BY 1"),
    "rounded_totals": "SELECT o_orderstatus, sum(round((o_totalprice / 1000)::DECIMAL(28,9), 0))::BIGINT AS away, sum(round_even(o_totalprice / 1000, 0))::BIGINT AS even, count(*) AS n FROM orders GROUP BY 1",
}
