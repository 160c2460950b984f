"""Ground analysis over rasters and graphs: grids of obstructions, planes, crossings, anchors,
coverage and checks with a named result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millwright.operators import spatial


def obstruction_grid(cells: DataFrame, size: int, least_valid: float, value: str = "z") -> DataFrame:
    """br, bc, valid, top, spread, usable: each block's highest and its spread, usable where enough
    of it has a value."""
    v = F.col(value)
    rows = cells.groupBy(F.floor(F.col("r") / size).cast("long").alias("br"), F.floor(F.col("c") / size).cast("long").alias("bc")).agg((F.count(v) / F.lit(size * size)).alias("valid"), F.max(v).alias("top"), (F.max(v) - F.min(v)).alias("spread"))
    return rows.withColumn("usable", F.col("valid") >= least_valid)


def planes_swept(grid: DataFrame, planes: DataFrame, top: str = "top") -> DataFrame:
    """plane, usable, n, share, rises: how much of a grid lies below each plane, which may only grow
    with it."""
    counts = grid.join(F.broadcast(planes)).groupBy("plane").agg(F.count_if(F.col(top) <= F.col("plane")).alias("usable"), F.count("*").alias("n"))  # few planes
    order = Window.orderBy("plane")
    return counts.withColumn("share", F.col("usable") / F.col("n")).withColumn("rises", F.coalesce(F.col("usable") >= F.lag("usable").over(order), F.lit(True)))


def verdict(checks: dict[str, Column], warnings: dict[str, Column] | None = None) -> tuple[Column, Column]:
    """PASS, WARN or FAIL, and the names of what does not hold, from columns that should be true."""
    failed = F.array_compact(F.array(*(F.when(~c, F.lit(k)) for k, c in checks.items())))
    warned = F.array_compact(F.array(*(F.when(~c, F.lit(k)) for k, c in (warnings or {}).items()))) if warnings else F.array().cast("array<string>")
    return F.when(F.size(failed) > 0, "FAIL").when(F.size(warned) > 0, "WARN").otherwise("PASS"), F.concat_ws(",", F.concat(failed, warned))


def crossings(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """a, b, label_a, label_b and the edges' columns: edges whose ends lie in different regions."""
    side = lambda k: labels.select(F.col("id").alias(k), F.col("label").alias(f"label_{k}"))
    return edges.join(side("a"), "a").join(side("b"), "b").where("label_a <> label_b")


def portals(cells: DataFrame, floors: DataFrame, dr: int, dc: int, step: float) -> tuple[DataFrame, DataFrame]:
    """Edges (r, c, z, to_z) from each cell to its neighbour by an offset where their floors are at
    most `step` apart, and portals (r, c, z): cells whose neighbour has no such floor."""
    to = floors.select((F.col("r") - dr).alias("r"), (F.col("c") - dc).alias("c"), F.col("z").alias("to_z"))
    met = cells.join(to, ["r", "c"], "left").withColumn("ok", F.coalesce(F.abs(F.col("z") - F.col("to_z")) <= step, F.lit(False)))
    edges = met.where("ok").select("r", "c", "z", "to_z")
    return edges, cells.select("r", "c", "z").join(edges.select("r", "c", "z"), ["r", "c", "z"], "left_anti")


def anchored(anchors: DataFrame, cells: DataFrame, radius: float, near: float) -> DataFrame:
    """id, cell, dist, tier: the best cell of each anchor, any `near` one that is primary before
    others, then by distance; anchors without any have none."""
    rows = spatial.radius_join(anchors.select("id", "x", "y"), cells.select("id", "x", "y", "primary"), radius)
    tier = F.when(F.col("r_primary") & (F.col("dist") <= near), 0).when(F.col("r_primary"), 1).otherwise(2)
    best = rows.withColumn("tier", tier).groupBy(F.col("l_id").alias("id")).agg(F.min(F.struct("tier", F.round("dist", 6).alias("dist"), F.col("r_id").alias("cell"))).alias("m"))
    return anchors.select("id").join(best, "id", "left").select("id", "m.cell", "m.dist", "m.tier")


def painted(footprints: DataFrame, order: str) -> DataFrame:
    """r, c, label: cells under footprints (r, c, height, width, label); the first in order wins
    where they overlap."""
    cells = footprints.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("height") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("width") - 1)))
    return cells.groupBy((F.col("r") + F.col("i")).alias("r"), (F.col("c") + F.col("j")).alias("c")).agg(F.min(F.struct(order, "label"))["label"].alias("label"))


def reversed_route(route: DataFrame, by: str) -> DataFrame:
    """by, step, node, length, total: a route (by, step, node, length of the leg to the node) the
    other way round."""
    back = Window.partitionBy(by).orderBy(F.col("step").desc())
    rows = route.select(by, (F.row_number().over(back) - 1).alias("step"), "node", F.coalesce(F.lag("length").over(back), F.lit(0.0)).alias("length"))
    return rows.withColumn("total", F.sum("length").over(Window.partitionBy(by).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)))


def directed(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Undirected rows both ways, with the one that was solved marked."""
    there = rows.withColumn("solved", F.lit("forward"))
    back = rows.select(*(F.col(b).alias(a) if k == a else F.col(a).alias(b) if k == b else F.col(k) for k in rows.columns), F.lit("reverse").alias("solved"))
    return there.unionByName(back)


def first_success(tries: DataFrame, by: list[str], order: str, found: str) -> DataFrame:
    """by and the columns of the first try in order that found a way; those without any are left
    out."""
    own = [c for c in tries.columns if c not in by and c != found]
    best = tries.where(F.col(found)).groupBy(*by).agg(F.min(F.struct(order, *(c for c in own if c != order))).alias("m"))
    return best.select(*by, *(F.col(f"m.{c}").alias(c) for c in [order, *(c for c in own if c != order)]))


def path_excess(steps: DataFrame, by: str) -> DataFrame:
    """by, pad: how far a path (x, y, with its ends ax, ay, bx, by_) leaves the box of its ends."""
    out = F.greatest(F.max("x") - F.max(F.greatest("ax", "bx")), F.min(F.least("ax", "bx")) - F.min("x"), F.max("y") - F.max(F.greatest("ay", "by_")), F.min(F.least("ay", "by_")) - F.min("y"), F.lit(0.0))
    return steps.groupBy(by).agg(out.alias("pad"))
