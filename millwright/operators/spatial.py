"""Radius joins, neighbourhoods and raster operators.

Rasters are long tables (r, c, value). Moving windows are separable: along rows first, then
along columns, with ranges in the window frame, so the work is linear in cells. A window partition
is a stretch of `TILE` cells of one row or column with a halo of the cells that its windows reach
beyond it, so it does not grow with the raster. Radius joins meet in square buckets as wide as the
radius, so a point is compared with nine buckets and not with all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def radius_join(left: DataFrame, right: DataFrame, radius: float, x: str = "x", y: str = "y") -> DataFrame:
    """Pairs (columns of `left` with l_, of `right` with r_, dist) at most `radius` apart."""
    cell = lambda c: F.floor(F.col(c) / radius).cast("long")
    a = left.select(*(F.col(c).alias(f"l_{c}") for c in left.columns), cell(x).alias("cx"), cell(y).alias("cy"))
    step = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    b = right.select(*(F.col(c).alias(f"r_{c}") for c in right.columns), cell(x).alias("bx"), cell(y).alias("by")).withColumn("dx", step).withColumn("dy", step)
    b = b.withColumn("cx", F.col("bx") + F.col("dx")).withColumn("cy", F.col("by") + F.col("dy")).drop("bx", "by", "dx", "dy")
    dist = F.sqrt(F.pow(F.col(f"l_{x}") - F.col(f"r_{x}"), 2) + F.pow(F.col(f"l_{y}") - F.col(f"r_{y}"), 2))
    return a.join(b, ["cx", "cy"]).withColumn("dist", dist).where(F.col("dist") <= radius).drop("cx", "cy")


#: Cells of a row or column in one window partition, less its halo.
TILE = 1024


def tiled(cells: DataFrame, axis: str, before: int, after: int) -> DataFrame:
    """`cells` with `_tile` along an axis: each cell in every tile from whose cells a window that
    reaches `before` cells back and `after` ahead meets it."""
    tile = lambda k: F.floor((F.col(axis) + k) / TILE).cast("long")
    return cells.withColumn("_tile", F.explode(F.sequence(tile(-after), tile(before))))


def at_home(rows: DataFrame, axis: str) -> DataFrame:
    """The rows of `tiled` in the tile of their own cell, once each."""
    return rows.where(F.col("_tile") == F.floor(F.col(axis) / TILE)).drop("_tile")


def _line(near: str, axis: str) -> Window:
    return Window.partitionBy(near, "_tile").orderBy(axis)


def block_stats(cells: DataFrame, size: int, value: str = "z") -> DataFrame:
    """Per block of size x size cells: n, valid, least, most, mean, median, p90."""
    v = F.col(value)
    return cells.groupBy(F.floor(F.col("r") / size).cast("long").alias("br"), F.floor(F.col("c") / size).cast("long").alias("bc")).agg(
        F.count("*").alias("n"), F.count(v).alias("valid"), F.min(v).alias("least"), F.max(v).alias("most"), F.avg(v).alias("mean"), F.median(v).alias("median"), F.percentile(v, F.lit(0.9)).alias("p90")
    )


def _filled(cells: DataFrame, radius: int) -> DataFrame:
    """`cells` with `_own`, and rows without values for the missing cells of each row that are within
    a radius of a cell, as a window over columns must see them. A dense raster gains its margin."""
    w = _line("r", "c")
    before, after = F.col("c") - F.lag("c").over(w) - 1, F.lead("c").over(w) - F.col("c") - 1
    left = F.when(before.isNull(), radius).otherwise(F.least(F.lit(radius), F.greatest(F.lit(0), before - radius)))  # what the cell before does not fill
    right = F.when(after.isNull(), radius).otherwise(F.least(F.lit(radius), after))
    wide = at_home(tiled(cells, "c", 2 * radius + 1, 2 * radius + 1).withColumn("_to", F.sequence(-left, right)), "c")
    each = wide.withColumn("_k", F.explode("_to")).withColumn("_own", F.col("_k") == 0)
    return each.select("r", (F.col("c") + F.col("_k")).alias("c"), "_own", *(F.when(F.col("_own"), F.col(k)).alias(k) for k in cells.columns if k not in ("r", "c")))


def box(cells: DataFrame, radius: int, value: str = "z") -> DataFrame:
    """cells with box_n, box_sum, box_min, box_max over the (2 radius + 1) square around each
    cell; missing cells and nulls count as absent."""
    along, across = (_line(near, axis).rangeBetween(-radius, radius) for near, axis in (("r", "c"), ("c", "r")))
    v = F.col(value)
    row = tiled(_filled(cells, radius), "c", radius, radius).select("*", F.count(v).over(along).alias("_n"), F.sum(v).over(along).alias("_s"), F.min(v).over(along).alias("_l"), F.max(v).over(along).alias("_h"))
    both = tiled(at_home(row, "c"), "r", radius, radius).select(*cells.columns, "_own", "_tile", F.sum("_n").over(across).alias("box_n"), F.sum("_s").over(across).alias("box_sum"), F.min("_l").over(across).alias("box_min"), F.max("_h").over(across).alias("box_max"))
    return at_home(both, "r").where("_own").drop("_own")


def footprint(cells: DataFrame, width: int, height: int, value: str = "z") -> DataFrame:
    """For each cell as the upper left corner of a footprint: cells with a value in it, the
    platform height (its highest cell), clearance (platform less lowest) and mean."""
    along, across = _line("r", "c").rangeBetween(0, width - 1), _line("c", "r").rangeBetween(0, height - 1)
    v = F.col(value)
    row = tiled(cells, "c", 0, width - 1).select("r", "c", "_tile", F.count(v).over(along).alias("_n"), F.sum(v).over(along).alias("_s"), F.min(v).over(along).alias("_l"), F.max(v).over(along).alias("_h"))
    out = tiled(at_home(row, "c"), "r", 0, height - 1).select("r", "c", "_tile", F.sum("_n").over(across).alias("n"), F.max("_h").over(across).alias("platform"), F.min("_l").over(across).alias("_low"), F.sum("_s").over(across).alias("_sum"))
    return at_home(out, "r").where(F.col("n") == width * height).select("r", "c", "platform", (F.col("platform") - F.col("_low")).alias("clearance"), (F.col("_sum") / F.col("n")).alias("mean"))


def _beside(cells: DataFrame, near: str, axis: str, made: dict[str, Column]) -> DataFrame:
    """`cells` with columns over the cells just before and after along an axis."""
    return at_home(tiled(cells, axis, 1, 1).withColumns(made), axis)


def gradient(cells: DataFrame, step: float, value: str = "z") -> DataFrame:
    """cells with `grade`, the length of the central difference; null on the rim."""
    v, out = F.col(value), cells
    for near, axis in (("c", "r"), ("r", "c")):
        w = _line(near, axis)
        there = (F.lead(axis).over(w) - F.col(axis) == 1) & (F.col(axis) - F.lag(axis).over(w) == 1)
        out = _beside(out, near, axis, {f"_d{axis}": F.when(there, (F.lead(v).over(w) - F.lag(v).over(w)) / (2 * step))})
    return out.select(*cells.columns, F.sqrt(F.col("_dr") * F.col("_dr") + F.col("_dc") * F.col("_dc")).alias("grade"))


def decoded(deltas: DataFrame, delta: str = "delta") -> DataFrame:
    """Values from row-wise differences."""
    return deltas.withColumn("value", F.sum(delta).over(Window.partitionBy("r").orderBy("c").rowsBetween(Window.unboundedPreceding, 0)))


def borders(cells: DataFrame, label: str) -> DataFrame:
    """(a, b, across, along, n): borders between unlike labels by unordered pair, crossing a
    column edge (across) or a row edge (along)."""
    out = cells.select("r", "c", F.col(label).alias("l"))
    for near, axis, name in (("r", "c", "right"), ("c", "r", "below")):
        w = _line(near, axis)
        out = _beside(out, near, axis, {name: F.when(F.lead(axis).over(w) == F.col(axis) + 1, F.lead("l").over(w))})
    each = out.select("l", F.explode(F.array(F.struct(F.lit(1).alias("across"), F.col("right").alias("o")), F.struct(F.lit(0).alias("across"), F.col("below").alias("o")))).alias("e"))
    pair = each.where(F.col("e.o").isNotNull() & (F.col("e.o") != F.col("l"))).select(F.least("l", "e.o").alias("a"), F.greatest("l", "e.o").alias("b"), "e.across")
    return pair.groupBy("a", "b").agg(F.sum("across").alias("across"), F.sum(1 - F.col("across")).alias("along"), F.count("*").alias("n"))


def cell_edges(cells: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """(a, b) for every two 4-neighbouring cells that agree on `carry`; cells are numbered by
    the column `id`."""
    carry = carry or []
    out = None
    for near, axis in (("r", "c"), ("c", "r")):
        w = _line(near, axis)
        ok = F.lead(axis).over(w) == F.col(axis) + 1
        for k in carry:
            ok = ok & F.lead(k).over(w).eqNullSafe(F.col(k))
        side = _beside(cells, near, axis, {"_to": F.lead("id").over(w), "_ok": ok}).where("_ok").select(F.col("id").alias("a"), F.col("_to").alias("b"))
        out = side if out is None else out.unionByName(side)
    return out


def boundary(cells: DataFrame) -> DataFrame:
    """Cells (r, c) of which any 4-neighbour is missing."""
    out = cells.select("r", "c")
    for near, axis, name in (("r", "c", "_wide"), ("c", "r", "_high")):
        w = _line(near, axis)
        both = F.coalesce(F.lead(axis).over(w) == F.col(axis) + 1, F.lit(False)) & F.coalesce(F.lag(axis).over(w) == F.col(axis) - 1, F.lit(False))
        out = _beside(out, near, axis, {name: both})
    return out.where("NOT (_wide AND _high)").select("r", "c")
