"""Scalars of routes, cells and moves, as columns."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def road_class(road: Column, band: Column, to_road: Column, to_band: Column) -> Column:
    """How an edge runs by what its ends are: along a road, within a road's band, on to a road, off
    it, or over open ground."""
    on, to = road | band, to_road | to_band
    return F.when(road & to_road, "road").when(on & to, "band").when(~on & to, "enter").when(on & ~to, "leave").otherwise("open")


def direction(dr: Column, dc: Column) -> Column:
    """0 to 7 of the eight neighbours, clockwise from north; -1 for no move. Rows grow southward."""
    ways = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]
    r, c = F.signum(dr), F.signum(dc)
    return reduce(lambda col, k: col.when((r == k[1][0]) & (c == k[1][1]), k[0]), enumerate(ways), F.when(F.lit(False), -1)).otherwise(-1)


def by_turn(steps: Column, table: list[float]) -> Column:
    """The entry of a table for a turn of so many eighths; the last one for larger turns."""
    return F.element_at(F.array(*(F.lit(float(x)) for x in table)), (F.least(steps, F.lit(len(table) - 1)) + 1).cast("int"))


def road_factor(kind: Column, steps: Column, straight: float = 0.6, turn: float = 0.8, band: float = 0.9, change: float = 1.1) -> Column:
    """What a metre costs by class: roads are cheap, straight ones most."""
    return F.when((kind == "road") & (steps == 0), straight).when(kind == "road", turn).when(kind == "band", band).when(kind.isin("enter", "leave"), change).otherwise(1.0)


def seam_penalty(seam: Column, kind: Column, grade: Column, steps: Column, same: float = 4.0, other: float = 12.0) -> Column:
    """What crossing a seam costs: more between components than inside one, less on a road, more
    with grade and with turns. `seam` is 'none', 'same' or 'cross'."""
    base = F.when(seam == "same", same).when(seam == "cross", other).otherwise(0.0)
    return base * F.when(kind == "road", 0.5).when(kind == "band", 0.75).otherwise(1.0) * (1 + F.least(grade, F.lit(1.0))) * (1 + 0.25 * steps)


def connector_cost(plan: Column, rise: Column, weight: float = 2.0, ramp: float = 8.0, penalty: float = 5.0, most: float = 60.0) -> Column:
    """Plan length, the rise times a weight and a penalty for each ramp; null where the rise is too
    much for a connector."""
    up = F.abs(rise)
    return F.when(up <= most, plan + weight * up + penalty * F.ceil(up / ramp))


def crossing_cost(plan: Column, rise: Column, excess: Column, least: float = 1.0, penalty: float = 2.0) -> Column:
    """The length in space, at least `least`, times what the excess grade costs."""
    return F.greatest(F.sqrt(plan * plan + rise * rise), F.lit(least)) * (1 + excess * penalty)


def grid_index(x: Column, origin: float, step: float) -> Column:
    """Cell of a coordinate, rounded half to even."""
    return F.rint((x - origin) / step).cast("long")


def grid_place(k: Column, origin: float, step: float) -> Column:
    """Coordinate of a cell."""
    return origin + k * step


def cell_row(cell: Column, width: int) -> Column:
    return F.floor(cell / width).cast("long")


def cell_column(cell: Column, width: int) -> Column:
    return F.pmod(cell, F.lit(width)).cast("long")


def span_cells(span: Column, resolution: float) -> Column:
    """Cells that a span covers."""
    return F.ceil(span / resolution - 1e-9).cast("long")


def deep_water(water: Column, depth: Column, limit: float) -> Column:
    """Under water that is too deep or of unknown depth."""
    return water & (depth.isNull() | (depth >= limit))


def rectangle_distance(x: Column, y: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """From a point inside a rectangle to its nearest side; negative outside."""
    return F.least(x - x0, x1 - x, y - y0, y1 - y)


def travel_minutes(length: Column, grade: Column, radius: Column, top: float = 30.0, side: float = 2.0, power: float = 4.0) -> Column:
    """Time of a move: speed is bounded by the top, by the curve and by the climb."""
    curve = F.when(radius > 0, F.sqrt(side * radius)).otherwise(top)
    climb = F.when(grade > 0, power / grade).otherwise(top)
    return length / F.least(F.lit(top), curve, climb) / 60


def end_pose(x: Column, y: Column, heading: Column, radius: Column, turn: Column, length: Column) -> dict[str, Column]:
    """Where a move ends: an arc of a radius turning left (turn 1) or right (-1), or straight on
    (turn 0). Headings are radians from east, in [0, 2 pi)."""
    swept = heading + turn * length / F.when(radius > 0, radius).otherwise(1.0)
    arc_x, arc_y = x + turn * radius * (F.sin(swept) - F.sin(heading)), y - turn * radius * (F.cos(swept) - F.cos(heading))
    straight = turn == 0
    to = F.when(straight, heading).otherwise(swept)
    return {"x": F.when(straight, x + length * F.cos(heading)).otherwise(arc_x), "y": F.when(straight, y + length * F.sin(heading)).otherwise(arc_y), "heading": to - 2 * math.pi * F.floor(to / (2 * math.pi))}
