"""Scalar functions of the planning domain, as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-9


def half_away(x: Column, places: int = 0) -> Column:
    """Rounded half away from zero, on decimals so that no binary fraction decides a tie."""
    return F.round(x.cast("decimal(28,9)"), places)


def scaled_input(amount: Column, factor: Column, unit: Column, floor_solid: bool = True) -> Column:
    """An input amount times the recipe factor: solids to whole items, fluids (m3) to whole
    millilitres; a solid never falls below one by a factor under one."""
    exact = amount.cast("decimal(18,6)") * factor.cast("decimal(9,4)")
    solid = F.round(exact, 0)
    if floor_solid:
        solid = F.when((factor < 1) & (amount >= 1), F.greatest(solid, F.lit(1))).otherwise(solid)
    return F.when(unit == "m3", F.round(exact, 3)).otherwise(solid).cast("double")


def whole(x: Column) -> Column:
    """Ceiling that ignores a surplus of 1e-9."""
    return F.ceil(x - F.lit(EPS)).cast("long")


def over(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return F.when(b != 0, a / b)


def normalised(name: Column) -> Column:
    """A display name as a join key: lower case without the word for alternates and without
    anything but letters and digits."""
    return F.regexp_replace(F.replace(F.lower(name), F.lit("alternate:"), F.lit("")), "[^a-z0-9]", "")


def folded(name: Column) -> Column:
    """White space runs to one space, trimmed, lower case."""
    return F.lower(F.regexp_replace(F.trim(name), r"\s+", " "))


def unlock_tier(text: Column) -> Column:
    """4 from 'Tier 4 - Name'; null from anything else."""
    return F.when(text.rlike(r"^Tier \d+"), F.regexp_extract(text, r"^Tier (\d+)", 1).cast("int"))


def unlock_milestone(text: Column) -> Column:
    """'Name' from 'Tier 4 - Name'."""
    return F.when(F.contains(text, F.lit(" - ")), F.substring_index(text, " - ", -1))


def largest_part(ident: Column) -> Column:
    """Largest whole number among the parts of an id split at underscores."""
    parts = F.filter(F.split(ident, "_"), lambda p: p.rlike(r"^\d+$"))
    return F.array_max(F.transform(parts, lambda p: p.cast("int")))


def leaf(path: Column) -> Column:
    """Last part of a dotted path."""
    return F.element_at(F.split(path, r"\."), -1)


def clock_power(base: Column, clock: Column, exponent: Column, machines: Column) -> Column:
    """base * (clock / 100) ** exponent for each machine."""
    return base * F.pow(clock / 100, exponent) * machines


def interpolated_rate(nominal: Column, top: Column, clock: Column, top_clock: float = 250.0) -> Column:
    """Linear between the rate at 100 % and that at `top_clock`."""
    return nominal + (top - nominal) * (clock - 100) / (top_clock - 100)


def turn_steps(a: Column, b: Column, directions: int = 8) -> Column:
    """Steps between two directions on a circle."""
    d = F.abs(a - b) % directions
    return F.least(d, directions - d)


def graded(x: Column, steps: list[tuple[float, str]], least: str) -> Column:
    """The label of the highest step that x reaches."""
    ordered = sorted(steps, reverse=True)
    return reduce(lambda c, s: c.when(x >= s[0], s[1]), ordered[1:], F.when(x >= ordered[0][0], ordered[0][1])).otherwise(least)


def size_class(long_side: Column, short_side: Column, classes: list[tuple[str, float, float]], least: str = "none") -> Column:
    """The first class (largest first) both of whose minima are met."""
    first, *rest = classes
    test = lambda c: (long_side >= c[1]) & (short_side >= c[2])
    return reduce(lambda col, c: col.when(test(c), c[0]), rest, F.when(test(first), first[0])).otherwise(least)


def shape_class(width: Column, height: Column, square: float = 1.5, long: float = 3.0) -> Column:
    """By the ratio of the longer to the shorter side."""
    ratio = F.greatest(width, height) / F.least(width, height)
    return F.when(ratio < square, "compact").when(ratio < long, "oblong").otherwise("strip")


def edge_cost(length: Column, narrow: Column, excess: Column) -> Column:
    """Length times a factor for narrowness and twice the square of the excess grade."""
    return length * narrow * (1 + 2 * excess * excess)


def ramps(rise: Column, height: float) -> Column:
    """Ramps of a height that a rise takes."""
    return F.ceil(F.abs(rise) / height).cast("int")


def ticks_to_timestamp(ticks: Column) -> Column:
    """Timestamp from 100 ns ticks since year 1."""
    return F.timestamp_micros(F.floor(ticks / 10).cast("long") - F.lit(62_135_596_800_000_000))
