"""Texts, keys and exact numbers, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def match_key(ident: Column) -> Column:
    """What follows the first colon; all of an id without one."""
    return F.regexp_replace(ident, "^[^:]*:", "")


def file_token(name: Column) -> Column:
    """A name that is safe in a file name: runs of other characters become one underscore."""
    return F.regexp_replace(F.trim(name), "[^A-Za-z0-9-]+", "_")


def label_of(kind: Column, ident: Column, labels: dict[str, str]) -> Column:
    """A kind's label and the last part of an id."""
    named = F.create_map(*(F.lit(x) for pair in labels.items() for x in pair))
    return F.concat_ws(" ", F.coalesce(named[kind], kind), F.element_at(F.split(ident, "[_#]"), -1))


def centimetres(x: Column) -> Column:
    """Metres as centimetres to a thousandth, without a negative zero."""
    return F.round(x * 100, 3) + 0.0


def metres(x: Column) -> Column:
    """Centimetres, as a number or a text, as metres; null from anything else."""
    return F.round(x.try_cast("double") / 100, 3)


def any_key(found: Column, token: str) -> Column:
    """Whether any key of a map holds a token."""
    return F.exists(F.map_keys(found), lambda k: F.contains(F.lower(k), F.lit(token)))


def significant(x: Column, digits: int = 4) -> Column:
    """A number to so many significant digits."""
    return F.when(x == 0, F.lit(0.0)).otherwise(F.round(x / F.pow(F.lit(10.0), F.floor(F.log10(F.abs(x)))), digits - 1) * F.pow(F.lit(10.0), F.floor(F.log10(F.abs(x)))))


def fixed(x: Column, places: int) -> Column:
    """A number as text with so many decimals, exact for tenths of a unit in the last place."""
    return F.round(x.cast("decimal(28,9)"), places).cast(f"decimal(28,{places})").cast("string")


def per_unit(price: Column, limit: Column) -> Column:
    """What one more unit of a cap is worth, and the cap."""
    return F.when(F.abs(price) < 1e-9, F.lit("slack")).otherwise(F.concat(fixed(price, 4), F.lit(" per unit at "), fixed(limit, 1)))


def per_mw(price: Column, step: Column) -> Column:
    """What a step of megawatts is worth."""
    return F.concat(fixed(price * step, 3), F.lit(" for "), fixed(step, 0), F.lit(" MW"))


def horizon(price: Column, scale: Column, step: Column) -> Column:
    """Minutes that a plan takes before and after a step of a cap."""
    return F.concat(fixed(1 / scale, 2), F.lit(" -> "), fixed(1 / (scale + price * step), 2), F.lit(" min"))


def fraction(text: Column) -> tuple[Column, Column]:
    """Numerator and denominator, without a common factor, of a decimal text."""
    places = F.length(F.regexp_extract(text, r"[.](\d*)$", 1))
    top, bottom = F.regexp_replace(text, "[.]", "").cast("long"), F.pow(F.lit(10), places).cast("long")
    both = F.struct(F.abs(top).alias("a"), bottom.alias("b"))
    euclid = F.aggregate(F.sequence(F.lit(1), F.lit(100)), both, lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.when(s["b"] == 0, F.lit(1)).otherwise(s["b"])).alias("b"))), lambda s: F.greatest(s["a"], F.lit(1)))
    return (top / euclid).cast("long"), (bottom / euclid).cast("long")


def class_list(text: Column) -> Column:
    """Class names in a list of dotted paths, in order."""
    return F.regexp_extract_all(text, F.lit(r"\.([A-Za-z0-9_]+)"), F.lit(1))


def machines_of(classes: Column, prefix: str = "Build_") -> Column:
    """Those of a list of classes that are machines."""
    return F.filter(classes, lambda x: F.startswith(x, F.lit(prefix)))


def number(text: Column, default: float = 0.0) -> Column:
    """A number, or the default where the text is none."""
    return F.coalesce(F.trim(text).try_cast("double"), F.lit(default))


#: Unit and divisor of an amount by form.
UNITS = {"solid": ("items", 1.0), "liquid": ("m3", 1000.0), "gas": ("m3", 1000.0)}


def unit_of(form: Column) -> tuple[Column, Column]:
    """Unit and divisor of a form; null for an unknown one."""
    table = lambda k: F.create_map(*(F.lit(x) for f, u in UNITS.items() for x in (f, u[k])))
    return table(0)[form], table(1)[form]
