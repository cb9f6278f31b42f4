"""Column expressions shared by the operators.  All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from frisk.config import AGE_BRACKETS, AGE_WEIGHTS, OLDEST_DRAWN_AGE

EARTH_RADIUS_KM = 6371.0


def flag(cond: Column) -> Column:
    return F.when(cond, F.lit(1.0)).otherwise(F.lit(0.0))


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0: an undefined rate is not a zero rate."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def literal_map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def lookup(pairs: dict, key: Column) -> Column:
    return F.try_element_at(literal_map(pairs), key)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance; NULL where a coordinate is."""
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), 2)
    chord = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return F.when(chord.isNotNull(), F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(chord, F.lit(1.0)))))


def behaviour_token(mcc: Column, channel: Column, amount: Column) -> Column:
    bucket = F.least(F.lit(6), F.floor(F.log1p(F.greatest(amount, F.lit(0.0))) / 1.43))
    return F.concat_ws("|", F.coalesce(mcc, F.lit("?")), F.coalesce(channel, F.lit("?")), bucket.cast("string"))


def short_hash(value: Column) -> Column:
    return F.substring(F.sha1(value.cast("string")), 1, 6)


def age_bracket(age: Column) -> Column:
    out = F.lit("unknown")
    for label, lo, hi in reversed(AGE_BRACKETS):
        out = F.when(age.between(lo, hi), F.lit(label)).otherwise(out)
    return out


def age_from_id(cust_id: Column) -> Column:
    """A stable age for a customer without one: a hash picks bracket (by weight) and year."""
    draw = F.pmod(F.xxhash64(cust_id), F.lit(10_000)) / 10_000.0
    year = F.pmod(F.xxhash64(cust_id, F.lit("year")), F.lit(1_000_000))
    edges, upto = [], 0.0
    for (_, lo, hi), weight in zip(AGE_BRACKETS, AGE_WEIGHTS):
        upto += weight
        hi = min(hi, OLDEST_DRAWN_AGE)
        edges.append((upto, lo + F.pmod(year, F.lit(hi - lo + 1))))
    out = edges[-1][1]
    for upto, age in reversed(edges[:-1]):
        out = F.when(draw < upto, age).otherwise(out)
    return out.cast("int")


def number(c: Column, pattern: str) -> Column:
    """Half-even decimal text, e.g. pattern '#,##0' or '0.0'."""
    return F.call_function("format_number", c, F.lit(pattern))


def as_int_text(c: Column) -> Column:
    return c.cast("long").cast("string")


def rounded(c: Column, places: int) -> Column:
    """Rounded, with -0.0 folded into 0.0."""
    return F.round(c, places) + F.lit(0.0)
