"""Postcodes and distances as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the Earth's radius in miles.
EARTH_MILES = 3958.8


def compact(postcode: Column) -> Column:
    return F.upper(F.regexp_replace(F.coalesce(postcode, F.lit("")), r"\s+", ""))


def is_full(postcode: Column) -> Column:
    return compact(postcode).rlike(r"^[A-Z]{1,2}[0-9]{1,2}[A-Z]?[0-9][A-Z]{2}$")


def district(postcode: Column) -> Column:
    """The outward part: all but the last three characters of a full code, else the code itself."""
    c = compact(postcode)
    return F.when((F.length(c) > 4) & c.rlike(r"[0-9][A-Z]{2}$"), F.substring(c, F.lit(1), F.length(c) - 3)).otherwise(c)


def strict_district(postcode: Column) -> Column:
    d = district(postcode)
    return F.when(d.rlike(r"^[A-Z]{1,2}[0-9][A-Z0-9]?$"), d)


def area(postcode: Column) -> Column:
    return F.regexp_extract(compact(postcode), r"^[A-Z]{1,2}", 0)


def find_postcode(text: Column) -> Column:
    """The first full postcode in a text; empty if there is none."""
    return F.regexp_extract(F.upper(text), r"\b[A-Z]{1,2}[0-9]{1,2}[A-Z]?\s*[0-9][A-Z]{2}\b", 0)


def match_postcode(held: Column, wanted: Column) -> Column:
    """Equal to a full code; else the held code or its district begins with the wanted one."""
    h, w = compact(held), compact(wanted)
    return F.when(is_full(wanted), h == w).otherwise((w != "") & (h.startswith(w) | district(held).startswith(w)))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in miles."""
    half = lambda a, b: F.sin(F.radians(b - a) / 2)
    h = half(lat1, lat2) * half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2) * half(lon1, lon2)
    return EARTH_MILES * 2 * F.atan2(F.sqrt(h), F.sqrt(1 - h))
