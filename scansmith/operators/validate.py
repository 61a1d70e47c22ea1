"""Which captured values are findings: predicates over a value, by the check that its pattern names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from scansmith import catalog as C
from scansmith.functions.text import java


def _holds_any(v: Column, parts: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(v, F.lit(p)) for p in parts))


def _ends_any(v: Column, ends: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.endswith(v, F.lit(e)) for e in ends))


def endpoint(v: Column) -> Column:
    long_part = v.rlike("[^/]{2}")
    # what begins a value is sought at its beginning alone, not at every place of it
    parts = [part for p in C.NOISE_ENDPOINTS for part in p.split("|")]
    first, rest = [p[1:] for p in parts if p.startswith("^")], [p for p in parts if not p.startswith("^")]
    noise = v.rlike(java(f"^(?:{'|'.join(first)})")) | v.rlike(java("|".join(rest)))
    return (F.length(v) >= 3) & ~v.isin(C.NOISE_STRINGS) & F.startswith(v, F.lit("/")) & long_part & ~noise


def url(v: Column) -> Column:
    low = F.lower(v)
    bad = _holds_any(low, [*C.NOISE_DOMAINS, "undefined", "null"]) | F.contains(v, F.lit("{")) | F.startswith(low, F.lit("data:")) | _ends_any(low, C.URL_NOISE_ENDINGS)
    return (F.length(v) >= 15) & ~bad


def secret(v: Column) -> Column:
    return (F.length(v) >= 10) & ~_holds_any(F.lower(v), C.SECRET_NOISE)


def email(v: Column) -> Column:
    low = F.lower(v)
    return F.contains(v, F.lit("@")) & ~F.substring_index(low, "@", -1).isin(C.EMAIL_NOISE_DOMAINS) & ~_holds_any(low, C.EMAIL_NOISE)


def file(v: Column) -> Column:
    low = F.lower(v)
    short_json = F.endswith(low, F.lit(".json")) & (F.length(F.substring_index(v, "/", -1)) <= 7)
    return (F.length(v) >= 3) & ~_holds_any(low, C.FILE_NOISE) & ~F.endswith(low, F.lit(".map")) & ~short_json


CHECKS = {
    "endpoint": endpoint,
    "url": url,
    "secret": secret,
    "email": email,
    "file": file,
    "sourcemap": lambda v: (F.length(v) > 0) & ~F.startswith(v, F.lit("data:")),
    "over3": lambda v: F.length(v) > 3,
    "over2": lambda v: F.length(v) > 2,
    "nonempty": lambda v: F.length(v) > 0,
}
