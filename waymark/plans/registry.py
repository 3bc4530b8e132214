"""Queries by name, with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: SQL pieces: the synthetic position of a key, distances, and rounding with halves upwards.
LON = "(139.0::DOUBLE + ({0} * 7919 % 10000) / 10000.0::DOUBLE)"
LAT = "(35.0::DOUBLE + ({0} * 104729 % 10000) / 10000.0::DOUBLE)"


def pos(key: str, lon: str = "lon", lat: str = "lat") -> str:
    return f"{LON.format(key)} AS {lon}, {LAT.format(key)} AS {lat}"


def hav(lon1: str, lat1: str, lon2: str, lat2: str, radius: str = "6371008.8") -> str:
    a = f"(pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))"
    return f"(2 * {radius}::DOUBLE * atan2(sqrt({a}), sqrt(1 - {a})))"


def query(sql: str | None = None):
    """Register a function as the query of its name."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register
