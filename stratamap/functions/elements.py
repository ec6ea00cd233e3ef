"""Columns over decoded elements; all of them built-in expressions that stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(column: str | Column) -> Column:
    return F.col(column) if isinstance(column, str) else column


def degrees(nano: str | Column) -> Column:
    """Degrees of nanodegrees: a multiplication by 1e-9, null for null."""
    return F.lit(1e-9) * _c(nano).cast("double")


def decimicro(nano: str | Column) -> Column:
    """Hundreds of nanodegrees, cut toward zero, as int."""
    c = _c(nano)
    return ((c - c % 100) / 100).cast("int")


def with_coordinates(df: DataFrame) -> DataFrame:
    """Adds ``lat, lon, decimicro_lat, decimicro_lon`` to nodes."""
    return df.withColumns({"lat": degrees("nano_lat"), "lon": degrees("nano_lon"), "decimicro_lat": decimicro("nano_lat"), "decimicro_lon": decimicro("nano_lon")})


def has_tag(key: str, value: str | None = None, tags: str | Column = "tags") -> Column:
    """True if any tag has the key and, if given, the value; false for null or empty tags."""
    test = (lambda t: t["key"] == key) if value is None else (lambda t: (t["key"] == key) & (t["value"] == value))
    return F.coalesce(F.exists(_c(tags), test), F.lit(False))


def tag(key: str, tags: str | Column = "tags") -> Column:
    """The value of the first tag of that key, null without one; later duplicates stay in the array."""
    return F.get(F.filter(_c(tags), lambda t: t["key"] == key), F.lit(0))["value"]


def deleted(info: str | Column = "info") -> Column:
    """True if the element is marked invisible; no info or no flag means it is there."""
    return ~F.coalesce(_c(info)["visible"], F.lit(True))


def info_timestamp(info: str | Column = "info") -> Column:
    """Time of the element's version as a timestamp."""
    return F.timestamp_millis(_c(info)["timestamp_ms"])


def changeset(info: str | Column = "info") -> Column:
    return _c(info)["changeset"]
