"""Attribute-value rows into wide typed tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Attributes a wide table may have at most; the list is collected, so its size is checked.
MAX_ATTRS = 2000
#: Accepted spellings.
TRUE, FALSE = ("yes", "true", "1"), ("no", "false", "0")

SPARK_TYPES = {"string": "string", "int": "decimal(38,0)", "decimal": "decimal(38,2)", "bool": "boolean", "date": "date"}


def discover(attr_types: DataFrame) -> list[tuple[str, str]]:
    """The attributes and their types, sorted; the smallest type wins where one attribute has several.

    Unknown types and nulls are refused or dropped: a null attribute or type declares nothing, an unknown
    type raises ``ValueError``, as does a list longer than ``MAX_ATTRS``.
    """
    rows = attr_types.select("attr", "attr_type").dropna().groupBy("attr").agg(F.min("attr_type").alias("t")).limit(MAX_ATTRS + 1).collect()
    if len(rows) > MAX_ATTRS:
        raise ValueError(f"more than {MAX_ATTRS} attributes")
    bad = {r.t for r in rows} - set(SPARK_TYPES)
    if bad:
        raise ValueError(f"unknown attribute types {sorted(bad)}")
    return sorted((r.attr, r.t) for r in rows)


def cast_text(value: Column, kind: str, bounded: bool = True) -> Column:
    """The canonical text of a value if it fits the type, else null. Blanks and tabs around it do not count.

    ``bounded`` numbers fit decimal(38), others have any number of digits.
    """
    v = F.btrim(value, F.lit(" \t"))
    if kind == "string":
        return F.when(v != "", v)
    if kind == "int":
        digits = F.regexp_replace(F.regexp_extract(v, r"^[+-]?([0-9]+)$", 1), r"^0+(?=[0-9])", "")
        text = F.when(v.startswith("-") & (digits != "0"), F.concat(F.lit("-"), digits)).otherwise(digits)
        return F.when((digits != "") & (F.length(digits) <= 38 if bounded else F.lit(True)), text)
    if kind == "decimal":
        whole = F.regexp_replace(F.regexp_extract(v, r"^([0-9]+)(?:[.,][0-9]{1,2})?(?: ?m)?$", 1), r"^0+(?=[0-9])", "")
        part = F.regexp_extract(v, r"^[0-9]+[.,]([0-9]{1,2})(?: ?m)?$", 1)
        return F.when((whole != "") & (F.length(whole) <= 36 if bounded else F.lit(True)), F.concat(whole, F.lit("."), F.rpad(part, 2, "0")))
    if kind == "bool":
        low = F.lower(v)
        return F.when(low.isin(*TRUE), "true").when(low.isin(*FALSE), "false")
    if kind == "date":
        iso = F.regexp_replace(F.regexp_replace(F.when(v.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$|^[0-9]{4}/[0-9]{2}/[0-9]{2}$|^[0-9]{2}\.[0-9]{2}\.[0-9]{4}$"), v), "/", "-"), r"^([0-9]{2})\.([0-9]{2})\.([0-9]{4})$", "$3-$2-$1")
        return F.when(iso.try_cast("date").isNotNull() & ~iso.startswith("0000"), iso)
    raise ValueError(kind)


def pivot_wide(rows: DataFrame, entity: Sequence[str], attrs: Sequence[tuple[str, str]], attr: str = "attr", value: str = "value", order: str = "pos") -> DataFrame:
    """One row per entity with a text column per attribute (canonical, see ``cast_text``), null where none fits.

    One conditional aggregation per attribute: of several rows for one cell the first by ``order`` whose value
    fits wins, ties by the smaller text. Attributes out of the list, null attributes, values and orders fill
    no cell; entities without any fitting value still get their row if they have any attribute row.
    """
    cells = [
        F.min(F.when((F.col(attr) == a) & F.col(order).isNotNull() & fits.isNotNull(), F.struct(F.col(order).alias("o"), fits.alias("t")))).alias(f"_{i}")
        for i, (a, k) in enumerate(attrs)
        for fits in [F.col(f"_fit_{k}")]
    ]
    kinds = sorted({k for _, k in attrs})
    prepared = rows.withColumns({f"_fit_{k}": F.when(F.col(attr).isin([a for a, kk in attrs if kk == k]), cast_text(F.col(value), k, bounded=False)) for k in kinds})
    if not cells:
        return rows.select(*entity).distinct()
    out = prepared.groupBy(*entity).agg(*cells)
    return out.select(*entity, *[F.col(f"_{i}.t").alias(a) for i, (a, _) in enumerate(attrs)])


def typed(wide: DataFrame, entity: Sequence[str], attrs: Sequence[tuple[str, str]]) -> DataFrame:
    """The wide table with typed columns; a number of more digits than decimal(38) holds is null."""
    return wide.select(*entity, *[F.col(f"`{a}`").try_cast(SPARK_TYPES[k]).alias(a) for a, k in attrs])


def cells(wide: DataFrame, entity: Sequence[str], attrs: Sequence[tuple[str, str]]) -> DataFrame:
    """The filled cells of a wide text table, one row each: entity, ``attr, attr_text``; none without attributes."""
    if not attrs:
        return wide.filter(F.lit(False)).select(*entity, F.lit("").alias("attr"), F.lit("").alias("attr_text"))
    each = F.array(*[F.struct(F.lit(a).alias("attr"), F.col(f"`{a}`").alias("attr_text")) for a, _ in attrs])
    return wide.select(*entity, F.explode(each).alias("c")).select(*entity, "c.attr", "c.attr_text").filter("attr_text is not null")
