"""Current row per element and per-blob lookups shared by the operators on stored element tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOB_KEY = ["file_path", "blob_offset"]

#: Fixed values of the block format: what an unset field of a data block means.
UNSET = {"granularity": 100, "lat_offset": 0, "lon_offset": 0, "date_granularity": 1000}


def blob_params(blobs: DataFrame) -> DataFrame:
    """One row per blob with its scaling parameters, unset ones replaced by their format defaults.

    A blob that is listed twice keeps its largest values, so a repeated row never multiplies elements.
    Rows with a null key name no blob and are dropped.
    """
    return (
        blobs.filter(F.col("file_path").isNotNull() & F.col("blob_offset").isNotNull())
        .groupBy(*BLOB_KEY)
        .agg(*[F.max(c).alias(c) for c in UNSET])
        .select(*BLOB_KEY, *[F.coalesce(F.col(c), F.lit(v)).cast("bigint").alias(c) for c, v in UNSET.items()])
    )


def with_blob_params(df: DataFrame, blobs: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Left-join scaling parameters; an element of an unlisted blob gets the format defaults.

    No broadcast hint: the blob list grows with the data, so Spark's own size check decides.
    """
    params = blob_params(blobs).select(*BLOB_KEY, *columns)
    out = df.join(params, BLOB_KEY, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(UNSET[c]).cast("bigint")) for c in columns})


def visible(column: Column) -> Column:
    """A null flag means visible."""
    return F.coalesce(column, F.lit(True))


def current_rows(df: DataFrame, keys: Sequence[str], payload: Sequence[str], version: str = "info_version") -> DataFrame:
    """The row of highest version per key; a null version counts as lowest, ties take the greatest payload.

    One partial and one final aggregation with a constant-size buffer per key: a key that holds a third
    of all rows is reduced before the shuffle. Rows with a null key are dropped. Only ``keys`` and
    ``payload`` are read, so extra columns with clashing names do no harm.
    """
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    top = F.max(F.struct(F.col(version).alias("v"), *[F.col(c) for c in payload])).alias("_top")
    return df.filter(cond).groupBy(*keys).agg(top).select(*keys, *[F.col(f"_top.{c}").alias(c) for c in payload])


def present_ids(elements: DataFrame, key: str = "id", version: str = "info_version", flag: str = "info_visible") -> DataFrame:
    """Ids whose current row is visible.

    Version and flag are packed into one number, so the aggregation stays a hash aggregation on longs.
    Tied rows are equal in content; should they differ in the flag, a visible one wins.
    """
    packed = F.coalesce(F.col(version).cast("bigint"), F.lit(-(1 << 40)).cast("bigint")) * 2 + F.when(visible(F.col(flag)), 1).otherwise(0)
    return (
        elements.filter(F.col(key).isNotNull())
        .groupBy(F.col(key).alias(key))
        .agg(F.max(packed).alias("_p"))
        .filter(F.pmod(F.col("_p"), F.lit(2)) == 1)
        .select(key)
    )


def resolve_tags(df: DataFrame, string_tables: DataFrame, pairs: Column, only: Sequence[str] | None = None) -> DataFrame:
    """Replace string ids by strings: adds ``tags array<struct<pos,key,value>>`` in stored order.

    ``pairs`` is an ``array<struct<k int, v int>>`` of string ids. Keys come out in lower case without outer
    blanks. An id outside its blob's table, an unknown blob or a null id gives no tag. With ``only`` just
    tags of those keys are kept, which keeps everything after the join narrow.
    """
    strings = string_tables.filter(F.col("file_path").isNotNull()).select(*BLOB_KEY, F.col("strings").alias("_strings"))
    out = df.withColumn("_pairs", pairs).join(strings, BLOB_KEY, "left")
    tags = F.transform(
        F.coalesce(F.col("_pairs"), F.array().cast("array<struct<k:int,v:int>>")),
        lambda p, i: F.struct(
            i.alias("pos"),
            F.lower(F.btrim(F.get(F.col("_strings"), p["k"]), F.lit(" \t"))).alias("key"),
            F.get(F.col("_strings"), p["v"]).alias("value"),
        ),
    )
    keep = (lambda t: t["key"].isin(list(only)) & t["value"].isNotNull()) if only is not None else (lambda t: t["key"].isNotNull() & t["value"].isNotNull())
    return out.withColumn("tags", F.filter(tags, keep)).drop("_pairs", "_strings")


def dense_pairs(column: str = "keys_vals_indices") -> Column:
    """``array<struct<k,v>>`` of an alternating key/value id list; a lone last id is no tag."""
    a = F.coalesce(F.col(column), F.array().cast("array<int>"))
    n = (F.size(a) / 2).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get(a, i * 2).alias("k"), F.get(a, i * 2 + 1).alias("v"))))


def zip_pairs(keys: str = "key_indices", vals: str = "val_indices") -> Column:
    """``array<struct<k,v>>`` of two parallel id lists; surplus entries of the longer one are no tags."""
    a, b = F.col(keys), F.col(vals)
    n = F.least(F.size(F.coalesce(a, F.array().cast("array<int>"))), F.size(F.coalesce(b, F.array().cast("array<int>"))))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get(a, i).alias("k"), F.get(b, i).alias("v"))))


def present_elements(nodes: DataFrame, ways: DataFrame, string_tables: DataFrame, only: Sequence[str] | None = None) -> DataFrame:
    """Present nodes and ways with their tags: ``elem_kind, id, tags``.

    Tags are resolved first, on the blob key, so that the second and last shuffle on (kind, id) both picks
    the current row and leaves the rows partitioned for whatever groups by element afterwards.
    """
    cols = [*BLOB_KEY, "id", "info_version", "info_visible"]
    both = (
        nodes.select(*cols, dense_pairs().alias("_p"), F.lit("node").alias("elem_kind"))
        .unionByName(ways.select(*cols, zip_pairs().alias("_p"), F.lit("way").alias("elem_kind")))
    )
    tagged = resolve_tags(both, string_tables, F.col("_p"), only).withColumn("vis", visible(F.col("info_visible")))
    cur = current_rows(tagged, ["elem_kind", "id"], ["vis", "tags"])
    return cur.filter("vis").select("elem_kind", "id", "tags")
