"""Relational tables as extracts: the mapping that queries and benchmarks decode again."""

from __future__ import annotations

import atexit
import hashlib
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratamap.session import shared_folder, ship_package, table
from stratamap.sources import datasource
from stratamap.sources.files import Folder

#: Raised whenever the mapping or the writer changes, so that older files are not read again.
VERSION = 2
OFFSETS = {"lat_offset": "37", "lon_offset": "-41"}


def nano_lat(key: str | Column) -> Column:
    k = F.col(key) if isinstance(key, str) else key
    return (F.pmod(k.cast("bigint") * 791903, F.lit(1800000001)) - 900000000) * 100 + 37


def nano_lon(key: str | Column) -> Column:
    k = F.col(key) if isinstance(key, str) else key
    return (F.pmod(k.cast("bigint") * 1299709, F.lit(3600000001)) - 1800000000) * 100 - 41


def _tags(**pairs: Column) -> Column:
    return F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in pairs.items()])


def _info(version: Column, ms: Column, changeset: Column, uid: Column, user: Column, visible: Column) -> Column:
    return F.struct(version.cast("int").alias("version"), ms.cast("bigint").alias("timestamp_ms"), changeset.cast("bigint").alias("changeset"), uid.cast("int").alias("uid"), user.alias("user"), visible.alias("visible"))


def millis(ts: str) -> Column:
    return F.unix_millis(F.col(ts).cast("timestamp"))


COLUMNS = ["kind", "is_dense", "id", "nano_lat", "nano_lon", "tags", "info", "refs", "node_locations", "members"]


def _whole(df: DataFrame) -> DataFrame:
    """All columns of the sink; what a kind does not have is null."""
    kinds = {
        "kind": "string", "is_dense": "boolean", "id": "bigint", "nano_lat": "bigint", "nano_lon": "bigint", "tags": "array<struct<key:string,value:string>>",
        "info": "struct<version:int,timestamp_ms:bigint,changeset:bigint,uid:int,user:string,visible:boolean>", "refs": "array<bigint>",
        "node_locations": "array<struct<nano_lat:bigint,nano_lon:bigint>>", "members": "array<struct<member_type:string,member_id:bigint,role:string>>",
    }
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()])


def part_nodes(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return _whole(p.select(F.lit("node").alias("kind"), (F.col("p_partkey") % 2 == 0).alias("is_dense"), F.col("p_partkey").alias("id"), nano_lat("p_partkey").alias("nano_lat"), nano_lon("p_partkey").alias("nano_lon"), _tags(name=F.col("p_name"), brand=F.col("p_brand"), type=F.col("p_type")).alias("tags")))


def order_ways(spark: SparkSession, d: str, locations: bool = False) -> DataFrame:
    line = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"]).alias("refs"))
    o = table(spark, d, "orders").join(table(spark, d, "customer").select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey")).join(line, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    building = F.when(F.col("o_orderkey") % 97 == 0, _tags(building=F.lit("yes"))).otherwise(F.array().cast("array<struct<key:string,value:string>>"))
    out = o.select(
        F.lit("way").alias("kind"), F.col("o_orderkey").alias("id"), F.concat(_tags(status=F.col("o_orderstatus"), priority=F.col("o_orderpriority")), building).alias("tags"),
        _info(F.lit(1), millis("o_orderdate"), F.col("o_orderkey"), F.col("o_custkey"), F.col("c_name"), F.lit(True)).alias("info"), F.coalesce("refs", F.array().cast("array<bigint>")).alias("refs"),
    )
    if locations:
        out = out.withColumn("node_locations", F.transform("refs", lambda r: F.struct(nano_lat(r).alias("nano_lat"), nano_lon(r).alias("nano_lon"))))
    return _whole(out)


def nation_relations(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    o = table(spark, d, "orders").join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    way = o.select(F.col("c_nationkey").alias("k"), F.struct(F.lit(0).alias("o"), F.lit("way").alias("member_type"), F.col("o_orderkey").alias("member_id"), F.col("o_orderstatus").alias("role")).alias("m"))
    node = table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.struct(F.lit(1).alias("o"), F.lit("node").alias("member_type"), F.col("s_suppkey").alias("member_id"), F.lit("supplier").alias("role")).alias("m"))
    m = way.unionByName(node).groupBy("k").agg(F.array_sort(F.collect_list("m")).alias("members"))
    return _whole(n.join(m, F.col("n_nationkey") == F.col("k"), "left").select(F.lit("relation").alias("kind"), F.col("n_nationkey").cast("bigint").alias("id"), _tags(name=F.col("n_name"), region=F.col("r_name")).alias("tags"), F.coalesce("members", F.array().cast("array<struct<o:int,member_type:string,member_id:bigint,role:string>>")).alias("members")).withColumn("members", F.transform("members", lambda x: F.struct(x["member_type"].alias("member_type"), x["member_id"].alias("member_id"), x["role"].alias("role")))))


def event_history(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    e = table(spark, d, "events").withColumn("v", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return _whole(e.select(F.lit("node").alias("kind"), F.lit(True).alias("is_dense"), F.col("user_id").alias("id"), F.lit(0).alias("nano_lat"), F.lit(0).alias("nano_lon"), _tags(event_type=F.col("event_type")).alias("tags"), _info(F.col("v"), millis("ts"), F.col("event_id"), F.col("user_id"), F.lit("events"), F.col("event_type") != "error").alias("info")))


def _write(df: DataFrame, path: str, **options: str) -> None:
    df.write.format("strata_elements").mode("append").options(**options).save(path)


def extract_of(spark: SparkSession, d: str, name: str) -> str:
    """The folder of the extract ``main``, ``partial`` (parts with a key divisible by 5 left out), ``history`` or
    ``located``; written by the tasks once per session and state of the tables, removed when the driver ends."""
    ship_package(spark)
    datasource.register(spark)
    state = [VERSION, os.path.realpath(d), name]
    for t in ("part", "orders", "lineitem", "customer", "supplier", "nation", "region", "events"):
        p = f"{d}/{t}.parquet"
        files = [os.path.join(p, f) for f in sorted(os.listdir(p))] if os.path.isdir(p) else [p]
        state += [(f, os.path.getsize(f), os.path.getmtime(f)) for f in files]
    state.append(spark.sparkContext.applicationId)
    out = f"{shared_folder(spark).rstrip('/')}/{hashlib.sha1(repr(state).encode()).hexdigest()[:16]}-{name}"
    if "_COMPLETE" in Folder(out).names():
        return out
    atexit.register(Folder.remove, out)
    if name in ("main", "partial"):
        nodes = part_nodes(spark, d)
        if name == "partial":
            nodes = nodes.filter("id % 5 <> 0")
        n = spark.sparkContext.defaultParallelism
        _write(nodes.repartitionByRange(max(1, n // 2), "is_dense", "id").sortWithinPartitions("is_dense", "id"), out, **OFFSETS)
        _write(order_ways(spark, d).repartitionByRange(n, "id").sortWithinPartitions("id"), out)
        if name == "main":
            _write(nation_relations(spark, d).repartition(2, "id"), out)
    elif name == "history":
        _write(event_history(spark, d).repartitionByRange(4, "id").sortWithinPartitions("id", "info.version"), out, date_granularity="1", required_features="OsmSchema-V0.6,DenseNodes,HistoricalInformation")
    elif name == "located":
        _write(order_ways(spark, d, True).repartitionByRange(8, "id").sortWithinPartitions("id"), out, optional_features="LocationsOnWays", **OFFSETS)
    else:
        raise ValueError(name)
    Folder(out).create("_COMPLETE").close()
    return out


__all__ = ["extract_of"]
