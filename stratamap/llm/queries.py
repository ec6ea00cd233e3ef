"""Registered queries of this subpackage."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratamap.llm import abuse, encode, heavy, leak, together
from stratamap.llm.sql import ORACLES  # noqa: F401
from stratamap.operators.current import BLOB_KEY, present_elements
from stratamap.session import spread, table

TOKENIZERS = os.environ.get("STRATAMAP_TOKENIZERS", "/opt/tokenizers")


def _names(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences of user names and tag values, counted per blob and string id before strings are looked up."""
    users = table(spark, d, "node_updates").filter("info_user_sid > 0").select(*BLOB_KEY, F.col("info_user_sid").alias("sid"), F.lit("user").alias("field_name"))
    ways = table(spark, d, "ways").filter(F.size("key_indices") > 0).select(*BLOB_KEY, F.explode(F.slice("val_indices", 1, F.size("key_indices"))).alias("sid"), F.lit("val").alias("field_name"))
    counted = users.unionByName(ways).dropna().groupBy(*BLOB_KEY, "field_name", "sid").agg(F.count(F.lit(1)).alias("weight"))
    strings = table(spark, d, "string_tables").select(*BLOB_KEY, "strings")
    named = counted.join(strings, BLOB_KEY).select("field_name", F.get("strings", F.col("sid")).alias("item"), "weight")
    return named.filter("item is not null and (field_name = 'user' or item <> '')")


def p2_top(spark: SparkSession, d: str) -> DataFrame:
    """User names and tag values of at least 1 % with their counts."""
    return heavy.heavy_hitters(_names(spark, d), 0.01)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """User names and tag values that make up at least 1 % of their field."""
    return p2_top(spark, d).select("field_name", "item")


def _key_pairs(spark: SparkSession, d: str) -> DataFrame:
    elements = present_elements(table(spark, d, "dense_nodes"), table(spark, d, "ways"), table(spark, d, "string_tables"))
    return together.co_occurrence(elements.select(F.transform("tags", lambda t: t["key"]).alias("items")))


def p5_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of tag keys in one present element, with lift and log-likelihood ratio, rounded to six places."""
    return _key_pairs(spark, d).withColumns({c: F.round(c, 6) for c in ("lift", "llr")})


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of keys in at least 2 % of the tagged elements and three times as often as by chance."""
    return _key_pairs(spark, d).filter("n_ab >= 0.02 * n and n_ab * n >= 3 * n_a * n_b").select("key_a", "key_b")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids of every document by the 50k byte-level vocabulary."""
    return encode.encode_corpus(spread(table(spark, d, "documents").select("doc_id", "text")), f"{TOKENIZERS}/byte_bpe_50k.tiktoken")


def p7_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Ids of every document with the byte ends of their pre-tokens."""
    return encode.encode_corpus(spread(table(spark, d, "documents").select("doc_id", "text")), f"{TOKENIZERS}/byte_bpe_50k.tiktoken", offsets=True)


def p8_spans(spark: SparkSession, d: str) -> DataFrame:
    """The passages of each test item in each document, with their places in words and characters."""
    return leak.find_leaks(spread(table(spark, d, "documents").select("doc_id", "text")), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold a passage of a test item, and the item."""
    return p8_spans(spark, d).select("doc_id", "item_id").distinct()


def p8_removal(spark: SparkSession, d: str) -> DataFrame:
    """Spans to remove from each document: its passages of all test items, merged where they overlap."""
    return leak.merge_spans(p8_spans(spark, d))


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    """Score and verdict of every document."""
    return abuse.score_documents(spread(table(spark, d, "documents").select("doc_id", "source", "text")), table(spark, d, "content_labels"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold abusive, hateful or sexual content."""
    return p9_scores(spark, d).filter("is_abusive").select("doc_id")


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    """Abusive documents per source."""
    return abuse.rates_by_source(p9_scores(spark, d))


QUERIES = {f.__name__: f for f in (p8_found, p8_spans, p8_removal, p9_found, p9_scores, p9_rates, p2_found, p2_top, p5_found, p5_pairs, p7_ids, p7_offsets)}
