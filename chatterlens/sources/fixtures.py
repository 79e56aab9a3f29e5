"""Adapters that derive the canonical ``posts`` and ``comments`` tables from
the supplied parquet tables, deterministically and with arithmetic DuckDB can
repeat verbatim (the SQL copies live in :mod:`chatterlens.plans.common`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]

# --- fixed values: adapter arithmetic (shared with the SQL twin) -------------
EPOCH_BASE = 1704067200       # 2024-01-01 00:00:00 UTC
EPOCH_STRIDE = 104729         # spreads doc ids over the month
EPOCH_SPAN = 2592000          # 30 days in seconds
NONE_AUTHOR_MOD = 23          # user ids divisible by this act as deleted authors
# ------------------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def posts_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``posts``: one row per document, joined to its event (same id).

    Both inputs are large at scale; the join is an equi-join on the id, so
    Spark plans a shuffle (sort-merge) join, or AQE turns it into a broadcast
    when one side is measured small at run time.  Titles are cut before the join,
    so whole texts are shuffled only for queries that read them.
    """
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "source", F.substring_index("text", "\n", 1).alias("title"))
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "props")
    j = d.join(e, d.doc_id == e.event_id, "inner")
    doc = F.col("doc_id")
    return j.select(
        F.concat(F.lit("p"), doc.cast("string")).alias("id"),
        F.col("source").alias("subreddit"),
        "title",
        F.col("text").alias("selftext"),
        F.when(F.col("user_id") % NONE_AUTHOR_MOD == 0, F.lit("None"))
         .otherwise(F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("author"),
        (F.lit(EPOCH_BASE) + (doc * EPOCH_STRIDE) % EPOCH_SPAN).cast("bigint").alias("created_utc"),
        F.floor("value").cast("bigint").alias("ups"),
        ((F.lit(50) + (doc * 37) % 51).cast("double") / F.lit(100.0)).alias("upvote_ratio"),
        ((doc * 131) % 12000).cast("bigint").alias("num_comments"),
        (doc % 7 != 0).alias("is_self"),
        F.when(doc % 11 == 0, F.lit("moderator")).alias("removed_by_category"),
        F.col("event_type").alias("award_name"),
        F.get_json_object("props", "$.k").cast("int").alias("award_count"),
    )


def comments_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``comments``: conversation turns as a reply forest (turn t replies to t-1)."""
    c = table(spark, sf_dir, "conversations")
    cid, turn = F.col("conv_id"), F.col("turn")
    return c.select(
        F.concat(cid.cast("string"), F.lit("_"), turn.cast("string")).alias("name"),
        F.when(turn > 0, F.concat(cid.cast("string"), F.lit("_"), (turn - 1).cast("string")))
         .alias("parent_id"),
        turn.cast("int").alias("depth"),
        F.concat(F.lit("a"), ((cid * 7 + turn * 3) % 97).cast("string")).alias("author"),
        ((cid * 13 + turn * 29) % 41 - 10).cast("bigint").alias("score"),
        F.col("text").alias("selftext"),
    )


def pooled_comments_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``comments`` of seven forums with authors of their own, who also get scores
    far below zero."""
    cid, turn = F.col("conv_id"), F.col("turn")
    return comments_view(spark, sf_dir).drop("author", "score").join(
        table(spark, sf_dir, "conversations").select(
            F.concat(cid.cast("string"), F.lit("_"), turn.cast("string")).alias("name"),
            F.concat(F.lit("f"), (cid % 7).cast("string"), F.lit("_"), ((cid * 7 + turn * 3) % (13 + cid % 7)).cast("string")).alias("author"),
            ((cid * 13 + turn * 29) % 41 - 25).cast("bigint").alias("score")), "name")
