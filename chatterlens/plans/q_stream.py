"""Catalog: Structured Streaming front ends (slice 9).

Each query lets data derived from the given tables arrive as consecutive time
slices, streams each with ``Trigger.AvailableNow`` under one checkpoint, and
returns the sink read back; the SQL twin is the batch answer, so the
oracle check is "stream = batch".
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import cut_lineage, scratch_path
from ..sources.fixtures import posts_view, table
from ..streaming import fronts as Z
from .common import POSTS_CTE, Query, finalize, token_ctes, wrap_sql

SLICES = 4
#: The events of a user lie hours apart: a day without one ends a session.
SESSION_GAP = "1 day"


def _stream_in_time_order(df, ts_col_expr, name, build):
    """Let ``df`` arrive as SLICES consecutive time slices and, after each
    arrival, run the streaming query ``build(stream)`` over what is new: a slice
    is one micro-batch of as many files as it has partitions, in time order, so
    no row is late.  Returns the sink folder."""
    spark = df.sparkSession
    df = cut_lineage(df)
    lo, hi = df.select(F.min(ts_col_expr), F.max(ts_col_expr)).first()
    source, run = scratch_path(spark, name), None
    for i in range(SLICES):
        a = lo + (hi - lo) * i / SLICES
        b = lo + (hi - lo) * (i + 1) / SLICES
        cond = (ts_col_expr >= a) & ((ts_col_expr < b) if i < SLICES - 1 else (ts_col_expr <= b))
        df.filter(cond).write.mode("append").parquet(source)
        stream = spark.readStream.schema(df.schema).parquet(source)
        run = Z.run_available_now(build(stream), name, run)
    return run[0]


def q_stream_daily_terms(spark, sf):
    p = posts_view(spark, sf).select("id", "created_utc", "title")
    out = _stream_in_time_order(p, F.col("created_utc").cast("double"), "daily-terms", Z.daily_term_counts_stream)
    res = Z.latest_rows(spark, out, ["day", "word"])
    return finalize(res.select(F.to_date(F.col("day.start")).alias("date"), "word", "cf"))


def _polls(spark, sf):
    return table(spark, sf, "events").select(F.col("user_id").alias("post_id"),
                                             F.col("ts").cast("timestamp").alias("ts"),
                                             F.col("value").alias("score"))


def q_stream_snapshots(spark, sf):
    out = _stream_in_time_order(_polls(spark, sf), F.unix_micros("ts").cast("double"), "snapshots",
                                lambda s: Z.snapshot_stream(s, "3 hours"))
    res = Z.latest_rows(spark, out, ["post_id", "span"])
    return finalize(res.select("post_id", F.to_date(F.col("span.start")).alias("day"),
                               "first_score", "last_score", "polls"))


def q_stream_post_snapshots(spark, sf):
    """First and last score of each post over all its finished and open spans."""
    out = _stream_in_time_order(_polls(spark, sf), F.unix_micros("ts").cast("double"), "post-snapshots",
                                lambda s: Z.snapshot_stream(s, "3 hours"))
    return finalize(Z.per_post(Z.latest_rows(spark, out, ["post_id", "span"])))


def q_stream_sessions(spark, sf):
    """Sessions of each post's polls.  Polls arrive in time slices; those of a
    slice's last hour come with the next slice too, every other one of them only then,
    so there are repeated polls and polls that are late within the watermark's delay.  A
    poll of no post, two days on, lets the watermark pass the last sessions."""
    polls = cut_lineage(_polls(spark, sf).filter(F.col("post_id").isNotNull() & F.col("ts").isNotNull()))
    us = F.unix_micros("ts")
    lo, hi = polls.select(F.min(us), F.max(us)).first()
    source, run = scratch_path(spark, "polls"), None
    if lo is None:
        lo, hi = 0, 0
    ends = [lo + (hi - lo) * (i + 1) // SLICES for i in range(SLICES)]
    for i, end in enumerate([*ends, None]):
        start = ends[i - 1] if i else lo - 1
        if end is None:
            part = spark.range(1).select(F.lit(None).cast(polls.schema["post_id"].dataType).alias("post_id"),
                                         F.timestamp_micros(F.lit(hi + 2 * 86_400_000_000)).alias("ts"),
                                         F.lit(None).cast(polls.schema["score"].dataType).alias("score"))
        else:
            hour, held = 3_600_000_000, F.pmod(F.xxhash64("ts", "score"), F.lit(2)) == 0
            again = (us > start - hour) & (us <= start) if i else F.lit(False)
            new = (us > start) & (us <= end)
            if i < SLICES - 1:
                new = new & ~((us > end - hour) & held)
            part = polls.filter(new | again)
        part.write.mode("append").parquet(source)
        run = Z.run_available_now(Z.session_stream(spark.readStream.schema(polls.schema).parquet(source), SESSION_GAP), "sessions", run, "append")
    out = spark.read.schema("post_id long, first_score double, last_score double, first_ts timestamp, last_ts timestamp, polls long") \
        .parquet(run[0])
    return finalize(out.select("post_id", F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us"),
                               "first_score", "last_score", "polls"))


SQL = {
    "stream_sessions": wrap_sql("""WITH p AS (SELECT DISTINCT user_id AS post_id, epoch_us(ts) AS us, value AS score FROM events
  WHERE user_id IS NOT NULL AND ts IS NOT NULL),
l AS (SELECT *, coalesce(us - lag(us) OVER (PARTITION BY post_id ORDER BY us) > 86400000000, false) AS fresh FROM p),
s AS (SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY post_id ORDER BY us) AS nth FROM l)
SELECT post_id, min(us) AS first_us, max(us) AS last_us, arg_min(score, (us, score)) AS first_score,
  arg_max(score, (us, score)) AS last_score, count(*) AS polls FROM s GROUP BY post_id, nth""", doubles=("first_score", "last_score")),
    "stream_daily_terms": wrap_sql(f"""WITH {POSTS_CTE},
{token_ctes()}
SELECT date, word, count(*) AS cf FROM words GROUP BY date, word""", texts=("date",)),
    "stream_snapshots": wrap_sql("""SELECT user_id AS post_id, CAST(ts AS DATE) AS day, arg_min(value, ts) AS first_score,
  arg_max(value, ts) AS last_score, count(*) AS polls FROM events GROUP BY user_id, CAST(ts AS DATE)""",
                                 doubles=("first_score", "last_score"), texts=("day",)),
    "stream_post_snapshots": wrap_sql("""SELECT user_id AS post_id, arg_min(value, ts) AS first_score,
  arg_max(value, ts) AS last_score, count(*) AS polls FROM events GROUP BY user_id""",
                                      doubles=("first_score", "last_score")),
}

QUERIES = [
    Query("stream_daily_terms", q_stream_daily_terms, SQL["stream_daily_terms"], ("Z01", "S12")),
    Query("stream_snapshots", q_stream_snapshots, SQL["stream_snapshots"], ("Z02", "W06")),
    Query("stream_sessions", q_stream_sessions, SQL["stream_sessions"], ("Z02",)),
    Query("stream_post_snapshots", q_stream_post_snapshots, SQL["stream_post_snapshots"], ("Z02",)),
]
