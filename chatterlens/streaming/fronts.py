"""Structured Streaming front ends over the batch operators.

* Z01 ``daily_term_counts_stream``: posts arriving as files -> tokens ->
  ``withWatermark("ts", "1 day")`` -> ``groupBy(window(ts, "1 day"), word)``.
* Z02 ``snapshot_stream``: score polls -> first / last / count per post and
  event-time span by ``min_by`` / ``max_by`` in update mode; ``per_post`` rolls
  the spans up, so the state is bounded by the watermark and yet every post's
  whole history counts.

* Z02 ``session_stream``: the same polls, repeated ones dropped, cut into sessions
  wherever a post is not polled for longer than ``gap``; a session is written once,
  when the watermark has passed its end (append mode, the only one for sessions).

The first two run in *update* mode through ``foreachBatch``: every micro-batch writes
its changed rows under ``<out>/batch=<id>`` (overwrite of that one folder, so
a retried batch is idempotent), and :func:`latest_rows` reads the sink back
keeping each key's row from the highest batch.  The watermark bounds the
state: windows older than the watermark are dropped from the state store.
Checkpoint and output folders live under the shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import tokenize
from ..session import scratch_path


def _upsert_sink(out: str):
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
    return write


def run_available_now(stream: DataFrame, name: str, run: tuple[str, str] | None = None, mode: str = "update",
                      late: dict | None = None) -> tuple[str, str]:
    """Drive ``stream`` over everything available, then stop; returns the sink
    and checkpoint folders, which ``run`` of a later call goes on with.  ``late``
    gets, for each micro-batch, the number of rows that came behind the watermark
    and were left out."""
    spark = stream.sparkSession
    out, ckpt = run or (scratch_path(spark, f"{name}-out"), scratch_path(spark, f"{name}-ckpt"))
    q = (stream.writeStream.outputMode(mode).foreachBatch(_upsert_sink(out))
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    while not q.awaitTermination(1):  # progress is kept for the last batches only
        _count_late(q, late)
    _count_late(q, late)
    return out, ckpt


def _count_late(q, late: dict | None) -> None:
    for p in q.recentProgress if late is not None else []:
        late[p["batchId"]] = sum(op["numRowsDroppedByWatermark"] for op in p["stateOperators"])


def latest_rows(spark: SparkSession, out: str, keys) -> DataFrame:
    """Read an update-mode sink back: the last written row per key."""
    df = spark.read.parquet(out)
    w = Window.partitionBy(*keys).orderBy(F.col("batch").desc())
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1).drop("_r", "_batch", "batch")


def daily_term_counts_stream(posts_stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Z01 on a streaming posts source with ``created_utc`` and ``title``."""
    s = posts_stream.withColumn("ts", F.timestamp_seconds("created_utc"))
    s = s.withWatermark("ts", delay)
    w = s.select("ts", F.explode(F.flatten(tokenize(F.col("title")))).alias("word"))
    return w.groupBy(F.window("ts", "1 day").alias("day"), "word").agg(F.count(F.lit(1)).alias("cf"))


def snapshot_stream(polls: DataFrame, delay: str = "3 hours", span: str = "1 day") -> DataFrame:
    """Z02 on a streaming source of ``(post_id, ts, score)`` polls: first /
    last score and poll count per post and event-time window of ``span``.
    Grouping by the window lets the watermark evict finished windows, so the
    state stays bounded however many posts arrive."""
    s = polls.withWatermark("ts", delay)
    return s.groupBy("post_id", F.window("ts", span).alias("span")).agg(
        F.min_by("score", "ts").alias("first_score"), F.max_by("score", "ts").alias("last_score"),
        F.count(F.lit(1)).alias("polls"))


def session_stream(polls: DataFrame, gap: str = "65 minutes", delay: str = "3 hours") -> DataFrame:
    """Z02 as sessions of a streaming source of ``(post_id, ts, score)`` polls: first and
    last score and poll count of each run of polls that are at most ``gap`` apart.

    A poll that is sent again (same post, time and score) counts once: its key stays in
    the state for as long as the watermark lets its time in, and is late after that.
    Late polls are left out and counted (:func:`run_available_now`).  Polls without a
    post or a time belong to no session; they only move the watermark on."""
    once = polls.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["post_id", "ts", "score"])
    at = F.struct("ts", "score")
    return once.groupBy("post_id", F.session_window("ts", gap).alias("session")).agg(
        F.min_by("score", at).alias("first_score"), F.max_by("score", at).alias("last_score"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("polls")) \
        .filter(F.col("post_id").isNotNull())


def per_post(spans: DataFrame) -> DataFrame:
    """First / last score and poll count of each post from its spans."""
    return spans.groupBy("post_id").agg(F.min_by("first_score", "span.start").alias("first_score"),
                                        F.max_by("last_score", "span.start").alias("last_score"),
                                        F.sum("polls").alias("polls"))
