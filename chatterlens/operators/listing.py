"""Listings of every community: top, new, controversial, rising and random posts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .orderstat import split_key

KINDS = ("top", "new", "controversial", "rising", "random")


def community_listings(posts: DataFrame, n: int, kinds=KINDS, seed: int = 42) -> DataFrame:
    """``(subreddit, kind, place, id)``: the first ``n`` posts of each listing of each
    community, places from 1.

    ``top``: most votes; ``new``: latest; ``controversial``: vote ratio nearest one half,
    then most votes; ``rising``: votes for each hour of age, two hours added, as of the
    community's latest post; ``random``: a seeded order of the ids, the same on every run.
    Ties go to the smaller id; posts without the value come last, those of no
    community are a community of their own.

    All listings are one pass: a row per post and kind, cut to ``n`` rows per community and
    kind in each task before the shuffle, so a hot community sends ``n`` rows a task.
    """
    latest = posts.groupBy("subreddit").agg(F.max("created_utc").alias("_latest"))
    p, l = posts.alias("p"), latest.alias("l")
    rows = p.join(l, F.col("p.subreddit").eqNullSafe(F.col("l.subreddit"))).select("p.*", "_latest")
    ups, none = F.col("ups").cast("double"), F.lit(0.0)
    hours = (F.col("_latest") - F.col("created_utc")) / 3600.0 + 2.0
    order = {"top": (ups, none), "new": (F.col("created_utc").cast("double"), none),
             "controversial": (-F.abs(F.col("upvote_ratio") - 0.5), ups), "rising": (ups / hours, none),
             "random": (split_key("id", seed).cast("double"), none)}
    each = rows.select("subreddit", "id", F.explode(F.array(*(
        F.struct(F.lit(k).alias("kind"), order[k][0].alias("a"), order[k][1].alias("b")) for k in kinds))).alias("o"))
    each = each.select("subreddit", "id", "o.kind", "o.a", "o.b")
    w = Window.partitionBy("subreddit", "kind").orderBy(F.desc_nulls_last("a"), F.desc_nulls_last("b"), "id")
    return each.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n).select("subreddit", "kind", "place", "id")
