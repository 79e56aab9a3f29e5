"""Cleaning filters and post predicates (P01-P14) as DataFrame transforms.

All of them are ``filter`` / ``withColumn`` chains, so Catalyst pushes the
simple comparisons into the parquet scan and prunes unused columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import REMOVED_BODIES, THREAD_TITLE_RE, not_thread_title
from ..functions.timeparts import hour_of_week, utc_ts


def data_setup(df: DataFrame, exclude_removed: bool = True, drop_na_cols=("title",)) -> DataFrame:
    """Text posts only, optionally live posts only, drop nulls, add UTC time."""
    out = df.filter(F.col("is_self") == True)  # noqa: E712
    if exclude_removed:
        out = out.filter(F.col("removed_by_category").isNull())
    if drop_na_cols:
        out = out.dropna(subset=list(drop_na_cols))
    return out.withColumn("created_datetime_utc", utc_ts("created_utc"))


def preprocess(df: DataFrame, pattern: str = THREAD_TITLE_RE) -> DataFrame:
    """Drop deleted authors, removed and non-text posts, recurring
    threads, null title/selftext; add time columns (D01, D08, D10)."""
    out = (df.filter(F.col("author") != "None")
             .filter(F.col("removed_by_category").isNull() & (F.col("is_self") == True)  # noqa: E712
                     & not_thread_title("title", pattern))
             .dropna(subset=["title", "selftext"]))
    ts = utc_ts("created_utc")
    return (out.withColumn("created_datetime_utc", ts)
               .withColumn("weektime", hour_of_week(ts))
               .withColumn("time_of_day", F.hour(ts))
               .withColumn("day", F.dayofmonth(ts)))


def popularity_bounds(df: DataFrame, min_ups: int = 10, max_comments: int = 10000,
                      drop_ids=()) -> DataFrame:
    """``ups >= min_ups & num_comments <= max_comments``, minus named ids."""
    out = df.filter((F.col("ups") >= min_ups) & (F.col("num_comments") <= max_comments))
    if drop_ids:
        out = out.filter(~F.col("id").isin(list(drop_ids)))
    return out


def split_live_removed(df: DataFrame):
    """(live, removed) on ``removed_by_category`` null."""
    c = F.col("removed_by_category")
    return df.filter(c.isNull()), df.filter(c.isNotNull())


def removed_body(c="selftext"):
    """Body is one of the removed markers."""
    return F.col(c).isin(REMOVED_BODIES)


def ignored_post(ups="ups", ratio="upvote_ratio"):
    """Nobody voted: ``ups = 1 and upvote_ratio = 1.0``."""
    return (F.col(ups) == 1) & (F.col(ratio) == 1.0)


def comment_range_ids(df: DataFrame, lower: int) -> DataFrame:
    """Ids with ``lower <= num_comments <= max(num_comments)`` (the bound
    is the column's maximum, not an id as upstream)."""
    mx = df.agg(F.max("num_comments")).scalar()
    return df.filter(F.col("num_comments").between(F.lit(lower), mx))
