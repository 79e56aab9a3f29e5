"""Shared pieces of the query catalog: result normalisation on the Spark side
and the SQL twins (DuckDB dialect) of the fixture adapters and tokenizer.

Oracle rules: counts are BIGINT, doubles are rounded to 6 places on both sides
(``+ 0.0`` in SQL folds a negative zero), dates and timestamps are compared as
ISO text.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.stopwords import ENGLISH_STOP_WORDS, sql_list
from ..functions.text import NON_ALPHA_RE, SENT_RE


@dataclass
class Query:
    name: str
    build: Callable  # (spark, sf_dir) -> DataFrame
    sql: str | None = None
    ids: tuple = field(default_factory=tuple)   # SURVEY operator ids covered
    doc: str = ""


def finalize(df: DataFrame, digits: int = 6) -> DataFrame:
    """Normalise output types: doubles rounded, integers BIGINT, dates as text."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        t = f.dataType
        if isinstance(t, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double"), digits).cast("double")
        elif isinstance(t, (T.IntegerType, T.ShortType, T.ByteType, T.LongType)):
            c = c.cast("bigint")
        elif isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            c = c.cast("string")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def wrap_sql(body: str, doubles=(), texts=(), digits: int = 6) -> str:
    """Round the named double columns and cast the named date columns to text."""
    rep = [f"round(CAST({c} AS DOUBLE), {digits}) + 0.0 AS {c}" for c in doubles]
    rep += [f"CAST({c} AS VARCHAR) AS {c}" for c in texts]
    if not rep:
        return body
    return f"SELECT * REPLACE ({', '.join(rep)}) FROM ({body}) AS _q"


STOPS_SQL = sql_list(ENGLISH_STOP_WORDS)

POSTS_CTE = """posts AS (
  SELECT 'p' || CAST(d.doc_id AS VARCHAR) AS id,
         d.source AS subreddit,
         split_part(d.text, chr(10), 1) AS title,
         d.text AS selftext,
         CASE WHEN e.user_id % 23 = 0 THEN 'None' ELSE 'u' || CAST(e.user_id AS VARCHAR) END AS author,
         CAST(1704067200 + (d.doc_id * 104729) % 2592000 AS BIGINT) AS created_utc,
         CAST(floor(e.value) AS BIGINT) AS ups,
         CAST(50 + (d.doc_id * 37) % 51 AS DOUBLE) / 100.0 AS upvote_ratio,
         CAST((d.doc_id * 131) % 12000 AS BIGINT) AS num_comments,
         d.doc_id % 7 <> 0 AS is_self,
         CASE WHEN d.doc_id % 11 = 0 THEN 'moderator' END AS removed_by_category,
         e.event_type AS award_name,
         CAST(json_extract_string(e.props, '$.k') AS INT) AS award_count
  FROM documents d JOIN events e ON e.event_id = d.doc_id
),
tposts AS (
  SELECT *, TIMESTAMP '1970-01-01 00:00:00' + to_seconds(created_utc) AS ts,
         CAST(TIMESTAMP '1970-01-01 00:00:00' + to_seconds(created_utc) AS DATE) AS date
  FROM posts
)"""

COMMENTS_CTE = """comments AS (
  SELECT CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR) AS name,
         CASE WHEN turn > 0 THEN CAST(conv_id AS VARCHAR) || '_' || CAST(turn - 1 AS VARCHAR) END AS parent_id,
         CAST(turn AS INTEGER) AS depth,
         'a' || CAST((conv_id * 7 + turn * 3) % 97 AS VARCHAR) AS author,
         CAST((conv_id * 13 + turn * 29) % 41 - 10 AS BIGINT) AS score,
         text AS selftext
  FROM conversations
)"""


def token_ctes(src: str = "tposts", text_col: str = "title", keep: str = "id, date, ups",
               prefix: str = "", stop: bool = True) -> str:
    """CTEs ``{prefix}sent``, ``{prefix}occ``: one row per kept word occurrence
    with its sentence number and position (T01 in SQL)."""
    stop_pred = f" AND NOT list_contains({STOPS_SQL}, word)" if stop else ""
    return f"""{prefix}sent AS (
  SELECT {keep}, unnest(string_split_regex({text_col}, '{SENT_RE}')) AS s,
         generate_subscripts(string_split_regex({text_col}, '{SENT_RE}'), 1) AS sent_no
  FROM {src}
),
{prefix}raw AS (
  SELECT {keep}, sent_no, unnest(string_split(s, ' ')) AS w,
         generate_subscripts(string_split(s, ' '), 1) AS w_no
  FROM {prefix}sent
),
{prefix}occ AS (
  SELECT * EXCLUDE (w), regexp_replace(lower(w), '{NON_ALPHA_RE}', '', 'g') AS word FROM {prefix}raw
),
{prefix}words AS (
  SELECT * FROM {prefix}occ WHERE word <> ''{stop_pred}
)"""
