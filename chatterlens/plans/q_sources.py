"""Catalog: sources and sinks (S01-S13) as write-then-read round trips of data
derived from the given tables, staged under the shared checkpoint folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import terms
from ..operators import vectors as V
from ..session import scratch_path
from ..sources import readers as R
from ..sources.fixtures import posts_view, table
from .common import POSTS_CTE, Query, finalize, token_ctes, wrap_sql

START, END = 1704067200 + 86400, 1704067200 + 20 * 86400 + 3600


def q_csv_roundtrip(spark, sf):
    path = scratch_path(spark, "posts-csv")
    R.write_posts_csv(posts_view(spark, sf), path)
    back = R.read_posts_csv(spark, path).select("id", "title", "ups", "upvote_ratio",
                                                F.length("selftext").alias("selftext_len"))
    return finalize(back)


def q_csv_whole(spark, sf):
    """Every row of the written and read CSV, with a hash of its body."""
    path = scratch_path(spark, "posts-csv")
    R.write_posts_csv(posts_view(spark, sf), path)
    return finalize(R.read_posts_csv(spark, path).select(
        "id", "title", "ups", "upvote_ratio", F.md5("selftext").alias("selftext_md5")))


def q_dir_with_source(spark, sf):
    path = scratch_path(spark, "posts-by-community")
    posts_view(spark, sf).write.mode("overwrite").partitionBy("subreddit").parquet(path)
    d = R.read_with_source(spark, path)
    sub = F.regexp_extract("source_file", r"subreddit=([^/]+)/", 1)
    return finalize(d.groupBy(sub.alias("subreddit")).agg(F.count(F.lit(1)).alias("n")))


def q_vector_text_roundtrip(spark, sf):
    tok = terms.with_tokens(posts_view(spark, sf), stop_words=[])
    path = scratch_path(spark, "vectors-txt")
    R.write_vector_text(V.rule_vectors(tok), path)
    back = R.read_vector_text(spark, path)
    return finalize(back.select("word", *[F.col("vector")[i].alias(f"v{i}") for i in range(V.VEC_DIM)]))


def q_printed_vectors(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    printed = F.concat(F.lit("[ "), F.array_join(F.transform("v", lambda x: x.cast("string")), "  "), F.lit("]"))
    back = e.select("vec_id", R.parse_printed_vector(printed).alias("v"))
    return finalize(back.select("vec_id", F.posexplode("v").alias("dim", "value")))


def q_day_windows(spark, sf):
    w = R.day_windows(posts_view(spark, sf), START, END, drop_last=True)
    return finalize(w.groupBy("window_start").agg(F.count(F.lit(1)).alias("n")))


def q_labelled_dir(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id") \
        .select("doc_id", F.col("quality").alias("label"), "text")
    path = scratch_path(spark, "labelled")
    R.write_labelled_dir(d, path)
    back = R.read_labelled_dir(spark, path)
    txt = F.when(F.col("text").endswith("\n"), F.expr("substring(text, 1, length(text) - 1)")).otherwise(F.col("text"))
    return finalize(back.select("doc_id", "label", F.length(txt).alias("n_chars")))


def q_compute_once(spark, sf):
    path = scratch_path(spark, "preprocessed")
    tok = R.compute_once(spark, path, lambda: terms.with_tokens(posts_view(spark, sf)).select("id", "date", "tokens"))
    again = R.compute_once(spark, path, lambda: 1 / 0)   # second call must not rebuild
    n_first = tok.agg(F.count(F.lit(1))).scalar()
    return finalize(again.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size(F.flatten("tokens"))).alias("words"),
                              n_first.alias("n_first")))


SQL = {
    "csv_roundtrip": f"""WITH {POSTS_CTE} SELECT id, title, ups, round(upvote_ratio, 6) + 0.0 AS upvote_ratio,
  CAST(length(selftext) AS BIGINT) AS selftext_len FROM posts""",
    "csv_whole": f"""WITH {POSTS_CTE} SELECT id, title, ups, round(upvote_ratio, 6) + 0.0 AS upvote_ratio,
  md5(selftext) AS selftext_md5 FROM posts""",
    "dir_with_source": f"WITH {POSTS_CTE} SELECT subreddit, count(*) AS n FROM posts GROUP BY subreddit",
    "vector_text_roundtrip": f"""WITH {POSTS_CTE}, {token_ctes(stop=False)},
vocab AS (SELECT DISTINCT word FROM words WHERE length(word) >= 3)
SELECT word, CAST(length(word) AS DOUBLE) AS v0, CAST(ascii(word) - 96 AS DOUBLE) AS v1,
       CAST((length(word) * 7) % 5 AS DOUBLE) AS v2, CAST(ascii(right(word, 1)) - 96 AS DOUBLE) AS v3 FROM vocab""",
    "printed_vectors": wrap_sql("""SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS dim,
  unnest(CAST(embedding AS DOUBLE[])) AS value FROM embeddings""", doubles=("value",)),
    "day_windows": f"""WITH {POSTS_CTE} SELECT CAST({START} + floor((created_utc - {START}) / 86400) * 86400 AS BIGINT)
  AS window_start, count(*) AS n FROM posts
WHERE created_utc >= {START} AND created_utc < {START + ((END - START) // 86400 - 1) * 86400} GROUP BY 1""",
    "labelled_dir": """SELECT d.doc_id, CAST(l.quality AS BIGINT) AS label, CAST(length(d.text) AS BIGINT) AS n_chars
FROM documents d JOIN labels l ON l.doc_id = d.doc_id""",
}

_ids = {"csv_roundtrip": ("S01", "S03"), "csv_whole": ("S01", "S03"), "dir_with_source": ("S04", "S05"),
        "vector_text_roundtrip": ("S07", "S10"), "printed_vectors": ("S08", "N06"),
        "day_windows": ("S12",), "labelled_dir": ("S13",), "compute_once": ("S06", "S09")}

QUERIES = [Query(n, globals()[f"q_{n}"], SQL.get(n), _ids[n]) for n in _ids]
