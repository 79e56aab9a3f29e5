"""Catalog: author statistics, shrinkage and author features (slice 5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import authors as au
from ..operators.orderstat import describe
from ..session import cut_lineage
from ..sources.fixtures import posts_view
from .common import POSTS_CTE, Query, finalize, wrap_sql

OHW_START, OHW_STOP, OHW_NUM = 10.0, 600.0, 100
OHW_THRESHOLD = 100


def _posts(spark, sf):
    """Posts with a known author."""
    return posts_view(spark, sf).filter(~F.col("author").isin(au.EXCLUDED_AUTHORS))


def q_author_table(spark, sf):
    return finalize(au.author_table(_posts(spark, sf)))


def q_popular_authors(spark, sf):
    return finalize(au.popular_authors(_posts(spark, sf), 60.0))


def q_author_describe(spark, sf):
    return finalize(au.describe(au.author_table(_posts(spark, sf)), "ups_sum"))


def q_community_describe(spark, sf):
    """A11 per community: exact count, mean, std, min, quartiles and max of the votes."""
    return finalize(describe(posts_view(spark, sf), "ups", ["subreddit"]))


def q_author_shrinkage(spark, sf):
    t, default = au.beta_shrinkage(au.with_votes(_posts(spark, sf)))
    return finalize(t.select("author", "ups", "downs", "beta_mean", default.alias("prior_mean")))


def q_author_shrinkage_moments(spark, sf):
    t, default = au.beta_shrinkage(au.with_votes(_posts(spark, sf)), prior="moments")
    return finalize(t.select("author", "beta_mean", default.alias("prior_mean")))


def q_author_power_law(spark, sf):
    return finalize(au.power_law_popularity(_posts(spark, sf), min_posts=10))


def q_ohw_ratio(spark, sf):
    return finalize(au.one_hit_wonder_ratio(_posts(spark, sf), OHW_THRESHOLD))


def q_ohw_curve(spark, sf):
    return finalize(au.one_hit_wonder_curve(_posts(spark, sf), OHW_START, OHW_STOP, OHW_NUM))


def q_distinct_authors(spark, sf):
    p = _posts(spark, sf)
    return finalize(p.agg(F.count_distinct("author").alias("n_authors")))


def q_author_post_features(spark, sf):
    """Each post with its author's total upvotes and post count."""
    p = _posts(spark, sf)
    t = p.groupBy("author").agg(F.sum("ups").alias("author_total_upvotes"),
                                F.count(F.lit(1)).alias("author_proliferacy"))
    # stored, so that AQE can split a hot author's posts in the join
    return finalize(p.join(cut_lineage(t), "author").select("id", "author", "author_total_upvotes", "author_proliferacy"))


def q_author_influence(spark, sf):
    """Fit on posts of even-numbered ids, transform all posts; unseen
    authors get the global mean."""
    p = posts_view(spark, sf)
    train = p.filter(F.substring("id", 2, 20).cast("bigint") % 2 == 0)
    model = au.AuthorInfluence("mean").fit(train)
    return finalize(model.transform(p).select("id", "author", "auth_aggmean"))


# ---------------------------------------------------------------- SQL twins
P = f"WITH {POSTS_CTE}, kp AS (SELECT * FROM posts WHERE author NOT IN ('None', 'AutoModerator'))"
VOTES = """, v AS (SELECT *, CASE WHEN 2.0 * upvote_ratio - 1 <> 0 AND ups <> 0
                      THEN ups * upvote_ratio / (2.0 * upvote_ratio - 1) END AS r_ups FROM kp),
vv AS (SELECT *, r_ups - ups AS r_downs FROM v)"""

SQL_AUTHOR_TABLE = wrap_sql(f"""{P}
SELECT author, CAST(sum(ups) AS BIGINT) AS ups_sum, count(ups) AS n_posts, avg(ups) AS ups_mean,
       median(ups) AS ups_median, CAST(max(ups) AS BIGINT) AS ups_max, stddev_samp(ups) AS ups_std
FROM kp GROUP BY author""", doubles=("ups_mean", "ups_median", "ups_std"))
SQL_POPULAR_AUTHORS = wrap_sql(f"""{P}
SELECT author, count(ups) AS n_posts, CAST(sum(ups) AS BIGINT) AS ups_sum, avg(ups) AS ups_mean
FROM kp GROUP BY author HAVING avg(ups) > 60.0""", doubles=("ups_mean",))
SQL_AUTHOR_DESCRIBE = wrap_sql(f"""{P}, t AS (SELECT author, sum(ups) AS s FROM kp GROUP BY author)
SELECT count(s) AS count, avg(s) AS mean, stddev_samp(s) AS std, CAST(min(s) AS DOUBLE) AS min,
       quantile_cont(s, 0.25) AS p25, quantile_cont(s, 0.5) AS p50, quantile_cont(s, 0.75) AS p75,
       CAST(max(s) AS DOUBLE) AS max FROM t""", doubles=("mean", "std", "min", "p25", "p50", "p75", "max"))
SQL_COMMUNITY_DESCRIBE = wrap_sql(f"""WITH {POSTS_CTE}
SELECT subreddit, count(ups) AS count, avg(ups) AS mean, stddev_samp(ups) AS std, CAST(min(ups) AS DOUBLE) AS min,
       quantile_cont(ups, 0.25) AS p25, quantile_cont(ups, 0.5) AS p50, quantile_cont(ups, 0.75) AS p75,
       CAST(max(ups) AS DOUBLE) AS max FROM posts GROUP BY subreddit""", doubles=("mean", "std", "min", "p25", "p50", "p75", "max"))
SQL_AUTHOR_SHRINK = wrap_sql(f"""{P}{VOTES},
pr AS (SELECT sum(r_ups) AS a, sum(r_downs) AS b FROM vv),
ag AS (SELECT author, sum(r_ups) AS ups, sum(r_downs) AS downs FROM vv GROUP BY author)
SELECT author, ups, downs, (a + ups) / (a + b + ups + downs) AS beta_mean, a / (a + b) AS prior_mean
FROM ag, pr WHERE ups IS NOT NULL AND downs IS NOT NULL""",
                             doubles=("ups", "downs", "beta_mean", "prior_mean"))
SQL_AUTHOR_SHRINK_MOM = wrap_sql(f"""{P}{VOTES},
ag AS (SELECT author, sum(r_ups) AS ups, sum(r_downs) AS downs FROM vv GROUP BY author),
ag2 AS (SELECT * FROM ag WHERE ups IS NOT NULL AND downs IS NOT NULL),
mm AS (SELECT avg(ups / (ups + downs)) AS m, var_pop(ups / (ups + downs)) AS v FROM ag2 WHERE ups + downs > 0),
pr AS (SELECT ((1 - m) / v - 1 / m) * m * m AS a, ((1 - m) / v - 1 / m) * m * m * (1 / m - 1) AS b FROM mm)
SELECT author, (a + ups) / (a + b + ups + downs) AS beta_mean, a / (a + b) AS prior_mean FROM ag2, pr""",
                                 doubles=("beta_mean", "prior_mean"))
SQL_POWER_LAW = wrap_sql(f"""{P},
pos AS (SELECT author, CAST(ups AS DOUBLE) AS x FROM kp WHERE ups > 0),
mx AS (SELECT author, max(x) AS xmax, count(*) AS n FROM pos GROUP BY author HAVING count(*) >= 10),
s AS (SELECT p.author, any_value(m.xmax) AS xmax, any_value(m.n) AS n, sum(ln(m.xmax / p.x)) AS slog
      FROM pos p JOIN mx m ON m.author = p.author GROUP BY p.author)
SELECT author, n, CASE WHEN slog > 0 THEN n / slog END AS alpha,
       xmax * (CASE WHEN slog > 0 THEN n / slog END) / ((CASE WHEN slog > 0 THEN n / slog END) + 1) AS pl_mean
FROM s""", doubles=("alpha", "pl_mean"))
SQL_OHW = wrap_sql(f"""{P}, pop AS (SELECT author, count(*) AS c FROM kp WHERE ups > {OHW_THRESHOLD} GROUP BY author)
SELECT CASE WHEN sum(c) > 0 THEN sum(CASE WHEN c = 1 THEN 1 ELSE 0 END) * 1.0 / sum(c) END AS ohw_ratio FROM pop""",
                   doubles=("ohw_ratio",))
_STEP = (OHW_STOP - OHW_START) / (OHW_NUM - 1)
SQL_OHW_CURVE = wrap_sql(f"""{P},
th AS (SELECT CAST(i AS BIGINT) AS step, {OHW_START!r} + i * {_STEP!r} AS threshold FROM range({OHW_NUM}) t(i)),
pc AS (SELECT t.step, t.threshold, p.author, count(*) AS c FROM th t JOIN kp p ON p.ups > t.threshold
       GROUP BY t.step, t.threshold, p.author),
cv AS (SELECT step, threshold, CAST(sum(c) AS BIGINT) AS popular_posts,
              CAST(sum(CASE WHEN c = 1 THEN 1 ELSE 0 END) AS BIGINT) AS ohw_authors FROM pc GROUP BY step, threshold),
full_cv AS (SELECT t.step, t.threshold, coalesce(cv.popular_posts, 0) AS popular_posts,
                   coalesce(cv.ohw_authors, 0) AS ohw_authors FROM th t LEFT JOIN cv ON cv.step = t.step),
fe AS (SELECT min(step) AS first_empty FROM full_cv WHERE popular_posts = 0)
SELECT step, threshold, popular_posts, ohw_authors, ohw_authors * 1.0 / popular_posts AS ohw_ratio
FROM full_cv, fe WHERE fe.first_empty IS NULL OR step < fe.first_empty""", doubles=("threshold", "ohw_ratio"))
SQL_DISTINCT_AUTHORS = f"{P} SELECT count(DISTINCT author) AS n_authors FROM kp"
SQL_AUTHOR_POST_FEATURES = f"""{P}, t AS (SELECT author, CAST(sum(ups) AS BIGINT) AS author_total_upvotes,
  count(*) AS author_proliferacy FROM kp GROUP BY author)
SELECT id, author, author_total_upvotes, author_proliferacy FROM kp JOIN t USING (author)"""
SQL_AUTHOR_INFLUENCE = wrap_sql(f"""WITH {POSTS_CTE},
tr AS (SELECT * FROM posts WHERE CAST(substr(id, 2, 20) AS BIGINT) % 2 = 0),
t AS (SELECT author, avg(ups) AS m FROM tr GROUP BY author),
g AS (SELECT avg(ups) AS gm FROM tr)
SELECT p.id, p.author, coalesce(t.m, g.gm) AS auth_aggmean FROM posts p LEFT JOIN t ON t.author = p.author, g""",
                                doubles=("auth_aggmean",))

QUERIES = [
    Query("author_table", q_author_table, SQL_AUTHOR_TABLE, ("A09", "P11")),
    Query("popular_authors", q_popular_authors, SQL_POPULAR_AUTHORS, ("A10",)),
    Query("author_describe", q_author_describe, SQL_AUTHOR_DESCRIBE, ("A11",)),
    Query("community_describe", q_community_describe, SQL_COMMUNITY_DESCRIBE, ("A11", "A28")),
    Query("author_shrinkage", q_author_shrinkage, SQL_AUTHOR_SHRINK, ("A12", "M01")),
    Query("author_shrinkage_moments", q_author_shrinkage_moments, SQL_AUTHOR_SHRINK_MOM, ("A13", "M05")),
    Query("author_power_law", q_author_power_law, SQL_POWER_LAW, ("A14",)),
    Query("one_hit_wonder_ratio", q_ohw_ratio, SQL_OHW, ("A18",)),
    Query("one_hit_wonder_curve", q_ohw_curve, SQL_OHW_CURVE, ("A19",)),
    Query("distinct_authors", q_distinct_authors, SQL_DISTINCT_AUTHORS, ("A20",)),
    Query("author_post_features", q_author_post_features, SQL_AUTHOR_POST_FEATURES, ("J05", "J06")),
    Query("author_influence", q_author_influence, SQL_AUTHOR_INFLUENCE, ("E15", "J04")),
]
