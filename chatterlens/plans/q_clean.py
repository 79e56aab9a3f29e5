"""Catalog: cleaning, text and time scalars, EDA aggregates, sort/limit, set
operations, JSON and simple regressions (slice 4)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import mathx as M
from ..functions import text as T
from ..functions import timeparts as D
from ..operators import clean as C
from ..operators import terms
from ..operators.orderstat import quantile
from ..operators.similarity import sorted_lag
from ..sources.fixtures import posts_view, table
from .common import POSTS_CTE, Query, STOPS_SQL, finalize, wrap_sql

AWARD_TYPES = ["click", "error", "purchase", "signup", "view"]  # fixed values: fixture award names
HIST_BINS = 20


def _p(spark, sf):
    return posts_view(spark, sf)


# ---------------------------------------------------------------- filters
def q_preprocess(spark, sf):
    p = C.preprocess(_p(spark, sf))
    return finalize(p.select("id", "created_datetime_utc", "weektime", "time_of_day", "day"))


def q_data_setup(spark, sf):
    p = C.data_setup(_p(spark, sf), exclude_removed=True, drop_na_cols=("title",))
    return finalize(p.select("id", "created_datetime_utc"))


def q_thread_filter_long(spark, sf):
    p = _p(spark, sf).filter(T.not_thread_title("title", T.THREAD_TITLE_LONG_RE))
    return finalize(p.select("id"))


def q_popularity_bounds(spark, sf):
    p = C.popularity_bounds(_p(spark, sf), 10, 10000, drop_ids=("p3", "p5"))
    return finalize(p.select("id", "ups", "num_comments"))


def q_live_removed(spark, sf):
    live, removed = C.split_live_removed(_p(spark, sf))
    out = live.select(F.lit("live").alias("part"), "ups").unionByName(
        removed.select(F.lit("removed").alias("part"), "ups"))
    return finalize(out.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.avg("ups").alias("mean_ups")))


def q_post_flags(spark, sf):
    p = _p(spark, sf)
    ts = D.utc_ts("created_utc")
    return finalize(p.select(
        "id",
        C.removed_body("selftext").alias("removed_body"),
        C.ignored_post().alias("ignored"),
        (F.col("ups") <= 100).alias("low_ups"),
        ((F.dayofyear(ts) == 1) & (F.year(ts) == 2024)).alias("new_year_day"),
        ((F.weekofyear(ts) == 1) & (F.year(ts) == 2024)).alias("first_week"),
        (F.col("ups") > 50).cast("int").alias("label_gt50"),
        M.bucket3("ups", 30, 100).alias("bucket3"),
    ))


def q_title_search(spark, sf):
    p = _p(spark, sf)
    hits = p.filter(F.col("title").contains("tion") | (F.col("id") == "p42"))
    return finalize(hits.select("id", "title"))


def q_comment_range(spark, sf):
    return finalize(C.comment_range_ids(_p(spark, sf), 6000).select("id", "num_comments"))


def q_token_predicates(spark, sf):
    tok = terms.with_tokens(_p(spark, sf))
    return finalize(tok.select("id", T.contains_token("tokens", "der").alias("has_der"),
                               T.contains_substring_token("tokens", "ion").alias("has_ion")))


def q_date_cut(spark, sf):
    tok = terms.with_tokens(_p(spark, sf))
    return finalize(tok.filter(F.col("date") <= F.lit("2024-01-10").cast("date")).select("id", "date"))


# ---------------------------------------------------------------- text
def q_text_cleaners(spark, sf):
    p = _p(spark, sf)
    return finalize(p.select(
        "id",
        T.regex_clean_keep_case("title").alias("clean_case"),
        T.regex_clean_lower("title").alias("clean_lower"),
        F.array_join(T.alpha_tokens("title"), " ").alias("alpha_tokens"),
        F.length(T.concat_text("title", "selftext")).cast("bigint").alias("text_len"),
        T.normalise_post_id("id").alias("fullname"),
        T.author_or_none(F.when(F.col("author") == "None", None).otherwise(F.col("author"))).alias("author2"),
    ))


def q_url_tokens(spark, sf):
    pg = table(spark, sf, "pages")
    txt = F.concat_ws(" ", F.lit("see"), F.col("url"), F.lit("or"),
                      F.regexp_extract("url", r"//([^/]+)", 1), F.lit("now"))
    return finalize(pg.select("page_id", T.replace_url_tokens(txt).alias("text")))


def q_html_text(spark, sf):
    pg = table(spark, sf, "pages")
    return finalize(pg.select("page_id", T.html_to_text("html").alias("text")))


def q_flat_tokens(spark, sf):
    """T02 (no stop words) with sentence/word positions."""
    tok = terms.with_tokens(_p(spark, sf), "title", "tokens", stop_words=[])
    s = tok.select("id", F.posexplode("tokens").alias("sent_no", "sent"))
    w = s.select("id", "sent_no", F.posexplode("sent").alias("w_no", "word"))
    return finalize(w)


# ---------------------------------------------------------------- time
def q_timeparts(spark, sf):
    p = _p(spark, sf)
    ts = D.utc_ts("created_utc")
    miny = p.agg(F.min(F.year(D.utc_ts("created_utc")))).scalar()
    return finalize(p.select(
        "id", ts.alias("ts"), D.utc_date("created_utc").alias("date"),
        D.to_epoch(ts).alias("epoch"), F.hour(ts).alias("hour"), F.minute(ts).alias("minute"),
        D.weekday_mon0(ts).alias("weekday"), D.day_of_year0(ts).alias("doy0"),
        D.hour_of_week(ts).alias("weektime"), D.two_hour_bucket(F.hour(ts)).alias("hour2"),
        F.dayofmonth(ts).alias("mday"), (F.year(ts) - miny).alias("year_offset"),
        F.to_timestamp(F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).alias("parsed"),
    ))


def q_local_parts(spark, sf):
    p = _p(spark, sf)
    lp = D.local_parts(D.utc_ts("created_utc"))
    return finalize(p.select("id", *[v.alias(k) for k, v in lp.items()]))


# ---------------------------------------------------------------- math
def q_math_fns(spark, sf):
    p = _p(spark, sf)
    ru, rd = M.reconstruct_votes("ups", "upvote_ratio")
    return finalize(p.select(
        "id", ru.alias("r_ups"), rd.alias("r_downs"),
        M.downvote_estimate("ups", "upvote_ratio").alias("downs_est"),
        F.when(F.col("ups") > 0, F.ln("ups")).alias("ln_ups"),
        M.sigmoid(F.col("upvote_ratio")).alias("sig"),
        M.odds(F.col("upvote_ratio") - 0.5).alias("odds"),
        M.beta_mean(F.col("ups") + 1, F.col("num_comments") + 1).alias("beta_mean"),
    ))


# ---------------------------------------------------------------- aggregates
def q_value_counts(spark, sf):
    p = _p(spark, sf)
    vc = p.groupBy("award_name").agg(F.count(F.lit(1)).alias("n"))
    return finalize(vc.withColumn("share", F.col("n") / vc.agg(F.sum("n")).scalar()))


def q_post_summary(spark, sf):
    p = _p(spark, sf)
    kept = C.preprocess(p)
    vc = p.groupBy("num_comments").agg(F.count(F.lit(1)).alias("n"))
    return finalize(p.agg(
        F.count(F.lit(1)).alias("n_posts"),
        F.avg((F.col("ups") == 1).cast("int")).alias("share_ups_one"),
        F.count_if(F.col("num_comments") >= 500).alias("n_ge_500"),
    ).select("*", (kept.agg(F.count(F.lit(1))).scalar() / F.col("n_posts")).alias("retention"),
             vc.filter(F.col("num_comments") >= 500).agg(F.sum("n")).scalar().alias("tail_count")))


def q_weekday_counts(spark, sf):
    p = _p(spark, sf)
    return finalize(p.groupBy(D.weekday_mon0(D.utc_ts("created_utc")).alias("weekday"))
                    .agg(F.count(F.lit(1)).alias("n")))


def q_weektime_stats(spark, sf):
    p = C.preprocess(_p(spark, sf)).filter(F.col("ups") >= 100)
    return finalize(p.groupBy("weektime").agg(F.sum("ups").alias("sum_ups"), F.avg("ups").alias("mean_ups"),
                                             F.median("ups").alias("median_ups")))


def q_histogram(spark, sf):
    p = _p(spark, sf).filter(F.col("ups") > 0)
    x = F.ln("ups")
    lo = p.agg(F.min(x)).scalar()
    hi = p.agg(F.max(x)).scalar()
    b = F.least(F.floor((x - lo) / (hi - lo) * HIST_BINS), F.lit(HIST_BINS - 1)).cast("int")
    return finalize(p.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n")))


def q_period_share(spark, sf):
    p = _p(spark, sf)
    tot = p.agg(F.sum("ups")).scalar()
    return finalize(p.select("id", (F.col("ups") / tot).alias("share_of_period")))


def q_award_totals(spark, sf):
    p = _p(spark, sf)
    return finalize(p.groupBy("award_name").agg(F.sum("award_count").alias("total")))


def q_award_pivot(spark, sf):
    p = _p(spark, sf)
    pv = p.groupBy("id").pivot("award_name", AWARD_TYPES).agg(F.sum("award_count")).fillna(0)
    pv = pv.withColumn("has_purchase", (F.col("purchase") > 0).cast("int"))
    return finalize(pv)


def q_award_struct_total(spark, sf):
    """Total of an awards array parsed from JSON text."""
    ev = table(spark, sf, "events")
    arr = F.from_json(F.concat(F.lit('[{"name": "'), F.col("event_type"), F.lit('", "count": '),
                               F.get_json_object("props", "$.k"), F.lit('}]')),
                      "array<struct<name:string,count:int>>")
    return finalize(ev.select("event_id", F.aggregate(arr, F.lit(0), lambda acc, a: acc + a["count"])
                              .alias("total_awards")))


def q_median_label(spark, sf):
    p = _p(spark, sf)
    med = quantile(p, "ups")
    lab = p.select((F.col("ups") > med).cast("int").alias("label"))
    return finalize(lab.agg(F.avg("label").alias("pos_rate"),
                            (F.lit(1.0) - F.avg("label")).alias("majority_baseline")))


def q_pair_stats(spark, sf):
    p = _p(spark, sf)
    return finalize(p.agg(F.corr("ups", "num_comments").alias("corr"),
                          F.covar_samp("ups", "num_comments").alias("cov"),
                          F.var_samp("ups").alias("var_ups"),
                          F.regr_slope("ups", "num_comments").alias("slope"),
                          F.regr_intercept("ups", "num_comments").alias("intercept"),
                          F.regr_r2("ups", "num_comments").alias("r2")))


def q_concept_ttest(spark, sf):
    """Mean ups of posts whose title holds ``der`` vs all posts,
    equal-variance two-sample t statistic."""
    tok = terms.with_tokens(_p(spark, sf))
    flag = T.contains_token("tokens", "der")
    g = tok.agg(F.count(F.when(flag, 1)).alias("n1"), F.avg(F.when(flag, F.col("ups"))).alias("m1"),
                F.var_samp(F.when(flag, F.col("ups"))).alias("v1"),
                F.count("ups").alias("n2"), F.avg("ups").alias("m2"), F.var_samp("ups").alias("v2"))
    sp = ((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / (F.col("n1") + F.col("n2") - 2)
    t = (F.col("m1") - F.col("m2")) / F.sqrt(sp * (F.lit(1.0) / F.col("n1") + F.lit(1.0) / F.col("n2")))
    return finalize(g.select("n1", "m1", "m2", t.alias("t_stat")))


# ---------------------------------------------------------------- sort / limit
def q_top_authors(spark, sf):
    p = _p(spark, sf)
    t = p.groupBy("author").agg(F.sum("ups").alias("s"), F.avg("ups").alias("m"), F.count(F.lit(1)).alias("c"))
    top = t.orderBy(F.col("s").desc(), "author").limit(10).select("author", "s")
    return finalize(top)


def q_reranked_authors(spark, sf):
    p = _p(spark, sf)
    t = p.groupBy("author").agg(F.avg("ups").alias("m"), F.count(F.lit(1)).alias("c"))
    top = t.orderBy(F.col("m").desc(), "author").limit(20).orderBy(F.col("c").desc(), "author").limit(5)
    return finalize(top)


def q_top_posts(spark, sf):
    return finalize(_p(spark, sf).orderBy(F.col("ups").desc(), "id").limit(10).select("id", "ups"))


def q_controversial(spark, sf):
    p = _p(spark, sf)
    return finalize(p.orderBy(F.abs(F.col("upvote_ratio") - 0.5), "id").limit(25).select("id", "upvote_ratio"))


def q_busiest_day_posts(spark, sf):
    """The date whose post count is the maximum, its posts by ups."""
    tok = terms.with_tokens(_p(spark, sf))
    per = tok.groupBy("date").agg(F.count(F.lit(1)).alias("n"))
    best = per.orderBy(F.col("n").desc(), "date").limit(1)
    day = tok.join(best, "date", "left_semi")
    return finalize(day.select("date", "id", "ups"))


# ---------------------------------------------------------------- sets, joins
def q_union_sets(spark, sf):
    p = _p(spark, sf)
    a = p.filter(F.col("ups") > 100).select("id", "ups")
    b = p.filter(F.col("num_comments") > 11000).select("id", "num_comments")
    u = a.unionByName(b, allowMissingColumns=True)
    return finalize(u)


def q_id_differences(spark, sf):
    """Ids in one collection but not the other, both directions."""
    p = _p(spark, sf)
    a = p.filter(F.col("ups") > 20).select("id")
    b = p.filter(F.col("is_self")).select("id")
    left = a.join(b, "id", "left_anti").select("id", F.lit("a_not_b").alias("side"))
    right = b.subtract(a).select("id", F.lit("b_not_a").alias("side"))
    both = p.join(a, "id", "left_semi").join(b, "id", "left_semi").select("id", F.lit("both").alias("side"))
    return finalize(left.unionByName(right).unionByName(both))


def q_snapshot_history(spark, sf):
    """Ordered score series per key with deltas (events as snapshots)."""
    ev = table(spark, sf, "events").select("user_id", "event_id", "ts", "value")
    h = sorted_lag(ev, "user_id", ["ts", "event_id"], "value")
    return finalize(h.select("user_id", "event_id", F.col("position").alias("poll"),
                             (F.col("value") - F.col("prev_value")).alias("delta")))


# ---------------------------------------------------------------- SQL twins
W = f"WITH {POSTS_CTE}"
PRE = """pre AS (SELECT *, ts AS created_datetime_utc, (isodow(ts) - 1) * 24 + hour(ts) AS weektime,
             hour(ts) AS time_of_day, day(ts) AS day FROM tposts
      WHERE author <> 'None' AND removed_by_category IS NULL AND is_self
        AND NOT coalesce(regexp_matches(title, '__PAT__'), false)
        AND title IS NOT NULL AND selftext IS NOT NULL)""".replace("__PAT__", T.THREAD_TITLE_RE)

SQL = {}
SQL["preprocess"] = wrap_sql(f"""{W}, {PRE}
SELECT id, created_datetime_utc, CAST(weektime AS BIGINT) AS weektime, CAST(time_of_day AS BIGINT) AS time_of_day,
       CAST(day AS BIGINT) AS day FROM pre""", texts=("created_datetime_utc",))
SQL["data_setup"] = wrap_sql(f"""{W} SELECT id, ts AS created_datetime_utc FROM tposts
WHERE is_self AND removed_by_category IS NULL AND title IS NOT NULL""", texts=("created_datetime_utc",))
SQL["thread_filter_long"] = f"""{W} SELECT id FROM posts
WHERE NOT coalesce(regexp_matches(title, '{T.THREAD_TITLE_LONG_RE}'), false)"""
SQL["popularity_bounds"] = f"""{W} SELECT id, ups, num_comments FROM posts
WHERE ups >= 10 AND num_comments <= 10000 AND id NOT IN ('p3', 'p5')"""
SQL["live_removed"] = wrap_sql(f"""{W} SELECT CASE WHEN removed_by_category IS NULL THEN 'live' ELSE 'removed' END AS part,
count(*) AS n, avg(ups) AS mean_ups FROM posts GROUP BY 1""", doubles=("mean_ups",))
SQL["post_flags"] = f"""{W} SELECT id, selftext IN ('[deleted]' || chr(10), '[removed]' || chr(10)) AS removed_body,
  (ups = 1 AND upvote_ratio = 1.0) AS ignored, ups <= 100 AS low_ups,
  (dayofyear(ts) = 1 AND year(ts) = 2024) AS new_year_day, (weekofyear(ts) = 1 AND year(ts) = 2024) AS first_week,
  CAST(ups > 50 AS BIGINT) AS label_gt50,
  CAST(CASE WHEN ups < 30 THEN 0 WHEN ups < 100 THEN 1 ELSE 2 END AS BIGINT) AS bucket3
FROM tposts"""
SQL["title_search"] = f"{W} SELECT id, title FROM posts WHERE contains(title, 'tion') OR id = 'p42'"
SQL["comment_range"] = f"""{W} SELECT id, num_comments FROM posts
WHERE num_comments BETWEEN 6000 AND (SELECT max(num_comments) FROM posts)"""


def _tok_sql(extra_select: str, where: str = "") -> str:
    return f"""{W},
ws AS (SELECT id, date, ups, unnest(string_split_regex(title, '{T.SENT_RE}')) AS s FROM tposts),
ww AS (SELECT id, unnest(string_split(s, ' ')) AS w FROM ws),
wc AS (SELECT id, regexp_replace(lower(w), '{T.NON_ALPHA_RE}', '', 'g') AS word FROM ww),
wk AS (SELECT * FROM wc WHERE word <> '' AND NOT list_contains({STOPS_SQL}, word))
{extra_select}"""


SQL["token_predicates"] = _tok_sql("""SELECT p.id,
  coalesce((SELECT bool_or(word = 'der') FROM wk WHERE wk.id = p.id), false) AS has_der,
  coalesce((SELECT bool_or(contains(word, 'ion')) FROM wk WHERE wk.id = p.id), false) AS has_ion
FROM tposts p""")
SQL["date_cut"] = wrap_sql(f"{W} SELECT id, date FROM tposts WHERE date <= DATE '2024-01-10'", texts=("date",))
SQL["text_cleaners"] = f"""{W} SELECT id,
  regexp_replace(coalesce(title, 'nan'), '{T.NON_ALPHA_RE}', '', 'g') AS clean_case,
  regexp_replace(lower(title), '{T.NON_ALPHA_RE}', '', 'g') AS clean_lower,
  array_to_string(list_filter(string_split_regex(lower(trim(title)), '\\s+'),
     lambda t: regexp_full_match(t, '[a-zA-Z]+') AND NOT list_contains({STOPS_SQL}, t)), ' ') AS alpha_tokens,
  CAST(length(concat_ws(' ', title, selftext)) AS BIGINT) AS text_len,
  CASE WHEN starts_with(id, 't3_') THEN id ELSE 't3_' || id END AS fullname,
  coalesce(CASE WHEN author = 'None' THEN NULL ELSE author END, 'None') AS author2
FROM posts"""
SQL["url_tokens"] = f"""SELECT page_id, array_to_string(list_transform(
    string_split_regex(trim(concat_ws(' ', 'see', url, 'or', regexp_extract(url, '//([^/]+)', 1), 'now')), '\\s+'),
    lambda t: CASE WHEN regexp_full_match(t, '{T.URL_TOKEN_RE[1:-1]}') THEN 'URL' ELSE t END), ' ') AS text
FROM pages"""
_html = "html"
_html = f"regexp_replace({_html}, '(?is)<(script)\\b[^>]*>.*?</script\\s*>', ' ', 'g')"
_html = f"regexp_replace({_html}, '(?is)<(style)\\b[^>]*>.*?</style\\s*>', ' ', 'g')"
_html = f"regexp_replace({_html}, '(?s)<!--.*?-->', ' ', 'g')"
_html = f"regexp_replace({_html}, '(?s)<[^>]*>', ' ', 'g')"
for _e, _c in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"),
               ("&apos;", "''"), ("&amp;", "&")):
    _html = f"replace({_html}, '{_e}', '{_c}')"
SQL["html_text"] = f"SELECT page_id, trim(regexp_replace({_html}, '\\s+', ' ', 'g')) AS text FROM pages"
SQL["flat_tokens"] = f"""{W},
ws AS (SELECT id, unnest(string_split_regex(title, '{T.SENT_RE}')) AS s,
              generate_subscripts(string_split_regex(title, '{T.SENT_RE}'), 1) - 1 AS sent_no FROM tposts),
ww AS (SELECT id, sent_no, unnest(string_split(s, ' ')) AS w FROM ws),
wc AS (SELECT id, sent_no, regexp_replace(lower(w), '{T.NON_ALPHA_RE}', '', 'g') AS word FROM ww),
ord AS (SELECT id, sent_no, word, row_number() OVER () AS rn FROM wc)
SELECT id, CAST(sent_no AS BIGINT) AS sent_no,
       CAST(row_number() OVER (PARTITION BY id, sent_no ORDER BY rn) - 1 AS BIGINT) AS w_no, word
FROM ord WHERE word <> ''"""
SQL["timeparts"] = wrap_sql(f"""{W} SELECT id, ts, date, CAST(epoch(ts) AS BIGINT) AS epoch,
  CAST(hour(ts) AS BIGINT) AS hour, CAST(minute(ts) AS BIGINT) AS minute,
  CAST(isodow(ts) - 1 AS BIGINT) AS weekday, CAST(dayofyear(ts) - 1 AS BIGINT) AS doy0,
  CAST((isodow(ts) - 1) * 24 + hour(ts) AS BIGINT) AS weektime, CAST(2 * floor(hour(ts) / 2) AS BIGINT) AS hour2,
  CAST(day(ts) AS BIGINT) AS mday, CAST(year(ts) - (SELECT min(year(ts)) FROM tposts) AS BIGINT) AS year_offset,
  strptime(strftime(ts, '%Y-%m-%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S') AS parsed
FROM tposts""", texts=("ts", "date", "parsed"))
SQL["local_parts"] = f"""{W}, lt AS (SELECT id, timezone('America/New_York', timezone('UTC', ts)) AS l FROM tposts)
SELECT id, CAST(hour(l) AS BIGINT) AS hour, CAST(minute(l) AS BIGINT) AS minute, CAST(dayofweek(l) AS BIGINT) AS dow_sun0,
       CAST(dayofyear(l) AS BIGINT) AS doy, CAST(year(l) AS BIGINT) AS year FROM lt"""
SQL["math_fns"] = wrap_sql(f"""{W}, v AS (SELECT id, ups, upvote_ratio, num_comments,
  CASE WHEN 2.0 * upvote_ratio - 1 <> 0 AND ups <> 0 THEN ups * upvote_ratio / (2.0 * upvote_ratio - 1) END AS r_ups FROM posts)
SELECT id, r_ups, r_ups - ups AS r_downs,
  CASE WHEN upvote_ratio <> 0 THEN (1.0 - upvote_ratio) * ups / upvote_ratio END AS downs_est,
  CASE WHEN ups > 0 THEN ln(ups) END AS ln_ups, 1.0 / (1.0 + exp(-upvote_ratio)) AS sig,
  CASE WHEN upvote_ratio - 0.5 = 0 THEN -999999999.0 ELSE (upvote_ratio - 0.5) / (1.0 - (upvote_ratio - 0.5)) END AS odds,
  (ups + 1) * 1.0 / ((ups + 1) + (num_comments + 1)) AS beta_mean
FROM v""", doubles=("r_ups", "r_downs", "downs_est", "ln_ups", "sig", "odds", "beta_mean"))
SQL["value_counts"] = wrap_sql(f"""{W} SELECT award_name, count(*) AS n, count(*) * 1.0 / (SELECT count(*) FROM posts) AS share
FROM posts GROUP BY award_name""", doubles=("share",))
SQL["post_summary"] = wrap_sql(f"""{W}, {PRE}
SELECT count(*) AS n_posts, avg(CAST(ups = 1 AS INTEGER)) AS share_ups_one,
  count(*) FILTER (WHERE num_comments >= 500) AS n_ge_500,
  (SELECT count(*) FROM pre) * 1.0 / count(*) AS retention,
  CAST(count(*) FILTER (WHERE num_comments >= 500) AS BIGINT) AS tail_count
FROM tposts""", doubles=("share_ups_one", "retention"))
SQL["weekday_counts"] = f"{W} SELECT CAST(isodow(ts) - 1 AS BIGINT) AS weekday, count(*) AS n FROM tposts GROUP BY 1"
SQL["weektime_stats"] = wrap_sql(f"""{W}, {PRE}
SELECT CAST(weektime AS BIGINT) AS weektime, CAST(sum(ups) AS BIGINT) AS sum_ups, avg(ups) AS mean_ups,
       median(ups) AS median_ups FROM pre WHERE ups >= 100 GROUP BY weektime""", doubles=("mean_ups", "median_ups"))
SQL["histogram"] = f"""{W}, p AS (SELECT ln(ups) AS x FROM posts WHERE ups > 0),
mm AS (SELECT min(x) AS lo, max(x) AS hi FROM p)
SELECT CAST(least(floor((x - lo) / (hi - lo) * {HIST_BINS}), {HIST_BINS - 1}) AS BIGINT) AS bin, count(*) AS n
FROM p, mm GROUP BY 1"""
SQL["period_share"] = wrap_sql(f"""{W} SELECT id, ups * 1.0 / (SELECT sum(ups) FROM posts) AS share_of_period
FROM posts""", doubles=("share_of_period",))
SQL["award_totals"] = f"{W} SELECT award_name, CAST(sum(award_count) AS BIGINT) AS total FROM posts GROUP BY 1"
SQL["award_pivot"] = f"""{W}, pv AS (SELECT id, {', '.join(
    f"CAST(coalesce(sum(award_count) FILTER (WHERE award_name = '{a}'), 0) AS BIGINT) AS {a}" for a in AWARD_TYPES)}
FROM posts GROUP BY id)
SELECT *, CAST(purchase > 0 AS BIGINT) AS has_purchase FROM pv"""
SQL["award_struct_total"] = """SELECT event_id, CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) AS BIGINT) AS total_awards
FROM events"""
SQL["median_label"] = wrap_sql(f"""{W}, m AS (SELECT median(ups) AS med FROM posts),
l AS (SELECT CAST(ups > med AS INTEGER) AS label FROM posts, m)
SELECT avg(label) AS pos_rate, 1.0 - avg(label) AS majority_baseline FROM l""",
                               doubles=("pos_rate", "majority_baseline"))
SQL["pair_stats"] = wrap_sql(f"""{W} SELECT corr(ups, num_comments) AS corr, covar_samp(ups, num_comments) AS cov,
  var_samp(ups) AS var_ups, regr_slope(ups, num_comments) AS slope, regr_intercept(ups, num_comments) AS intercept,
  regr_r2(ups, num_comments) AS r2 FROM posts""", doubles=("corr", "cov", "var_ups", "slope", "intercept", "r2"))
SQL["concept_ttest"] = wrap_sql(_tok_sql("""
, f AS (SELECT p.ups, p.id IN (SELECT id FROM wk WHERE word = 'der') AS flag FROM tposts p),
g AS (SELECT count(*) FILTER (WHERE flag) AS n1, avg(ups) FILTER (WHERE flag) AS m1,
             var_samp(ups) FILTER (WHERE flag) AS v1, count(ups) AS n2, avg(ups) AS m2, var_samp(ups) AS v2 FROM f)
SELECT n1, m1, m2, (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2)) AS t_stat
FROM g"""),
                                doubles=("m1", "m2", "t_stat"))
SQL["top_authors"] = f"""{W} SELECT author, CAST(sum(ups) AS BIGINT) AS s FROM posts GROUP BY author
ORDER BY s DESC, author LIMIT 10"""
SQL["reranked_authors"] = wrap_sql(f"""{W}, t AS (SELECT author, avg(ups) AS m, count(*) AS c FROM posts GROUP BY author),
t20 AS (SELECT * FROM t ORDER BY m DESC, author LIMIT 20)
SELECT author, m, c FROM t20 ORDER BY c DESC, author LIMIT 5""", doubles=("m",))
SQL["top_posts"] = f"{W} SELECT id, ups FROM posts ORDER BY ups DESC, id LIMIT 10"
SQL["controversial"] = wrap_sql(f"""{W} SELECT id, upvote_ratio FROM posts ORDER BY abs(upvote_ratio - 0.5), id
LIMIT 25""", doubles=("upvote_ratio",))
SQL["busiest_day_posts"] = wrap_sql(f"""{W}, per AS (SELECT date, count(*) AS n FROM tposts GROUP BY date),
best AS (SELECT date FROM per ORDER BY n DESC, date LIMIT 1)
SELECT date, id, ups FROM tposts WHERE date IN (SELECT date FROM best)""", texts=("date",))
SQL["union_sets"] = f"""{W} SELECT id, ups, NULL::BIGINT AS num_comments FROM posts WHERE ups > 100
UNION ALL SELECT id, NULL::BIGINT AS ups, num_comments FROM posts WHERE num_comments > 11000"""
SQL["id_differences"] = f"""{W}, a AS (SELECT id FROM posts WHERE ups > 20), b AS (SELECT id FROM posts WHERE is_self)
SELECT id, 'a_not_b' AS side FROM a WHERE id NOT IN (SELECT id FROM b)
UNION ALL SELECT id, 'b_not_a' FROM (SELECT DISTINCT id FROM b EXCEPT SELECT id FROM a)
UNION ALL SELECT id, 'both' FROM posts WHERE id IN (SELECT id FROM a) AND id IN (SELECT id FROM b)"""
SQL["snapshot_history"] = wrap_sql("""SELECT user_id, event_id,
  CAST(row_number() OVER w AS BIGINT) AS poll, value - lag(value) OVER w AS delta
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""", doubles=("delta",))


_ids = {
    "preprocess": ("P02", "P03", "D01", "D08", "D10"), "data_setup": ("P01",),
    "thread_filter_long": ("P04",), "popularity_bounds": ("P05", "P06"), "live_removed": ("P07", "A15"),
    "post_flags": ("P08", "P09", "P10", "M08", "M09"), "title_search": ("P12", "P13"),
    "comment_range": ("P14", "G06"), "token_predicates": ("P15", "P16"), "date_cut": ("P18", "D02"),
    "text_cleaners": ("T03", "T04", "T05", "T09", "T10", "T11", "P17"), "url_tokens": ("T06",),
    "html_text": ("T08",), "flat_tokens": ("T02", "N02"),
    "timeparts": ("D01", "D02", "D03", "D04", "D05", "D06", "D07", "D08", "D09", "D10", "D12"),
    "local_parts": ("D11",), "math_fns": ("M01", "M02", "M03", "M04", "M06"), "value_counts": ("A15",),
    "post_summary": ("A16", "A17", "A36"), "weekday_counts": ("A21",), "weektime_stats": ("A22",),
    "histogram": ("A23",), "period_share": ("A24",), "award_totals": ("A25",), "award_pivot": ("A26", "E19"),
    "award_struct_total": ("A27", "N01"), "median_label": ("A28", "R03", "R15"),
    "pair_stats": ("A29", "A30", "R11"), "concept_ttest": ("A32", "A33"), "top_authors": ("L05",),
    "reranked_authors": ("L06",), "top_posts": ("L07",), "controversial": ("L11",),
    "busiest_day_posts": ("L14",), "union_sets": ("U01",), "id_differences": ("U02", "J08"),
    "snapshot_history": ("W06", "N04"),
}

QUERIES = [Query(n, globals()[f"q_{n}"], SQL.get(n), _ids[n]) for n in _ids]
