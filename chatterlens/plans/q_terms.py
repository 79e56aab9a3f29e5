"""Catalog: term statistics, share series and change points (slices 1-3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import changepoint as cpo
from ..operators import terms
from ..sources.fixtures import posts_view, table
from .common import POSTS_CTE, Query, finalize, token_ctes, wrap_sql

K_DAILY = 2        # daily top words (package default)
CP_NODES = cpo.DEFAULT_NODES  # quadrature nodes a dimension
K_NEW = 200        # hot / known list sizes of the new-term detector (upstream value)
CP_EPS = 1e-6


def _tok(spark, sf, column="title"):
    return terms.with_tokens(posts_view(spark, sf), column)


# ---------------------------------------------------------------- Spark side
def q_top_words_per_day(spark, sf):
    top = terms.top_words_per_day(_tok(spark, sf), K_DAILY)
    return finalize(top.select("date", "word", "cf", "rank"))


def q_popular_words(spark, sf):
    return finalize(terms.popular_words(_tok(spark, sf), K_DAILY))


def q_corpus_top_words(spark, sf):
    return finalize(terms.top_corpus_words(_tok(spark, sf), 40))


def _series(spark, sf, statistic="count"):
    return terms.keyword_share_series(_tok(spark, sf), K_DAILY, statistic)


def q_share_series(spark, sf):
    return finalize(_series(spark, sf))


def q_share_series_sum(spark, sf):
    return finalize(_series(spark, sf, "sum"))


def q_share_notebook(spark, sf):
    tok = _tok(spark, sf)
    return finalize(terms.keyword_share_notebook(tok, terms.popular_words(tok, K_DAILY)))


def q_share_normalised(spark, sf):
    s = _series(spark, sf)
    return finalize(terms.normalised_total(s, "share", 2.0).select("word", "date", "normalised"))


def q_rolling_share(spark, sf):
    s = terms.rolling_mean(_series(spark, sf), "share", 7)
    return finalize(s.select("word", "date", "rolling_mean"))


def q_new_terms(spark, sf):
    return finalize(terms.new_terms(_tok(spark, sf), k_hot=K_NEW, k_known=K_NEW, lookback=9, skip_first=11))


def q_new_persistent_terms(spark, sf):
    return finalize(terms.new_terms(_tok(spark, sf), k_hot=K_NEW, k_known=K_NEW, lookback=9, skip_first=11,
                                    persist_ahead=2))


def q_two_level(spark, sf):
    s = terms.two_level_activity(_series(spark, sf), "share", rolling=7)
    return finalize(s.select("word", "date", "level", "level_rolling"))


def q_daily_entropy(spark, sf):
    return finalize(terms.daily_entropy(_tok(spark, sf)))


def q_change_points(spark, sf):
    cp = cpo.change_points(_series(spark, sf), nodes=CP_NODES, eps=CP_EPS)
    return finalize(cp)


def q_community_change_points(spark, sf):
    """C01 as the reference runs it: every community on its own dates and words."""
    s = terms.community_share_series(_tok(spark, sf), K_DAILY)
    return finalize(cpo.community_change_points(s, nodes=CP_NODES, eps=CP_EPS))


def q_event_community_change_points(spark, sf):
    """The same on all ``events``: an event type's share of a user group's days."""
    ev = table(spark, sf, "events").select(
        F.concat(F.lit("g"), F.pmod("user_id", F.lit(3)).cast("string")).alias("subreddit"),
        F.to_date(F.col("ts").cast("timestamp")).alias("date"), F.floor("value").cast("bigint").alias("ups"),
        F.array(F.array(F.col("event_type"))).alias("tokens"))
    s = terms.community_share_series(ev, 100)
    return finalize(cpo.community_change_points(s, nodes=CP_NODES, eps=CP_EPS))


def q_change_points_always(spark, sf):
    cp = cpo.change_points(_series(spark, sf), nodes=CP_NODES, eps=CP_EPS, model="always")
    return finalize(cp)


def q_change_point_report(spark, sf):
    cp = cpo.change_points(_series(spark, sf), nodes=CP_NODES, eps=CP_EPS)
    rep = cpo.report(cp, 0.5, 0.01)
    return finalize(rep.select("word", "confidence", "mu_diff",
                               cpo.truncate2("mu_diff").alias("mu_diff_2dp"), "entropy"))


def _event_series(spark, sf):
    """Dense-axis series: share of each event type among the day's events."""
    ev = table(spark, sf, "events").select(
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"),
        F.to_date(F.col("ts").cast("timestamp")).alias("date"),
        F.floor("value").cast("bigint").alias("ups"),
        F.array(F.array(F.col("event_type"))).alias("tokens"))
    words = ev.select(F.col("tokens")[0][0].alias("word")).distinct()
    return terms.keyword_share_series(ev, words, "count")


def q_top_words_per_day_body(spark, sf):
    """The daily top words of whole bodies, not of titles."""
    return finalize(terms.top_words_per_day(_tok(spark, sf, "selftext"), K_DAILY).select("date", "word", "cf", "rank"))


def q_share_series_body(spark, sf):
    return finalize(terms.keyword_share_series(_tok(spark, sf, "selftext"), K_DAILY, "count"))


def q_new_terms_body(spark, sf):
    return finalize(terms.new_terms(_tok(spark, sf, "selftext"), k_hot=K_NEW, k_known=K_NEW, lookback=9, skip_first=11))


def q_change_points_body(spark, sf):
    """Change points of the shares of posts whose whole body holds a word."""
    s = terms.keyword_share_series(_tok(spark, sf, "selftext"), K_DAILY, "count")
    return finalize(cpo.change_points(s, nodes=CP_NODES, eps=CP_EPS))


def q_event_change_points(spark, sf):
    return finalize(cpo.change_points(_event_series(spark, sf), nodes=CP_NODES, eps=CP_EPS))


# ---------------------------------------------------------------- SQL twins
def _top_ctes(k=K_DAILY, column="title"):
    return f"""{POSTS_CTE},
{token_ctes(text_col=column)},
counts AS (SELECT date, word, count(*) AS cf FROM words GROUP BY date, word),
ranked AS (SELECT date, word, cf, row_number() OVER (PARTITION BY date ORDER BY cf DESC, word ASC) AS rank
           FROM counts),
top AS (SELECT * FROM ranked WHERE rank <= {k}),
hot AS (SELECT word, CAST(sum(cf) AS BIGINT) AS cf_top_days FROM top GROUP BY word)"""


def _series_ctes(statistic="count", k=K_DAILY, column="title"):
    stat = {"count": "CAST(count(ups) AS DOUBLE)", "sum": "CAST(sum(ups) AS DOUBLE)"}[statistic]
    return f"""{_top_ctes(k, column)},
pw AS (SELECT DISTINCT id, date, ups, word FROM words),
kw AS (SELECT word, date, {stat} AS kw_stat FROM pw WHERE word IN (SELECT word FROM hot)
       GROUP BY word, date),
tot AS (SELECT date, {stat} AS total FROM tposts GROUP BY date),
grid AS (SELECT h.word, t.date, t.total FROM hot h CROSS JOIN tot t),
s0 AS (SELECT g.word, g.date, coalesce(kw.kw_stat, 1.0) / g.total AS share
       FROM grid g LEFT JOIN kw ON kw.word = g.word AND kw.date = g.date),
s1 AS (SELECT * FROM s0 WHERE share IS NOT NULL AND share <> 0),
series AS (SELECT word, date, CAST(row_number() OVER (PARTITION BY word ORDER BY date) - 1 AS BIGINT) AS idx,
                  CAST(count(*) OVER (PARTITION BY word) AS BIGINT) AS n, share FROM s1)"""


def _digamma_sql(x: str) -> str:
    tail = " - ".join(f"1 / ({x} + {i})" for i in range(8))
    return f"(ln({x} + 8) - 0.5 / ({x} + 8) - 1 / (12 * ({x} + 8)^2) + 1 / (120 * ({x} + 8)^4) - 1 / (252 * ({x} + 8)^6) + 1 / (240 * ({x} + 8)^8) - {tail})"


def _trigamma_sql(x: str) -> str:
    tail = " + ".join(f"1 / ({x} + {i})^2" for i in range(8))
    return (f"(1 / ({x} + 8) + 1 / (2 * ({x} + 8)^2) + 1 / (6 * ({x} + 8)^3) - 1 / (30 * ({x} + 8)^5) + 1 / (42 * ({x} + 8)^7)"
            f" - 1 / (30 * ({x} + 8)^9) + {tail})")


def _shapes_sql(src: str) -> str:
    return (f"(SELECT *, mu * exp(e) AS a, nu * exp(e) AS b, exp(e) AS ph, mu * nu * exp(e) AS v "
            f"FROM (SELECT *, 1 / (1 + exp(-t)) AS mu, 1 / (1 + exp(t)) AS nu FROM {src}))")


def _slopes_sql(src: str) -> str:
    """Derivatives dt, de, dtt, dte, dee of the segment's log density at (t, e)."""
    return f"""(SELECT *, v * (fa - fb) AS dt, a * fa + b * fb AS de, v * v * (faa + fbb - 2 * fab) + (nu - mu) * v * (fa - fb) AS dtt,
  v * (a * (faa - fab) + b * (fab - fbb)) + v * (fa - fb) AS dte, a * a * faa + b * b * fbb + 2 * a * b * fab + a * fa + b * fb AS dee
FROM (SELECT *, s1 - 1 / ah - m * ({_digamma_sql('a')} - pp) + 1 / a AS fa, s2 - 1 / bh - m * ({_digamma_sql('b')} - pp) + 1 / b AS fb,
  -m * ({_trigamma_sql('a')} - tp) - 1 / (a * a) AS faa, -m * ({_trigamma_sql('b')} - tp) - 1 / (b * b) AS fbb, m * tp AS fab
FROM (SELECT *, {_digamma_sql('ph')} AS pp, {_trigamma_sql('ph')} AS tp FROM {_shapes_sql(src)})))"""


def _inner_sql(src: str) -> str:
    """Slope it and curvature itt in theta at a given eta."""
    return f"""(SELECT *, v * (da - db) AS it, v * v * bend + (nu - mu) * v * (da - db) AS itt
FROM (SELECT *, s1 - 1 / ah - m * {_digamma_sql('a')} + 1 / a AS da, s2 - 1 / bh - m * {_digamma_sql('b')} + 1 / b AS db,
  -m * ({_trigamma_sql('a')} + {_trigamma_sql('b')}) - 1 / (a * a) - 1 / (b * b) AS bend FROM {_shapes_sql(src)}))"""


def cp_sql_ctes(g=CP_NODES, eps=CP_EPS, model="optional", key="word"):
    """Change-point CTE chain over ``series(key, date, idx, share)`` ending in ``cp``
    (to follow ``WITH RECURSIVE``): the same nodes around each segment's mode."""
    def clip(x):
        return f"greatest(least({x}, {cpo.MAX_STEP}), -{cpo.MAX_STEP})"
    rule = ", ".join(f"({t!r}, {w!r})" for t, w in cpo.hermite_nodes(g))
    seg = "key, idx, side, m, s1, s2, ah, bh"
    inner = "cout"
    for _ in range(cpo.INNER_STEPS):
        inner = f"""(SELECT {seg}, te, width, e, ow, t + CASE WHEN itt < 0 THEN {clip('-it / itt')} ELSE sign(it) END AS t FROM {_inner_sql(inner)})"""
    if model == "always":
        prior = "CAST(1 AS DOUBLE) / (n - 1)"
        conf = "1.0"
    else:
        u1, u0 = "(CAST(idx + 1 AS DOUBLE) / (n - 1))", "(CAST(idx AS DOUBLE) / (n - 1))"
        prior = f"(3 * {u1}^2 - 2 * {u1}^3) - (3 * {u0}^2 - 2 * {u0}^3)"
        conf = "1.0 / (1.0 + exp(e0 - e1))"
    return f"""cx AS (SELECT {key} AS key, date, idx, greatest(least(share, {1 - eps!r}), {eps!r}) AS x FROM series),
cpre AS (SELECT key, date, idx, idx + 1 AS m, ln(x) AS lx, ln(1 - x) AS l1x,
                sum(ln(x)) OVER (PARTITION BY key ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s1p,
                sum(ln(1 - x)) OVER (PARTITION BY key ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s2p
         FROM cx),
ctot AS (SELECT key, count(*) AS n, sum(ln(x)) AS s1t, sum(ln(1 - x)) AS s2t, avg(x) AS mu, var_pop(x) AS v
         FROM cx GROUP BY key),
chat AS (SELECT key, n, s1t, s2t, ((1 - mu) / v - 1 / mu) * mu * mu AS ah,
                ((1 - mu) / v - 1 / mu) * mu * mu * (1 / mu - 1) AS bh
         FROM ctot WHERE n >= 3 AND v > 0 AND v < mu * (1 - mu)),
csides AS (SELECT key, idx, 0 AS side, CAST(m AS DOUBLE) AS m, s1p AS s1, s2p AS s2, ah, bh FROM cpre JOIN chat USING (key)
         UNION ALL SELECT key, idx, 1, n - m, s1t - s1p, s2t - s2p, ah, bh FROM cpre JOIN chat USING (key) WHERE m < n),
cnewton AS (SELECT {seg}, ln(g / h) AS t, ln((m / 2 + 1.5) / (m * (g * ln(g) + h * ln(h)) - (g * s1 + h * s2) + g / ah + h / bh)) AS e, 0 AS step
         FROM (SELECT *, exp(s1 / m) / (exp(s1 / m) + exp(s2 / m)) AS g, exp(s2 / m) / (exp(s1 / m) + exp(s2 / m)) AS h FROM csides)
         UNION ALL SELECT {seg},
           t + {clip("CASE WHEN fine THEN -(dee * dt - dte * de) / det ELSE sign(dt) END")},
           e + {clip("CASE WHEN fine THEN -(dtt * de - dte * dt) / det ELSE sign(de) END")}, step + 1
         FROM (SELECT *, dtt * dee - dte * dte AS det, dtt < 0 AND dtt * dee > dte * dte AS fine FROM {_slopes_sql('cnewton')}) WHERE step < {cpo.MODE_STEPS}),
crule AS (SELECT * FROM (VALUES {rule}) r(x, w)),
cmode AS MATERIALIZED (SELECT {seg}, t, e, dte / dtt AS lean, sqrt(-dtt / (dtt * dee - dte * dte)) AS width
         FROM {_slopes_sql(f'(SELECT * FROM cnewton WHERE step = {cpo.MODE_STEPS})')}),
cout AS (SELECT {seg}, 0 AS te, width, e + width * x AS e, w AS ow, t - lean * width * x AS t FROM cmode, crule),
cin AS MATERIALIZED (SELECT {seg}, width, e, ow, t, 1 / sqrt(greatest(-itt, 1e-300)) AS s FROM {_inner_sql(inner)}),
cnode AS (SELECT key, idx, side, mu, a * (s1 - 1 / ah) + b * (s2 - 1 / bh) - m * (lgamma(a) + lgamma(b) - lgamma(ph)) + ln(a) + ln(b) - s1 - s2 - ln(ah * bh)
           + ow + iw + ln(s) + ln(width) AS l
         FROM {_shapes_sql('(SELECT * EXCLUDE (t), t + s * x AS t, w AS iw FROM cin, crule)')}),
cmx AS (SELECT *, max(l) OVER (PARTITION BY key, idx, side) AS top FROM cnode),
cev AS (SELECT key, idx, side, max(top) + ln(sum(exp(l - top))) AS lse, sum(exp(l - top) * mu) / sum(exp(l - top)) AS mean FROM cmx GROUP BY key, idx, side),
cseg AS (SELECT p.key, p.idx, p.date, h.n, l.lse AS lse_l, l.mean AS mu_l, r.lse AS lse_r, r.mean AS mu_r
         FROM cpre p JOIN chat h ON h.key = p.key JOIN cev l ON l.key = p.key AND l.idx = p.idx AND l.side = 0
         LEFT JOIN cev r ON r.key = p.key AND r.idx = p.idx AND r.side = 1),
cb AS (SELECT *, CASE WHEN idx < n - 1 THEN {prior} ELSE 0.0 END AS prior FROM cseg),
cc AS (SELECT *, CASE WHEN idx < n - 1 THEN ln(prior) + lse_l + lse_r END AS lp FROM cb),
cd AS (SELECT *, max(CASE WHEN idx = n - 1 THEN lse_l END) OVER (PARTITION BY key) AS e0,
              max(lp) OVER (PARTITION BY key) AS lpmax FROM cc),
ce AS (SELECT *, lpmax + ln(sum(exp(lp - lpmax)) OVER (PARTITION BY key)) AS e1 FROM cd),
cf AS (SELECT *, CASE WHEN idx < n - 1 THEN exp(lp - e1) ELSE 0.0 END AS post, {conf} AS confidence FROM ce),
cg AS (SELECT *, confidence * post + (1 - confidence) * prior AS hist FROM cf),
cres AS (SELECT key, max(confidence) AS confidence, sum(post * mu_l) AS mu_1, sum(post * mu_r) AS mu_2,
                first(date ORDER BY round(hist, 9) DESC, idx ASC) AS tau_map,
                sqrt(greatest(sum(hist * idx * idx) - sum(hist * idx) ^ 2, 0)) AS tau_std,
                sum(CASE WHEN hist > 0 THEN -hist * ln(hist) ELSE 0 END) AS entropy
         FROM cg GROUP BY key),
ckeys AS (SELECT {key} AS key, CAST(count(*) AS BIGINT) AS n_dates FROM series GROUP BY {key}),
cp AS (SELECT k.key AS {key}, k.n_dates, r.confidence, r.mu_1, r.mu_2, r.mu_2 - r.mu_1 AS mu_diff,
              CAST(r.tau_map AS VARCHAR) AS tau_map, r.tau_std, r.entropy
       FROM ckeys k LEFT JOIN cres r ON r.key = k.key)"""


CP_DOUBLES = ("confidence", "mu_1", "mu_2", "mu_diff", "tau_std", "entropy")

SQL_TOP_WORDS = wrap_sql(f"WITH {_top_ctes()} SELECT date, word, cf, CAST(rank AS BIGINT) AS rank FROM top",
                         texts=("date",))
SQL_POPULAR = f"WITH {_top_ctes()} SELECT word, cf_top_days FROM hot"
SQL_CORPUS_TOP = f"""WITH {POSTS_CTE},
{token_ctes()}
SELECT word, count(*) AS cf FROM words GROUP BY word ORDER BY cf DESC, word LIMIT 40"""
SQL_SERIES = wrap_sql(f"WITH {_series_ctes()} SELECT * FROM series", doubles=("share",), texts=("date",))
SQL_SERIES_SUM = wrap_sql(f"WITH {_series_ctes('sum')} SELECT * FROM series", doubles=("share",),
                          texts=("date",))
SQL_SHARE_NOTEBOOK = wrap_sql(f"""WITH {_top_ctes()},
pw AS (SELECT DISTINCT id, date, ups, word FROM words),
w AS (SELECT word, date, CAST(count(ups) AS DOUBLE) AS with_kw, count(*) AS n_with FROM pw
      WHERE word IN (SELECT word FROM hot) GROUP BY word, date),
t AS (SELECT date, CAST(count(ups) AS DOUBLE) AS all_kw, count(*) AS n_all FROM tposts GROUP BY date)
SELECT w.word, w.date, CASE WHEN n_all > n_with THEN with_kw / (with_kw + (all_kw - with_kw)) END AS share
FROM w JOIN t ON t.date = w.date""", doubles=("share",), texts=("date",))
SQL_NORMALISED = wrap_sql(f"""WITH {_series_ctes()}
SELECT word, date, share / (2.0 * (SELECT max(share) FROM series)) AS normalised FROM series""",
                          doubles=("normalised",), texts=("date",))
SQL_ROLLING = wrap_sql(f"""WITH {_series_ctes()}
SELECT word, date,
  CASE WHEN count(share) OVER w = 7 THEN avg(share) OVER w END AS rolling_mean
FROM series WINDOW w AS (PARTITION BY word ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""",
                       doubles=("rolling_mean",), texts=("date",))


def _new_terms_sql(persist: int, column="title") -> str:
    extra = ""
    if persist:
        extra = f"""
  AND (SELECT count(*) FROM hotk h2 WHERE h2.word = h.word
       AND h2.day_idx BETWEEN h.day_idx + 1 AND h.day_idx + {persist}) = {persist}
  AND h.day_idx < (SELECT count(*) FROM axis) - {persist}"""
    return wrap_sql(f"""WITH {_top_ctes(K_NEW, column)},
axis AS (SELECT date, CAST(row_number() OVER (ORDER BY date) - 1 AS BIGINT) AS day_idx
         FROM (SELECT DISTINCT date FROM tposts)),
hotk AS (SELECT t.date, a.day_idx, t.word, t.cf, CAST(t.rank AS BIGINT) AS rank FROM top t JOIN axis a ON a.date = t.date)
SELECT h.date, h.day_idx, h.word, h.cf, h.rank FROM hotk h
WHERE h.day_idx >= 11
  AND NOT EXISTS (SELECT 1 FROM hotk k WHERE k.word = h.word
                  AND k.day_idx BETWEEN h.day_idx - 9 AND h.day_idx - 1){extra}""", texts=("date",))


SQL_NEW_TERMS = _new_terms_sql(0)
SQL_NEW_PERSISTENT = _new_terms_sql(2)

SQL_TWO_LEVEL = wrap_sql(f"""WITH {_series_ctes()},
a AS (SELECT *, row_number() OVER ws AS r, count(*) OVER (PARTITION BY word) AS nn,
         sum(share) OVER ws AS c1, sum(share * share) OVER ws AS c2,
         sum(share) OVER (PARTITION BY word) AS t1, sum(share * share) OVER (PARTITION BY word) AS t2
      FROM series WINDOW ws AS (PARTITION BY word ORDER BY share, date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
b AS (SELECT *, CASE WHEN nn - r > 0 THEN (c2 - c1 * c1 / r) + ((t2 - c2) - (t1 - c1) ^ 2 / (nn - r)) END AS sse FROM a),
best AS (SELECT word, arg_min(r, (sse, r)) AS cut, arg_min(c1 / r, (sse, r)) AS low_mean,
                arg_min((t1 - c1) / (nn - r), (sse, r)) AS high_mean
         FROM b WHERE sse IS NOT NULL GROUP BY word),
lv AS (SELECT b.word, b.date, CASE WHEN best.cut IS NULL THEN b.share WHEN b.r <= best.cut THEN best.low_mean
                                   ELSE best.high_mean END AS level
       FROM b LEFT JOIN best ON best.word = b.word)
SELECT word, date, level,
  CASE WHEN count(level) OVER w = 7 THEN avg(level) OVER w END AS level_rolling
FROM lv WINDOW w AS (PARTITION BY word ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""",
                         doubles=("level", "level_rolling"), texts=("date",))

SQL_DAILY_ENTROPY = wrap_sql(f"""WITH {POSTS_CTE},
{token_ctes()},
counts AS (SELECT date, word, count(*) AS cf FROM words GROUP BY date, word),
p AS (SELECT date, cf * 1.0 / sum(cf) OVER (PARTITION BY date) AS p FROM counts)
SELECT date, -sum(p * ln(p)) AS entropy, count(*) AS n_words FROM p GROUP BY date""",
                             doubles=("entropy",), texts=("date",))

SQL_CP = wrap_sql(f"WITH RECURSIVE {_series_ctes()},\n{cp_sql_ctes()} SELECT * FROM cp", doubles=CP_DOUBLES)
SQL_CP_ALWAYS = wrap_sql(f"WITH RECURSIVE {_series_ctes()},\n{cp_sql_ctes(model='always')} SELECT * FROM cp",
                         doubles=CP_DOUBLES)
SQL_CP_REPORT = wrap_sql(f"""WITH RECURSIVE {_series_ctes()},
{cp_sql_ctes()}
SELECT word, confidence, mu_diff,
       CASE WHEN mu_diff >= 0 THEN floor(mu_diff * 100) / 100 ELSE ceil(mu_diff * 100) / 100 END AS mu_diff_2dp,
       entropy
FROM cp WHERE confidence >= 0.5 AND abs(mu_diff) > 0.01""",
                         doubles=("confidence", "mu_diff", "mu_diff_2dp", "entropy"))
SQL_EVENT_CP = wrap_sql(f"""WITH RECURSIVE ev AS (SELECT 'e' || CAST(event_id AS VARCHAR) AS id, CAST(ts AS DATE) AS date,
                   CAST(floor(value) AS BIGINT) AS ups, event_type AS word FROM events),
hot AS (SELECT DISTINCT word FROM ev),
kw AS (SELECT word, date, CAST(count(ups) AS DOUBLE) AS kw_stat FROM ev GROUP BY word, date),
tot AS (SELECT date, CAST(count(ups) AS DOUBLE) AS total FROM ev GROUP BY date),
s0 AS (SELECT h.word, t.date, coalesce(kw.kw_stat, 1.0) / t.total AS share
       FROM hot h CROSS JOIN tot t LEFT JOIN kw ON kw.word = h.word AND kw.date = t.date),
s1 AS (SELECT * FROM s0 WHERE share IS NOT NULL AND share <> 0),
series AS (SELECT word, date, row_number() OVER (PARTITION BY word ORDER BY date) - 1 AS idx, share FROM s1),
{cp_sql_ctes()} SELECT * FROM cp""", doubles=CP_DOUBLES)


def _community_cp_sql(words: str, totals: str, k: int) -> str:
    """Twin of the per-community change points over ``words(subreddit, id, date,
    ups, word)`` and ``totals(subreddit, date, total)``; a key is community,
    unit separator, word."""
    return wrap_sql(f"""WITH RECURSIVE {words},
wc AS (SELECT subreddit, date, word, count(*) AS cf FROM cwords GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY subreddit, date ORDER BY cf DESC, word) AS r FROM wc),
hot AS (SELECT DISTINCT subreddit, word FROM rk WHERE r <= {k}),
kw AS (SELECT subreddit, word, date, CAST(count(ups) AS DOUBLE) AS kw_stat FROM (SELECT DISTINCT subreddit, id, date, ups, word FROM cwords) GROUP BY ALL),
tot AS ({totals}),
s0 AS (SELECT h.subreddit || chr(31) || h.word AS word, t.date, coalesce(kw.kw_stat, 1.0) / t.total AS share
       FROM hot h JOIN tot t ON t.subreddit = h.subreddit
       LEFT JOIN kw ON kw.subreddit = h.subreddit AND kw.word = h.word AND kw.date = t.date),
s1 AS (SELECT * FROM s0 WHERE share IS NOT NULL AND share <> 0),
series AS (SELECT word, date, CAST(row_number() OVER (PARTITION BY word ORDER BY date) - 1 AS BIGINT) AS idx, share FROM s1),
{cp_sql_ctes()},
named AS (SELECT split_part(word, chr(31), 1) AS subreddit, split_part(word, chr(31), 2) AS w, * FROM cp)
SELECT subreddit, w AS word, n_dates, confidence, mu_1, mu_2, mu_diff, tau_map, tau_std, entropy, mu_2 / mu_1 AS mu_ratio,
  row_number() OVER (PARTITION BY subreddit ORDER BY round(entropy, 6) ASC NULLS LAST, w) AS entropy_rank
FROM named""", doubles=(*CP_DOUBLES, "mu_ratio"))


SQL_COMMUNITY_CP = _community_cp_sql(
    f"{POSTS_CTE},\n{token_ctes()},\ncwords AS (SELECT p.subreddit, w.id, w.date, w.ups, w.word FROM words w JOIN tposts p ON p.id = w.id)",
    "SELECT subreddit, date, CAST(count(ups) AS DOUBLE) AS total FROM tposts GROUP BY ALL", K_DAILY)
SQL_EVENT_COMMUNITY_CP = _community_cp_sql(
    """cwords AS (SELECT 'g' || CAST(user_id % 3 AS VARCHAR) AS subreddit, event_id AS id, CAST(ts AS DATE) AS date,
                    CAST(floor(value) AS BIGINT) AS ups, event_type AS word FROM events)""",
    "SELECT subreddit, date, CAST(count(ups) AS DOUBLE) AS total FROM cwords GROUP BY ALL", 100)

QUERIES = [
    Query("top_words_per_day", q_top_words_per_day, SQL_TOP_WORDS, ("T01", "N02", "A07", "L01")),
    Query("popular_words", q_popular_words, SQL_POPULAR, ("L02", "A35", "U03")),
    Query("corpus_top_words", q_corpus_top_words, SQL_CORPUS_TOP, ("A06", "L03")),
    Query("share_series", q_share_series, SQL_SERIES, ("A01", "A02", "A03", "J01", "P15")),
    Query("share_series_sum", q_share_series_sum, SQL_SERIES_SUM, ("A01", "A03")),
    Query("share_notebook", q_share_notebook, SQL_SHARE_NOTEBOOK, ("A04", "J02")),
    Query("share_normalised", q_share_normalised, SQL_NORMALISED, ("A05",)),
    Query("rolling_share", q_rolling_share, SQL_ROLLING, ("W02",)),
    Query("new_terms", q_new_terms, SQL_NEW_TERMS, ("W03",)),
    Query("new_persistent_terms", q_new_persistent_terms, SQL_NEW_PERSISTENT, ("W04",)),
    Query("two_level_activity", q_two_level, SQL_TWO_LEVEL, ("C08",)),
    Query("daily_entropy", q_daily_entropy, SQL_DAILY_ENTROPY, ("C09", "M07")),
    Query("change_points", q_change_points, SQL_CP, ("C01", "C02", "C04", "C05", "C06", "C07", "W05", "W07", "M05")),
    Query("community_change_points", q_community_change_points, SQL_COMMUNITY_CP, ("C01", "C06", "L15")),
    Query("event_community_change_points", q_event_community_change_points, SQL_EVENT_COMMUNITY_CP, ("C01", "C06", "L15")),
    Query("change_points_always", q_change_points_always, SQL_CP_ALWAYS, ("C03",)),
    Query("change_point_report", q_change_point_report, SQL_CP_REPORT, ("P19", "L15")),
    Query("top_words_per_day_body", q_top_words_per_day_body,
          wrap_sql(f"WITH {_top_ctes(column='selftext')} SELECT date, word, cf, CAST(rank AS BIGINT) AS rank FROM top", texts=("date",)), ("T01", "A07", "L01")),
    Query("share_series_body", q_share_series_body,
          wrap_sql(f"WITH {_series_ctes(column='selftext')} SELECT * FROM series", doubles=("share",), texts=("date",)), ("A01", "A02", "A03")),
    Query("new_terms_body", q_new_terms_body, _new_terms_sql(0, "selftext"), ("W03",)),
    Query("change_points_body", q_change_points_body,
          wrap_sql(f"WITH RECURSIVE {_series_ctes(column='selftext')},\n{cp_sql_ctes()} SELECT * FROM cp", doubles=CP_DOUBLES), ("C01", "C02", "C05", "C06")),
    Query("event_change_points", q_event_change_points, SQL_EVENT_CP, ("A03", "C01")),
]
