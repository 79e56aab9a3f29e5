"""Term statistics: token tables, daily top terms, term-share time series and
the window operators over them (new / persistent terms, rolling means, the
two-level activity view and daily entropy).

Every operator here is one grouped / joined / windowed plan over *all* words
and *all* dates at once; nothing loops over words or dates on the driver.
Total order for every top-k: ``cf desc, word asc``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokenize
from ..functions.timeparts import utc_date
from ..session import cut_lineage


def with_tokens(posts: DataFrame, text_col: str = "title", out: str = "tokens",
                stop_words=None) -> DataFrame:
    """T01 on a column plus the UTC ``date`` of ``created_utc`` (the
    change-point preprocessing: no rows are filtered here)."""
    df = posts
    if "date" not in df.columns and "created_utc" in df.columns:
        df = df.withColumn("date", utc_date("created_utc"))
    return df.withColumn(out, tokenize(F.col(text_col), stop_words))


def word_occurrences(tok: DataFrame, tokens_col: str = "tokens", keep=("id", "date")) -> DataFrame:
    """One row per word occurrence (collection-frequency input)."""
    return tok.select(*keep, F.explode(F.flatten(tokens_col)).alias("word"))


def post_words(tok: DataFrame, tokens_col: str = "tokens", keep=("id", "date", "ups")) -> DataFrame:
    """One row per distinct (post, word): the document-frequency input."""
    return tok.select(*keep, F.explode(F.array_distinct(F.flatten(tokens_col))).alias("word"))


def corpus_frequency(tok: DataFrame, tokens_col: str = "tokens") -> DataFrame:
    """Collection frequency of every word over the whole corpus."""
    return (word_occurrences(tok, tokens_col, keep=())
            .groupBy("word").agg(F.count(F.lit(1)).alias("cf")))


def daily_word_counts(tok: DataFrame, tokens_col: str = "tokens") -> DataFrame:
    """Per-date collection frequency ``(date, word, cf)``.

    Partial (map-side) aggregation runs before the shuffle on (date, word), so
    a hot word is pre-summed per input partition and never lands whole in one
    task as raw rows.
    """
    return (word_occurrences(tok, tokens_col, keep=("date",))
            .groupBy("date", "word").agg(F.count(F.lit(1)).alias("cf")))


def top_k_by(df: DataFrame, group_cols, k: int, order_cols, rank_col: str = "rank") -> DataFrame:
    """Top-k rows per group under a total order.

    ``row_number() <= k`` lets Catalyst insert a partial ``WindowGroupLimit``
    before the shuffle, so each input partition ships at most k rows per
    group; the final window sees at most k x partitions rows per group.
    """
    w = Window.partitionBy(*group_cols).orderBy(*order_cols)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)


def top_words_per_day(tok: DataFrame, k: int = 2, tokens_col: str = "tokens") -> DataFrame:
    """The k most frequent words of every date ``(date, word, cf, rank)``."""
    counts = daily_word_counts(tok, tokens_col)
    return top_k_by(counts, ["date"], k, [F.col("cf").desc(), F.col("word").asc()])


def popular_words(tok: DataFrame, k: int = 2, tokens_col: str = "tokens",
                  up_to: int | None = None) -> DataFrame:
    """Union of the daily top-k words, ``(word, cf_total)``.

    ``up_to`` keeps the first words under our defined order (total cf desc,
    word asc); upstream took the first items of an unordered set.
    """
    top = top_words_per_day(tok, k, tokens_col)
    words = top.groupBy("word").agg(F.sum("cf").cast("bigint").alias("cf_top_days"))
    if up_to is not None:
        total = corpus_frequency(tok, tokens_col)
        words = (words.join(total, "word")
                 .orderBy(F.col("cf").desc(), F.col("word")).limit(up_to)
                 .select("word", "cf_top_days"))
    return words


def top_corpus_words(tok: DataFrame, k: int = 40, tokens_col: str = "tokens") -> DataFrame:
    """Top-k words of the whole corpus."""
    return corpus_frequency(tok, tokens_col).orderBy(F.col("cf").desc(), F.col("word")).limit(k)


def _stat(statistic: str, c: str = "ups") -> Column:
    statistic = statistic.lower()
    if statistic == "count":
        return F.count(c).cast("double")          # non-null count, not count(*)
    if statistic == "sum":
        return F.sum(c).cast("double")
    if statistic == "mean":
        return F.avg(c)
    if statistic == "median":
        return F.median(c).cast("double")
    raise ValueError(f"unknown statistic {statistic}")


def daily_totals(tok: DataFrame, statistic: str = "count", value_col: str = "ups") -> DataFrame:
    """``(date, total)`` statistic of all posts per date."""
    return tok.groupBy("date").agg(_stat(statistic, value_col).alias("total"))


def keyword_daily_stat(tok: DataFrame, words: DataFrame, statistic: str = "count",
                       tokens_col: str = "tokens", value_col: str = "ups") -> DataFrame:
    """``(word, date, kw_stat)`` for posts containing each word, all words in one pass.

    ``words`` is a small derived table (daily top words); the semi join lets
    AQE broadcast it once its measured size is known, otherwise it stays a
    shuffle join.
    """
    pw = post_words(tok, tokens_col, keep=("date", value_col))
    pw = pw.join(words.select("word"), "word", "left_semi")
    return pw.groupBy("word", "date").agg(_stat(statistic, value_col).alias("kw_stat"))


def keyword_share_series(tok: DataFrame, words: DataFrame, statistic: str = "count",
                         fill: float = 1.0, tokens_col: str = "tokens",
                         value_col: str = "ups") -> DataFrame:
    """A03 (package version): ``(word, date, idx, n, share)``.

    ``words`` is a word table, or an int k meaning "the union of the daily
    top-k words" computed from the same materialised token slice.

    For every word and every date of the corpus: keyword statistic (missing
    date -> ``fill``, 1 upstream, also for sums) divided by the date's total;
    shares equal to 0 (and undefined ones) are dropped, then positions are
    numbered per word.  The date axis is attached to each word by exploding
    the sorted per-date totals, a scalar subquery of at most one row per
    calendar date -- no join of words with dates is planned.
    """
    if statistic in ("count", "sum"):
        # one stored aggregate by (date, word) serves hot words and word days;
        # the tokenised corpus is read once and never copied
        days = cut_lineage(term_days(tok, ("date",), tokens_col, value_col))
        if isinstance(words, int):
            words = top_k_by(days, ["date"], words, [F.col("cf").desc(), F.col("word").asc()]).select("word").distinct()
        kw = days.select("word", "date", F.col("posts" if statistic == "count" else "total").cast("double").alias("kw_stat"))
    else:
        # order statistics need the posts themselves: the narrow slice is
        # materialised once for the branches that read it
        tok = cut_lineage(tok.select("date", value_col, tokens_col))
        if isinstance(words, int):
            words = popular_words(tok, words, tokens_col)
        kw = keyword_daily_stat(tok, words, statistic, tokens_col, value_col)
    totals = daily_totals(tok, statistic, value_col)
    axis = totals.select(F.sort_array(F.collect_list(F.struct("date", "total"))).alias("axis")).scalar()
    grid = words.select("word").distinct().select("word", F.explode(axis).alias("d"))
    grid = grid.select("word", F.col("d.date").alias("date"), F.col("d.total").alias("total"))
    s = grid.join(kw, ["word", "date"], "left")
    s = s.withColumn("share", F.try_divide(F.coalesce(F.col("kw_stat"), F.lit(float(fill))), F.col("total")))
    s = s.filter(F.col("share").isNotNull() & (F.col("share") != 0))
    w = Window.partitionBy("word").orderBy("date")
    s = s.withColumn("idx", (F.row_number().over(w) - 1).cast("int"))
    s = s.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("word")).cast("int"))
    return s.select("word", "date", "idx", "n", "share")


def term_days(posts: DataFrame, keys, tokens_col: str = "tokens", value_col: str = "ups") -> DataFrame:
    """``(keys, word, cf, posts, total)`` in one aggregate: occurrences, posts with
    a value that hold the word, and the sum of their values.  A post's words are
    sorted, so its repeats stand together and each place is one narrow row; the
    only shuffle is that of the partial sums."""
    w = posts.select(*keys, value_col, F.array_sort(F.flatten(tokens_col)).alias("word"))
    # sorted, a word's first place in a post is the one that differs from the word before
    w = w.withColumn("before", F.concat(F.array(F.lit(None).cast("string")), F.slice("word", 1, F.greatest(F.size("word") - 1, F.lit(0)))))
    w = w.select(*keys, value_col, F.inline(F.arrays_zip("word", "before")))
    first = F.when(F.col("before").isNull() | (F.col("before") != F.col("word")), F.col(value_col))
    return w.where(F.col("word").isNotNull()).groupBy(*keys, "word").agg(
        F.count(F.lit(1)).alias("cf"), F.count(first).alias("posts"), F.sum(first).alias("total"))


def community_share_series(posts: DataFrame, k: int, fill: float = 1.0, tokens_col: str = "tokens",
                           value_col: str = "ups", community: str = "subreddit") -> DataFrame:
    """A03 for every community apart: ``(community, word, date, idx, n, share)``
    of the union of its daily top-``k`` words over its own dates.

    Hot words and word days come from one stored aggregate; the tokenised
    corpus itself is read once and never copied.
    """
    days = cut_lineage(term_days(posts, (community, "date"), tokens_col, value_col))
    totals = posts.groupBy(community, "date").agg(F.count(value_col).cast("double").alias("total"))
    # one array of dates for each community
    axis = totals.groupBy(community).agg(F.sort_array(F.collect_list(F.struct("date", "total"))).alias("axis"))
    hot = top_k_by(days, [community, "date"], k, [F.col("cf").desc(), F.col("word").asc()]) \
        .select(community, "word").distinct()
    grid = hot.join(axis, community).select(community, "word", F.explode("axis").alias("d"))
    grid = grid.select(community, "word", F.col("d.date").alias("date"), F.col("d.total").alias("total"))
    s = grid.join(days.select(community, "word", "date", F.col("posts").cast("double").alias("kw")),
                  [community, "word", "date"], "left")
    s = s.withColumn("share", F.try_divide(F.coalesce("kw", F.lit(float(fill))), F.col("total")))
    s = s.filter(F.col("share").isNotNull() & (F.col("share") != 0))
    w = Window.partitionBy(community, "word")
    return s.select(community, "word", "date", (F.row_number().over(w.orderBy("date")) - 1).cast("int").alias("idx"),
                    F.count(F.lit(1)).over(w).cast("int").alias("n"), "share")


def keyword_share_notebook(tok: DataFrame, words: DataFrame, tokens_col: str = "tokens",
                           value_col: str = "ups", statistic: str = "count") -> DataFrame:
    """A04 (notebook version): with / (with + without) per date; null when a
    side has no posts on that date (upstream's left join loses it)."""
    pw = post_words(tok, tokens_col, keep=("id", "date", value_col))
    pw = pw.join(words.select("word"), "word", "left_semi")
    withw = pw.groupBy("word", "date").agg(_stat(statistic, value_col).alias("with_kw"),
                                          F.count(F.lit(1)).alias("n_with"))
    totals = tok.groupBy("date").agg(_stat(statistic, value_col).alias("all_kw"),
                                     F.count(F.lit(1)).alias("n_all"))
    j = withw.join(totals, "date")
    without = F.col("all_kw") - F.col("with_kw")
    share = F.when(F.col("n_all") > F.col("n_with"),
                   F.col("with_kw") / (F.col("with_kw") + without))
    return j.select("word", "date", share.alias("share"))


def normalised_total(series: DataFrame, value_col: str = "share", factor: float = 2.0) -> DataFrame:
    """``x / (factor * max(x))`` with the global max as a scalar subquery."""
    mx = series.agg(F.max(value_col)).scalar()
    return series.withColumn("normalised", F.col(value_col) / (F.lit(factor) * mx))


def rolling_mean(series: DataFrame, value_col: str = "share", rows: int = 30,
                 key: str = "word", order: str = "date") -> DataFrame:
    """Trailing ``rows``-row mean, null until the window is full."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-(rows - 1), 0)
    return series.withColumn(
        "rolling_mean",
        F.when(F.count(value_col).over(w) == rows, F.avg(value_col).over(w)))


def new_terms(tok: DataFrame, k_hot: int = 200, k_known: int = 200, lookback: int = 9,
              skip_first: int = 11, persist_ahead: int = 0, tokens_col: str = "tokens") -> DataFrame:
    """Words in a date's top-``k_hot`` list that are absent from
    the top-``k_known`` list of each of the previous ``lookback`` dates.

    Dates are positions (dense rank), not calendar days; the first
    ``skip_first`` positions are not reported.  With ``persist_ahead = 2`` the
    word must also be in the top-``k_hot`` list of both following positions
    (no row for the last positions, where upstream indexed past the end).
    """
    counts = daily_word_counts(tok, tokens_col)
    k_max = max(k_hot, k_known)
    ranked = top_k_by(counts, ["date"], k_max, [F.col("cf").desc(), F.col("word").asc()])
    pos = _with_day_index(ranked, tok)
    known = pos.filter(F.col("rank") <= k_known).select("word", "day_idx")
    hot = pos.filter(F.col("rank") <= k_hot).select("word", "date", "day_idx", "cf", "rank")
    wk = Window.partitionBy("word").orderBy("day_idx")
    known_flag = known.withColumn("is_known", F.lit(1))
    both = hot.join(known_flag, ["word", "day_idx"], "full_outer")
    both = both.withColumn(
        "known_before",
        F.count("is_known").over(wk.rangeBetween(-lookback, -1)))
    if persist_ahead:
        both = both.withColumn(
            "hot_after",
            F.count("rank").over(wk.rangeBetween(1, persist_ahead)))
    n_days = _n_days(tok)
    res = both.filter(F.col("rank").isNotNull() & (F.col("day_idx") >= skip_first)
                      & (F.col("known_before") == 0))
    if persist_ahead:
        res = res.filter((F.col("hot_after") == persist_ahead)
                         & (F.col("day_idx") < n_days - persist_ahead))
    return res.select("date", "day_idx", "word", "cf", "rank")


def _day_axis(tok: DataFrame) -> Column:
    return tok.select(F.sort_array(F.collect_set("date")).alias("axis")).scalar()


def _with_day_index(df: DataFrame, tok: DataFrame) -> DataFrame:
    """Position of each date on the corpus date axis (a small scalar array)."""
    axis = _day_axis(tok)
    return df.withColumn("day_idx", (F.array_position(axis, F.col("date")) - 1).cast("int"))


def _n_days(tok: DataFrame) -> Column:
    return tok.select(F.count_distinct("date")).scalar()


def two_level_activity(series: DataFrame, value_col: str = "share", key: str = "word",
                       order: str = "date", rolling: int = 30) -> DataFrame:
    """Exact 1-D 2-means per key (sorted values, prefix sums, best cut by
    least within-cluster sum of squares), each value replaced by its cluster
    mean, then the ``rolling``-row trailing mean of that level."""
    v = F.col(value_col)
    ws = Window.partitionBy(key).orderBy(v, order)
    wall = Window.partitionBy(key)
    s = (series.withColumn("_r", F.row_number().over(ws))
         .withColumn("_n", F.count(F.lit(1)).over(wall))
         .withColumn("_c1", F.sum(v).over(ws.rowsBetween(Window.unboundedPreceding, 0)))
         .withColumn("_c2", F.sum(v * v).over(ws.rowsBetween(Window.unboundedPreceding, 0)))
         .withColumn("_t1", F.sum(v).over(wall))
         .withColumn("_t2", F.sum(v * v).over(wall)))
    left_ss = F.col("_c2") - F.col("_c1") * F.col("_c1") / F.col("_r")
    nr = F.col("_n") - F.col("_r")
    right_ss = (F.col("_t2") - F.col("_c2")) - (F.col("_t1") - F.col("_c1")) ** 2 / nr
    s = s.withColumn("_sse", F.when(nr > 0, left_ss + right_ss))
    best = (s.filter(F.col("_sse").isNotNull())
            .groupBy(key).agg(F.min_by(F.struct("_r", "_c1", "_t1", "_n"),
                                       F.struct(F.col("_sse"), F.col("_r"))).alias("b")))
    best = best.select(key, F.col("b._r").alias("cut"),
                       (F.col("b._c1") / F.col("b._r")).alias("low_mean"),
                       ((F.col("b._t1") - F.col("b._c1")) / (F.col("b._n") - F.col("b._r"))).alias("high_mean"))
    out = s.join(best, key, "left")
    level = F.when(F.col("cut").isNull(), v) \
        .when(F.col("_r") <= F.col("cut"), F.col("low_mean")).otherwise(F.col("high_mean"))
    out = out.withColumn("level", level).select(*series.columns, "level")
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-(rolling - 1), 0)
    return out.withColumn("level_rolling",
                          F.when(F.count("level").over(w) == rolling, F.avg("level").over(w)))


def daily_entropy(tok: DataFrame, tokens_col: str = "tokens") -> DataFrame:
    """Shannon entropy (natural log) of each date's word distribution."""
    counts = daily_word_counts(tok, tokens_col)
    tot = counts.groupBy("date").agg(F.sum("cf").alias("total"))
    p = counts.join(tot, "date").withColumn("p", F.col("cf") / F.col("total"))
    return p.groupBy("date").agg((-F.sum(F.col("p") * F.ln("p"))).alias("entropy"),
                                 F.count(F.lit(1)).alias("n_words"))


# ------------------------------------------------------------------ ml stage
from pyspark.ml import Transformer  # noqa: E402
from pyspark.ml.param.shared import HasInputCol, HasOutputCol  # noqa: E402


class TextTokenizer(Transformer, HasInputCol, HasOutputCol):
    """The tokenizer (T01/T02) as a reusable pipeline stage; ``stop_words``
    None = English list, [] = keep every word."""

    def __init__(self, inputCol: str = "title", outputCol: str | None = None, stop_words=None):
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol or f"tokenized_{inputCol}")
        self.stop_words = stop_words

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.getOutputCol(), tokenize(F.col(self.getInputCol()), self.stop_words))
