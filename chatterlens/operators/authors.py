"""Author statistics, empirical-Bayes shrinkage, power-law popularity and the
one-hit-wonder curve.

Skew: one author may own a third of all posts.  Every operator here is a
``groupBy`` with partial (map-side) aggregation, so a hot author is reduced
per input partition before the shuffle; nothing collects an author's rows
into one list.  Joining author features back to posts is a join on a table
with one row per author: AQE broadcasts it when it is measured small and
otherwise splits the skewed post partition (skew join).
"""

from __future__ import annotations

from pyspark.ml import Estimator, Model
from pyspark.ml.param.shared import Param, Params, TypeConverters
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.mathx import reconstruct_votes
from ..session import cut_lineage
from . import orderstat

EXCLUDED_AUTHORS = ["None", "AutoModerator"]   # fixed values: P11


def with_votes(posts: DataFrame, score_col: str = "ups", ratio_col: str = "upvote_ratio") -> DataFrame:
    """M01 on a table: reconstructed ``r_ups`` / ``r_downs`` from score and ratio."""
    u, d = reconstruct_votes(score_col, ratio_col)
    return posts.withColumn("r_ups", u).withColumn("r_downs", d)


def author_table(posts: DataFrame, value_col: str = "ups", exact_median: bool = True) -> DataFrame:
    """Per-author sum / count / mean / median / max / sample std.

    ``exact_median=False`` uses a bounded-memory sketch (``percentile_approx``)
    for authors with very many distinct values."""
    v = F.col(value_col)
    med = F.median(v) if exact_median else F.percentile_approx(v, 0.5, 10000)
    return posts.groupBy("author").agg(
        F.sum(v).cast("bigint").alias("ups_sum"),
        F.count(v).alias("n_posts"),
        F.avg(v).alias("ups_mean"),
        med.cast("double").alias("ups_median"),
        F.max(v).cast("bigint").alias("ups_max"),
        F.stddev_samp(v).alias("ups_std"),
    )


def popular_authors(posts: DataFrame, min_mean: float = 200.0, value_col: str = "ups") -> DataFrame:
    """A10: authors whose mean exceeds ``min_mean`` (HAVING), by post count."""
    t = author_table(posts, value_col)
    return t.filter(F.col("ups_mean") > min_mean).select("author", "n_posts", "ups_sum", "ups_mean")


def describe(df: DataFrame, col: str, exact: bool = True) -> DataFrame:
    """Count, mean, std, min, quartiles (linear interpolation), max.

    The exact quartiles come from distributed selection (:mod:`.orderstat`), so no
    task holds the distinct values; ``exact=False`` uses a quantile sketch in one pass."""
    c = F.col(col)
    if exact:
        found = orderstat.quantiles(df, [], col, (0.25, 0.5, 0.75))
        q = [found.filter(F.col("q") == x).select("value").scalar() for x in (0.25, 0.5, 0.75)]
    else:
        q = [F.percentile_approx(c, x, 10000).cast("double") for x in (0.25, 0.5, 0.75)]
    return df.agg(
        F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
        F.min(c).cast("double").alias("min"),
        q[0].alias("p25"), q[1].alias("p50"), q[2].alias("p75"), F.max(c).cast("double").alias("max"))


def beta_shrinkage(posts: DataFrame, prior=None, ups_col: str = "r_ups", downs_col: str = "r_downs"):
    """``(a + ups) / (a + b + ups + downs)`` per author.

    ``prior=None`` is the empirical prior a = sum(ups), b = sum(downs) over all
    posts (a one-row scalar aggregate); ``prior="moments"`` moment-matches a
    Beta to the authors' raw approval rates (the conjugate replacement of the
    sampled hierarchical model); otherwise an explicit ``(a, b)``.
    Returns ``(author_table, default_value_column)``.
    """
    agg = posts.groupBy("author").agg(F.sum(ups_col).alias("ups"), F.sum(downs_col).alias("downs"))
    agg = agg.filter(F.col("ups").isNotNull() & F.col("downs").isNotNull())
    if prior is None:
        tot = posts.agg(F.sum(ups_col).alias("a"), F.sum(downs_col).alias("b"))
        a = tot.select("a").scalar()
        b = tot.select("b").scalar()
    elif prior == "moments":
        rate = agg.filter((F.col("ups") + F.col("downs")) > 0) \
            .select((F.col("ups") / (F.col("ups") + F.col("downs"))).alias("r"))
        m = rate.agg(F.avg("r")).scalar()
        v = rate.agg(F.var_pop("r")).scalar()
        a = ((F.lit(1.0) - m) / v - F.lit(1.0) / m) * m * m
        b = a * (F.lit(1.0) / m - F.lit(1.0))
    else:
        a, b = F.lit(float(prior[0])), F.lit(float(prior[1]))
    out = agg.withColumn("beta_mean", (a + F.col("ups")) / (a + b + F.col("ups") + F.col("downs")))
    return out, (a / (a + b))


def power_law_popularity(posts: DataFrame, value_col: str = "ups", min_posts: int = 10) -> DataFrame:
    """Per-author power-law exponent by closed-form MLE on (0, max]:
    ``a = n / sum(ln(max / x))``, mean ``max * a / (a + 1)``; positive values
    only, at least ``min_posts`` of them.  One partial aggregate: the sum is
    ``n ln(max) - sum(ln x)``."""
    pos = posts.filter(F.col(value_col) > 0).select("author", F.col(value_col).cast("double").alias("x"))
    s = pos.groupBy("author").agg(F.max("x").alias("xmax"), F.min("x").alias("xmin"), F.count(F.lit(1)).alias("n"),
                                  F.sum(F.ln("x")).alias("sln")).filter(F.col("n") >= min_posts)
    # all values equal: the sum is exactly 0, which rounding must not hide
    s = s.withColumn("slog", F.when(F.col("xmin") < F.col("xmax"), F.col("n") * F.ln("xmax") - F.col("sln")).otherwise(F.lit(0.0)))
    a = F.when(F.col("slog") > 0, F.col("n") / F.col("slog"))
    return s.select("author", "n", a.alias("alpha"),
                    (F.col("xmax") * a / (a + F.lit(1.0))).alias("pl_mean"))


def one_hit_wonder_ratio(posts: DataFrame, threshold: float, value_col: str = "ups") -> DataFrame:
    """Authors with exactly one post above ``threshold`` / number of such posts."""
    pop = posts.filter(F.col(value_col) > threshold).groupBy("author").agg(F.count(F.lit(1)).alias("c"))
    return pop.agg(F.try_divide(F.sum(F.when(F.col("c") == 1, 1).otherwise(0)).cast("double"),
                                F.sum("c").cast("double")).alias("ohw_ratio"))


def one_hit_wonder_curve(posts: DataFrame, start: float = 10.0, stop: float = 600000.0,
                         num: int = 100, value_col: str = "ups") -> DataFrame:
    """The ratio at ``num`` evenly spaced thresholds, cut at the first
    threshold with no popular post.

    No join of thresholds with posts: each post's count of thresholds below
    its value is arithmetic; authors reduce to their two largest counts
    through a (author, count) pre-aggregate, and the curve is two cumulative
    sums over at most ``num`` + 1 values.
    """
    step = (stop - start) / (num - 1)
    v = F.col(value_col).cast("double")
    below = F.least(F.greatest(F.ceil((v - F.lit(start)) / F.lit(step)), F.lit(0)), F.lit(num)).cast("int")
    p = posts.filter(F.col(value_col).isNotNull()).select("author", below.alias("nb"))
    p = p.filter(F.col("nb") > 0)
    # popular posts at threshold j: posts with nb > j
    per_nb = p.groupBy("nb").agg(F.count(F.lit(1)).alias("c"))
    # author's two largest nb values via a bounded pre-aggregate
    an = p.groupBy("author", "nb").agg(F.count(F.lit(1)).alias("c"))
    top2 = an.groupBy("author").agg(
        F.max("nb").alias("m1"),
        F.max_by(F.col("c"), F.col("nb")).alias("c1"))
    sec = an.join(top2, "author").filter(F.col("nb") < F.col("m1")) \
        .groupBy("author").agg(F.max("nb").alias("m2_lt"))
    a2 = top2.join(sec, "author", "left").select(
        "author", "m1",
        F.when(F.col("c1") >= 2, F.col("m1")).otherwise(F.coalesce("m2_lt", F.lit(0))).alias("m2"))
    # author is a one-hit wonder at j (0-based) iff m2 <= j < m1
    delta = a2.select(F.col("m2").alias("j"), F.lit(1).alias("d")).unionByName(
        a2.select(F.col("m1").alias("j"), F.lit(-1).alias("d")))
    dj = delta.groupBy("j").agg(F.sum("d").alias("d"))
    grid = posts.sparkSession.range(num + 1).select(F.col("id").cast("int").alias("j"))
    g = grid.join(F.broadcast(dj), "j", "left").join(
        F.broadcast(per_nb.withColumnRenamed("nb", "j")), "j", "left").fillna(0, ["d", "c"])
    w = Window.orderBy("j").rowsBetween(Window.unboundedPreceding, 0)
    wrev = Window.orderBy(F.col("j").desc()).rowsBetween(Window.unboundedPreceding, -1)
    g = g.withColumn("ohw_authors", F.sum("d").over(w))
    g = g.withColumn("popular_posts", F.coalesce(F.sum("c").over(wrev), F.lit(0)))
    g = g.withColumn("threshold", F.lit(start) + F.col("j") * F.lit(step))
    g = g.withColumn("first_empty", F.min(F.when(F.col("popular_posts") == 0, F.col("j")))
                     .over(Window.partitionBy(F.lit(1))))
    g = g.filter((F.col("j") < num) & (F.col("first_empty").isNull() | (F.col("j") < F.col("first_empty"))))
    return g.select(F.col("j").alias("step"), "threshold", "popular_posts", "ohw_authors",
                    (F.col("ohw_authors") / F.col("popular_posts")).alias("ohw_ratio"))


def join_author_feature(posts: DataFrame, feature: DataFrame, col: str, default: Column,
                        how: str = "left") -> DataFrame:
    """Attach an author feature; unseen authors get ``default``.  The
    feature table is stored first: an aggregate by author in the same plan has
    no exchange of its own under the join, and AQE would then leave the rows of
    a hot author in one task."""
    feature = cut_lineage(feature.select("author", col))
    j = posts.join(feature.select("author", col), "author", how)
    return j.withColumn(col, F.coalesce(F.col(col), default))


# ------------------------------------------------------------------ ml stage
class AuthorInfluence(Estimator):
    """Fit an author table on the training posts; transform attaches it
    (unseen authors get the global value).  ``kind`` in sum, count, mean,
    median, std, max, beta_shrinkage, power_law."""

    kind = Param(Params._dummy(), "kind", "aggregate kind", typeConverter=TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "output column", typeConverter=TypeConverters.toString)

    def __init__(self, kind: str = "mean", outputCol: str | None = None, prior=None):
        super().__init__()
        self._setDefault(kind="mean", outputCol="auth_agg")
        self._set(kind=kind, outputCol=outputCol or f"auth_agg{kind}")
        self.prior = prior

    def _fit(self, df: DataFrame) -> "AuthorInfluenceModel":
        kind = self.getOrDefault("kind")
        out = self.getOrDefault("outputCol")
        if kind in ("sum", "count"):
            fn = {"sum": F.sum, "count": F.count}[kind]
            table = df.groupBy("author").agg(fn("ups").cast("double").alias(out))
            default = F.lit(0.0)
        elif kind in ("mean", "median", "std", "max"):
            fn = {"mean": F.avg, "median": F.median, "std": F.stddev_samp, "max": F.max}[kind]
            table = df.groupBy("author").agg(fn("ups").cast("double").alias(out))
            default = df.agg(fn("ups").cast("double")).scalar()
        elif kind == "beta_shrinkage":
            t, default = beta_shrinkage(with_votes(df) if "r_ups" not in df.columns else df, self.prior)
            table = t.select("author", F.col("beta_mean").alias(out))
        elif kind == "power_law":
            t = power_law_popularity(df)
            table = t.select("author", F.col("pl_mean").alias(out))
            default = df.filter(F.col("ups") > 0).agg(F.avg("ups")).scalar()
        else:
            raise ValueError(kind)
        return AuthorInfluenceModel(table, default, out)


class AuthorInfluenceModel(Model):
    def __init__(self, table: DataFrame, default: Column, out: str):
        super().__init__()
        self.table, self.default, self.out = table, default, out

    def _transform(self, df: DataFrame) -> DataFrame:
        return join_author_feature(df, self.table, self.out, self.default)
