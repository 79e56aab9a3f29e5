"""Bayesian change points in every term's daily share, in one distributed job.

Model (optional-change, per word): observations x_0..x_{n-1} in (0, 1);
``delta ~ Bernoulli(p)``, ``p ~ Beta(cp_alpha, cp_beta)``;
``tau = (n-1) * Beta(2, 2)``; rows with ``idx < tau`` follow
``Beta(alpha_1, beta_1)``, the others ``Beta(alpha_2, beta_2)`` when a change
exists; every shape parameter has an Exponential prior whose mean is the
method-of-moments estimate of the whole series.  The always-change variant
fixes ``delta = 1`` and uses a uniform ``tau``.

Instead of sampling, the posterior is summed over ``tau`` (its histogram bins are
series positions) and integrated over the shape parameters of each segment, in
theta = logit of the mean a/(a+b) and eta = ln of the precision a+b.  A Newton
search with digamma and trigamma finds the segment's mode; Gauss-Hermite nodes in
eta, as wide as the posterior there, each get the mode and width of theta given eta
(two more Newton steps), around which the nodes in theta lie.  The rule follows
each segment's posterior, however tight, so a few nodes are enough: 8 and 32 a
dimension agree to 1e-3 in every output (tests).  A segment's likelihood needs only
the sums of ``ln x`` and ``ln(1-x)`` over it, so prefix sums per word (one window)
give every split at once.

Plan shape: one shuffle by word (series windows), then rows for each (segment, outer
node, inner node) that are summed where they lie: the final aggregate reuses that
partitioning.  Work is words x dates x nodes^2 and each word's series has one row
per date, so no group grows with the post count.

Outputs per word: ``confidence`` (posterior P(delta = 1)), ``mu_1``, ``mu_2``
(posterior means of a/(a+b) before / after the change, given a change),
``mu_diff``, ``tau_map`` (date of the histogram's mode, earliest of those equal to 9 places),
``tau_std`` and ``entropy`` of the tau histogram, where the histogram is the
mixture ``confidence * p(tau | change) + (1 - confidence) * prior(tau)`` that
a sampler's trace of tau would show.  Words with fewer than 3 points or a
series whose moments admit no Beta return null statistics.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.mathx import digamma_sql, entropy_term, let_sql, lgamma_sql, trigamma_sql
from ..session import cut_lineage

#: Gauss-Hermite nodes a dimension.
DEFAULT_NODES = 10
DEFAULT_EPS = 1e-6
#: Newton steps to a segment's mode, and to the mode of theta at an outer node; the
#: largest change of theta or eta in one step.
MODE_STEPS, INNER_STEPS, MAX_STEP = 14, 2, 2.0


def hermite_nodes(g: int) -> list[tuple[float, float]]:
    """Gauss-Hermite nodes times sqrt(2) with the logs of their weights for a plain integrand."""
    t, w = np.polynomial.hermite.hermgauss(g)
    return [(float(math.sqrt(2) * x), float(math.log(math.sqrt(2) * y) + x * x)) for x, y in zip(t, w)]


def _clip(x: str) -> str:
    return f"greatest(least({x}, {MAX_STEP}D), -{MAX_STEP}D)"


def _struct(**parts: str) -> str:
    return "named_struct(" + ", ".join(f"'{n}', {x}" for n, x in parts.items()) + ")"


def _shapes(t: str, e: str, use: str) -> str:
    """``use`` with struct p (mu, nu, phi, a, b): mean, its complement, precision, shapes."""
    first = _struct(mu=f"1D / (1D + exp(-{t}))", nu=f"1D / (1D + exp({t}))", phi=f"exp({e})")
    return let_sql("o", first, let_sql("p", _struct(mu="o.mu", nu="o.nu", phi="o.phi", a="o.mu * o.phi", b="o.nu * o.phi"), use))


def _slopes(t: str, e: str, use: str) -> str:
    """``use`` with struct d (t, e, tt, te, ee): derivatives of the log posterior density
    at (theta, eta) of the segment (m, s1, s2, ahat, bhat)."""
    first = _struct(
        mu="p.mu", nu="p.nu", a="p.a", b="p.b", v="p.a * p.nu",
        fa=f"s1 - 1D / ahat - m * ({digamma_sql('p.a')} - g.f) + 1D / p.a", fb=f"s2 - 1D / bhat - m * ({digamma_sql('p.b')} - g.f) + 1D / p.b",
        faa=f"-m * ({trigamma_sql('p.a')} - g.ff) - 1D / (p.a * p.a)", fbb=f"-m * ({trigamma_sql('p.b')} - g.ff) - 1D / (p.b * p.b)", fab="m * g.ff")
    second = _struct(
        t="q.v * (q.fa - q.fb)", e="q.a * q.fa + q.b * q.fb",
        tt="q.v * q.v * (q.faa + q.fbb - 2D * q.fab) + (q.nu - q.mu) * q.v * (q.fa - q.fb)",
        te="q.v * (q.a * (q.faa - q.fab) + q.b * (q.fab - q.fbb)) + q.v * (q.fa - q.fb)",
        ee="q.a * q.a * q.faa + q.b * q.b * q.fbb + 2D * q.a * q.b * q.fab + q.a * q.fa + q.b * q.fb")
    whole = let_sql("g", _struct(f=digamma_sql("p.phi"), ff=trigamma_sql("p.phi")), let_sql("q", first, let_sql("d", second, use)))
    return _shapes(t, e, whole)


def _mode() -> str:
    """struct(t, e): the segment's posterior mode, from Stirling's approximation on."""
    phi = ("(m / 2D + 1.5D) / (m * (w.g * ln(w.g) + w.h * ln(w.h)) - (w.g * s1 + w.h * s2) + w.g / ahat + w.h / bhat)")
    g = "exp(s1 / m) / (exp(s1 / m) + exp(s2 / m))"
    h = "exp(s2 / m) / (exp(s1 / m) + exp(s2 / m))"
    start = let_sql("w", _struct(g=g, h=h), _struct(t="ln(w.g / w.h)", e=f"ln({phi})", by="1D"))
    fine = "d.tt < 0D AND d.tt * d.ee > d.te * d.te"
    det = "(d.tt * d.ee - d.te * d.te)"
    step = _struct(t=_clip(f"CASE WHEN {fine} THEN -(d.ee * d.t - d.te * d.e) / {det} ELSE signum(d.t) END"),
                   e=_clip(f"CASE WHEN {fine} THEN -(d.tt * d.e - d.te * d.t) / {det} ELSE signum(d.e) END"))
    move = let_sql("z", step, _struct(t="acc.t + z.t", e="acc.e + z.e", by="abs(z.t) + abs(z.e)"))
    # a search that has arrived stays where it is
    return f"aggregate(sequence(1, {MODE_STEPS}), {start}, (acc, i) -> CASE WHEN acc.by < 1e-8D THEN acc ELSE {_slopes('acc.t', 'acc.e', move)} END)"


def _inner(start: str) -> str:
    """struct(t, s): mode and width of theta at the outer node's ``eta``."""
    def slopes(t, use):
        both = _struct(t="p.a * p.nu * (r.da - r.db)", tt="p.a * p.nu * p.a * p.nu * r.bend + (p.nu - p.mu) * p.a * p.nu * (r.da - r.db)")
        r = _struct(da=f"s1 - 1D / ahat - m * {digamma_sql('p.a')} + 1D / p.a", db=f"s2 - 1D / bhat - m * {digamma_sql('p.b')} + 1D / p.b",
                    bend=f"-m * ({trigamma_sql('p.a')} + {trigamma_sql('p.b')}) - 1D / (p.a * p.a) - 1D / (p.b * p.b)")
        return _shapes(t, "eta", let_sql("r", r, let_sql("d", both, use)))

    step = slopes("acc", "acc + " + _clip("CASE WHEN d.tt < 0D THEN -d.t / d.tt ELSE signum(d.t) END"))
    t = f"aggregate(sequence(1, {INNER_STEPS}), {start}, (acc, i) -> {step})"
    return let_sql("x", t, _struct(t="x", s=slopes("x", "1D / sqrt(greatest(-d.tt, 1e-300D))")))


#: Log posterior density in (theta, eta), without the terms that all nodes share.
_DENSITY = (f"a * (s1 - 1D / ahat) + b * (s2 - 1D / bhat) - m * ({lgamma_sql('a')} + {lgamma_sql('b')} - lg_phi) + ln(a) + ln(b)")


def segment_evidence(segments: DataFrame, keys: list[str], nodes: int) -> DataFrame:
    """(keys, lse, mean): the log evidence of each segment (keys, m, s1, s2, ahat, bhat)
    under Beta shapes with Exponential priors, and the posterior mean of a/(a+b)."""
    rule = "array(" + ", ".join(_struct(t=f"{t!r}D", w=f"{w!r}D") for t, w in hermite_nodes(nodes)) + ")"
    s = segments.selectExpr("*", f"{_mode()} AS mode")
    s = s.selectExpr("*", f"{_slopes('mode.t', 'mode.e', 'd')} AS d")
    s = s.selectExpr("*", "sqrt(-d.tt / (d.tt * d.ee - d.te * d.te)) AS width", "1D / (1D + exp(-mode.t)) * exp(mode.e) AS a",
                     "1D / (1D + exp(mode.t)) * exp(mode.e) AS b", "exp(mode.e) AS phi")
    s = s.selectExpr("*", f"{lgamma_sql('phi')} AS lg_phi")
    s = s.selectExpr(*keys, "m", "s1", "s2", "ahat", "bhat", "mode", "d", "width", f"{_DENSITY} AS top", f"explode({rule}) AS o")
    # outer nodes
    s = s.selectExpr("*", "mode.e + width * o.t AS eta", "exp(mode.e + width * o.t) AS phi")
    s = s.selectExpr("*", f"{_inner('mode.t - d.te / d.tt * width * o.t')} AS i", f"{lgamma_sql('phi')} AS lg_phi")
    # inner nodes
    s = s.selectExpr("*", f"explode({rule}) AS k")
    s = s.selectExpr("*", "i.t + i.s * k.t AS theta")
    s = s.selectExpr("*", "1D / (1D + exp(-theta)) AS mu", "1D / (1D + exp(-theta)) * phi AS a", "1D / (1D + exp(theta)) * phi AS b")
    s = s.selectExpr(*keys, "mu", f"exp({_DENSITY} - top + o.w + k.w) * i.s AS weight", "top + ln(width) - s1 - s2 - ln(ahat * bhat) AS base")
    out = s.groupBy(*keys).agg(F.sum("weight").alias("sum"), F.sum(F.col("weight") * F.col("mu")).alias("mu_sum"), F.first("base").alias("base"))
    return out.select(*keys, (F.col("base") + F.ln("sum")).alias("lse"), (F.col("mu_sum") / F.col("sum")).alias("mean"))


def change_points(series: DataFrame, key: str = "word", value_col: str = "share",
                  nodes: int = DEFAULT_NODES, eps: float = DEFAULT_EPS,
                  model: str = "optional", cp_alpha: float = 1.0, cp_beta: float = 1.0,
                  date_col: str = "date", idx_col: str = "idx") -> DataFrame:
    """C01-C07 over a series table ``(key, date, idx, value)``.

    ``idx`` must number each key's points 0..n-1 in date order.
    """
    # the series is small (words x dates) but expensive to derive and read
    # by several branches below: materialise it once in the shared
    # checkpoint folder, which also cuts its lineage
    series = cut_lineage(series.select(key, date_col, idx_col, value_col))
    # few bytes but much work a row: a stated number of partitions is not coalesced
    tasks = int(series.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    series = series.repartition(tasks, key)
    x = F.least(F.greatest(F.col(value_col).cast("double"), F.lit(eps)), F.lit(1.0 - eps))
    s = series.select(key, date_col, idx_col, x.alias("x"))
    s = s.withColumn("lx", F.ln("x")).withColumn("l1x", F.ln(F.lit(1.0) - F.col("x")))

    wk = Window.partitionBy(key)
    wp = Window.partitionBy(key).orderBy(idx_col).rowsBetween(Window.unboundedPreceding, 0)
    s = (s.withColumn("m", F.col(idx_col) + 1)
          .withColumn("s1p", F.sum("lx").over(wp))
          .withColumn("s2p", F.sum("l1x").over(wp))
          .withColumn("n", F.count(F.lit(1)).over(wk))
          .withColumn("s1t", F.sum("lx").over(wk))
          .withColumn("s2t", F.sum("l1x").over(wk))
          .withColumn("mu", F.avg("x").over(wk))
          .withColumn("var", F.var_pop("x").over(wk)))

    mu, var = F.col("mu"), F.col("var")
    ok = (F.col("n") >= 3) & (var > 0) & (var < mu * (F.lit(1.0) - mu))
    ahat = F.when(ok, ((F.lit(1.0) - mu) / var - F.lit(1.0) / mu) * mu * mu)
    bhat = ahat * (F.lit(1.0) / mu - F.lit(1.0))
    s = s.withColumn("ahat", ahat).withColumn("bhat", bhat).filter(F.col("ahat").isNotNull())

    # the segments before and after each split; the last row's first one is the whole series
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("m").alias("m"), F.col("s1p").alias("s1"), F.col("s2p").alias("s2")),
                    F.struct(F.lit(1).alias("side"), (F.col("n") - F.col("m")).alias("m"), (F.col("s1t") - F.col("s1p")).alias("s1"),
                             (F.col("s2t") - F.col("s2p")).alias("s2")))
    facts = F.struct(F.col(date_col).alias("date"), F.col("n").alias("n"))
    seg = s.select(key, idx_col, facts.alias("facts"), "ahat", "bhat", F.explode(sides).alias("g")) \
        .select(key, idx_col, "facts", "ahat", "bhat", F.col("g.side").alias("side"), F.col("g.m").cast("double").alias("m"),
                F.col("g.s1").alias("s1"), F.col("g.s2").alias("s2")).filter(F.col("m") > 0)
    e = segment_evidence(seg, [key, idx_col, "facts", "side"], nodes)

    def of(side, c):
        return F.max(F.when(F.col("side") == side, F.col(c)))

    s = e.groupBy(key, idx_col, "facts").agg(of(0, "lse").alias("lse_l"), of(0, "mean").alias("mu_l"), of(1, "lse").alias("lse_r"), of(1, "mean").alias("mu_r")) \
        .select(key, idx_col, F.col("facts.date").alias(date_col), F.col("facts.n").alias("n"), "lse_l", "mu_l", "lse_r", "mu_r")

    n1 = (F.col("n") - 1).cast("double")
    k = F.col(idx_col).cast("double")
    if model == "always":
        prior = F.when(F.col(idx_col) < F.col("n") - 1, F.lit(1.0) / n1).otherwise(F.lit(0.0))
    else:
        def cdf(u):
            return F.lit(3.0) * u * u - F.lit(2.0) * u * u * u
        prior = F.when(F.col(idx_col) < F.col("n") - 1, cdf((k + 1) / n1) - cdf(k / n1)).otherwise(F.lit(0.0))
    s = s.withColumn("prior", prior)
    is_bin = F.col(idx_col) < F.col("n") - 1
    s = s.withColumn("lp", F.when(is_bin, F.ln("prior") + F.col("lse_l") + F.col("lse_r")))
    s = (s.withColumn("e0", F.max(F.when(~is_bin, F.col("lse_l"))).over(wk))
          .withColumn("lpmax", F.max("lp").over(wk)))
    s = s.withColumn("e1", F.col("lpmax") + F.ln(F.sum(F.exp(F.col("lp") - F.col("lpmax"))).over(wk)))
    s = s.withColumn("post", F.when(is_bin, F.exp(F.col("lp") - F.col("e1"))).otherwise(F.lit(0.0)))
    if model == "always":
        conf = F.lit(1.0)
    else:
        lp1 = math.log(cp_alpha / (cp_alpha + cp_beta))
        lp0 = math.log(cp_beta / (cp_alpha + cp_beta))
        conf = F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(lp0) + F.col("e0") - F.lit(lp1) - F.col("e1")))
    s = s.withColumn("confidence", conf)
    s = s.withColumn("hist", F.col("confidence") * F.col("post")
                     + (F.lit(1.0) - F.col("confidence")) * F.col("prior"))

    out = s.groupBy(key).agg(
        F.first("confidence").alias("confidence"),
        F.sum(F.col("post") * F.col("mu_l")).alias("mu_1"),
        F.sum(F.col("post") * F.col("mu_r")).alias("mu_2"),
        F.max_by(F.col(date_col), F.struct(F.round("hist", 9), -F.col(idx_col))).alias("tau_map"),
        F.sum(F.col("hist") * k).alias("_t1"),
        F.sum(F.col("hist") * k * k).alias("_t2"),
        F.sum(entropy_term(F.col("hist"))).alias("entropy"),
    )
    # every word keeps a row; unfit series (n < 3, no Beta moments) get nulls
    keys = series.groupBy(key).agg(F.count(F.lit(1)).cast("bigint").alias("n_dates"))
    out = keys.join(out, key, "left")
    return out.select(
        key, "n_dates", "confidence", "mu_1", "mu_2",
        (F.col("mu_2") - F.col("mu_1")).alias("mu_diff"),
        "tau_map",
        F.when(F.col("_t2").isNotNull(), F.sqrt(F.greatest(F.col("_t2") - F.col("_t1") * F.col("_t1"), F.lit(0.0)))).alias("tau_std"),
        "entropy",
    )


def community_change_points(series: DataFrame, community: str = "subreddit", **settings) -> DataFrame:
    """C01 for every (community, word) apart, with ``mu_ratio`` = mu_2 / mu_1
    (C06) and the rank of the word's tau entropy in its community (sharpest
    change first; words without a fit come last)."""
    cp = change_points(series.withColumn("_key", F.struct(community, "word")), key="_key", **settings)
    cp = cp.select(F.col(f"_key.{community}").alias(community), F.col("_key.word").alias("word"), *[c for c in cp.columns if c != "_key"],
                   F.try_divide("mu_2", "mu_1").alias("mu_ratio"))
    # a community's words: the union of its daily top lists, not its posts
    rank = F.row_number().over(Window.partitionBy(community).orderBy(F.round("entropy", 6).asc_nulls_last(), "word"))
    return cp.withColumn("entropy_rank", rank)


def report(cp: DataFrame, min_confidence: float = 1.0, min_abs_diff: float = 0.03) -> DataFrame:
    """Keep confident, large shifts; sort by ``mu_diff`` descending."""
    return (cp.filter((F.col("confidence") >= min_confidence) & (F.abs("mu_diff") > min_abs_diff))
              .orderBy(F.col("mu_diff").desc(), F.col(cp.columns[0])))


def truncate2(c) -> Column:
    """Truncate toward zero to 2 decimals (floor for positives, ceil for negatives)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c >= 0, F.floor(c * 100) / 100).otherwise(F.ceil(c * 100) / 100)
