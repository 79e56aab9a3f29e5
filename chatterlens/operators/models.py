"""Popularity models and their evaluation with spark.ml.

Features are columns computed by Spark (time slots, pooled title vectors,
author statistics, tf-idf); models are spark.ml estimators inside a
``Pipeline`` fitted on the training split only.  Splits
are deterministic hashes of the post id, so they are stable across
partitionings and re-runs.  Metrics are DataFrame aggregates.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import (IDF, CountVectorizer, ElementwiseProduct, Normalizer, OneHotEncoder,
                                RegexTokenizer, VectorAssembler)
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timeparts import day_of_year0, utc_ts, weekday_mon0
from .ordering import sorted_copy, sum_before
from .orderstat import quantile

# --- fixed values: categorical slot sizes of the time inputs ------------------
SLOT_SIZES = {"minute": 60, "hour": 24, "weekday": 7, "doy": 366}
# ------------------------------------------------------------------------------


def hash_bucket(col: str = "id", seed: int = 42, buckets: int = 1000):
    """Deterministic per-row bucket in [0, buckets)."""
    return F.pmod(F.xxhash64(F.col(col), F.lit(seed)), F.lit(buckets))


def split(df: DataFrame, fractions=(0.8, 0.2), col: str = "id", seed: int = 42):
    """Deterministic hash split into consecutive fractions."""
    b = hash_bucket(col, seed)
    out, lo = [], 0.0
    for f in fractions:
        hi = lo + f
        out.append(df.filter((b >= int(round(lo * 1000))) & (b < int(round(hi * 1000)))))
        lo = hi
    return out


def seeded_shuffle(df: DataFrame, col: str = "id", seed: int = 42) -> DataFrame:
    """A reproducible full shuffle (order by a seeded hash)."""
    return df.orderBy(F.xxhash64(F.col(col), F.lit(seed)), col)


def fold_column(df: DataFrame, k: int = 5, col: str = "id", seed: int = 7) -> DataFrame:
    """Fold id by hash, for ``CrossValidator(foldCol=...)``."""
    return df.withColumn("fold", F.pmod(F.xxhash64(F.col(col), F.lit(seed)), F.lit(k)).cast("int"))


def time_features(posts: DataFrame, train: DataFrame | None = None) -> DataFrame:
    """D04-D07 slot columns used as model inputs; years count from the first one
    of ``train`` (all rows where none is given)."""
    ts = utc_ts("created_utc")
    miny = (posts if train is None else train).agg(F.min(F.year(utc_ts("created_utc")))).scalar()
    return posts.select("*", F.minute(ts).alias("minute"), F.hour(ts).alias("hour"),
                        weekday_mon0(ts).alias("weekday"), day_of_year0(ts).alias("doy"),
                        (F.year(ts) - miny).cast("double").alias("year"))


def median_label(df: DataFrame, value_col: str = "ups", rule: str = "median", threshold: float | None = None,
                 train: DataFrame | None = None):
    """label = value > median of ``train`` (all rows where none is
    given; exact, by distributed selection), or > threshold for ``rule="threshold"``."""
    thr = quantile(df if train is None else train, value_col) if rule == "median" else F.lit(float(threshold))
    return df.withColumn("label", (F.col(value_col) > thr).cast("double"))


def cumulative_before(df: DataFrame, order_col: str, value_col: str, out_col: str) -> DataFrame:
    """Sum of ``value_col`` over all rows with a smaller ``order_col`` (rows
    distinct on ``order_col``), as a distributed prefix sum: a stored
    range-partitioned sort, one total per partition, prefix offsets of those
    totals (one row per partition, broadcast) plus a running sum inside each
    partition.  No single-partition window over the rows."""
    s = sorted_copy(df, [order_col])
    offs = sum_before(s.groupBy("_pid").agg(F.sum(value_col).alias("_ps")), "_ps", "_off")
    w = Window.partitionBy("_pid").orderBy("_rn").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("_in", F.coalesce(F.sum(value_col).over(w), F.lit(0)))
    return s.join(F.broadcast(offs), "_pid").withColumn(out_col, F.col("_off") + F.col("_in")) \
        .drop("_pid", "_rn", "_off", "_in")


def percent_rank_label(df: DataFrame, score_col: str, cut: float = 0.5) -> DataFrame:
    """``percent_rank() over (order by score) >= cut`` without a global
    single-partition window: a row's rank depends only on how many scores are
    strictly smaller, so count per distinct score, prefix-sum those counts
    (:func:`cumulative_before`) and join back on the score."""
    n = df.agg(F.count(F.lit(1))).scalar()
    cnt = df.groupBy(score_col).agg(F.count(F.lit(1)).alias("_c"))
    below = cumulative_before(cnt, score_col, "_c", "_below")
    pr = F.when(n > 1, F.col("_below") / (n - 1)).otherwise(F.lit(0.0))
    below = below.select(score_col, pr.alias("percent_rank"))
    return df.join(below, score_col).withColumn("label", (F.col("percent_rank") >= cut).cast("int"))


def one_hot_slots(cols=("minute", "hour", "weekday", "doy")):
    """Fixed-size one-hot encoders (sizes from ``SLOT_SIZES``)."""
    return OneHotEncoder(inputCols=list(cols), outputCols=[f"{c}_oh" for c in cols], dropLast=False,
                         handleInvalid="keep")


def fit_classifier(train: DataFrame, vec_col: str = "pooled_v", hidden: int = 256, max_iter: int = 30,
                   seed: int = 42):
    """Pooled title vector + one-hot time slots + year -> MLP(d, hidden, 2),
    fitted on ``train``; the input width is read off the fitted feature stage."""
    from pyspark.ml import PipelineModel
    oh = one_hot_slots()
    asm = VectorAssembler(inputCols=[vec_col, "minute_oh", "hour_oh", "weekday_oh", "doy_oh", "year"],
                          outputCol="features")
    prep = Pipeline(stages=[oh, asm]).fit(train)
    feats = prep.transform(train)
    size = feats.select("features").first()[0].size
    mlp = MultilayerPerceptronClassifier(layers=[size, hidden, 2], maxIter=max_iter, seed=seed,
                                         featuresCol="features", labelCol="label").fit(feats)
    return PipelineModel(stages=list(prep.stages) + [mlp])


def accuracy(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return pred.agg(F.avg((F.col(label) == F.col(prediction)).cast("double")).alias("accuracy"))


def binary_metrics(df: DataFrame, label: str = "label", score: str = "score", threshold: float = 0.5):
    """Accuracy, balanced accuracy, ROC AUC (ties averaged), MSE of the
    score and R2 of the score against the label.  The AUC sums over distinct
    score values: ``sum_pos (neg_below + neg_equal / 2) / (P * N)``."""
    y, s = F.col(label).cast("double"), F.col(score).cast("double")
    pred = (s > threshold).cast("double")
    base = df.agg(
        F.avg((pred == y).cast("double")).alias("accuracy"),
        (F.sum(pred * y) / F.sum(y)).alias("tpr"),
        (F.sum((F.lit(1.0) - pred) * (F.lit(1.0) - y)) / F.sum(F.lit(1.0) - y)).alias("tnr"),
        F.avg((s - y) * (s - y)).alias("mse"),
        F.var_pop(y).alias("var_y"))
    per = df.groupBy(s.alias("s")).agg(F.sum(y).alias("pos"), F.sum(F.lit(1.0) - y).alias("neg"))
    per = cumulative_before(per, "s", "neg", "neg_below")
    auc = per.agg((F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2))
                   / (F.sum("pos") * F.sum("neg"))).alias("auc"))
    return base.select("accuracy", ((F.col("tpr") + F.col("tnr")) / 2).alias("balanced_accuracy"),
                       auc.select("auc").scalar().alias("auc"),
                       "mse", (F.lit(1.0) - F.col("mse") / F.col("var_y")).alias("r2"))


def fit_tfidf(train: DataFrame, text_col: str, vocab_size: int | None = None):
    """E07/E08 fitted on the training rows: 2+ character lower-cased tokens,
    term counts over the whole vocabulary (unless ``vocab_size`` is given), smooth idf ``ln((1+n)/(1+df)) + 1`` (Spark's IDF is the
    same without the ``+1``, so the fitted idf vector is shifted by one and
    applied as an elementwise product), then L2 normalisation."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.linalg import Vectors
    tok = RegexTokenizer(inputCol=text_col, outputCol="_w", pattern=r"[\p{L}\p{N}_]{2,}", gaps=False,
                         toLowercase=True)
    words = tok.transform(train)
    if vocab_size is None:
        vocab_size = max(1, words.select(F.explode("_w").alias("w")).distinct().count())
    cvm = CountVectorizer(inputCol="_w", outputCol="_tf", vocabSize=vocab_size).fit(words)
    idfm = IDF(inputCol="_tf", outputCol="_idf").fit(cvm.transform(words))
    scale = Vectors.dense([v + 1.0 for v in idfm.idf.toArray()])
    ep = ElementwiseProduct(scalingVec=scale, inputCol="_tf", outputCol="_tfidf")
    return PipelineModel(stages=[tok, cvm, ep, Normalizer(inputCol="_tfidf", outputCol="features", p=2.0)])

