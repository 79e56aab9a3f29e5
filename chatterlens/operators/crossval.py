"""k-fold cross validation from one pass of statistics.

Multinomial naive Bayes needs only counts of words per class, and counts add up: they
are taken once for each (fold, class), and the model that is tested on a fold is fitted
on the total minus that fold.  One table holds, for each word, its weight in all k models
as an array, so one join scores every row under every model.  Test and train metrics of
all models come from those scores: accuracy, balanced accuracy and the area under the ROC
curve, ties counted half.

Skew: counts are summed by tasks before the shuffle; a hot word is split by adaptive
execution in the join of two stored tables.  The driver gets 5 k totals.  ``k`` is a small
number, as each word and each row carries k values.

Defined cases: null words and null or empty arrays count as no words, a row of none is
scored by the class shares; words that are not in a model's training part weigh nothing
there; rows with a null label or fold take no part; repeated ids are rows of their own.
A training part without one of the classes predicts the other one; a metric that is not
defined on a part (a class or all rows missing) is null.  An empty table gives no row.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .ordering import sorted_copy, sum_before


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kfold_scores(rows: DataFrame, k: int = 5, alpha: float = 1.0, words: str = "words") -> DataFrame:
    """``(id, label, fold, scores)`` of ``rows(id, label 0 or 1, fold 0 .. k - 1, words)``: the
    log odds of label 1 under each model; model j is fitted without fold j."""
    rows = _stored(rows.select("id", F.col("label").cast("int").alias("label"), F.col("fold").cast("int").alias("fold"), F.col(words).alias("words"))
                   .filter("label IN (0, 1) AND fold >= 0").filter(F.col("fold") < k).withColumn("_row", F.monotonically_increasing_id()), "kfold-rows")
    seen = _stored(rows.select("_row", "label", "fold", F.explode("words").alias("word")).filter(F.col("word").isNotNull())
                   .groupBy("_row", "label", "fold", "word").agg(F.count(F.lit(1)).alias("c")), "kfold-counts")

    def per_fold(label, value):
        return [F.coalesce(F.sum(F.when((F.col("fold") == j) & (F.col("label") == label), value)), F.lit(0)) for j in range(k)]

    counts = seen.groupBy("word").agg(*(F.array(*per_fold(c, F.col("c"))).alias(f"f{c}") for c in (0, 1)))

    def others(folds):
        total = F.aggregate(folds, F.lit(0).cast("long"), lambda sum_, x: sum_ + x)
        return F.transform(folds, lambda n: total - n)

    held = _stored(counts.select("word", *(others(f"f{c}").alias(f"n{c}") for c in (0, 1))), "kfold-words")
    sums = held.agg(*(F.coalesce(F.sum(F.col(f"n{c}")[j]), F.lit(0)) for c in (0, 1) for j in range(k)),
                    *(F.count_if(F.col("n0")[j] + F.col("n1")[j] > 0) for j in range(k))).first()
    docs = rows.agg(*per_fold(0, F.lit(1)), *per_fold(1, F.lit(1))).first()

    weights, priors = [], []
    for j in range(k):
        n0, n1, size = sums[j], sums[k + j], sums[2 * k + j]
        a, b = F.col("n0")[j], F.col("n1")[j]
        # a model without words has no weight to give
        base = math.log((n0 + alpha * size) / (n1 + alpha * size)) if size else 0.0
        weights.append(F.when(a + b > 0, F.ln((b + alpha) / (a + alpha)) + base).otherwise(0.0))
        d0, d1 = sum(docs[:k]) - docs[j], sum(docs[k:]) - docs[k + j]
        priors.append(math.log(d1 / d0) if d0 and d1 else 0.0 if d0 == d1 else math.inf if d1 else -math.inf)
    model = _stored(held.select("word", F.array(*weights).alias("w")), "kfold-model")
    found = seen.select("_row", "word", "c").join(model, "word").groupBy("_row") \
        .agg(F.array(*(F.sum(F.col("c") * F.col("w")[j]) for j in range(k))).alias("s"))
    scores = F.array(*(F.coalesce(F.col("s")[j], F.lit(0.0)) + F.lit(p) for j, p in enumerate(priors)))
    return rows.drop("words").join(found, "_row", "left").select("id", "label", "fold", scores.alias("scores"))


def kfold_metrics(scores: DataFrame) -> DataFrame:
    """``(model, part, n, accuracy, balanced_accuracy, auc)`` of :func:`kfold_scores` for
    ``part`` "test" (the model's fold) and "train" (all others).  Scores that agree to nine
    digits are ties; label 1 is predicted above zero."""
    each = scores.select("label", "fold", F.posexplode("scores").alias("model", "s"))
    each = each.select("model", F.when(F.col("fold") == F.col("model"), "test").otherwise("train").alias("part"),
                       (F.col("label") == 1).cast("long").alias("y"), (F.round("s", 9) + 0.0).alias("s"))
    per = sorted_copy(each.groupBy("model", "part", "s").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg")), ["model", "part", "s"])
    off = sum_before(per.groupBy("_pid").agg(F.sum("neg").alias("t")), "t", "off")
    inside = Window.partitionBy("_pid").orderBy("_rn").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("in", F.coalesce(F.sum("neg").over(inside), F.lit(0))).join(F.broadcast(off), "_pid") \
        .withColumn("below", F.col("off") + F.col("in"))
    up = F.col("s") > 0
    t = per.groupBy("model", "part").agg(
        F.sum("pos").alias("p"), F.sum("neg").alias("q"), F.min("below").alias("first"),
        F.sum(F.when(up, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(up, 0).otherwise(F.col("neg"))).alias("tn"),
        F.sum(F.col("pos").cast("double") * (F.col("below") + F.col("neg") / 2)).alias("u"))
    p, q = F.col("p"), F.col("q")
    return t.select("model", "part", (p + q).alias("n"), ((F.col("tp") + F.col("tn")) / (p + q)).alias("accuracy"),
                    ((F.try_divide("tp", p) + F.try_divide("tn", q)) / 2).alias("balanced_accuracy"),
                    F.try_divide(F.col("u") - F.col("first").cast("double") * p, p.cast("double") * q).alias("auc"))


def kfold_naive_bayes(rows: DataFrame, k: int = 5, alpha: float = 1.0, words: str = "words") -> DataFrame:
    """:func:`kfold_metrics` of :func:`kfold_scores`."""
    return kfold_metrics(kfold_scores(rows, k, alpha, words))
