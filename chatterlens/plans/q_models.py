"""Catalog: supervised models, feature stages and evaluation (slice 8)."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, NaiveBayes
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import PolynomialExpansion, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import functions as F

from ..functions.text import concat_text, pad_truncate
from ..operators import authors as au
from ..operators import models as MD
from ..operators import terms
from ..operators import vectors as V
from ..operators.crossval import kfold_naive_bayes
from ..operators.orderstat import exact_split, split_key
from ..session import stored
from ..sources.fixtures import posts_view, table
from .common import POSTS_CTE, Query, finalize, wrap_sql

MAXLEN = 20
PARTS = (0.6, 0.2, 0.2)


def _features(spark, sf, text_cols=("title",), rule="median", threshold=None):
    """Posts with time slots, pooled text vector (E06 over rule vectors) and label;
    the vocabulary, the first year and the median come from the training split.  Every
    pass of the fit and of the scores reads them from one stored table."""
    p = posts_view(spark, sf)
    train = MD.split(p, PARTS)[0]
    if len(text_cols) > 1:
        p = p.withColumn("text", concat_text(*text_cols))
        col = "text"
    else:
        col = text_cols[0]
    tok = stored(terms.with_tokens(p, col, "tokens", stop_words=[]).select("id", "created_utc", "ups", "tokens"), "tokens")
    vocab = stored(V.frequency_vocabulary(MD.split(tok, PARTS)[0], 40000), "vocabulary")
    m = stored(V.embedding_matrix(vocab, V.rule_vectors(tok, min_len=4), V.VEC_DIM), "matrix")
    seq = V.encode_sequences(tok, vocab).withColumn("padded", pad_truncate("seq", MAXLEN))
    pooled = V.pooled_sequence_vectors(seq, m, MAXLEN, V.VEC_DIM)
    f = MD.time_features(tok.drop("tokens").join(pooled, "id"), train)
    f = stored(MD.median_label(f, "ups", rule, threshold, train), "features")
    return f.withColumn("pooled_v", array_to_vector("pooled"))


def _fit_eval(spark, sf, **kw):
    f = _features(spark, sf, **kw)
    train, val, test = MD.split(f, PARTS)
    model = MD.fit_classifier(train, "pooled_v", hidden=64, max_iter=30)
    base = train.agg((F.lit(1.0) - F.avg("label")).alias("b")).select("b").scalar()
    va = MD.accuracy(model.transform(val)).select("accuracy").scalar()
    te = MD.accuracy(model.transform(test)).select("accuracy").scalar()
    return model, f, spark.range(1).select(base.alias("majority_baseline"), va.alias("val_accuracy"),
                                           te.alias("test_accuracy"))


def q_popularity_classifier(spark, sf):
    return finalize(_fit_eval(spark, sf)[2])


def q_classifier_variant(spark, sf):
    """Title + selftext, label ``ups > 1``."""
    return finalize(_fit_eval(spark, sf, text_cols=("title", "selftext"), rule="threshold", threshold=1)[2])


def q_best_slots(spark, sf):
    """Score one stored title at every weekday x hour x minute
    slot; the 20 best.  The slot grid is a fixed 10080-row range table."""
    model, f, _ = _fit_eval(spark, sf)
    one = f.orderBy("id").limit(1).select("id", "pooled_v", "year")
    grid = spark.range(7 * 24 * 60).select(
        (F.col("id") % 60).cast("int").alias("minute"), ((F.col("id") / 60) % 24).cast("int").alias("hour"),
        (F.col("id") / 1440).cast("int").alias("weekday"), F.lit(150).alias("doy"))
    # attach the single chosen title to every slot: an equi-join on a constant
    # key against a one-row table (bounded by construction)
    cand = grid.withColumn("_k", F.lit(1)).join(F.broadcast(one.withColumn("_k", F.lit(1))), "_k").drop("_k")
    scored = model.transform(cand)
    p1 = vector_to_array("probability")[1]
    return finalize(scored.select("weekday", "hour", "minute", p1.alias("p_success"))
                    .orderBy(F.col("p_success").desc(), "weekday", "hour", "minute").limit(20))


def q_tfidf_models(spark, sf):
    """Tf-idf features -> plain linear and lasso regression of the
    votes; naive Bayes and logistic regression of the quality label."""
    posts = posts_view(spark, sf).select("id", F.col("selftext").alias("text"), F.log1p(F.greatest("ups", F.lit(0))).alias("y"))
    train, test = MD.split(posts, (0.75, 0.25))
    tf = MD.fit_tfidf(train, "text")
    # stored, so that no pass of a fit carries the vocabulary and the weights to its tasks again
    tr, te = (stored(tf.transform(x).select("features", "y"), "tfidf") for x in (train, test))
    rows = []
    for name, penalty, share in (("linear_r2", 0.001, 0.0), ("lasso_r2", 0.01, 1.0)):
        fit = LinearRegression(featuresCol="features", labelCol="y", elasticNetParam=share, regParam=penalty, solver="l-bfgs",
                               standardization=False, maxIter=50).fit(tr)
        r2 = RegressionEvaluator(labelCol="y", metricName="r2")
        rows += [(f"{name}_train", r2.evaluate(fit.transform(tr))), (name, r2.evaluate(fit.transform(te)))]
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id") \
        .select(F.col("doc_id").cast("string").alias("id"), "text", F.col("quality").cast("double").alias("label"))
    train, test = MD.split(d, (0.75, 0.25))
    tf = MD.fit_tfidf(train, "text")
    tr, te = (stored(tf.transform(x).select("features", "label"), "tfidf") for x in (train, test))
    acc = MulticlassClassificationEvaluator(labelCol="label", metricName="accuracy")
    nb = NaiveBayes(smoothing=1.0, featuresCol="features", labelCol="label").fit(tr)
    rows.append(("naive_bayes_accuracy", acc.evaluate(nb.transform(te))))
    lr = LogisticRegression(featuresCol="features", labelCol="label", regParam=1.0 / (1.0 * 1000), maxIter=50).fit(tr)
    rows.append(("logistic_accuracy", acc.evaluate(lr.transform(te))))
    return finalize(spark.createDataFrame(rows, "metric string, value double"))


def _all_features(spark, sf):
    p = posts_view(spark, sf)
    p = p.withColumn("time_of_day", F.hour(F.timestamp_seconds("created_utc")).cast("double"))
    p = p.withColumn("label", (F.col("ups") > 50).cast("double")).withColumn("y", F.col("ups").cast("double"))
    return stored(p.select("id", "author", "ups", "upvote_ratio", "num_comments", "time_of_day", "label", "y"), "post-features")


def q_tree_models(spark, sf):
    """Author influence + cubic time of day -> trees,
    logistic, boosted trees with the per-round error curve."""
    p = _all_features(spark, sf)
    train, test = MD.split(p, (0.75, 0.25))
    inf = au.AuthorInfluence("mean", outputCol="auth_mean")
    poly = PolynomialExpansion(degree=3, inputCol="tod_v", outputCol="tod_poly")
    asm0 = VectorAssembler(inputCols=["time_of_day"], outputCol="tod_v")
    asm = VectorAssembler(inputCols=["tod_poly", "auth_mean", "num_comments", "upvote_ratio"], outputCol="features")
    prep = Pipeline(stages=[inf, asm0, poly, asm]).fit(train)
    tr, te = (stored(prep.transform(x).select("features", "label", "y"), name) for x, name in ((train, "train"), (test, "test")))
    acc = MulticlassClassificationEvaluator(labelCol="label", metricName="accuracy")
    rows = [("tree_accuracy", acc.evaluate(DecisionTreeClassifier(maxDepth=3, seed=1).fit(tr).transform(te))),
            ("logistic_accuracy", acc.evaluate(LogisticRegression(maxIter=50).fit(tr).transform(te)))]
    gbt = GBTRegressor(labelCol="y", maxDepth=2, maxIter=10, seed=1).fit(tr)
    errs = gbt.evaluateEachIteration(te, "squared")
    rows += [(f"gbt_test_mse_round_{i}", float(e)) for i, e in enumerate(errs)]
    rf = RandomForestRegressor(labelCol="y", maxDepth=3, numTrees=10, seed=1).fit(tr)
    rows.append(("rf_r2", RegressionEvaluator(labelCol="y", metricName="r2").evaluate(rf.transform(te))))
    return finalize(spark.createDataFrame(rows, "metric string, value double"))


def q_cross_validation(spark, sf):
    """5-fold CV by hashed fold column, scaled logistic regression."""
    p = MD.fold_column(_all_features(spark, sf))
    asm = VectorAssembler(inputCols=["time_of_day", "num_comments", "upvote_ratio"], outputCol="raw")
    sc = StandardScaler(withMean=False, withStd=True, inputCol="raw", outputCol="features")
    lr = LogisticRegression(maxIter=30)
    grid = ParamGridBuilder().addGrid(lr.regParam, [0.0, 0.1]).build()
    cv = CrossValidator(estimator=Pipeline(stages=[asm, sc, lr]), estimatorParamMaps=grid,
                        evaluator=MulticlassClassificationEvaluator(labelCol="label", metricName="accuracy"),
                        foldCol="fold", numFolds=5, collectSubModels=False)
    m = cv.fit(p)
    return finalize(spark.createDataFrame([(str(i), float(v)) for i, v in enumerate(m.avgMetrics)],
                                          "params string, avg_accuracy double"))


def q_kfold_metrics(spark, sf):
    """5 folds of naive Bayes on the words of whole labelled documents, test and train
    scores, fitted from total minus fold."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").filter(F.col("quality").isNotNull())
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    rows = d.select(F.col("doc_id").alias("id"), F.col("quality").alias("label"), words.alias("words"),
                    (split_key("doc_id", 7) % 5).alias("fold"))
    return finalize(kfold_naive_bayes(rows, 5))


def q_embedding_logistic(spark, sf):
    """Logistic regression on stored vectors vs the majority class."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("id"),
                                              array_to_vector(F.col("embedding").cast("array<double>")).alias("features"),
                                              F.col("label").cast("double").alias("label"))
    train, test = MD.split(e, (0.75, 0.25))
    m = LogisticRegression(maxIter=50, regParam=0.01).fit(train)
    acc = MulticlassClassificationEvaluator(labelCol="label", metricName="accuracy").evaluate(m.transform(test))
    maj = train.groupBy("label").count().orderBy(F.col("count").desc(), "label").limit(1).select("label").scalar()
    dummy = test.agg(F.avg((F.col("label") == maj).cast("double"))).scalar()
    return finalize(spark.range(1).select(F.lit(acc).alias("logistic_accuracy"), dummy.alias("dummy_accuracy")))


def q_hash_splits(spark, sf):
    """Deterministic split sizes."""
    p = posts_view(spark, sf)
    parts = MD.split(p, (0.6, 0.2, 0.2))
    out = parts[0].select(F.lit("train").alias("part"), "id").unionByName(
        parts[1].select(F.lit("val").alias("part"), "id")).unionByName(parts[2].select(F.lit("test").alias("part"), "id"))
    return finalize(out.groupBy("part").agg(F.count(F.lit(1)).alias("n")))


def q_exact_split(spark, sf):
    """Every post with its part of a split stratified by community, 3/4 to 1/4; each
    community's quota is met exactly."""
    p = posts_view(spark, sf).select("id", "subreddit")
    return finalize(exact_split(p, ["subreddit"], (0.75, 0.25), seed=7))


def q_binary_metrics(spark, sf):
    """Metrics of a fixed score (upvote ratio) against the median label."""
    p = MD.median_label(posts_view(spark, sf))
    return finalize(MD.binary_metrics(p, "label", "upvote_ratio", 0.75))


def q_percent_rank_label(spark, sf):
    p = posts_view(spark, sf)
    return finalize(MD.percent_rank_label(p, "ups").select("id", "percent_rank", "label"))


def q_dummy_baselines(spark, sf):
    """Majority-class accuracy and mean-regressor MSE."""
    p = MD.median_label(posts_view(spark, sf))
    return finalize(p.agg(F.greatest(F.avg("label"), F.lit(1.0) - F.avg("label")).alias("majority_accuracy"),
                          F.var_pop("ups").alias("mean_regressor_mse")))


W = f"WITH {POSTS_CTE}"
SQL = {
    "kfold_metrics": wrap_sql("""WITH r AS (SELECT row_number() OVER () AS row, quality AS y, text,
  CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || '-7'), 1, 15) AS BIGINT) % 5 AS fold
  FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL),
t AS (SELECT row, y, fold, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM r),
c AS (SELECT row, word, count(*) AS c FROM t GROUP BY ALL),
m AS (SELECT range AS model FROM range(5)),
f AS (SELECT model, word, sum(CAST(y = 1 AS INT)) AS n1, sum(CAST(y = 0 AS INT)) AS n0 FROM t JOIN m ON fold <> model GROUP BY ALL),
z AS (SELECT model, sum(n1) + count(*) AS z1, sum(n0) + count(*) AS z0 FROM f GROUP BY model),
p AS (SELECT model, ln(sum(CAST(y = 1 AS INT)) / sum(CAST(y = 0 AS INT))) AS prior FROM r JOIN m ON fold <> model GROUP BY model),
w AS (SELECT model, word, ln((n1 + 1) / (n0 + 1)) + ln(z0 / z1) AS w FROM f JOIN z USING (model)),
e AS (SELECT model, row, sum(c * w) AS s FROM c JOIN w USING (word) GROUP BY ALL),
x AS (SELECT m.model, CASE WHEN fold = m.model THEN 'test' ELSE 'train' END AS part, y, round(coalesce(s, 0) + prior, 9) AS s
  FROM r, m JOIN p ON p.model = m.model LEFT JOIN e ON e.model = m.model AND e.row = r.row),
k AS (SELECT *, rank() OVER (PARTITION BY model, part ORDER BY s) AS lo, count(*) OVER (PARTITION BY model, part, s) AS ties FROM x)
SELECT model, part, count(*) AS n, avg(CAST((s > 0) = (y = 1) AS DOUBLE)) AS accuracy,
  (avg(CAST(s > 0 AS DOUBLE)) FILTER (y = 1) + avg(CAST(s <= 0 AS DOUBLE)) FILTER (y = 0)) / 2 AS balanced_accuracy,
  (sum(lo + (ties - 1) / 2) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2)
    / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)) AS auc
FROM k GROUP BY model, part""", doubles=("accuracy", "balanced_accuracy", "auc")),
    "exact_split": f"""{W}, o AS (SELECT id, subreddit, count(*) OVER (PARTITION BY subreddit) AS n,
  row_number() OVER (PARTITION BY subreddit ORDER BY CAST('0x' || substr(md5(id || '-7'), 1, 15) AS BIGINT), id) AS nth FROM posts)
SELECT id, subreddit, CAST(nth > floor(n * 0.75 + 0.5) AS BIGINT) AS part FROM o""",
    "binary_metrics": wrap_sql(f"""{W}, m AS (SELECT median(ups) AS med FROM posts),
l AS (SELECT CAST(ups > med AS DOUBLE) AS y, upvote_ratio AS s FROM posts, m),
b AS (SELECT avg(CAST((CAST(s > 0.75 AS DOUBLE)) = y AS DOUBLE)) AS accuracy,
             sum(CAST(s > 0.75 AS DOUBLE) * y) / sum(y) AS tpr,
             sum((1 - CAST(s > 0.75 AS DOUBLE)) * (1 - y)) / sum(1 - y) AS tnr,
             avg((s - y) * (s - y)) AS mse, var_pop(y) AS var_y FROM l),
per AS (SELECT s, sum(y) AS pos, sum(1 - y) AS neg FROM l GROUP BY s),
pc AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM per),
a AS (SELECT sum(pos * (nb + neg / 2)) / (sum(pos) * sum(neg)) AS auc FROM pc)
SELECT accuracy, (tpr + tnr) / 2 AS balanced_accuracy, auc, mse, 1 - mse / var_y AS r2 FROM b, a""",
                               doubles=("accuracy", "balanced_accuracy", "auc", "mse", "r2")),
    "percent_rank_label": wrap_sql(f"""{W}
SELECT id, percent_rank() OVER (ORDER BY ups) AS percent_rank,
       CAST(percent_rank() OVER (ORDER BY ups) >= 0.5 AS BIGINT) AS label FROM posts""",
                                   doubles=("percent_rank",)),
    "dummy_baselines": wrap_sql(f"""{W}, m AS (SELECT median(ups) AS med FROM posts),
l AS (SELECT CAST(ups > med AS DOUBLE) AS label, ups FROM posts, m)
SELECT greatest(avg(label), 1 - avg(label)) AS majority_accuracy, var_pop(ups) AS mean_regressor_mse FROM l""",
                                doubles=("majority_accuracy", "mean_regressor_mse")),
}

_ids = {
    "popularity_classifier": ("R01", "R03", "E06", "E18", "L10", "L12"),
    "classifier_variant": ("R02", "R19", "T09"),
    "best_slots": ("R06", "J12", "L08"),
    "tfidf_models": ("R08", "R09", "R10", "E07", "E08"),
    "tree_models": ("R12", "R13", "R14", "R18", "E10", "E15", "U04"),
    "cross_validation": ("R16", "E09"),
    "embedding_logistic": ("R20", "N05"),
    "hash_splits": ("L09", "L10", "L12"),
    "exact_split": ("L10",), "kfold_metrics": ("R16",),
    "binary_metrics": ("R17",),
    "percent_rank_label": ("W01",),
    "dummy_baselines": ("R15",),
}

QUERIES = [Query(n, globals()[f"q_{n}"], SQL.get(n), _ids[n]) for n in _ids]
