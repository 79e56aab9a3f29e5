"""Catalog: scoring with a fitted model, rankings, samples and sinks."""

from __future__ import annotations

from pyspark.ml.feature import PCA, Word2Vec, Word2VecModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from ..functions.timeparts import day_of_year0, weekday_mon0
from ..operators import models as MD
from ..operators import terms
from ..operators import vectors as V
from ..operators.listing import community_listings
from ..operators.ordering import sorted_copy, sum_before
from ..session import scratch_path, stored
from ..sources.fixtures import posts_view
from ..sources.readers import write_partitioned
from .common import POSTS_CTE, Query, finalize, token_ctes, wrap_sql
from .q_models import MAXLEN, PARTS, _fit_eval

TOP_AUTHORS, TOP_WORDS, SAMPLE = 10, 200, 20


def _success(model, rows):
    return model.transform(rows).withColumn("p_success", vector_to_array("probability")[1])


def q_title_scores(spark, sf):
    """Every stored title at one fixed time (Monday noon, day 150)."""
    model, f, _ = _fit_eval(spark, sf)
    at = f.select("id", "pooled_v", "year", F.lit(0).alias("minute"), F.lit(12).alias("hour"), F.lit(0).alias("weekday"),
                  F.lit(150).alias("doy"))
    return finalize(_success(model, at).select("id", "p_success"))


def q_date_scores(spark, sf):
    """The most upvoted title at noon of every corpus date."""
    model, f, _ = _fit_eval(spark, sf)
    first_year = MD.split(f, PARTS)[0].agg(F.min(F.year(F.timestamp_seconds("created_utc")))).scalar()
    one = f.orderBy(F.col("ups").desc(), "id").limit(1).select("pooled_v")
    days = f.select(F.to_date(F.timestamp_seconds("created_utc")).alias("date")).distinct()
    noon = F.col("date").cast("timestamp")
    grid = days.select("date", F.lit(0).alias("minute"), F.lit(12).alias("hour"), weekday_mon0(noon).alias("weekday"),
                       day_of_year0(noon).alias("doy"), (F.year(noon) - first_year).cast("double").alias("year"), F.lit(1).alias("_k"))
    cand = grid.join(F.broadcast(one.withColumn("_k", F.lit(1))), "_k")  # one row
    return finalize(_success(model, cand).select("date", "p_success"))


def q_word_effect(spark, sf):
    """Each of the most frequent words as a title of its own at a fixed
    time, with the lowest score of any stored title beside it."""
    model, f, _ = _fit_eval(spark, sf)
    tok = terms.with_tokens(posts_view(spark, sf), "title", "tokens", stop_words=[])
    vocab = V.frequency_vocabulary(tok, TOP_WORDS)
    rows = V.embedding_matrix(vocab, V.rule_vectors(tok, min_len=4), V.VEC_DIM).filter("word IS NOT NULL")
    fixed = [F.lit(0).alias("minute"), F.lit(12).alias("hour"), F.lit(0).alias("weekday"), F.lit(150).alias("doy"), F.lit(0.0).alias("year")]
    words = rows.select("word", array_to_vector(F.transform("vector", lambda x: x / MAXLEN)).alias("pooled_v"), *fixed)
    least = _success(model, f.select("pooled_v", *fixed)).agg(F.min("p_success")).scalar()
    return finalize(_success(model, words).select("word", "p_success", least.alias("least_title")))


def q_joint_model(spark, sf):
    """Author statistics, time and concept counts in one pipeline fitted on
    the training split; balanced accuracy and error on the test split."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    from ..operators import authors as au
    p = terms.with_tokens(MD.time_features(posts_view(spark, sf)), "title", "tokens")
    p = stored(p.select("id", "author", "ups", "hour", "weekday", "doy", "year", "tokens",
                        (F.col("ups") > 50).cast("double").alias("label")), "post-features")
    train, test = MD.split(p, (0.75, 0.25))
    stages = [au.AuthorInfluence("mean", outputCol="auth_mean"),
              V.ConceptCluster(cols=("tokens",), rough_size=200, size=16, min_count=3, epochs=1)]
    first = Pipeline(stages=stages).fit(train)
    tr, te = (stored(first.transform(x).drop("tokens"), name) for x, name in ((train, "train"), (test, "test")))
    concepts = [c for c in tr.columns if c.startswith("tokens_cluster_")]
    model = Pipeline(stages=[VectorAssembler(inputCols=["auth_mean", "hour", "weekday", "doy", "year", *concepts], outputCol="features"),
                             LogisticRegression(maxIter=30, regParam=0.01)]).fit(tr)
    scored = stored(model.transform(te).select("label", vector_to_array("probability")[1].alias("score")), "scores")
    return finalize(MD.binary_metrics(scored, "label", "score", 0.5))


def q_classifier_variants(spark, sf):
    """The text inputs and label rules that the two other classifier
    queries do not fit."""
    out = None
    for text, rule, threshold in ((("title", "selftext"), "median", None), (("title",), "threshold", 250)):
        row = _fit_eval(spark, sf, text_cols=text, rule=rule, threshold=threshold)[2]
        row = row.select(F.lit("+".join(text)).alias("text"), F.lit(rule if threshold is None else f"ups > {threshold}").alias("label"), "*")
        out = row if out is None else out.unionByName(row)
    return finalize(out)


def q_roc_curve(spark, sf):
    """True and false positive rate at each different score."""
    p = MD.median_label(posts_view(spark, sf))
    per = p.groupBy(F.col("upvote_ratio").alias("score")).agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"))
    below = MD.cumulative_before(MD.cumulative_before(per, "score", "pos", "pos_below"), "score", "neg", "neg_below")
    total = per.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    tp, fp = total.select("p").scalar(), total.select("n").scalar()
    return finalize(below.select("score", (1 - F.col("pos_below") / tp).alias("tpr"), (1 - F.col("neg_below") / fp).alias("fpr")))


def q_linear_fit(spark, sf):
    """Ups ~ num_comments on posts of odd numbers, R2 there and on the rest."""
    p = posts_view(spark, sf).select(F.col("ups").cast("double").alias("y"), F.col("num_comments").cast("double").alias("x"),
                                     (F.substring("id", 2, 20).cast("bigint") % 2 == 1).alias("train"))
    fit = p.filter("train").agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"))
    a, b = fit.select("slope").scalar(), fit.select("intercept").scalar()
    err = p.withColumn("e", F.col("y") - (a * F.col("x") + b))
    r2 = err.groupBy("train").agg((1 - F.sum(F.col("e") * F.col("e")) / (F.var_pop("y") * F.count("y"))).alias("r2"))
    return finalize(r2.select("train", "r2", a.alias("slope"), b.alias("intercept")))


def q_author_rankings(spark, sf):
    """The first authors by sum, mean and median of the votes."""
    p = posts_view(spark, sf).groupBy("author").agg(F.sum("ups").cast("double").alias("sum"), F.avg("ups").alias("mean"),
                                                    F.median("ups").cast("double").alias("median"))
    out = None
    for by in ("sum", "mean", "median"):
        top = p.orderBy(F.col(by).desc(), "author").limit(TOP_AUTHORS).select(F.lit(by).alias("by"), "author", F.col(by).alias("value"))
        out = top if out is None else out.unionByName(top)
    return finalize(out)


def q_community_samples(spark, sf):
    """Top, new and controversial posts (vote ratio nearest one half)."""
    p = posts_view(spark, sf).select("id", "ups", "upvote_ratio", "created_utc")
    orders = {"top": [F.col("ups").desc()], "new": [F.col("created_utc").desc()], "controversial": [F.abs(F.col("upvote_ratio") - 0.5), F.col("ups").desc()]}
    out = None
    for kind, order in orders.items():
        part = p.orderBy(*order, "id").limit(SAMPLE).select(F.lit(kind).alias("kind"), "id")
        out = part if out is None else out.unionByName(part)
    return finalize(out)


def q_community_listings(spark, sf):
    """Top, new, controversial, rising and random posts of every community."""
    return finalize(community_listings(posts_view(spark, sf), SAMPLE, seed=7))


def q_seeded_shuffle(spark, sf):
    """A seeded order of all posts, each with its place, without one task."""
    p = posts_view(spark, sf).select("id", F.md5(F.concat(F.lit("7:"), F.col("id"))).alias("h"))
    s = sorted_copy(p, ["h", "id"])
    # one row for each partition of the stored copy
    offsets = sum_before(s.groupBy("_pid").agg(F.count(F.lit(1)).alias("n")), "n", "before")
    return finalize(s.join(F.broadcast(offsets), "_pid").select("id", (F.col("before") + F.col("_rn") - 1).alias("place")))


def q_related_words(spark, sf):
    """The words of the cluster of 'thing' and, per post, whether any of
    its words lies in each cluster."""
    tok = terms.with_tokens(posts_view(spark, sf))
    clusters = V.rule_clusters(V.vocabulary_words(tok))
    w = tok.select("id", F.explode(F.array_distinct(F.flatten("tokens"))).alias("word")).join(clusters, "word")
    flags = w.groupBy("id").agg(*[F.max((F.col("cluster") == i).cast("int")).alias(f"concept_{i}") for i in range(5)])
    return finalize(tok.select("id").join(flags, "id", "left").fillna(0))


def q_cluster_words(spark, sf):
    """The words of the cluster of 'thing'; none where no title holds it."""
    clusters = V.rule_clusters(V.vocabulary_words(terms.with_tokens(posts_view(spark, sf))))
    own = clusters.where(F.col("word") == "thing").select("cluster")
    return finalize(clusters.join(own, "cluster", "left_semi").select("word"))


def q_word_coordinates(spark, sf):
    """Two principal coordinates of each vector (sign fixed by the largest)."""
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    pcs = PCA(k=2, inputCol="v", outputCol="p").fit(e).transform(e).select("vec_id", vector_to_array("p").alias("p"))
    return finalize(pcs.select("vec_id", F.col("p")[0].alias("x"), F.col("p")[1].alias("y")))


def q_saved_word_vectors(spark, sf):
    """A word-vector model saved and loaded again gives the same vectors."""
    tok = terms.with_tokens(posts_view(spark, sf)).select(F.explode("tokens").alias("sentence"))
    model = Word2Vec(vectorSize=8, minCount=5, maxIter=1, seed=3, numPartitions=8, inputCol="sentence", outputCol="v").fit(tok)
    path = scratch_path(spark, "word2vec")
    model.write().save(path)
    again = Word2VecModel.load(path).getVectors().withColumnRenamed("vector", "loaded")
    both = model.getVectors().join(again, "word", "full")
    return finalize(both.select("word", (F.col("vector") == F.col("loaded")).cast("int").alias("same")))


def q_written_results(spark, sf):
    """The cleaned table written by community and date and a result
    table written as CSV, both read back."""
    p = posts_view(spark, sf).withColumn("date", F.to_date(F.timestamp_seconds("created_utc")))
    path = scratch_path(spark, "cleaned")
    write_partitioned(p.select("id", "subreddit", "date", "ups"), path, ["subreddit", "date"], "id")
    table = spark.read.parquet(path).groupBy("subreddit").agg(F.count(F.lit(1)).alias("posts"), F.sum("ups").alias("ups"))
    out = scratch_path(spark, "results")
    table.write.option("header", True).csv(out)
    return finalize(spark.read.schema("subreddit string, posts long, ups long").option("header", True).csv(out))


W = f"WITH {POSTS_CTE}"
SQL = {
    "roc_curve": wrap_sql(f"""{W}, m AS (SELECT median(ups) AS med FROM posts),
l AS (SELECT CAST(ups > med AS DOUBLE) AS y, upvote_ratio AS s FROM posts, m),
per AS (SELECT s, sum(y) AS pos, sum(1 - y) AS neg FROM l GROUP BY s)
SELECT s AS score, 1 - coalesce(sum(pos) OVER w, 0) / (SELECT sum(pos) FROM per) AS tpr,
  1 - coalesce(sum(neg) OVER w, 0) / (SELECT sum(neg) FROM per) AS fpr
FROM per WINDOW w AS (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""", doubles=("score", "tpr", "fpr")),
    "linear_fit": wrap_sql(f"""{W},
p AS (SELECT CAST(ups AS DOUBLE) AS y, CAST(num_comments AS DOUBLE) AS x, CAST(substr(id, 2) AS BIGINT) % 2 = 1 AS train FROM posts),
f AS (SELECT regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept FROM p WHERE train)
SELECT train, 1 - sum((y - (slope * x + intercept)) ^ 2) / (var_pop(y) * count(y)) AS r2, any_value(slope) AS slope,
  any_value(intercept) AS intercept FROM p, f GROUP BY train""", doubles=("r2", "slope", "intercept")),
    "author_rankings": wrap_sql(f"""{W},
a AS (SELECT author, CAST(sum(ups) AS DOUBLE) AS s, avg(ups) AS m, CAST(median(ups) AS DOUBLE) AS d FROM posts GROUP BY author)
(SELECT 'sum' AS "by", author, s AS value FROM a ORDER BY s DESC, author LIMIT {TOP_AUTHORS}) UNION ALL
(SELECT 'mean', author, m FROM a ORDER BY m DESC, author LIMIT {TOP_AUTHORS}) UNION ALL
(SELECT 'median', author, d FROM a ORDER BY d DESC, author LIMIT {TOP_AUTHORS})""", doubles=("value",)),
    "community_samples": f"""{W}
(SELECT 'top' AS kind, id FROM posts ORDER BY ups DESC, id LIMIT {SAMPLE}) UNION ALL
(SELECT 'new', id FROM posts ORDER BY created_utc DESC, id LIMIT {SAMPLE}) UNION ALL
(SELECT 'controversial', id FROM posts ORDER BY abs(upvote_ratio - 0.5), ups DESC, id LIMIT {SAMPLE})""",
    "community_listings": f"""{W},
o AS (SELECT *, max(created_utc) OVER (PARTITION BY subreddit) AS latest FROM posts),
k AS (SELECT subreddit, id, unnest([
  {{'kind': 'top', 'a': CAST(ups AS DOUBLE), 'b': 0.0::DOUBLE}}, {{'kind': 'new', 'a': CAST(created_utc AS DOUBLE), 'b': 0.0::DOUBLE}},
  {{'kind': 'controversial', 'a': -abs(upvote_ratio - 0.5), 'b': CAST(ups AS DOUBLE)}},
  {{'kind': 'rising', 'a': CAST(ups AS DOUBLE) / ((latest - created_utc) / 3600.0::DOUBLE + 2.0::DOUBLE), 'b': 0.0::DOUBLE}},
  {{'kind': 'random', 'a': CAST(CAST('0x' || substr(md5(id || '-7'), 1, 15) AS BIGINT) AS DOUBLE), 'b': 0.0::DOUBLE}}]) AS o FROM o)
SELECT subreddit, o.kind AS kind, row_number() OVER (PARTITION BY subreddit, o.kind ORDER BY o.a DESC NULLS LAST, o.b DESC NULLS LAST, id) AS place, id
FROM k QUALIFY place <= {SAMPLE}""",
    "seeded_shuffle": f"{W} SELECT id, row_number() OVER (ORDER BY md5('7:' || id), id) - 1 AS place FROM posts",
    "cluster_words": f"""{W}, {token_ctes()},
vocab AS (SELECT DISTINCT word FROM words)
SELECT word FROM vocab WHERE ascii(word) % 5 IN (SELECT ascii(word) % 5 FROM vocab WHERE word = 'thing')""",
    "related_words": f"""{W}, {token_ctes()},
c AS (SELECT DISTINCT id, ascii(word) % 5 AS k FROM words)
SELECT p.id, {', '.join(f'CAST(coalesce(max(CASE WHEN k = {i} THEN 1 ELSE 0 END), 0) AS BIGINT) AS concept_{i}' for i in range(5))}
FROM posts p LEFT JOIN c ON c.id = p.id GROUP BY p.id""",
    "written_results": f"{W} SELECT subreddit, count(*) AS posts, CAST(sum(ups) AS BIGINT) AS ups FROM posts GROUP BY subreddit",
}

_ids = {
    "title_scores": ("R04",), "date_scores": ("R05", "J12"), "word_effect": ("R07",), "joint_model": ("R18", "E16", "E17"),
    "classifier_variants": ("R02", "R19"), "roc_curve": ("R17",), "linear_fit": ("R11",), "author_rankings": ("L05",),
    "community_samples": ("L11",), "community_listings": ("L11",), "seeded_shuffle": ("L09",), "related_words": ("K04", "K05"), "cluster_words": ("K04",), "word_coordinates": ("E14",),
    "saved_word_vectors": ("S11",), "written_results": ("S05", "S09"),
}

QUERIES = [Query(n, globals()[f"q_{n}"], SQL.get(n), _ids[n]) for n in _ids]
