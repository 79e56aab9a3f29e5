"""Catalog: remaining inventory items (document-frequency filter, repeated
sample means, zero-filled outer join, prediction join-back, model
persistence, emoji and hashed token encodings)."""

from __future__ import annotations

import unicodedata

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import hashed_word_ids
from ..operators import terms
from ..operators import models as MD
from ..session import scratch_path, stored
from ..sources.fixtures import posts_view, table
from .common import POSTS_CTE, Query, finalize, token_ctes, wrap_sql

NO_BELOW, NO_ABOVE, KEEP_N = 10, 0.5, 100000


def q_doc_frequency_filter(spark, sf):
    """Words kept by a document-frequency filter where a document is a
    sentence: at least NO_BELOW sentences, at most NO_ABOVE of them, the
    KEEP_N most frequent."""
    tok = terms.with_tokens(posts_view(spark, sf), "title", "tokens", stop_words=[])
    s = tok.select("id", F.posexplode("tokens").alias("s", "sent"))
    n_sent = s.agg(F.count(F.lit(1))).scalar()
    w = s.select("id", "s", F.explode(F.array_distinct("sent")).alias("word"))
    df_ = w.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    kept = df_.filter((F.col("df") >= NO_BELOW) & (F.col("df") <= F.lit(NO_ABOVE) * n_sent))
    return finalize(kept.orderBy(F.col("df").desc(), "word").limit(KEEP_N))


def q_repeated_sample_mean(spark, sf, num_samples: int = 20, sample_size: int = 50, seed: int = 11):
    """``num_samples`` means of ``sample_size`` posts drawn without
    replacement: in each replicate the posts of the least seeded hashes, found by a
    top-k that holds ``sample_size`` rows a task."""
    p = stored(posts_view(spark, sf).select("id", "ups"), "votes")
    top = None
    for rep in range(num_samples):
        drawn = p.select("id", "ups", F.lit(rep).alias("rep"), F.xxhash64("id", F.lit(rep), F.lit(seed)).alias("h")) \
            .orderBy("h", "id").limit(sample_size)
        top = drawn if top is None else top.unionByName(drawn)
    means = top.groupBy("rep").agg(F.avg("ups").alias("sample_mean"), F.count(F.lit(1)).alias("n"))
    return finalize(means.withColumn("mean_of_means", F.avg("sample_mean").over(Window.partitionBy(F.lit(1)))))


def _kw_daily(tok, word):
    return tok.filter(F.array_contains(F.flatten("tokens"), word)).groupBy("date") \
        .agg(F.count(F.lit(1)).alias(f"n_{word}"))


def q_outer_zero_fill(spark, sf):
    """Two keyword series joined on date, full outer, missing -> 0."""
    tok = terms.with_tokens(posts_view(spark, sf))
    j = _kw_daily(tok, "der").join(_kw_daily(tok, "und"), "date", "full_outer").fillna(0)
    return finalize(j)


def q_first_popular_words(spark, sf):
    """The first ``up_to`` popular words under the defined order."""
    tok = terms.with_tokens(posts_view(spark, sf))
    return finalize(terms.popular_words(tok, 2, up_to=5))


def q_author_upvotes_exploded(spark, sf):
    """Every upvote value of the authors whose mean exceeds 60."""
    p = posts_view(spark, sf).filter(F.col("author") != "None")
    m = p.groupBy("author").agg(F.avg("ups").alias("m")).filter(F.col("m") > 60)
    return finalize(p.join(m, "author", "left_semi").select("author", "id", "ups"))


def q_predictions_join(spark, sf):
    """Fit, save and reload a model, score posts and keep them keyed
    by id (predictions carry the key, so no positional join is needed)."""
    p = posts_view(spark, sf).withColumn("label", (F.col("ups") > 50).cast("double"))
    asm = VectorAssembler(inputCols=["num_comments", "upvote_ratio"], outputCol="features")
    d = asm.transform(p)
    train, _ = MD.split(d, (0.7, 0.3))
    m = LogisticRegression(maxIter=20).fit(train)
    path = scratch_path(spark, "lr-model")
    m.write().overwrite().save(path)
    m2 = LogisticRegressionModel.load(path)
    pred = m2.transform(d).select("id", "prediction")
    return finalize(p.select("id", "ups").join(pred, "id"))


def emoji_names(spark):
    """T07 name table built by rule: every named code point of the emoji
    blocks, named ``emoji<lower_snake_name>emoji``.  Bounded (a few thousand
    rows), so it is broadcast."""
    rows = []
    for lo, hi in ((0x1F300, 0x1FAFF), (0x2600, 0x27BF)):
        for cp in range(lo, hi + 1):
            name = unicodedata.name(chr(cp), None)
            if name:
                rows.append((chr(cp), "emoji" + name.lower().replace(" ", "_").replace("-", "_") + "emoji"))
    return spark.createDataFrame(rows, "glyph string, token string")


def q_emoji_tokens(spark, sf):
    """Whitespace tokens that are exactly one emoji become
    ``emoji<name>emoji``; texts are re-assembled in order."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    t = d.select("doc_id", F.posexplode(F.split(F.trim("text"), r"\s+")).alias("pos", "tok"))
    names = F.broadcast(emoji_names(spark))
    j = t.join(names, t.tok == names.glyph, "left").select("doc_id", "pos", F.coalesce("token", "tok").alias("tok"))
    out = j.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "tok"))),
                                                           lambda e: e["tok"]), " ").alias("text"))
    return finalize(out.select("doc_id", F.length("text").alias("n_chars"),
                               F.size(F.split("text", "emoji[a-z_]+emoji")).alias("pieces")))


def q_hashed_ids(spark, sf):
    """Title words as hashed ids in 1..vocab_size-1."""
    tok = terms.with_tokens(posts_view(spark, sf), stop_words=[])
    h = hashed_word_ids(F.flatten("tokens"), 50)
    return finalize(tok.select("id", F.array_join(F.transform(h, lambda x: x.cast("string")), ",").alias("ids")))


SQL = {
    "doc_frequency_filter": f"""WITH {POSTS_CTE}, {token_ctes(stop=False)},
ns AS (SELECT count(*) AS n FROM (SELECT id, sent_no FROM sent)),
d AS (SELECT word, count(DISTINCT (id, sent_no)) AS df FROM words GROUP BY word)
SELECT word, df FROM d, ns WHERE df >= {NO_BELOW} AND df <= {NO_ABOVE} * n ORDER BY df DESC, word LIMIT {KEEP_N}""",
    "outer_zero_fill": f"""WITH {POSTS_CTE}, {token_ctes()},
a AS (SELECT date, count(DISTINCT id) AS n_der FROM words WHERE word = 'der' GROUP BY date),
b AS (SELECT date, count(DISTINCT id) AS n_und FROM words WHERE word = 'und' GROUP BY date)
SELECT CAST(coalesce(a.date, b.date) AS VARCHAR) AS date, coalesce(n_der, 0) AS n_der, coalesce(n_und, 0) AS n_und
FROM a FULL OUTER JOIN b ON a.date = b.date""",
    "first_popular_words": f"""WITH {POSTS_CTE}, {token_ctes()},
counts AS (SELECT date, word, count(*) AS cf FROM words GROUP BY date, word),
r AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY cf DESC, word) AS rk FROM counts),
hot AS (SELECT word, CAST(sum(cf) AS BIGINT) AS cf_top_days FROM r WHERE rk <= 2 GROUP BY word),
tot AS (SELECT word, count(*) AS cf FROM words GROUP BY word)
SELECT h.word, h.cf_top_days FROM hot h JOIN tot t ON t.word = h.word ORDER BY t.cf DESC, h.word LIMIT 5""",
    "author_upvotes_exploded": f"""WITH {POSTS_CTE}, kp AS (SELECT * FROM posts WHERE author <> 'None'),
m AS (SELECT author FROM kp GROUP BY author HAVING avg(ups) > 60)
SELECT author, id, ups FROM kp WHERE author IN (SELECT author FROM m)""",
}

_ids = {"doc_frequency_filter": ("A08",), "repeated_sample_mean": ("A34",), "outer_zero_fill": ("J03",),
        "first_popular_words": ("L04",), "author_upvotes_exploded": ("N03", "A10"),
        "predictions_join": ("J11", "S11"), "emoji_tokens": ("T07",), "hashed_ids": ("T14",)}

QUERIES = [Query(n, globals()[f"q_{n}"], SQL.get(n), _ids[n]) for n in _ids]
