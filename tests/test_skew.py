"""AQE splits a hot key's rows in the joins with stored keyed tables: read off
the final plan of the run itself."""
import pytest
from pyspark.sql import functions as F

from chatterlens.operators.authors import AuthorInfluence
from chatterlens.operators.vectors import post_vectors, rule_vectors

CONF = {"spark.sql.shuffle.partitions": "16", "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2"}


@pytest.fixture()
def skewed(spark):
    before = {k: spark.conf.get(k, None) for k in CONF}
    for k, v in CONF.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def final_plan(df):
    run = df._jdf.queryExecution()
    run.toRdd().count()
    return run.executedPlan().toString()  # initial plans, printed beside the final ones, have no splits


def test_hot_author_is_split(skewed):
    posts = skewed.range(0, 400_000, 1, 16).select(
        F.concat(F.lit("p"), F.col("id").cast("string")).alias("id"), (F.col("id") % 100).alias("ups"),
        F.when(F.col("id") % 5 < 2, F.lit("hot")).otherwise(F.concat(F.lit("a"), (F.col("id") % 5000).cast("string"))).alias("author"))
    out = AuthorInfluence("mean").fit(posts).transform(posts)
    assert "skew=true" in final_plan(out.select("id", "author", "auth_aggmean"))


def test_hot_word_is_split(skewed):
    words = F.array(F.lit("common"), F.concat(F.lit("w"), F.regexp_replace((F.col("id") % 3000).cast("string"), "[0-9]", "x")))
    tok = skewed.range(0, 300_000, 1, 16).select(F.col("id").cast("string").alias("id"), F.array(words).alias("tokens"))
    assert "skew=true" in final_plan(post_vectors(tok, rule_vectors(tok), 4))
