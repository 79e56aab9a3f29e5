"""Distributed ordering against plain windows, over many range partitions."""
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import Window
from pyspark.sql import functions as F

from chatterlens.operators.clusters import max_clust
from chatterlens.operators.graph import connected_components
from chatterlens.operators.models import binary_metrics, cumulative_before
from chatterlens.operators.similarity import posting_order, sorted_lag
from chatterlens.session import ensure_checkpoint_dir

ROWS = 3_000_000


@pytest.fixture()
def wide(spark):
    """3 million rows with a payload over 64 shuffle partitions; key 0 has 40%."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    h = F.xxhash64("id")
    yield spark.range(ROWS).select(
        "id", F.pmod(h, F.lit(10_000_019)).alias("created_utc"), F.sha2(F.col("id").cast("string"), 256).alias("payload"),
        F.when(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(10)) < 4, 0).otherwise(F.pmod(h, F.lit(3))).cast("long").alias("key"))
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_posting_order_is_gapless(wide):
    got = posting_order(wide).select("pos", "created_utc", "id").cache()
    r = got.agg(F.count(F.lit(1)), F.countDistinct("pos"), F.min("pos"), F.max("pos")).first()
    assert tuple(r) == (ROWS, ROWS, 0, ROWS - 1)
    # neighbours in position are neighbours in order
    nxt = got.select((F.col("pos") - 1).alias("pos"), F.struct("created_utc", "id").alias("n"))
    assert got.join(nxt, "pos").where(F.struct("created_utc", "id") >= F.col("n")).isEmpty()
    got.unpersist()


def test_sorted_lag_matches_window(wide):
    rows = wide.select("id", "created_utc", "key", (F.col("id") * 7).alias("v"))
    w = Window.partitionBy("key").orderBy("created_utc", "id")
    want = rows.select("id", F.lag("v").over(w).alias("prev_value"), F.row_number().over(w).cast("long").alias("position"))
    got = sorted_lag(rows, "key", ["created_utc", "id"], "v").select("id", "prev_value", F.col("position").cast("long"))
    def total(d):
        return d.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("id", "prev_value", "position"))).first()

    assert total(got) == total(want)


def test_auc_matches_the_evaluator(wide):
    s = wide.select((F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1_000_003)) / 1_000_003).alias("score"), "id")
    s = s.withColumn("label", (F.col("score") + F.pmod("id", F.lit(1000)) / 1000 > 1).cast("double")).limit(ROWS)
    auc = binary_metrics(s).first()["auc"]
    best = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label", numBins=0).evaluate(s)
    assert abs(auc - best) < 1e-9


def test_empty_partitions_and_tables(spark):
    few = spark.createDataFrame([(i, 5, 1) for i in range(3)], "id long, created_utc long, key long")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        assert sorted(r.pos for r in posting_order(few).collect()) == [0, 1, 2]
        lag = sorted_lag(few, "key", ["created_utc", "id"], "id").orderBy("id").collect()
        assert [(r.prev_value, r.position) for r in lag] == [(None, 1), (0, 2), (1, 3)]
        below = cumulative_before(spark.createDataFrame([(3, 1), (9, 2), (5, 4)], "s int, n long"), "s", "n", "b")
        assert {r.s: r.b for r in below.collect()} == {3: 0, 5: 1, 9: 5}
        assert posting_order(few.limit(0)).count() == 0
        assert sorted_lag(few.limit(0), "key", ["id"], "id").count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_long_path_converges(spark):
    edges = spark.range(2000).select(F.concat(F.lit("n"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("u"),
                                     F.concat(F.lit("n"), F.lpad((F.col("id") + 1).cast("string"), 6, "0")).alias("v"))
    verts = edges.select(F.col("u").alias("id")).union(edges.select("v")).distinct()
    assert connected_components(verts, edges).select("component").distinct().count() == 1


def test_oversize_clusters_are_split_to_the_end(spark):
    vecs = spark.range(300).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("word"), F.when(
        F.col("id") < 200, F.array(F.lit(1.0), F.lit(1.0))).otherwise(F.array(F.col("id") / 7.0, F.col("id") % 11 * 1.0)).alias("vector"))
    got = max_clust(vecs, k=3, max_cluster_size=20)
    sizes = got.groupBy("cluster").count().collect()
    assert got.count() == 300 and max(r["count"] for r in sizes) <= 20
    assert sorted(r.cluster for r in sizes) == list(range(len(sizes)))


def test_no_machine_local_folder_on_a_cluster(spark, monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://cluster:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        ensure_checkpoint_dir(Session())
