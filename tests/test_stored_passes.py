"""Steps whose work a task or a pass must not repeat or grow: transport of pairs, features, samples, tf-idf."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import __spark_entry__ as E
from chatterlens.operators import clusters, similarity, transport
from chatterlens.operators import vectors as V
from chatterlens.plans import q_models
from chatterlens.sources.fixtures import posts_view

KIND = "id string, tokens array<array<string>>"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d, r = str(tmp_path_factory.mktemp("tables")), random.Random(5)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(80)]
    docs = [(i, "\n".join(" ".join(r.choices(words, k=r.randint(1, 9))) for _ in range(3)), "web") for i in range(120)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{d}/documents.parquet")
    events = [(i, i % 9, "click", float(r.randint(0, 300)), '{"k": 1}') for i in range(130)]
    spark.createDataFrame(events, "event_id long, user_id long, event_type string, value double, props string").write.parquet(f"{d}/events.parquet")
    return d


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_optima_of_a_batch_are_those_of_each_pair():
    r, left, right = np.random.default_rng(1), [], []
    for side in range(150):
        for out in (left, right):
            n = r.integers(1, 9)
            w = r.random(n) + 0.01 if side % 2 else 1 / (np.arange(n) * 0.5 + 1)
            out.append((w / w.sum(), r.integers(0, 4, (n, 3)).astype(float)))
    low, best = transport._distances(left, right, 2.0)
    for k, ((a, x), (b, y)) in enumerate(zip(left, right)):
        c = transport.costs(x, y)
        assert best[k] == pytest.approx(transport.optimum(a, b, c), abs=1e-9)
        assert low[k] == pytest.approx(transport.relaxed(a, b, c), abs=1e-12)


def test_first_known_words_wherever_they_stand(spark):
    far = [["no"] * 40 + ["aa", "bb"], ["cc"] * 3, ["dd"]]
    tok = spark.createDataFrame([("p1", far), ("p2", [["aa", "no", "bb", "cc", "dd"]]), ("p3", [["no"]]), ("p4", [["aa"]]), ("p4", [["bb"] * 9])], KIND)
    vecs = spark.createDataFrame([(w, [float(i), 1.0]) for i, w in enumerate(["aa", "bb", "cc", "dd"])], "word string, vector array<double>")
    want = similarity.clouds(tok, vecs).where("p < 3").select("id", "p", "word")
    got = similarity.clouds(tok, vecs, cut_off=3)
    rows = {(x.id, x.p): x.word for x in got.collect()}
    assert {k: v for k, v in rows.items() if k[0] != "p4"} == {(x.id, x.p): x.word for x in want.collect() if x.id != "p4"}
    assert len([k for k in rows if k[0] == "p4"]) == 3
    assert all(x.s == pytest.approx(1) for x in got.groupBy("id").agg(F.sum("w").alias("s")).collect())


def test_relaxed_transport_makes_no_row_for_two_words(spark):
    r = np.random.default_rng(3)
    clouds = {f"p{i}": (np.full(n, 1 / n), r.integers(0, 9, (n, 2)).astype(float)) for i, n in enumerate((700, 900, 1, 1))}
    cl = spark.createDataFrame([(i, p, "w", [float(z) for z in x], float(w)) for i, (ws, xs) in clouds.items() for p, (w, x) in enumerate(zip(ws, xs))],
                               "id string, p int, word string, vector array<double>, w double")
    pairs = spark.createDataFrame([("p0", "p1"), ("p0", "p1"), ("p1", "p2"), ("p2", "p3"), ("p0", "p0"), ("p0", "p9")], "id_a string, id_b string")
    df = similarity.relaxed_transport(pairs, cl)
    got = {(x.id_a, x.id_b): x.distance for x in df.collect()}
    assert set(got) == {("p0", "p1"), ("p1", "p2"), ("p2", "p3"), ("p0", "p0")} and df.count() == 4
    for (i, k), d in got.items():
        (a, x), (b, y) = clouds[i], clouds[k]
        assert d == pytest.approx(transport.relaxed(a, b, transport.costs(x, y)), abs=1e-9)
    assert "ArrowEvalPython" in plan(df)


def test_blocks_of_a_bound(monkeypatch):
    r = np.random.default_rng(4)
    a, b, x, y = np.full(30, 1 / 30), np.full(20, 1 / 20), r.random((30, 3)), r.random((20, 3))
    monkeypatch.setattr(similarity, "BLOCK", 64)
    assert similarity._bound(a, x, b, y) == pytest.approx(transport.relaxed(a, b, transport.costs(x, y)))


def test_titles_are_cut_before_the_join(spark, tables):
    p = plan(posts_view(spark, tables).select("id", "title"))
    assert p.index("substring_index") > p.index("Join")


def test_model_inputs_are_stored(spark, tables):
    for df in (q_models._features(spark, tables), q_models._all_features(spark, tables)):
        assert df.inputFiles() and all("features" in f for f in df.inputFiles())


def test_affinities_are_stored(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(x):
        seen.add(1)
        return x

    pairs = spark.createDataFrame([(f"p{i}", f"p{i + 1}", float(i % 3)) for i in range(12)], "id_a string, id_b string, distance double")
    pairs = pairs.withColumn("distance", F.udf(counted, "double")("distance"))
    assert clusters.affinity_clusters(pairs, 2).count() == 13
    assert seen.value == 12


def test_samples_by_top_k(spark, tables):
    p = posts_view(spark, tables).select("id", "ups", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("rep"))
    r = p.withColumn("h", F.xxhash64("id", "rep", F.lit(11)))
    top = r.withColumn("rk", F.row_number().over(Window.partitionBy("rep").orderBy("h", "id"))).where("rk <= 50")
    want = {x.rep: x.m for x in top.groupBy("rep").agg(F.avg("ups").alias("m")).collect()}
    df = E.queries()["repeated_sample_mean"](spark, tables)
    assert {x.rep: x.sample_mean for x in df.collect()} == pytest.approx(want, abs=1e-6)
    assert "rep" not in plan(df).split("Window")[-1].split("LocalLimit")[0] or "WindowGroupLimit" not in plan(df)


@pytest.mark.parametrize("hot", [1, 3, 10**9])
def test_tfidf_of_common_and_rare_terms(spark, hot):
    docs = [(1, "aa bb aa cc"), (2, "aa dd"), (3, "aa bb"), (4, None), (None, "aa ee"), (5, "")]
    got = {(x.id, x.term): x.tfidf for x in V.tfidf(spark.createDataFrame(docs, "id long, text string"), "text", "id", hot).collect()}
    df = Counter(w for _, t in docs for w in set((t or "").split()))
    want = {}
    for i, t in docs:
        w = {x: c * (math.log((1 + len(docs)) / (1 + df[x])) + 1) for x, c in Counter((t or "").split()).items()}
        want |= {(i, x): v / math.sqrt(sum(z * z for z in w.values())) for x, v in w.items() if i is not None}
    assert got == pytest.approx(want)


def test_equal_words_meet_their_cluster_once(spark):
    tok = spark.createDataFrame([("p1", [["aa", "bb"], ["aa", "zz", "cc"]]), ("p2", [["cc"] * 3]), ("p3", [[]])], KIND)
    cl = spark.createDataFrame([("aa", 0), ("bb", 1), ("cc", 2)], "word string, cluster int")
    lab = V.cluster_labels(tok, cl)
    assert {x.id: list(x.labels) for x in lab.collect()} == {"p1": [0, 1, 0, 2], "p2": [2, 2, 2]}
    counts = V.concept_counts(tok, cl, ["tokens"], 3)
    assert {tuple(x) for x in counts.collect()} == {("p1", 2, 1, 1), ("p2", 0, 0, 3), ("p3", 0, 0, 0)}
    for df in (lab, counts):  # counted or gathered by post and word below the join
        assert "Aggregate [id" in plan(df) and ", word" in plan(df).split("Join Inner")[1]


def test_sentences_are_stored_for_all_passes_of_word2vec(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(x):
        seen.add(1)
        return x

    tok = spark.createDataFrame([(f"p{i}", [["aa", "bb"], ["cc", "aa"]]) for i in range(12)], KIND)
    _, vecs = V.train_word2vec(tok.withColumn("tokens", F.udf(counted, "array<array<string>>").asNondeterministic()("tokens")), size=3, min_count=1, epochs=2)
    assert {r.word: len(r.vector) for r in vecs.collect()} == {"aa": 3, "bb": 3, "cc": 3}
    assert seen.value == 12
