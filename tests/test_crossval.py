"""Folds from total minus fold against separate fits, metrics against pair counts."""
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from chatterlens.operators import crossval as V

KIND = "id string, label int, fold int, words array<string>"


def made(n=160, k=4, rnd=random.Random(3)):
    rows = []
    for i in range(n):
        y = int(rnd.random() < 0.4)
        words = rnd.choices([f"w{j}" for j in range(30)] + ([f"good{j}" for j in range(6)] if y else [f"bad{j}" for j in range(6)]) + ["hot"] * 20, k=rnd.randrange(0, 15))
        rows.append((f"p{i % (n - 3)}", y, i % k, words + ([f"rare{i}"] if i % 9 == 0 else [])))
    return rows


def separate(rows, k, alpha=1.0):
    """Each model fitted on its own training rows alone."""
    out = []
    for j in range(k):
        train = [r for r in rows if r[2] != j]
        count = {c: Counter(w for r in train if r[1] == c for w in r[3]) for c in (0, 1)}
        vocab = set(count[0]) | set(count[1])
        n = {c: sum(count[c].values()) + alpha * len(vocab) for c in (0, 1)}
        docs = Counter(r[1] for r in train)
        for r in rows:
            s = math.log(docs[1] / docs[0])
            s += sum(math.log((count[1][w] + alpha) / n[1]) - math.log((count[0][w] + alpha) / n[0]) for w in r[3] if w in vocab)
            out.append((j, r[2] == j, r[1], round(s, 9)))
    return out


def test_equal_to_separate_fits(spark):
    rows = made()
    got = V.kfold_scores(spark.createDataFrame(rows, KIND).withColumn("word", F.lit(1)), 4).collect()
    mine = sorted((j, r.fold == j, r.label, s) for r in got for j, s in enumerate(r.scores))
    want = sorted(separate(rows, 4))
    assert [m[:3] for m in mine] == [w[:3] for w in want]
    assert [m[3] for m in mine] == pytest.approx([w[3] for w in want], abs=1e-8)


def test_metrics_of_test_and_train(spark):
    rows = made()
    want = separate(rows, 4)
    got = V.kfold_naive_bayes(spark.createDataFrame(rows, KIND), 4).collect()
    assert len(got) == 8
    for r in got:
        part = [(y, s) for j, test, y, s in want if j == r.model and test == (r.part == "test")]
        pos, neg = [s for y, s in part if y], [s for y, s in part if not y]
        assert r.n == len(part)
        assert r.accuracy == pytest.approx((sum(s > 0 for s in pos) + sum(s <= 0 for s in neg)) / len(part))
        assert r.balanced_accuracy == pytest.approx((sum(s > 0 for s in pos) / len(pos) + sum(s <= 0 for s in neg) / len(neg)) / 2)
        assert r.auc == pytest.approx(sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg))


def test_defined_cases(spark):
    rows = [("a", 1, 0, ["x", None]), ("a", 1, 0, ["x"]), ("b", 0, 1, None), ("c", 1, 1, []), (None, None, 1, ["x"]), ("d", 0, None, ["y"]), ("e", 0, 2, ["x"])]
    df = spark.createDataFrame(rows, KIND)
    got = V.kfold_naive_bayes(df, 3).collect()
    assert {(r.model, r.part): r.n for r in got} == {(0, "test"): 2, (0, "train"): 3, (1, "test"): 2, (1, "train"): 3, (2, "test"): 1, (2, "train"): 4}
    assert {r.auc for r in got if (r.model, r.part) in ((0, "test"), (2, "test"))} == {None}
    assert V.kfold_naive_bayes(df.limit(0), 3).count() == 0
    one = [("a", 1, 0, ["x"]), ("b", 1, 1, ["y"]), ("c", 0, 0, ["x"])]
    scores = {r.id: r.scores for r in V.kfold_scores(spark.createDataFrame(one, KIND), 2).collect()}
    assert scores["a"][0] == math.inf and abs(scores["a"][1]) < 1e-9
