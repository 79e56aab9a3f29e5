"""Author affinity against a dense computation and planted groups."""
import random

import numpy as np
from pyspark.sql import functions as F

from chatterlens.operators import affinity as A

TOKENS = "author string, tokens array<array<string>>"


def planted(groups=3, authors=12, rnd=random.Random(2)):
    """Authors of a group draw from the group's words; all use the common ones."""
    rows, group = [], {}
    common = [f"common{i}" for i in range(30)]
    for g in range(groups):
        words = [f"g{g}w{i}" for i in range(25)]
        for a in range(authors):
            name = f"a{g}_{a}"
            group[name] = g
            for _ in range(3):
                rows.append((name, [rnd.choices(words, k=6) + rnd.choices(common, k=6), rnd.choices(common, k=5)]))
    return rows, group


def dense(rows):
    by = {}
    for a, sents in rows:
        by.setdefault(a, set()).update(w for s in sents for w in s)
    names = sorted(by)
    words = sorted(set().union(*by.values()))
    m = np.array([[w in by[a] for w in words] for a in names], float)
    df = m.sum(0)
    m = m[:, (df > 1) & (df < len(names))] * np.log(len(names) / df[(df > 1) & (df < len(names))])
    b = m / np.sqrt(np.outer(m.sum(1), m.sum(0)))
    return names, b @ b.T


def test_leading_vectors_are_those_of_the_whole_matrix(spark):
    rows, _ = planted()
    names, m = dense(rows)
    values, vectors = np.linalg.eigh(m)
    block, got = A.leading_vectors(A.author_words(spark.createDataFrame(rows, TOKENS)), 3)
    assert np.allclose(got, values[::-1][:3], atol=1e-3)
    y = {r.author: r.y for r in block.collect()}
    mine = np.array([y[n] for n in names])
    # the same space: its projection keeps the true vectors
    assert np.linalg.norm(mine @ (mine.T @ vectors[:, -3:]) - vectors[:, -3:]) < 0.05


def test_planted_groups_are_found(spark):
    rows, group = planted()
    tok = spark.createDataFrame(rows, TOKENS).withColumn("cluster", F.lit("mine")).withColumn("w", F.lit(1))
    got = {r.author: r.cluster for r in A.author_clusters(tok, 3).collect()}
    assert set(got) == set(group)
    assert len({(group[a], c) for a, c in got.items()}) == 3 == len(set(got.values()))


def test_a_hot_author_and_a_hot_word(spark):
    rows, group = planted()
    rows += [("a0_0", [["common1", "g0w1", "g0w2"]])] * 400 + [(a, [["hot"]]) for a in list(group)[:-1]]
    got = {r.author: r.cluster for r in A.author_clusters(spark.createDataFrame(rows, TOKENS), 3).collect()}
    assert len({(group[a], c) for a, c in got.items()}) == 3


def test_defined_cases(spark):
    odd = [(None, [["x", "y"]]), ("lone", [["only"]]), ("none", None), ("empty", []), ("nulls", [[None, "both"], None]), ("twin", [["both"]])]
    got = {r.author: r.cluster for r in A.author_clusters(spark.createDataFrame(odd, TOKENS), 2).collect()}
    assert set(got) == {"lone", "none", "empty", "nulls", "twin"}
    assert got["lone"] is got["none"] is got["empty"] is None
    assert A.author_clusters(spark.createDataFrame([], TOKENS), 2).count() == 0


def test_no_pair_of_authors_is_made(spark, monkeypatch):
    seen = []
    real = A._stored
    monkeypatch.setattr(A, "_stored", lambda df, name: seen.append(df.columns) or real(df, name))
    A.author_clusters(spark.createDataFrame(planted()[0], TOKENS), 3).collect()
    assert all(sum("author" in c for c in cols) <= 1 for cols in seen)


def test_a_round_shuffles_sums_by_author_alone(spark, monkeypatch):
    rounds, real = [], A._multiplied
    monkeypatch.setattr(A, "_multiplied", lambda edges, *rest: rounds.append((edges, real(edges, *rest))) or rounds[-1][1])
    A.leading_vectors(A.author_words(spark.createDataFrame(planted()[0], TOKENS)), 3)
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    for edges, df in rounds:
        assert edges.columns == ["a", "b", "w"]
        text = df._jdf.queryExecution().executedPlan().toString()
        assert text.count("Exchange hashpartitioning(") == 1 and "Exchange hashpartitioning(a#" in text
