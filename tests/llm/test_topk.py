import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chatterlens.llm import topk

KIND = "vec_id long, embedding array<float>, label int"


def brute(rows, k=5):
    import math
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None
          and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (q, a) in enumerate(ok):
        if q % 50 == 0:
            found = sorted((-sum(x * y for x, y in zip(a, b)), i) for m, (i, b) in enumerate(ok) if m != n)
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found[:k])]
    return sorted(out)


def run(spark, rows):
    df = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in rows], KIND)
    data = topk.integer_vectors(df.withColumn("v", F.lit(1)).withColumn("cell", F.lit(2)))
    return sorted(tuple(r) for r in topk.top_k(data, "vec_id % 50 = 0").collect())


def vectors(n, size, seed, clusters=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, size))
    if clusters:
        x = 0.2 * x + 4 * rng.normal(size=(clusters, size))[rng.integers(0, clusters, n)]
    return [(i, np.float32(v).tolist()) for i, v in enumerate(x)]


@pytest.mark.parametrize("clusters", [0, 7])
def test_matches_brute_force(spark, clusters):
    rows = vectors(700, 8, 3, clusters)
    assert run(spark, rows) == brute(rows)


def test_blocks_of_a_hot_cell(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_ROWS", 3)
    monkeypatch.setattr(topk, "DATA_ROWS", 40)
    rows = vectors(300, 4, 5) + [(i, [0.5, 0.5, 0.5, 0.5]) for i in range(300, 600)]
    assert run(spark, rows) == brute(rows)


def test_defined_cases(spark):
    rows = [(0, [1, 2]), (50, None), (100, [1, None]), (150, [float("nan"), 1]), (200, [float("inf"), 0]), (None, [3, 3]),
            (1, [1.0]), (2, []), (3, [-1, 5, 2]), (3, [-1, 5, 2])]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == [] and run(spark, [(1, [1, 2])]) == [] and run(spark, [(0, [1.0])]) == []


def test_clustered_vectors_are_sent_once_and_queries_to_few_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "DATA_ROWS", 100)
    kept = {}
    stored = topk.stored
    monkeypatch.setattr(topk, "stored", lambda df, name: kept.setdefault(name, []).append(stored(df, name)) or kept[name][-1])
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(12, 6)) * 3
    rows = [(i, np.float32(v).tolist()) for i, v in enumerate(centres[rng.integers(0, 12, 4000)] + .05 * rng.normal(size=(4000, 6)))]
    assert run(spark, rows) == brute(rows)
    blocks, data, first, others = kept["blocks"][0], 4000, kept["first"][0].count(), kept["others"][0].count()
    n_blocks = blocks.select("cell", "part").distinct().count()
    assert blocks.count() == data and first == 80 and n_blocks >= 40
    sizes = [r["count"] for r in blocks.groupBy("cell", "part").count().collect()]
    assert max(sizes) <= 150
    assert others < 0.35 * first * n_blocks  # most blocks are excluded for most queries
    for name in ("met",):
        assert all(t.count() <= 5 * (first + others) for t in kept[name])


def test_repeated_ids_are_rows(spark):
    longest = [(50, [9.0, 9.0, 9.0])] * 6  # all of distance 0 to their pivot
    rows = longest + [(i, v) for i, v in vectors(30, 3, 4) if i]
    assert run(spark, rows) == brute(rows)
    assert len(run(spark, rows)) == 30
    rows += [(50, [-1.0, 2.0, 0.5]), (50, [0.0, -3.0, 1.0])]  # further vectors of one query id
    assert run(spark, rows) == brute(rows)
    rows = vectors(400, 4, 8, 5) + [(100, v) for _, v in vectors(20, 4, 21)] + [(150, [3.0, 3.0, 3.0, 3.0])] * 30
    assert run(spark, rows) == brute(rows)


def test_equal_rows_fill_more_than_one_block(spark, monkeypatch):
    monkeypatch.setattr(topk, "DATA_ROWS", 10)
    rows = vectors(60, 3, 2) + [(7, [1.0, 1.0, 1.0])] * 50
    assert run(spark, rows) == brute(rows)
