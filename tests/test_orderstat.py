"""Selection against sorting, splits against quotas counted by hand."""
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from chatterlens.operators import orderstat as O

RND = random.Random(4)


def groups():
    return {"flat": [3.5] * 50, "one": [7.0], "wide": [RND.choice([-1, 1]) * 10 ** RND.uniform(-300, 300) for _ in range(400)],
            "ends": [1.7e308, -1.7e308, 0.0, -0.0, 5e-324], None: [RND.gauss(0, 1) for _ in range(300)],
            "hot": [float(RND.randrange(20)) for _ in range(2000)]}


def frame(spark, g, kind="double"):
    return spark.createDataFrame([(k, v) for k, vs in g.items() for v in vs], f"k string, x {kind}")


@pytest.mark.parametrize("bins", [O.BINS, 16])
def test_quantiles_match_sorting(spark, monkeypatch, bins):
    monkeypatch.setattr(O, "BINS", bins)
    g = groups()
    qs = (0.0, 0.1, 0.25, 0.5, 0.9, 1.0)
    got = {(r.k, r.q): r.value for r in O.quantiles(frame(spark, g), ["k"], "x", qs).collect()}
    assert len(got) == len(g) * len(qs)
    for k, vs in g.items():
        s = sorted(vs)
        for q in qs:
            at = q * (len(s) - 1)
            low, high = s[math.floor(at)], s[math.ceil(at)]
            want = low if low == high else low * (1 - at % 1) + high * (at % 1)
            assert got[k, q] == pytest.approx(want, rel=1e-12, abs=1e-320)


def test_whole_numbers_beyond_doubles(spark, monkeypatch):
    monkeypatch.setattr(O, "BINS", 16)
    g = {"a": [2 ** 62 + i for i in range(50)] + [-2 ** 63, 2 ** 63 - 1], "b": [RND.randrange(-2 ** 63, 2 ** 63) for _ in range(300)]}
    for r in O.select_ranks(frame(spark, g, "long"), ["k"], "x", [0, 1, 17, 51]).collect():
        s = sorted(g[r.k])
        assert (r.value, r.below) == (s[r["rank"]], sum(x < s[r["rank"]] for x in s))


def test_null_nan_and_infinite_values_take_no_part(spark):
    g = {"a": [None, math.nan, math.inf, -math.inf, 1.0, 2.0, 4.0], "b": [None, math.nan]}
    rows = O.describe(frame(spark, g), "x", ["k"]).collect()
    assert [(r.k, r["count"], r["min"], r["p50"], r["max"]) for r in rows] == [("a", 3, 1.0, 2.0, 4.0)]
    assert O.quantiles(frame(spark, g).limit(0), ["k"], "x").count() == 0
    whole = spark.range(1).select(O.quantile(frame(spark, g), "x", 0.25).alias("q"), O.quantile(frame(spark, g).limit(0), "x").alias("none")).first()
    assert (whole.q, whole.none) == (np.percentile([1, 2, 4], 25), None)


def test_a_group_is_counted_before_the_shuffle(spark, monkeypatch):
    """Hot group: what a round's shuffle gets is bins, not rows."""
    seen = []
    real = O._stored
    monkeypatch.setattr(O, "_stored", lambda df, name: seen.append(df._jdf.queryExecution().executedPlan().toString()) or real(df, name))
    O.quantiles(frame(spark, {"hot": [RND.random() for _ in range(5000)]}), ["k"], "x").collect()
    assert any("partial_count" in p and "bin" in p for p in seen)
    assert not any("collect_list" in p or "percentile" in p for p in seen)


@pytest.mark.parametrize("fractions", [(0.8, 0.2), (0.6, 0.2, 0.2), (1.0, 0.0), (0.0, 1.0), (1.0,)])
def test_quota_is_met_exactly_in_every_stratum(spark, monkeypatch, fractions):
    monkeypatch.setattr(O, "BINS", 64)
    sizes = {"a": 1, "b": 2, "c": 7, None: 33, "hot": 500}
    rows = [(f"{k}{i}", k, i) for k, n in sizes.items() for i in range(n)]
    rows += [("same", "copies", i) for i in range(101)] + [(None, "nulls", i) for i in range(10)]
    df = spark.createDataFrame(rows, "id string, k string, part_of int")
    got = O.exact_split(df, ["k"], fractions).collect()
    assert Counter((r.id, r.k, r.part_of) for r in got) == Counter(rows)
    counts = Counter((r.k, r.part) for r in got)
    for k, n in [*sizes.items(), ("copies", 101), ("nulls", 10)]:
        cuts = [0, *(math.floor(n * sum(fractions[:j + 1]) + 0.5 + 1e-9) for j in range(len(fractions) - 1)), n]
        assert [counts[k, j] for j in range(len(fractions))] == [b - a for a, b in zip(cuts, cuts[1:])]


def test_split_is_stable_and_differs_by_seed(spark):
    df = spark.range(400).select(F.col("id").cast("string").alias("id"), (F.col("id") % 3).alias("k"))
    a = {r.id: r.part for r in O.exact_split(df, ["k"]).collect()}
    assert {r.id: r.part for r in O.exact_split(df.repartition(7), ["k"]).collect()} == a
    assert {r.id: r.part for r in O.exact_split(df, ["k"], seed=1).collect()} != a
    assert O.exact_split(df.limit(0), ["k"]).count() == 0
    plain = Counter(r.part for r in O.exact_split(df, [], (0.75, 0.25)).collect())
    assert plain == {0: 300, 1: 100}
    with pytest.raises(ValueError):
        O.exact_split(df, ["k"], (0.5, 0.6))
