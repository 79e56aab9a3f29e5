import random

import pytest
from pyspark.sql import functions as F

from chatterlens.operators import setjoin

KIND = "rep string, members long, words array<string>"


def sets_of(n, seed, vocabulary=60, longest=12):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    weight = [1 / (i + 1) for i in range(vocabulary)]  # some words are in most sets
    out = set()
    while len(out) < n:
        base = set(rng.choices(words, weight, k=rng.randrange(1, longest)))
        out.add(tuple(sorted(base)))
        for _ in range(rng.randrange(3)):  # near copies
            other = set(base)
            other ^= set(rng.choices(words, k=rng.randrange(1, 3)))
            if other:
                out.add(tuple(sorted(other)))
    return [(f"p{i}", i % 3 + 1, list(w)) for i, w in enumerate(sorted(out)[:n])]


def brute(rows, num, den):
    found = {}
    for i, (a, ma, x) in enumerate(rows):
        for b, mb, y in rows:
            shared = len(set(x) & set(y))
            every = len(set(x) | set(y))
            if a < b and shared * den >= num * every:
                found[a, b] = (round(shared / every, 9), ma, mb)
    return found


@pytest.mark.parametrize("t,num,den,hot", [(0.5, 1, 2, 200), (0.5, 1, 2, 5), (0.8, 4, 5, 5), (0.3, 3, 10, 5), (1.0, 1, 1, 5)])
def test_finds_all_pairs(spark, t, num, den, hot):
    rows = sets_of(260, 3)
    got = setjoin.set_similarity_pairs(spark.createDataFrame(rows, KIND), t, hot).collect()
    assert len({(r.rep_a, r.rep_b) for r in got}) == len(got)
    assert {(r.rep_a, r.rep_b): (round(r.jaccard, 9), r.members_a, r.members_b) for r in got} == brute(rows, num, den)


def test_distinct_sets_and_defined_cases(spark):
    tok = spark.createDataFrame([("b", [["x", "y"], ["x"]]), ("a", [["y"], ["x"]]), ("c", []), ("d", None), ("e", [["x"]])],
                                "id string, tokens array<array<string>>")
    sets = setjoin.distinct_sets(tok)
    assert sorted((r.rep, r.members, r.words) for r in sets.collect()) == [("a", 2, ["x", "y"]), ("e", 1, ["x"])]
    assert [tuple(r) for r in setjoin.set_similarity_pairs(sets, 0.5).collect()] == [("a", "e", 0.5, 2, 1)]
    assert setjoin.set_similarity_pairs(sets.limit(0), 0.5).collect() == []


def test_hot_words_make_few_candidates(spark):
    """A word that all sets hold: candidates grow with what is similar, not with its group."""
    rows = [(f"p{i:04}", 1, ["the", "of", f"a{i}", f"b{i}", f"c{i // 2}", f"d{i // 2}"]) for i in range(600)]
    rows += [(f"q{i:04}", 1, ["the", f"z{i}"]) for i in range(300)]
    df = spark.createDataFrame(rows, KIND)
    from fractions import Fraction
    pairs = setjoin.candidate_pairs(df, Fraction(1, 2), hot=20)
    assert pairs.count() <= 2000
    assert {(r.rep_a, r.rep_b) for r in setjoin.set_similarity_pairs(df, 0.5, 20).collect()} == {(a, b) for a, b in brute(rows, 1, 2)}


def test_recall_of_the_bands(spark):
    rows = sets_of(500, 9, vocabulary=400, longest=14)
    df = spark.createDataFrame(rows, KIND)
    want = {k for k, v in brute(rows, 1, 2).items() if v[0] > 0.5}
    got = {(r.rep_a, r.rep_b) for r in setjoin.lsh_pairs(df, 0.5).collect()}
    assert got <= want and len(got) >= 0.9 * len(want) and len(want) > 50


def test_words_that_repeat_in_no_set(spark):
    df = spark.createDataFrame([(f"p{i}", 1, [f"a{i}", f"b{i}"]) for i in range(50)], KIND).withColumn("df", F.lit(1))
    assert setjoin.set_similarity_pairs(df, 0.5).collect() == []


def test_long_sets_agree_in_bands_without_meeting(spark):
    """Sets with a common half agree in a band, but no two of them are close: few meet."""
    from fractions import Fraction
    common = [f"c{i}" for i in range(12)]
    rows = [(f"p{i:03}", 1, common + [f"a{i}x{j}" for j in range(14)]) for i in range(150)] + [("q", 1, common + [f"a3x{j}" for j in range(13)])]
    df = spark.createDataFrame(rows, KIND)
    bands = df.withColumn("bands", F.array(*[F.array_min(F.transform("words", lambda w: F.xxhash64(w, F.lit(i)))) for i in range(6)]))
    assert setjoin.candidate_pairs(bands, Fraction(1, 2), hot=20).count() < 150 < bands.alias("a").join(
        bands.alias("b"), F.expr("a.rep < b.rep AND a.bands[0] = b.bands[0]")).count()
    assert {(r.rep_a, r.rep_b) for r in setjoin.lsh_pairs(df, 0.5, hot=20).collect()} == {("p003", "q")}


@pytest.mark.parametrize("hot", [200, 5])
def test_bands_give_what_meeting_on_them_alone_gives(spark, hot):
    rows = sets_of(260, 4)
    df = spark.createDataFrame(rows, KIND).withColumn("bands", F.array(*[F.array_min(F.transform("words", lambda w: F.xxhash64(w, F.lit(i)))) for i in range(2)]))
    band = {r.rep: r.bands for r in df.collect()}
    want = {k for k in brute(rows, 1, 2) if any(x == y for x, y in zip(band[k[0]], band[k[1]]))}
    want = {k for k in want if brute([r for r in rows if r[0] in k], 1, 2)[k][0] > 0.5}
    assert len(want) > 20 and {(r.rep_a, r.rep_b) for r in setjoin.agreeing_pairs(df, 0.5, hot).collect()} == want


def test_sets_of_one_id(spark):
    df = spark.createDataFrame([("p", 1, ["a", "b"]), ("p", 1, ["x", "y"]), ("q", 1, ["x", "y", "z"])], KIND)
    assert [tuple(r)[:2] for r in setjoin.set_similarity_pairs(df, 0.5).collect()] == [("p", "q")]


def test_words_in_common_are_counted_before_a_pair_is_written(spark):
    """Sets that share two words of their prefixes, as most do here, are no candidates yet."""
    from fractions import Fraction
    rng = random.Random(5)
    rows = [(f"p{i:03}", 1, sorted(rng.sample([f"a{j}" for j in range(150)], 20) + rng.sample([f"b{j}" for j in range(25)], 20))) for i in range(300)]
    rows += [(f"q{i:03}", 1, sorted({*r[2][1:], f"c{i}"})) for i, r in enumerate(rows[:10])]
    df = spark.createDataFrame(rows, KIND)
    assert setjoin.candidate_pairs(df, Fraction(1, 2), hot=20).count() < 6000
    assert {(r.rep_a, r.rep_b) for r in setjoin.set_similarity_pairs(df, 0.5, 20).collect()} == set(brute(rows, 1, 2)) != set()


def test_blocks_and_counting_in_pieces(monkeypatch):
    import numpy as np
    from fractions import Fraction
    t = Fraction(1, 2)
    assert [b[2] > 1 for b in setjoin._blocks([(4, 10), (9, 5000), (12, 10)], t, 1)] == [False, True, False]
    monkeypatch.setattr(setjoin, "CELLS", 100)
    monkeypatch.setattr(setjoin, "MEETINGS", 7)
    sets = [sorted({hash(w) % 1000 for w in r[2]}) for r in sets_of(120, 6)]
    side = {"n": np.array([len(x) for x in sets]), "q": np.array([len(x) for x in sets]), "least": np.ones(len(sets), int), "w": np.concatenate(sets)}
    x, y = setjoin._meet(side, side, True, t)
    want = {(i, j) for j, b in enumerate(sets) for i, a in enumerate(sets[:j]) if 2 * len({*a} & {*b}) >= len({*a} | {*b})}
    assert set(zip(x.tolist(), y.tolist())) == want and len(x) == len(want) > 20
