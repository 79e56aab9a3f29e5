import math
import random
import zlib

import numpy as np
import pytest

from chatterlens.llm import labelled, quality, toxicity
from helpers import docs

WORDS = [a + b for a in ("th", "er", "on", "an") for b in ("ing", "ed", "ly", "or", "es")]


def corpus(n=400, seed=2):
    """(texts, quality, toxic): junk is shouted or repeated, toxic texts hold both
    an insult and a group word; clean ones hold at most one of the two."""
    rnd = random.Random(seed)
    texts, good, bad = [], [], []
    for i in range(n):
        w = rnd.choices(WORDS, k=rnd.randint(8, 60))
        toxic = i % 4 == 0
        if toxic:
            w[1:1] = ["grumph", "blorps"]
        elif i % 4 == 1:
            w.insert(2, "grumph")
        elif i % 4 == 2:
            w.insert(2, "blorps")
        ok = i % 5 != 0
        if not ok:
            w = [x.upper() + "!!" for x in w] if i % 2 else [x for x in w for _ in range(9)]
        texts.append(" ".join(w))
        good.append(int(ok))
        bad.append(int(toxic))
    return texts, good, bad


def tables(spark):
    texts, good, bad = corpus()
    labels = spark.createDataFrame([(i, g, b) for i, (g, b) in enumerate(zip(good, bad))], "doc_id long, quality int, toxic int")
    return docs(spark, texts), labels, good, bad


def outside(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_quality_on_held_out(spark):
    table, labels, good, _ = tables(spark)
    rows = quality.quality_scores(table, labels).collect()
    assert all(r.held_out == outside(r.doc_id) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == good[r.doc_id] for r in held]) > 0.95


def test_toxicity_learns_pairs(spark):
    table, labels, _, bad = tables(spark)
    rows = toxicity.toxicity_scores(table, labels).collect()
    held = [r for r in rows if r.held_out]
    assert all(r.predicted == int(r.score >= 0.5) for r in rows)
    assert np.mean([r.predicted == bad[r.doc_id] for r in held]) > 0.95


def test_pairs_carry_the_signal():
    texts, _, bad = corpus(800)
    y = np.array(bad, np.int8)
    model = toxicity.fit(y, [toxicity.terms(t) for t in texts])
    assert ((toxicity.score_texts(model)(texts) >= 0.5) == (y == 1)).mean() > 0.97
    alone = model | {"v": np.zeros_like(model["v"])}  # linear weights only
    assert ((toxicity.score_texts(alone)(texts) >= 0.5) == (y == 1)).mean() < 0.97


@pytest.mark.parametrize("own_insult", [True, False])
def test_pairs_of_terms_that_either_class_holds_alike(own_insult):
    """grumph and blorps stand in half of the texts of each class. Toxic are both
    or an insult of its own against one of the two; or both or none against one."""
    def made(seed, n=2000):
        rnd, texts, kinds = random.Random(seed), [], []
        for _ in range(n):
            w = rnd.choices(WORDS, k=rnd.randint(8, 60))
            kinds.append(rnd.randrange(4))
            w[2:2] = [["grumph", "blorps"], ["vexil"] if own_insult else [], ["grumph"], ["blorps"]][kinds[-1]]
            texts.append(" ".join(w))
        return texts, (np.array(kinds) < 2).astype(np.int8)

    texts, y = made(3)
    model = toxicity.fit(y, [toxicity.terms(t) for t in texts])
    texts, y = made(9)
    assert ((toxicity.score_texts(model)(texts) >= 0.5) == (y == 1)).mean() > 0.95


def test_held_out_labels_are_not_learnt(spark):
    table, labels, *_ = tables(spark)
    from pyspark.sql import functions as F
    from chatterlens.llm.common import held_out
    turned = labels.withColumn("quality", F.when(held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a = {r.doc_id: r.score for r in quality.quality_scores(table, labels).collect()}
    assert a == {r.doc_id: r.score for r in quality.quality_scores(table, turned).collect()}


@pytest.mark.parametrize("mod", [quality, toxicity])
def test_defined_cases(spark, mod):
    table, labels, *_ = tables(spark)
    scores = quality.quality_scores if mod is quality else toxicity.toxicity_scores
    keep = quality.keep_good if mod is quality else toxicity.drop_toxic
    more = docs(spark, [(None, "thing ered"), (900, None), (901, ""), (901, ""), (902, "thing " * 60_000), (3, "repeated id")])
    rows = scores(table.union(more), labels).collect()
    assert len(rows) == 406 and all(r.held_out is not None for r in rows)
    assert len({r.score for r in rows if r.doc_id in (900, 901)}) == 1
    assert scores(docs(spark, []), labels).count() == 0
    none = labels.limit(0)
    assert {r.score for r in scores(table, none).collect()} == ({0.5} if mod is quality else {0.0})
    odd = spark.createDataFrame([(None, 1, 1), (1, None, None), (2, 1, 1), (2, 0, 0)], "doc_id long, quality int, toxic int")
    assert scores(table, odd).count() == 400
    from pyspark.sql import functions as F
    wide = table.withColumn("score", F.lit("x")).withColumn("y", F.lit(1)).withColumn("held_out", F.lit(2))
    assert keep(wide, labels).columns == wide.columns
    assert scores(wide, labels.withColumn("text", F.lit("z"))).count() == 400


def test_sample_is_bounded(spark):
    _, labels, *_ = tables(spark)
    assert labelled.sample_ids(labels, "quality", 20).groupBy("y").count().collect()[0]["count"] == 20


def test_dual_descent_reaches_the_primal_optimum():
    rng = np.random.default_rng(0)
    y = (np.arange(200) % 2).astype(np.int8)
    rows = [(np.array([0, 1, 2 + i % 3]), np.array([y[i] - 0.5 + rng.normal(0, 0.2), rng.normal(), 1.0])) for i in range(200)]
    w, b = quality.descend(rows, y, cost=1.0, passes=300)
    sign = np.where(y == 1, 1, -1)

    def loss(w, b):
        return 0.5 * (w @ w + b * b) + sum(max(0, 1 - s * (w[a] @ v + b)) for (a, v), s in zip(rows, sign))

    best = loss(w, b)
    for _ in range(300):
        d = np.zeros_like(w)
        d[:5] = rng.normal(0, 0.05, 5)
        assert loss(w + d, b + rng.normal(0, 0.05)) >= best - 0.05


def test_fm_margin_is_the_sum_over_all_pairs():
    texts, _, bad = corpus(300)
    model = toxicity.fit(np.array(bad, np.int8), [toxicity.terms(t) for t in texts])
    known = {t: i for i, t in enumerate(model["terms"].tolist())}
    for text in [*texts[:40], "", "nothing known here"]:
        at = [known[t] for t in toxicity.terms(text).tolist() if t in known]
        naive = model["bias"] + sum(float(model["w"][i]) for i in at)
        for n, i in enumerate(at):
            for j in at[n + 1:]:
                naive += float(model["v"][i].astype(float) @ model["v"][j].astype(float))
        assert toxicity._margins(model, [toxicity.terms(text)])[0] == pytest.approx(naive, abs=1e-4)


def naive_places(text):
    """Words, and runs of one to three word shapes, hashed one at a time."""
    import zlib
    mask = (1 << 64) - 1

    def shape(word):
        out = ""
        for c in word:
            kind = "A" if c.isalpha() and c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c if 32 < ord(c) < 127 else "o"
            if not out.endswith(kind):
                out += kind
        return out.encode("latin-1")

    words = text.split()
    one = [zlib.crc32(shape(w)) << 32 | zlib.crc32(b"s" + shape(w)) for w in words]
    one = [1 if i and words[i] == words[i - 1] else h for i, h in enumerate(one)]
    mix = int(quality._MIX)
    two = [(a * 31 + b) * mix & mask for a, b in zip(one, one[1:])]
    three = [(a * 31 + b) * mix & mask for a, b in zip(two, one[2:])]
    out = {(h * mix & mask) >> quality._BITS for h in one} | {h >> quality._BITS for h in two + three}
    return out | {zlib.crc32(w.encode()) % quality.PLACES for w in text.lower().split()}


def test_quality_score_is_the_naive_sum():
    texts, good, _ = corpus(300)
    model = quality.fit(np.array(good, np.int8), [quality.indicators(t) for t in texts])
    odd = ["", "a", "Buy BUY buy NOW!!! 12,50 Ünder über 1 1 1", "x" * 500 + " y"]
    margins = []
    for text in texts[:40] + odd:
        at = naive_places(text)
        assert set(quality.indicators(text).tolist()) == at
        length = math.sqrt(sum(float(model["ratio"][i]) ** 2 for i in at))
        margins.append(sum(float(model["w"][i]) for i in at) / max(1e-9, length) + model["bias"])
    got = quality.score_texts(model)(texts[:40] + odd)
    assert got == pytest.approx(quality.share(np.array(margins), model["curve"]), abs=1e-5)
