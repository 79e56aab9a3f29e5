import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from chatterlens.llm import forest, trie

KIND = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            sha = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own.setdefault(c, []).append((turn is not None, turn or 0, sha, (role, text)))
    own = {c: [t[3] for t in sorted(ts)] for c, ts in own.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        made[c] = tuple(own.get(base, [])[:h] + turns[h:])
    nodes = {}
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(c)
    children = {}
    for p in nodes:
        if p:
            children.setdefault(p[:-1], []).append(p)
    out = []
    for p, members in nodes.items():
        below, todo = [], [p]
        while todo:
            q = todo.pop()
            below.append(q)
            todo += children.get(q, [])
        saved = sum((len(nodes[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        names = ",".join(str(c) for c in sorted(members) if len(made[c]) == len(p))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(children.get(p, [])),
                    sum(q not in children for q in below), saved, hashlib.sha256(names.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, **settings):
    table = spark.createDataFrame(rows, KIND).withColumn("depth", F.lit("x")).withColumn("size", F.lit(1))
    return sorted((tuple(r) for r in trie.conversation_trie(table, **settings).collect()), key=str)


def conversations(n, seed, kinds=3, longest=7):
    rng = random.Random(seed)
    return [(c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "bé", "ccc", ""][:kinds]))
            for c in range(n) for t in range(rng.randrange(1, longest))]


def test_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(trie, "RUN", 4)
    rows = conversations(60, 1)
    rows += [(c, t, "user", f"same {t}") for c in range(100, 130) for t in range(4)]  # copies
    rows += [(200, t, "user", f"long {t}") for t in range(90)] + [(201, t, "user", f"long {t}") for t in range(60)]
    assert run(spark, rows, piece=40) == brute(rows)


def test_defined_cases(spark):
    rows = [(None, 1, "user", "x"), (1, None, "user", "first"), (1, None, None, None), (1, 0, "user", ""), (1, 0, "user", ""),
            (-7, 3, None, "neg"), (-7, 2, "user", None), (-5, 1, "a", "b"), (-10, 1, "a", "b"), (2**40, 0, "user", "w " * 50_000), (3, 0, "", "abc"), (4, 0, "a", "bc")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == [] and run(spark, [(None, 0, "a", "b")]) == []


def sums_of(parents, weights):
    out = list(weights)
    for i in range(len(parents) - 1, -1, -1):  # parents come before their children
        if parents[i] is not None:
            out[parents[i]] += out[i]
    return out


def tree(rng, n, kind):
    if kind == "chain":
        return [i - 1 if i else None for i in range(n)]
    if kind == "star":
        return [0 if i else None for i in range(n)]
    if kind == "trees":
        return [rng.randrange(max(0, i - 4), i) if i % 17 else None for i in range(n)]
    return [rng.randrange(max(0, i - rng.choice([2, 50])), i) if i else None for i in range(n)]


@pytest.mark.parametrize("kind", ["chain", "star", "trees", "mixed"])
def test_local_levels(kind):
    rng = random.Random(kind)
    for n in (1, 2, 3, 50, 3000):
        parents = tree(rng, n, kind)
        weights = [rng.randrange(-5, 100) for _ in range(n)]
        kids, pre, full = {}, [0] * n, [1] * n
        for i in range(n - 1, -1, -1):
            if parents[i] is not None:
                full[parents[i]] += full[i]
        top = [0] * n
        after, nxt = 0, {}
        for i in range(n):  # a preorder: each node after the parts of its earlier siblings
            if parents[i] is None:
                pre[i], after = after, after + full[i]
                top[i] = pre[i]
            else:
                p = parents[i]
                pre[i] = nxt.get(p, pre[p] + 1)
                nxt[p] = pre[i] + full[i]
                top[i] = top[p]
        order = np.argsort(pre)
        col = lambda v: np.array(v, np.int64)[order]
        up = col([-1 if p is None else pre[p] for p in parents])
        got = forest.solve(col(top), col(pre), up, col(full), col(full), [col(weights)])[0]
        assert got.tolist() == np.array(sums_of(parents, weights))[order].tolist()


@pytest.mark.parametrize("kind,piece", [("chain", 40), ("mixed", 12), ("trees", 4)])
def test_rollup_splits_large_components(spark, kind, piece):
    rng = random.Random(kind)
    parents = tree(rng, 150, kind)
    weights = [rng.randrange(100) for _ in parents]
    name = [f"n{i * 7919 % 1000}" for i in range(150)]
    rows = [(name[i], "absent" if p is None and i % 2 else None if p is None else name[p], w) for i, (p, w) in enumerate(zip(parents, weights))]
    table = spark.createDataFrame(rows, "node string, parent string, w long").withColumn("one", F.lit(1))
    got = {r.node: (r.w, r.one) for r in forest.rollup(table, ["w", "one"], piece).collect()}
    assert got == {name[i]: (s, k) for i, (s, k) in enumerate(zip(sums_of(parents, weights), sums_of(parents, [1] * 150)))}


def test_cycle_and_empty_forest(spark):
    empty = spark.createDataFrame([], "node long, parent long, w long")
    assert forest.rollup(empty, ["w"]).collect() == []
    with pytest.raises(ValueError, match="cycle"):
        forest._sizes(spark.createDataFrame([(1, 2), (2, 1)], "node long, parent long"), most=3)


def test_prefixes_carry_over_partitions(spark):
    from chatterlens.operators.ordering import sorted_copy
    rows = [(k, i, (i * 37 + (k or 0)) % 101) for k, n in ((1, 5), (2, 400), (None, 90)) for i in range(n)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        copy = sorted_copy(spark.createDataFrame(rows, "k long, i long, v long").repartition(7), ["k", "i"])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    got = forest.prefixes(copy.withColumn("z", F.col("v")), "k", sums=("v",), xors=("z",)).collect()
    assert len({r._pid for r in got}) > 3
    for r in got:
        seen = [v for k, i, v in rows if k == r.k and i <= r.i]
        assert r.v == sum(seen) and r.z == int(np.bitwise_xor.reduce(seen))
