import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from chatterlens.llm import simhash
from helpers import docs


def brute_print(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ")
             .replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints, bits=3):
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(prints))]


def texts():
    rnd = random.Random(3)
    base = [" ".join(rnd.choices(["aa", "Bb", "cç", "dd.", "e e", "f\x1cf", "g"], k=200)) for _ in range(6)]
    out = list(base)
    for b in base[:4]:
        for _ in range(25):
            w = b.split(" ")
            w[rnd.randrange(len(w))] = rnd.choice(["x", "y", "zz"])
            out.append(" ".join(w))
    return out + [None, "", " \t\n", "One", "one two", "ONE two", "word " * 40_000, base[0], base[0]]


def test_matches_brute_force(spark):
    given = texts()
    rows = {r.doc_id: r for r in simhash.near_duplicates(docs(spark, given)).collect()}
    prints = [brute_print(t) for t in given]
    assert [int(rows[i].fingerprint, 16) for i in range(len(given))] == prints
    assert all(len(r.fingerprint) == 16 for r in rows.values())
    assert [rows[i].component_id for i in range(len(given))] == brute_groups(prints)
    assert len(set(brute_groups(prints))) < len(given) - 40


def test_links_planted_distances(spark):
    rnd = random.Random(5)
    prints = [rnd.getrandbits(64) for _ in range(300)]
    for p in prints[:150]:
        for k in (1, 2, 3, 4):
            q = p
            for b in rnd.sample(range(64), k):
                q ^= 1 << b
            prints.append(q)
    prints = list(dict.fromkeys(prints))
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    table = spark.createDataFrame([(x,) for x in signed], "fp long")
    from chatterlens.llm.common import components
    got = {r.node: r.root for r in components(simhash.links(table)).collect()}
    want = brute_groups(prints)
    groups = {}
    for s, w in zip(signed, want):
        groups.setdefault(w, set()).add(got.get(s, s))
    assert all(len(g) == 1 for g in groups.values())
    assert len({min(g) for g in groups.values()}) == len(groups)


def test_variants_cover_every_distance():
    rnd = random.Random(1)
    emit = simhash.variants(3)
    keys = lambda x: {(((x ^ (f % (1 << 64))) & (m % (1 << 64))) | (t % (1 << 64))) for m, f, t in emit}
    for k in (1, 2, 3):
        for _ in range(200):
            a = rnd.getrandbits(64)
            b = a
            for bit in rnd.sample(range(64), k):
                b ^= 1 << bit
            assert keys(a) & keys(b)


def test_drop_keeps_one_row_of_each_group(spark):
    given = [(5, "a b c d"), (3, "a b c d"), (3, "a b c d"), (9, "q r s t u"), (9, None), (None, "a b c d"), (None, "only here now"), (1, "")]
    table = docs(spark, given).withColumn("fp", F.lit("extra")).withColumn("root", F.lit(1)).withColumn("th", F.lit(2))
    kept = simhash.drop_near_duplicates(table)
    assert kept.columns == table.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert got == sorted([(3, "a b c d"), (9, "q r s t u"), (None, "only here now"), (1, "")], key=str)


def test_empty_and_null_ids(spark):
    none = docs(spark, [])
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.drop_near_duplicates(none).count() == 0
    rows = simhash.near_duplicates(docs(spark, [(None, "x y z"), (None, "x y z"), (4, "other words here")])).collect()
    assert sorted(str(r.component_id) for r in rows) == ["4", "None", "None"]
