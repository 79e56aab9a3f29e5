import random

import numpy as np
from pyspark.sql import functions as F

from chatterlens.llm import decontam
from helpers import docs

RND = random.Random(7)
WORDS = ["".join(RND.choices("abcdefghij", k=RND.randint(2, 8))) for _ in range(3000)]


def brute(a, b):
    """Smith-Waterman score, cell by cell."""
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h))


def test_alignment_matches_brute_force():
    rng = np.random.default_rng(1)
    query, rows = rng.integers(0, 5, (60, 12)), rng.integers(-1, 5, (60, 30))
    best, end = decontam.align(query, rows)
    assert best.tolist() == [brute(q.tolist(), r.tolist()) for q, r in zip(query, rows)]


def planted():
    rnd = random.Random(11)
    items = [" ".join(rnd.choices(WORDS, k=rnd.choice([12, 30, 45, 150]))) for _ in range(20)]
    texts, leaks = [], set()
    for i in range(200):
        w = rnd.choices(WORDS, k=rnd.randint(20, 300))
        k = i % 40
        if k < 20:
            passage = items[k].split()
            if i % 3 == 1:  # edited: one word in six replaced
                passage = [rnd.choice(WORDS) if j % 6 == 3 else x for j, x in enumerate(passage)]
            elif i % 3 == 2:  # words dropped and added, other case and marks
                passage = [x.upper() + "," for j, x in enumerate(passage) if j % 9 != 4] + [rnd.choice(WORDS)]
            at = rnd.randrange(len(w))
            w[at:at] = passage
            leaks.add((i, k))
        texts.append(" ".join(w))
    return items, texts, leaks


def bench(spark, items):
    return spark.createDataFrame(list(enumerate(items)), "item_id long, text string")


def test_catches_planted_passages_and_no_others(spark):
    items, texts, leaks = planted()
    rows = decontam.contaminated(docs(spark, texts), bench(spark, items)).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == leaks
    for r in rows:
        assert decontam.THRESHOLD <= r.score <= 1
    kept = decontam.drop_contaminated(docs(spark, texts), bench(spark, items))
    assert {r.doc_id for r in kept.collect()} == set(range(200)) - {d for d, _ in leaks}


def test_score_is_the_best_over_all_windows(spark):
    items, texts, leaks = planted()
    got = {(r.doc_id, r.item_id): r.score for r in decontam.contaminated(docs(spark, texts), bench(spark, items)).collect()}
    for d, k in sorted(leaks)[:25]:
        a, b = items[k].lower().split(), decontam.words(texts[d].lower().encode())
        if len(a) <= decontam.SEGMENT:
            assert abs(got[d, k] - brute([x.encode() for x in a], b) / (2 * len(a))) < 1e-6


def test_blocks_give_the_same_rows(spark, monkeypatch):
    items, texts, _ = planted()
    whole = {tuple(r) for r in decontam.contaminated(docs(spark, texts), bench(spark, items)).collect()}
    monkeypatch.setattr(decontam, "BLOCK_WORDS", 100)
    assert {tuple(r) for r in decontam.contaminated(docs(spark, texts), bench(spark, items)).collect()} == whole


def test_a_passage_that_all_share_is_still_a_leak(spark):
    items, _, _ = planted()
    texts = [items[1] + " " + " ".join(random.Random(i).choices(WORDS, k=40)) for i in range(60)]
    assert decontam.contaminated(docs(spark, texts), bench(spark, items)).select("doc_id").distinct().count() == 60


def test_a_passage_across_a_cut_of_a_long_item(spark):
    rnd = random.Random(5)
    item = rnd.sample(WORDS, 128)
    texts = [" ".join([*rnd.choices(WORDS, k=30), *item[a:a + 50], *rnd.choices(WORDS, k=30)]) for a in range(0, 79, 6)]
    texts.append(" ".join([*rnd.choices(WORDS, k=30), *item[39:89]]))  # 25 words on either side
    rows = decontam.contaminated(docs(spark, texts), bench(spark, [" ".join(item)])).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))


def test_very_many_edited_copies_with_few_whole_grams(spark):
    """16 words of 32 kept: two whole 3-grams in the first 4, then every third
    word replaced. A third of all rows holds the same copy; each is a leak."""
    rnd = random.Random(8)
    item = rnd.sample(WORDS, 32)
    other = [w for w in WORDS if w not in item]
    copy = [*item[:4], *(rnd.choice(other) if j % 3 == 0 else w for j, w in enumerate(item[4:]))]
    assert brute(item, copy) >= 2 * 32 * decontam.THRESHOLD
    for n in (60, 3600):
        texts = [" ".join([*rnd.choices(other, k=10), *(copy if i % 3 == 0 else []), *rnd.choices(other, k=10)]) for i in range(n)]
        rows = decontam.contaminated(docs(spark, texts), bench(spark, [" ".join(item)])).collect()
        assert sorted(r.doc_id for r in rows) == list(range(0, n, 3))


def test_defined_cases(spark):
    items, texts, leaks = planted()
    odd = docs(spark, [(None, items[0]), (500, None), (501, ""), (502, "two words"), (503, texts[0] * 300), (503, items[3]), (503, items[3])])
    table = bench(spark, [*items, items[0], None, "", "a b"])
    rows = decontam.contaminated(odd.withColumn("item_id", F.lit(1)).withColumn("score", F.lit("s")), table.withColumn("doc_id", F.lit(3))).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == {(None, 0), (None, 20), (503, 0), (503, 20), (503, 3)}
    assert sum(r.item_id == 3 for r in rows) == 2
    assert decontam.contaminated(docs(spark, []), table).count() == 0
    assert decontam.contaminated(odd, table.limit(0)).count() == 0
    assert decontam.drop_contaminated(odd, table.limit(0)).count() == 7
    assert decontam.drop_contaminated(odd.withColumn("ids", F.lit(1)), table).columns == [*odd.columns, "ids"]
