import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from chatterlens.llm import sharding
from helpers import docs


def brute_jump(key, shards):
    b, j, key = -1, 0, key % (1 << 64)
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_matches_brute_force():
    keys = [0, 1, 2, (1 << 63) - 1, -1, -5, *range(1000, 1300)]
    for n in (1, 2, 40, 41, 1000):
        got = sharding.jump_hash(np.array(keys, np.int64).view(np.uint64), n).tolist()
        assert got == [brute_jump(k, n) for k in keys]


def test_law_sizes_and_slots(spark):
    given = [(i, "é" * (i % 9)) for i in range(3000)] + [(None, "x"), (None, None), (7, None), (8, ""), (8, ""), (9, "long " * 50_000)]
    table = docs(spark, given).withColumn("shard", F.lit("x")).withColumn("size", F.lit(1)).withColumn("_idx", F.lit(0))
    rows = sharding.shard_rows(table).collect()
    assert len(rows) == len(given)
    want = sorted((str(d), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in given)
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == want
    slots = defaultdict(list)
    for r in rows:
        assert r.law == "key" and r.shard == brute_jump(r.doc_id or 0, 40) and r.grown_shard == brute_jump(r.doc_id or 0, 41)
        assert r.grown_shard in (r.shard, 40)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(s) for s in slots.values()]
    assert len(counts) == 40 and max(counts) < 2 * min(counts)
    moved = sum(r.grown_shard == 40 for r in rows) / len(rows)
    assert 0.5 / 41 < moved < 2 / 41


def test_hot_key_and_empty(spark):
    rows = sharding.shard_rows(docs(spark, [(3, "same")] * 500 + [(4, "x")] * 3)).collect()
    assert len({r.shard for r in rows if r.doc_id == 3}) == 1 and len(rows) == 503
    for shard in {r.shard for r in rows}:
        mine = sorted(r.slot for r in rows if r.shard == shard)
        assert mine == list(range(len(mine)))
    assert sharding.shard_rows(docs(spark, [])).count() == 0


def test_written_shards(spark, tmp_path):
    table = docs(spark, ["a", "b", None, ""])
    sharding.write_shards(table, str(tmp_path / "out"), 5)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 4 and {(r.doc_id, r.shard) for r in back.collect()} == {(i, brute_jump(i, 5)) for i in range(4)}
