import os

import pytest
from pyspark.sql import functions as F

from chatterlens.sources import cache


def write(spark, path, n, first=0):
    spark.range(first, first + n).select(F.col("id"), (F.col("id") % 7).alias("k")).coalesce(1).write.mode("append").parquet(path)


def plan(spark, path, limit=100):
    t = spark.read.parquet(path)
    return t.where(F.col("id") < limit).groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max(F.transform(F.array("id"), lambda x: x + 1)).alias("m"))


def folders(base):
    return sorted(f for d, names, _ in os.walk(base) for f in names if f.startswith("data-"))


def test_second_session_hits(spark, tmp_path):
    path, base = str(tmp_path / "in"), str(tmp_path / "cache")
    write(spark, path, 50)
    first = sorted(map(tuple, cache.cached(plan(spark, path), base).collect()))
    assert sorted(map(tuple, cache.cached(plan(spark.newSession(), path), base).collect())) == first
    assert len(folders(base)) == 1
    cache.cached(plan(spark, path, 20), base)  # another plan
    assert len(folders(base)) == 2


def test_changed_input_misses(spark, tmp_path):
    path, base = str(tmp_path / "in"), str(tmp_path / "cache")
    write(spark, path, 50)
    before = cache.cached(plan(spark, path), base).agg(F.sum("n")).first()[0]
    write(spark, path, 10, 50)
    assert before == 50 and cache.cached(plan(spark, path), base).agg(F.sum("n")).first()[0] == 60
    file = next(f"{path}/{f}" for f in os.listdir(path) if f.endswith(".parquet"))
    key = cache.content_key(plan(spark, path))
    os.utime(file, (1, 1))
    assert cache.content_key(plan(spark, path)) != key


def test_half_written_entry_is_rebuilt(spark, tmp_path):
    path, base = str(tmp_path / "in"), str(tmp_path / "cache")
    write(spark, path, 30)
    df = plan(spark, path)
    half = f"{base}/{cache.content_key(df)}/data-half"
    spark.range(3).write.parquet(half)  # a run that died before its marker
    assert cache.cached(df, base).agg(F.sum("n")).first()[0] == 30
    assert len(folders(base)) == 2 and os.path.exists(f"{base}/{cache.content_key(df)}/{cache.MARKER}")


def test_sides_of_a_join_are_told_apart(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    write(spark, a, 5)
    write(spark, b, 9)
    x, y = spark.read.parquet(a), spark.read.parquet(b)
    assert cache.content_key(x.join(y, "id", "left")) != cache.content_key(y.join(x, "id", "left"))


def test_what_the_key_would_not_tell_is_refused(spark, tmp_path):
    path = str(tmp_path / "in")
    write(spark, path, 5)
    t = spark.read.parquet(path)
    for df in (spark.createDataFrame([(1,)], "a int"), t.withColumn("r", F.rand()), t.where(F.col("id") < t.agg(F.max("id")).scalar())):
        with pytest.raises(ValueError):
            cache.content_key(df)


def test_first_rows(spark, tmp_path):
    path = str(tmp_path / "in")
    for i, n in enumerate([4, 0, 6, 5]):
        spark.range(100 * i, 100 * i + n).coalesce(1).write.parquet(f"{path}-{i}")
    os.mkdir(path)
    for i in range(4):
        part = next(f for f in os.listdir(f"{path}-{i}") if f.startswith("part-"))
        os.link(f"{path}-{i}/{part}", f"{path}/{i}-{part}")
    order = [0, 1, 2, 3, 200, 201, 202, 203, 204, 205, 300, 301, 302, 303, 304]
    for n in (0, 3, 4, 5, 10, 12, 15, 99):
        got = cache.first_rows(spark, path, n)
        assert sorted(r.id for r in got.collect()) == order[:n]
    names = {f.rsplit("/", 1)[1][0] for f in cache.first_rows(spark, path, 7).inputFiles()}
    assert names <= {"0", "1", "2"}  # the file past the cap is not read
