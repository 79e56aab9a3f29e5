"""Listings per community and tables written by community and date."""
import random
from glob import glob

from pyspark.sql import functions as F

from chatterlens.operators.listing import KINDS, community_listings
from chatterlens.session import scratch_path
from chatterlens.sources.readers import write_partitioned

KIND = "subreddit string, id string, ups long, created_utc long, upvote_ratio double"


def made(rnd=random.Random(6)):
    rows = [(rnd.choice(["a", "b", "hot", "hot", "hot"]), f"p{i:04}", rnd.randrange(50), 1000 * rnd.randrange(40), rnd.randrange(11) / 10) for i in range(500)]
    return rows + [("small", "z1", 3, 5, 0.5), (None, "z2", 1, 1, 0.1), ("small", "z0", None, None, None)]


def test_listings_match_sorting(spark):
    rows = made()
    got = {}
    for r in sorted(community_listings(spark.createDataFrame(rows, KIND), 7).collect(), key=lambda r: r.place):
        got.setdefault((r.subreddit, r.kind), []).append(r.id)
    low = float("-inf")
    for c in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == c]
        last = max(r[3] for r in mine if r[3] is not None)
        keys = {"top": lambda r: (r[2], 0), "new": lambda r: (r[3], 0), "controversial": lambda r: (-abs(r[4] - 0.5), r[2]),
                "rising": lambda r: (r[2] / ((last - r[3]) / 3600.0 + 2.0), 0)}
        for kind, key in keys.items():
            want = sorted(mine, key=lambda r: ((low, low) if r[2] is None else key(r), [-ord(x) for x in r[1]]), reverse=True)
            assert got[c, kind] == [r[1] for r in want[:7]], (c, kind)
        assert len(got[c, "random"]) == min(7, len(mine)) and set(got[c, "random"]) <= {r[1] for r in mine}
    assert got["hot", "random"] != got["hot", "top"]


def test_random_listing_is_seeded_and_cut_before_the_shuffle(spark):
    df = spark.createDataFrame(made(), KIND)
    ids = lambda seed, d: sorted(r.id for r in community_listings(d, 7, ("random",), seed).collect())
    assert ids(1, df) == ids(1, df.repartition(5)) != ids(2, df)
    plan = community_listings(df, 7)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert community_listings(df.limit(0), 7, KINDS).count() == 0


def test_a_hot_folder_is_written_by_many_tasks(spark):
    df = spark.range(40000).select(F.when(F.col("id") % 10 > 0, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 50)).alias("subreddit"),
                                   F.when(F.col("id") % 3 > 0, "2024-01-01").otherwise("2024-01-02").alias("date"), F.col("id"))
    path = scratch_path(spark, "written")
    write_partitioned(df, path, ["subreddit", "date"], "id", 12)
    assert len(glob(f"{path}/subreddit=hot/date=2024-01-01/*.parquet")) > 3
    assert len(glob(f"{path}/subreddit=c0/date=*/*.parquet")) <= 4
    back = spark.read.schema(df.schema).parquet(path).select(df.columns)
    assert back.exceptAll(df).count() == 0 == df.exceptAll(back).count()
