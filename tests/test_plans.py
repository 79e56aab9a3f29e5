"""Plan-shape checks: pushdown, pruning, no nested-loop neighbourhood join."""
from pyspark.sql import functions as F

from chatterlens.operators import similarity as S
from chatterlens.operators import terms
from chatterlens.sources.fixtures import posts_view, table

from tables import SF0001


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filter_pushed_and_columns_pruned(spark):
    ev = table(spark, SF0001, "events").filter(F.col("value") > 10).select("event_id")
    p = plan(ev)
    assert "PushedFilters: [IsNotNull(value), GreaterThan(value,10.0)]" in p
    assert "ReadSchema: struct<event_id:bigint,value:double>" in p


def test_neighbourhood_join_is_equi_join(spark):
    tok = terms.with_tokens(posts_view(spark, SF0001))
    pairs = S.repost_pairs(tok, 200)
    p = plan(pairs)
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    assert pairs.count() >= 0


def test_top_k_uses_window_group_limit(spark):
    tok = terms.with_tokens(posts_view(spark, SF0001))
    top = terms.top_words_per_day(tok, 2)
    top.collect()
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString() or \
        "WindowGroupLimit" in top._jdf.queryExecution().optimizedPlan().toString()
