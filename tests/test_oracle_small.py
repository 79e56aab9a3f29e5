"""Spark result = DuckDB twin on sf0.001 for a representative subset."""
import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as E
from tables import SF0001

NAMES = ["top_words_per_day", "share_series", "change_points", "new_terms", "author_table",
         "author_shrinkage", "one_hit_wonder_curve", "preprocess", "timeparts", "html_text",
         "post_vectors", "tfidf_top_terms", "repost_pairs", "reply_edges", "connected_components",
         "binary_metrics", "stream_snapshots", "exact_split", "community_describe", "kfold_metrics", "stream_sessions",
         "community_listings"]


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if hasattr(v, "isoformat"):
        return str(v)
    return v


def _bag(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], Counter(tuple(_norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ["events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF0001}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, name):
    df = E.queries()[name](spark, SF0001)
    rows = [tuple(r) for r in df.collect()]
    cur = con.execute(E.oracle_sql()[name])
    sc, sb = _bag(df.columns, rows)
    dc, db = _bag([d[0] for d in cur.description], cur.fetchall())
    assert sc == dc
    assert sb == db


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert "confidence" in df.columns


def test_every_query_has_ids():
    from chatterlens.plans import all_queries
    for q in all_queries().values():
        assert q.ids, q.name
