"""Registered queries and the pipeline on the smallest tables."""
import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as E
import corpus_pipeline
from chatterlens.llm import common
from chatterlens.llm.queries import QUERIES, SQL
from helpers import docs

SF = "/root/testdata/sf0.001"
COLUMNS = {"op2_simhash": ["doc_id", "fingerprint", "component_id"], "op3_quality": ["doc_id", "held_out", "score", "predicted"],
           "op4_urls": ["page_id", "host", "path", "rule", "verdict"], "op6_topk": ["query_id", "rank", "vec_id", "score"],
           "op7_toxicity": ["doc_id", "held_out", "score", "predicted"],
           "op11_licenses": ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
           "op12_centroids": ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
           "op13_prefix_trie": ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"],
           "op10_sharding": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]}


def test_all_are_registered():
    assert set(QUERIES) <= set(E.queries()) and set(SQL) <= set(E.oracle_sql())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_contract_columns(spark, name):
    df = E.queries()[name](spark, SF)
    assert df.columns[:len(COLUMNS[name])] == COLUMNS[name]
    table = {"op4_urls": "pages", "op6_topk": None, "op12_centroids": "embeddings", "op13_prefix_trie": None}.get(name, "documents")
    if table:
        assert df.count() == common.table(spark, SF, table).count()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = E.queries()[name](spark, SF)
    cur = con.execute(SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    got = Counter(tuple(r[c] for c in sorted(names)) for r in df.collect())
    at = sorted(range(len(names)), key=names.__getitem__)
    assert got == Counter(tuple(r[i] for i in at) for r in cur.fetchall())


def test_pipeline_stages(spark, tmp_path):
    before = common.table(spark, SF, "documents")
    labels = {r.doc_id: r for r in common.table(spark, SF, "labels").collect()}
    table = before
    for name, stage in corpus_pipeline.STAGES:
        out = common.stored(stage(spark, table, SF), "test-stage")
        if name != "tokens":
            assert out.columns == before.columns and out.count() > 0.5 * table.count()
            assert out.exceptAll(table).count() == 0
        table = out
    rows = table.collect()
    assert all(r.lossless and r.n_pieces == len(r.ids) for r in rows if r.ids is not None)
    assert len(labels) and len({r.doc_id for r in rows}) == len(rows)
    assert Counter(r.doc_id for r in corpus_pipeline.run(spark, SF).collect()) == Counter(r.doc_id for r in rows)


def test_pipeline_on_odd_tables(spark, tmp_path):
    for t in ("labels", "benchmark"):
        common.table(spark, SF, t).write.parquet(str(tmp_path / f"{t}.parquet"))
    from pyspark.sql import functions as F
    for rows in ([], [(None, None), (1, ""), (1, ""), (2, "word " * 30_000), (3, None)]):
        table = docs(spark, rows).withColumn("score", F.lit(1)).withColumn("e", F.lit("x"))
        for name, stage in corpus_pipeline.STAGES:
            columns = table.columns
            table = common.stored(stage(spark, table, str(tmp_path)), "odd-stage")
            assert name == "tokens" or table.columns == columns
        # the four texts without words are one group
        assert table.count() <= 2 and (table.count() > 0) == bool(rows)
        assert {r.doc_id for r in table.collect()} <= {None, 1, 2, 3}


def test_no_score_is_nan(spark):
    for name in ("op3_quality", "op7_toxicity"):
        assert all(r.score is not None and not math.isnan(r.score) for r in E.queries()[name](spark, SF).collect())
