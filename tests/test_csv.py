"""CSV written and read again: every row and the whole body."""
from collections import Counter

import duckdb

import __spark_entry__ as E
from chatterlens.sources import readers as R
from tables import SF0001


def test_every_row_and_body_matches_sql(spark):
    con = duckdb.connect()
    for t in ["events", "documents"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF0001}/{t}.parquet')")
    cur = con.execute(E.oracle_sql()["csv_whole"])
    want = Counter(cur.fetchall())
    rows = E.queries()["csv_whole"](spark, SF0001)
    assert rows.columns == [d[0] for d in cur.description]
    assert Counter(tuple(r) for r in rows.collect()) == want
    assert sum(want.values()) > 100


def test_odd_bodies_come_back(spark, tmp_path):
    bodies = ["  both ends  ", "\ttab", "a \"quote\", and comma", "back\\slash\\", "line\nbreak\r\nend\n", "", None, "x"]
    names = R.POSTS_SCHEMA.fieldNames()
    rows = spark.createDataFrame([tuple({"id": f"p{i}", "selftext": b}.get(n) for n in names) for i, b in enumerate(bodies)], R.POSTS_SCHEMA)
    R.write_posts_csv(rows, str(tmp_path / "csv"))
    back = {r.id: r.selftext for r in R.read_posts_csv(spark, str(tmp_path / "csv")).collect()}
    assert back == {f"p{i}": b for i, b in enumerate(bodies)}
