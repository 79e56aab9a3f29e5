"""Reply graph: parent-author join, undirected weighted edges, connected
components, giant component and comment-forest views.

Connected components use alternating star contraction on DataFrames.  Every
round is a join of edges with minima plus a ``min`` aggregate (partial
aggregation absorbs high-degree authors), and each round's edge table is cut from its lineage with a reliable checkpoint, so a long
iteration neither grows the plan nor depends on lost executors' shuffle files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def with_parent_author(comments: DataFrame) -> DataFrame:
    """Each comment with its parent comment's author (left join,
    ``parent_id`` -> ``name``, suffix ``_parent``)."""
    par = comments.select(F.col("name").alias("parent_id"), F.col("author").alias("author_parent"))
    return comments.join(par, "parent_id", "left")


def reply_edges(comments: DataFrame) -> DataFrame:
    """Undirected author edges of replies (depth != 0), weight = sum of
    the replies' scores.  Replies whose parent is unknown make no edge."""
    c = with_parent_author(comments).filter((F.col("depth") != 0) & F.col("author_parent").isNotNull())
    e = c.select(F.least("author", "author_parent").alias("u"), F.greatest("author", "author_parent").alias("v"),
                 "score")
    return e.groupBy("u", "v").agg(F.sum("score").alias("weight"), F.count(F.lit(1)).alias("replies"))


def vertices(comments: DataFrame) -> DataFrame:
    """Every author of a comment is a vertex (isolated ones included)."""
    return comments.filter(F.col("author").isNotNull()).select(F.col("author").alias("id")).distinct()


def _norm_edges(df: DataFrame, x: str, y: str) -> DataFrame:
    """Undirected edge set as (a < b) pairs, self loops dropped, distinct."""
    return df.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")) \
        .filter(F.col("a") != F.col("b")).distinct()


def connected_components(verts: DataFrame, edges: DataFrame, src: str = "u", dst: str = "v") -> DataFrame:
    """``(id, component)`` with the component named by its smallest id.

    Alternating large-star / small-star rounds (Kiveris et al., 2014): each
    round is two ``min`` aggregates and two joins on the vertex key, and the
    edge set contracts towards one star per component centred on its minimum
    in O(log^2 n) rounds.  Rounds go on until the edge set is unchanged, by its
    count and an order-free hash.  The minima of the large star are stored
    before they are joined back, so that both sides of the join are dealt by an
    exchange and AQE can split the rows of a hub; those of the small star are not.
    """
    def state(d):
        return tuple(d.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())

    e = cut_lineage(_norm_edges(edges, src, dst))
    before = state(e)
    while before[0]:
        # large star: every neighbour above u links to m(u) = min(u, N(u))
        d = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        m = cut_lineage(d.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")))
        ls = d.filter(F.col("v") > F.col("u")).join(m, "u")
        ls = _norm_edges(ls, "v", "m")
        # small star: u and its lower neighbours link to the least of them
        mm = ls.groupBy("b").agg(F.min("a").alias("m"))
        ss = ls.join(mm, "b").select(F.col("a").alias("x"), F.col("m").alias("y")).unionByName(
            mm.select(F.col("b").alias("x"), F.col("m").alias("y")))
        e = cut_lineage(_norm_edges(ss, "x", "y"))
        after = state(e)
        if after == before:
            break
        before = after
    comp = e.groupBy("b").agg(F.min("a").alias("component")).withColumnRenamed("b", "id")
    return verts.select("id").join(comp, "id", "left") \
        .select("id", F.coalesce(F.col("component"), F.col("id")).alias("component"))


def component_sizes(cc: DataFrame) -> DataFrame:
    """Component-size distribution ``(size, n_components)``."""
    s = cc.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    return s.groupBy("size").agg(F.count(F.lit(1)).alias("n_components"))


def giant_component_edges(cc: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges inside the largest component (ties: smallest name)."""
    s = cc.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    giant = s.orderBy(F.col("size").desc(), "component").limit(1)
    members = cc.join(giant, "component", "left_semi").select("id")
    return edges.join(members.withColumnRenamed("id", "u"), "u", "left_semi") \
        .join(members.withColumnRenamed("id", "v"), "v", "left_semi")


def negative_edges(edges: DataFrame) -> DataFrame:
    """Negative-weight edges plus the minimum weight."""
    mn = edges.agg(F.min("weight")).scalar()
    return edges.filter(F.col("weight") < 0).withColumn("min_weight", mn)


def forest_views(comments: DataFrame, min_comments: int = 5) -> DataFrame:
    """Per thread (root name), top-level vs full comment counts for
    threads with at least ``min_comments`` comments."""
    t = comments.withColumn("thread", F.substring_index("name", "_", 1))
    g = t.groupBy("thread").agg(F.count(F.lit(1)).alias("n_all"),
                                F.count(F.when(F.col("depth") == 0, 1)).alias("n_top_level"))
    return g.filter(F.col("n_all") >= min_comments)
