"""Catalog: reply graph (slice 7)."""

from __future__ import annotations

from ..operators import graph as G
from ..sources.fixtures import comments_view, pooled_comments_view
from .common import COMMENTS_CTE, Query, finalize


def _cc(spark, sf):
    c = comments_view(spark, sf)
    e = G.reply_edges(c)
    return G.connected_components(G.vertices(c), e), e


def q_comment_parents(spark, sf):
    return finalize(G.with_parent_author(comments_view(spark, sf)).select("name", "author", "author_parent"))


def q_reply_edges(spark, sf):
    return finalize(G.reply_edges(comments_view(spark, sf)))


def q_graph_vertices(spark, sf):
    return finalize(G.vertices(comments_view(spark, sf)))


def q_connected_components(spark, sf):
    cc, _ = _cc(spark, sf)
    return finalize(cc)


def q_component_sizes(spark, sf):
    cc, _ = _cc(spark, sf)
    return finalize(G.component_sizes(cc))


def q_giant_component_edges(spark, sf):
    cc, e = _cc(spark, sf)
    return finalize(G.giant_component_edges(cc, e))


def q_negative_edges(spark, sf):
    cc, e = _cc(spark, sf)
    return finalize(G.negative_edges(G.giant_component_edges(cc, e)))


def _pooled(spark, sf):
    c = pooled_comments_view(spark, sf)
    e = G.reply_edges(c)
    return G.connected_components(G.vertices(c), e), e


def q_forum_components(spark, sf):
    """Components of a reply graph that falls into several."""
    return finalize(_pooled(spark, sf)[0])


def q_forum_component_sizes(spark, sf):
    return finalize(G.component_sizes(_pooled(spark, sf)[0]))


def q_forum_negative_edges(spark, sf):
    """Edges of negative weight in the largest of several components."""
    cc, e = _pooled(spark, sf)
    return finalize(G.negative_edges(G.giant_component_edges(cc, e)))


def q_forest_views(spark, sf):
    return finalize(G.forest_views(comments_view(spark, sf), 5))


W = f"WITH {COMMENTS_CTE}"
PAR = """cp AS (SELECT c.*, p.author AS author_parent FROM comments c LEFT JOIN comments p ON p.name = c.parent_id)"""
EDGES = f"""{PAR},
edges AS (SELECT least(author, author_parent) AS u, greatest(author, author_parent) AS v,
                 CAST(sum(score) AS BIGINT) AS weight, count(*) AS replies
          FROM cp WHERE depth <> 0 AND author_parent IS NOT NULL GROUP BY 1, 2)"""
CC = f"""{EDGES},
verts AS (SELECT DISTINCT author AS id FROM comments WHERE author IS NOT NULL),
und AS (SELECT u AS a, v AS b FROM edges WHERE u <> v UNION SELECT v, u FROM edges WHERE u <> v),
reach(id, comp) AS (SELECT id, id FROM verts UNION SELECT und.b, reach.comp FROM reach JOIN und ON und.a = reach.id),
cc AS (SELECT id, min(comp) AS component FROM reach GROUP BY id),
sizes AS (SELECT component, count(*) AS size FROM cc GROUP BY component),
giant AS (SELECT component FROM sizes ORDER BY size DESC, component LIMIT 1),
gm AS (SELECT id FROM cc WHERE component IN (SELECT component FROM giant)),
ge AS (SELECT * FROM edges WHERE u IN (SELECT id FROM gm) AND v IN (SELECT id FROM gm))"""
SQL = {
    "comment_parents": f"{W}, {PAR} SELECT name, author, author_parent FROM cp",
    "reply_edges": f"{W}, {EDGES} SELECT * FROM edges",
    "graph_vertices": f"{W} SELECT DISTINCT author AS id FROM comments WHERE author IS NOT NULL",
    "connected_components": f"WITH RECURSIVE {COMMENTS_CTE}, {CC} SELECT * FROM cc",
    "component_sizes": f"""WITH RECURSIVE {COMMENTS_CTE}, {CC}
SELECT size, count(*) AS n_components FROM sizes GROUP BY size""",
    "giant_component_edges": f"WITH RECURSIVE {COMMENTS_CTE}, {CC} SELECT * FROM ge",
    "negative_edges": f"""WITH RECURSIVE {COMMENTS_CTE}, {CC}
SELECT *, (SELECT min(weight) FROM ge) AS min_weight FROM ge WHERE weight < 0""",
    "forest_views": f"""{W} SELECT split_part(name, '_', 1) AS thread, count(*) AS n_all,
count(*) FILTER (WHERE depth = 0) AS n_top_level FROM comments GROUP BY 1 HAVING count(*) >= 5""",
}

_POOLED = COMMENTS_CTE.replace("'a' || CAST((conv_id * 7 + turn * 3) % 97 AS VARCHAR)",
                               "'f' || CAST(conv_id % 7 AS VARCHAR) || '_' || CAST((conv_id * 7 + turn * 3) % (13 + conv_id % 7) AS VARCHAR)") \
    .replace("% 41 - 10", "% 41 - 25")
for _name, _of in (("forum_components", "connected_components"), ("forum_component_sizes", "component_sizes"), ("forum_negative_edges", "negative_edges")):
    SQL[_name] = SQL[_of].replace(COMMENTS_CTE, _POOLED)

_ids = {
    "forum_components": ("G03",), "forum_component_sizes": ("G03", "G04"), "forum_negative_edges": ("G04", "G05"),
    "comment_parents": ("J07",), "reply_edges": ("G01",), "graph_vertices": ("G02",),
    "connected_components": ("G03",), "component_sizes": ("G03",), "giant_component_edges": ("G04",),
    "negative_edges": ("G05",), "forest_views": ("G06",),
}

QUERIES = [Query(n, globals()[f"q_{n}"], SQL.get(n), _ids[n]) for n in _ids]
