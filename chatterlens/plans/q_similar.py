"""Catalog: exact set-similarity joins, exact transport, the content-addressed cache
and the row cap."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import setjoin, similarity, terms, transport
from ..operators import vectors as V
from ..session import scratch_path
from ..sources import cache
from ..sources.fixtures import posts_view, table
from .common import POSTS_CTE, Query, finalize, token_ctes, wrap_sql

MIN_JACCARD = 0.5
N_ROWS = 700
#: Words of a cloud, pairs' distance in posting order, and largest transport distance.
CUT_OFF, WIDTH, RADIUS = 8, 3, 0.35


def _sets(spark, sf, column):
    return setjoin.distinct_sets(terms.with_tokens(posts_view(spark, sf), column))


def q_similar_titles(spark, sf):
    """All pairs of distinct title word sets with Jaccard similarity of 0.5 or more."""
    return finalize(setjoin.set_similarity_pairs(_sets(spark, sf, "title"), MIN_JACCARD))


def q_similar_bodies(spark, sf):
    """The same over whole bodies, at 0.8."""
    return finalize(setjoin.set_similarity_pairs(_sets(spark, sf, "selftext"), 0.8))


def q_lsh_bodies(spark, sf):
    """Banded minimum hashes over whole bodies, Jaccard distance below 0.5."""
    return finalize(setjoin.lsh_pairs(_sets(spark, sf, "selftext"), 0.5))


def _transport_parts(spark, sf, column):
    posts = posts_view(spark, sf)
    tok = terms.with_tokens(posts, column)
    vecs = V.rule_vectors(terms.with_tokens(posts, column, stop_words=[]))
    cl = similarity.clouds(tok, vecs, cut_off=CUT_OFF, weights="decaying", step=0.5, shift=1.0)
    order = similarity.posting_order(posts.select("id", "created_utc"))
    return similarity.neighbourhood_pairs(order, WIDTH), cl


def q_exact_transport(spark, sf):
    """Exact transport distances of titles close in posting order, up to a radius."""
    pairs, cl = _transport_parts(spark, sf, "title")
    return finalize(transport.transport_within(pairs, cl, RADIUS))


def q_exact_transport_bodies(spark, sf):
    """The same for the first words of bodies."""
    pairs, cl = _transport_parts(spark, sf, "selftext")
    return finalize(transport.transport_within(pairs, cl, RADIUS))


def q_content_cache(spark, sf):
    """Token counts of all posts through the content-addressed cache, computed in the
    first pass and read in the second."""
    base = scratch_path(spark, "content-cache")
    d = table(spark, sf, "documents")
    tok = d.select("doc_id", F.size(F.split(F.coalesce("text", F.lit("")), " ")).alias("n_words"), F.md5("text").alias("text_md5"))
    cache.cached(tok, base)
    return finalize(cache.cached(tok, base))


def q_first_rows(spark, sf):
    """The first rows of ``documents`` in file order."""
    return finalize(cache.first_rows(spark, f"{sf}/documents.parquet", N_ROWS, ["doc_id", "source", "n_chars"]))


def _pairs_sql(column, t):
    return wrap_sql(f"""WITH {POSTS_CTE},
{token_ctes(text_col=column)},
w AS (SELECT id, list_sort(list_distinct(list(word))) AS words FROM words GROUP BY id),
s AS (SELECT min(id) AS rep, CAST(count(*) AS BIGINT) AS members, words FROM w GROUP BY words),
j AS (SELECT a.rep AS rep_a, b.rep AS rep_b, len(list_intersect(a.words, b.words)) AS shared, len(a.words) + len(b.words) AS total,
        a.members AS members_a, b.members AS members_b
      FROM s a JOIN s b ON a.rep < b.rep AND len(a.words) >= {t} * len(b.words) AND len(b.words) >= {t} * len(a.words))
SELECT rep_a, rep_b, shared / (total - shared) AS jaccard, members_a, members_b FROM j WHERE shared >= {t} * (total - shared)""", doubles=("jaccard",))


SQL = {
    "similar_titles": _pairs_sql("title", "CAST(0.5 AS DECIMAL(3, 1))"),
    "similar_bodies": _pairs_sql("selftext", "CAST(0.8 AS DECIMAL(3, 1))"),
    "content_cache": "SELECT doc_id, CAST(len(string_split(coalesce(text, ''), ' ')) AS BIGINT) AS n_words, md5(text) AS text_md5 FROM documents",
    "first_rows": f"SELECT doc_id, source, CAST(n_chars AS BIGINT) AS n_chars FROM documents LIMIT {N_ROWS}",
}

_ids = {"similar_titles": ("X07",), "similar_bodies": ("X07",), "lsh_bodies": ("X07",), "exact_transport": ("X02", "X03", "M10"),
        "exact_transport_bodies": ("X02", "X03", "M10"), "content_cache": ("S06",), "first_rows": ("S02",)}

QUERIES = [Query(n, globals()[f"q_{n}"], SQL.get(n), _ids[n]) for n in _ids]
