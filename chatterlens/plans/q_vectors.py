"""Catalog: word/post vectors, sequences, tf-idf, concepts, vector similarity,
near duplicates and clustering (slice 6)."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans, PowerIterationClustering
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from ..functions.text import pad_truncate
from ..session import cut_lineage, stored
from ..operators import clusters as KC
from ..operators import similarity as S
from ..operators import terms
from ..operators.affinity import author_clusters
from ..operators.authors import EXCLUDED_AUTHORS
from ..operators import vectors as V
from ..sources.fixtures import posts_view, table
from .common import POSTS_CTE, Query, finalize, token_ctes, wrap_sql

MAX_FEATURES, MAXLEN, NCLUST = 40000, 20, 5   # the vocabulary size is a fixed value of the data model
REPOST_WIDTH, TRANSPORT_WIDTH = 200, 3


def _tok2(spark, sf, col="title", out="tokens"):
    """T02 tokens (no stop-word removal), the vector-training variant."""
    return terms.with_tokens(posts_view(spark, sf), col, out, stop_words=[])


def q_post_vectors(spark, sf):
    # tokens feed both the vocabulary and the post explode: write them once
    tok = cut_lineage(_tok2(spark, sf).select("id", "tokens"))
    pv = V.post_vectors(tok, V.rule_vectors(tok), V.VEC_DIM)
    return finalize(pv.select("id", F.posexplode("vector").alias("dim", "value")))


def q_embedding_matrix(spark, sf):
    tok = _tok2(spark, sf)
    m = V.embedding_matrix(V.frequency_vocabulary(tok, MAX_FEATURES), V.rule_vectors(tok, min_len=4), V.VEC_DIM)
    return finalize(m.select("idx", "word", *[F.col("vector")[i].alias(f"v{i}") for i in range(V.VEC_DIM)]))


def q_pooled_sequences(spark, sf):
    tok = stored(_tok2(spark, sf).select("id", "tokens"), "tokens")
    vocab = stored(V.frequency_vocabulary(tok, MAX_FEATURES), "vocabulary")
    m = stored(V.embedding_matrix(vocab, V.rule_vectors(tok, min_len=4), V.VEC_DIM), "matrix")
    seq = stored(V.encode_sequences(tok, vocab).withColumn("padded", pad_truncate("seq", MAXLEN)), "sequences")
    pooled = V.pooled_sequence_vectors(seq, m, MAXLEN, V.VEC_DIM)
    out = seq.join(pooled, "id").select(
        "id", F.array_join(F.transform("seq", lambda x: x.cast("string")), ",").alias("seq"),
        *[F.col("pooled")[i].alias(f"p{i}") for i in range(V.VEC_DIM)])
    return finalize(out)


def q_tfidf_top_terms(spark, sf):
    docs = table(spark, sf, "documents")
    t = V.tfidf(docs, "text", "doc_id")
    top = terms.top_k_by(t, ["doc_id"], 3, [F.col("tfidf").desc(), F.col("term")], "rk")
    return finalize(top.select("doc_id", "term", "tfidf", "rk"))


def _concept_tok(spark, sf):
    p = posts_view(spark, sf)
    p = terms.with_tokens(p, "title", "tok_title", stop_words=[])
    return stored(terms.with_tokens(p, "selftext", "tok_selftext", stop_words=[]).select("id", "tok_title", "tok_selftext"), "tokens")


def _rule_clusters(tok, cols=("tokens",)):
    words = None
    for c in cols:
        w = V.vocabulary_words(tok, c)
        words = w if words is None else words.unionByName(w)
    return V.rule_clusters(words.distinct(), NCLUST)


def q_concept_counts(spark, sf):
    tok = _concept_tok(spark, sf)
    cl = _rule_clusters(tok, ("tok_title", "tok_selftext"))
    return finalize(V.concept_counts(tok, cl, ["tok_title", "tok_selftext"], NCLUST))


def q_cluster_labels(spark, sf):
    tok = stored(_tok2(spark, sf).select("id", "tokens"), "tokens")
    lab = V.cluster_labels(tok, _rule_clusters(tok))
    return finalize(lab.select("id", F.array_join(F.transform("labels", lambda x: x.cast("string")), ",")
                               .alias("labels")))


def q_cluster_post_stats(spark, sf):
    tok = _tok2(spark, sf)
    return finalize(V.cluster_post_stats(tok, _rule_clusters(tok)))


def _emb(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"),
                                                 "label")


def q_similar_embeddings(spark, sf):
    s = V.similarity_to(_emb(spark, sf), "vec_id", "v", 0)
    return finalize(s.orderBy(F.col("similarity").desc(), "vec_id").limit(10))


def q_embedding_clusters(spark, sf):
    """K04-K06 with given labels: cluster sizes and the cluster of vector 0."""
    e = _emb(spark, sf)
    c0 = e.filter(F.col("vec_id") == 0).select("label").scalar()
    return finalize(e.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
                    .select("label", "n", (F.col("label") == c0).alias("has_vec0"), (F.col("n") == 1).alias("singleton")))


def q_repost_pairs(spark, sf):
    tok = terms.with_tokens(posts_view(spark, sf))
    return finalize(S.repost_pairs(tok, REPOST_WIDTH))


def q_neighbourhood_transport(spark, sf):
    tok = terms.with_tokens(posts_view(spark, sf))
    vecs = V.rule_vectors(_tok2(spark, sf))
    cl = stored(S.clouds(tok, vecs, weights="decaying"), "cloud-words")
    posts = tok.join(cl.select("id").distinct(), "id", "left_semi").select("id", "created_utc")
    pairs = S.neighbourhood_pairs(S.posting_order(posts), TRANSPORT_WIDTH)
    return finalize(S.relaxed_transport(pairs, cl))


def q_lsh_pairs(spark, sf):
    tok = terms.with_tokens(posts_view(spark, sf))
    return finalize(S.lsh_pairs(tok, 0.3))


def q_author_clouds(spark, sf):
    """Authors with more than 5 posts as word-frequency clouds."""
    tok = terms.with_tokens(posts_view(spark, sf))
    return finalize(KC.author_word_distribution(tok, min_posts=6))


def q_word2vec(spark, sf):
    tok = _tok2(spark, sf, "selftext")
    _, vecs = V.train_word2vec(tok, size=50, min_count=10, epochs=2)
    return vecs.select("word", F.size("vector").alias("dim"))


def q_word_kmeans(spark, sf):
    tok = _tok2(spark, sf, "selftext")
    _, vecs = V.train_word2vec(tok, size=50, min_count=10, epochs=2)
    return KC.kmeans_words(vecs, rough_size=50)


def q_max_cluster(spark, sf):
    e = _emb(spark, sf).select(F.col("vec_id").cast("string").alias("word"), F.col("v").alias("vector"))
    out = KC.max_clust(e, k=3, max_cluster_size=60)
    return out


def q_most_similar(spark, sf):
    tok = _tok2(spark, sf)
    return finalize(V.most_similar(V.rule_vectors(tok), ["the", "der"], ["und"], 10))


def q_pca_variance(spark, sf):
    e = _emb(spark, sf).select("vec_id", array_to_vector("v").alias("f"))
    return KC.pca_fraction(e, "f", 0.8)


def q_post_kmeans(spark, sf):
    tok = stored(_tok2(spark, sf).select("id", "tokens"), "tokens")
    pv = V.post_vectors(tok, V.rule_vectors(tok), V.VEC_DIM).join(
        posts_view(spark, sf).select("id", "ups"), "id").filter(F.col("ups") >= 50)
    feats = stored(pv.select("id", "vector"), "post-vectors").select("id", array_to_vector("vector").alias("features"))
    return KC.pca_kmeans(feats, k=4, n_components=2)


def q_pic_clusters(spark, sf):
    d = q_neighbourhood_transport(spark, sf)
    return KC.affinity_clusters(d, k=3)


def q_author_affinity(spark, sf):
    """Authors clustered by the rare words that they share."""
    tok = terms.with_tokens(posts_view(spark, sf)).filter(~F.col("author").isin(EXCLUDED_AUTHORS))
    return finalize(author_clusters(tok.select("author", "tokens"), k=4))


# ---------------------------------------------------------------- SQL twins
T2 = token_ctes(stop=False)
RULE = ("[CAST(length(word) AS DOUBLE), CAST(ascii(word) - 96 AS DOUBLE), CAST((length(word) * 7) % 5 AS DOUBLE), "
        "CAST(ascii(right(word, 1)) - 96 AS DOUBLE)]")
VL = f"""vocab AS (SELECT DISTINCT word FROM words WHERE length(word) >= 3),
vl AS (SELECT word, unnest(generate_series(0, 3)) AS d, unnest({RULE}) AS x FROM vocab)"""

SQL = {}
SQL["post_vectors"] = wrap_sql(f"""WITH {POSTS_CTE},
{T2}, {VL},
sm AS (SELECT w.id, w.sent_no, vl.d, avg(vl.x) AS m FROM words w JOIN vl ON vl.word = w.word GROUP BY 1, 2, 3),
ps AS (SELECT id, d, sum(m) AS v FROM sm GROUP BY 1, 2)
SELECT p.id, CAST(dims.d AS BIGINT) AS dim, coalesce(ps.v, 0.0) AS value
FROM tposts p CROSS JOIN (SELECT range AS d FROM range(4)) dims LEFT JOIN ps ON ps.id = p.id AND ps.d = dims.d""",
                               doubles=("value",))
VOCAB = f"""cnt AS (SELECT word, count(*) AS c FROM words GROUP BY word),
voc AS (SELECT word, CAST(row_number() OVER (ORDER BY c DESC, word) AS BIGINT) AS idx FROM
        (SELECT * FROM cnt ORDER BY c DESC, word LIMIT {MAX_FEATURES})),
mat AS (SELECT idx, word, CASE WHEN length(word) >= 4 THEN {RULE} ELSE [0.0, 0.0, 0.0, 0.0] END AS v FROM voc
        UNION ALL SELECT 0, NULL, [0.0, 0.0, 0.0, 0.0])"""
SQL["embedding_matrix"] = wrap_sql(f"""WITH {POSTS_CTE},
{T2}, {VOCAB}
SELECT idx, word, v[1] AS v0, v[2] AS v1, v[3] AS v2, v[4] AS v3 FROM mat""", doubles=("v0", "v1", "v2", "v3"))
SQL["pooled_sequences"] = wrap_sql(f"""WITH {POSTS_CTE},
{T2}, {VOCAB},
sq AS (SELECT p.id, coalesce(list(v.idx ORDER BY w.sent_no, w.w_no) FILTER (WHERE v.idx IS NOT NULL), []::BIGINT[]) AS seq
       FROM tposts p LEFT JOIN words w ON w.id = p.id LEFT JOIN voc v ON v.word = w.word GROUP BY p.id),
kp AS (SELECT id, seq, list_slice(seq, greatest(len(seq) - {MAXLEN - 1}, 1), len(seq)) AS kept FROM sq),
pd AS (SELECT id, seq, list_concat(list_resize([]::BIGINT[], {MAXLEN} - len(kept), 0), kept) AS padded FROM kp),
ex AS (SELECT id, unnest(padded) AS idx FROM pd),
pl AS (SELECT ex.id, sum(m.v[1]) / {MAXLEN} AS p0, sum(m.v[2]) / {MAXLEN} AS p1, sum(m.v[3]) / {MAXLEN} AS p2,
              sum(m.v[4]) / {MAXLEN} AS p3 FROM ex JOIN mat m ON m.idx = ex.idx GROUP BY ex.id)
SELECT pd.id, array_to_string(seq, ',') AS seq, p0, p1, p2, p3 FROM pd JOIN pl ON pl.id = pd.id""",
                                   doubles=("p0", "p1", "p2", "p3"))
SQL["tfidf_top_terms"] = wrap_sql(f"""WITH
tc AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{V.WORD_RE}')) AS term
       FROM documents) GROUP BY 1, 2),
nn AS (SELECT count(*) AS n FROM documents),
df AS (SELECT term, count(*) AS df FROM tc GROUP BY term),
w AS (SELECT tc.doc_id, tc.term, tc.tf * (ln((1.0 + n) / (1.0 + df)) + 1) AS w FROM tc JOIN df ON df.term = tc.term, nn),
nr AS (SELECT doc_id, sqrt(sum(w * w)) AS nrm FROM w GROUP BY doc_id),
t AS (SELECT w.doc_id, w.term, w.w / nr.nrm AS tfidf FROM w JOIN nr ON nr.doc_id = w.doc_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY tfidf DESC, term) AS BIGINT) AS rk FROM t)
SELECT doc_id, term, tfidf, rk FROM r WHERE rk <= 3""", doubles=("tfidf",))
_TT = token_ctes(text_col="title", keep="id", prefix="t_", stop=False)
_TS = token_ctes(text_col="selftext", keep="id", prefix="s_", stop=False)
_CL = f"""cw AS (SELECT DISTINCT word FROM (SELECT word FROM t_words UNION ALL SELECT word FROM s_words)),
cl AS (SELECT word, ascii(word) % {NCLUST} AS cluster FROM cw)"""
SQL["concept_counts"] = f"""WITH {POSTS_CTE},
{_TT}, {_TS}, {_CL},
tc AS (SELECT t.id, c.cluster FROM t_words t JOIN cl c ON c.word = t.word),
sc AS (SELECT s.id, c.cluster FROM s_words s JOIN cl c ON c.word = s.word)
SELECT p.id, {', '.join(f"(SELECT count(*) FROM tc WHERE tc.id = p.id AND tc.cluster = {i}) AS tok_title_cluster_{i}_counts" for i in range(NCLUST))},
       {', '.join(f"(SELECT count(*) FROM sc WHERE sc.id = p.id AND sc.cluster = {i}) AS tok_selftext_cluster_{i}_counts" for i in range(NCLUST))}
FROM tposts p"""
SQL["cluster_labels"] = f"""WITH {POSTS_CTE},
{T2}, cl AS (SELECT DISTINCT word, ascii(word) % {NCLUST} AS cluster FROM words)
SELECT w.id, array_to_string(list(c.cluster ORDER BY w.sent_no, w.w_no), ',') AS labels
FROM words w JOIN cl c ON c.word = w.word GROUP BY w.id"""
SQL["cluster_post_stats"] = wrap_sql(f"""WITH {POSTS_CTE},
{T2}, cl AS (SELECT DISTINCT word, ascii(word) % {NCLUST} AS cluster FROM words),
pc AS (SELECT DISTINCT w.id, w.ups, c.cluster FROM words w JOIN cl c ON c.word = w.word)
SELECT CAST(cluster AS BIGINT) AS cluster, count(*) AS posts, avg(ups) AS mean, median(ups) AS median,
       var_pop(ups) AS var_pop FROM pc GROUP BY cluster""", doubles=("mean", "median", "var_pop"))
SQL["similar_embeddings"] = wrap_sql("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
t AS (SELECT v AS tv FROM e WHERE vec_id = 0)
SELECT vec_id, list_dot_product(v, tv) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(tv, tv))) AS similarity
FROM e, t ORDER BY similarity DESC, vec_id LIMIT 10""", doubles=("similarity",))
SQL["embedding_clusters"] = """SELECT CAST(label AS BIGINT) AS label, count(*) AS n,
  label = (SELECT label FROM embeddings WHERE vec_id = 0) AS has_vec0, count(*) = 1 AS singleton
FROM embeddings GROUP BY label"""
SQL["repost_pairs"] = f"""WITH {POSTS_CTE},
{token_ctes()},
sg AS (SELECT id, array_to_string(list_sort(list(word)), ' ') AS sig FROM words GROUP BY id),
o AS (SELECT p.id, sg.sig, row_number() OVER (ORDER BY p.created_utc, p.id) - 1 AS pos
      FROM tposts p JOIN sg ON sg.id = p.id)
SELECT a.id AS id_a, b.id AS id_b, CAST(a.pos AS BIGINT) AS pos_a, CAST(b.pos AS BIGINT) AS pos_b
FROM o a JOIN o b ON a.sig = b.sig AND b.pos > a.pos AND b.pos - a.pos <= {REPOST_WIDTH}"""
SQL["neighbourhood_transport"] = wrap_sql(f"""WITH {POSTS_CTE},
{token_ctes(stop=False, prefix='x')},
vocab AS (SELECT DISTINCT word FROM xwords WHERE length(word) >= 3),
{token_ctes()},
cl AS (SELECT w.id, row_number() OVER (PARTITION BY w.id ORDER BY w.sent_no, w.w_no) - 1 AS p, w.word
       FROM words w JOIN vocab v ON v.word = w.word),
clw AS (SELECT id, p, {RULE} AS vec, (1.0 / (p + 1)) / sum(1.0 / (p + 1)) OVER (PARTITION BY id) AS w FROM cl),
o AS (SELECT id, row_number() OVER (ORDER BY created_utc, id) - 1 AS pos FROM tposts WHERE id IN (SELECT id FROM cl)),
pairs AS (SELECT a.id AS id_a, b.id AS id_b FROM o a JOIN o b ON b.pos > a.pos AND b.pos - a.pos <= {TRANSPORT_WIDTH}),
x AS (SELECT pr.id_a, pr.id_b, a.p AS pa, b.p AS pb, a.w AS wa, b.w AS wb,
             0.0 + (a.vec[1] - b.vec[1]) ^ 2 + (a.vec[2] - b.vec[2]) ^ 2 + (a.vec[3] - b.vec[3]) ^ 2
                 + (a.vec[4] - b.vec[4]) ^ 2 AS c
      FROM pairs pr JOIN clw a ON a.id = pr.id_a JOIN clw b ON b.id = pr.id_b),
x2 AS (SELECT *, CASE WHEN max(c) OVER (PARTITION BY id_a, id_b) > 0 THEN c / max(c) OVER (PARTITION BY id_a, id_b)
                      ELSE 0.0 END AS cn FROM x),
ra AS (SELECT id_a, id_b, pa, min(cn) AS m, any_value(wa) AS w FROM x2 GROUP BY 1, 2, 3),
rb AS (SELECT id_a, id_b, pb, min(cn) AS m, any_value(wb) AS w FROM x2 GROUP BY 1, 2, 3),
sa AS (SELECT id_a, id_b, sum(w * m) AS la FROM ra GROUP BY 1, 2),
sb AS (SELECT id_a, id_b, sum(w * m) AS lb FROM rb GROUP BY 1, 2)
SELECT sa.id_a, sa.id_b, greatest(la, lb) AS distance FROM sa JOIN sb ON sb.id_a = sa.id_a AND sb.id_b = sa.id_b""",
                                          doubles=("distance",))

_ids = {
    "post_vectors": ("E02",), "embedding_matrix": ("E05", "T12"), "pooled_sequences": ("T12", "T13", "E06"),
    "tfidf_top_terms": ("E07", "E08"), "concept_counts": ("E12", "E16"), "cluster_labels": ("E13", "J09"),
    "cluster_post_stats": ("A31", "K05"), "similar_embeddings": ("X01", "M11"),
    "embedding_clusters": ("K04", "K06"), "repost_pairs": ("X06", "J10"),
    "neighbourhood_transport": ("J10", "X02", "X03", "M10"), "lsh_pairs": ("X07",), "author_clouds": ("X08",),
    "word2vec": ("E01",), "word_kmeans": ("K01", "E17"), "max_cluster": ("K03",), "most_similar": ("E03", "E04"),
    "pca_variance": ("E11", "E14"), "post_kmeans": ("K02", "K08"), "pic_clusters": ("K07", "M12"), "author_affinity": ("K07",),
}

QUERIES = [Query(n, globals()[f"q_{n}"], SQL.get(n), _ids[n]) for n in _ids]
