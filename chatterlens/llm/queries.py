"""Queries of the training-data operators, each over its whole table, with the
SQL twins of those that SQL can express."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, common, decontam, fixity, licenses, pieces, quality, sharding, shallot, simhash, topk, toxicity, trie, urls


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a test item, with item, score and place."""
    return decontam.contaminated(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(common.table(spark, sf_dir, "documents"), width=3, max_bits=3)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(common.table(spark, sf_dir, "pages"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every text and whether they decode to it."""
    common.small_batches(spark)
    docs = common.table(spark, sf_dir, "documents")
    return docs.select("doc_id", pieces.encode_column("text").alias("e")).select(
        "doc_id", F.col("e.ids").alias("ids"), F.when(F.col("e.ids").isNotNull(), F.size("e.ids")).alias("n_pieces"), F.col("e.lossless").alias("lossless"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = topk.integer_vectors(common.table(spark, sf_dir, "embeddings"))
    return topk.top_k(data, "vec_id % 50 = 0", k=5)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit of the archive of all pages against a replica that Spark derives from
    it: of some records a byte is changed, some are cut short, some are gone."""
    pid = F.col("page_id")
    first = F.when(F.substring("html", 1, 1) == "#", "%").otherwise("#")
    damaged = (F.when(pid % 97 == 13, F.concat(first, F.substring("html", 2, 2_000_000_000)))
               .when(pid % 193 == 57, F.substring("html", 1, 40)).otherwise(F.col("html")))
    gone = F.coalesce(pid % 389 == 101, F.lit(False))
    again = F.sha2(fixity.record(pid, F.col("url"), damaged), 256)
    index = fixity.archive(common.table(spark, sf_dir, "pages"), {"copy": again, "gone": gone})
    replica = index.where("NOT gone").select("idx", F.col("copy").alias("hash"))
    return fixity.audit(index, replica)


def op9_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = chat.format_preferences(*chat.answer_pairs(common.table(spark, sf_dir, "conversations")))

    def flat(c):
        return F.concat_ws(",", F.transform(c, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))))

    return made.withColumn("chosen_spans", flat(F.col("chosen_spans"))).withColumn("rejected_spans", flat(F.col("rejected_spans")))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(common.table(spark, sf_dir, "documents"), 40)


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices of every whole text, exact and with a few edits."""
    common.small_batches(spark)
    return licenses.scan_licenses(common.table(spark, sf_dir, "documents"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shallot.k_means(shallot.integer_vectors(common.table(spark, sf_dir, "embeddings"), scale=1024, size=64), k=8, rounds=10, seed="3")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.conversation_trie(common.table(spark, sf_dir, "conversations"), group=5, spread=9)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_decontamination, op2_simhash, op3_quality, op4_urls, op5_sentencepiece, op6_topk, op7_toxicity, op8_warc,
    op9_preferences, op10_sharding, op11_licenses, op12_centroids, op13_prefix_trie, pipeline)}


def _rounds_sql(k: int, rounds: int) -> str:
    """k-means in whole numbers: a CTE for each round."""
    distance = "CAST(list_sum(list_transform(list_zip(v.v, c.m), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"
    out = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND list_count(embedding) = 64 AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || CAST(vec_id AS VARCHAR)) NULLS LAST, v) - 1 AS c, v AS m FROM v QUALIFY c < {k}),"""
    for r in range(rounds + 1):
        out += f"""
d{r} AS MATERIALIZED (SELECT n, any_value(vec_id) AS vec_id, arg_min(c, (d, c)) AS c, min(d) AS d
  FROM (SELECT v.n, v.vec_id, c.c, {distance} AS d FROM v CROSS JOIN c{r} c) GROUP BY n),"""
        if r < rounds:
            out += f"""
s{r} AS (SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS w
  FROM (SELECT d{r}.c, unnest(range(64)) AS i, unnest(v.v) AS x FROM v JOIN d{r} USING (n)) GROUP BY c, i),
c{r + 1} AS MATERIALIZED (SELECT c{r}.c, coalesce(f.m, c{r}.m) AS m FROM c{r} LEFT JOIN
  (SELECT c, list((s - ((s % w) + w) % w) // w ORDER BY i) AS m FROM s{r} GROUP BY c) f USING (c)),"""
    return out + f"""
t AS (SELECT c, CAST(sum(d) AS BIGINT) AS s FROM d{rounds} GROUP BY c)
SELECT vec_id, CAST(d.c AS INTEGER) AS cluster, d AS distance, t.s AS cluster_inertia, (SELECT CAST(sum(s) AS BIGINT) FROM t) AS inertia,
  sha256(array_to_string(m, ',')) AS centroid_sha256
FROM d{rounds} d JOIN t ON t.c = d.c JOIN c{rounds} c ON c.c = d.c"""


#: CRC-32 of a string of ASCII characters: eight steps for each, the first with its code.
_CRC32 = """xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(string_split({}, ''),
  lambda ch: [CAST(ord(ch) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))), lambda c, b: xor(xor(c, b) >> 1, (xor(c, b) & 1) * 3988292384)), CAST(4294967295 AS BIGINT))"""

SQL = {
    "op12_centroids": _rounds_sql(8, 10),
    "op13_prefix_trie": f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS MATERIALIZED (SELECT conv_id, list({{'r': role, 't': text}} ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) AS own,
  {_CRC32.format('CAST(conv_id AS VARCHAR)')} % 9 AS h FROM t GROUP BY conv_id),
r AS MATERIALIZED (SELECT o.conv_id, list_concat(coalesce(b.own[1:o.h], []), o.own[o.h + 1:]) AS p
  FROM o LEFT JOIN o b ON b.conv_id = o.conv_id - o.conv_id % 5),
m AS MATERIALIZED (SELECT conv_id, d AS depth, sha256(CAST(p[1:d] AS VARCHAR)) AS k, CASE WHEN d > 0 THEN sha256(CAST(p[1:d - 1] AS VARCHAR)) END AS up,
  d = len(p) AS last, CASE WHEN d > 0 THEN strlen(p[d].t) ELSE 0 END AS size FROM (SELECT *, unnest(range(len(p) + 1)) AS d FROM r)),
n AS MATERIALIZED (SELECT k, depth, min(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, min(size) AS size,
  sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256 FROM m GROUP BY k, depth),
c AS (SELECT up AS k, depth - 1 AS depth, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
f AS MATERIALIZED (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN c USING (k, depth)),
s AS (SELECT a.k, a.depth, sum(CASE WHEN f.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((f.n_convs - 1) * f.size) AS saved_tokens
  FROM f JOIN m a ON a.conv_id = f.conv_id AND a.depth <= f.depth GROUP BY ALL)
SELECT f.conv_id, CAST(f.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children,
  CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, f.ends_sha256
FROM f JOIN s USING (k, depth) LEFT JOIN n p ON p.k = f.up AND p.depth = f.depth - 1""",
    "op6_topk": """
WITH v AS (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND list_count(embedding) = len(embedding) AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0),
s AS (
  SELECT q.n AS q, q.vec_id AS query_id, d.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, d.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id % 50 = 0 AND d.n <> q.n),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS place FROM s)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM r WHERE place <= 5""",
    "op8_warc": """
WITH p AS (
  SELECT page_id, coalesce(url, '') AS u, coalesce(html, '') AS h,
    CASE WHEN page_id % 97 = 13 THEN (CASE WHEN substr(html, 1, 1) = '#' THEN '%' ELSE '#' END) || substr(html, 2)
         WHEN page_id % 193 = 57 THEN substr(html, 1, 40) ELSE coalesce(html, '') END AS h2 FROM pages),
b AS (
  SELECT page_id, u, page_id % 389 = 101 AS gone,
    'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), '')
      || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || u || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' AS head,
    chr(13) || chr(10) || chr(13) || chr(10) AS gap, h, h2 FROM p),
r AS (
  SELECT page_id, u, gone, strlen(head || CAST(strlen(h) AS VARCHAR) || gap || h || gap) AS length,
    sha256(head || CAST(strlen(h) AS VARCHAR) || gap || h || gap) AS hash,
    sha256(head || CAST(strlen(h2) AS VARCHAR) || gap || h2 || gap) AS copy FROM b),
i AS (SELECT *, row_number() OVER (ORDER BY page_id NULLS FIRST, u, hash) - 1 AS idx FROM r),
o AS (SELECT *, idx // 1000 AS file, coalesce(sum(length) OVER (PARTITION BY idx // 1000 ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS "offset" FROM i)
SELECT page_id, CAST(file AS BIGINT) AS file, CAST("offset" AS BIGINT) AS "offset", CAST(length AS BIGINT) AS length,
  CASE WHEN gone THEN 'missing' ELSE 'changed' END AS kind, hash, CASE WHEN NOT gone THEN copy END AS replica_hash
FROM o WHERE gone OR hash <> copy""",
    "op9_preferences": """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
l AS (SELECT conv_id, max(turn) AS last, arg_max(text, turn) AS answer FROM t WHERE role = 'assistant' GROUP BY conv_id),
k AS (SELECT l.conv_id, l.last, o.answer AS swap FROM l JOIN l o ON o.conv_id = xor(l.conv_id, 1)),
b AS (SELECT t.conv_id, t.turn, t.role, t.text AS c, CASE WHEN t.turn = k.last THEN k.swap ELSE t.text END AS r FROM t LEFT JOIN k USING (conv_id)),
s AS (SELECT *, min(CASE WHEN c <> r THEN turn END) OVER (PARTITION BY conv_id) AS split FROM b),
f AS (SELECT conv_id, turn, role, split IS NULL OR turn < split AS common,
  '<|im_start|>' || role || chr(10) || c || '<|im_end|>' || chr(10) AS ct, '<|im_start|>' || role || chr(10) || r || '<|im_end|>' || chr(10) AS rt FROM s),
g AS (SELECT *, sum(CASE WHEN common THEN 0 ELSE length(ct) END) OVER w AS ce, sum(CASE WHEN common THEN 0 ELSE length(rt) END) OVER w AS re FROM f WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id AS pair_id, CAST(turn // 256 AS BIGINT) AS chunk,
  coalesce(string_agg(ct, '' ORDER BY turn) FILTER (common), '') AS prompt, CAST(count(*) FILTER (common) AS BIGINT) AS prompt_turns,
  coalesce(string_agg(ct, '' ORDER BY turn) FILTER (NOT common), '') AS chosen,
  coalesce(string_agg(CAST(ce - length(ct) + 22 AS BIGINT) || '-' || CAST(ce - 1 AS BIGINT), ',' ORDER BY turn) FILTER (NOT common AND role = 'assistant'), '') AS chosen_spans,
  coalesce(string_agg(rt, '' ORDER BY turn) FILTER (NOT common), '') AS rejected,
  coalesce(string_agg(CAST(re - length(rt) + 22 AS BIGINT) || '-' || CAST(re - 1 AS BIGINT), ',' ORDER BY turn) FILTER (NOT common AND role = 'assistant'), '') AS rejected_spans
FROM g GROUP BY conv_id, turn // 256""",
}
