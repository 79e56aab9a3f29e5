"""Authors clustered by the rare words that they share.

The affinity of two authors is the sum, over the words both use, of the squared weights
of a word, normalised by both authors' totals.  It is never written as a table of pairs:
with B the author x word matrix of weights, scaled by the square roots of its row and
column sums, the affinity matrix is B times its transpose, and multiplying a block of
vectors by it takes two joins with the (author, word) table.  A word's weight is
``ln(authors / authors of the word)``: rare words count most and a word of all authors
nothing, so no cut of frequent words is needed.  A word of one author links no two and
is left out.

The leading vectors come from orthogonal iteration: multiply, take the products of all
columns as sums (a small square matrix, the only thing that the driver gets), make the
columns orthonormal, until what the affinity does to the block no longer changes.
k-means on the vectors, scaled to length one for each author, gives the clusters.

A product costs one shuffle of sums by author.  The (author, word) table is dealt and
sorted by word once, under numbers for names, and keeps that layout in its checkpoint, so
a round's sums by word and their way back to the authors stay where the words lie; a word
has at most one row for each author.  The products of the columns come with the write.

Defined cases: null authors and null or empty token lists take no part; authors without
a shared word form no links and get a null cluster; an empty table gives no row.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..session import cut_lineage, scratch_path

#: Relative change of the block's image at which the iteration has converged.
TOLERANCE = 1e-4


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def author_words(tok: DataFrame, tokens_col: str = "tokens") -> DataFrame:
    """``(author, word, w)``: scaled weights of the words that two or more authors use."""
    pairs = _stored(tok.filter(F.col("author").isNotNull()).select("author", F.explode(F.flatten(tokens_col)).alias("word"))
                    .filter(F.col("word").isNotNull()).distinct(), "author-words")
    n = pairs.select(F.count_distinct("author")).scalar()
    words = _stored(pairs.groupBy("word").agg(F.count(F.lit(1)).alias("df")).select("word", "df", F.ln(n / F.col("df")).alias("x"))
                    .filter("df > 1 AND x > 0").withColumn("total", F.col("df") * F.col("x")), "word-weights")
    w = _stored(pairs.join(words, "word").select("author", "word", "x", "total"), "weights")
    rows = _stored(w.groupBy("author").agg(F.sum("x").alias("sum")), "author-sums")
    return _stored(w.join(rows, "author").select("author", "word", (F.col("x") / F.sqrt(F.col("total") * F.col("sum"))).alias("w")), "affinity")


def _sums(k: int) -> Column:
    # one SQL text: a Column for each number costs a round more than its jobs do
    return F.expr(f"array({', '.join(f'sum(w * y[{i}])' for i in range(k))})")


def _multiplied(edges: DataFrame, block: DataFrame, k: int) -> DataFrame:
    """The affinity matrix times ``block(a, y)``."""
    words = edges.join(block, "a").groupBy("b").agg(_sums(k).alias("y"))
    return edges.join(words, "b").groupBy("a").agg(_sums(k).alias("y"))


def _block(rows: DataFrame, k: int) -> tuple[DataFrame, np.ndarray]:
    """``rows(a, y)`` stored, and the products of all pairs of columns: k x k sums."""
    at, seen = [(i, j) for i in range(k) for j in range(i + 1)], Observation()
    block = _stored(rows.observe(seen, *(F.expr(f"sum(y[{i}] * y[{j}]) AS `{i}_{j}`") for i, j in at)), "author-block")
    out = np.zeros((k, k))
    for i, j in at:
        out[i, j] = out[j, i] = seen.get[f"{i}_{j}"] or 0.0
    return block, out


def _numbered(edges: DataFrame, name: str, number: str) -> DataFrame:
    return _stored(edges.select(name).distinct().withColumn(number, F.monotonically_increasing_id()), f"{name}-numbers")


def _times(m: np.ndarray) -> Column:
    """Column ``y`` (a row vector) times a small matrix."""
    column = lambda j: " + ".join(f"y[{i}] * ({float(m[i, j])!r}D)" for i in range(m.shape[0]))
    return F.expr(f"array({', '.join(column(j) for j in range(m.shape[1]))})")


def _dealt(edges: DataFrame) -> DataFrame:
    """``edges`` in a checkpoint that is dealt and sorted by word.  A plan tells its layout
    only where adaptive execution does not change it."""
    conf = edges.sparkSession.conf
    tasks, adaptive = int(conf.get("spark.sql.shuffle.partitions")), conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return cut_lineage(edges.repartition(tasks, "b").sortWithinPartitions("b"))
    finally:
        conf.set("spark.sql.adaptive.enabled", adaptive)


def leading_vectors(edges: DataFrame, k: int, extra: int = 3, seed: int = 42) -> tuple[DataFrame, list[float]]:
    """``(author, y)`` with the ``k`` leading vectors of the affinity matrix and their
    values, largest first.  ``extra`` further columns make the others converge faster."""
    size = k + extra
    # the start depends on the author's name alone, so on no partitioning
    start = F.array(*(F.pmod(F.xxhash64("author", F.lit(seed + i)), F.lit(2001)) / 1000.0 - 1.0 for i in range(size)))
    authors, words = _numbered(edges, "author", "a"), _numbered(edges, "word", "b")
    edges = _dealt(_stored(edges.join(authors, "author").join(words, "word").select("a", "b", "w"), "numbered"))
    block, gram = _block(authors.select("a", start.alias("y")), size)
    before = None
    while True:
        # the columns made orthonormal; a direction without length falls out
        values, turn = np.linalg.eigh(gram)
        keep = values > 1e-12 * max(values[-1], 1e-300)
        block = block.withColumn("y", _times(turn[:, keep] / np.sqrt(values[keep])))
        size = int(keep.sum())
        block, gram = _block(_multiplied(edges, block, size), size)
        now = np.sort(np.sqrt(np.maximum(np.linalg.eigvalsh(gram), 0)))[::-1][:k]
        if before is not None and len(now) == len(before) and np.abs(now - before).max() <= TOLERANCE * now[0]:
            break
        before = now
    values, turn = np.linalg.eigh(gram)
    order = [i for i in np.argsort(values)[::-1][:k] if values[i] > 1e-12 * values.max()]
    turned = block.join(authors, "a").select("author", _times(turn[:, order] / np.sqrt(values[order])).alias("y"))
    return _stored(turned, "vectors"), np.sqrt(values[order]).tolist()


def author_clusters(tok: DataFrame, k: int = 4, seed: int = 42, tokens_col: str = "tokens") -> DataFrame:
    """``(author, cluster)`` for every author of ``tok(author, tokens)``."""
    authors = tok.select("author").filter(F.col("author").isNotNull()).distinct()
    edges = author_words(tok, tokens_col)
    if edges.isEmpty():
        return authors.withColumn("cluster", F.lit(None).cast("int"))
    vectors, _ = leading_vectors(edges, k, seed=seed)
    length = F.sqrt(F.aggregate("y", F.lit(0.0), lambda a, x: a + x * x))
    unit = vectors.withColumn("n", length).select("author", array_to_vector(F.transform("y", lambda x: F.when(F.col("n") > 0, x / F.col("n")).otherwise(x))).alias("features"))
    model = KMeans(k=k, seed=seed, predictionCol="cluster").fit(unit.orderBy(F.xxhash64("author", F.lit(seed)), "author"))
    return authors.join(model.transform(unit).select("author", "cluster"), "author", "left")
