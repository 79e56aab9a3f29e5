"""Near duplicates and neighbourhood pairs.

* ``posting_order``: consecutive 0-based positions in (created_utc, id) order
  without a single-partition window: a stored range-partitioned sort,
  per-partition counts (one row per partition) and their prefix offsets.
* ``neighbourhood_pairs`` (J10): pairs of posts at most ``width`` positions
  apart, as an equi-join on ``floor(pos / width)`` with the same and the next
  bucket plus a residual range test -- never a nested-loop or cartesian join,
  and at most ``2 * width`` partners per post whatever the key skew.
* ``repost_pairs`` (X06): transport distance 0 under uniform weights means
  equal word-frequency distributions, so candidates are an equi-join on a
  normalised bag signature *and* the position bucket; a signature shared by a
  third of all posts still yields at most ``2 * width`` partners per post.
* ``relaxed_transport`` (X03): lower bound of the optimal transport cost
  ``max(sum_i w_i min_j c_ij, sum_j w_j min_i c_ij)`` of each pair.  Equal vectors
  of a cloud are one point with the sum of their weights, and a pair's costs are
  taken in blocks inside the task: no row is made for two words of a pair.
* ``lsh_pairs`` (X07): MinHash LSH similarity join on token sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import HashingTF, MinHashLSH
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..session import cut_lineage, stored
from .ordering import sorted_copy, sum_before
from .setjoin import agreeing_pairs


def posting_order(df: DataFrame, order_cols=("created_utc", "id"), pos_col: str = "pos") -> DataFrame:
    s = sorted_copy(df, order_cols)
    counts = s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition: bounded by the partition count, safe to broadcast
    offs = sum_before(counts, "_n", "_off")
    return s.join(F.broadcast(offs), "_pid").withColumn(pos_col, (F.col("_off") + F.col("_rn") - 1).cast("bigint")) \
        .drop("_pid", "_off", "_rn")


def neighbourhood_pairs(df: DataFrame, width: int, id_col: str = "id", pos_col: str = "pos",
                        extra_keys=()) -> DataFrame:
    """Pairs ``(id_a, id_b)`` with ``0 < pos_b - pos_a <= width`` (and equal
    ``extra_keys``)."""
    b = df.withColumn("_bk", F.floor(F.col(pos_col) / width))
    left = b.select(*[F.col(k) for k in extra_keys], F.col(id_col).alias("id_a"),
                    F.col(pos_col).alias("pos_a"), F.col("_bk").alias("_bk"))
    right = b.select(*[F.col(k) for k in extra_keys], F.col(id_col).alias("id_b"),
                     F.col(pos_col).alias("pos_b"), F.col("_bk").alias("_bk_b"))
    # the partner's bucket is this bucket or the next one
    left2 = left.select("*", F.explode(F.array(F.col("_bk"), F.col("_bk") + 1)).alias("_bk_b"))
    j = left2.join(right, list(extra_keys) + ["_bk_b"])
    j = j.filter((F.col("pos_b") > F.col("pos_a")) & (F.col("pos_b") - F.col("pos_a") <= width))
    return j.select("id_a", "id_b", "pos_a", "pos_b", *extra_keys)


def bag_signature(tokens_col: str = "tokens"):
    """Word-frequency signature: sorted multiset of the words (order free)."""
    return F.sha2(F.array_join(F.array_sort(F.flatten(F.col(tokens_col))), " "), 256)


def repost_pairs(tok: DataFrame, width: int = 200, tokens_col: str = "tokens") -> DataFrame:
    """Pairs of posts with identical word distributions within ``width``
    positions of each other (posts with no words excluded)."""
    p = tok.filter(F.size(F.flatten(tokens_col)) > 0) \
        .select("id", "created_utc", bag_signature(tokens_col).alias("sig"))
    # narrow (id, time, signature) table read twice by the ordering step
    # (range sampling, rows): write it once
    p = posting_order(cut_lineage(p))
    return neighbourhood_pairs(p, width, extra_keys=("sig",)).drop("sig")


def clouds(tok: DataFrame, vectors: DataFrame, tokens_col: str = "tokens", cut_off: int | None = None,
           weights: str = "uniform", step: float = 1.0, shift: float = 1.0) -> DataFrame:
    """Each post's point cloud ``(id, p, vector, w)`` of in-vocabulary
    words in text order; weights uniform or ``1/(step*p + shift)``, normalised
    per post.  ``cut_off=None`` keeps the whole text."""
    places = F.flatten(F.transform(tokens_col, lambda sent, s: F.transform(sent, lambda x, q: F.struct(s.alias("s"), q.alias("q"), x.alias("word")))))
    if cut_off is None:
        j = tok.select("id", F.inline(places)).join(vectors, "word")
    else:
        j = _first_known(tok.select("id", places.alias("places")), vectors, cut_off)
    j = j.withColumn("p", F.row_number().over(Window.partitionBy("id").orderBy("s", "q")) - 1)
    if cut_off is not None:
        j = j.filter(F.col("p") < cut_off)
    raw = F.lit(1.0) if weights == "uniform" else F.lit(1.0) / (F.lit(step) * F.col("p") + F.lit(shift))
    j = j.withColumn("w0", raw)
    j = j.withColumn("w", F.col("w0") / F.sum("w0").over(Window.partitionBy("id")))
    return j.select("id", "p", "word", "vector", "w")


def _first_known(words: DataFrame, vectors: DataFrame, cut_off: int) -> DataFrame:
    """Places of ``words(id, places)`` with their vectors that hold the first ``cut_off``
    known ones of every id: the first few words of all posts, and all words of those
    posts whose first few do not hold enough known ones."""
    few = 4 * cut_off
    heads = stored(words.select("id", F.slice("places", 1, few).alias("places"), (F.size("places") > few).alias("more")), "first-words")
    known = stored(heads.select("id", F.inline("places")).join(vectors, "word"), "first-known")
    # of m rows with one id, each has at least known - few * (m - 1) known words among its first
    rows = heads.groupBy("id").agg(F.count(F.lit(1)).alias("m"), F.max("more").alias("more")).where("more")
    n = known.groupBy("id").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("id", "_id")
    short = stored(rows.join(n, F.col("id").eqNullSafe(F.col("_id")), "left")
                   .where(F.coalesce("n", F.lit(0)) - few * (F.col("m") - 1) < cut_off).select(F.col("id").alias("_id")), "short-of-words")
    same = F.col("id").eqNullSafe(F.col("_id"))
    rest = words.join(short, same, "left_semi").select("id", F.inline("places")).join(vectors, "word")
    return known.join(short, same, "left_anti").unionByName(rest)


#: Costs of a pair that are held at once.
BLOCK = 1 << 18


def _bound(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> float | None:
    """The larger one-sided bound of weights ``a``, ``b`` at points ``x``, ``y``."""
    if not len(a) or not len(b):
        return None
    near_x, near_y, top = np.empty(len(a)), np.full(len(b), np.inf), 0.0
    step = max(1, BLOCK // len(b))
    for at in range(0, len(a), step):
        c = np.zeros((len(x[at:at + step]), len(b)))
        for d in range(x.shape[1]):
            c += (x[at:at + step, d, None] - y[None, :, d]) ** 2
        near_x[at:at + step] = c.min(1)
        np.minimum(near_y, c.min(0), out=near_y)
        top = max(top, float(c.max()))
    return float(max((a * near_x).sum(), (b * near_y).sum())) / top if top > 0 else 0.0


def cloud_arrays(points: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Weights and points of a column of clouds ``array<struct<w, vector>>``."""
    flat = points.flatten()
    w = flat.field("w").to_numpy(zero_copy_only=False)
    v = flat.field("vector").flatten().to_numpy(zero_copy_only=False).reshape(len(w), -1) if len(w) else np.zeros((0, 0))
    ends = np.cumsum(pc.fill_null(pc.list_value_length(points), 0).to_numpy(zero_copy_only=False))
    return [(w[e - n:e], v[e - n:e]) for e, n in zip(ends, np.diff(ends, prepend=0))]


@F.arrow_udf(DoubleType())
def _relaxed(left: pa.Array, right: pa.Array) -> pa.Array:
    return pa.array([_bound(a, x, b, y) for (a, x), (b, y) in zip(cloud_arrays(left), cloud_arrays(right))], pa.float64())


def relaxed_transport(pairs: DataFrame, cl: DataFrame) -> DataFrame:
    """X03 over ``pairs(id_a, id_b)`` and clouds; cost = squared Euclidean
    distance scaled by the pair's maximum cost."""
    # a post's points are at most its words
    whole = stored(cl.groupBy("id", F.col("vector").cast("array<double>").alias("vector")).agg(F.sum("w").alias("w"))
                   .groupBy("id").agg(F.collect_list(F.struct("w", "vector")).alias("cloud")), "clouds")
    x = pairs.select("id_a", "id_b").distinct().join(whole.select(F.col("id").alias("id_a"), F.col("cloud").alias("a")), "id_a") \
        .join(whole.select(F.col("id").alias("id_b"), F.col("cloud").alias("b")), "id_b")
    # little data, much work: spread whatever its size
    x = x.repartition(int(x.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return x.select("id_a", "id_b", _relaxed("a", "b").alias("distance"))


def lsh_pairs(tok: DataFrame, threshold: float = 0.5, tokens_col: str = "tokens", num_features: int = 1 << 18,
              num_hash_tables: int = 5, seed: int = 42) -> DataFrame:
    """Approximate near-duplicate pairs by MinHash LSH (Jaccard distance
    of word sets below ``threshold``).

    Identical word sets are collapsed first to one representative (smallest
    id) with a member count, so a set shared by a third of all posts is one
    row, not a bucket that would emit all pairs of its members.  Sets that have a
    minimum hash in common are many, so they meet on rare words, and those pairs are
    kept that agree in one of the hashes (:func:`.setjoin.agreeing_pairs`).  The result
    pairs distinct sets: ``(rep_a, rep_b, jaccard_distance, members_a,
    members_b)``; exact copies are reported by :func:`exact_set_groups`.
    """
    groups = exact_set_groups(tok, tokens_col)
    reps = groups.groupBy("set_key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("members"),
                                         F.first("words").alias("words"))
    feats = HashingTF(inputCol="words", outputCol="f", numFeatures=num_features, binary=True).transform(reps)
    model = MinHashLSH(inputCol="f", outputCol="h", numHashTables=num_hash_tables, seed=seed).fit(feats)
    # hashed words only propose pairs (colliding words may move the hashed
    # distance either way); the distance is that of the word sets
    hashes = F.array(*[vector_to_array(F.col("h")[i])[0] for i in range(num_hash_tables)])
    return agreeing_pairs(model.transform(feats).select("rep", "members", "words", hashes.alias("bands")), threshold)


def exact_set_groups(tok: DataFrame, tokens_col: str = "tokens") -> DataFrame:
    """Posts keyed by their sorted distinct word set (non-empty sets only)."""
    words = F.array_sort(F.array_distinct(F.flatten(tokens_col)))
    return tok.select("id", words.alias("words")).filter(F.size("words") > 0) \
        .withColumn("set_key", F.sha2(F.array_join("words", " "), 256))


def sorted_lag(df: DataFrame, key: str, order_cols, value_col: str) -> DataFrame:
    """Per-key running position and previous value in ``order_cols`` order,
    safe for a key holding a large share of all rows.

    The rows are range-partitioned on ``(key, order)`` and stored once, so a hot
    key is spread over many partitions; ``lag`` runs inside each partition, and
    the partition boundaries are repaired with two small tables: the last row of
    every partition that has rows (one row per partition, broadcast) and the
    per-(partition, key) counts prefix-summed per key (at most one row per
    partition for each key, so a key's group is bounded by the partition count,
    never by its row count).
    """
    s = sorted_copy(df, [key, *order_cols])
    s = s.withColumn("_lag", F.lag(F.struct(F.col(key).alias("k"), F.col(value_col).alias("v"))).over(
        Window.partitionBy("_pid").orderBy("_rn")))
    last = s.groupBy("_pid").agg(F.max_by(F.struct(F.col(key).alias("k"), F.col(value_col).alias("v")),
                                          F.col("_rn")).alias("l"))
    last = last.select("_pid", F.lag("l").over(Window.orderBy("_pid")).alias("_prev"))
    cnt = s.groupBy("_pid", key).agg(F.count(F.lit(1)).alias("_c"), F.min("_rn").alias("_first"))
    cnt = cnt.withColumn("_before", F.coalesce(F.sum("_c").over(
        Window.partitionBy(key).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    cnt = cnt.select(F.col("_pid").alias("_p"), F.col(key).alias("_k"), "_first", "_before")
    s = s.join(F.broadcast(last), "_pid", "left") \
        .join(cnt, (F.col("_pid") == F.col("_p")) & F.col(key).eqNullSafe(F.col("_k")))
    prev = F.when(F.col("_rn") == 1, F.col("_prev")).otherwise(F.col("_lag"))
    same = prev["k"].eqNullSafe(F.col(key)) & prev.isNotNull()
    return s.withColumn("prev_value", F.when(same, prev["v"])) \
        .withColumn("position", F.col("_before") + F.col("_rn") - F.col("_first") + 1) \
        .drop("_pid", "_rn", "_lag", "_prev", "_before", "_first", "_p", "_k")
