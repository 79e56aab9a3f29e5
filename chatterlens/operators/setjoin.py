"""Exact and approximate similarity joins of word sets.

``set_similarity_pairs`` is exact.  Words are ordered from the rarest to the most
frequent.  Two sets of Jaccard similarity t or more share at least
``ceil(t / (1 + t) * (n_a + n_b))`` words, so many of them lie within the first words of
each (the prefix), and sizes must be within the factor t.  Sets are laid in blocks by
size; a task gets the prefixes of two blocks whose sizes can match, as arrays of
hashes, and counts for all their pairs the prefix words that both hold.  Only pairs
with as many as they must have leave the task, each once, to be verified on the words
themselves; no pair is written for a word alone, however frequent it is.  A task's
memory is bounded by the words of a block.

``lsh_pairs`` is approximate: it finds the sets that agree on all ``rows`` minimum hashes
of a band, never on one hash.  Its recall is measured against the exact join in the tests
(1 - (1 - s^rows)^bands for similarity s).  Long texts of one language agree in a band
without being close, so sets meet on their prefixes, and the bands are compared then.

Both work on distinct sets (:func:`distinct_sets`), so copies of a text are one row
with a member count and never pairs.  Empty sets take no part.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path

#: Sets of a block at least, blocks of a table, and prefix words of a block at most.
HOT, BLOCKS, BLOCK_WORDS = 200, 24, 6_000_000
#: Pairs that a task counts at a time, and shared words at a time.
CELLS, MEETINGS = 1 << 20, 1 << 22


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def distinct_sets(tok: DataFrame, tokens_col: str = "tokens") -> DataFrame:
    """``(rep, members, words)``: one row for each distinct non-empty word set of
    ``tok(id, tokens)``, with its smallest id and the number of posts that have it."""
    words = F.array_sort(F.array_distinct(F.flatten(tokens_col)))
    sets = tok.select("id", words.alias("words")).filter(F.size("words") > 0)
    # the digest is the key: an aggregate on whole arrays would compare them
    keyed = sets.withColumn("key", F.sha2(F.array_join("words", " "), 256))
    return keyed.groupBy("key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("members"), F.first("words").alias("words")) \
        .select("rep", "members", "words")


def _least(t: Fraction, n) -> Column:
    """ceil(t * n) in whole numbers."""
    return F.floor((F.lit(t.numerator) * n + F.lit(t.denominator - 1)) / F.lit(t.denominator)).cast("int")


def _ceil(num, n, den):
    return -(-num * n // den)


def _spare(n):
    """Words by which a prefix is longer than one shared word needs: as many more must be shared."""
    return n // 10


def _blocks(sizes: list[tuple[int, int]], t: Fraction, hot: int) -> list[tuple[int, int, int]]:
    """``(lo, hi, parts)``: ranges of set sizes from ``(size, sets)`` in ascending order, of
    about equally many prefix words; a size with more than that is dealt over ``parts`` blocks."""
    words = [(n, count * (n - _ceil(t.numerator, n, t.denominator) + 1 + _spare(n))) for n, count in sizes]
    total, sets = sum(w for _, w in words), sum(count for _, count in sizes)
    most = min(BLOCK_WORDS, max(total / BLOCKS, hot * total / max(sets, 1)))
    out, held = [], 0
    for n, w in words:
        if w > most:
            out.append((n, n, int(w // most) + 1))
            held = most
        elif not out or held + w > most:
            out.append((n, n, 1))
            held = w
        else:
            out[-1] = (out[-1][0], n, 1)
            held += w
    return out


def _meet(a: dict, b: dict, same: bool, t: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers ``(of a, of b)`` of the pairs whose prefixes share what similarity ``t``
    takes; of a block and itself each pair once."""
    num, den = t.numerator, t.denominator
    rows, width = len(a["n"]), len(b["n"])
    order = np.argsort(b["w"], kind="stable")
    owner = np.repeat(np.arange(width), b["q"])[order]
    words, first, count = np.unique(b["w"][order], return_index=True, return_counts=True)
    at = np.minimum(np.searchsorted(words, a["w"]), len(words) - 1)
    known = words[at] == a["w"]
    row, first, count = np.repeat(np.arange(rows), a["q"])[known], first[at[known]], count[at[known]]
    ends = np.cumsum(count)
    begin = np.searchsorted(row, np.arange(rows + 1))
    # a set's words that are not in its prefix
    left_a, left_b = a["n"] - a["q"], b["n"] - b["q"]
    found_a, found_b = [], []
    step = max(1, CELLS // width)
    for lo in range(0, rows, step):
        hi = min(rows, lo + step)
        shared, i = np.zeros((hi - lo) * width, np.int64), begin[lo]
        while i < begin[hi]:
            j = min(begin[hi], max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + MEETINGS, "right"))))
            c = count[i:j]
            place = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c - first[i:j], c)
            shared += np.bincount(owner[place] + np.repeat((row[i:j] - lo) * width, c), minlength=len(shared))
            i = j
        cell = np.flatnonzero(shared >= min(a["least"][lo:hi].min(), b["least"].min()))
        x, y = cell // width + lo, cell % width
        n_a, n_b = a["n"][x], b["n"][y]
        ok = (n_a * den >= n_b * num) & (n_b * den >= n_a * num)
        ok &= shared[cell] >= _ceil(num, n_a + n_b, num + den) - np.maximum(left_a[x], left_b[y])
        if same:
            ok &= x < y
        found_a.append(x[ok])
        found_b.append(y[ok])
    return np.concatenate(found_a), np.concatenate(found_b)


def _met(t: Fraction):
    """The function of one pair of blocks: rows ``(side, same, rep, n, least, w)`` to pairs."""
    def pairs(rows: pa.Table) -> pa.Table:
        def of(x: pa.Table) -> dict:
            w = x["w"].combine_chunks()
            return {"n": x["n"].to_numpy().astype(np.int64), "least": x["least"].to_numpy(), "q": pc.list_value_length(w).to_numpy(), "w": w.flatten().to_numpy()}

        a = rows.filter(pc.equal(rows["side"], 0))
        same = len(a) > 0 and a["same"][0].as_py()
        b = a if same else rows.filter(pc.equal(rows["side"], 1))
        if not len(a) or not len(b):
            return pa.table({"rep_a": rows["rep"][:0], "rep_b": rows["rep"][:0]})
        x, y = _meet(of(a), of(b), same, t)
        return pa.table({"rep_a": a["rep"].take(pa.array(x)), "rep_b": b["rep"].take(pa.array(y))})

    return pairs


def candidate_pairs(sets: DataFrame, t: Fraction, hot: int = HOT) -> DataFrame:
    """Distinct ``(rep_a, rep_b)`` that hold all pairs of similarity ``t`` or more of ``sets(rep,
    words)``.  Words travel as hashes: equal hashes of different words only add candidates.
    Blocks have ``hot`` sets or more."""
    spark, num, den = sets.sparkSession, t.numerator, t.denominator
    occ = sets.select("rep", F.explode(F.transform("words", lambda x: F.hash(x))).alias("x"))
    # stored, so that adaptive execution can split the rows of a frequent word
    freq = _stored(occ.groupBy("x").agg(F.count(F.lit(1)).alias("df")), "word-frequencies")
    ranked = occ.join(freq, "x").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("df", "x"))).alias("w"))
    s = _stored(ranked.select("rep", F.size("w").alias("n"), F.transform("w", lambda x: x["x"]).alias("w")), "ordered-sets")
    # a row for each size of a set, then for each pair of blocks
    sizes = [tuple(r) for r in s.groupBy("n").agg(F.count(F.lit(1))).orderBy("n").collect()]
    ranges = _blocks(sizes, t, hot)
    blocks = [(lo, hi) for lo, hi, parts in ranges for _ in range(parts)]
    start = [sum(parts for _, _, parts in ranges[:k]) for k in range(len(ranges))]
    of_size = [(n, start[k], parts) for k, (lo, hi, parts) in enumerate(ranges) for n, _ in sizes if lo <= n <= hi]
    meet = [(i, j) for i in range(len(blocks)) for j in range(i + 1) if blocks[i][0] * num <= blocks[j][1] * den]
    sides = [(x, k, side, i == j, *blocks[y]) for k, (i, j) in enumerate(meet) for side, x, y in ((0, i, j), (1, j, i)) if side == 0 or i != j]
    of_size = spark.createDataFrame(of_size, "n int, start int, parts int")
    sides = spark.createDataFrame(sides, "block int, pair int, side int, same boolean, lo int, hi int")
    rows = s.join(F.broadcast(of_size), "n").withColumn("block", F.col("start") + F.pmod(F.hash("rep"), "parts")).join(F.broadcast(sides), "block")
    rows = rows.where((F.col("lo") * num <= F.col("n") * den) & (F.col("n") * num <= F.col("hi") * den))
    needed = _least(t / (1 + t), F.col("n") + F.greatest("lo", _least(t, F.col("n"))))
    rows = rows.withColumn("needed", needed).withColumn("least", F.least("needed", F.expr("n div 10 + 1").cast("int")))
    rows = rows.select("pair", "side", "same", "rep", "n", "least", F.slice("w", F.lit(1), F.col("n") - F.col("needed") + F.col("least")).alias("w"))
    tasks = max(1, min(len(meet), max(int(spark.conf.get("spark.sql.shuffle.partitions")), len(blocks) * 4)))
    kind = sets.schema["rep"].dataType.simpleString()
    met = rows.repartition(tasks, "pair").groupBy("pair").applyInArrow(_met(t), f"rep_a {kind}, rep_b {kind}")
    return met.select(F.least("rep_a", "rep_b").alias("rep_a"), F.greatest("rep_a", "rep_b").alias("rep_b"))


def _numbered(sets: DataFrame, *more: str) -> DataFrame:
    """``sets``, stored, each with a number of its own: ids may repeat."""
    return _stored(sets.select(F.monotonically_increasing_id().alias("set"), "rep", "members", "words", *more), "sets")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    a = sets.select(F.col("set").alias("rep_a"), F.struct("rep", "members", "words").alias("_a"))
    b = sets.select(F.col("set").alias("rep_b"), F.struct("rep", "members", "words").alias("_b"))
    j = pairs.join(a, "rep_a").join(b, "rep_b").where("_a.rep <> _b.rep")
    j = j.withColumn("shared", F.size(F.array_intersect("_a.words", "_b.words")))
    j = j.withColumn("all", F.size("_a.words") + F.size("_b.words") - F.col("shared"))
    # numbers do not follow the ids
    turned = F.col("_a.rep") > F.col("_b.rep")
    first, second = F.when(turned, F.col("_b")).otherwise(F.col("_a")), F.when(turned, F.col("_a")).otherwise(F.col("_b"))
    return j.select(first["rep"].alias("rep_a"), second["rep"].alias("rep_b"), "shared", "all",
                    first["members"].alias("members_a"), second["members"].alias("members_b"))


def set_similarity_pairs(sets: DataFrame, min_jaccard: float = 0.5, hot: int = HOT) -> DataFrame:
    """Every pair of ``sets(rep, members, words)`` with Jaccard similarity of at least
    ``min_jaccard`` (over 0): ``(rep_a, rep_b, jaccard, members_a, members_b)``."""
    t = Fraction(str(min_jaccard))
    sets = _numbered(sets)
    pairs = candidate_pairs(sets.select(F.col("set").alias("rep"), "words"), t, hot)
    v = _verified(_stored(pairs, "candidates"), sets)
    return v.where(F.col("shared") * t.denominator >= F.col("all") * t.numerator) \
        .select("rep_a", "rep_b", (F.col("shared") / F.col("all")).alias("jaccard"), "members_a", "members_b")


def agreeing_pairs(sets: DataFrame, max_distance: float, hot: int = HOT) -> DataFrame:
    """Pairs of ``sets(rep, members, words, bands)`` closer than ``max_distance`` (Jaccard
    distance) that have the same value at a place of ``bands``.  Sets meet on their prefixes,
    as every closer pair does; the bands are compared then."""
    t = max(1 - Fraction(str(max_distance)), Fraction(1, 10**6))
    sets = _numbered(sets, "bands")
    pairs = _stored(candidate_pairs(sets.select(F.col("set").alias("rep"), "words"), t, hot), "candidates")
    a = sets.select(F.col("set").alias("rep_a"), F.col("bands").alias("_a"))
    b = sets.select(F.col("set").alias("rep_b"), F.col("bands").alias("_b"))
    same = F.exists(F.zip_with("_a", "_b", lambda x, y: x == y), lambda x: x)
    v = _verified(_stored(pairs.join(a, "rep_a").join(b, "rep_b").where(same).select("rep_a", "rep_b"), "agreeing"), sets)
    distance = F.lit(1.0) - F.col("shared") / F.col("all")
    return v.select("rep_a", "rep_b", distance.alias("jaccard_distance"), "members_a", "members_b").where(F.col("jaccard_distance") < max_distance)


def lsh_pairs(sets: DataFrame, max_distance: float = 0.5, bands: int = 10, rows: int = 2, hot: int = HOT) -> DataFrame:
    """Pairs of ``sets`` closer than ``max_distance`` (Jaccard distance) that agree in a
    band: ``(rep_a, rep_b, jaccard_distance, members_a, members_b)``."""
    def least(i):
        return F.array_min(F.transform("words", lambda w: F.xxhash64(w, F.lit(i))))

    keys = F.array(*[F.struct(*[least(b * rows + r).alias(f"h{r}") for r in range(rows)]) for b in range(bands)])
    return agreeing_pairs(sets.select("rep", "members", "words", keys.alias("bands")), max_distance, hot)
