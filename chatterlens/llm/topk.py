"""Exact top-k inner products by a Voronoi kNN join.

A further coordinate, sqrt(M^2 - |x|^2) for data and 0 for queries, makes the
largest inner product the smallest distance. Pivots are a bounded sample of the
data; rows belong to the cell of their nearest pivot and, within it, to a block of
rows of like distance to it. Summaries of the blocks (rows, least and largest
distance to the pivot) bound from below how near any row of a block can be to a
query: by the triangle inequality over the pivot, and by the plane between the
query's own pivot and the block's.

Every data row is sent once, to its block. A query first meets the block with the
least bound; its k-th score there is a bound of its own, and only the blocks that can
still reach it get the query in a second round. In a block's task the data come
first and the queries stream past them, so neither the queries of a hot block nor
the rows of a hot cell are ever held together. The best rows of each query and block
are merged. Where nothing can be excluded the work is that of all pairs of blocks,
but what is sent stays the queries.

Scores are exact integers. Defined cases: a null vector, or one that holds a
null or a component that is not finite, and rows of null id take no part;
shorter vectors count as padded with zeros; rows are told apart as rows, not by id:
each query row gets an answer, among all rows but itself, rows of its own id or
equal to it included; fewer than k candidates give fewer rows; empty tables give
none. Components must be below 2^31 after scaling.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Sample of the data that serves as pivots.
PIVOTS = 48
#: Queries that meet a block at a time, and rows in a block (of tables of up to 2^17 times as many).
QUERY_ROWS, DATA_ROWS = 512, 8192
_SLACK = 1e-6


def integer_vectors(df: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v): usable vectors as whole numbers floor(scale * x)."""
    ok = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.exists(
        "embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return df.select("vec_id", "embedding").where(ok).select(
        F.col("vec_id").cast("long"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("v"))


def _matrix(vectors, size: int) -> np.ndarray:
    out = np.zeros((len(vectors), size))
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(square, 0))


class Blocks:
    """Summaries of the blocks of data; at most about 2^17 rows."""

    def __init__(self, facts, pivots: np.ndarray, reach: float):
        self.cell = np.array([f[0] for f in facts], np.int64)
        self.part = np.array([f[1] for f in facts], np.int64)
        self.low = np.array([f[2] for f in facts], float)
        self.high = np.array([f[3] for f in facts], float)
        self.between, self.reach = _distances(pivots, pivots), reach
        self.slack = _SLACK * (1 + np.sqrt(reach))

    def least(self, far: np.ndarray) -> np.ndarray:
        """For one query, with its distances to all pivots: no row of a block is nearer."""
        own = int(far.argmin())
        there = far[self.cell]
        gap = self.between[own][self.cell]
        plane = np.where(gap > 0, (there ** 2 - far[own] ** 2) / np.where(gap > 0, 2 * gap, 1), 0)
        return np.maximum(np.maximum(there - self.high, self.low - there), np.maximum(plane, 0)) - self.slack


def _best(q, own, asked, x, ids, rows, k):
    """(row, query_id, vec_id, score) of the k best of a block for each query."""
    if np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * q.shape[1] < 2 ** 53:
        scores = (q.astype(float) @ x.astype(float).T).astype(np.int64)  # whole numbers, exact in doubles
    else:
        scores = q @ x.T
    out = []
    for i in range(len(q)):
        other = np.nonzero(rows != asked[i])[0]
        s = scores[i, other]
        if len(s) > k:  # all that tie with the k-th, then by id
            other = other[s >= np.partition(s, len(s) - k)[len(s) - k]]
            s = scores[i, other]
        best = np.lexsort((ids[other], -s))[:k]
        out.append((np.full(len(best), asked[i]), np.full(len(best), own[i]), ids[other][best], s[best]))
    return [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 4


def _meet(size: int, k: int, query_rows: int):
    """Blocks stream in, each with its data before its queries."""
    def meet(batches):
        key, held, whole = None, [], None
        for b in batches:
            cell, part, ask, row, ids = (b.column(i).to_numpy() for i in range(5))
            v = b.column(5).flatten().to_numpy().reshape(b.num_rows, size)
            edge = np.nonzero((np.diff(cell) != 0) | (np.diff(part) != 0) | (np.diff(ask) != 0))[0] + 1
            for lo, hi in zip([0, *edge], [*edge, b.num_rows]):
                if hi == lo:
                    continue
                if key != (cell[lo], part[lo]):
                    key, held, whole = (cell[lo], part[lo]), [], None
                if not ask[lo]:
                    held.append((v[lo:hi], ids[lo:hi], row[lo:hi]))
                    continue
                if whole is None:
                    whole, held = [np.concatenate(c) for c in zip(*held)] if held else [], []
                for at in range(lo, hi if whole else lo, query_rows):
                    to = min(at + query_rows, hi)
                    found = _best(v[at:to], ids[at:to], row[at:to], *whole, k)
                    yield pa.record_batch([pa.array(c, pa.int64()) for c in found], ["row", "query_id", "vec_id", "score"])
    return meet


def top_k(data: DataFrame, is_query: str, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of (vec_id, v array<long>) that
    satisfies ``is_query``, the k other rows with the largest inner product; ties go
    to the smaller id."""
    return merged(found_in_blocks(data, is_query, k), k)


def merged(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k) \
        .select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def found_in_blocks(data: DataFrame, is_query: str, k: int) -> DataFrame:
    """(row, query_id, vec_id, score): the best of each block that a query met."""
    spark = data.sparkSession
    kind = "row long, query_id long, vec_id long, score long"
    # a stored number tells rows apart that are equal in all columns
    data = stored(data.select("vec_id", "v").withColumn("row", F.monotonically_increasing_id()), "data")
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    total, reach, size = data.agg(F.count(F.lit(1)), F.max(norm), F.max(F.size("v"))).first()
    if not total:
        return spark.createDataFrame([], kind)
    reach, size = float(reach), max(int(size), 1)
    block_rows = max(DATA_ROWS, total >> 17)

    def lifted(x, is_data):
        more = np.sqrt(np.maximum(reach - (x * x).sum(1), 0)) if is_data else np.zeros(len(x))
        return np.concatenate([x, more[:, None]], axis=1)

    sample = data.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(PIVOTS).collect()
    pivots = np.unique(lifted(_matrix([r.v for r in sample], size), True), axis=0)

    def assign(batches):
        for pdf in batches:
            far = _distances(lifted(_matrix(pdf["v"], size), True), pivots)
            cell = far.argmin(1)
            yield pd.DataFrame({"row": pdf["row"], "vec_id": pdf["vec_id"], "v": pdf["v"], "cell": cell, "far": far[np.arange(len(far)), cell]})

    rows = stored(data.select("row", "vec_id", "v").mapInPandas(assign, "row long, vec_id long, v array<long>, cell long, far double"), "cells")
    # blocks of a cell: rings of like distance, as many as its rows need
    counts = {r.cell: r["count"] for r in rows.groupBy("cell").count().collect()}
    most = max(1, -(-max(counts.values()) // block_rows))
    edges = {c: np.zeros(0) for c in counts}
    if most > 1:
        steps = [i / most for i in range(1, most)]
        for r in rows.groupBy("cell").agg(F.percentile_approx("far", steps, max(1000, 10 * most)).alias("cuts")).collect():
            need = -(-counts[r.cell] // block_rows)
            edges[r.cell] = np.array([r.cuts[i * most // need - 1] for i in range(1, need)], float)

    def place(batches):
        for pdf in batches:
            part = np.zeros(len(pdf), np.int64)
            for c in pdf["cell"].unique():
                here = (pdf["cell"] == c).to_numpy()
                far, row = pdf["far"].to_numpy()[here], pdf["row"].to_numpy()[here]
                lo, hi = np.searchsorted(edges[c], far, "left"), np.searchsorted(edges[c], far, "right")
                part[here] = lo + row % (hi - lo + 1)  # rows on several equal cuts are spread over their rings
            yield pdf.assign(part=part)

    placed = stored(rows.mapInPandas(place, "row long, vec_id long, v array<long>, cell long, far double, part long"), "blocks")
    facts = placed.groupBy("cell", "part").agg(F.min("far"), F.max("far")).collect()
    blocks = Blocks(facts, pivots, reach)
    asks = data.where(is_query).select("row", "vec_id", "v")

    def first(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            x = _matrix(pdf["v"], size)
            at = np.array([blocks.least(f).argmin() for f in _distances(lifted(x, False), pivots)], np.int64)
            yield pd.DataFrame({"cell": blocks.cell[at], "part": blocks.part[at], "ask": 1, "row": pdf["row"], "vec_id": pdf["vec_id"], "v": list(x.astype(np.int64))})

    def others(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            x = _matrix(pdf["v"], size)
            # a row of the k-th score so far is this far away
            near = np.sqrt(np.maximum((x * x).sum(1) + reach - 2 * pdf["kth"].fillna(-np.inf).to_numpy(float), 0))
            met = list(zip(pdf["cell"], pdf["part"]))
            go = [np.nonzero((blocks.least(f) <= near[i]) & ((blocks.cell != met[i][0]) | (blocks.part != met[i][1])))[0]
                  for i, f in enumerate(_distances(lifted(x, False), pivots))]
            at, ask = np.concatenate([*go, np.zeros(0, np.int64)]).astype(np.int64), np.repeat(np.arange(len(x)), [len(g) for g in go])
            if len(at):
                yield pd.DataFrame({"cell": blocks.cell[at], "part": blocks.part[at], "ask": 1, "row": pdf["row"].to_numpy()[ask],
                                    "vec_id": pdf["vec_id"].to_numpy()[ask], "v": list(x.astype(np.int64)[ask])})

    layout = "cell long, part long, ask int, row long, vec_id long, v array<long>"
    padded = F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(size) - F.size("v")))
    there = placed.select("cell", "part", F.lit(0).alias("ask"), "row", "vec_id", padded.alias("v"))

    def round_(queries):
        asked = F.broadcast(queries.select("cell", "part").distinct())  # at most a row for each block
        both = there.join(asked, ["cell", "part"], "left_semi").select(*queries.columns).union(queries)
        both = both.repartition("cell", "part").sortWithinPartitions("cell", "part", "ask")
        return stored(both.mapInArrow(_meet(size, k, QUERY_ROWS), kind), "met")

    begun = stored(asks.mapInPandas(first, layout), "first")
    one = round_(begun)
    kth = one.groupBy("row").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).cast("double").alias("kth"))
    return one.union(round_(stored(begun.join(kth, "row", "left").mapInPandas(others, layout), "others")))
