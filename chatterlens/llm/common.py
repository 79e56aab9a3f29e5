"""Shared Spark helpers of the training-data operators."""

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path

#: Documents per Arrow batch: a batch of long texts stays a few MB.
ARROW_ROWS = 1000

#: Size of texts whose words a task holds at once, beyond a single longer text.
SLICE = 4 << 20


def slices(texts: list):
    """Parts (first, texts) of a batch, each of at most ``SLICE`` or one text."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if i > first and size + len(t or "") > SLICE:
            yield first, texts[first:i]
            first, size = i, 0
        size += len(t or "")
    if texts:
        yield first, texts[first:]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Whole texts travel to Python in batches of at most ``ARROW_ROWS`` rows."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: a lineage cut
    that survives lost executors and is evaluated exactly once."""
    return stored_at(df, name)[0]


def stored_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """:func:`stored` with the folder, for :func:`discard`."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder that :func:`stored_at` made and nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def held_out(doc_id="doc_id"):
    """crc32 of the id as text, mod 5, is 0; null ids are never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def ordered_index(df: DataFrame, keys: list[str], name: str, index: str = "_idx") -> DataFrame:
    """Add the gapless 0-based position of each row in the order of ``keys``.

    Rows are range-partitioned once by the keys and a row number that splits
    runs of equal keys, and stored with partition and local position in one
    column; only a count per partition is gathered to shift them.
    """
    spread = df.withColumn("_tie", F.monotonically_increasing_id())
    order = [*keys, "_tie"]
    copy = stored(spread.repartitionByRange(*order).sortWithinPartitions(*order)
                  .withColumn("_at", F.monotonically_increasing_id()).drop("_tie"), name)
    copy = copy.withColumn("_pid", F.shiftright("_at", 33))
    counts = copy.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    # one row for each partition of the stored copy
    starts = counts.select("_pid", (F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n")).alias("_start"))
    return (copy.join(F.broadcast(starts), "_pid")
            .withColumn(index, F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
            .drop("_pid", "_at", "_start"))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node it is linked to) for the nodes of the links a-b that
    are not the smallest of their group."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[:len(a)], at[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        while True:
            jump = new[new]
            if np.array_equal(jump, new):
                break
            new = jump
        if np.array_equal(new, label):
            break
        label = new
    inner = label != np.arange(len(nodes))
    return nodes[inner], nodes[label[inner]]


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable from each node of ``links``
    (a, b) that is not a root itself, by alternating large-star and small-star
    rounds until the links no longer change.

    Minima are stored before they are joined back, so adaptive execution can
    split the rows of a hub; nothing is gathered on the driver but a count and
    a hash per round.
    """
    def pairs(df):
        return (df.where(F.col("a") != F.col("b"))
                .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def state(df):
        r = df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        return r[0], r[1]

    now = stored(pairs(links), "links")
    before = state(now)
    while before[0]:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low")), "low")
        large = (both.join(low, "a").where(F.col("b") > F.col("a"))
                 .select(F.col("b").alias("a"), F.col("low").alias("b")))
        large = stored(pairs(large), "large")
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        now = stored(pairs(small.union(low.select("a", F.col("low").alias("b")))), "links")
        after = state(now)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
