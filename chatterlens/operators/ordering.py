"""A globally sorted copy of a table whose partition numbers can be relied on.

``spark_partition_id()`` over a range repartition is evaluated anew in every
branch that reads it, and each branch may sample other bounds; counts and rows
then disagree. The copy here is stored once, with the partition and the place in
it as columns, so every branch reads the same numbers. Partitions without rows
simply have no number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path


def sorted_copy(df: DataFrame, keys) -> DataFrame:
    """``df`` with ``_pid`` and ``_rn`` (1-based in the partition) in the order of
    ``keys``, written to the shared scratch folder."""
    keys = list(keys)
    path = scratch_path(df.sparkSession, "sorted")
    df.repartitionByRange(*keys).sortWithinPartitions(*keys) \
        .withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    copy = df.sparkSession.read.parquet(path)
    return copy.withColumn("_pid", F.shiftright("_at", 33)) \
        .withColumn("_rn", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_at")


def sum_before(totals: DataFrame, value: str, out: str) -> DataFrame:
    """``(_pid, out)``: sum of ``value`` over the partitions before each one;
    ``totals`` has one row for each partition."""
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("_pid", F.coalesce(F.sum(value).over(before), F.lit(0)).alias(out))
