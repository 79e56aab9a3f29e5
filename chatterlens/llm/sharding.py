"""Sharding by jump consistent hashing.

The shard of a row follows from its stable key and the number of shards alone:
a linear congruential step of the key jumps over shard numbers, so no ring table
is kept, and with one more shard a row either stays or moves into the new one.

Slots number the rows of each shard from 0 without a gap, in the order of key,
checksum and size; they come from a range-partitioned order of all rows and a
count per partition, never from one task per shard.

Defined cases: a null text has size 16 and checksum 0; a null id has the key 0;
equal ids share a shard, equal rows get a slot each; an empty table gives no
row; further columns are never read.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ordered_index

#: Bytes that a row takes beside its text.
ROW_BYTES = 16


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unsigned 64-bit key."""
    key = keys.astype(np.uint64)
    out, at = np.full(len(key), -1, np.int64), np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    while len(live):
        out[live] = at[live]
        key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
        step = (out[live] + 1) * (float(1 << 31) / ((key[live] >> np.uint64(33)) + np.uint64(1)).astype(np.float64))
        at[live] = np.minimum(step, shards).astype(np.int64)
        live = live[at[live] < shards]
    return out


def shard_column(key, shards: int):
    if shards < 1:
        raise ValueError("at least one shard")

    @F.arrow_udf("int")
    def shard(keys: pa.Array) -> pa.Array:
        return pa.array(jump_hash(keys.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64), shards), pa.int32())

    return shard(F.col(key).cast("long"))


def shard_rows(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    rows = docs.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        shard_column("doc_id", shards).alias("shard"), shard_column("doc_id", shards + 1).alias("grown_shard"))
    placed = ordered_index(rows, ["shard", "doc_id", "text_crc32", "size"], "shards")
    counts = placed.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
    # one row for each shard
    first = counts.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("first"))
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("_idx") - F.col("first")).cast("long").alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, path: str, shards: int = 40) -> None:
    """Write the rows of ``docs``, all columns, in a folder for each shard."""
    name = "shard" if "shard" not in docs.columns else "_".join(["shard", *docs.columns])
    docs.withColumn(name, shard_column("doc_id", shards)).repartition(name, F.pmod(F.xxhash64("doc_id"), F.lit(16))) \
        .write.partitionBy(name).parquet(path)
