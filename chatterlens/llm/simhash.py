"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most ``d`` bits meet at a variant that is
within half the radius of both. The 64 bits are read as 8 blocks of 8. For a
linked pair, take the lowest block in which it differs: that block is masked
(it absorbs at least one of the differing bits), lower blocks agree, and the at
most ``d - 1`` other bits lie in higher blocks, where both sides emit all
variants within ``(d - 1) / 2`` flips, rounded up. With ``d = 3`` a fingerprint
emits 232 variants in place of the 2,081 of a whole ball of radius 2, and at
most 57 * 256 different fingerprints can share a variant, so no bucket grows
with the data.

Only different fingerprints are hashed (copies collapse first). Variants are
shuffled, every colliding pair in a bucket is verified by its bit distance, and
each task passes on a spanning forest of its verified links, not the links.

Defined cases: null texts and texts without words have fingerprint zero and are
linked like any other; null ids keep their row, and a group of null ids only
has a null component; repeated rows each give a row; an empty table gives none.
"""

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, forest, small_batches, stored

SEED = 42
BLOCKS, BLOCK_BITS = 8, 8
#: Variant rows for each task that verifies: it holds them as two long arrays.
TASK_ROWS = 1_000_000


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """64-bit SimHash of the word shingles of UTF-8 ``text``, as a signed long."""
    words = (text or b"").lower().split()  # bytes: A-Z only, split at 20 and 09-0D
    n = len(words)
    if not n:
        return 0
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if n <= width:
        hashes = np.array([digest(joined, SEED)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
        starts = [0, *ends[:n - width].tolist()]
        hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, (ends[width - 1:] - 1).tolist())),
                             np.uint64, n - width + 1)
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 255):  # a byte counts up to 255 rows
        bits = np.unpackbits(hashes[at:at + 255].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprint_column(text, width: int = 3):
    @F.arrow_udf("long")
    def prints(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint(t, width) for t in texts.to_pylist()], pa.int64())

    return prints(F.col(text).cast("binary") if isinstance(text, str) else text.cast("binary"))


def variants(max_bits: int) -> list[tuple[int, int, int]]:
    """(mask, flip, tag) of every variant, as signed longs; the tag is the number
    of the masked block, kept in its own bits."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    full, out = (1 << 64) - 1, []
    for block in range(BLOCKS):
        low = block * BLOCK_BITS
        mask = full ^ (((1 << BLOCK_BITS) - 1) << low)
        above = range(low + BLOCK_BITS, 64)
        for k in range(max_bits // 2 + 1):
            for bits in combinations(above, k):
                flip = sum(1 << x for x in bits)
                out.append((signed(mask), signed(flip), signed(block << low)))
    return out


def _verify(max_bits: int):
    def verify(batches):
        keys, prints = [], []
        for b in batches:
            keys.append(b.column(0).to_numpy())
            prints.append(b.column(1).to_numpy())
        if not keys:
            return
        key, fp = np.concatenate(keys), np.concatenate(prints)
        del keys, prints
        order = np.argsort(key, kind="stable")
        key, fp = key[order], fp[order]
        n = len(key)
        last = np.nonzero(np.append(key[1:] != key[:-1], True))[0]  # of each run of equal keys
        end = np.repeat(last, np.diff(last, prepend=-1))
        at = np.nonzero(end > np.arange(n))[0]
        a, b, held = [], [], 0
        step = 1
        while len(at):
            for part in range(0, len(at), 1 << 20):
                i = at[part:part + (1 << 20)]
                x = fp[i] ^ fp[i + step]
                ok = (x != 0) & (np.bitwise_count(x.view(np.uint64)) <= max_bits)
                a.append(fp[i[ok]])
                b.append(fp[i[ok] + step])
                held += int(ok.sum())
                if held > 2_000_000:
                    u, v = forest(np.concatenate(a), np.concatenate(b))
                    a, b, held = [u], [v], len(u)
            step += 1
            at = at[end[at] >= at + step]
        if held:
            u, v = forest(np.concatenate(a), np.concatenate(b))
            for part in range(0, len(u), 65536):
                yield pa.RecordBatch.from_arrays([pa.array(u[part:part + 65536]), pa.array(v[part:part + 65536])], ["a", "b"])

    return verify


def links(prints: DataFrame, max_bits: int = 3) -> DataFrame:
    """(a, b): verified links that connect what is linked at ``max_bits`` or
    fewer differing bits, from a stored table of different fingerprints ``fp``."""
    if not 0 < max_bits <= 4:
        raise ValueError("max_bits must be 1 to 4")
    spark = prints.sparkSession
    emit = variants(max_bits)
    rows = prints.count() * len(emit)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))
    one = F.explode(F.array(*[F.struct(F.lit(m).cast("long").alias("m"), F.lit(f).cast("long").alias("f"),
                                       F.lit(t).cast("long").alias("t")) for m, f, t in emit]))
    dealt = (prints.select("fp", one.alias("v"))
             .select((F.col("fp").bitwiseXOR(F.col("v.f"))).bitwiseAND(F.col("v.m")).bitwiseOR(F.col("v.t")).alias("key"), "fp")
             .repartition(tasks, "key"))
    return dealt.mapInArrow(_verify(max_bits), "a long, b long")


def simhash_groups(docs: DataFrame, width: int = 3, max_bits: int = 3, keep: tuple = ()) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, fp, root (a
    fingerprint that names its group), component_id and the columns of ``keep`` (expressions over docs), stored."""
    small_batches(docs.sparkSession)
    rows = stored(docs.select("doc_id", fingerprint_column("text", width).alias("fp"), *keep), "simhash")
    prints = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "prints")
    found = components(links(prints.select("fp"), max_bits))
    known = prints.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    known = stored(known, "known")
    lowest = known.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = stored(known.join(lowest, "root").select("fp", "root", "component_id"), "named")
    return rows.join(named, "fp")


def near_duplicates(docs: DataFrame, width: int = 3, max_bits: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row."""
    return simhash_groups(docs.select("doc_id", "text"), width, max_bits).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, width: int = 3, max_bits: int = 3) -> DataFrame:
    """The rows of ``docs`` (all columns) with one row of each group: its smallest
    doc_id; of rows that share it, one of those with the smallest text hash."""
    rows = simhash_groups(docs.select("doc_id", "text"), width, max_bits, (F.xxhash64("text").alias("th"),))
    best = stored(rows.groupBy("root").agg(
        F.min_by(F.struct("doc_id", "th"), F.struct(F.col("doc_id").isNull(), "doc_id", "th")).alias("best"))
        .select("best.*"), "survivors")
    again = rows.join(best, (rows.doc_id.eqNullSafe(best.doc_id)) & (rows.th == best.th), "left_semi") \
        .groupBy("doc_id", "th").count().where("count > 1").limit(1).count()
    at = "_" + "_".join(docs.columns)  # a name that no column has
    kept = docs.withColumn(at, F.xxhash64("text"))
    kept = kept.join(best.select(F.col("doc_id").alias(at + "d"), F.col("th").alias(at + "t")),
                     kept["doc_id"].eqNullSafe(F.col(at + "d")) & (kept[at] == F.col(at + "t")), "left_semi")
    if again:
        kept = kept.dropDuplicates(["doc_id", at])
    return kept.drop(at)
