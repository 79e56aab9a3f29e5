"""WARC fixity audit with Merkle trees.

A page becomes a WARC response record; records lie one after another in archive
files of ``FILE_RECORDS`` records, in the order of page id, url and checksum.
The leaves of a file's tree are the SHA-256 hashes of its records in offset
order; a node hashes the hashes of up to ``FAN`` consecutive children, so it
stands for an ordered range of offsets, up to one root per file and one root of
the archive. Two replicas are compared from the root down, and only children of
nodes that differ are read on the next level, until the records that differ are
known by file, offset and length.

Records are hashed where they are read; only hashes, sizes and positions are
shuffled. Defined cases: null url or html is empty; a null id is written as an
empty record id and comes first; equal pages are records of their own; an empty
archive has no tree, and all records of the other replica are reported; further
columns are never read.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ordered_index, stored

FILE_RECORDS, FAN = 1000, 16


def record(page_id: Column, url: Column, html: Column) -> Column:
    """Bytes of a WARC response record."""
    body = F.coalesce(html, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n")).cast("binary")


def archive(pages: DataFrame, more: dict | None = None) -> DataFrame:
    """Index of the archive of ``pages`` (page_id, url, html): page_id, file, idx
    (position in all), offset in the file, length, hash, and the columns of
    ``more`` (name: expression over pages), stored."""
    whole = record(F.col("page_id"), F.col("url"), F.col("html"))
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("u"), F.octet_length(whole).cast("long").alias("length"),
                        F.sha2(whole, 256).alias("hash"), *[c.alias(n) for n, c in (more or {}).items()])
    placed = ordered_index(rows, ["page_id", "u", "hash"], "records", "idx").drop("u")
    placed = placed.withColumn("file", F.floor(F.col("idx") / FILE_RECORDS).cast("long"))
    before = Window.partitionBy("file").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    return stored(placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long")), "archive")


def tree(leaves: DataFrame) -> list[DataFrame]:
    """Levels (pos, hash) of the tree over the leaves (idx, file, hash), records
    first: their ranges of ``FAN`` within a file, then whole files, then ranges
    of files up to one root. Every level is stored; ``up`` is a node's parent."""
    def parents(level):
        # a group has at most FAN children, or a file's last level FILE_RECORDS / FAN^2
        return level.groupBy(F.col("up").alias("pos")).agg(F.sha2(F.concat_ws("", F.transform(
            F.array_sort(F.collect_list(F.struct("pos", "hash"))), lambda x: x["hash"])), 256).alias("hash"))

    per_file = -(-FILE_RECORDS // FAN)
    level = stored(leaves.select(F.col("idx").alias("pos"), "hash").withColumn(
        "up", F.floor(F.col("pos") / FILE_RECORDS) * per_file + F.floor(F.pmod("pos", F.lit(FILE_RECORDS)) / FAN)), "leaves")
    levels = [level]
    ups = [F.floor(F.col("pos") / per_file)]  # from ranges of a file to the file
    while True:
        level = parents(level).withColumn("up", ups.pop(0) if ups else F.floor(F.col("pos") / FAN))
        level = stored(level, "nodes")
        levels.append(level)
        top = level.agg(F.count(F.lit(1)), F.max("pos")).first()
        if not ups and len(levels) > 2 and (not top[0] or top[1] == 0):
            return levels


def differing(left: list[DataFrame], right: list[DataFrame]) -> DataFrame:
    """(pos, left_hash, right_hash) of the records that differ or exist on one
    side only: from the roots down, a level is read under differing nodes only."""
    deep = max(len(left), len(right))
    found = None
    for k in range(deep - 1, -1, -1):
        sides = [t[k] if k < len(t) else None for t in (left, right)]
        if None in sides:  # the other tree is lower: everything below is compared
            continue
        a, b = (s if found is None else s.join(found, s["up"] == found["node"], "left_semi") for s in sides)
        pairs = a.select("pos", F.col("hash").alias("left_hash")).join(b.select("pos", F.col("hash").alias("right_hash")), "pos", "full")
        pairs = pairs.where(~F.col("left_hash").eqNullSafe(F.col("right_hash")))
        if k == 0:
            return pairs
        found = stored(pairs.select(F.col("pos").alias("node")), "differing")
    raise AssertionError("a tree has leaves")


def audit(index: DataFrame, replica: DataFrame) -> DataFrame:
    """page_id, file, offset, length, kind (changed, missing or extra), hash and
    replica_hash of each record of the archive ``index`` that ``replica`` (idx,
    hash) does not hold as it is."""
    bad = stored(differing(tree(index), tree(replica)), "bad")
    named = bad.join(index, bad["pos"] == index["idx"], "left")
    kind = F.when(F.col("right_hash").isNull(), "missing").when(F.col("left_hash").isNull(), "extra").otherwise("changed")
    return named.select("page_id", F.floor(F.col("pos") / FILE_RECORDS).cast("long").alias("file"), "offset", "length",
                        kind.alias("kind"), F.col("left_hash").alias("hash"), F.col("right_hash").alias("replica_hash"))
