"""The trie of conversation prefixes, with sums over its subtrees.

Turns are numbered within their conversation from a range-partitioned copy, so a
conversation of any length fills many tasks. A prefix is named by two 64-bit lanes,
the exclusive or of a hash of each turn with its place in the conversation: running
totals again, with no chain through one task. Prefixes of equal name and depth are
one node; its smallest member and its depth name it outside. Children, leaves and
savings are pre-aggregated; sums over subtrees come from the centroid decomposition
of the parent edges (:mod:`forest`).

``rebuilt`` is the input rule of the query: each conversation takes the first h
turns of the one whose number is the next lower multiple of ``group``, then its own
from the h-th on, with h = crc32(number) mod ``spread``.

The digest of the conversations that end in a node runs over their numbers in order:
sorted runs of up to 1,000 are joined where they lie, and only those strings of a
node pass one after another through a hash.

Defined cases: rows of null conv_id belong to no conversation; null roles and texts
are empty; turns that are equal or null come in the order of the SHA-256 of role and
text, and rows that repeat are turns of their own; a conversation may be left
without turns and then ends in the root; an empty table has no nodes, not even a
root; further columns are not read.
"""

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import sorted_copy
from .common import stored
from .forest import PIECE, prefixes, rollup

#: Numbers in a run of the digest.
RUN = 1000

_KEY = ["depth", "x", "y"]


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, idx, a, b, size): every turn's place, the lanes of its content and
    the bytes of its text."""
    t = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    content = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)
    t = t.select("conv_id", "turn", content.alias("sha"), F.octet_length("text").cast("long").alias("size"),
                 F.monotonically_increasing_id().alias("tie"))
    copy = sorted_copy(t, ["conv_id", "turn", "sha", "tie"])
    lanes = [F.conv(F.substring("sha", i, 16), 16, -10).cast("long").alias(n) for i, n in ((1, "a"), (17, "b"))]
    return prefixes(copy.select("conv_id", "_pid", "_rn", *lanes, "size", F.lit(1).cast("long").alias("idx")), "conv_id", sums=("idx",)) \
        .select("conv_id", (F.col("idx") - 1).alias("idx"), "a", "b", "size")


def rebuilt(turns: DataFrame, group: int = 5, spread: int = 9) -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos, last, a, b, size) of the rebuilt conversations' turns, and
    (conv_id, length) of all of them."""
    turns = stored(turns, "turns")
    convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    convs = stored(convs.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % group).alias("base"),
                                (F.crc32(F.col("conv_id").cast("string").cast("binary")) % spread).alias("h")), "conversations")
    lent = F.least("h", F.coalesce("n_base", F.lit(0)))
    convs = convs.join(convs.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base")), "base", "left")
    convs = stored(convs.select("conv_id", "base", "h", lent.alias("lent"), (lent + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "plans")
    cols = ["conv_id", "pos", (F.col("pos") == F.col("length") - 1).alias("last"), "a", "b", "size"]
    own = turns.join(convs, "conv_id").where("idx >= h").withColumn("pos", F.col("idx") - F.col("h") + F.col("lent")).select(*cols)
    # the first few turns of a conversation for the few that borrow them
    first = turns.where(F.col("idx") < spread - 1).select(F.col("conv_id").alias("base"), F.col("idx").alias("pos"), "a", "b", "size")
    borrowed = convs.where("lent > 0").join(first, "base").where("pos < lent").select(*cols)
    return own.union(borrowed), convs.select("conv_id", "length")


def named_prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, x, y, up_x, up_y, last, size): the name of each prefix of
    (conv_id, pos, last, a, b, size) and of the one without its last turn."""
    t = turns.withColumns({"lx": F.xxhash64("pos", "a", "b"), "ly": F.xxhash64(F.lit("y"), "b", "a", "pos")})
    copy = sorted_copy(t.select("conv_id", "pos", "last", "size", "lx", "ly"), ["conv_id", "pos"])
    p = prefixes(copy.withColumns({"x": F.col("lx"), "y": F.col("ly")}), "conv_id", xors=("x", "y"))
    return p.select("conv_id", (F.col("pos") + 1).alias("depth"), "x", "y", F.col("x").bitwiseXOR(F.col("lx")).alias("up_x"),
                    F.col("y").bitwiseXOR(F.col("ly")).alias("up_y"), "last", "size")


def _digests(batches):
    """SHA-256 over the strings of each node, which come one after another."""
    key, state = None, None

    def out():
        return pa.record_batch([pa.array([v], pa.int64()) for v in key] + [pa.array([state.hexdigest()])], [*_KEY, "ends_sha256"])

    for b in batches:
        for d, x, y, text in zip(*(b.column(n).to_pylist() for n in [*_KEY, "text"])):
            if key != (d, x, y):
                if key is not None:
                    yield out()
                key, state = (d, x, y), hashlib.sha256(text.encode())
            else:
                state.update(b"," + text.encode())
    if key is not None:
        yield out()


def ends(members: DataFrame) -> DataFrame:
    """(depth, x, y, ends_sha256) of (conv_id, depth, x, y)."""
    copy = sorted_copy(members, [*_KEY, "conv_id"])
    run = copy.groupBy(*_KEY, "_pid", F.floor(F.col("_rn") / RUN).alias("run")) \
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("text"))
    order = [*_KEY, "_pid", "run"]
    run = run.repartition(*_KEY).sortWithinPartitions(*order).select(*_KEY, "text")
    return run.mapInArrow(_digests, "depth long, x long, y long, ends_sha256 string")


def prefix_trie(turns: DataFrame, conversations: DataFrame, piece: int = PIECE) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and
    ends_sha256 of each node of the trie of ``turns`` (conv_id, pos, last, a, b, size);
    ``conversations`` (conv_id, length) holds those without turns too."""
    p = stored(named_prefixes(turns), "prefixes")
    zero = [F.lit(0).cast("long").alias(n) for n in ("x", "y")]
    none = [F.lit(None).cast("long").alias(n) for n in ("up_x", "up_y")]
    nodes = p.groupBy(*_KEY).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("size").alias("size"),
                                 F.min("up_x").alias("up_x"), F.min("up_y").alias("up_y"))
    root = conversations.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0") \
        .select(F.lit(0).cast("long").alias("depth"), *zero, "conv_id", "n_convs", F.lit(0).cast("long").alias("size"), *none)
    nodes = stored(nodes.select(*root.columns).union(root), "nodes")
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("x").alias("up_x"), F.col("y").alias("up_y"), F.col("conv_id").alias("parent_conv_id"))
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("up_x").alias("x"), F.col("up_y").alias("y")) \
        .agg(F.count(F.lit(1)).alias("n_children"))
    full = nodes.join(above, ["depth", "up_x", "up_y"], "left").join(children, _KEY, "left")
    full = stored(full.select(*_KEY, "conv_id", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "size"), "trie")
    parent = F.when(F.col("parent_conv_id").isNotNull(), F.struct(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")))
    sums = rollup(full.select(F.struct("conv_id", "depth").alias("node"), parent.alias("parent"),
                              (F.col("n_children") == 0).cast("long").alias("n_leaves"),
                              ((F.col("n_convs") - 1) * F.col("size")).alias("saved_tokens")), ["n_leaves", "saved_tokens"], piece)
    done = p.where("last").select("conv_id", *_KEY).union(
        conversations.where("length = 0").select("conv_id", F.lit(0).cast("long").alias("depth"), *zero))
    out = full.join(sums.select("node.conv_id", "node.depth", "n_leaves", "saved_tokens"), ["conv_id", "depth"]) \
        .join(ends(done), _KEY, "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                      F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, group: int = 5, spread: int = 9, piece: int = PIECE) -> DataFrame:
    """The trie of the rebuilt conversations of (conv_id, turn, role, text)."""
    turns, lengths = rebuilt(numbered_turns(conversations), group, spread)
    return prefix_trie(turns, lengths, piece)
