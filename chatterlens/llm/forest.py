"""Sums over the subtrees of a forest of parent edges by centroid decomposition.

The method: a component of n nodes has a centroid, the deepest node whose subtree in
the component holds at least half of it. All nodes of such a size form the path from
the component's top down to it. The total of the centroid and what hangs below it is
added to every node of that path; then the centroid goes, each child's part is a
component with the child as its top, and what stays above is one too, its path
shortened by what has gone. For any node and any node below it there is exactly one
component in which they are parted, so each node ends with the sum over its subtree
after log2(n) levels, whatever the shape: a chain is halved like a star.

On Spark, sizes of subtrees come from pointer doubling (log2(depth) rounds of equi-joins
and pre-aggregated sums), and so do preorder numbers, in which a subtree is an
interval: whether a node is below a centroid is a comparison, and its child part is
the last child before it in that order. Components beyond ``PIECE`` nodes are split
by level with joins, aggregates and windows over blocks of preorder numbers; what
the joins broadcast has a row for each such component, 2^18 rows at most. Components
of up to ``PIECE`` nodes are spread over the tasks, and a task runs the same levels
over many of them at once as numpy arrays. Rounds and levels are written to the
shared folder, so lost executors cost their tasks alone.

Defined cases: a node without a parent, or whose parent is no node, is a top; null
weights count as 0; an empty forest gives no rows; a cycle raises an error. Nodes
must be unique and not null, of any type that joins and sorts (structs too).
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import sorted_copy
from .common import stored

#: Nodes of a component that one task solves, in forests of up to 2^18 times as many.
PIECE = 1 << 14
#: Preorder numbers in a block of a window.
BLOCK_BITS = 18


def prefixes(copy: DataFrame, key: str, sums=(), xors=()) -> DataFrame:
    """``copy`` (a sorted copy, by ``key`` first) with each column of ``sums`` and
    ``xors`` replaced by its running total within the key, the row itself included.

    A key's rows may fill many partitions: totals run inside each, and what came
    before is carried to the partitions in which a key goes on (one key each).
    """
    fold = {c: F.sum for c in sums} | {c: F.bit_xor for c in xors}
    local = Window.partitionBy("_pid", key).orderBy("_rn").rowsBetween(Window.unboundedPreceding, 0)
    rest = [c for c in copy.columns if c not in fold]
    out = copy.select(*rest, *[f(c).over(local).alias(c) for c, f in fold.items()])
    totals = copy.groupBy("_pid", key).agg(*[f(c).alias(c) for c, f in fold.items()])
    past = Window.partitionBy(key).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(F.col("_pid").alias("_p"), F.col(key).alias("_k"), *[f(c).over(past).alias(f"_b_{c}") for c, f in fold.items()])
    carry = carry.where(F.col(f"_b_{next(iter(fold))}").isNotNull())  # at most one row for each partition
    out = out.join(F.broadcast(carry), (F.col("_pid") == F.col("_p")) & F.col(key).eqNullSafe(F.col("_k")), "left")

    def joined(c):
        before = F.coalesce(f"_b_{c}", F.lit(0))
        return (F.col(c) + before if fold[c] is F.sum else F.col(c).bitwiseXOR(before)).alias(c)

    return out.select(*rest, *[joined(c) for c in fold])


def _sizes(edges: DataFrame, most: int = 63) -> tuple[DataFrame, int]:
    """(node, full): nodes of each subtree; and the rounds it took, log2 of the depth.

    A round holds only the nodes that still have an ancestor at its distance."""
    act = stored(edges.where("parent IS NOT NULL").select("node", F.col("parent").alias("anc"), F.lit(1).cast("long").alias("full")), "active")
    found = [edges.select("node", F.lit(1).cast("long").alias("more"))]
    while act.limit(1).count():
        if len(found) > most:  # no path is longer than 2^63
            raise ValueError("the parents form a cycle")
        more = stored(act.groupBy(F.col("anc").alias("node")).agg(F.sum("full").alias("more")), "more")
        found.append(more)
        up = act.join(act.select(F.col("node").alias("anc"), F.col("anc").alias("up")), "anc").select("node", "up", "full")
        act = stored(up.join(more, "node", "left").select("node", F.col("up").alias("anc"), (F.col("full") + F.coalesce("more", F.lit(0))).alias("full")), "active")
    total = found[0]
    for f in found[1:]:
        total = total.union(f)
    return stored(total.groupBy("node").agg(F.sum("more").alias("full")), "sizes"), len(found) - 1


def _numbered(edges: DataFrame, sizes: DataFrame, rounds: int) -> DataFrame:
    """(node, pre, parent_pre, full, top, n): preorder numbers, the top of each node's
    tree and that tree's size."""
    family = sorted_copy(edges.select("node", "parent").join(sizes, "node").withColumn("before", F.col("full")), ["parent", "node"])
    off = prefixes(family, "parent", sums=("before",)).select("node", "parent", "full", (F.col("before") - F.col("full") + 1).alias("off"))
    top = F.when(F.col("parent").isNull(), F.struct((F.col("off") - 1).alias("pre"), F.col("full").alias("n")))
    cols = ["node", "anc", "full", "off", "sum", "top"]
    now = stored(off.select("node", F.col("parent").alias("anc"), "full", "off", F.col("off").alias("sum"), top.alias("top")), "numbers")
    act, done = now.where("anc IS NOT NULL"), now.where("anc IS NULL")
    for _ in range(rounds):
        above = done.union(act).select(F.col("node").alias("anc"), F.col("anc").alias("up"), F.col("sum").alias("more"), F.col("top").alias("up_top"))
        now = stored(act.join(above, "anc").select("node", F.col("up").alias("anc"), "full", "off", (F.col("sum") + F.col("more")).alias("sum"),
                                                   F.col("up_top").alias("top")).select(*cols), "numbers")
        act, done = now.where("anc IS NOT NULL"), done.union(now.where("anc IS NULL"))
    pre = F.col("sum") - 1
    return done.select("node", pre.alias("pre"), (pre - F.col("off")).alias("parent_pre"), "full", F.col("top.pre").alias("top"), F.col("top.n").alias("n"))


def _split(cur: DataFrame, weights: list[str]) -> DataFrame:
    """One level: every component of ``cur`` without its centroid (``gone``)."""
    on_path = 2 * F.col("left") >= F.col("n")
    found = cur.where(on_path).groupBy("top").agg(F.max(F.struct("pre", "full", "left")).alias("c"))
    x = cur.join(F.broadcast(found), "top")
    below = (F.col("pre") > F.col("c.pre")) & (F.col("pre") < F.col("c.pre") + F.col("c.full"))
    is_c = F.col("pre") == F.col("c.pre")
    totals = x.where(below | is_c).groupBy("top").agg(*[F.sum(w).alias(f"_t_{w}") for w in weights])
    x = x.join(F.broadcast(totals), "top")
    x = x.withColumns({f"sum_{w}": F.col(f"sum_{w}") + F.when(on_path, F.col(f"_t_{w}")).otherwise(0) for w in weights})
    x = x.withColumns({"gone": is_c, "left": F.when(on_path & ~is_c, F.col("left") - F.col("c.left")).otherwise(F.col("left"))})
    upper = x.where(~below).withColumn("n", F.when(is_c, F.col("n")).otherwise(F.col("n") - F.col("c.left")))
    # below a centroid, the part is that of the last child up to here
    child = F.when(F.col("parent_pre") == F.col("c.pre"), F.struct("pre", F.col("left").alias("n")))
    lower = x.where(below).withColumns({"child": child, "blk": F.shiftright("pre", BLOCK_BITS)})
    up_to = Window.partitionBy("blk", "top").orderBy("pre").rowsBetween(Window.unboundedPreceding, 0)
    last = lower.groupBy("blk", "top").agg(F.max("child").alias("last"))
    past = Window.partitionBy("top").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    last = last.select("blk", "top", F.max("last").over(past).alias("carry"))
    lower = lower.withColumn("child", F.max("child").over(up_to)).join(last, ["blk", "top"])
    part = F.coalesce("child", "carry")
    lower = lower.withColumns({"top": part["pre"], "n": part["n"]})
    return upper.select(*cur.columns).union(lower.select(*cur.columns))


def solve(comp, pre, parent_pre, full, left, weights) -> list[np.ndarray]:
    """Sums over the subtrees of many components, given as arrays sorted by component
    and preorder number; ``left`` is the size of a node's subtree in its component."""
    left = left.copy()
    sums = [np.zeros(len(pre), np.int64) for _ in weights]
    lab = np.cumsum(np.append(0, comp[1:] != comp[:-1])) if len(comp) else np.zeros(0, np.int64)
    at = np.arange(len(pre))
    while len(at):
        size = np.bincount(lab)
        path = 2 * left[at] >= size[lab]
        c = np.zeros(len(size), np.int64)
        np.maximum.at(c, lab[path], at[path])  # the deepest is the last in preorder
        mine = c[lab]
        below = (pre[at] > pre[mine]) & (pre[at] < pre[mine] + full[mine])
        is_c = at == mine
        inside = below | is_c
        for w, s in zip(weights, sums):
            total = np.zeros(len(size), np.int64)
            np.add.at(total, lab[inside], w[at[inside]])
            s[at[path]] += total[lab[path]]
        gone = left[c]
        cut = path & ~is_c
        left[at[cut]] -= gone[lab[cut]]
        stay = ~inside
        order = np.argsort(lab[below], kind="stable")
        low, low_lab = at[below][order], lab[below][order]
        starts = parent_pre[low] == pre[c[low_lab]]
        lab = np.concatenate([lab[stay], len(size) + np.cumsum(starts) - 1])
        at = np.concatenate([at[stay], low])
        if len(at):
            lab = np.unique(lab, return_inverse=True)[1]
    return sums


def _solver(weights: list[str]):
    """Whole components of a sorted stream, as many at a time as batches bring."""
    def part(table: pa.Table):
        col = {n: table.column(n).combine_chunks().to_numpy() for n in table.column_names if n != "node"}
        made = solve(col["top"], col["pre"], col["parent_pre"], col["full"], col["left"], [col[w] for w in weights])
        return pa.table([table.column("node")] + [pa.array(s + col[f"sum_{w}"], pa.int64()) for w, s in zip(weights, made)],
                        names=["node", *[f"sum_{w}" for w in weights]]).to_batches()

    def solved(batches):
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            held = pa.concat_tables([held, pa.Table.from_batches([b])]) if held is not None else pa.Table.from_batches([b])
            top = held.column("top").combine_chunks().to_numpy()
            cut = int(np.searchsorted(top, top[-1]))  # the last component may go on
            if cut:
                yield from part(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None:
            yield from part(held)
    return solved


def rollup(forest: DataFrame, weights: list[str], piece: int = PIECE) -> DataFrame:
    """(node, weights): each whole-number weight of (node, parent, weights) summed
    over the node's subtree, the node itself included."""
    kept = forest.select("node", "parent", *[F.coalesce(F.col(w).cast("long"), F.lit(0)).alias(w) for w in weights])
    known = kept.select(F.col("node").alias("parent"), F.col("node").alias("known"))
    edges = stored(kept.join(known, "parent", "left").select("node", F.col("known").alias("parent"), *weights), "edges")
    total = edges.count()
    piece = max(piece, total >> 18)  # so what a level broadcasts stays below 2^18 rows
    sizes, rounds = _sizes(edges)
    cols = ["node", "pre", "parent_pre", "full", "top", "n", "left", "gone", *weights, *[f"sum_{w}" for w in weights]]
    cur = _numbered(edges, sizes, rounds).join(edges.select("node", *weights), "node")
    cur = cur.withColumns({"left": F.col("full"), "gone": F.lit(False)} | {f"sum_{w}": F.lit(0).cast("long") for w in weights})
    cur = stored(cur.select(*cols), "components")
    big = ~F.col("gone") & (F.col("n") > piece)
    small, done = [], []
    while True:
        small.append(cur.where(~F.col("gone") & (F.col("n") <= piece)))
        done.append(cur.where("gone"))
        if not cur.where(big).limit(1).count():
            break
        cur = stored(_split(cur.where(big), weights), "components")
    parts, gone = small[0], done[0]
    for s, d in zip(small[1:], done[1:]):
        parts, gone = parts.union(s), gone.union(d)
    kind = edges.schema["node"].dataType.simpleString()
    fields = f"node {kind}, " + ", ".join(f"sum_{w} long" for w in weights)
    parts = parts.drop("gone", "n")
    solved = parts.repartition("top").sortWithinPartitions("top", "pre").mapInArrow(_solver(weights), fields)
    return solved.union(gone.select("node", *[f"sum_{w}" for w in weights])).select("node", *[F.col(f"sum_{w}").alias(w) for w in weights])
