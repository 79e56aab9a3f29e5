"""Exact order statistics and exact splits by distributed selection.

``select_ranks`` finds the values at given ranks of every group without a sort and
without one task that holds a group's distinct values.  Each round counts the values
of an interval in ``BINS`` bins, which tasks sum before the shuffle; the bin that holds
the wanted rank becomes the next interval, with its least and largest value as ends.
Intervals shrink by the number of bins, more where values are sparse, and end when both
ends are the same value or at most ``BINS`` rows are left, which are put in order.  Rows of a group never meet: a group of a third of all rows is
``BINS`` counts from each task.

Null, NaN and infinite values take no part.  Null groups are groups of their own.
Nothing of the rows comes to the driver but the count of open intervals per round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path
from .ordering import sorted_copy, sum_before

#: Parts that an interval of values is cut into each round.
BINS = 1024
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _same(a: DataFrame, b: DataFrame, by: list[str]) -> Column:
    cond = F.lit(True)
    for c in by:
        cond = cond & a[c].eqNullSafe(b[c])
    return cond


def _values(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Stored ``(g0, g1, ..., v)`` of the rows that take part; one group without ``by``."""
    kind = df.schema[value].dataType
    v = F.col(value).cast("long") if isinstance(kind, _WHOLE) else F.col(value).cast("double")
    rows = df.select(*(F.col(c).alias(f"g{i}") for i, c in enumerate(by)), *([] if by else [F.lit(0).alias("g0")]), v.alias("v"))
    if isinstance(kind, _WHOLE):
        return _stored(rows.filter(F.col("v").isNotNull()), "values")
    return _stored(rows.filter(F.abs("v") < float("inf")).withColumn("v", F.col("v") + 0.0), "values")


def _groups(by: list[str]) -> list[str]:
    return [f"g{i}" for i in range(max(1, len(by)))]


def _bin(rows: DataFrame) -> Column:
    """Number of the bin of ``v`` between ``lo`` and ``hi``; grows with ``v`` and
    differs between the two ends."""
    if isinstance(rows.schema["v"].dataType, T.LongType):
        v, lo, hi = (F.col(c).cast("decimal(20,0)") for c in ("v", "lo", "hi"))
        part = (v - lo).cast("double") / (hi - lo).cast("double")
    else:
        v, lo, hi = F.col("v"), F.col("lo"), F.col("hi")
        # halves, as the difference of the ends may be beyond a double
        even = (v / 2 - lo / 2) / (hi / 2 - lo / 2)
        far = F.greatest(F.abs(lo), F.abs(hi)) / F.least(F.abs(lo), F.abs(hi)) > BINS
        part = F.when((lo <= 0) & (hi >= 0), (F.signum(v) + 1) / 2) \
            .when(far, (F.ln(F.abs(v)) - F.ln(F.abs(lo))) / (F.ln(F.abs(hi)) - F.ln(F.abs(lo)))).otherwise(even)
    inner = F.least(F.greatest(F.floor(part * (BINS - 2)), F.lit(0)), F.lit(BINS - 3)) + 1
    return F.when(F.col("v") == F.col("lo"), 0).when(F.col("v") == F.col("hi"), BINS - 1).otherwise(inner).cast("int")


def _ordered(rows: DataFrame, g: list[str], state: DataFrame) -> DataFrame:
    """The values at the ranks of intervals that hold at most ``BINS`` rows, in order."""
    spans = state.select(*g, "lo", "hi").distinct()
    inside = rows.join(spans, _same(rows, spans, g) & rows["v"].between(spans["lo"], spans["hi"])) \
        .select(*(spans[c] for c in g), "lo", "hi", "v")
    w = Window.partitionBy(*g, "lo", "hi").orderBy("v")
    inside = inside.select("*", (F.row_number().over(w) - 1).alias("nth"), (F.rank().over(w) - 1).alias("smaller"))
    s, i = state.alias("s"), inside.alias("i")
    return s.join(i, [_same(state, inside, [*g, "lo", "hi"]), F.col("s.rank") - F.col("s.below") == F.col("i.nth")]) \
        .select(*(F.col(f"s.{c}") for c in g), "s.rank", F.col("i.v").alias("value"), (F.col("s.below") + F.col("i.smaller")).alias("below"))


def _select(rows: DataFrame, g: list[str], targets: DataFrame) -> DataFrame:
    """``targets(g.., rank)`` with ``value``, and ``below``, the number of smaller values
    in the group.  Ranks count from 0; a rank beyond the group's rows gives no row."""
    ends = rows.groupBy(*g).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("n"))
    ends = ends.filter("n > 0")
    t, e = targets.alias("t"), ends.alias("e")
    state = t.join(e, _same(targets, ends, g)).filter("t.rank >= 0 AND t.rank < e.n") \
        .select(*(F.col(f"t.{c}") for c in g), "t.rank", "e.lo", "e.hi", F.lit(0).cast("long").alias("below"), "e.n")
    state = _stored(state, "ranks")
    done = []
    while True:
        done.append(state.filter("lo = hi").select(*g, "rank", F.col("lo").alias("value"), "below"))
        state = state.filter("lo < hi")
        few, open_spans = state.select(F.count_if(F.col("n") <= BINS), F.count_if(F.col("n") > BINS)).first()
        if few:
            done.append(_ordered(rows, g, state.filter(F.col("n") <= BINS)))
        if not open_spans:
            break
        state = state.filter(F.col("n") > BINS)
        spans = state.select(*g, "lo", "hi").distinct()
        inside = rows.join(spans, _same(rows, spans, g) & rows["v"].between(spans["lo"], spans["hi"])) \
            .select(*(spans[c] for c in g), "lo", "hi", "v")
        bins = inside.withColumn("bin", _bin(inside)).groupBy(*g, "lo", "hi", "bin") \
            .agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("first"), F.max("v").alias("last"))
        # at most BINS rows in a window
        before = Window.partitionBy(*g, "lo", "hi").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        bins = bins.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        at = F.col("s.rank") - F.col("s.below") - F.col("b.before")
        s, b = state.alias("s"), bins.alias("b")
        state = _stored(
            s.join(b, _same(state, bins, [*g, "lo", "hi"])).filter((at >= 0) & (at < F.col("b.n")))
            .select(*(F.col(f"s.{c}") for c in g), "s.rank", F.col("b.first").alias("lo"), F.col("b.last").alias("hi"),
                    (F.col("s.below") + F.col("b.before")).alias("below"), "b.n"), "ranks")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def select_ranks(df: DataFrame, by: list[str], value: str, ranks: list[int]) -> DataFrame:
    """``(by.., rank, value, below)``: the value at each rank (from 0) of each group and
    how many of its values are smaller."""
    rows, g = _values(df, by, value), _groups(by)
    targets = rows.select(*g).distinct().withColumn("rank", F.explode(F.array(*(F.lit(int(r)).cast("long") for r in ranks))))
    return _named(_select(rows, g, targets), by)


def _named(df: DataFrame, by: list[str]) -> DataFrame:
    return df.select(*(F.col(f"g{i}").alias(c) for i, c in enumerate(by)), *(c for c in df.columns if c not in _groups(by)))


def quantiles(df: DataFrame, by: list[str], value: str, qs=(0.0, 0.25, 0.5, 0.75, 1.0)) -> DataFrame:
    """``(by.., n, q, value)``: exact quantiles with linear interpolation between the two
    neighbouring ranks.  Groups without a value have no row."""
    rows, g = _values(df, by, value), _groups(by)
    wanted = rows.groupBy(*g).agg(F.count(F.lit(1)).alias("n")).filter("n > 0") \
        .withColumn("q", F.explode(F.array(*(F.lit(float(q)) for q in qs)))) \
        .withColumn("at", F.col("q") * (F.col("n") - 1)).withColumn("low", F.floor("at")).withColumn("high", F.ceil("at"))
    both = wanted.select(*g, F.explode(F.array("low", "high")).alias("rank")).distinct()
    found = _stored(_select(rows, g, both), "quantiles")
    w, a, b = wanted.alias("w"), found.alias("a"), found.alias("b")
    key = lambda side: [F.col(f"w.{c}").eqNullSafe(F.col(f"{side}.{c}")) for c in g]
    joined = w.join(a, [*key("a"), F.col("w.low") == F.col("a.rank")]).join(b, [*key("b"), F.col("w.high") == F.col("b.rank")])
    low, high = F.col("a.value").cast("double"), F.col("b.value").cast("double")
    share = F.col("w.at") - F.col("w.low")
    # weights of both ends: their difference may be beyond a double
    mid = F.when(low == high, low).otherwise(low * (1 - share) + high * share)
    return _named(joined.select(*(F.col(f"w.{c}") for c in g), "w.n", "w.q", mid.alias("value")), by)


def describe(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """A11 per group: count, mean, std, min, quartiles and max of ``value``."""
    rows = _values(df, by, value)
    moments = _named(rows, by).groupBy(*by).agg(F.count("v").alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"))
    names = {0.0: "min", 0.25: "p25", 0.5: "p50", 0.75: "p75", 1.0: "max"}
    q = quantiles(df, by, value, tuple(names)).groupBy(*by) \
        .agg(*(F.max(F.when(F.col("q") == k, F.col("value"))).alias(v) for k, v in names.items()))
    return moments.join(q, _same(moments, q, by)).select(*(moments[c] for c in by), "count", "mean", "std", *names.values())


def quantile(df: DataFrame, value: str, q: float = 0.5) -> Column:
    """An exact quantile of the whole table as a scalar; null for no values."""
    return quantiles(df, [], value, (q,)).select("value").scalar()


def split_key(col: str, seed: int) -> Column:
    """A whole number below 2^60 from the MD5 of the id and the seed; null ids count as
    empty ones."""
    text = F.concat_ws("-", F.coalesce(F.col(col).cast("string"), F.lit("")), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def exact_split(df: DataFrame, by: list[str], fractions=(0.8, 0.2), col: str = "id", seed: int = 42, part: str = "part") -> DataFrame:
    """``df`` with the number of its part, stratified by ``by`` ([] for a plain split).

    Of a stratum's n rows the first j parts hold exactly ``floor(n * (f1 + .. + fj) + 1/2)``
    in the order of :func:`split_key` of ``col``.  The key at each quota is found by
    selection, so a row only compares its key with its stratum's cuts.  Rows of the same key
    as a cut (copies of an id) are numbered over a stored, range-partitioned copy, and
    as many of them as the quota still asks for go below it.  ``df`` has to give the same
    rows each time it is read.
    """
    if any(f < 0 for f in fractions) or abs(sum(fractions) - 1) > 1e-9:
        raise ValueError("fractions are not negative and sum to 1")
    g = [f"_g{i}" for i in range(len(by))]
    s = _groups(by)
    rows = df.withColumns({"_key": split_key(col, seed)} | {k: F.col(c) for k, c in zip(g, by)})
    keys = _values(rows, g, "_key")
    total, shares = 0.0, []
    for f in fractions[:-1]:
        total += f
        shares.append(total)
    if not shares:
        return df.withColumn(part, F.lit(0))
    quota = F.array(*(F.struct(F.lit(j).alias("j"), F.floor(F.col("n") * F.lit(s) + 0.5 + 1e-9).cast("long").alias("quota")) for j, s in enumerate(shares)))
    cuts = keys.groupBy(*s).agg(F.count(F.lit(1)).alias("n")).select(*s, F.inline(quota))
    at = _select(keys, s, cuts.select(*s, (F.col("quota") - 1).alias("rank")).distinct())
    c, a = cuts.alias("c"), at.alias("a")
    same = [F.col(f"c.{k}").eqNullSafe(F.col(f"a.{k}")) for k in s]
    # a quota of no rows has no key: every row stands above it
    held = c.join(a, [*same, F.col("a.rank") == F.col("c.quota") - 1], "left").select(
        *(F.col(f"c.{k}").alias(f"_s{k}") for k in s),
        F.struct("c.j", F.coalesce("a.value", F.lit(-1).cast("long")).alias("key"),
                 F.coalesce(F.col("c.quota") - F.col("a.below"), F.lit(0).cast("long")).alias("room")).alias("cut"))
    # one entry for each cut of the split in an array
    per = _stored(held.groupBy(*(f"_s{k}" for k in s)).agg(F.array_sort(F.collect_list("cut")).alias("_cuts")), "cuts")
    if by:
        rows = rows.join(per, [F.col(k).eqNullSafe(F.col(f"_s{i}")) for k, i in zip(g, s)]).drop(*(f"_s{k}" for k in s))
    else:
        rows = rows.withColumn("_cuts", per.select("_cuts").scalar())
    tie = F.exists("_cuts", lambda x: x["key"] == F.col("_key"))
    ties = sorted_copy(rows.filter(tie), [*g, "_key"])
    before = sum_before(ties.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n")), "_n", "_off")
    ties = ties.join(F.broadcast(before), "_pid").withColumn("_at", F.col("_off") + F.col("_rn")).drop("_pid", "_rn", "_off")
    first = ties.groupBy(*g, "_key").agg(F.min("_at").alias("_first"))
    t, f = ties.alias("t"), first.alias("f")
    ties = t.join(f, [F.col(f"t.{k}").eqNullSafe(F.col(f"f.{k}")) for k in [*g, "_key"]]) \
        .select("t.*", (F.col("t._at") - F.col("f._first") + 1).alias("_nth")).drop("_at")
    both = rows.filter(~tie).withColumn("_nth", F.lit(0).cast("long")).unionByName(ties)
    above = F.size(F.filter("_cuts", lambda x: (x["key"] < F.col("_key")) | ((x["key"] == F.col("_key")) & (x["room"] < F.col("_nth")))))
    return both.withColumn(part, above).select(*df.columns, part)
