"""URL filter: rules first, then a character language-model ratio.

URLs that a rule allows or blocks train two smoothed variable-order Markov
models over the characters of host and path, one of accepted and one of rejected
URLs. The probability of a character after a context of up to ``ORDER``
characters is interpolated with that after the next shorter context, down to the
uniform one. URLs that no rule fits are judged by the mean difference of the two
log-likelihoods per character, against a threshold calibrated on a fifth of the
ruled URLs, which the models have not seen.

Everything is DataFrame functions: n-grams are counted once at the longest
order, shorter orders are summed from those counts; each different n-gram is
scored once, stored, and joined to the positions of the URLs, where adaptive
execution splits n-grams that every URL has.

Defined cases: a null url or one without ``://`` has empty host and path, fits
no rule and is judged as an empty sequence; with no training URL of one class,
both models fall back to the uniform one, so the score is 0 and the threshold 0
allows; repeated rows each give a row; an empty table gives no row; further
columns are never read.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Longest context in characters; weight of the next shorter context.
ORDER, BACKOFF = 4, 2.0
#: Rows of the n-gram tables of the two shortest orders that are broadcast at
#: most; beyond it they are joined like the others.
BROADCAST_ROWS = 50_000
#: (verdict, host, path prefix)
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/")]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    empty = F.lit("")
    return F.coalesce(F.translate(host, _UPPER, _LOWER), empty), F.coalesce(path, empty)


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):  # the longest is asked first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def _grams(df: DataFrame) -> DataFrame:
    """A row for each character of ``seq`` and its end: context and character."""
    padded = F.concat(F.lit("\u0002" * ORDER), "seq", F.lit("\u0003"))
    return (df.withColumn("_p", F.explode(F.sequence(F.lit(1), F.length("seq") + 1)))
            .withColumn("gram", F.substring(padded, F.col("_p"), F.lit(ORDER + 1))).drop("_p", "seq"))


def ngram_counts(train: DataFrame) -> DataFrame:
    """(gram, a, r): occurrences in accepted and rejected URLs of ``train`` (seq, ok)."""
    return _grams(train.select("seq", "ok")).groupBy("gram").agg(
        F.sum(F.col("ok").cast("long")).alias("a"), F.sum((~F.col("ok")).cast("long")).alias("r"))


def score_ngrams(counts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(gram, d): difference of the two models' log-probabilities of the last
    character of each wanted n-gram, in whole billionths so that sums are exact."""
    out = wanted.withColumn("pa", F.lit(1 / 256)).withColumn("pr", F.lit(1 / 256))
    for k in range(ORDER + 1):
        own, context = F.substring("gram", ORDER + 1 - k, k + 1), F.substring("gram", ORDER + 1 - k, k)
        seen = counts.groupBy(own.alias("g")).agg(F.sum("a").alias("ga"), F.sum("r").alias("gr"))
        before = counts.groupBy(context.alias("c")).agg(F.sum("a").alias("ca"), F.sum("r").alias("cr"))
        if k < 2:
            seen, before = stored(seen, "grams"), stored(before, "contexts")
            if seen.count() <= BROADCAST_ROWS:
                seen, before = F.broadcast(seen), F.broadcast(before)
        out = (out.withColumn("g", own).withColumn("c", context).join(seen, "g", "left").join(before, "c", "left")
               .fillna(0, ["ga", "gr", "ca", "cr"])
               .withColumn("pa", (F.col("ga") + BACKOFF * F.col("pa")) / (F.col("ca") + BACKOFF))
               .withColumn("pr", (F.col("gr") + BACKOFF * F.col("pr")) / (F.col("cr") + BACKOFF))
               .select("gram", "pa", "pr"))
    return out.select("gram", F.round((F.log("pa") - F.log("pr")) * 1e9).cast("long").alias("d"))


def calibrated_threshold(scores: DataFrame) -> float:
    """The cut in hundredths with the best balanced accuracy on (score, ok), ties
    nearest to 0; the scores are gathered as counts per hundredth."""
    bins = [(r.b, r.a, r.r) for r in scores.groupBy(F.floor(F.col("score") * 100).cast("long").alias("b")).agg(
        F.sum(F.col("ok").cast("long")).alias("a"), F.sum((~F.col("ok")).cast("long")).alias("r")).collect()]
    good, bad = sum(x[1] for x in bins), sum(x[2] for x in bins)
    if not good or not bad:
        return 0.0
    best = max({b for b, _, _ in bins} | {0}, key=lambda c: (
        sum(a for b, a, _ in bins if b >= c) / good + sum(r for b, _, r in bins if b < c) / bad, -abs(c)))
    return best / 100


def judge_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score (mean log-likelihood difference
    per character where the models judge, else null) of every row."""
    host, path = url_parts(F.col("url"))
    base = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    base = base.withColumn("rule", rule).withColumn("verdict", verdict)
    base = base.withColumn("seq", F.concat("host", "path")).withColumn("uid", F.monotonically_increasing_id())
    base = stored(base, "urls")
    apart = F.pmod(F.xxhash64("seq"), F.lit(5)) == 0
    ruled = base.where("verdict IS NOT NULL").withColumn("ok", F.col("verdict") == "allow")
    counts = stored(ngram_counts(ruled.where(~apart)), "counts")
    totals = counts.agg(F.sum("a"), F.sum("r")).first()
    if not totals[0] or not totals[1]:  # no model without both classes
        counts = counts.limit(0)
    judged = base.where(F.col("verdict").isNull() | apart)
    at = _grams(judged.select("uid", "seq"))
    scored = stored(score_ngrams(counts, at.select("gram").distinct()), "scored")
    sums = at.join(scored, "gram").groupBy("uid").agg((F.sum("d") / F.count("d") / 1e9).alias("score"))
    sums = stored(sums, "sums")
    checked = sums.join(ruled.where(apart).select("uid", "ok"), "uid")
    threshold = calibrated_threshold(checked)
    return (base.join(sums, "uid", "left")
            .select("page_id", "host", "path", "rule",
                    F.coalesce("verdict", F.when(F.col("score") >= threshold, "allow").otherwise("block")).alias("verdict"),
                    F.when(F.col("rule").isNull(), F.col("score")).alias("score")))
