import inspect
import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from chatterlens.llm import urls

PAGES = "page_id long, url string, html string"


def brute_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host):]).group()


def brute_rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def urls_given():
    rnd = random.Random(4)
    out = []
    for i in range(400):
        host = rnd.choice(["www.", "m.", "", "Blog."]) + rnd.choice(["alpha", "beta", "gamma"]) + ".example." + rnd.choice(["net", "org", "com"])
        out.append(f"{rnd.choice(['http', 'https'])}://{host}/{rnd.choice(['en', 'es', 'fr', 'de'])}/{rnd.randint(1, 9999)}{rnd.choice(['', '/', '?a=/de/', '#x'])}")
    return out + [None, "", "no scheme", "://", "http://", "http://org", "http://ORG/", "x://a.b?c", "http://example.org/en/12", "http://notorg/es/",
                  "ftp://deep.example.org/es/1", "http://é.net/ü\n/1", "http://a.net/" + "long/" * 2000]


def test_rules_and_parts(spark):
    given = urls_given()
    rows = urls.judge_urls(spark.createDataFrame([(i, u, None) for i, u in enumerate(given)], PAGES)).collect()
    assert len(rows) == len(given)
    for r in rows:
        host, path = brute_parts(given[r.page_id])
        assert (r.host, r.path) == (host, path)
        rule, verdict = brute_rule(host, path)
        assert r.rule == rule and (r.verdict == verdict or rule is None) and r.verdict in ("allow", "block")


def test_model_matches_brute_force(spark):
    rnd = random.Random(8)
    train = [("".join(rnd.choices("abc/1", k=rnd.randint(0, 9))), rnd.random() < 0.5) for _ in range(120)]
    asked = ["", "a", "abc", "zzz/1", "c/1ab", "bbbbbbbb"]
    counts = {True: Counter(), False: Counter()}
    k = urls.ORDER
    for s, ok in train:
        p = "\u0002" * k + s + "\u0003"
        for i in range(k, len(p)):
            for o in range(k + 1):
                counts[ok][p[i - o:i + 1]] += 1
                counts[ok][("context", o, p[i - o:i])] += 1

    def log_p(p, i, ok):
        v = 1 / 256
        for o in range(k + 1):
            v = (counts[ok][p[i - o:i + 1]] + urls.BACKOFF * v) / (counts[ok][("context", o, p[i - o:i])] + urls.BACKOFF)
        return math.log(v)

    table = spark.createDataFrame(train, "seq string, ok boolean")
    asks = spark.createDataFrame([(s,) for s in asked], "seq string").withColumn("uid", F.monotonically_increasing_id())
    grams = urls._grams(asks)
    scored = {r.gram: r.d for r in urls.score_ngrams(urls.ngram_counts(table), grams.select("gram").distinct()).collect()}
    for s in asked:
        p = "\u0002" * k + s + "\u0003"
        for i in range(k, len(p)):
            want = log_p(p, i, True) - log_p(p, i, False)
            assert abs(scored[p[i - k:i + 1]] / 1e9 - want) < 1e-8


def test_held_out_urls_are_told_apart(spark):
    rnd = random.Random(6)
    rows = []
    for i in range(600):
        good = i % 2 == 0
        word = rnd.choice(["garden", "kitchen", "library"] if good else ["casino", "poker", "jackpot"]) + str(rnd.randint(1, 99))
        ruled = i % 3 != 0
        host = ("a.org" if good else "b.com") if ruled else "c.net"
        rows.append((i, f"http://{host}/{'' if good or not ruled else 'de/'}{word}", None))
    out = urls.judge_urls(spark.createDataFrame(rows, PAGES)).where("rule IS NULL").collect()
    assert sum((r.verdict == "allow") == (r.page_id % 2 == 0) for r in out) > 0.97 * len(out)


def test_calibrated_threshold(spark):
    rows = [(0.10, False), (0.20, False), (0.31, True), (0.42, True), (0.25, False)]
    assert urls.calibrated_threshold(spark.createDataFrame(rows, "score double, ok boolean")) == 0.31
    assert urls.calibrated_threshold(spark.createDataFrame([], "score double, ok boolean")) == 0.0


def test_defined_cases(spark):
    none = spark.createDataFrame([], PAGES)
    assert urls.judge_urls(none).count() == 0
    one = spark.createDataFrame([(None, "http://x.net/a", None), (1, None, None), (1, None, None)], PAGES)
    rows = urls.judge_urls(one.withColumn("host", F.lit(1)).withColumn("score", F.lit(2)).withColumn("uid", F.lit(3))).collect()
    assert len(rows) == 3 and all(r.verdict == "allow" and r.score == 0 for r in rows)


def test_no_python_in_tasks():
    text = inspect.getsource(urls)
    assert not re.search(r"udf|pandas|Arrow|\.rdd", text)
