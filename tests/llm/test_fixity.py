import hashlib

from pyspark.sql import functions as F

from chatterlens.llm import fixity

PAGES = "page_id long, url string, html string"


def record(i, url, html):
    body = (html or "").encode()
    return (f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{'' if i is None else i}>\r\nWARC-Target-URI: {url or ''}\r\n"
            f"Content-Type: text/html\r\nContent-Length: {len(body)}\r\n\r\n").encode() + body + b"\r\n\r\n"


def pages(n=2500):
    return [(i, f"http://x/{i}", "é" * (i % 7) + f"<p>{i % 50}</p>") for i in range(n)] + [(None, None, None), (5, "http://x/5", "again"), (7, "u", ""), (7, "u", "")]


def frame(spark, rows):
    return spark.createDataFrame(rows, PAGES).withColumn("idx", F.lit("x")).withColumn("hash", F.lit(1))


def test_index_is_the_archive(spark):
    given = pages()
    rows = sorted(fixity.archive(frame(spark, given)).collect(), key=lambda r: r.idx)
    assert [r.idx for r in rows] == list(range(len(given)))
    offset = {}
    want = sorted((p[0] is not None, p[0] or 0, p[1] or "", hashlib.sha256(record(*p)).hexdigest(), len(record(*p))) for p in given)
    for r, w in zip(rows, want):
        assert (r.hash, r.length) == w[3:] and r.file == r.idx // fixity.FILE_RECORDS
        assert r.offset == offset.get(r.file, 0)
        offset[r.file] = r.offset + r.length


def brute_root(hashes):
    """One hash from all record hashes, file by file."""
    def level(nodes):
        return [hashlib.sha256("".join(nodes[i:i + fixity.FAN]).encode()).hexdigest() for i in range(0, len(nodes), fixity.FAN)]
    files = []
    for at in range(0, len(hashes), fixity.FILE_RECORDS):
        files.append(hashlib.sha256("".join(level(hashes[at:at + fixity.FILE_RECORDS])).encode()).hexdigest())
    while True:
        files = level(files)
        if len(files) == 1:
            return files[0]


def test_root_and_descent(spark):
    index = fixity.archive(frame(spark, pages()))
    rows = sorted(index.collect(), key=lambda r: r.idx)
    levels = fixity.tree(index)
    assert [r.hash for r in levels[-1].collect()] == [brute_root([r.hash for r in rows])]
    bad = {0: "changed", 999: "changed", 1000: "missing", 1717: "changed", len(rows) - 1: "missing"}
    replica = index.where(~F.col("idx").isin([i for i, k in bad.items() if k == "missing"])).select(
        "idx", F.when(F.col("idx").isin([i for i, k in bad.items() if k == "changed"]), "0" * 64).otherwise(F.col("hash")).alias("hash"))
    got = {r.offset: r for r in fixity.audit(index, replica).collect()}
    assert len(got) <= len(bad)
    found = fixity.audit(index, replica).join(index.select("idx", "file", "offset"), ["file", "offset"]).collect()
    assert {r.idx: r.kind for r in found} == bad


def test_equal_replicas_and_extra_records(spark):
    index = fixity.archive(frame(spark, pages(60)))
    same = index.select("idx", "hash")
    assert fixity.audit(index, same).count() == 0
    extra = same.union(spark.createDataFrame([(5000, "f" * 64)], "idx long, hash string"))
    rows = fixity.audit(index, extra).collect()
    assert [(r.kind, r.page_id, r.file) for r in rows] == [("extra", None, 5)]
    none = fixity.archive(frame(spark, []))
    assert fixity.audit(none, none.select("idx", "hash")).count() == 0
    assert {r.kind for r in fixity.audit(index, none.select("idx", "hash")).collect()} == {"missing"}
    assert {r.kind for r in fixity.audit(none, same).collect()} == {"extra"}
