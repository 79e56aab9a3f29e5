import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from chatterlens.llm import licenses
from helpers import docs


def run(spark, rows, **settings):
    table = docs(spark, rows).withColumn("found", F.lit(1)).withColumn("labels", F.lit(2))
    return licenses.scan_licenses(table, **settings).orderBy("doc_id").collect()


def words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def least_edits(notice, ws, most):
    """Fewest edits between the notice and any run of whole words, or None."""
    best = None
    for i in range(len(ws)):
        for j in range(i + 1, len(ws) + 1):
            run = " ".join(ws[i:j])
            if len(run) > len(notice) + most:
                break
            row = list(range(len(run) + 1))
            for a, x in enumerate(notice):
                last, row = row, [a + 1]
                for b, y in enumerate(run):
                    row.append(min(last[b] + (x != y), last[b + 1] + 1, row[b] + 1))
            if row[-1] <= most and (best is None or row[-1] < best):
                best = row[-1]
    return best


def brute(text):
    ws = words(text)
    starts = sorted((i, label) for n, label in licenses.BASE.items() for i in range(len(ws)) if ws[i:i + len(n.split())] == n.split())
    near = {n: least_edits(n, ws, len(n) // licenses.PER_EDIT) for n in licenses.NOTICES}
    base = {label for _, label in starts}
    return (len(ws), len(starts), starts[0][0] if starts else None, starts[-1][0] if starts else None, ",".join(sorted(base)),
            ",".join(sorted(base | {licenses.NOTICES[n] for n, e in near.items() if e is not None})),
            max([0.0, *(1 - e / len(n) for n, e in near.items() if e is not None)]))


def edited(rng, text, times):
    out = list(text)
    for _ in range(times):
        at = rng.randrange(len(out))
        kind = rng.choice("sid")
        letter = rng.choice("abceglmn ié")
        if kind == "s":
            out[at] = letter
        elif kind == "i":
            out.insert(at, letter)
        elif len(out) > 1:
            del out[at]
    return "".join(out)


def test_matches_brute_force(spark):
    rng = random.Random(5)
    filler = "the license of a general mit work éa is public by gnu cc apache 3 licence".split()
    texts = []
    for i in range(200):
        notice = rng.choice(list(licenses.NOTICES))
        text = edited(rng, notice, rng.randrange(0, 6)) if i % 5 else rng.choice(["Mit-License", "GNU General\nPublic License", "CC BY cc by"])
        texts.append(" ".join([*rng.choices(filler, k=rng.randrange(5)), text, *rng.choices(filler, k=rng.randrange(5))]))
    got = run(spark, texts)
    for r, text in zip(got, texts):
        want = brute(text)
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) == want[:6], text
        assert r.score == pytest.approx(want[6]), text


def test_spans(spark):
    r = run(spark, ["See the MIT licence, or\nthe Apache  License. (mit license)"])[0]
    assert [tuple(m) for m in r.matches] == [("mit", 2, 3, 1), ("apache", 6, 7, 0), ("mit", 8, 9, 0)]
    assert (r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == (2, 6, 8, "apache,mit", "apache,mit", 1.0)
    r = run(spark, ["éé ünder gnu genéral publc license éé"])[0]
    assert [tuple(m) for m in r.matches] == [("gpl", 2, 5, 2)] and r.n_base == 0 and r.base_labels == ""
    assert r.score == pytest.approx(1 - 2 / 26)


def test_defined_cases(spark):
    rows = [(None, "mit license"), (1, None), (2, ""), (3, "..."), (4, "mit license"), (4, "mit license"),
            (5, "cc by cc by"), (6, "license " * 30_000 + "mit licens"), (7, "é" * 200_000)]
    got = {}
    for r in run(spark, rows):
        got.setdefault(r.doc_id, []).append(r)
    for i in (1, 2, 3):
        r = got[i][0]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score, r.matches) == (0, 0, None, None, "", "", 0.0, [])
    assert len(got[4]) == 2 and len(got[None]) == 1
    assert (got[5][0].n_base, got[5][0].first_word, got[5][0].last_word) == (2, 0, 2)
    assert (got[6][0].n_words, got[6][0].labels) == (30_002, "mit")
    assert run(spark, []) == []


def test_other_notices(spark):
    r = run(spark, ["Alle Rechte vorbehalten, alle recht vorbehalten"], base={"alle rechte vorbehalten": "all"},
            notices={"alle rechte vorbehalten": "all"}, per_edit=10)[0]
    assert (r.n_base, r.labels) == (1, "all") and [m.edits for m in r.matches] == [0, 1]


def test_base_columns_match_sql(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    needles = " UNION ALL ".join(f"SELECT '{n}' AS n, '{label}' AS label" for n, label in licenses.BASE.items())
    want = duckdb.sql(f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM '{path}'),
p AS (SELECT doc_id, label, unnest(range(len(w))) AS i, w, string_split(n, ' ') AS n FROM d, ({needles})),
h AS (SELECT doc_id, label, i FROM p WHERE w[i + 1:i + len(n)] = n)
SELECT d.doc_id, len(any_value(d.w)), count(h.i), min(h.i), max(h.i), coalesce(string_agg(DISTINCT h.label, ',' ORDER BY h.label), '')
FROM d LEFT JOIN h USING (doc_id) GROUP BY d.doc_id""").fetchall()
    got = licenses.scan_licenses(spark.read.parquet(path)).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert sorted(want) == sorted(tuple(r) for r in got.collect())
