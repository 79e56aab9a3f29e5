import random

import pytest
import sentencepiece
from pyspark.sql import functions as F

from chatterlens.llm import common, pieces
from helpers import docs

TEXTS = ["", " ", "  ", "Hello world", "  a  b\n\tc ", "ａﬁ ①", "éè ▁x▁▁", "▁", "\x00a\ufffd", "word " * 20_000, "x" * 3000,
         "日本語 text", "<s> <0x0A> <unk>", "🙂🙂 ok"]


def brute(v, text, texts):
    """Best segmentation of the whole text, position by position."""
    by_text = {t: i for i, t in enumerate(texts) if v.plain[i]}
    chars = ["▁" if c == " " else "\0literal" if c == "▁" else c for c in " " + text]
    best = [(0.0, None, None)]
    for end in range(1, len(chars) + 1):
        top = (best[end - 1][0] + v.lowest, 1, None)
        for size in range(1, min(end, 16) + 1):
            part = chars[end - size:end]
            i = by_text.get("".join(part)) if "\0literal" not in part else None
            if i is not None and best[end - size][0] + v.scores[i] >= top[0]:
                top = (best[end - size][0] + v.scores[i], size, i)
        best.append(top)
    out, end = [], len(chars)
    while end:
        _, size, i = best[end]
        raw = "▁" if chars[end - 1] == "\0literal" else chars[end - 1]
        out.append([i] if i is not None else [v.byte_ids[b] for b in raw.encode()])
        end -= size
    return [x for p in reversed(out) for x in p] if text else []


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


def encode(v, texts):
    return [x if x is None else x.tolist() for x in v.encode(texts, pieces.Memory())]


def random_texts(alphabet, n=400):
    rnd = random.Random(2)
    return ["".join(rnd.choices(alphabet, k=rnd.randint(1, 60))) for _ in range(n)]


def test_scores_decide_without_merges(library):
    v = pieces.load(merges=False)
    texts = [library.id_to_piece(i) for i in range(library.vocab_size())]
    v.plain = [not (library.is_control(i) or library.is_unknown(i) or library.is_byte(i)) for i in range(len(texts))]
    given = [t for t in TEXTS if len(t) < 2000] + random_texts("abcdeth ▁ é\nZ", 200)
    for t, ids in zip(given, encode(v, given)):
        assert ids == brute(v, t, texts), t


def test_ids_are_those_of_the_library(spark, library):
    given = [t for t in TEXTS if "▁" not in t] + random_texts("abcdeth  é\nZ.$") + random_texts("aab  ") + random_texts("日本🙂x <>0A")
    given += [r.text for r in common.table(spark, "/root/testdata/sf0.001", "documents").collect() if r.text is not None]
    for t, ids in zip(given, encode(pieces.load(), given)):
        assert ids == library.encode(t), t


def test_texts_come_back_whole(library):
    v = pieces.load()
    for t, ids in zip(TEXTS, encode(v, TEXTS)):
        assert v.decode(ids) == t
        if "▁" not in t:
            assert library.decode(ids) == t and v.decode(library.encode(t)) == t


def test_hashes_of_pieces_differ():
    v = pieces.load()
    assert len(set(v.keys[:len(v.ids)].tolist())) == len(v.ids) and v.deepest < 8


def test_columns_and_defined_cases(spark):
    common.small_batches(spark)
    table = docs(spark, [*TEXTS, None, TEXTS[3], TEXTS[3]]).withColumn("ids", F.lit("x")).withColumn("e", F.lit(0))
    rows = table.select("doc_id", "text", pieces.encode_column("text").alias("made")).select(
        "doc_id", "text", "made.*", pieces.decode_column(F.col("made.ids")).alias("back")).collect()
    assert len(rows) == len(TEXTS) + 3
    for r in rows:
        assert r.back == r.text and r.lossless == (None if r.text is None else True)
        assert (r.ids is None) == (r.text is None)
    assert docs(spark, []).select(pieces.encode_column("text")).count() == 0


def test_forgetting_changes_nothing(monkeypatch):
    v, memory = pieces.load(), pieces.Memory()
    whole = encode(v, TEXTS)
    monkeypatch.setattr(pieces, "PAIRS", 1 << 4)
    small = pieces.load.__wrapped__()
    assert encode(small, TEXTS) == whole
    monkeypatch.setattr(pieces, "REMEMBERED", 3)
    assert [v.encode([t], memory)[0].tolist() for t in TEXTS] == whole
