import duckdb
import pytest
from pyspark.sql import functions as F

from chatterlens.llm import chat

KIND = "pair_id long, turn long, role string, text string"


def brute(chosen, rejected):
    sides = [{}, {}]
    for side, rows in zip(sides, (chosen, rejected)):
        for p, t, role, text in rows:
            if p is not None and t is not None:
                side.setdefault(p, []).append((t, role or "", text or ""))
    out = {}
    for p in sides[0].keys() | sides[1].keys():
        c, r = (sorted(s.get(p, [])) for s in sides)
        n = 0
        while n < min(len(c), len(r)) and c[n] == r[n]:
            n += 1

        def made(turns):
            text, spans = "", []
            for _, role, body in turns:
                head = f"<|im_start|>{role}\n"
                if role == "assistant":
                    spans.append((len(text) + len(head), len(text) + len(head) + len(body) + len("<|im_end|>")))
                text += head + body + "<|im_end|>\n"
            return text, spans

        out[p] = (made(c[:n])[0], n, *made(c[n:]), *made(r[n:]))
    return out


def run(spark, chosen, rejected):
    sides = [spark.createDataFrame(x, KIND).withColumn("chunk", F.lit(1)).withColumn("at", F.lit("z")).withColumn("c_text", F.lit(0)) for x in (chosen, rejected)]
    rows = chat.format_preferences(*sides).collect()
    return {r.pair_id: (r.prompt, r.prompt_turns, r.chosen, [tuple(s) for s in r.chosen_spans], r.rejected, [tuple(s) for s in r.rejected_spans]) for r in rows}


def test_matches_brute_force(spark):
    u, a = "user", "assistant"
    chosen = [(1, 0, u, "q"), (1, 1, a, "yes é"), (2, 0, "system", "s"), (2, 1, u, "q"), (2, 2, a, "x"), (2, 3, u, "more"), (2, 4, a, "good"),
              (3, 0, u, "same"), (3, 1, a, "same"), (4, 0, u, "only chosen"), (5, 0, None, None), (5, 1, a, ""), (6, 0, u, "r"), (6, 0, u, "r"),
              (6, 1, a, "z"), (None, 0, u, "n"), (7, None, u, "n"), (8, 0, u, "x" * 50_000)]
    rejected = [(1, 0, u, "q"), (1, 1, a, "no"), (2, 0, "system", "s"), (2, 1, u, "q"), (2, 2, a, "x"), (2, 3, u, "other"), (3, 0, u, "same"),
                (3, 1, a, "same"), (5, 0, "", ""), (5, 1, a, "b"), (6, 0, u, "r"), (6, 0, u, "r"), (6, 1, a, "y"), (9, 0, a, "only rejected")]
    assert run(spark, chosen, rejected) == brute(chosen, rejected)


def test_trained_spans_are_the_answers(spark):
    got = run(spark, [(1, 0, "user", "q"), (1, 1, "assistant", "abc")], [(1, 0, "user", "q"), (1, 1, "assistant", "defg")])[1]
    (s, e), (t, f) = got[3][0], got[5][0]
    assert got[2][s:e] == "abc<|im_end|>" and got[4][t:f] == "defg<|im_end|>"


def joined(rows):
    """The pieces of each pair in order, as one row."""
    out = {}
    for r in sorted(rows, key=lambda r: (r.pair_id, r.chunk)):
        p = out.setdefault(r.pair_id, ["", 0, "", [], "", []])
        for i, part in enumerate((r.prompt, r.prompt_turns, r.chosen, [tuple(s) for s in r.chosen_spans], r.rejected, [tuple(s) for s in r.rejected_spans])):
            p[i] = p[i] + part
    return {k: tuple(v) for k, v in out.items()}


@pytest.mark.parametrize("chunk", [256, 7])
def test_long_conversations_do_not_depend_on_the_chunk(spark, monkeypatch, chunk):
    monkeypatch.setattr(chat, "CHUNK", chunk)
    chosen, rejected = [], []
    for pair, turns, split in ((1, 600, 3), (2, 1000, 700), (3, 5, 2), (4, 300, 300), (5, 258, 0)):
        rows = [(pair, t, "assistant" if t % 2 else "user", f"t{t}" * (1 + t % 3)) for t in range(turns)]
        chosen += rows
        rejected += rows[:split] + [(pair, t, role, text + "!") for _, t, role, text in rows[split:turns - turns // 9]]
    made = chat.format_preferences(*(spark.createDataFrame(x, KIND) for x in (chosen, rejected))).collect()
    assert joined(made) == brute(chosen, rejected)
    if chunk == 256:
        assert sorted(r.chunk for r in made if r.pair_id == 2) == [0, 1, 2, 3]


def test_query_and_sql_agree_on_long_conversations(spark, tmp_path):
    rows = [(c, t, "assistant" if t % 2 else "user", f"c{c} t{t}") for c in (0, 1, 4) for t in range(600 - 90 * c)] + [(5, 3, "assistant", "x")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    from chatterlens.llm.queries import SQL, op9_preferences
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    cur = con.execute(SQL["op9_preferences"])
    names = [c[0] for c in cur.description]
    got = op9_preferences(spark, str(tmp_path)).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(cur.fetchall()) and len(got) > 4


def test_empty(spark):
    assert run(spark, [], []) == {}
    conversations = spark.createDataFrame([(0, 0, "user", "q"), (0, 1, "assistant", "a"), (1, 0, "assistant", None), (2, 0, "user", "alone")],
                                          "conv_id long, turn long, role string, text string")
    made = {r.pair_id: r for r in chat.format_preferences(*chat.answer_pairs(conversations)).collect()}
    assert made[0].chosen.count("a<|im_end|>") and made[0].rejected == "<|im_start|>assistant\n<|im_end|>\n" and made[2].chosen == ""
