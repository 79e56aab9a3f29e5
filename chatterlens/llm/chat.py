"""Preference formatting of paired conversations.

The chosen and the rejected conversation of a pair are compared turn by turn;
the turns before the first one that differs in role or text (or that one of them
lacks) are the longest common prefix. They are rendered once, as the prompt; the
rest of each conversation is its completion, with the character spans of the
assistant's turns that a model is trained on, and of no other.

Turns are compared and rendered as rows: a conversation is gathered only in
chunks of ``CHUNK`` turns, so even one of a third of all rows never is one group.
Almost every pair is one row; of a longer one, ``chunk`` numbers the pieces, and
joined in that order prompts, completions and spans are the same for any ``CHUNK``:
spans count from the start of the whole completion, by running totals of the
pieces' lengths.

Defined cases: null role or text is empty; turns of a null id or number are left
out; several rows of one turn number are ordered by role and text; a pair with
only one conversation has no common prefix; equal conversations are all prompt,
with empty completions; an empty table gives no row; further columns are never
read.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import sorted_copy
from .common import stored
from .forest import prefixes

#: Turns rendered in one row.
CHUNK = 256


def render(role: Column, text: Column) -> Column:
    """One turn in chat markup."""
    return F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), text, F.lit("<|im_end|>\n"))


def _turns(df: DataFrame, side: str) -> DataFrame:
    # numbered within (pair, turn), which only repeated turn numbers share
    again = Window.partitionBy("pair_id", "turn").orderBy("role", "text")
    clean = df.where("pair_id IS NOT NULL AND turn IS NOT NULL").select(
        "pair_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return clean.withColumn("copy", F.row_number().over(again)).select(
        "pair_id", "turn", "copy", F.col("role").alias(f"{side}_role"), F.col("text").alias(f"{side}_text"))


def format_preferences(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """pair_id, chunk, prompt, prompt_turns, chosen, chosen_spans, rejected,
    rejected_spans from the turns (pair_id, turn, role, text) of both sides;
    spans are [start, end) of the trained characters in the whole completion."""
    rows = _turns(chosen, "c").join(_turns(rejected, "r"), ["pair_id", "turn", "copy"], "full")
    same = (F.col("c_role") == F.col("r_role")) & (F.col("c_text") == F.col("r_text"))
    rows = rows.withColumn("at", F.struct("turn", "copy")).withColumn("differs", ~F.coalesce(same, F.lit(False)))
    split = rows.groupBy("pair_id").agg(F.min(F.when(F.col("differs"), F.col("at"))).alias("split"))
    rows = rows.join(split, "pair_id").withColumn("common", F.col("split").isNull() | (F.col("at") < F.col("split")))
    # a turn's chunk by its number; turn numbers are those of the table
    rows = rows.withColumn("chunk", F.floor(F.col("turn") / CHUNK).cast("long"))

    def gathered(side, when):
        here = F.col(f"{side}_role").isNotNull() & when
        return F.array_sort(F.collect_list(F.when(here, F.struct("at", F.col(f"{side}_role").alias("role"), F.col(f"{side}_text").alias("text")))))

    whole = rows.groupBy("pair_id", "chunk").agg(gathered("c", F.col("common")).alias("p"),
                                                 gathered("c", ~F.col("common")).alias("c"), gathered("r", ~F.col("common")).alias("r"))

    def text(turns):
        return F.concat_ws("", F.transform(turns, lambda t: render(t["role"], t["text"])))

    def spans(turns):
        step = F.aggregate(turns, F.struct(F.lit(0).cast("long").alias("end"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans")),
                           lambda a, t: F.struct(
                               (a["end"] + F.length(render(t["role"], t["text"]))).cast("long").alias("end"),
                               F.when(t["role"] == "assistant", F.concat(a["spans"], F.array(F.struct(
                                   (a["end"] + F.length(F.concat(F.lit("<|im_start|>"), t["role"], F.lit("\n")))).cast("long").alias("start"),
                                   (a["end"] + F.length(render(t["role"], t["text"])) - 1).cast("long").alias("end")))))
                               .otherwise(a["spans"]).alias("spans")))
        return step["spans"]

    pieces = stored(whole.select("pair_id", "chunk", text(F.col("p")).alias("prompt"), F.size("p").cast("long").alias("prompt_turns"),
                                 text(F.col("c")).alias("chosen"), spans(F.col("c")).alias("chosen_spans"),
                                 text(F.col("r")).alias("rejected"), spans(F.col("r")).alias("rejected_spans")), "pieces")
    sizes = pieces.select("pair_id", "chunk", *[F.length(c).cast("long").alias(f"{c}_end") for c in ("chosen", "rejected")])
    ends = prefixes(sorted_copy(sizes, ["pair_id", "chunk"]), "pair_id", sums=("chosen_end", "rejected_end")).drop("_pid", "_rn")

    def moved(side):
        before = F.col(f"{side}_end") - F.length(side)
        return F.transform(f"{side}_spans", lambda s: F.struct((s["start"] + before).alias("start"), (s["end"] + before).alias("end"))).alias(f"{side}_spans")

    return pieces.join(ends, ["pair_id", "chunk"]).select(
        "pair_id", "chunk", "prompt", "prompt_turns", "chosen", moved("chosen"), "rejected", moved("rejected"))


def answer_pairs(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chosen, rejected) turns of one pair for each conversation: itself, and
    itself with its last assistant turn answered as the neighbouring
    conversation (ids 2n and 2n + 1) ends; without a neighbour's answer it keeps
    its own."""
    turns = conversations.where("conv_id IS NOT NULL AND turn IS NOT NULL").select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    last = turns.where("role = 'assistant'").groupBy("pair_id").agg(
        F.max("turn").alias("last"), F.max_by("text", F.struct("turn", F.coalesce("text", F.lit("")))).alias("answer"))
    other = last.select((F.col("pair_id").bitwiseXOR(F.lit(1))).alias("pair_id"), F.col("answer").alias("swap"), F.lit(True).alias("has"))
    known = last.select("pair_id", "last").join(other, "pair_id", "left")
    swapped = (F.col("turn") == F.col("last")) & (F.col("role") == "assistant") & F.col("has")
    rejected = turns.join(known, "pair_id", "left").select(
        "pair_id", "turn", "role", F.when(F.coalesce(swapped, F.lit(False)), F.col("swap")).otherwise(F.col("text")).alias("text"))
    return turns, rejected
