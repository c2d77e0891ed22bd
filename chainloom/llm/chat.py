"""Preference formatting of conversations; DataFrame functions only.

The longest common turn prefix of a chosen and a rejected conversation is rendered once as the
prompt. What follows in each is its completion, with the spans of characters that a loss counts:
the contents of the assistant's turns and their end marks. All else is masked.

Scale: one shuffle groups the turns of a conversation, one joins the pairs. A rendered conversation
is one value of one row, so the longest conversation bounds a row; groups of equal conversations
do not meet anywhere.

Defined results: turns are in the order of (turn, role, text), nulls first; null role or text is
the empty text; rows with a null conversation id are left out; a conversation without a partner
has no prompt, and the other side's columns are null; equal conversations have empty completions;
repeated rows are repeated turns. Columns other than the four named are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Marks before and behind a turn.
BEGIN, END = "<|im_start|>", "<|im_end|>"
TRAINED = "assistant"


def _render(turn):
    return F.concat(F.lit(BEGIN), turn["role"], F.lit("\n"), turn["text"], F.lit(END + "\n"))


def _spans(turns):
    """[begin, end) of what a loss counts, over the characters of the rendered turns."""
    head = lambda t: F.char_length(t["role"]) + len(BEGIN) + 1
    body = lambda t: F.char_length(t["text"]) + len(END)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin:int,end:int>>").alias("spans"))

    def step(acc, t):
        begin = acc["at"] + head(t)
        span = F.array(F.struct(begin.alias("begin"), (begin + body(t)).alias("end")))
        return F.struct((begin + body(t) + 1).alias("at"), F.when(t["role"] == TRAINED, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def conversations(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows (id, turns): the turns of each conversation in order."""
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return df.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def preference_format(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """Formats pairs of conversations: both sides have rows (pair_id, id, turns).

    Returns pair_id, chosen_id, rejected_id, n_prompt_turns, prompt, chosen, chosen_spans, rejected,
    rejected_spans.
    """
    none = F.array().cast("array<struct<turn:bigint,role:string,text:string>>")
    c = chosen.select("pair_id", F.col("id").alias("chosen_id"), F.col("turns").cast("array<struct<turn:bigint,role:string,text:string>>").alias("c"))
    r = rejected.select("pair_id", F.col("id").alias("rejected_id"), F.col("turns").cast("array<struct<turn:bigint,role:string,text:string>>").alias("r"))
    both = c.join(r, "pair_id", "full").withColumn("c", F.coalesce("c", none)).withColumn("r", F.coalesce("r", none))
    pairs = F.slice(F.arrays_zip("c", "r"), 1, F.least(F.size("c"), F.size("r")))
    equal = F.transform(pairs, lambda p: (p["c"]["role"] == p["r"]["role"]) & (p["c"]["text"] == p["r"]["text"]))
    first = F.array_position(equal, F.lit(False)).cast("int")
    both = both.withColumn("k", F.when(F.size(equal) == 0, 0).when(first > 0, first - 1).otherwise(F.size(equal)))
    rest = lambda x: F.slice(x, F.col("k") + 1, F.size(x))
    text = lambda turns: F.array_join(F.transform(turns, _render), "")
    side = lambda x, i: [F.when(F.col(i).isNotNull(), text(rest(x))), F.when(F.col(i).isNotNull(), _spans(rest(x)))]
    chosen_text, chosen_spans = side("c", "chosen_id")
    rejected_text, rejected_spans = side("r", "rejected_id")
    return both.select(
        "pair_id", "chosen_id", "rejected_id", F.col("k").cast("long").alias("n_prompt_turns"), text(F.slice("c", 1, F.col("k"))).alias("prompt"),
        chosen_text.alias("chosen"), chosen_spans.alias("chosen_spans"), rejected_text.alias("rejected"), rejected_spans.alias("rejected_spans"),
    )
