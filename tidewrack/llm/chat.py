"""Chat formatting of preference pairs.

The turns that chosen and rejected conversation share from the start are rendered once, as
the prompt; what follows in each is its completion, with the spans of it that a loss should
count: the text of assistant turns and their end mark, never a header or another speaker.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, located

#: Fixed values of the chat template.
HEAD, AFTER_ROLE, END = "<|im_start|>", "\n", "<|im_end|>\n"
TRAINED_ROLE = "assistant"


def _rendered(t):
    return F.concat(F.lit(HEAD), t["role"], F.lit(AFTER_ROLE), t["text"], F.lit(END))


def _text(turns):
    return F.array_join(F.transform(turns, _rendered), "")


def _spans(turns):
    """Trained spans (start, end) in characters of the rendered turns."""
    def span(t, at):
        start = at + len(HEAD) + F.length(t["role"]) + len(AFTER_ROLE)
        return F.struct(start.alias("start"), (start + F.length(t["text"]) + len(END.rstrip("\n"))).alias("end"), (t["role"] == TRAINED_ROLE).alias("trained"))
    every = located(turns, lambda t: F.length(_rendered(t)), span, "struct<start:int,end:int,trained:boolean>")
    return F.transform(F.filter(every, lambda s: s["trained"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))


def preference_pairs(turns: DataFrame, pair_col: str = "pair_id", side_col: str = "side", turn_col: str = "turn",
                     role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row per pair: pair_id, n_prompt_turns, prompt, and for chosen and rejected the
    completion and its trained spans.

    ``turns`` has a row per turn; side is 'chosen' or 'rejected', other rows are ignored, as
    are further columns. Turns stand in order of turn, null first, then role and text; equal
    rows are equal turns. Null roles and texts are empty. A pair that lacks a side has an
    empty completion there and shares no turns. Rows without a pair id form no pair. No
    turns: no rows. A pair is one row, so its conversations must fit in a row; their turns
    meet in one task for each pair only.
    """
    one = F.struct(column(turns, turn_col).alias("turn"), F.coalesce(column(turns, role_col).cast("string"), F.lit("")).alias("role"),
                   F.coalesce(column(turns, text_col), F.lit("")).alias("text"))
    rows = turns.select(column(turns, pair_col).alias("pair_id"), column(turns, side_col).alias("side"), one.alias("t"))
    rows = rows.where(F.col("pair_id").isNotNull() & F.col("side").isin("chosen", "rejected"))

    def side(name: str):
        return F.array_sort(F.collect_list(F.when(F.col("side") == name, F.col("t")))).alias(name)
    pairs = rows.groupBy("pair_id").agg(side("chosen"), side("rejected"))
    return formatted(pairs)


def formatted(pairs: DataFrame) -> DataFrame:
    """The columns of :func:`preference_pairs` from (pair_id, chosen, rejected): arrays of turns (turn, role, text) in order."""
    same = F.zip_with("chosen", "rejected", lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False)))
    shared = F.array_position(same, F.lit(False)) - 1
    shared = F.when(shared < 0, F.size(same).cast("long")).otherwise(shared)
    pairs = pairs.withColumn("n_prompt_turns", shared)
    n = F.col("n_prompt_turns").cast("int")

    def rest(name: str):
        return F.slice(name, n + 1, F.greatest(F.lit(0), F.size(name) - n))
    pairs = pairs.select("pair_id", "n_prompt_turns", F.slice("chosen", F.lit(1), n).alias("p"), rest("chosen").alias("c"), rest("rejected").alias("r"))
    return pairs.select("pair_id", "n_prompt_turns", _text(F.col("p")).alias("prompt"),
                        _text(F.col("c")).alias("chosen"), _spans(F.col("c")).alias("chosen_spans"),
                        _text(F.col("r")).alias("rejected"), _spans(F.col("r")).alias("rejected_spans"))


def alternatives(conversations: DataFrame) -> DataFrame:
    """(pair_id, chosen, rejected) made from plain conversations (conv_id, turn, role, text): a
    conversation is the chosen side; the rejected side is the same up to its last assistant turn, then
    the last assistant turn of its neighbour (conv_id xor 1). A conversation without neighbour, or
    whose neighbour lacks such a turn, has a rejected side that ends there; one without assistant turn is
    rejected as it is.

    Neighbours meet in one exchange. Turns stand in order of turn, null first, then role and text; null
    roles and texts are empty, and a null turn counts as before all others. Equal rows are equal
    turns; of several last assistant turns with one number the greatest by text is swapped and
    the others stay in chosen alone. Rows without a conversation id are left out. No rows: no pairs.
    """
    def turn_of(x):
        return F.struct(x["turn"].alias("turn"), x["role"].alias("role"), x["text"].alias("text"))

    def own(id_):
        return F.transform(F.filter("all", lambda x: x["conv_id"] == id_), turn_of)

    def last(turns: str):
        said = F.filter(turns, lambda x: x["role"] == TRAINED_ROLE)
        return F.array_max(F.transform(said, lambda x: F.struct(F.coalesce(x["turn"], F.lit(-1)).alias("turn"), x["role"].alias("role"), x["text"].alias("text"))))
    c = conversations.where("conv_id is not null").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    two = c.groupBy(F.shiftright("conv_id", 1).alias("two")).agg(F.array_sort(F.collect_list(F.struct("conv_id", "turn", "role", "text"))).alias("all"))
    each = two.select("all", F.explode(F.array_distinct(F.transform("all", lambda x: x["conv_id"]))).alias("pair_id"))
    sides = each.select("pair_id", own(F.col("pair_id")).alias("chosen"), own(F.col("pair_id").bitwiseXOR(F.lit(1))).alias("other"))
    ends = sides.select("pair_id", "chosen", last("chosen").alias("last"), last("other").alias("swap"))
    kept = F.filter("chosen", lambda x: F.col("last").isNull() | F.coalesce(x["turn"] < F.col("last.turn"), F.col("last.turn") >= 0))
    instead = F.when(F.col("last").isNotNull() & F.col("swap").isNotNull(), F.array(F.struct(F.col("last.turn").alias("turn"), F.col("swap.role").alias("role"), F.col("swap.text").alias("text"))))
    return ends.select("pair_id", "chosen", F.concat(kept, F.coalesce(instead, F.slice("chosen", F.lit(1), F.lit(0)))).alias("rejected"))
