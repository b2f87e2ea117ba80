"""Chat formatting as a relational query: Spark expressions only.

Turns are collected as structs and sorted by (turn, role, text); runs of adjacent
turns of one role become one message, whose texts a separator divides; messages are
concatenated. The template is

    <|im_start|>ROLE\\nTEXT[<|im_sep|>TEXT...]<|im_end|>\\n

A control string can't occur inside a text: every ``<|`` of a text is written as
``<||``, and no control string begins so. Reading back turns ``<||`` into ``<|``.
Roles are escaped likewise, and a line feed inside a role becomes ``<|nl|>``.

Defined results: a null text or role is empty; a null turn sorts first; turns of
equal rank are ordered by role, then text, and repeated rows are repeated turns; a
null conversation id is a conversation of its own; an empty table gives no rows; only
the four named columns are read. A conversation is one output string, so its turns
meet in one task; a copy of a turn in many conversations is not brought together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, SEP, NL = "<|im_start|>", "<|im_end|>\n", "<|im_sep|>", "<|nl|>"


def escape(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("<||"))


def unescape(text: Column) -> Column:
    return F.replace(text, F.lit("<||"), F.lit("<|"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit(NL))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(NL), F.lit("\n")))


def sorted_turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turns: the turns of each conversation in order."""
    one = F.struct(rows[turn].cast("long").alias("turn"), F.coalesce(rows[role], F.lit("")).alias("role"), F.coalesce(rows[text], F.lit("")).alias("text"))
    return rows.select(rows[conv].alias("conv_id"), one.alias("one")).groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).alias("turns"))


def merged_messages(turns: Column) -> Column:
    """array<struct<role, texts>>: adjacent turns of one role become one message."""
    n = F.size(turns)
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (turns[i]["role"] != turns[F.greatest(i - 1, F.lit(0))]["role"]))
    ends = F.concat(F.slice(starts, 2, F.size(starts)), F.array(n))
    return F.zip_with(starts, ends, lambda a, b: F.struct(turns[a]["role"].alias("role"), F.transform(F.slice(turns, a + 1, b - a), lambda t: t["text"]).alias("texts")))


def format_conversations(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, segments array<struct<chars, loss>>.

    segments divide formatted without a gap; those with loss hold the (escaped) texts of loss_role.
    """
    messages = sorted_turns(rows, conv, turn, role, text).select("conv_id", merged_messages(F.col("turns")).alias("messages"))

    def parts(m: Column) -> Column:
        """Header, then text and what follows it, again and again."""
        last = F.size(m["texts"]) - 1
        head = F.array(F.struct(F.concat(F.lit(START), escape_role(m["role"]), F.lit("\n")).alias("s"), F.lit(False).alias("loss")))
        body = F.transform(
            m["texts"],
            lambda x, i: F.array(
                F.struct(escape(x).alias("s"), (m["role"] == loss_role).alias("loss")),
                F.struct(F.when(i == last, F.lit(END)).otherwise(F.lit(SEP)).alias("s"), F.lit(False).alias("loss")),
            ),
        )
        return F.concat(head, F.flatten(body))

    pieces = messages.select("conv_id", F.flatten(F.transform("messages", parts)).alias("pieces"))
    return pieces.select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda p: p["s"]), "").alias("formatted"),
        F.transform("pieces", lambda p: F.struct(F.length(p["s"]).alias("chars"), p["loss"].alias("loss"))).alias("segments"),
    )


def loss_text(formatted: Column, segments: Column) -> Column:
    """The texts that the segments with loss cut out of formatted, unescaped and joined.

    Goes through the characters once, as cutting at each segment would read the string from its start again.
    """
    none, one = F.lit(0), F.lit(1)
    marks = lambda s: F.when(~s["loss"], F.array_repeat(none, s["chars"])).when(s["chars"] == 0, F.array_repeat(none, F.lit(0))).otherwise(F.concat(F.array_repeat(one, s["chars"] - 1), F.array(F.lit(2))))
    kept = F.zip_with(F.split(formatted, ""), F.flatten(F.transform(segments, marks)), lambda c, m: F.when(m == 0, "").when(m == 2, F.concat(c, F.lit(SEP))).otherwise(c))
    return F.array_join(F.transform(F.split(F.array_join(kept, ""), r"\Q<|im_sep|>\E"), unescape), "")


def parse_formatted(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted string, one entry a turn."""
    blocks = F.transform(F.split(formatted, r"\Q<|im_end|>\E\n"), lambda b: F.substr(b, F.lit(len(START) + 1)))
    whole = F.slice(blocks, 1, F.greatest(F.size(blocks) - 1, F.lit(0)))

    def turns(b: Column) -> Column:
        role = F.substring_index(b, "\n", 1)
        texts = F.split(F.substr(b, F.length(role) + 2), r"\Q<|im_sep|>\E")
        return F.transform(texts, lambda t: F.struct(unescape_role(role).alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(whole, turns))
