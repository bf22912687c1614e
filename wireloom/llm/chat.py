"""Operator 5, chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: the turns before it as context, then its reply, the only
text under the loss mask. What follows the last reply gives one example without a target, so that the output holds
whole conversations. Turns are marked as

    <|im_start|>role<|im_sep|>text<|im_end|>

and a newline. Inside roles and texts every backslash is doubled, then each control string gets a backslash after
its first character; dropping one backslash of each group of one or two undoes both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, written

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
#: What may not stand in a text as it is: this template's markers and those of other common ones, cut after the first character.
CONTROL = r"([<\[])(\|im_start\|>|\|im_sep\|>|\|im_end\|>|\|endoftext\|>|\|startoftext\|>|/?s>|/?INST\]|<SYS>>|</SYS>>)"


def escaped(c: Column) -> Column:
    return F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit(CONTROL), F.lit(r"$1\\$2"))


def unescaped(c: Column) -> Column:
    return F.regexp_replace(c, F.lit(r"\\(\\?)"), F.lit("$1"))


def examples(turns: DataFrame) -> DataFrame:
    """(conv_id, example, formatted, loss_start, loss_chars): loss_start and loss_chars in code points of `formatted`.

    turns: conv_id, turn, role, text, one row a turn, ordered by turn (ties by role, then text; nulls first). Null roles
    and texts are empty; a null conv_id is one conversation; an empty table gives no example; other columns are not
    read. Output grows with the square of a conversation's turns, as the method has it, never with the table's.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    whole = Window.partitionBy("conv_id")
    role, text = escaped(F.coalesce("role", F.lit(""))), escaped(F.coalesce("text", F.lit("")))
    rows = turns.select(
        "conv_id", F.row_number().over(order).alias("at"), F.count(F.lit(1)).over(whole).alias("n"), "role", text.alias("reply"),
        F.concat(F.lit(START), role, F.lit(SEP)).alias("head"), F.coalesce(F.concat_ws("", F.collect_list(F.concat(F.lit(START), role, F.lit(SEP), text, F.lit(END))).over(order.rowsBetween(Window.unboundedPreceding, -1))), F.lit("")).alias("before"),
    )
    target = F.coalesce(F.col("role") == "assistant", F.lit(False))
    rows = rows.where(target | (F.col("at") == F.col("n")))
    return rows.select(
        "conv_id", F.col("at").cast("long").alias("example"), F.concat("before", "head", "reply", F.lit(END)).alias("formatted"),
        (F.length("before") + F.length("head")).cast("long").alias("loss_start"), F.when(target, F.length("reply")).otherwise(0).cast("long").alias("loss_chars"),
    )


def turns_of(formatted: Column) -> Column:
    """The turns of a formatted text, as an array of (role, text), unescaped."""
    parts = F.split(formatted, F.lit(r"<\|im_end\|>\n"))
    parts = F.slice(parts, 1, F.size(parts) - 1)
    return F.transform(parts, lambda p: F.struct(
        unescaped(F.substring_index(F.substr(p, F.lit(len(START) + 1)), SEP, 1)).alias("role"),
        unescaped(F.substr(p, F.instr(p, SEP) + len(SEP))).alias("text"),
    ))


def read_back(rows: DataFrame) -> DataFrame:
    """Per conversation, from examples alone: its turns, the text under the loss mask, and digests of both."""
    loss = F.struct("example", unescaped(F.substr("formatted", (F.col("loss_start") + 1).cast("int"), F.col("loss_chars").cast("int"))).alias("text"))
    per = rows.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("whole"), F.array_sort(F.collect_list(loss)).alias("losses"),
        F.sum(F.length("formatted")).cast("long").alias("formatted_chars"),
    )
    turns = turns_of(F.col("whole"))
    per = per.withColumns({"turns": turns, "loss": F.concat_ws("", F.transform("losses", lambda x: x["text"]))})
    flat = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return per.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(flat, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation, and of one full of control strings, read back from the written examples."""
    said = "</s>[INST] ok [/INST]"
    given = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return read_back(written(examples(given.unionByName(probe)), "chat"))


OP5_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), o AS (
  SELECT *, row_number() OVER w AS pos, count(*) OVER (PARTITION BY conv_id) AS n,
    12 + 10 + 11
    + length(regexp_replace(replace(role, '\', '\\'), '([<\[])(\|im_start\|>|\|im_sep\|>|\|im_end\|>|\|endoftext\|>|\|startoftext\|>|/?s>|/?INST\]|<SYS>>|</SYS>>)', '\1\\\2', 'g'))
    + length(regexp_replace(replace(text, '\', '\\'), '([<\[])(\|im_start\|>|\|im_sep\|>|\|im_end\|>|\|endoftext\|>|\|startoftext\|>|/?s>|/?INST\]|<SYS>>|</SYS>>)', '\1\\\2', 'g')) AS chars
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), c AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY pos) AS so_far FROM o
)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(so_far) FILTER (role = 'assistant' OR pos = n)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
