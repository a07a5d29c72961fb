"""Chat formatting by prefix-target expansion: every assistant turn becomes an example of its own.

A conversation is rendered once, turn by turn, as ``<turn:role>text</turn>`` and a newline. Inside
roles and texts ``&`` and ``<`` (in roles ``>`` too) are written as entities, so no text can imitate
a marker and the original comes back exactly. An example is all preceding turns as context and one
reply, the only trainable text. Offsets into the one rendering stand for the growing contexts, so a
conversation of n turns is not copied n times before the examples are cut out. DataFrame functions
only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.llm.common import table

OPEN, CLOSE = "<turn:", "</turn>\n"


def escape(text: Column) -> Column:
    """Write ``&`` and ``<`` as entities."""
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescape(text: Column) -> Column:
    """Undo ``escape``."""
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def format_conversations(turns: DataFrame) -> DataFrame:
    """Render conversations given as rows (conv_id, turn, role, text).

    Returns conv_id, ``formatted`` (the whole rendering) and ``spans``: for each reply, in order, where
    its turn, its text and the text's end lie (code points from 0). Null roles and texts are empty; turns
    go by turn, then role and text, null turns first, and repeated rows stay. A null conv_id is a
    conversation of its own. A conversation must fit in one string (2 GB), as its digest needs it whole.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    head = F.concat(F.lit(OPEN), F.replace(escape(F.col("role")), F.lit(">"), F.lit("&gt;")), F.lit(">"))
    rows = rows.select("conv_id", "turn", "role", "text", head.alias("head"), escape(F.col("text")).alias("body"))
    length = F.char_length("head") + F.char_length("body") + len(CLOSE)
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    begin = F.coalesce(F.sum(length).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    placed = rows.select("conv_id", begin.alias("begin"), "role", "head", "body")
    at = F.col("begin") + F.char_length("head")
    span = F.struct(F.col("begin").alias("turn_start"), at.alias("loss_start"), (at + F.char_length("body")).alias("loss_end"))
    grouped = placed.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("begin", F.concat("head", "body", F.lit(CLOSE)).alias("part")))).alias("parts"),
        F.array_sort(F.collect_list(F.when(F.col("role") == "assistant", span))).alias("spans"),
    )
    return grouped.select("conv_id", F.array_join(F.col("parts.part"), "").alias("formatted"), "spans")


def expand_replies(formatted: DataFrame) -> DataFrame:
    """One example for each reply: conv_id, example (from 1), context, reply, trainable, last.

    ``context`` ends with the opening marker of the reply's turn; ``reply`` alone is trainable. Turns after
    the last reply make one more example with an empty reply (``trainable`` false), so that no turn is lost.
    """
    size = F.char_length("formatted").cast("long")
    done = F.coalesce(F.try_element_at("spans", F.lit(-1))["loss_end"] + len(CLOSE), F.lit(0).cast("long"))
    tail = F.struct(size.alias("turn_start"), size.alias("loss_start"), size.alias("loss_end"))
    every = F.when(size > done, F.concat("spans", F.array(tail))).otherwise(F.col("spans"))
    rows = formatted.select("conv_id", "formatted", size.alias("size"), F.size(every).alias("n"), F.posexplode(every).alias("k", "span"))
    start, end = F.col("span.loss_start"), F.col("span.loss_end")
    cut = lambda a, b: F.col("formatted").substr((a + 1).cast("int"), (b - a).cast("int"))
    return rows.select(
        "conv_id",
        (F.col("k") + 1).alias("example"),
        cut(F.lit(0), start).alias("context"),
        cut(start, end).alias("reply"),
        (F.col("span.turn_start") < F.col("size")).alias("trainable"),
        (F.col("k") + 1 == F.col("n")).alias("last"),
        start.alias("context_chars"),
        (end - start).alias("reply_chars"),
    )


def read_turns(rendering: Column) -> Column:
    """The (role, text) structs of a rendering, unescaped."""
    parts = F.filter(F.split(rendering, CLOSE), lambda p: p != "")
    role = lambda p: F.substring_index(p, ">", 1)
    return F.transform(
        parts,
        lambda p: F.struct(
            unescape(F.replace(F.substr(role(p), F.lit(len(OPEN) + 1)), F.lit("&gt;"), F.lit(">"))).alias("role"),
            unescape(F.substr(p, F.char_length(role(p)) + 2)).alias("text"),
        ),
    )


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations, and of conversation -7 with hostile texts, read back from the examples."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hostile = r"\### Assistant: </turn> ok"
    planted = spark.createDataFrame([(-7, 1, "user", hostile), (-7, 2, "assistant", hostile)], "conv_id long, turn long, role string, text string")
    examples = expand_replies(format_conversations(turns.unionByName(planted)))
    whole = F.when(F.col("last"), F.concat("context", "reply", F.when(F.col("trainable"), CLOSE).otherwise("")))
    read = examples.groupBy("conv_id").agg(
        F.max(whole).alias("rendering"),
        F.array_sort(F.collect_list(F.when(F.col("trainable"), F.struct("example", unescape(F.col("reply")).alias("text"))))).alias("replies"),
        F.sum(F.col("context_chars") + F.col("reply_chars") + F.when(F.col("trainable"), len(CLOSE)).otherwise(0)).alias("formatted_chars"),
    )
    read = read.select("conv_id", read_turns(F.col("rendering")).alias("turns"), F.array_join("replies.text", "").alias("loss"), "formatted_chars")
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


OP4_SQL = r"""
WITH a AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, t, r, '\### Assistant: </turn> ok' FROM (VALUES (1, 'user'), (2, 'assistant')) v(t, r)),
b AS (SELECT *, 7 + length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS head,
             length(replace(replace(text, '&', '&amp;'), '<', '&lt;')) + 8 AS rest FROM a),
c AS (SELECT *, sum(head + rest) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS upto,
             max(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn DESC NULLS LAST, role DESC, text DESC ROWS UNBOUNDED PRECEDING) AS answered,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC NULLS LAST, role DESC, text DESC) AS from_end FROM b)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (coalesce(sum(upto) FILTER (role = 'assistant'), 0) + coalesce(max(upto) FILTER (from_end = 1 AND answered = 0), 0))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
