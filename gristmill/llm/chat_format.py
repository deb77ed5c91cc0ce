"""Chat formatting by prefix-target expansion, in native expressions.

Every assistant turn is exploded into an example of its own: all turns before it are its context and only its reply is
trainable. Written out, the contexts of a long conversation grow with the square of its length, so an example row holds
the marked turns since the last reply, its own reply, and where in them the reply stands; the rest of its context are the
rows of the conversation before it. Turns behind the last reply make a row without a reply. ``whole`` puts the context
into every row, which the query reads back.

Rows are made of up to ``PART_TURNS`` consecutive turn numbers at a time, so a conversation that holds a third of all
turns is many parts in many tasks. Whole examples and digests need it in one task: a conversation of more than about 2 GB
has rows, but neither of these.

The template marks a turn as ``<|role|>text<|end|>``. In texts and roles ``&``, ``<``, ``[`` and ``|`` are written as
character references, so no control string of this or another template survives in them, and reading back is exact.

Defined results: turns go by turn number, null first, equal numbers by role and text; null texts and roles are empty;
repeated rows are turns of their own; rows without conv_id are one conversation; other columns are not looked at. Turns
that share a number, or have none, are formatted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gristmill.llm.common import let, table

PART_TURNS = 64
TRAINED_ROLE = "assistant"
END = "<|end|>"

_ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"), ("|", "&#124;"))


def escape(text: Column) -> Column:
    for plain, coded in _ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in reversed(_ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def examples(conversations: DataFrame) -> DataFrame:
    """conv_id, part, k, text, start, chars: one row per reply, in the order of part and k.

    ``text`` has the marked turns since the reply before and the reply itself, which stands at ``start`` (from 0, in code
    points) and has ``chars``. In rows of turns that no reply of their part follows both are null.
    """
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    turn = F.col("turn").cast("bigint")
    head = F.concat(F.lit("<|"), escape(role), F.lit("|>"))
    body = escape(text)
    turns = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.floor(turn / PART_TURNS).alias("part"),
        turn.alias("turn"),
        role.alias("role"),
        text.alias("text"),
        F.concat(head, body, F.lit(END)).alias("marked"),
        F.char_length(head).cast("bigint").alias("head_chars"),
        F.char_length(body).cast("bigint").alias("body_chars"),
        (role == TRAINED_ROLE).alias("trained"),
    )
    parts = turns.groupBy("conv_id", "part").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text", "marked", "head_chars", "body_chars", "trained"))).alias("t")
    )

    def rows(t: Column) -> Column:
        replies = F.filter(F.transform(t, lambda x, i: F.when(x["trained"], i)), lambda i: i.isNotNull())
        # a row ends with each reply, and the last one with the part
        ends = F.array_distinct(F.concat(replies, F.array(F.size(t) - 1)))

        def row(at: Column, k: Column) -> Column:
            def of(last: Column) -> Column:
                start = F.coalesce(F.get(at, k - 1) + 1, F.lit(0))
                whole = F.array_join(F.transform(F.slice(t, start + 1, at[k] - start + 1), lambda x: x["marked"]), "")
                return let(
                    whole,
                    lambda w: F.struct(
                        k.alias("k"),
                        w.alias("text"),
                        F.when(last["trained"], F.char_length(w).cast("bigint") - F.char_length(last["marked"]) + last["head_chars"]).alias("start"),
                        F.when(last["trained"], last["body_chars"]).alias("chars"),
                    ),
                )

            return let(F.get(t, at[k]), of)

        return let(ends, lambda at: F.transform(at, lambda _, k: row(at, k)))

    return parts.select("conv_id", "part", F.explode(rows(F.col("t"))).alias("e")).select("conv_id", "part", "e.k", "e.text", "e.start", "e.chars")


def read_turns(text: Column) -> Column:
    """The turns of a row: array of (role, text)."""
    pieces = F.filter(F.split(text, r"<\|end\|>"), lambda p: p != "")
    return F.transform(
        pieces,
        lambda p: let(
            F.substring_index(p, "|>", 1),
            lambda head: F.struct(
                unescape(F.substring(head, F.lit(3), F.char_length(head))).alias("role"),
                unescape(F.substring(p, F.char_length(head) + 3, F.char_length(p))).alias("text"),
            ),
        ),
    )


def target(text: Column, start: Column, chars: Column) -> Column:
    """The trainable reply of a row as it stands there; null without one."""
    return F.substring(text, start.cast("int") + 1, chars.cast("int"))


def whole(rows: DataFrame) -> DataFrame:
    """Every row with all turns of its conversation before it. Grows with the square of a conversation."""
    before = Window.partitionBy("conv_id").orderBy("part", "k").rowsBetween(Window.unboundedPreceding, -1)
    told = rows.withColumn("before", F.array_join(F.collect_list("text").over(before), ""))
    start = F.col("start") + F.char_length("before")
    return told.select("conv_id", "part", "k", F.concat("before", "text").alias("text"), start.alias("start"), "chars")


def expand(rows: DataFrame) -> DataFrame:
    """Every example written out: conv_id, part, k, context, target."""
    told = whole(rows).where("start IS NOT NULL")
    context = F.substring("text", F.lit(1), F.col("start").cast("int"))
    return told.select("conv_id", "part", "k", context.alias("context"), target(F.col("text"), F.col("start"), F.col("chars")).alias("target"))


def digests(rows: DataFrame) -> DataFrame:
    """What is read back from the whole examples, one row per conversation: each reply from its own, the turns from the last."""
    loss = F.coalesce(unescape(target(F.col("text"), F.col("start"), F.col("chars"))), F.lit(""))
    read = whole(rows).select("conv_id", F.struct("part", "k").alias("at"), "text", loss.alias("loss"))
    last = read.groupBy("conv_id").agg(F.max_by("text", "at").alias("text"), F.sort_array(F.collect_list(F.struct("at", "loss"))).alias("p"))
    told = last.select("conv_id", "text", F.array_join(F.transform("p", lambda x: x["loss"]), "").alias("loss"), read_turns(F.col("text")).alias("t"))
    turns = F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return told.select(
        "conv_id",
        F.size("t").cast("bigint").alias("n_turns"),
        F.sha2(F.encode(turns, "UTF-8"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("bigint").alias("loss_chars"),
        F.sha2(F.encode("loss", "UTF-8"), 256).alias("loss_sha256"),
        F.char_length("text").cast("bigint").alias("formatted_chars"),
    )


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = F.lit("</s>[INST] ok [/INST]")
    extra = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise(TRAINED_ROLE).alias("role"),
        hard.alias("text"),
    )
    return digests(examples(told.unionByName(extra)))


ORACLE_SQL = """
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
           UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'), '|', '&#124;'))
                + length(replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'), '|', '&#124;')) + 11 AS chars FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
