"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are its context, and only its reply is trained.
The formatted turns of a conversation stand one behind another, and an example is a prefix of them, so the table of
turns is stored once and an example holds the length of its context and the span of its reply; ``render`` writes an
example out. That keeps the output in proportion to the input for a conversation of any length.

Template: ``### <role>: <text></turn>`` and a line break. Inside texts and roles the two control strings and the escape
character are written as escapes, so a text can say anything without ending its turn, and reading back restores it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .common import partitions

OPEN, BETWEEN, CLOSE = "### ", ": ", "</turn>\n"
TRAINED = "assistant"
#: Written first to last, read back last to first. A role must not hold the string that ends it.
ESCAPES = [("\\", "\\b"), ("</turn>", "\\e"), ("### ", "\\h")]
ROLE_ESCAPES = [*ESCAPES, (": ", "\\c")]


def escape(text: Column, table: list[tuple[str, str]] = ESCAPES) -> Column:
    for raw, coded in table:
        text = F.replace(text, F.lit(raw), F.lit(coded))
    return text


def unescape(text: Column, table: list[tuple[str, str]] = ESCAPES) -> Column:
    for raw, coded in reversed(table):
        text = F.replace(text, F.lit(coded), F.lit(raw))
    return text


def format_turns(conversations: DataFrame) -> DataFrame:
    """One row per turn: conv_id, position, formatted, start (characters of the conversation before it), target.

    Turns are in order of ``turn`` (null first), then role, then text. A null role or text is empty. Rows that repeat
    stay repeated. A null conv_id is a conversation too. ``target``: the turn is an assistant's.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")),
    )
    formatted = F.concat(F.lit(OPEN), escape(F.col("role"), ROLE_ESCAPES), F.lit(BETWEEN), escape(F.col("text")), F.lit(CLOSE))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("formatted", formatted).select(
        "conv_id", F.row_number().over(order).cast("long").alias("position"), "formatted",
        F.coalesce(F.sum(F.length("formatted")).over(before), F.lit(0)).alias("start"), (F.col("role") == TRAINED).alias("target"),
    )


def examples(turns: DataFrame) -> DataFrame:
    """One row per assistant turn: conv_id, position, context_chars, loss_start, loss_end.

    The context is the first ``context_chars`` characters of the conversation, all preceding turns. The loss mask is
    [loss_start, loss_end) of the conversation's characters: the reply, without marks.
    """
    head = F.length(F.lit(OPEN + TRAINED + BETWEEN))
    return turns.where("target").select(
        "conv_id", "position", F.col("start").alias("context_chars"), (F.col("start") + head).alias("loss_start"),
        (F.col("start") + F.length("formatted") - len(CLOSE)).alias("loss_end"),
    )


def render(turns: DataFrame, some: DataFrame) -> DataFrame:
    """The given examples written out: conv_id, position, text (context and reply's turn), loss_start, loss_end.

    Its output grows with the square of a conversation's turns; give it the examples of one training batch.
    """
    joined = some.alias("e").join(turns.alias("t"), (F.col("e.conv_id").eqNullSafe(F.col("t.conv_id"))) & (F.col("t.position") <= F.col("e.position")))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("t.position", "t.formatted"))), lambda x: x["formatted"]), "")
    return joined.groupBy("e.conv_id", "e.position", "e.loss_start", "e.loss_end").agg(text.alias("text"))


def read_back(turns: DataFrame, some: DataFrame) -> DataFrame:
    """What the formatted conversations say: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Roles and texts come out of the formatted characters, the trained text out of the loss spans of the examples. A
    conversation passes a task turn by turn; nothing of it is held but running digests.
    """
    key = ["conv_id", "position"]
    rows = turns.select(*key, "formatted", F.col("start")).join(some.select(F.col("conv_id").alias("c"), F.col("position").alias("p"), "loss_start", "loss_end"),
        F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("position") == F.col("p")), "left")
    inner = F.expr(f"substring(formatted, {len(OPEN) + 1}, length(formatted) - {len(OPEN) + len(CLOSE)})")
    cut = F.instr(inner, BETWEEN)
    trained = F.expr("substring(formatted, cast(loss_start - start + 1 as int), cast(loss_end - loss_start as int))")
    said = rows.select(
        *key, F.length("formatted").alias("chars"), unescape(F.substring(inner, F.lit(1), cut - 1), ROLE_ESCAPES).alias("role"),
        unescape(F.substring(inner, cut + len(BETWEEN), F.length(inner))).alias("text"), unescape(trained).alias("trained"),
    )
    dealt = said.repartition(partitions(said), "conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "position")
    return dealt.mapInArrow(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
    )
    now = None

    def row():
        conv_id, n, turns, chars, loss, formatted = now
        return {"conv_id": conv_id, "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": chars, "loss_sha256": loss.hexdigest(), "formatted_chars": formatted}

    for batch in batches:
        done = []
        for turn in batch.to_pylist():
            if now is None or now[0] != turn["conv_id"]:
                if now is not None:
                    done.append(row())
                now = [turn["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            now[1] += 1
            now[2].update(f"{turn['role']}\n{turn['text']}\n".encode())
            if turn["trained"] is not None:
                now[3] += len(turn["trained"])
                now[4].update(turn["trained"].encode())
            now[5] += turn["chars"]
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)
    if now is not None:
        yield pa.RecordBatch.from_pylist([row()], schema)


def expand(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, examples), both written to the shared folder."""
    turns = stage(format_turns(conversations), "chat-turns")
    return turns, stage(examples(turns), "chat-examples")
