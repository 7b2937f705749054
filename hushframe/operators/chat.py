"""Chat tables: user turns, content blocks, per-conversation anonymizing, system hint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import BRACKET_HINT
from ..functions.text import strip
from . import pseudonym, recognizers
from . import spans as sp

TURNS_PER_BUCKET = 4096


def user_turns(chat: DataFrame) -> DataFrame:
    """User messages that hold more than white space."""
    return chat.where((F.col("role") == "user") & (strip(F.col("text")) != ""))


BODY_SCHEMA = "struct<messages:array<struct<role:string,content:variant>>>"


def content_blocks(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Texts of the user messages of request bodies: a plain string or each text block of a list."""
    parsed = bodies.withColumn("__m", F.from_json(body, BODY_SCHEMA))
    rest = [c for c in bodies.columns if c != body]
    messages = parsed.select(*rest, F.posexplode(F.col("__m.messages")).alias("message", "m")).where(
        F.col("m.role") == "user"
    )
    content = F.col("m.content")
    is_list = F.schema_of_variant(content).startswith("ARRAY")
    plain = F.when(~is_list, F.array(F.try_variant_get(content, "$", "string")))
    texts = F.transform(
        F.filter(
            F.try_variant_get(content, "$", "array<variant>"),
            lambda b: F.try_variant_get(b, "$.type", "string") == "text",
        ),
        lambda b: F.try_variant_get(b, "$.text", "string"),
    )
    blocks = F.coalesce(F.when(is_list, texts), plain)
    return (
        messages.select(*rest, F.col("message").cast("bigint").alias("message"), F.posexplode(blocks).alias("block", "text"))
        .where(strip(F.col("text")) != "")
        .withColumn("block", F.col("block").cast("bigint"))
    )


def detect_user_turns(chat: DataFrame, **options) -> DataFrame:
    """Spans of user messages only; other roles keep their text."""
    found = recognizers.detect(chat, into="__spans", **options)
    return found.withColumn(
        "spans", F.when(F.col("role") == "user", F.col("__spans")).otherwise(sp.no_spans())
    ).drop("__spans")


def anonymize_chat(chat: DataFrame, scope: str = "conversation", **options) -> tuple[DataFrame, DataFrame]:
    """Chat with anonymized user messages and its codebook.

    ``scope='message'`` numbers each message on its own, ``conversation`` shares codenames over the turns
    of a conversation, so two people never get the same codename there.
    """
    found = detect_user_turns(chat, **options)
    if scope == "message":
        rewritten = pseudonym.anonymize(found)
        return rewritten, pseudonym.mapping_rows(rewritten, ["conv_id", "turn"])
    return pseudonym.anonymize_scoped(
        found,
        ids=["conv_id", "turn"],
        scope=["conv_id"],
        order=["turn"],
    )


def merge_mappings(rows: DataFrame) -> DataFrame:
    """One mapping per conversation from the mappings of its messages; the later message wins."""
    return rows.groupBy("conv_id", "codename").agg(F.max_by("original", "turn").alias("original"))


def prompt(instruction: Column, text: Column) -> Column:
    return F.concat(instruction, F.lit("\n\n---\n\n"), text)


def add_system_hint(chat: DataFrame, mappings: DataFrame, hint: str = BRACKET_HINT) -> DataFrame:
    """Append the hint to the first system turn of conversations with bracket codenames, or add one.

    The flags are one row per conversation; a conversation that holds a third of all turns is spread.
    """
    flagged = (
        mappings.where(F.col("codename").contains("["))
        .select("conv_id")
        .distinct()
        .withColumn("hint", F.lit(True))
    )
    system = chat.where(F.col("role") == "system").groupBy("conv_id").agg(F.min("turn").alias("system_turn"))
    plan = flagged.join(system, "conv_id", "left")
    joined = pseudonym.salted_join(chat, plan, ["conv_id"], F.col("turn"), how="left")
    first = F.col("hint") & (F.col("role") == "system") & (F.col("turn") == F.col("system_turn"))
    extended = joined.select(
        "conv_id", "turn", "role",
        F.when(first, F.concat("text", F.lit("\n\n" + hint))).otherwise(F.col("text")).alias("text"),
    )
    added = plan.where(F.col("system_turn").isNull()).select(
        "conv_id", F.lit(-1).cast("bigint").alias("turn"), F.lit("system").alias("role"), F.lit(hint).alias("text")
    )
    return extended.unionByName(added)
