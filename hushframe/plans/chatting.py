"""Queries over chats and event-stream lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as c
from ..operators import chat
from ..sources import sse
from . import fixtures as fx
from . import sql
from .registry import big, query


@query(
    "chat_user_turns",
    f"select conv_id, turn, text from conversations where role = 'user' and {sql.strip('text')} <> ''",
)
def chat_user_turns(spark, sf_dir):
    return chat.user_turns(fx.table(spark, sf_dir, "conversations")).select("conv_id", "turn", "text")


@query(
    "chat_content_blocks",
    f"""select conv_id, turn, cast(0 as bigint) as message, cast(0 as bigint) as block, text from conversations where role = 'user' and {sql.strip('text')} <> ''
    union all
    select conv_id, turn, 0, 1, concat('Zusatz "', cast(turn as varchar), '"') from conversations where role = 'user' and conv_id % 2 = 1""",
)
def chat_content_blocks(spark, sf_dir):
    """Request bodies, one per message: plain text for even conversations, block lists for odd ones."""

    def block(kind, text):
        return F.struct(F.lit(kind).alias("type"), text.alias("text"))

    plain = F.to_json(F.struct(F.array(F.struct("role", F.col("text").alias("content"))).alias("messages")))
    extra = F.concat(F.lit('Zusatz "'), F.col("turn").cast("string"), F.lit('"'))
    blocks = F.array(
        block("text", F.col("text")), block("image", F.lit("no text")), block("text", extra), block("text", F.lit("  "))
    )
    listed = F.to_json(F.struct(F.array(F.struct("role", blocks.alias("content"))).alias("messages")))
    bodies = fx.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.when(F.col("conv_id") % 2 == 0, plain).otherwise(listed).alias("body")
    )
    return chat.content_blocks(bodies)


_CHAT_DOCS = f"""{fx.CHAT_SQL},
turns as (select conv_id * 100000 + turn as doc_id, conv_id, turn, role, text from chat where role = 'user')"""
_CHAT_SPANS = f"with recursive {_CHAT_DOCS}, {sql.detected('turns')}, {sql.resolved('spans')}, placed as (select *, doc_id // 100000 as conv_id, doc_id * 1000000 + s as place from resolved)"


@query(
    "chat_anonymize",
    f"""{_CHAT_SPANS}, {sql.codenames('placed', 'conv_id', 'place')}, {sql.spliced('named', 'turns', 'doc_id')}
    select c.conv_id, c.turn, c.role, coalesce(s.anonymized, c.text) as text
    from chat c left join spliced s on s.conv_id = c.conv_id and s.turn = c.turn""",
)
def chat_anonymize(spark, sf_dir):
    """User turns rewritten with codenames shared over their conversation; other roles keep their text."""
    texts, _ = chat.anonymize_chat(fx.chat(spark, sf_dir))
    return texts.select("conv_id", "turn", "role", F.col("anonymized").alias("text"))


@query(
    "chat_mapping_merge",
    f"""{_CHAT_SPANS}, {sql.codenames('placed', 'doc_id', 's')},
    mapped as (select doc_id, conv_id, codename, max_by(span_text, s) as original from named group by doc_id, conv_id, codename)
    select conv_id, codename, max_by(original, doc_id) as original from mapped group by conv_id, codename""",
)
def chat_mapping_merge(spark, sf_dir):
    """Mappings of single messages merged per conversation; the later message wins."""
    _, rows = chat.anonymize_chat(fx.chat(spark, sf_dir), scope="message")
    return chat.merge_mappings(rows)


_HINT = sql.q(c.BRACKET_HINT)


@query(
    "system_hint",
    f"""{_CHAT_SPANS}, {sql.codenames('placed', 'conv_id', 'place')},
    flagged as (select distinct conv_id from named where contains(codename, '[')),
    sys as (select conv_id, min(turn) as system_turn from chat where role = 'system' group by conv_id)
    select c.conv_id, c.turn, c.role, case when f.conv_id is not null and c.role = 'system' and c.turn = s.system_turn
        then c.text || chr(10) || chr(10) || {_HINT} else c.text end as text
    from chat c left join flagged f on f.conv_id = c.conv_id left join sys s on s.conv_id = c.conv_id
    union all
    select f.conv_id, -1, 'system', {_HINT} from flagged f left join sys s on s.conv_id = f.conv_id where s.conv_id is null""",
)
def system_hint(spark, sf_dir):
    talk = fx.chat(spark, sf_dir)
    _, book = chat.anonymize_chat(talk)
    return chat.add_system_hint(talk, book)


@query(
    "sse_delta_parse",
    """with kinds as (select unnest([0, 1, 2, 3, 4, 5]) as k)
    select conv_id, turn, k as line_no, case k when 0 then 'delta' when 1 then 'delta' when 2 then 'done' when 3 then 'bad' when 4 then 'other' else 'event' end as kind,
      case when k in (0, 1) then text end as delta from conversations, kinds""",
)
def sse_delta_parse(spark, sf_dir):
    """Every message as stream lines of all kinds, parsed again."""
    text = F.col("text")
    lines = F.array(
        sse.delta_line(text, F.lit("choices")),
        sse.delta_line(text, F.lit("block")),
        F.lit("data: [DONE]"),
        F.concat(F.lit('data: {"choices": [{"delta": '), F.left(F.col("role"), F.lit(2))),
        F.lit("event: ping"),
        F.lit('data: {"type": "message_start", "message": {}}'),
    )
    rows = fx.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(lines).alias("line_no", "line"))
    return sse.parse(rows).select("conv_id", "turn", "line_no", "kind", "delta")
