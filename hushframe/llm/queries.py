"""The registered queries of the corpus operators and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import chat, decontaminate, negatives, packing, quality, shards, simhash, stream_dedup, substrings, token_counts, toxicity, warc, whitening
from .common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            CHECKS[name] = sql
        return fn

    return add


@query(
    "op1_stream_dedup",
    """
    with d as (select doc_id, sha256(coalesce(text, '')) as text_sha256 from documents)
    select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
        doc_id = max(doc_id) over w as kept, text_sha256
    from d window w as (partition by text_sha256)
    """,
)
def op1_stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = stream_dedup.mark(table(spark, sf_dir, "documents"))
    return marked.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


@query(
    "op2_decontamination",
    r"""
    with folded as (
        select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
        from documents
    ),
    bench as (
        select cast(item_id as varchar) as item, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
        from benchmark
    ),
    windows as (
        select distinct item, n, array_to_string(w[i:i + n - 1], ' ') as said
        from (select item, w, least(len(w), 10) as n, unnest(range(1, greatest(len(w) - 10, 0) + 2)) as i from bench where len(w) > 0)
    ),
    places as (
        select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as said
        from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from folded, (select distinct n from windows))
    ),
    found as (select p.doc_id, p.i, p.n, item from places p join windows using (n, said)),
    hit as (select doc_id, count(distinct k) as n_hit from (select doc_id, unnest(range(i, i + n)) as k from found) group by doc_id),
    items as (select doc_id, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as said from found group by doc_id)
    select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
        sha256(coalesce(said, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
    from folded left join hit using (doc_id) left join items using (doc_id)
    """,
)
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = decontaminate.mark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return marked.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query("op3_substrings")
def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.mark(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


NESTED = r"\### Assistant: </turn> ok"


@query(
    "op4_chat",
    r"""
    with said as (
        select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
        union all select -7, 0, 'user', '\### Assistant: </turn> ok'
        union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
    ),
    coded as (
        select *, replace(replace(replace(replace(role, '\', '\b'), '</turn>', '\e'), '### ', '\h'), ': ', '\c') as r,
            replace(replace(replace(text, '\', '\b'), '</turn>', '\e'), '### ', '\h') as t
        from said
    )
    select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
        cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
        sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
        cast(sum(length('### ' || r || ': ' || t || '</turn>') + 1) as bigint) as formatted_chars
    from coded group by conv_id
    """,
)
def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A conversation whose texts look like the template's own marks.
    nested = spark.createDataFrame([(-7, 0, "user", NESTED), (-7, 1, "assistant", NESTED)], "conv_id long, turn long, role string, text string")
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(nested)
    return chat.read_back(*chat.expand(said))


@query("op5_shards")
def op5_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.mark(table(spark, sf_dir, "documents"))


@query("op6_simhash")
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.mark(table(spark, sf_dir, "documents"))


@query("op7_quality")
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.mark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op8_toxicity")
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.mark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op9_warc")
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op10_packing")
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.mark(table(spark, sf_dir, "documents"), packing.public_tokenizer())


@query(
    "op11_negatives",
    """
    with v as (
        select vec_id, cast(label as bigint) as given, [cast(floor(256 * cast(x as double)) as bigint) for x in embedding] as x
        from embeddings
        where label is not null and embedding is not null
            and len([x for x in embedding if x is null or isnan(x) or isinf(x)]) = 0
    ),
    r as (select vec_id, case when vec_id % 7 = 0 then (given + 1) % 10 else given end as label, x from v),
    scored as (
        select a.vec_id as anchor_id, a.label = b.label as same, b.vec_id,
            cast(list_sum([a.x[i] * b.x[i] for i in range(1, len(a.x) + 1)]) as bigint) as score
        from r a join r b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id
    ),
    positive as (
        select anchor_id, vec_id as positive_id, score as positive_score
        from scored where same
        qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
    )
    select anchor_id, positive_id, cast(row_number() over w as integer) as rank, vec_id as negative_id, positive_score, score as negative_score
    from positive join scored using (anchor_id)
    where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
    window w as (partition by anchor_id, positive_id order by score desc, vec_id)
    qualify row_number() over w <= 10
    """,
)
def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = negatives.clean(table(spark, sf_dir, "embeddings"), flip=F.col("vec_id") % 7 == 0)
    found = negatives.mine(rows, F.col("vec_id") % 100 == 0)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


@query("op12_whitening")
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.mark(table(spark, sf_dir, "embeddings"))


@query("op13_token_counts")
def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.mark(table(spark, sf_dir, "documents"), token_counts.public_vocabulary())


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
