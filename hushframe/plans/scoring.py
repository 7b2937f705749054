"""Queries that score sensitivity and learn from vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as c
from ..functions.vectors import hashed_text
from ..operators import learner, sensitivity
from ..sources import files
from . import fixtures as fx
from . import sql
from .registry import big, query

_WORDS = "(?i)\\b(?:" + "|".join(c.FLAG_WORDS) + ")\\b"


def _excerpts(src: str) -> str:
    """CTE ``excerpts(doc_id, first_s, excerpt)`` of distinct flag-word surroundings."""
    return f"""{sql.with_plain(src)},
hits as (
  select *, unnest(range(1, len(m) + 1)) as i from (
    select doc_id, text, regexp_extract_all(plain, {sql.q(_WORDS)}) as m, string_split_regex(plain, {sql.q(_WORDS)}) as g
    from src where regexp_matches(plain, {sql.q(_WORDS)}))
),
places as (select doc_id, text, cast({sql.lengths('g[1:i]')} + {sql.lengths('m[1:i-1]')} as bigint) as s, length(m[i]) as n from hits),
excerpts as (
  select doc_id, min(s) as first_s, excerpt from (
    select doc_id, s, {sql.strip('substr(text, greatest(s - 50, 0) + 1, least(s + n + 150, length(text)) - greatest(s - 50, 0))')} as excerpt
    from places) group by doc_id, excerpt
)"""


@query(
    "keyword_flags",
    f"with {fx.TEXTS_SQL}, {_excerpts('texts')} select doc_id, 'CREDENTIALS' as category, cast(0.9 as double) as score, substr(excerpt, 1, 200) as excerpt from excerpts",
)
def keyword_flags(spark, sf_dir):
    flags = sensitivity.keyword_flags(F.col("text"))
    return fx.texts(spark, sf_dir).select("doc_id", F.explode(flags).alias("f")).select(
        "doc_id", "f.category", "f.score", "f.excerpt"
    )


_CHUNKS = """with recursive lines as (
      select doc_id, i as line, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') as line_text from (
        select doc_id, unnest(string_split(text, chr(10))) as raw, generate_subscripts(string_split(text, chr(10)), 1) as i from documents)
    ),
    sentences as (
      select doc_id, line, generate_subscripts(p, 1) as nth, unnest(p) as sentence, len(p) as total from (
        select doc_id, line, string_split(regexp_replace(line_text, '([.!?])\\s+', '\\1' || chr(30), 'g'), chr(30)) as p
        from lines where length(line_text) > 200)
    ),
    pack as (
      select doc_id, line, cast(0 as bigint) as nth, '' as open, cast([] as varchar[]) as done, max(total) as total from sentences group by doc_id, line
      union all
      select p.doc_id, p.line, p.nth + 1,
        case when length(p.open) + length(s.sentence) + 1 <= 200 then regexp_replace(p.open || ' ' || s.sentence, '^\\s+|\\s+$', '', 'g') else s.sentence end,
        case when length(p.open) + length(s.sentence) + 1 <= 200 or p.open = '' then p.done else list_append(p.done, p.open) end, p.total
      from pack p join sentences s on s.doc_id = p.doc_id and s.line = p.line and s.nth = p.nth + 1
    ),
    parts as (
      select doc_id, line, 1 as k, line_text as chunk from lines where line_text <> '' and length(line_text) <= 200
      union all
      select doc_id, line, generate_subscripts(d, 1) as k, unnest(d) as chunk from (
        select doc_id, line, case when open = '' then done else list_append(done, open) end as d from pack where nth = total)
    )"""


@query(
    "chunk_text",
    f"{_CHUNKS} select doc_id, row_number() over (partition by doc_id order by line, k) - 1 as chunk_no, chunk from parts",
)
def chunk_text(spark, sf_dir):
    """Whole documents cut into chunks of about two hundred characters."""
    parts = sensitivity.chunks(F.col("text"))
    out = fx.documents(spark, sf_dir).select("doc_id", F.posexplode(parts).alias("chunk_no", "chunk"))
    return out.withColumn("chunk_no", big("chunk_no"))


_WORD_VECTOR = "list_transform(range(0, 8), lambda i: cast('0x' || substr(md5(word), cast(4 * i + 1 as int), 4) as int) / 32768.0 - 1)"


def _text_vectors(src: str, keys: str, text: str) -> str:
    """Unit vectors of texts: the sum of the vectors of their words."""
    return f"""
    select {keys}, list(value / n order by i) as v from (
      select *, sqrt(sum(value * value) over (partition by {keys})) as n from (
        select {keys}, i, sum(v[i]) as value from (
          select {keys}, {_WORD_VECTOR} as v from (select {keys}, unnest(list_filter(string_split_regex({text}, '\\s+'), lambda w: w <> '')) as word from {src})),
        (select unnest(range(1, 9)) as i) group by all)) where n > 0 group by {keys}"""


_DESCRIBED = ", ".join(f"({sql.q(k)}, {sql.q(v)})" for k, v in c.CATEGORY_DESCRIPTIONS.items())


@query(
    "chunk_category_flags",
    f"""{_CHUNKS}, numbered as (select doc_id, row_number() over (partition by doc_id order by line, k) - 1 as chunk_no, chunk from parts),
    described as (select * from (values {_DESCRIBED}) t(category, d)),
    cats as ({_text_vectors('described', 'category', 'd')}),
    vecs as ({_text_vectors('numbered', 'doc_id, chunk_no', 'chunk')}),
    hits as (select doc_id, chunk_no, category, list_sum(list_transform(range(1, 9), lambda i: x.v[i] * c.v[i])) as sim from vecs x, cats c)
    select doc_id, category, count(*) as n_chunks, max(round(sim, 3)) as top_score from hits where sim > {c.CATEGORY_THRESHOLD} group by doc_id, category""",
)
def chunk_category_flags(spark, sf_dir):
    """Chunks of every document, encoded and scored against the described categories."""
    flags = sensitivity.chunk_flags(fx.documents(spark, sf_dir), encode=hashed_text)
    each = flags.select("doc_id", F.explode("flags").alias("f"))
    return each.groupBy("doc_id", F.col("f.category").alias("category")).agg(
        F.count(F.lit(1)).alias("n_chunks"), F.max("f.score").alias("top_score")
    )


LETTERS = "etaoinsr"


def letter_model():
    """A stand-in for an outside model: how much more often than the others each of some letters stands in a text."""
    import numpy as np

    def predict(batch):
        counts = np.array([[str(t).count(x) + str(t).count(x.upper()) for x in LETTERS] for t in batch], "int64")
        return (len(LETTERS) * counts - counts.sum(1, keepdims=True)).astype("float32")

    return predict


def _letter_vectors(src: str, keys: str, text: str) -> str:
    counts = ", ".join(f"length(regexp_replace({text}, '[^{x}{x.upper()}]', '', 'g'))" for x in LETTERS)
    return f"""
    select {keys}, list_transform(n, lambda x: cast({len(LETTERS)} * x - list_sum(n) as double)) as v
    from (select *, [{counts}] as n from {src})"""


_LETTER_COSINE = """list_sum(list_transform(range(1, 9), lambda i: x.v[i] * c.v[i]))
  / (sqrt(list_sum(list_transform(x.v, lambda z: z * z))) * sqrt(list_sum(list_transform(c.v, lambda z: z * z))))"""


@query(
    "model_category_flags",
    f"""{_CHUNKS}, numbered as (select doc_id, row_number() over (partition by doc_id order by line, k) - 1 as chunk_no, chunk from parts),
    described as (select * from (values {_DESCRIBED}) t(category, d)),
    cats as ({_letter_vectors('described', 'category', 'd')}),
    vecs as ({_letter_vectors('numbered', 'doc_id, chunk_no', 'chunk')}),
    hits as (select doc_id, chunk_no, category, {_LETTER_COSINE} as sim from vecs x, cats c where list_sum(list_transform(x.v, lambda z: z * z)) > 0)
    select doc_id, category, count(*) as n_chunks, max(round(sim, 3)) as top_score from hits where sim > {c.CATEGORY_THRESHOLD} group by doc_id, category""",
)
def model_category_flags(spark, sf_dir):
    """Chunks of every document through an outside model as encoder, scored against the described categories."""
    flags = sensitivity.chunk_flags(fx.documents(spark, sf_dir), encode=sensitivity.model_encoder(letter_model))
    each = flags.select("doc_id", F.explode("flags").alias("f"))
    return each.groupBy("doc_id", F.col("f.category").alias("category")).agg(
        F.count(F.lit(1)).alias("n_chunks"), F.max("f.score").alias("top_score")
    )


CATEGORIES = list(c.CATEGORY_LABELS)
_COSINE = """list_sum(list_transform(range(1, len(a) + 1), lambda i: cast(a[i] as double) * cast(b[i] as double)))
  / (sqrt(list_sum(list_transform(a, lambda x: cast(x as double) * cast(x as double)))) * sqrt(list_sum(list_transform(b, lambda x: cast(x as double) * cast(x as double)))))"""
_FLAGS = f"""cats as (
  select {sql.sql_list(CATEGORIES)}[label + 1] as category, label as cat_no, embedding as b from (
    select label, embedding, row_number() over (partition by label order by vec_id) as rn from embeddings where label < 7) where rn = 1
),
flags as (
  select vec_id, vec_id // 3 as doc_id, category, cat_no, round(sim, 3) as score from (
    select vec_id, category, cat_no, {_COSINE} as sim from (select vec_id, embedding as a from embeddings), cats) where sim > 0.25
)"""


def _categories(spark, sf_dir):
    """One reference vector per category: the first one with its label."""
    vectors = fx.table(spark, sf_dir, "embeddings").where(F.col("label") < len(CATEGORIES))
    first = vectors.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("vector"))
    names = F.array(*[F.lit(x) for x in CATEGORIES])
    return first.select(F.get(names, F.col("label")).alias("category"), "vector")


def _flags(spark, sf_dir):
    vectors = fx.table(spark, sf_dir, "embeddings").select(
        "vec_id", F.floor(F.col("vec_id") / 3).alias("doc_id"), "embedding"
    )
    return sensitivity.category_flags(vectors, _categories(spark, sf_dir), ["vec_id", "doc_id"], threshold=0.25)


@query("embedding_category_flags", f"with {_FLAGS} select vec_id, category, score from flags")
def embedding_category_flags(spark, sf_dir):
    return _flags(spark, sf_dir).select("vec_id", "category", "score")


_RISK = """case when count(*) = 0 then 'low' when max(score) >= 0.7 or count(*) >= 4 then 'high'
  when count(*) >= 2 or max(score) >= 0.6 then 'medium' else 'low' end"""


@query(
    "risk_level",
    f"with {_FLAGS} select doc_id, max(score) as top_score, count(*) as n_flags, {_RISK} as risk_level from flags group by doc_id",
)
def risk_level(spark, sf_dir):
    per_doc = _flags(spark, sf_dir).groupBy("doc_id").agg(
        F.max("score").alias("top_score"), F.count(F.lit(1)).cast("bigint").alias("n_flags")
    )
    return per_doc.withColumn("risk_level", sensitivity.risk(F.col("top_score"), F.col("n_flags")))


@query(
    "sensitivity_report",
    f"""with {_FLAGS}, {_excerpts('documents')},
    every as (
      select doc_id, 0.9 as score, 'CREDENTIALS' as category, 0 as kind, first_s as a, 0 as b from excerpts
      union all select doc_id, score, category, 1, vec_id, cat_no from flags
    ),
    labels_map as (select unnest({sql.sql_list(c.CATEGORY_LABELS)}) as category, unnest({sql.sql_list(c.CATEGORY_LABELS.values())}) as label),
    ranked as (select e.*, label, row_number() over (partition by doc_id order by score desc, kind, a, b) as rn from every e join labels_map using (category)),
    names as (select doc_id, string_agg(label, ', ' order by rn) as names from (select doc_id, label, min(rn) as rn from ranked group by doc_id, label) group by doc_id),
    risk as (select doc_id, count(*) as n, {_RISK} as level, max(case when rn = 1 then category end) as top from ranked group by doc_id)
    select d.doc_id, coalesce(n, 0) > 0 as is_sensitive, coalesce(level, 'low') as risk_level, coalesce(n, 0) as n_flags, coalesce(top, '') as top_category,
      case when {sql.strip('d.text')} = '' then {sql.q(c.SUMMARY_BLANK)} when n is null then {sql.q(c.SUMMARY_NONE)}
           when level = 'high' then {sql.q(c.SUMMARY_HIGH[0])} || names || {sql.q(c.SUMMARY_HIGH[1])}
           else {sql.q(c.SUMMARY_OTHER[0])} || names || {sql.q(c.SUMMARY_OTHER[1])} end as summary
    from documents d left join risk r on r.doc_id = d.doc_id left join names x on x.doc_id = d.doc_id""",
)
def sensitivity_report(spark, sf_dir):
    """Flag words and category similarity of the chunks of a document in one report."""
    order = F.create_map(*[x for i, k in enumerate(CATEGORIES) for x in (F.lit(k), F.lit(i))])
    flags = _flags(spark, sf_dir).groupBy("doc_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("vec_id", F.element_at(order, F.col("category")).alias("at"), "category", "score"))),
            lambda x: sensitivity.flag(x["category"], x["score"], F.lit("")),
        ).alias("extra")
    )
    df = fx.documents(spark, sf_dir).join(flags, "doc_id", "left")
    done = sensitivity.report(df, extra_flags="extra")
    return done.select(
        "doc_id", "is_sensitive", "risk_level", big(F.size("flags")).alias("n_flags"),
        F.coalesce(F.get("flags", F.lit(0))["category"], F.lit("")).alias("top_category"), "summary",
    )


@query(
    "high_risk_split",
    f"""select doc_id, case when regexp_matches({sql.PLAIN}, {sql.q(_WORDS)}) then 'local_summary' else 'direct' end as route,
      md5(case when regexp_matches({sql.PLAIN}, {sql.q(_WORDS)}) then substr(text, 1, 5744) else text end) as sent_md5 from documents""",
)
def high_risk_split(spark, sf_dir):
    """Only texts of high risk take the extra local step, with their text cut to its budget."""
    done = sensitivity.report(fx.documents(spark, sf_dir))
    high = F.col("risk_level") == "high"
    return done.select(
        "doc_id",
        F.when(high, F.lit("local_summary")).otherwise(F.lit("direct")).alias("route"),
        F.md5(F.when(high, files.truncate(F.col("text"), 5744)).otherwise(F.col("text"))).alias("sent_md5"),
    )


_MEANS = """dims as (select label, generate_subscripts(embedding, 1) - 1 as dim, unnest(embedding) as v from embeddings),
means as (select label, dim, avg(cast(v as double)) as mean from dims group by label, dim),
units as (select label, dim, mean / sqrt(sum(mean * mean) over (partition by label)) as value from means)"""


@query("centroids", f"with {_MEANS} select label, dim, round(value, 6) + 0.0 as value from units")
def centroids(spark, sf_dir):
    rows = sensitivity.centroids(fx.table(spark, sf_dir, "embeddings"))
    return rows.select("label", big("dim").alias("dim"), (F.round("value", 6) + F.lit(0.0)).alias("value"))


@query(
    "centroid_similar",
    f"""with {_MEANS}, centres as (select label, list(value order by dim) as b from units group by label)
    select distinct vec_id from (select vec_id, {_COSINE} as sim from (select vec_id, embedding as a from embeddings), centres) where sim > 0.3""",
)
def centroid_similar(spark, sf_dir):
    vectors = fx.table(spark, sf_dir, "embeddings")
    centres = sensitivity.centroid_vectors(sensitivity.centroids(vectors))
    return sensitivity.similar_to_any(vectors, centres, threshold=0.3).select("vec_id")


_ANSWERS = " Vertrag.|Rechnung: Betrag|unbekannt|BRIEF!!|medizinisch, weil|Protokoll;|  gutachten|Sonstiges?"
_ANSWER = f"case when doc_id % 9 = 8 then '' else split_part('{_ANSWERS}', '|', cast(doc_id % 8 as int) + 1) end"


@query(
    "doc_type_normalise",
    f"""with a as (select doc_id, rtrim(lower(regexp_extract({_ANSWER}, '^\\s*(\\S+)', 1)), '.,;:!?') as word from documents)
    select doc_id, case when word in {sql.sql_in(c.DOC_KINDS)} then word else 'sonstiges' end as kind from a""",
)
def doc_type_normalise(spark, sf_dir):
    return fx.documents(spark, sf_dir).select("doc_id", learner.doc_kind(F.expr(_ANSWER)).alias("kind"))
