"""Queries that find, filter and resolve spans."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as c
from ..functions.vectors import hashed_word
from ..operators import learner, pseudonym, terms
from ..operators import recognizers as rec
from ..operators import spans as sp
from ..session import stage
from . import fixtures as fx
from . import sql
from .registry import big, query, span_table

# ------------------------------------------------------------------ one recognizer family each

FAMILIES = {
    "rec_at_uid": [rec.AT_UID],
    "rec_at_iban": [rec.AT_IBAN],
    "rec_at_svnr": [rec.AT_SVNR],
    "rec_phone": [rec.PHONE_INTL, rec.PHONE_LOCAL],
    "rec_firmenbuch": [rec.FIRMENBUCH],
    "rec_doc_metadata": [rec.DOC_METADATA],
    "rec_credential_label": [rec.CREDENTIAL_LABEL],
    "rec_credential_stmt": [rec.CREDENTIAL_STATED],
    "rec_api_key": [rec.API_KEY],
    "rec_bearer": [rec.BEARER],
    "rec_conn_string": [rec.CONN_STRING],
    "rec_private_key": [rec.PRIVATE_KEY],
    "rec_ipv4": [rec.IPV4],
    "rec_ipv6": [rec.IPV6],
    "rec_eu_iban": [rec.EU_IBAN],
    "rec_cards": [rec.VISA, rec.MASTERCARD, rec.AMEX],
    "rec_dates": [rec.DATE_DE, rec.DATE_ISO],
    "rec_sensitive_art9": list(rec.SENSITIVE),
    "rec_first_name": [rec.NAME_FOLLOWED, rec.NAME_ALONE],
    "rec_email": [rec.EMAIL],
    "rec_iban_mod97": [rec.IBAN_ANY],
    "rec_card_luhn": [rec.CARD_ANY],
}


def _family(recognizers, boost=False):
    def run(spark, sf_dir):
        df = fx.texts(spark, sf_dir)
        found = rec.found_spans("text", registry=recognizers, boost=boost)
        return span_table(df.select("doc_id", found.alias("spans")))

    return run


def _family_sql(recognizers, boost=False, where="true"):
    parts = []
    for r in recognizers:
        if r.entity_type == "PERSON":
            parts = [sql.first_names("src")]
        else:
            parts.append(sql.scan(r.name, "src", boost))
    body = "\nunion all\n".join(parts)
    return f"with {fx.TEXTS_SQL}, {sql.with_plain('texts')}, found as ({body})\nselect {sql.COLUMNS} from found where {where}"


for _name, _recs in FAMILIES.items():
    query(_name, _family_sql(_recs))(_family(_recs))

WEAK = [rec.PLATE_AT, rec.PLATE_DE, rec.TAX_DE, rec.PASSPORT_AT]


@query("rec_plates_ctx", _family_sql(WEAK, boost=True, where="score >= 0.6"))
def rec_plates_ctx(spark, sf_dir):
    """Weak patterns that pass the threshold only with a context word in front."""
    df = fx.texts(spark, sf_dir)
    found = rec.found_spans("text", registry=WEAK, boost=True)
    return span_table(df.select("doc_id", rec.keep_spans(found).alias("spans")))


BOOSTED = [rec.AT_UID, rec.AT_IBAN, rec.PHONE_INTL, rec.PHONE_LOCAL, rec.FIRMENBUCH, *rec.EU]
query("context_boost", _family_sql(BOOSTED, boost=True))(_family(BOOSTED, boost=True))

# ------------------------------------------------------------------ detection and filters

_FOUND_LETTERS = f"with recursive {fx.LETTERS_SQL}, {sql.with_plain('letters')}, found as ({sql.all_found('src')})"
_DETECTED_LETTERS = f"with recursive {fx.LETTERS_SQL}, {sql.detected('letters')}"
_DETECTED_TEXTS = f"with recursive {fx.TEXTS_SQL}, {sql.detected('texts')}"


@query("detect_spans", f"{_DETECTED_TEXTS} select {sql.COLUMNS} from spans")
def detect_spans(spark, sf_dir):
    return span_table(rec.detect(fx.texts(spark, sf_dir)))


@query("spans_threshold", f"{_FOUND_LETTERS} select {sql.COLUMNS} from found where score >= 0.8")
def spans_threshold(spark, sf_dir):
    """The conservative confidence of 0.8."""
    found = rec.found_spans("text")
    kept = F.filter(found, lambda s: s["score"] >= 0.8)
    return span_table(fx.letters(spark, sf_dir).select("doc_id", kept.alias("spans")))


# A place and a date type that the allow-list drops, besides the kinds found by patterns.
_PLACES = """
places as (
  select doc_id, 'LOCATION' as entity_type, cast(position('Firmenbuch' in text) - 1 as int) as place_start, 10 as n from letters
  union all
  select doc_id, 'LOCATION' as entity_type, cast(position('FN ' in text) - 1 as int) as place_start, 2 as n from letters
  union all
  select doc_id, 'LOCATION' as entity_type, cast(position('BIC' in text) - 1 as int) as place_start, 3 as n from letters
  union all
  select doc_id, 'NRP' as entity_type, cast(position('BIC' in text) - 1 as int) as place_start, 3 as n from letters
)"""


def _with_places(spark, sf_dir):
    df = fx.letters(spark, sf_dir)

    def place(kind, word, n):
        return df.select(
            "doc_id", F.lit(kind).alias("entity_type"), (F.instr("text", word) - 1).alias("start"),
            (F.instr("text", word) - 1 + n).alias("end"), F.lit(0.85).alias("score"),
        )

    places = (
        place("LOCATION", "Firmenbuch", 10)
        .unionByName(place("LOCATION", "FN ", 2))
        .unionByName(place("LOCATION", "BIC", 3))
        .unionByName(place("NRP", "BIC", 3))
    )
    return rec.attach_annotations(df, places)


_PLACE_SPANS = f"""{_FOUND_LETTERS}, {_PLACES},
both_found as (
  select doc_id, entity_type, s, e, score, span_text from found
  union all
  select p.doc_id, p.entity_type, p.place_start, p.place_start + p.n, cast(0.85 as double), substr(text, place_start + 1, n)
  from places p join letters l on l.doc_id = p.doc_id
)"""


@query(
    "spans_allowed",
    f"{_PLACE_SPANS} select {sql.COLUMNS} from both_found where entity_type in {sql.sql_in(c.KEPT_TYPES)}",
)
def spans_allowed(spark, sf_dir):
    df = _with_places(spark, sf_dir)
    found = rec.found_spans("text", extra=F.col("annotations"))
    kept = rec.keep_spans(found, threshold=0.0, person_filter=False)
    return span_table(df.select("doc_id", kept.alias("spans")))


@query(
    "location_filter",
    f"""{_PLACE_SPANS} select {sql.COLUMNS} from both_found
    where entity_type = 'LOCATION' and score >= 0.6 and length({sql.strip('span_text')}) > 2
      and lower({sql.strip('span_text')}) not in {sql.sql_in(c.NO_PLACES)}""",
)
def location_filter(spark, sf_dir):
    """Places are admitted by parameter; known non-places and two-letter ones go."""
    df = _with_places(spark, sf_dir)
    found = rec.found_spans("text", extra=F.col("annotations"))
    kept = rec.keep_spans(found, locations=True, allowed=[])
    return span_table(df.select("doc_id", kept.alias("spans")))


@query(
    "spans_requested",
    f"""{_FOUND_LETTERS}, wanted as (
      select * from found where doc_id % 3 = 0 or (doc_id % 3 = 1 and entity_type in ('PERSON', 'CREDENTIAL'))
       or (doc_id % 3 = 2 and entity_type = 'EU_PII')
    ), {sql.cleaned('wanted', 'spans')} select {sql.COLUMNS} from spans""",
)
def spans_requested(spark, sf_dir):
    """Each text asks for its own types; none means all.  Types not asked for hide nothing."""
    wanted = (
        F.when(F.col("doc_id") % 3 == 1, F.array(F.lit("PERSON"), F.lit("CREDENTIAL")))
        .when(F.col("doc_id") % 3 == 2, F.array(F.lit("EU_PII")))
    )
    return span_table(rec.detect(fx.letters(spark, sf_dir), requested=wanted))


_PRODUCT_TEXTS = """
products as (
  select doc_id, concat(case when doc_id % 2 = 0 then 'Claude' else 'Copilot' end, ' meint: ', text) as text from letters
)"""


@query(
    "person_false_positive",
    f"""with recursive {fx.LETTERS_SQL}, {_PRODUCT_TEXTS}, {sql.with_plain('products')},
    found as (
      select doc_id, entity_type, s, e, score, span_text from ({sql.first_names('src')})
      union all
      select doc_id, 'PERSON', 0, case when doc_id % 2 = 0 then 6 else 7 end, 0.85, substr(text, 1, case when doc_id % 2 = 0 then 6 else 7 end)
      from products
      union all
      select doc_id, 'PERSON', 0, 5, case when doc_id % 3 = 0 then 0.85 else 0.55 end, substr(text, 1, 5) from products
    )
    select {sql.COLUMNS} from found
    where score >= 0.6 and lower({sql.strip('span_text')}) not in {sql.sql_in(c.PRODUCT_NAMES)}""",
)
def person_false_positive(spark, sf_dir):
    """A model takes product names for persons; they are dropped by name."""
    even = F.col("doc_id") % 2 == 0
    product = F.when(even, F.lit("Claude")).otherwise(F.lit("Copilot"))
    df = fx.letters(spark, sf_dir).select("doc_id", F.concat(product, F.lit(" meint: "), "text").alias("text"))

    def person(end, score):
        return sp.span(F.lit("PERSON"), F.lit(0), end, score, F.left("text", end), F.lit("external"))

    external = F.array(
        person(F.when(even, F.lit(6)).otherwise(F.lit(7)), F.lit(0.85)),
        person(F.lit(5), F.when(F.col("doc_id") % 3 == 0, F.lit(0.85)).otherwise(F.lit(0.55))),
    )
    found = rec.found_spans("text", registry=[rec.NAME_FOLLOWED, rec.NAME_ALONE], extra=external)
    return span_table(df.select("doc_id", rec.keep_spans(found).alias("spans")))


# ------------------------------------------------------------------ span algebra


@query(
    "remove_contained",
    f"""{_FOUND_LETTERS},
    kept as (select distinct doc_id, entity_type, s, e, score, span_text from found where score >= 0.6 and entity_type in ('EU_PII', 'AT_IBAN', 'CREDIT_CARD', 'PHONE_NUMBER'))
    select {sql.COLUMNS} from kept a where not exists (
      select 1 from kept b where b.doc_id = a.doc_id and b.s <= a.s and a.e <= b.e and b.score >= a.score and b.e - b.s > a.e - a.s)""",
)
def remove_contained(spark, sf_dir):
    found = rec.keep_spans(
        rec.found_spans("text"), allowed=["EU_PII", "AT_IBAN", "CREDIT_CARD", "PHONE_NUMBER"]
    )
    alone = F.array_distinct(F.transform(found, lambda s: s.withField("recognizer", F.lit(""))))
    return span_table(fx.letters(spark, sf_dir).select("doc_id", sp.remove_contained(alone).alias("spans")))


@query(
    "resolve_overlaps",
    f"{_DETECTED_TEXTS}, {sql.resolved('spans')} select {sql.COLUMNS} from resolved",
)
def resolve_overlaps(spark, sf_dir):
    found = rec.detect(fx.texts(spark, sf_dir))
    return span_table(found.select("doc_id", sp.resolve_overlaps(F.col("spans")).alias("spans")))


@query(
    "span_overlap_pairs",
    f"""{_FOUND_LETTERS},
    u as (select doc_id, entity_type, s, e, max(score) as score from found group by doc_id, entity_type, s, e),
    n as (select *, row_number() over (partition by doc_id order by s, e desc, score desc, entity_type) as i from u)
    select a.doc_id, a.entity_type as a_type, a.s as a_start, a.e as a_end, b.entity_type as b_type, b.s as b_start, b.e as b_end
    from n a join n b on a.doc_id = b.doc_id and a.i < b.i and a.s < b.e and a.e > b.s""",
)
def span_overlap_pairs(spark, sf_dir):
    found = rec.found_spans("text")
    df = fx.letters(spark, sf_dir).select("doc_id", sp.remove_repeated(found).alias("spans"))
    pairs = sp.overlap_pairs(df)
    return pairs.select(
        "doc_id",
        F.col("a.entity_type").alias("a_type"), big("a.start").alias("a_start"), big("a.end").alias("a_end"),
        F.col("b.entity_type").alias("b_type"), big("b.start").alias("b_start"), big("b.end").alias("b_end"),
    )


_EXTERNAL = """
annotations as (
  select doc_id, 'ORGANIZATION' as entity_type, cast(position('Nordlicht' in text) - 1 as bigint) as s, cast(position('Nordlicht' in text) + 17 as bigint) as e,
         cast(0.85 as double) as score from letters
  union all
  select doc_id, 'PERSON', cast(position('Herr' in text) + 4 as bigint), cast(position('Herr' in text) + 14 as bigint),
         cast(case when doc_id % 3 = 0 then 0.9 else 0.55 end as double) from letters
)"""


def external_annotations(df):
    org = df.select(
        "doc_id", F.lit("ORGANIZATION").alias("entity_type"), (F.instr("text", "Nordlicht") - 1).alias("start"),
        (F.instr("text", "Nordlicht") + 17).alias("end"), F.lit(0.85).alias("score"),
    )
    sure = F.when(F.col("doc_id") % 3 == 0, F.lit(0.9)).otherwise(F.lit(0.55))
    person = df.select(
        "doc_id", F.lit("PERSON").alias("entity_type"), (F.instr("text", "Herr") + 4).alias("start"),
        (F.instr("text", "Herr") + 14).alias("end"), sure.alias("score"),
    )
    return org.unionByName(person)


@query(
    "spans_union_external",
    f"""{_FOUND_LETTERS}, {_EXTERNAL},
    every as (
      select doc_id, entity_type, s, e, score, span_text from found
      union all
      select a.doc_id, a.entity_type, a.s, a.e, a.score, substr(l.text, a.s + 1, a.e - a.s)
      from annotations a join letters l on l.doc_id = a.doc_id
    ), {sql.cleaned('every', 'spans')}
    select {sql.COLUMNS} from spans""",
)
def spans_union_external(spark, sf_dir):
    df = fx.letters(spark, sf_dir)
    joined = rec.attach_annotations(df, external_annotations(df))
    return span_table(rec.detect(joined, extra=F.col("annotations")))


# ------------------------------------------------------------------ default proper-noun tagger

WORDS_SQL = """
words as (
  select doc_id, text, i, w, cast(sum(length(w) + 1) over (partition by doc_id order by i) - length(w) - 1 as bigint) as s,
         lag(w) over (partition by doc_id order by i) as prev
  from (select doc_id, text, unnest(string_split_regex(text, '\\s')) as w,
               generate_subscripts(string_split_regex(text, '\\s'), 1) as i from {src})
),
caps as (
  select *, regexp_extract(w, '^\\p{{Lu}}[\\p{{L}}\\p{{M}}\\p{{Nd}}_]*') as cap,
         coalesce(prev <> '' and not regexp_matches(prev, '[.!?]$'), false) as inside
  from words
),
propn as (select doc_id, text, i, s, s + length(cap) as e, cap as term from caps where inside and cap <> ''),
linked as (
  select *, coalesce(cap <> '' and lag(cap) over (partition by doc_id order by i) = prev and prev <> ''
                     and substr(text, s, 1) = ' ', false) as link
  from caps
),
chains as (
  select *, sum(case when link then 0 else 1 end) over (partition by doc_id order by i) as chain from linked
),
runs as (
  select doc_id, any_value(text) as text, min(s) as s, string_agg(cap, ' ' order by i) as term
  from (select *, row_number() over (partition by doc_id, chain order by i) as pos,
               first_value(inside and cap <> '') over (partition by doc_id, chain order by i) as head
        from chains where cap <> '')
  where head or pos > 1
  group by doc_id, chain having count(*) >= 2
)"""


def frequency(term: str) -> str:
    return f"((length(lower(text)) - length(replace(lower(text), lower({term}), ''))) // length({term}))"


def _signal(source: str, least: int) -> str:
    return f"""
select distinct doc_id, text, term from {source} t
where length(term) >= {least} and lower(term) not in {sql.sql_in(c.DEFAULT_STOP_TERMS)} and {frequency('term')} <= 3
  and not exists (select 1 from spans x where x.doc_id = t.doc_id and x.s <= t.s and t.s < x.e)
  and not exists (select 1 from spans x where x.doc_id = t.doc_id and lower({sql.strip('x.span_text')}) = lower(t.term))"""


_TAGGED_TEXTS = f"{_DETECTED_TEXTS}, {WORDS_SQL.format(src='texts')}"
_TAGGED_LETTERS = f"{_DETECTED_LETTERS}, {WORDS_SQL.format(src='letters')}"
_LEARNED = f"""learned as (
  select doc_id, text, term, {frequency('term')} as n,
         row_number() over (partition by doc_id order by {frequency('term')}, lower(term), term) as rk
  from (select * from ({_signal('propn', 4)}) union select * from ({_signal('runs', 1)}))
  where length(term) >= 4
)"""


@query("propn_terms", f"{_TAGGED_TEXTS} select doc_id, term from ({_signal('propn', 4)})")
def propn_terms(spark, sf_dir):
    found = rec.detect(fx.texts(spark, sf_dir))
    return found.select("doc_id", F.explode(learner.proper_terms(F.col("text"), F.col("spans"))).alias("term"))


@query("propn_runs", f"{_TAGGED_TEXTS} select doc_id, term from ({_signal('runs', 1)})")
def propn_runs(spark, sf_dir):
    found = rec.detect(fx.texts(spark, sf_dir))
    return found.select("doc_id", F.explode(learner.proper_run_terms(F.col("text"), F.col("spans"))).alias("term"))


@query(
    "learned_terms",
    f"{_TAGGED_TEXTS}, {_LEARNED} select doc_id, term, cast(n as bigint) as frequency from learned where rk <= 25",
)
def learned_terms(spark, sf_dir):
    found = rec.detect(fx.texts(spark, sf_dir))
    learned = found.select("doc_id", "text", F.explode(learner.learned_terms(F.col("text"), F.col("spans"))).alias("term"))
    return terms.term_counts(learned, F.col("text"), F.col("term")).select("doc_id", "term", "frequency")


@query(
    "uncovered_candidates",
    f"""{_TAGGED_TEXTS} select doc_id, s as term_start, term from propn t
    where not exists (select 1 from spans x where x.doc_id = t.doc_id and x.s <= t.s and t.s < x.e)""",
)
def uncovered_candidates(spark, sf_dir):
    found = rec.detect(fx.texts(spark, sf_dir))
    free = learner.uncovered(learner.proper_nouns(F.col("text")), F.col("spans"))
    return found.select("doc_id", F.explode(free).alias("t")).select(
        "doc_id", big("t.start").alias("term_start"), F.col("t.text").alias("term")
    )


@query(
    "term_frequency",
    f"""with recursive {fx.TEXTS_SQL}, {WORDS_SQL.format(src='texts')}
    select doc_id, term, cast({frequency('term')} as bigint) as frequency from (select distinct doc_id, text, term from propn)""",
)
def term_frequency(spark, sf_dir):
    df = fx.texts(spark, sf_dir)
    nouns = F.array_distinct(F.transform(learner.proper_nouns(F.col("text")), lambda s: s["text"]))
    counted = F.transform(
        nouns,
        lambda t: F.struct(t.alias("term"), learner._frequency(F.lower("text"), t).cast("bigint").alias("frequency")),
    )
    return df.select("doc_id", F.inline(counted))


@query(
    "person_pos_check",
    f"""{_TAGGED_LETTERS} select {sql.COLUMNS} from spans p
    where entity_type <> 'PERSON' or exists (select 1 from propn t where t.doc_id = p.doc_id and t.s >= p.s and t.s < p.e)""",
)
def person_pos_check(spark, sf_dir):
    found = rec.detect(fx.letters(spark, sf_dir))
    kept = learner.person_pos_check(F.col("spans"), learner.proper_nouns(F.col("text")))
    return span_table(found.select("doc_id", kept.alias("spans")))


_MODEL = """
annotated as (
  select doc_id, text, case when doc_id % 3 = 0 then 'PER' when doc_id % 3 = 1 then 'MISC' else 'LOC' end as kind,
         cast(position('Silberfuchs' in text) - 1 as bigint) as s, cast(position('Silberfuchs' in text) + 10 as bigint) as e from letters
  union all
  select doc_id, text, 'MISC', cast(position('mit Partner' in text) - 1 as bigint), cast(position('mit Partner' in text) + 10 as bigint) from letters
  union all
  select doc_id, text, 'ORG', cast(position('Auftraggeber' in text) - 1 as bigint), cast(position('Auftraggeber' in text) + 11 as bigint) from letters
)"""


@query(
    "ner_recheck",
    f"""{_TAGGED_LETTERS}, {_MODEL},
    named as (select *, trim(substr(text, s + 1, e - s)) as term from annotated)
    select distinct doc_id, term from named a
    where length(term) >= 4 and {frequency('term')} <= 3 and lower(term) not in {sql.sql_in(c.DEFAULT_STOP_TERMS)}
      and not exists (select 1 from spans x where x.doc_id = a.doc_id and lower({sql.strip('x.span_text')}) = lower(a.term))
      and (kind in ('PER', 'ORG') or (kind = 'MISC' and not exists (
        select 1 from (select unnest(string_split(term, ' ')) as part) where part not in ('und', 'and', '&') and not exists (
          select 1 from propn t where t.doc_id = a.doc_id and t.term = part and t.s >= a.s and t.s < a.e))))""",
)
def ner_recheck(spark, sf_dir):
    """Names an outside model marked, re-checked against the type rules."""
    df = fx.letters(spark, sf_dir)

    def mark(kind, word, n):
        at = F.instr("text", word) - 1
        return df.select(
            "doc_id", kind.alias("entity_type"), at.alias("start"), (at + n).alias("end"), F.lit(0.85).alias("score")
        )

    by_key = (
        F.when(F.col("doc_id") % 3 == 0, F.lit("PER")).when(F.col("doc_id") % 3 == 1, F.lit("MISC")).otherwise(F.lit("LOC"))
    )
    marks = (
        mark(by_key, "Silberfuchs", 11)
        .unionByName(mark(F.lit("MISC"), "mit Partner", 11))
        .unionByName(mark(F.lit("ORG"), "Auftraggeber", 12))
    )
    found = rec.detect(rec.attach_annotations(df, marks))
    names = learner.model_terms(
        F.col("text"), F.col("annotations"), learner.proper_nouns(F.col("text")), F.col("spans")
    )
    return found.select("doc_id", F.explode(names).alias("term"))


# An outside model's names, written from the tagged words: their place decides the kind.
_MARKED = """
annotated as (select doc_id, text, case s % 3 when 0 then 'PER' when 1 then 'MISC' else 'LOC' end as kind, s, e, term from propn where s % 5 < 2)"""


def _vector(word: str) -> str:
    return f"list_transform(range(0, 8), lambda i: cast('0x' || substr(md5({word}), cast(4 * i + 1 as int), 4) as int) / 32768.0 - 1)"


_FIRST = f"""
first as (select * from spans p where entity_type <> 'PERSON' or exists (
  select 1 from propn t where t.doc_id = p.doc_id and t.s >= p.s and t.s < p.e))"""
_SIMILAR = f"""
members as (
  select x.doc_id, x.entity_type, i, v[i] as value from (
    select x.doc_id, x.entity_type, {_vector('t.term')} as v from propn t join first x on x.doc_id = t.doc_id and t.s >= x.s and t.e <= x.e) x,
  (select unnest(range(1, 9)) as i)),
centre as (
  select doc_id, entity_type, list(value / n order by i) as v from (
    select *, sqrt(sum(value * value) over (partition by doc_id, entity_type)) as n from (
      select doc_id, entity_type, i, sum(value) as value from members group by all)) where n > 0 group by all),
phrase as (
  select distinct doc_id, text, term, s, s + length(term) as e from (
    select doc_id, text, term, s from propn union all select doc_id, text, term, s from runs)),
phrase_parts as (
  select doc_id, text, term, i, sum(v[i]) as value from (
    select doc_id, text, term, {_vector('word')} as v from (
      select distinct doc_id, text, term, unnest(string_split(term, ' ')) as word, generate_subscripts(string_split(term, ' '), 1) as k from phrase p
      where not exists (select 1 from first x where x.doc_id = p.doc_id and x.s < p.e and p.s < x.e))),
  (select unnest(range(1, 9)) as i) group by all),
phrase_vectors as (
  select doc_id, text, term, list(value / n order by i) as v from (
    select *, sqrt(sum(value * value) over (partition by doc_id, term)) as n from phrase_parts) where n > 0 group by all),
similar_to as (
  select distinct p.doc_id, p.text, p.term from phrase_vectors p join centre c on c.doc_id = p.doc_id
  where list_sum(list_transform(range(1, 9), lambda i: p.v[i] * c.v[i])) > {c.TERM_SIMILARITY}
    and not exists (select 1 from first x where x.doc_id = p.doc_id and lower({sql.strip('x.span_text')}) = lower(p.term))),
named as (
  select distinct doc_id, text, term from annotated a where kind in ('PER', 'MISC')
    and not exists (select 1 from first x where x.doc_id = a.doc_id and lower({sql.strip('x.span_text')}) = lower(a.term)))"""
_THREE = f"""learned as (
  select doc_id, text, term, {frequency('term')} as n,
         row_number() over (partition by doc_id order by {frequency('term')}, lower(term), term) as rk
  from (select * from ({_signal('propn', 4).replace('from spans x', 'from first x')}) union select * from ({_signal('runs', 1).replace('from spans x', 'from first x')})
        union select * from similar_to union select * from named)
  where length(term) >= 4 and lower(term) not in {sql.sql_in(c.DEFAULT_STOP_TERMS)} and {frequency('term')} <= 3
)"""


@query(
    "detect_two_pass",
    f"""{_TAGGED_TEXTS}, {_MARKED}, {_FIRST}, {_SIMILAR}, {_THREE},
    term_rx as (
      select doc_id, '(?i)\\b(?:' || string_agg({sql.PLAIN.replace('text', 'term')}, '|' order by length(term) desc, term) || ')\\b' as rx,
        list(lower(term)) as known
      from learned where rk <= 25 group by doc_id
    ),
    term_hits as (
      select *, unnest(range(1, len(m) + 1)) as i from (
        select l.doc_id, l.text, known, regexp_extract_all(l.plain, rx) as m, string_split_regex(l.plain, rx) as g
        from src l join term_rx r on r.doc_id = l.doc_id where l.doc_id in (select doc_id from first))
    ),
    second as (
      select doc_id, entity_type, s, e, score, span_text from found
      union all
      select doc_id, 'CUSTOM', s, s + length(m[i]), cast(1.0 as double), substr(text, s + 1, length(m[i])) from (
        select *, cast({sql.lengths('g[1:i]')} + {sql.lengths('m[1:i-1]')} as bigint) as s from term_hits)
      where list_contains(known, lower(substr(text, s + 1, length(m[i]))))
    ), {sql.cleaned('second', 'final')}
    select {sql.COLUMNS} from final p where entity_type <> 'PERSON' or exists (
      select 1 from propn t where t.doc_id = p.doc_id and t.s >= p.s and t.s < p.e)""",
)
def detect_two_pass(spark, sf_dir):
    """All texts with the three signals of learning and the proper-noun check."""

    def named(s):
        kind = F.when(s["start"] % 3 == 0, F.lit("PER")).when(s["start"] % 3 == 1, F.lit("MISC")).otherwise(F.lit("LOC"))
        return sp.changed(s, entity_type=kind)

    nouns = F.col("nouns")
    marks = F.transform(F.filter(nouns, lambda s: s["start"] % 5 < 2), named)
    df = fx.texts(spark, sf_dir).withColumn("nouns", learner.proper_nouns(F.col("text")))
    found = learner.detect_two_pass(df, proper=nouns, annotations=marks, encode=hashed_word)
    return span_table(found)


# ------------------------------------------------------------------ span tables and outside models


@query(
    "interval_join",
    f"""{_TAGGED_TEXTS} select x.doc_id, x.entity_type, x.s as span_start, x.e as span_end, t.s as term_start, t.term
    from spans x join propn t on t.doc_id = x.doc_id and t.s < x.e and x.s < t.e""",
)
def interval_join(spark, sf_dir):
    """Proper nouns and spans as two long tables: which of them share a place."""
    found = rec.detect(fx.texts(spark, sf_dir))
    spans = sp.explode_spans(found, ["doc_id"]).select("doc_id", "entity_type", "start", "end")
    nouns = fx.texts(spark, sf_dir).select("doc_id", F.inline(learner.proper_nouns(F.col("text"))))
    pairs = sp.interval_join(spans, nouns.select("doc_id", "start", "end", "text"))
    return pairs.select(
        "doc_id", F.col("a.entity_type").alias("entity_type"), big("a.start").alias("span_start"), big("a.end").alias("span_end"),
        big("b.start").alias("term_start"), F.col("b.text").alias("term"),
    )


MODEL_NAME = "[A-Z][a-z]{7,}"


def name_model():
    """A stand-in for an outside tagger: long capitalised words are names of persons, or of places where they end in n."""
    import re

    pattern = re.compile(MODEL_NAME)
    return lambda said: [
        [("LOC" if m.group().endswith("n") else "PER", m.start(), m.end(), 0.5 + len(m.group()) / 64) for m in pattern.finditer(t)] for t in said
    ]


@query(
    "model_annotations",
    f"""with {fx.TEXTS_SQL},
    h as (select doc_id, text, regexp_extract_all(text, '{MODEL_NAME}') as m, string_split_regex(text, '{MODEL_NAME}') as g from texts),
    p as (select *, unnest(range(1, len(m) + 1)) as i from h),
    found as (
      select doc_id, case when m[i][-1:] = 'n' then 'LOC' else 'PER' end as entity_type, s, s + length(m[i]) as e, 0.5 + length(m[i]) / 64.0 as score,
        substr(text, s + 1, length(m[i])) as span_text
      from (select *, cast({sql.lengths('g[1:i]')} + {sql.lengths('m[1:i-1]')} as bigint) as s from p))
    select {sql.COLUMNS} from found""",
)
def model_annotations(spark, sf_dir):
    """All texts through an outside model, its finds as spans beside their text."""
    df = fx.texts(spark, sf_dir)
    marked = rec.attach_annotations(df, rec.model_annotations(df, name_model))
    return span_table(marked.select("doc_id", F.col("annotations").alias("spans")))


# ------------------------------------------------------------------ deny lists

DENY = ["Nordlicht", "Silberfuchs", "BIC GIBAATWW", "Thomas", "Firmenbuch", "the", "nordlicht zentrale"]


@query(
    "rec_deny_list",
    f"""with {fx.TEXTS_SQL}, {sql.with_plain('texts')},
    h as (select doc_id, text, regexp_extract_all(plain, {sql.q('(?i)\\b(?:' + '|'.join(DENY) + ')\\b')}) as m,
                 string_split_regex(plain, {sql.q('(?i)\\b(?:' + '|'.join(DENY) + ')\\b')}) as g from src),
    p as (select *, unnest(range(1, len(m) + 1)) as i from h),
    found as (
      select doc_id, 'CUSTOM' as entity_type, s, s + length(m[i]) as e, cast(1.0 as double) as score, substr(text, s + 1, length(m[i])) as span_text
      from (select *, cast({sql.lengths('g[1:i]')} + {sql.lengths('m[1:i-1]')} as bigint) as s from p))
    select {sql.COLUMNS} from found""",
)
def rec_deny_list(spark, sf_dir):
    return span_table(terms.find(fx.texts(spark, sf_dir), DENY))


@query(
    "deny_list_join",
    f"""with {fx.TEXTS_SQL}, {sql.with_plain('texts')},
    deny as (select term, min(pos) as pos from (
      select replace(replace(p_name, 'small', 'the'), 'red', 'and') as term, p_partkey as pos from part
      union all select substr(c_name, 1, 18), c_custkey + 1000000000 from customer) group by term),
    words as (select distinct doc_id, unnest(regexp_extract_all(lower(text), '[{sql.W}]+')) as word from texts),
    cand as (
      select w.doc_id, t.term, t.pos from words w join (select term, pos, regexp_extract(lower(term), '[{sql.W}]+') as word from deny) t on t.word = w.word
      join texts x on x.doc_id = w.doc_id where contains(lower(x.text), lower(t.term))
    ),
    rx as (select doc_id, '(?i)\\b(?:' || string_agg(term, '|' order by pos) || ')\\b' as rx from cand group by doc_id),
    h as (select s.doc_id, text, regexp_extract_all(plain, rx) as m, string_split_regex(plain, rx) as g from src s join rx on rx.doc_id = s.doc_id),
    p as (select *, unnest(range(1, len(m) + 1)) as i from h),
    found as (
      select doc_id, 'CUSTOM' as entity_type, s, s + length(m[i]) as e, cast(1.0 as double) as score, substr(text, s + 1, length(m[i])) as span_text
      from (select *, cast({sql.lengths('g[1:i]')} + {sql.lengths('m[1:i-1]')} as bigint) as s from p))
    select {sql.COLUMNS} from found""",
)
def deny_list_join(spark, sf_dir):
    """A long list: part names turned into words of the texts, and all customer names."""
    parts = fx.table(spark, sf_dir, "part").select(
        F.regexp_replace(F.regexp_replace("p_name", "small", "the"), "red", "and").alias("term"), F.col("p_partkey").alias("pos")
    )
    names = fx.table(spark, sf_dir, "customer").select(
        F.substring("c_name", 1, 18).alias("term"), (F.col("c_custkey") + 1_000_000_000).alias("pos")
    )
    return span_table(terms.join_terms(fx.texts(spark, sf_dir), parts.unionByName(names)))


OVERLAPPING = ["Nordlicht", "Nordlicht Zentrale", "Projekt Silberfuchs", "Silberfuchs mit", "Thomas Gruber", "Thomas", "the", "the on"]


@query(
    "deny_list_parity",
    f"""with {fx.TEXTS_SQL}, {sql.with_plain('texts')},
    h as (select doc_id, text, regexp_extract_all(plain, {sql.q('(?i)\\b(?:' + '|'.join(OVERLAPPING) + ')\\b')}) as m,
                 string_split_regex(plain, {sql.q('(?i)\\b(?:' + '|'.join(OVERLAPPING) + ')\\b')}) as g from src),
    p as (select *, unnest(range(1, len(m) + 1)) as i from h),
    found as (
      select doc_id, 'CUSTOM' as entity_type, s, s + length(m[i]) as e, cast(1.0 as double) as score, substr(text, s + 1, length(m[i])) as span_text
      from (select *, cast({sql.lengths('g[1:i]')} + {sql.lengths('m[1:i-1]')} as bigint) as s from p))
    select way, {sql.COLUMNS} from found, (select unnest(['pattern', 'join']) as way)""",
)
def deny_list_parity(spark, sf_dir):
    """Terms that begin alike or overlap: one pattern and the join find the same spans, the first term in the list wins."""
    df = fx.texts(spark, sf_dir)
    listed = spark.createDataFrame(list(enumerate(OVERLAPPING)), "pos long, term string")
    both = [("pattern", terms.find(df, OVERLAPPING)), ("join", terms.join_terms(df, listed))]
    rows = [span_table(found).select(F.lit(way).alias("way"), "*") for way, found in both]
    return rows[0].unionByName(rows[1])


# Lists written from the tables: one term per line, blanks and repeats included.
_LISTS = """
lists as (
  select cast(p_partkey as bigint) as list_id, concat(' ', p_name, chr(10), '  ', chr(10), p_type, ' ', chr(10), p_brand) as body from part
)"""


def _lists(spark, sf_dir):
    return fx.table(spark, sf_dir, "part").selectExpr(
        "p_partkey as list_id", "concat(' ', p_name, chr(10), '  ', chr(10), p_type, ' ', chr(10), p_brand) as body"
    )


@query(
    "deny_terms_parse",
    f"""with {_LISTS} select list_id, pos, term from (
      select list_id, cast(i - 1 as bigint) as pos, {sql.strip('raw')} as term from (
        select list_id, unnest(string_split(body, chr(10))) as raw, generate_subscripts(string_split(body, chr(10)), 1) as i from lists))
    where term <> ''""",
)
def deny_terms_parse(spark, sf_dir):
    return terms.parse(_lists(spark, sf_dir), "body")


@query(
    "deny_terms_merge",
    """with both_lists as (
      select 0 as list, cast(p_partkey as bigint) as pos, p_name as term from part
      union all select 1, cast(s_suppkey as bigint), s_name from supplier
      union all select 1, cast(p_partkey as bigint) + 1000000, p_name from part)
    select term, cast(list as bigint) as list, pos from (
      select *, row_number() over (partition by term order by list, pos) as rn from both_lists) where rn = 1""",
)
def deny_terms_merge(spark, sf_dir):
    part, supplier = fx.table(spark, sf_dir, "part"), fx.table(spark, sf_dir, "supplier")
    request = supplier.selectExpr("s_suppkey as pos", "s_name as term").unionByName(
        part.selectExpr("p_partkey + 1000000 as pos", "p_name as term")
    )
    return terms.merge(part.selectExpr("p_partkey as pos", "p_name as term"), request)


@query(
    "deny_terms_add",
    f"""with known as (select distinct p_brand as term from part),
    fresh as (select distinct {sql.strip("case when p_partkey % 10 = 0 then '  ' when p_partkey % 3 = 0 then p_brand || ' ' else p_name end")} as term from part)
    select term from known union all select term from fresh where term <> '' and term not in (select term from known)""",
)
def deny_terms_add(spark, sf_dir):
    part = fx.table(spark, sf_dir, "part")
    new = part.selectExpr(
        "case when p_partkey % 10 = 0 then '  ' when p_partkey % 3 = 0 then p_brand || ' ' else p_name end as term"
    )
    return terms.add(part.select(F.col("p_brand").alias("term")).distinct(), new)


@query(
    "deny_terms_remove",
    """with known as (select distinct p_name as term from part),
    gone as (select distinct p_name as term from part where p_retailprice < 905)
    select term, 'exact' as variant from known where term not in (select term from gone)
    union all
    select term, 'any_case' from known where lower(term) not in (select lower(upper(term)) from gone)""",
)
def deny_terms_remove(spark, sf_dir):
    part = fx.table(spark, sf_dir, "part")
    known = part.select(F.col("p_name").alias("term")).distinct()
    gone = part.where("p_retailprice < 905").select(F.col("p_name").alias("term"))
    exact = terms.remove(known, gone).withColumn("variant", F.lit("exact"))
    loose = terms.remove(known, gone.select(F.upper("term").alias("term")), any_case=True)
    return exact.unionByName(loose.withColumn("variant", F.lit("any_case")))


# ------------------------------------------------------------------ dense texts

ADDRESSES = 4000
_ADDRESS = "concat('10.', cast(event_id % 200 as string), '.', cast(floor(event_id / 200) % 250 as int), '.', cast(event_id % 240 as string))"
_DENSE_SQL = f"""{fx.LETTERS_SQL},
dense as (
  select cast(c_nationkey as bigint) as doc_id, string_agg(text, chr(10) order by doc_id) as text from letters join customer on c_custkey = doc_id group by c_nationkey
  union all
  select 1000 + event_id // {ADDRESSES}, string_agg({_ADDRESS}, ' ' order by event_id) from events group by event_id // {ADDRESSES}
)"""


@query(
    "dense_texts",
    f"""with {_DENSE_SQL}, {sql.detected('dense')},
    n as (select doc_id, count(*) as n_spans, cast(sum(s) as bigint) as starts, count(distinct lower(span_text)) as names from spans group by doc_id)
    select doc_id, n_spans, starts, case when doc_id >= 1000 then names else 0 end as n_names from dense join n using (doc_id)""",
)
def dense_texts(spark, sf_dir):
    """Few texts with very many spans: all letters of a nation in one, and lists of thousands of addresses.

    A nation's text has no bound, so it is detected and rewritten in parts; the lists are as long as they are.
    """
    nation = fx.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.col("c_nationkey").cast("long").alias("one"))
    letters = fx.letters(spark, sf_dir).join(nation, "doc_id").select("one", F.col("doc_id").alias("at"), "text")
    events = fx.table(spark, sf_dir, "events").select(
        (F.floor(F.col("event_id") / ADDRESSES) + 1000).alias("one"), F.col("event_id").alias("at"), F.expr(_ADDRESS).alias("text")
    )
    # What has no number is one text, whatever it comes from.
    letters = letters.unionByName(events.where(F.col("one").isNull()))
    parts = stage(rec.detect_parts(letters, "one"), "dense")
    counted = parts.withColumns({"n": big(F.size("spans")), "sum": _starts(F.col("offset"))})
    rewritten, _ = pseudonym.anonymize_scoped(counted, ["one", "part"], ["one"], ["part"])
    # A part counts with its rewritten text.
    own = lambda c: F.sum(F.when(F.col("anonymized").isNotNull(), F.col(c)).otherwise(0)).alias(c)
    nations = rewritten.groupBy("one").agg(own("n"), own("sum")).select(
        F.col("one").alias("doc_id"), F.col("n").alias("n_spans"), F.col("sum").alias("starts"), F.lit(0).cast("bigint").alias("n_names")
    )
    lines = F.transform(F.sort_array(F.collect_list(F.struct("at", "text"))), lambda r: r["text"])
    lists = events.where(F.col("one").isNotNull()).groupBy(F.col("one").alias("doc_id")).agg(F.array_join(lines, " ").alias("text"))
    done = pseudonym.anonymize(rec.detect(lists))
    return nations.unionByName(
        done.select("doc_id", big(F.size("spans")).alias("n_spans"), _starts(F.lit(0)).alias("starts"), big(F.size("mapping")).alias("n_names"))
    )


def _starts(offset):
    """The sum of the places of a row's spans in a text that the row stands in at ``offset``."""
    return F.aggregate("spans", F.lit(0).cast("bigint"), lambda acc, s: acc + s["start"] + offset)


# ------------------------------------------------------------------ counts


@query(
    "spans_per_doc",
    f"""{_DETECTED_TEXTS} select t.doc_id, count(s.doc_id) as n_spans from texts t left join spans s on s.doc_id = t.doc_id group by t.doc_id""",
)
def spans_per_doc(spark, sf_dir):
    found = rec.detect(fx.texts(spark, sf_dir))
    return found.select("doc_id", big(F.size("spans")).alias("n_spans"))


@query(
    "type_legend",
    f"""{_DETECTED_LETTERS}, placed as (
      select doc_id, entity_type, row_number() over (partition by doc_id order by s, e desc, score desc, entity_type) as place from spans),
    firsts as (select doc_id, entity_type, min(place) as place from placed group by doc_id, entity_type)
    select doc_id, string_agg(entity_type, ',' order by place) as legend from firsts group by doc_id""",
)
def type_legend(spark, sf_dir):
    """Distinct types of a text in the order they first appear."""
    found = rec.detect(fx.letters(spark, sf_dir))
    kinds = F.array_distinct(F.transform("spans", lambda s: s["entity_type"]))
    return found.select("doc_id", F.array_join(kinds, ",").alias("legend"))
