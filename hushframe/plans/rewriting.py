"""Queries that rewrite texts: codenames, mappings, marked-up views, restoring, vault."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as c
from ..functions.text import fold_key
from ..operators import annotate, chat, pseudonym
from ..operators import recognizers as rec
from ..operators import rehydrate as rh
from ..operators import spans as sp
from ..session import work_folder
from ..sources import files, vault
from . import fixtures as fx
from . import sql
from .registry import big, query

# ------------------------------------------------------------------ codenames


def _occurrences(spark, sf_dir):
    """Resolved spans of the letters as rows with their key."""
    found = rec.detect(fx.letters(spark, sf_dir))
    resolved = found.select("doc_id", sp.resolve_overlaps(F.col("spans")).alias("spans"))
    long = sp.explode_spans(resolved, ["doc_id"])
    return long.select("doc_id", "entity_type", "start", fold_key(F.col("text")).alias("key"))


_RESOLVED_LETTERS = f"with recursive {fx.LETTERS_SQL}, {sql.detected('letters')}, {sql.resolved('spans')}"


@query(
    "codename_keys",
    f"""{_RESOLVED_LETTERS}, k as (select *, lower({sql.strip('span_text')}) as key from resolved)
    select doc_id, key, entity_type, s as first_start from (
      select *, row_number() over (partition by doc_id, key order by s) as rn from k) where rn = 1""",
)
def codename_keys(spark, sf_dir):
    """Where and as what type an identifier first occurs in its text."""
    firsts = pseudonym.first_seen(_occurrences(spark, sf_dir), ["doc_id"], ["start"])
    return firsts.select("doc_id", "key", "entity_type", big("start").alias("first_start"))


_CORPUS = f"""{_RESOLVED_LETTERS}, keyed as (select *, 1 as one, cast('0x' || substr(md5(cast(doc_id as varchar)), 1, 10) as bigint) * 1000000 + s as place from resolved),
{sql.codenames('keyed', 'one', 'place')}"""


def _corpus_codebook(spark, sf_dir):
    """The reading order goes by hashed ids, which lie far apart."""
    hashed = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 10), 16, 10).cast("bigint")
    rows = _occurrences(spark, sf_dir).withColumn("at", hashed)
    return pseudonym.codebook(rows, [], ["at", "start"]).select("key", "entity_type", big("number").alias("number"), "codename")


@query(
    "codenames_bracket",
    f"""{_CORPUS} select distinct key, key_type as entity_type, number, codename from named
    where {sql.pool_sql('key_type')} is null""",
)
def codenames_bracket(spark, sf_dir):
    """Bracket names numbered per type over the whole corpus."""
    return _corpus_codebook(spark, sf_dir).where(~F.col("entity_type").isin(*c.POOL_OF_TYPE))


@query(
    "codenames_pool",
    f"""{_CORPUS} select distinct key, key_type as entity_type, number, codename from named
    where {sql.pool_sql('key_type')} is not null""",
)
def codenames_pool(spark, sf_dir):
    """Pool names over the whole corpus, far beyond the size of the pool."""
    return _corpus_codebook(spark, sf_dir).where(F.col("entity_type").isin(*c.POOL_OF_TYPE))


def _pipeline(src_sql: str, src: str) -> str:
    return f"""with recursive {src_sql}, {sql.detected(src)}, {sql.resolved('spans')},
{sql.codenames('resolved', 'doc_id', 's')}, {sql.spliced('named', src, 'doc_id')}"""


_DOCS = "docs as (select doc_id, text from documents)"


@query(
    "anonymize_documents",
    f"{_pipeline(_DOCS, 'docs')} select doc_id, anonymized, n_spans as replaced from spliced",
)
def anonymize_documents(spark, sf_dir):
    """The whole pipeline over the documents: detect, resolve, number, rewrite; no shuffle."""
    done = pseudonym.anonymize(rec.detect(fx.documents(spark, sf_dir)), keep_spans=True)
    return done.select("doc_id", "anonymized", big(F.size("resolved")).alias("replaced"))


@query(
    "anonymize_letters",
    f"{_pipeline(fx.LETTER_FILES_SQL, 'letter_files')} select doc_id, anonymized, n_spans as replaced from spliced",
)
def anonymize_letters(spark, sf_dir):
    """Long texts with more persons than the pool has names."""
    done = pseudonym.anonymize(rec.detect(fx.letter_files(spark, sf_dir)), keep_spans=True)
    return done.select("doc_id", "anonymized", big(F.size("resolved")).alias("replaced"))


_MAPPED = f"""{_pipeline(fx.LETTERS_SQL, 'letters')}, mapped as (
  select doc_id, codename, max_by(span_text, s) as original, min(s) as first_s from named group by doc_id, codename
)"""


@query("mappings", f"{_MAPPED} select doc_id, codename, original from mapped")
def mappings(spark, sf_dir):
    done = pseudonym.anonymize(rec.detect(fx.letters(spark, sf_dir)))
    return pseudonym.mapping_rows(done, ["doc_id"])


@query(
    "mapping_preview",
    f"""{_MAPPED} select l.doc_id, coalesce(string_agg(original, ' | ' order by first_s), '') as preview
    from letters l left join (select *, row_number() over (partition by doc_id order by first_s) as rn from mapped) m
      on m.doc_id = l.doc_id and rn <= 3 group by l.doc_id""",
)
def mapping_preview(spark, sf_dir):
    """The first three originals of a text."""
    done = pseudonym.anonymize(rec.detect(fx.letters(spark, sf_dir)))
    return done.select("doc_id", F.array_join(F.slice(F.map_values("mapping"), 1, 3), " | ").alias("preview"))


@query(
    "roundtrip_check",
    f"with {fx.TEXTS_SQL} select count(*) as texts, count(*) as restored from texts",
)
def roundtrip_check(spark, sf_dir):
    """Anonymize and restore gives every text back."""
    done = pseudonym.anonymize(rec.detect(fx.texts(spark, sf_dir)))
    back = rh.rehydrate_exact(F.col("anonymized"), F.col("mapping"))
    return done.select((back == F.col("text")).alias("same")).agg(
        big(F.count(F.lit(1))).alias("texts"), big(F.count_if("same")).alias("restored")
    )


# ------------------------------------------------------------------ marked-up views


def escape_sql(x: str) -> str:
    return (
        f"replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), "
        "'''', '&#x27;')"
    )


_COLOUR = (
    "(case "
    + " ".join(f"when entity_type = {sql.q(k)} then {sql.q(v)}" for k, v in c.TYPE_COLOURS.items())
    + f" else {sql.q(c.OTHER_COLOUR)} end)"
)
_SHARP = "sharp as (select doc_id, replace(replace(text, 'Gruber', '<Gruber & \"Co\">'), 'geheim', '<b>''x''&') as text from letters)"


def _marked(chosen: str, mark: str) -> str:
    return f"""
    marked as (select *, {mark} as codename, coalesce(lag(e) over (partition by doc_id order by s), 0) as prev from {chosen}),
    joined as (
      select p.doc_id, string_agg({escape_sql('substr(t.text, p.prev + 1, p.s - p.prev)')} || p.codename, '' order by p.s) as body, max(p.e) as last
      from marked p join sharp t on t.doc_id = p.doc_id group by p.doc_id)
    select t.doc_id, coalesce(body, '') || {escape_sql("substr(t.text, coalesce(last, 0) + 1)")} as html
    from sharp t left join joined j on j.doc_id = t.doc_id"""


def _sharp(spark, sf_dir):
    """Letters with characters that need escaping, inside and outside of spans."""
    return fx.letters(spark, sf_dir).select(
        "doc_id",
        F.replace(
            F.replace("text", F.lit("Gruber"), F.lit('<Gruber & "Co">')), F.lit("geheim"), F.lit("<b>'x'&")
        ).alias("text"),
    )


@query(
    "annotate_html",
    f"""with recursive {fx.LETTERS_SQL}, {_SHARP}, {sql.detected('sharp')}, {sql.resolved('spans')}, {_marked('resolved', f'''
      '<mark style="background-color: ' || {_COLOUR} || '20; border: 1px solid ' || {_COLOUR}
      || '; border-radius: 3px; padding: 1px 4px;" data-entity="' || entity_type || '" title="' || entity_type || ' ('
      || cast(cast(round(score * 100) as int) as varchar) || '%)">' || {escape_sql('span_text')} || '</mark>' ''')}""",
)
def annotate_html(spark, sf_dir):
    found = rec.detect(_sharp(spark, sf_dir))
    return found.select("doc_id", annotate.annotate_html(F.col("text"), F.col("spans")).alias("html"))


@query(
    "annotate_html_first_wins",
    f"""with recursive {fx.LETTERS_SQL}, {_SHARP}, {sql.detected('sharp')},
    walk_r as (select *, row_number() over (partition by doc_id order by s, e desc, score desc, entity_type) as rn from spans),
    walk as (
      select doc_id, cast(0 as bigint) as rn, cast(0 as bigint) as reach, false as took from walk_r where rn = 1
      union all
      select w.doc_id, r.rn, case when r.s >= w.reach then r.e else w.reach end, r.s >= w.reach
      from walk w join walk_r r on r.doc_id = w.doc_id and r.rn = w.rn + 1),
    chosen as (select r.* from walk_r r join walk w on w.doc_id = r.doc_id and w.rn = r.rn where took),
    {_marked('chosen', f'''
      '<mark class="entity-mark entity-' || entity_type || '" title="' || entity_type || '">' || {escape_sql('span_text')} || '</mark>' ''')}""",
)
def annotate_html_first_wins(spark, sf_dir):
    found = rec.detect(_sharp(spark, sf_dir))
    return found.select("doc_id", annotate.annotate_html_first_wins(F.col("text"), F.col("spans")).alias("html"))


# ------------------------------------------------------------------ answers and their vault

K = "c_custkey"
_FIRST_ORDER = "(select o_custkey, min(o_orderdate) as od from orders group by o_custkey) o"
_NAME = f"concat({fx.first_name(K)}, ' ', {fx.pick(fx.LAST, K)})"
ORIGINALS = {
    "Arion": _NAME,
    "[AT_UID_NR_1]": fx.uid(K),
    "[AT_IBAN_1]": fx.iban(K),
    "[EU_PII_1]": fx.ip(K),
    "[EU_PII_12]": f"concat('K-', cast({K} as string))",
    "Nexon Corp": "c_name",
}
# A type that no recognizer has.
OWN_TYPE = "[PROJECT_7]"
CREATED = "coalesce(od, timestamp '1996-01-01 00:00:00')"


def answer(name, uid, iban, ip, card, org, tight=False) -> str:
    """An answer text; ``tight`` drops the blanks that a codename without brackets swallows."""
    b = "" if tight else " "
    return (
        f"concat('Lieber ', {name}, ', UID{b}', {uid}, '{b}und Konto{b}', {iban}, '; IP{b}', {ip}, "
        f"'{b}bei ', {org}, '. Karte{b}', {card}, '. Danke ', {name}, '!')"
    )


NAMES = [f"'{n}'" for n in ("Arion", "[AT_UID_NR_1]", "[AT_IBAN_1]", "[EU_PII_1]", "[EU_PII_12]", "Nexon Corp")]
STYLES = {
    0: answer(*NAMES),
    1: answer(*[n.lower() for n in NAMES]),
    2: answer(*[n.replace("[", "").replace("]", "") for n in NAMES]),
    3: answer(*[n.replace("[", "[ ").replace("]", " ]") for n in NAMES]),
    4: answer(*[n.replace("[", "(").replace("]", ")") for n in NAMES]),
}
RESTORED = answer(*ORIGINALS.values())
RESTORED_TIGHT = answer(*ORIGINALS.values(), tight=True)


def styled(which: str) -> str:
    return "case " + " ".join(f"when {which} = {i} then {t}" for i, t in STYLES.items()) + " end"


def restored(which: str) -> str:
    return f"case when {which} = 2 then {RESTORED_TIGHT} else {RESTORED} end"


_CUSTOMERS = f"people as (select customer.*, od from customer left join {_FIRST_ORDER} on o_custkey = c_custkey)"


def _people(spark, sf_dir):
    orders = fx.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("od"))
    customer = fx.spread(fx.table(spark, sf_dir, "customer"), "c_custkey")
    return customer.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")


def _mapping():
    return F.create_map(*[x for k, v in ORIGINALS.items() for x in (F.lit(k), F.expr(v))])


def _vault(spark, sf_dir):
    people = _people(spark, sf_dir)
    keyed = people.select(
        F.concat(F.lit("s"), F.col(K).cast("string")).alias("session_id"),
        _mapping().alias("mapping"),
        F.expr(CREATED).alias("created_at"),
    )
    return pseudonym.mapping_rows(keyed, ["session_id", "created_at"])


#: Seconds after which every third session is written again, and days after which it is for the queries on its age.
AGAIN, DAYS_AGAIN = 900, 200


def _written_twice(spark, sf_dir, later):
    """The vault with a second write to every third session."""
    first = _vault(spark, sf_dir)
    again = first.where("cast(substr(session_id, 2) as bigint) % 3 = 0")
    return first.unionByName(again.withColumn("created_at", F.col("created_at") + later))


def _restoring(name, style, fn):
    @query(
        name,
        f"with {_CUSTOMERS} select c_custkey as answer_id, {restored(style)} as restored from people",
    )
    def run(spark, sf_dir):
        return _people(spark, sf_dir).select(
            F.col(K).alias("answer_id"), fn(F.expr(styled(style)), _mapping()).alias("restored")
        )

    return run


_restoring("rehydrate_exact", "0", rh.rehydrate_exact)
_restoring("rehydrate_nocase", "c_custkey % 2", rh.rehydrate)
_restoring("rehydrate_fuzzy", "(c_custkey % 3 + 2)", rh.rehydrate)


@query(
    "rehydrate_session",
    f"""with {_CUSTOMERS}, asked as (
      select *, (c_custkey % 11 <> 0 and ((c_custkey % 4) * 700 <= 1800 or c_custkey % 3 = 0)) as live, {styled('c_custkey % 5')} as text from people)
    select c_custkey as answer_id, case when live then 'ok' else 'missing' end as status,
           case when live then {restored('c_custkey % 5')} end as rehydrated_text,
           case when live then cast(case when c_custkey % 5 in (0, 1) then 6 else 2 end as bigint) end as replacements_made
    from asked""",
)
def rehydrate_session(spark, sf_dir):
    """Answers meet the vault of their session; unknown and old sessions give nothing. Some ask between two writes, or after both."""
    responses = _people(spark, sf_dir).select(
        F.col(K).alias("answer_id"),
        F.when(F.col(K) % 11 == 0, F.concat(F.lit("x"), F.col(K).cast("string")))
        .otherwise(F.concat(F.lit("s"), F.col(K).cast("string")))
        .alias("session_id"),
        F.expr(styled("c_custkey % 5")).alias("text"),
        (F.expr(CREATED) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col(K) % 4) * 700)).alias("asked_at"),
    )
    held = _written_twice(spark, sf_dir, F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(AGAIN)))
    done = rh.rehydrate_sessions(responses, held, ["answer_id"])
    return done.select("answer_id", "status", "rehydrated_text", "replacements_made")


@query(
    "replacement_count",
    f"""with {_CUSTOMERS} select c_custkey as answer_id, cast(case when c_custkey % 5 in (0, 1) then 6 else 2 end as bigint) as replacements
    from people""",
)
def replacement_count(spark, sf_dir):
    return _people(spark, sf_dir).select(
        F.col(K).alias("answer_id"),
        rh.replacements_made(F.expr(styled("c_custkey % 5")), _mapping()).alias("replacements"),
    )


@query(
    "rehydrate_json",
    f"""with {_CUSTOMERS} select cast(c_custkey as varchar) as answer_id,
      concat('Guten Tag ', '"', c_name, '"', chr(10), chr(92), ' $1', ', UID ', {fx.uid(K)}) as restored, 'null' as stop, '{{"n":' || cast(c_custkey as varchar) || '}}' as usage
    from people""",
)
def rehydrate_json(spark, sf_dir):
    """Originals with quotes, line breaks and backslashes inside a JSON answer; other fields and nulls stay."""
    text = F.to_json(F.array(F.struct(F.lit("text").alias("type"), F.lit("Guten Tag Arion, UID [AT_UID_NR_1]").alias("text"))))
    key = F.col(K).cast("string")
    body = F.concat(
        F.lit('{"id":"'), key, F.lit('","content":'), text, F.lit(',"stop":null,"usage":{"n":'), key, F.lit("}}")
    )
    original = F.concat(F.lit('"'), "c_name", F.lit('"\n\\ $1'))
    mapping = F.create_map(F.lit("Arion"), original, F.lit("[AT_UID_NR_1]"), F.expr(fx.uid(K)))
    out = _people(spark, sf_dir).select(rh.rehydrate_json(body, mapping).alias("json"))
    return out.select(
        F.get_json_object("json", "$.id").alias("answer_id"),
        F.get_json_object("json", "$.content[0].text").alias("restored"),
        F.regexp_extract("json", '"stop":(\\w+)', 1).alias("stop"),
        F.get_json_object("json", "$.usage").alias("usage"),
    )


@query(
    "placeholder_scan",
    f"""with {_CUSTOMERS} select answer_id, cast(i - 1 as bigint) as nth, m[i] as placeholder from (
      select *, unnest(range(1, len(m) + 1)) as i from (
        select c_custkey as answer_id, regexp_extract_all({styled('c_custkey % 5')}, '\\[(\\w+?)\\]', 1) as m from people))""",
)
def placeholder_scan(spark, sf_dir):
    found = annotate.placeholders(F.expr(styled("c_custkey % 5")))
    out = _people(spark, sf_dir).select(F.col(K).alias("answer_id"), F.posexplode(found).alias("nth", "placeholder"))
    return out.withColumn("nth", big("nth"))


@query(
    "highlight_restored",
    f"""with {_CUSTOMERS}, r as (select c_custkey as answer_id, {escape_sql(RESTORED)} as t, {escape_sql(_NAME)} as a, {escape_sql(fx.uid(K))} as b from people)
    select answer_id, replace(replace(t, a, '<span class="rehydrated-mark">' || a || '</span>'), b, '<span class="rehydrated-mark">' || b || '</span>') as html from r""",
)
def highlight_restored(spark, sf_dir):
    originals = F.array(F.expr(_NAME), F.expr(fx.uid(K)), F.expr(_NAME), F.lit("x"))
    return _people(spark, sf_dir).select(
        F.col(K).alias("answer_id"), rh.highlight(F.expr(RESTORED), originals).alias("html")
    )


# ------------------------------------------------------------------ vault

_VAULT_SQL = (
    f"with {_CUSTOMERS}, vault as (\n"
    + "\nunion all\n".join(
        f"select concat('s', cast(c_custkey as string)) as session_id, {sql.q(k)} as codename, {v} as original, {CREATED} as created_at from people"
        for k, v in ORIGINALS.items()
    )
    + ")"
)


@query("vault_roundtrip", f"{_VAULT_SQL} select session_id, codename, original from vault")
def vault_roundtrip(spark, sf_dir):
    """Mappings written to the partitioned vault and read back."""
    path = work_folder(spark, "vault")
    vault.append(_vault(spark, sf_dir), path)
    return vault.load(spark, path).select("session_id", "codename", "original")


_NOW = "1996-03-01 00:00:00"
_YEAR = 31_536_000
_LATEST_SQL = f"""latest as (
  select session_id, max(written) as newest from (
    select session_id, created_at as written from vault
    union all select session_id, created_at + interval {DAYS_AGAIN} days from vault where cast(substr(session_id, 2) as bigint) % 3 = 0)
  where written <= timestamp '{_NOW}' group by session_id)"""


@query(
    "vault_expiry",
    f"""{_VAULT_SQL}, {_LATEST_SQL}
    select count(*) filter (where epoch_us(timestamp '{_NOW}') - epoch_us(newest) <= {_YEAR}000000) as live,
      count(*) filter (where epoch_us(timestamp '{_NOW}') - epoch_us(newest) > {_YEAR}000000) as expired from latest""",
)
def vault_expiry(spark, sf_dir):
    """Sessions alive at a moment with a lifetime of a year; the latest write up to then counts, and an age of exactly that is alive."""
    held = _written_twice(spark, sf_dir, F.make_dt_interval(F.lit(DAYS_AGAIN)))
    return vault.session_stats(held, F.lit(_NOW).cast("timestamp"), ttl=_YEAR)


@query(
    "vault_sweep",
    f"""{_VAULT_SQL}, kept as (
      select session_id, codename, original, created_at from vault
      union all select session_id, codename, original, created_at + interval {DAYS_AGAIN} days from vault where cast(substr(session_id, 2) as bigint) % 3 = 0)
    select session_id, codename, original, created_at from kept where epoch_us(timestamp '{_NOW}') - epoch_us(created_at) <= {_YEAR}000000""",
)
def vault_sweep(spark, sf_dir):
    """A vault that was written in two writes, one of them repeated, after a sweep: what is past its lifetime is gone."""
    path = work_folder(spark, "vault")
    first = _vault(spark, sf_dir)
    vault.append(first, path, "first")
    vault.append(_written_twice(spark, sf_dir, F.make_dt_interval(F.lit(DAYS_AGAIN))).exceptAll(first), path, "second")
    vault.append(first, path, "first")
    vault.sweep(spark, path, _NOW, ttl=_YEAR)
    return vault.load(spark, path).select("session_id", "codename", "original", "created_at")


# ------------------------------------------------------------------ prompts, cuts, reports

_PROMPT = "Fasse den folgenden Text zusammen:"


@query(
    "prompt_assembly",
    f"select doc_id, md5(concat({sql.q(_PROMPT)}, chr(10), chr(10), '---', chr(10), chr(10), text)) as prompt_md5 from documents",
)
def prompt_assembly(spark, sf_dir):
    df = fx.documents(spark, sf_dir)
    return df.select("doc_id", F.md5(chat.prompt(F.lit(_PROMPT), F.col("text"))).alias("prompt_md5"))


@query(
    "budget_truncate",
    """select doc_id, length(substr(text, 1, (2048 - 512 - 100) * 4)) as summary_chars, md5(substr(text, 1, (2048 - 512 - 100) * 4)) as summary_md5,
       md5(substr(text, 1, 1000)) as classify_md5 from documents""",
)
def budget_truncate(spark, sf_dir):
    """Texts cut to a model's context: the answer budget is taken off, a token counts four characters."""
    summary = files.truncate(F.col("text"), (2048 - 512 - 100) * 4)
    return fx.documents(spark, sf_dir).select(
        "doc_id", big(F.length(summary)).alias("summary_chars"), F.md5(summary).alias("summary_md5"),
        F.md5(files.truncate(F.col("text"), 1000)).alias("classify_md5"),
    )


@query(
    "report_json",
    f"""{_MAPPED}
    select s.doc_id, s.anonymized as anonymized_text, s2.n as entities_found, coalesce(u.original, '') as uid_original
    from spliced s join (select doc_id, count(*) as n from mapped group by doc_id) s2 on s2.doc_id = s.doc_id
    left join mapped u on u.doc_id = s.doc_id and u.codename = '[AT_UID_NR_1]'""",
)
def report_json(spark, sf_dir):
    """The JSON report of each letter, read back field by field."""
    done = pseudonym.anonymize(rec.detect(fx.letters(spark, sf_dir)))
    report = done.select("doc_id", files.report_json().alias("json"))
    shape = "anonymized_text string, mappings map<string,string>, entities_found bigint"
    parsed = report.select("doc_id", F.from_json("json", shape).alias("r"))
    return parsed.select(
        "doc_id", "r.anonymized_text", "r.entities_found",
        F.coalesce(F.element_at("r.mappings", "[AT_UID_NR_1]"), F.lit("")).alias("uid_original"),
    )


# One text in seven holds the mark of the search, two code points in front.
_MARKED = "case when doc_id % 7 = 0 then '\ufdd0 ' else '' end || text"


@query(
    "sql_surface",
    f"""with {fx.TEXTS_SQL}, marked as (select doc_id, {_MARKED} as text from texts), {sql.detected('marked')},
    n as (select doc_id, count(*) as spans, sum(s) as starts from spans group by doc_id)
    select t.doc_id, coalesce(spans, 0) as spans, cast(coalesce(starts, 0) as bigint) as starts,
      concat(substr(md5(cast(t.doc_id as varchar)), 1, 8), '...', substr(md5(cast(t.doc_id as varchar)), 29, 4)) as masked,
      '***' as masked_short, 'kunde ' || cast(t.doc_id as varchar) as folded,
      cast((length(lower(text)) - length(replace(lower(text), 'the', ''))) // 3 as bigint) as the_count,
      'Lieber Thomas Gruber, Thomas-2, ATU1' as restored, true as same
    from marked t left join n on n.doc_id = t.doc_id""",
)
def sql_surface(spark, sf_dir):
    """The SQL functions called from SQL; ``same`` compares the rewritten text with that of the DataFrame functions.

    The spans that SQL finds are rewritten as they are, not found again.
    """
    from ..functions import sqlfuncs

    sqlfuncs.register(spark)
    texts = fx.texts(spark, sf_dir).select("doc_id", F.expr(_MARKED).alias("text"))
    found = rec.detect(texts, into="found").withColumn("spans", F.call_function("pii_spans", "text"))
    both = pseudonym.anonymize(found, spans="found")
    return spark.sql(
        """SELECT doc_id, CAST(size(spans) AS BIGINT) AS spans,
          CAST(aggregate(spans, 0L, (acc, s) -> acc + s.start) AS BIGINT) AS starts,
          mask_key(md5(CAST(doc_id AS STRING))) AS masked, mask_key('short') AS masked_short,
          pii_fold_key(concat('  KUNDE ', CAST(doc_id AS STRING), ' ')) AS folded, pii_term_count(text, 'The') AS the_count,
          pii_rehydrate('Lieber Arion Gruber, Arion-2, ( at_uid_nr 1 )', map('Arion', 'Thomas', 'Arion-2', 'Thomas-2', '[AT_UID_NR_1]', 'ATU1')) AS restored,
          pii_anonymize(text, spans).anonymized = anonymized AS same
        FROM {texts}""",
        texts=both,
    )
