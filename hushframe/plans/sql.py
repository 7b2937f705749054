"""Building blocks of the check queries (DuckDB SQL), written without the operators they check.

DuckDB's regular expressions know neither look-around nor Unicode word borders.  Patterns with word
borders therefore run on ``plain``, the text with every non-ASCII letter or digit turned into an
underscore and every other non-ASCII character into a tilde, so borders fall where Unicode puts them
and all offsets stay the same.
"""

from __future__ import annotations

from .. import constants as c


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def sql_in(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


PLAIN = (
    "regexp_replace(regexp_replace(text, '[^\\x00-\\x7F\\p{L}\\p{M}\\p{N}]', '~', 'g'), '[^\\x00-\\x7F]', '_', 'g')"
)

UID_W = ["uid", "uid-nummer", "umsatzsteuer", "atu", "uid-nr"]
IBAN_W = ["iban", "konto", "bankverbindung", "kontonummer", "überweisung"]
TEL_W = ["telefon", "tel", "handy", "mobil", "rufnummer", "erreichbar", "anrufen"]
FN_W = ["firmenbuch", "firmenbuchnummer", "fn", "firmenbuch-nr", "handelsregister"]
EU_W = [
    "ip", "adresse", "ip-adresse", "iban", "konto", "kreditkarte", "visa", "mastercard", "geburtsdatum",
    "geboren", "geb.", "kennzeichen", "nummernschild", "steuer", "steuernummer", "pass", "reisepass", "ausweis",
]
W = "\\p{L}\\p{M}\\p{Nd}_"


def _value(labels: str, extra: str, lo: int, hi: int) -> str:
    return (
        f"(?i)((?:{labels})[:\\s]+[\"']?)([A-Za-zÄÖÜäöüß][{W}\\s\\-{extra}]{{{lo},{hi}}}?)(?:[,.\\n]|$)"
    )


# Patterns and scores, here in the dialect of the check engine.
# name: (type, base score, pattern, labelled, least characters, context words, runs on plain text)
PATTERNS = {
    "at_uid": ("AT_UID_NR", 0.9, r"(?i)\bATU[0-9]{8}\b", False, 1, UID_W, True),
    "at_iban": ("AT_IBAN", 0.95, r"(?i)\bAT\d\d\s?\d{4}\s?\d{4}\s?\d{4}\s?\d{4}\b", False, 1, IBAN_W, True),
    "at_svnr": (
        "AT_SVNR", 0.95,
        r"(?i)((?:SVNr|SV-Nr|SV-Nummer|Versicherungsnummer|Sozialversicherungsnummer)[.:\s]*)\b(\d{4}\s?\d{6})\b",
        True, 1, [], True),
    "phone_intl": ("PHONE_NUMBER", 0.85, r"\+43\s?\d{1,4}[\s/\-]?\d{3,}[\s/\-]?\d*", False, 1, TEL_W, True),
    "phone_local": ("PHONE_NUMBER", 0.7, r"\b0\d{1,4}[\s/\-]?\d{3,}[\s/\-]?\d*", False, 1, TEL_W, True),
    "firmenbuch": ("AT_FIRMENBUCH_NR", 0.9, r"(?i)\bFN\s?\d{5,6}\s?[a-z]\b", False, 1, FN_W, True),
    "doc_metadata": (
        "DOC_METADATA", 0.85,
        r"(?i)((?:erstellt\s+f[uü]r|Auftraggeber|Kunde|im\s+Auftrag\s+von|Ansprechpartner|Empf[aä]nger|"
        r"Projektleiter|Bearbeiter)[:\s]+)([^\n]+?)(?:\n|$)", True, 2, [], False),
    "credential_label": (
        "CREDENTIAL", 0.9,
        r"(?i)((?:passwort|password|kennwort|pwd|pin|passphrase|secret|geheimwort|zugangscode)[\s:=]+[\"']?)"
        r"(\S{4,})[\"']?", True, 1, [], False),
    "credential_stmt": (
        "CREDENTIAL", 0.9,
        r"(?i)((?:mein|my|unser)\s+(?:passwort|password|kennwort|pin|key|token|secret|zugangscode)\s+"
        r"(?:ist|is|lautet|=)\s+[\"']?)(\S{4,})[\"']?", True, 1, [], False),
    "api_key": (
        "CREDENTIAL", 0.95,
        r"\b(?:sk-[a-zA-Z0-9_-]{20,}|pk_[a-zA-Z0-9_-]{20,}|api[_-][a-zA-Z0-9_-]{20,}|key[_-][a-zA-Z0-9_-]{20,}|"
        r"token[_-][a-zA-Z0-9_-]{20,}|ghp_[a-zA-Z0-9]{36,}|gho_[a-zA-Z0-9]{36,}|glpat-[a-zA-Z0-9_-]{20,}|"
        r"xox[bpsa]-[a-zA-Z0-9-]{10,}|AKIA[A-Z0-9]{16})\b", False, 1, [], True),
    "bearer": (
        "CREDENTIAL", 0.95,
        r"(Bearer\s+)(eyJ[a-zA-Z0-9_-]{20,}\.eyJ[a-zA-Z0-9_-]{20,}\.[a-zA-Z0-9_-]{20,})", True, 1, [], False),
    "conn_string": (
        "CREDENTIAL", 0.95, r"(?i)(?:postgres|postgresql|mysql|mongodb|redis|amqp|sqlite)://\S{10,}",
        False, 1, [], False),
    "private_key": (
        "CREDENTIAL", 0.95,
        r"-----BEGIN\s+(?:RSA\s+)?(?:PRIVATE|EC)\s+KEY-----(?s:.{20,}?)-----END\s+(?:RSA\s+)?(?:PRIVATE|EC)\s+KEY-----",
        False, 1, [], False),
    "ipv4": ("EU_PII", 0.6, r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", False, 1, EU_W, True),
    "ipv6": ("EU_PII", 0.8, r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b", False, 1, EU_W, True),
    "eu_iban": (
        "EU_PII", 0.85, r"(?i)\b[A-Z]{2}\d{2}\s?\d{4}\s?\d{4}\s?\d{4}\s?\d{4}\s?[\d\s]{0,10}\b", False, 1, EU_W, True),
    "visa": ("EU_PII", 0.8, r"\b4\d{3}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b", False, 1, EU_W, True),
    "mastercard": ("EU_PII", 0.8, r"\b5[1-5]\d{2}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b", False, 1, EU_W, True),
    "amex": ("EU_PII", 0.8, r"\b3[47]\d{2}[\s-]?\d{6}[\s-]?\d{5}\b", False, 1, EU_W, True),
    "date_de": ("EU_PII", 0.65, r"\b(?:0[1-9]|[12]\d|3[01])\.(?:0[1-9]|1[0-2])\.\d{4}\b", False, 1, EU_W, True),
    "date_iso": ("EU_PII", 0.65, r"\b\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])\b", False, 1, EU_W, True),
    "plate_at": ("EU_PII", 0.4, r"(?i)\b[A-Z]{1,2}\s?\d{1,5}\s?[A-Z]{1,3}\b", False, 1, EU_W, True),
    "plate_de": ("EU_PII", 0.4, r"(?i)\b[A-Z]{1,3}\s?[A-Z]{1,2}\s?\d{1,4}[EH]?\b", False, 1, EU_W, True),
    "tax_de": ("EU_PII", 0.3, r"\b\d{2,3}/?\.?\d{3,4}/?\.?\d{4,5}\b", False, 1, EU_W, True),
    "passport_at": ("EU_PII", 0.4, r"(?i)\b[A-Z]\d{7}\b", False, 1, EU_W, True),
    "health": (
        "SENSITIVE_DATA", 0.85,
        _value("diagnose|befund|krankheit|erkrankung|medikament|therapie|behandlung|symptom|allergie", ".", 3, 60),
        True, 3, [], False),
    "religion": (
        "SENSITIVE_DATA", 0.85,
        _value("religion|konfession|glaube|glaubensbekenntnis|religionszugehoerigkeit", "", 2, 30),
        True, 3, [], False),
    "politics": (
        "SENSITIVE_DATA", 0.85,
        _value(r"partei|parteimitglied|politische\s+(?:meinung|ueberzeugung|orientierung)", "", 2, 40),
        True, 3, [], False),
    "ethnicity": (
        "SENSITIVE_DATA", 0.85,
        _value(r"ethnie|ethnische\s+herkunft|abstammung|nationalitaet|staatsangehoerigkeit", "", 2, 30),
        True, 3, [], False),
    "union": (
        "SENSITIVE_DATA", 0.85,
        _value("gewerkschaft|gewerkschaftsmitglied(?:schaft)?|betriebsrat", "", 2, 40), True, 3, [], False),
    "email": (
        "EMAIL_ADDRESS", 1.0, f"[{W}.+%-]+@[{W}-]+(?:\\.[{W}-]+)*\\.[A-Za-z]{{2,}}", False, 1, [], False),
    "iban_any": (
        "IBAN_CODE", 1.0, r"(?i)\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", False, 1, [], True),
    "card_any": (
        "CREDIT_CARD", 1.0, r"\b(?:4\d{3}|5[1-5]\d{2}|6\d{3}|3\d{3})[- ]?\d{3,4}[- ]?\d{3,4}[- ]?\d{3,5}\b",
        False, 1, [], True),
}

def iban_test(column: str) -> str:
    bare = f"upper(regexp_replace({column}, '\\s', '', 'g'))"
    turned = f"(substr({bare}, 5) || substr({bare}, 1, 4))"
    return f"""list_reduce(
      list_prepend(cast(0 as bigint), list_transform(string_split({turned}, ''),
        lambda ch: cast(case when ch between '0' and '9' then ascii(ch) - 48 else ascii(ch) - 55 end as bigint))),
      lambda a, b: (a * (case when b > 9 then 100 else 10 end) + b) % 97) = 1"""


def luhn_test(column: str) -> str:
    """Right-to-left, every second digit doubled, digit sums add up to a multiple of ten."""
    bare = f"reverse(regexp_replace({column}, '[\\s-]', '', 'g'))"
    return f"""list_sum(list_transform(range(1, length({bare}) + 1),
      lambda i: case when i % 2 = 1 then cast(substr({bare}, i, 1) as int)
                     else (cast(substr({bare}, i, 1) as int) * 2) // 10 + (cast(substr({bare}, i, 1) as int) * 2) % 10 end)) % 10 = 0"""


def lengths(items: str) -> str:
    return f"coalesce(list_sum(list_transform({items}, lambda z: length(z))), 0)"


def words_before(text: str, at: str) -> str:
    return (
        f"lower(array_to_string(list_filter(string_split_regex(substr({text}, 1, {at}), '\\s+'), "
        f"lambda w: w <> '')[-5:], ' '))"
    )


def escape_regex(word: str) -> str:
    return word.replace(".", "\\.")


def scan(name: str, src: str, boost: bool = False) -> str:
    """Spans (doc_id, entity_type, s, e, score, recognizer, span_text) of one pattern."""
    kind, score, pattern, labelled, least, context, plain = PATTERNS[name]
    p = q(pattern)
    body = "plain" if plain else "text"
    label = f", regexp_extract_all({body}, {p}, 1) as lab, regexp_extract_all({body}, {p}, 2) as val" if labelled else ""
    shift = " + length(lab[i])" if labelled else ""
    size = f"length({strip('val[i]')})" if labelled else "length(m[i])"
    points = f"cast({score} as double)"
    if boost and context:
        rx = q("|".join(escape_regex(w) for w in context))
        better = min(1.0, max(round(score + 0.35, 6), 0.4))
        points = f"case when regexp_matches({words_before('text', 's')}, {rx}) then cast({better} as double) else {points} end"
    check = {"iban_any": iban_test("span_text"), "card_any": luhn_test("span_text")}.get(name, "true")
    return f"""
select * from (
  select doc_id, {q(kind)} as entity_type, s, s + n as e, {points} as score, {q(name)} as recognizer,
         substr(text, s + 1, n) as span_text
  from (
    select doc_id, text, cast({lengths('g[1:i]')} + {lengths('m[1:i-1]')}{shift} as bigint) as s, cast({size} as bigint) as n
    from (
      select *, unnest(range(1, len(m) + 1)) as i
      from (select doc_id, text, regexp_extract_all({body}, {p}) as m, string_split_regex({body}, {p}) as g{label}
            from {src} where regexp_matches({body}, {p}))
    )
  ) where n >= {least}
) where {check}"""


def first_names(src: str) -> str:
    """First names: white-space words, looked up without their punctuation."""
    upper_next = "nxt is not null and regexp_matches(nxt, '^\\p{Lu}')"
    return f"""
select h.doc_id, 'PERSON' as entity_type, s, s + length(clean) as e,
       cast(case when {upper_next} then 0.8
                 when regexp_matches(lower(substr(t.text, greatest(s - 30, 0) + 1, s - greatest(s - 30, 0))), {q(NAME_WORDS)}) then 0.85
                 else 0.65 end as double) as score,
       case when {upper_next} then 'first_name_followed' else 'first_name' end as recognizer,
       clean as span_text
from (
  select *, lead(w) over (partition by doc_id order by i) as nxt,
         regexp_replace(w, '[.,;:!?"''()\\[\\]{{}}]+$', '') as clean
  from (
    select doc_id, i, w, cast(sum(length(w) + 1) over (partition by doc_id order by i) - length(w) - 1 as bigint) as s
    from (select doc_id, unnest(string_split_regex(text, '\\s')) as w,
                 generate_subscripts(string_split_regex(text, '\\s'), 1) as i from {src})
  ) where w <> ''
) h join {src} t on t.doc_id = h.doc_id
where regexp_matches(w, '^\\p{{Lu}}') and lower(clean) in {sql_in(c.FIRST_NAMES)}"""


NAME_WORDS = (
    "herr|frau|dr\\.|prof\\.|mag\\.|ing\\.|kollege|kollegin|freund|freundin|mitarbeiter|mitarbeiterin|kunde|kundin|"
    "patient|patientin|chef|chefin|liebe|geschätzte"
)

COLUMNS = (
    "doc_id, entity_type, s as span_start, e as span_end, round(score, 6) as score, span_text"
)


def with_plain(src: str, name: str = "src") -> str:
    return f"{name} as (select doc_id, text, {PLAIN} as plain from {src})"


def all_found(src: str, boost: bool = True) -> str:
    parts = [scan(name, src, boost) for name in PATTERNS] + [first_names(src)]
    return "\nunion all\n".join(parts)


KEEP = (
    f"score >= 0.6 and entity_type in {sql_in(c.KEPT_TYPES)} "
    f"and not (entity_type = 'PERSON' and lower({strip('span_text')}) in {sql_in(c.PRODUCT_NAMES)})"
)


def cleaned(found: str, out: str) -> str:
    """Best of equal spans, then spans not strictly inside a longer one of at least their score."""
    return f"""
{out}_u as (
  select doc_id, entity_type, s, e, max(score) as score, any_value(span_text) as span_text
  from {found} where {KEEP} group by doc_id, entity_type, s, e
),
{out} as (
  select * from {out}_u a where not exists (
    select 1 from {out}_u b where b.doc_id = a.doc_id and b.s <= a.s and a.e <= b.e and b.score >= a.score
      and b.e - b.s > a.e - a.s)
)"""


def detected(src: str, out: str = "spans") -> str:
    """CTEs from texts to detected spans."""
    return f"""{with_plain(src)},
found as ({all_found('src')}),
{cleaned('found', out)}"""


def resolved(spans: str, out: str = "resolved") -> str:
    """Greedy choice, one span after the other by score, length, start and type."""
    return f"""
{out}_r as (
  select *, row_number() over (partition by doc_id order by score desc, e - s desc, s, entity_type) as rn,
         count(*) over (partition by doc_id) as total
  from {spans}
),
{out}_g as (
  select doc_id, cast(0 as bigint) as rn, cast([] as struct(s bigint, e bigint)[]) as kept, cast(false as boolean) as took
  from {out}_r where rn = 1
  union all
  select g.doc_id, r.rn,
         case when len(list_filter(g.kept, lambda k: r.s < k.e and r.e > k.s)) = 0
              then list_append(g.kept, cast(row(r.s, r.e) as struct(s bigint, e bigint))) else g.kept end,
         len(list_filter(g.kept, lambda k: r.s < k.e and r.e > k.s)) = 0
  from {out}_g g join {out}_r r on r.doc_id = g.doc_id and r.rn = g.rn + 1
),
{out} as (
  select r.* exclude (rn, total) from {out}_r r join {out}_g g on g.doc_id = r.doc_id and g.rn = r.rn where g.took
)"""


def pool_sql(kind: str) -> str:
    cases = " ".join(f"when {kind} = {q(k)} then {q(v)}" for k, v in c.POOL_OF_TYPE.items())
    return f"(case {cases} else null end)"


def codename_sql(kind: str, number: str) -> str:
    branches = []
    for pool, names in c.POOLS.items():
        n = len(names)
        base = f"{sql_list(names)}[(({number} - 1) % {n}) + 1]"
        branches.append(
            f"when {pool_sql(kind)} = {q(pool)} then case when {number} <= {n} then {base} "
            f"else {base} || '-' || cast(({number} - 1) // {n} + 1 as varchar) end"
        )
    return f"(case {' '.join(branches)} else '[' || {kind} || '_' || cast({number} as varchar) || ']' end)"


def codenames(spans: str, scope: str, order: str, out: str = "named") -> str:
    """Numbers keys by first appearance inside a scope and names every span."""
    return f"""
{out}_k as (select *, lower({strip('span_text')}) as key from {spans}),
{out}_f as (
  select * from (select *, row_number() over (partition by {scope}, key order by {order}) as seen from {out}_k) where seen = 1
),
{out}_n as (
  select *, row_number() over (partition by {scope}, coalesce({pool_sql('entity_type')}, entity_type) order by {order}) as number
  from {out}_f
),
{out}_b as (select {scope}, key, entity_type as key_type, number, {codename_sql('entity_type', 'number')} as codename from {out}_n),
{out} as (select k.*, b.key_type, b.number, b.codename from {out}_k k join {out}_b b using ({scope}, key))"""


def spliced(named: str, src: str, keys: str, out: str = "spliced") -> str:
    """Texts with each span replaced by its codename."""
    on = " and ".join(f"p.{k.strip()} = t.{k.strip()}" for k in keys.split(","))
    return f"""
{out}_p as (
  select *, coalesce(lag(e) over (partition by {keys} order by s), 0) as prev from {named}
),
{out} as (
  select t.*, coalesce(p.body, '') || substr(t.text, coalesce(p.last, 0) + 1) as anonymized, coalesce(p.n, 0) as n_spans
  from {src} t left join (
    select {', '.join('p.' + k.strip() for k in keys.split(','))},
           string_agg(substr(t.text, p.prev + 1, p.s - p.prev) || p.codename, '' order by p.s) as body,
           max(p.e) as last, count(*) as n
    from {out}_p p join {src} t on {on} group by {', '.join('p.' + k.strip() for k in keys.split(','))}
  ) p on {on}
)"""
