"""Declarative recognizers and the detection step.

A recognizer is data: a pattern, a type, a score and optional context words.  The registry compiles to
native expressions that run together in one projection over ``(id, text)``.  A few cheap gates (a
digit, three digits in a row, a known label, a known name) and literals that a match must hold decide which
patterns a text is scanned with at all.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..constants import CONFIDENCE, FIRST_NAMES, KEPT_TYPES, NAME_CONTEXT, NO_PLACES, PRODUCT_NAMES
from ..functions.text import (
    UNICODE, UNICODE_ANYCASE, any_case, blocks, cut_blocks, fold_key, let, literal_array, quote, word_tree,
)
from ..session import stage
from . import spans as sp

ANY, DIGIT, DIGITS, LABEL, NAME = "any", "digit", "digits", "label", "name"


#: Labels with so few letters in a row that they only count in front of a separator.
SHORT_LABEL = 3
# Letters that ignore-case matching takes for a plain one, though lower() keeps them.
ODD_LETTERS = {"\u0130": "i", "\u0131": "i", "\u017f": "s", "\u212a": "k"}


def _stems(labels: str) -> list[str]:
    """The longest run of plain letters that each alternative of a label pattern must hold, in lower case."""
    sure = labels
    while (less := re.sub(r"\([^()]*\)[?*]?", " ", sure)) != sure:
        sure = less
    sure = re.sub(r"\[[^\]]*\]|\\.|\w[?*]", " ", sure)
    return [max(re.findall(r"[^\W\d_]+", label), key=len, default="").lower() for label in sure.split("|")]


@dataclass(frozen=True)
class Recognizer:
    """One pattern.

    ``labelled`` patterns are the groups label, value and rest.  ``needs`` is a literal every match holds;
    texts without it skip the pattern.  With the gate LABEL, ``labels`` is the pattern of its labels, of which every
    match holds one.
    """

    name: str
    entity_type: str
    pattern: str
    score: float
    labelled: bool = False
    min_chars: int = 1
    context: tuple[str, ...] = ()
    gate: str = ANY
    needs: str | None = None
    check: str | None = None
    labels: str | None = None

    def __post_init__(self) -> None:
        if self.gate == LABEL and not (self.labels and all(_stems(self.labels))):
            raise ValueError(f"{self.name}: the label gate needs labels with letters")


# Context words per family.
UID_CONTEXT = ("UID", "UID-Nummer", "Umsatzsteuer", "ATU", "UID-Nr")
IBAN_CONTEXT = ("IBAN", "Konto", "Bankverbindung", "Kontonummer", "Überweisung")
PHONE_CONTEXT = ("Telefon", "Tel", "Handy", "Mobil", "Rufnummer", "erreichbar", "anrufen")
FIRM_CONTEXT = ("Firmenbuch", "Firmenbuchnummer", "FN", "Firmenbuch-Nr", "Handelsregister")
EU_CONTEXT = (
    "IP", "Adresse", "IP-Adresse", "IBAN", "Konto", "Kreditkarte", "Visa", "Mastercard",
    "Geburtsdatum", "geboren", "geb.", "Kennzeichen", "Nummernschild", "Steuer", "Steuernummer",
    "Pass", "Reisepass", "Ausweis",
)

# Labels in front of a value.
SVNR_LABELS = "SVNr|SV-Nr|SV-Nummer|Versicherungsnummer|Sozialversicherungsnummer"
DOCUMENT_LABELS = (
    r"erstellt\s+f[uü]r|Auftraggeber|Kunde|im\s+Auftrag\s+von|Ansprechpartner|Empf[aä]nger|"
    r"Projektleiter|Bearbeiter"
)
PASSWORD_LABELS = "passwort|password|kennwort|pwd|pin|passphrase|secret|geheimwort|zugangscode"
STATED_SECRETS = "passwort|password|kennwort|pin|key|token|secret|zugangscode"
HEALTH_LABELS = (
    "diagnose|befund|krankheit|erkrankung|medikament|therapie|behandlung|symptom|allergie"
)
RELIGION_LABELS = "religion|konfession|glaube|glaubensbekenntnis|religionszugehoerigkeit"
POLITICS_LABELS = r"partei|parteimitglied|politische\s+(?:meinung|ueberzeugung|orientierung)"
ETHNICITY_LABELS = r"ethni(?:e|sche\s+herkunft)|abstammung|nationalitaet|staatsangehoerigkeit"
UNION_LABELS = "gewerkschaft|gewerkschaftsmitglied(?:schaft)?|betriebsrat"

NAME_TAIL = r"""[.,;:!?"'()\[\]{}]*"""


def _either(letters: Iterable[str]) -> str:
    """A plain class of some letters in every case that ignore-case matching takes for them."""
    return "[" + "".join(sorted({x for a in letters for x in any_case(a).strip("[]")} | {o for o, a in ODD_LETTERS.items() if a in letters})) + "]"


def _first_of(labels: str) -> str:
    """A look at the first letters of the labels, as plain classes: quicker than trying each label at every character."""
    ahead = []
    for column in zip(*labels.lower().split("|")):
        # Only letters that stand there as such; at most four tell enough.
        if len(ahead) == 4 or not all(x.isalpha() for x in column):
            break
        ahead.append(_either(set(column)))
    return f"(?=(?-i:{''.join(ahead)}))"


def _stated(labels: str, chars: str, least: int, most: int) -> str:
    """Label, separator and a value up to a comma, full stop, line end or the end of the text."""
    return (
        UNICODE_ANYCASE
        + _first_of(labels)
        + rf"""((?:{labels})[:\s]+["']?)([A-Za-zÄÖÜäöüß][{chars}]{{{least},{most}}}?)([,.\n]|$)"""
    )


def _first_names(names: Iterable[str]) -> str:
    """One of some names that begins a word with a capital letter."""
    capitals = sorted({x for name in names for x in any_case(name[0]).strip("[]") if x.isupper()})
    return rf"(?=[{''.join(capitals)}])(?<!\S){word_tree(names)}"


def _name_pattern(names: Iterable[str], tail: str) -> str:
    return (
        UNICODE
        + rf"{_first_names(names)}(?={NAME_TAIL}(?!\S))(?{tail}{NAME_TAIL}\s+\p{{Lu}})"
    )


# Patterns and scores of the recognizers.
AT_UID = Recognizer("at_uid", "AT_UID_NR", UNICODE_ANYCASE + _first_of("ATU") + r"\bATU\d{8}\b", 0.9,
                    context=UID_CONTEXT, gate=DIGITS)
AT_IBAN = Recognizer("at_iban", "AT_IBAN", UNICODE_ANYCASE + _first_of("AT") + r"\bAT\d{2}\s?(?:\d{4}\s?){3}\d{4}\b", 0.95,
                     context=IBAN_CONTEXT, gate=DIGITS)
AT_SVNR = Recognizer("at_svnr", "AT_SVNR",
                     UNICODE_ANYCASE + _first_of(SVNR_LABELS) + rf"((?:{SVNR_LABELS})[.:\s]*)\b(\d{{4}}\s?\d{{6}})\b()", 0.95,
                     labelled=True, gate=DIGITS)
PHONE_INTL = Recognizer("phone_intl", "PHONE_NUMBER",
                        UNICODE_ANYCASE + r"\+43\s?\d{1,4}[\s/\-]?\d{3,}[\s/\-]?\d*", 0.85,
                        context=PHONE_CONTEXT, gate=DIGITS)
PHONE_LOCAL = Recognizer("phone_local", "PHONE_NUMBER",
                         UNICODE_ANYCASE + r"(?=0)\b0\d{1,4}[\s/\-]?\d{3,}[\s/\-]?\d*", 0.7,
                         context=PHONE_CONTEXT, gate=DIGITS)
FIRMENBUCH = Recognizer("firmenbuch", "AT_FIRMENBUCH_NR",
                        UNICODE_ANYCASE + _first_of("FN") + r"\bFN\s?\d{5,6}\s?[a-z]\b", 0.9,
                        context=FIRM_CONTEXT, gate=DIGITS)
DOC_METADATA = Recognizer("doc_metadata", "DOC_METADATA",
                          UNICODE_ANYCASE + _first_of(DOCUMENT_LABELS) + rf"((?:{DOCUMENT_LABELS})[:\s]+)(.+?)(\n|$)", 0.85,
                          labelled=True, min_chars=2, gate=LABEL, labels=DOCUMENT_LABELS)


def credential_label(anchored: bool = False, more_labels: Iterable[str] = ()) -> Recognizer:
    """Value after a password label.

    Labels also match inside words ("Spin: abcd"); ``anchored`` asks for whole words instead.  Further
    labels, such as ``token``, can be added.
    """
    labels = "|".join([PASSWORD_LABELS, *map(quote, more_labels)])
    border = r"\b" if anchored else ""
    # Further labels may begin with anything.
    first = "" if more_labels else _first_of(PASSWORD_LABELS)
    pattern = rf"""({border}(?:{labels})[\s:=]+["']?)(\S{{4,}})(["']?)"""
    return Recognizer(
        "credential_label", "CREDENTIAL", UNICODE_ANYCASE + first + pattern, 0.9, labelled=True,
        gate=ANY if more_labels else LABEL, labels=PASSWORD_LABELS,
    )


CREDENTIAL_LABEL = credential_label()
CREDENTIAL_STATED = Recognizer(
    "credential_stmt", "CREDENTIAL",
    UNICODE_ANYCASE
    + _first_of("mein|my|unser")
    + rf"""((?:mein|my|unser)\s+(?:{STATED_SECRETS})\s+(?:ist|is|lautet|=)\s+["']?)(\S{{4,}})(["']?)""",
    0.9, labelled=True, gate=LABEL, labels=STATED_SECRETS)
API_KEY = Recognizer(
    "api_key", "CREDENTIAL",
    UNICODE + r"(?=[spaktgxA])\b(?:sk-[a-zA-Z0-9_-]{20,}|pk_[a-zA-Z0-9_-]{20,}|api[_-][a-zA-Z0-9_-]{20,}|"
    r"key[_-][a-zA-Z0-9_-]{20,}|token[_-][a-zA-Z0-9_-]{20,}|ghp_[a-zA-Z0-9]{36,}|"
    r"gho_[a-zA-Z0-9]{36,}|glpat-[a-zA-Z0-9_-]{20,}|xox[bpsa]-[a-zA-Z0-9-]{10,}|AKIA[A-Z0-9]{16})\b",
    0.95)
BEARER = Recognizer(
    "bearer", "CREDENTIAL",
    UNICODE + r"(Bearer\s+)(eyJ[a-zA-Z0-9_-]{20,}\.eyJ[a-zA-Z0-9_-]{20,}\.[a-zA-Z0-9_-]{20,})()", 0.95,
    labelled=True, needs="Bearer")
CONN_STRING = Recognizer(
    "conn_string", "CREDENTIAL",
    UNICODE_ANYCASE + _first_of("postgres|mysql|mongodb|redis|amqp|sqlite") + r"(?:postgres(?:ql)?|mysql|mongodb|redis|amqp|sqlite)://\S{10,}", 0.95,
    needs="://")
PRIVATE_KEY = Recognizer(
    "private_key", "CREDENTIAL",
    UNICODE + r"-----BEGIN\s+(?:RSA\s+)?(?:PRIVATE|EC)\s+KEY-----[\s\S]{20,}?"
    r"-----END\s+(?:RSA\s+)?(?:PRIVATE|EC)\s+KEY-----", 0.95, needs="-----BEGIN")


def _eu(name: str, pattern: str, score: float) -> Recognizer:
    gate = {"ipv4": DIGIT, "plate_at": DIGIT, "plate_de": DIGIT, "ipv6": ANY}.get(name, DIGITS)
    needs = {"ipv4": ".", "ipv6": ":"}.get(name)
    return Recognizer(name, "EU_PII", UNICODE_ANYCASE + pattern, score, context=EU_CONTEXT, gate=gate, needs=needs)


IPV4 = _eu("ipv4", r"(?=\d)\b(?:\d{1,3}\.){3}\d{1,3}\b", 0.6)
IPV6 = _eu("ipv6", r"(?=(?-i:[0-9a-fA-F]{1,4}+:))\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b", 0.8)
EU_IBAN = _eu("eu_iban", r"(?=..\d)\b[A-Z]{2}\d{2}\s?\d{4}\s?\d{4}\s?\d{4}\s?\d{4}\s?[\d\s]{0,10}\b", 0.85)
VISA = _eu("visa", r"(?=4)\b4\d{3}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b", 0.8)
MASTERCARD = _eu("mastercard", r"(?=5)\b5[1-5]\d{2}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b", 0.8)
AMEX = _eu("amex", r"(?=3)\b3[47]\d{2}[\s-]?\d{6}[\s-]?\d{5}\b", 0.8)
DATE_DE = _eu("date_de", r"(?=[0-3])\b(?:0[1-9]|[12]\d|3[01])\.(?:0[1-9]|1[0-2])\.\d{4}\b", 0.65)
DATE_ISO = _eu("date_iso", r"(?=\d)\b\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])\b", 0.65)
PLATE_AT = _eu("plate_at", r"\b(?=\D{1,3}+\d)[A-Z]{1,2}\s?\d{1,5}\s?[A-Z]{1,3}\b", 0.4)
PLATE_DE = _eu("plate_de", r"\b(?=\D{2,7}+\d)[A-ZÄÖÜ]{1,3}\s?[A-Z]{1,2}\s?\d{1,4}[EH]?\b", 0.4)
TAX_DE = _eu("tax_de", r"(?=\d)\b\d{2,3}/?\.?\d{3,4}/?\.?\d{4,5}\b", 0.3)
PASSPORT_AT = _eu("passport_at", r"(?=.\d)\b[A-Z]\d{7}\b", 0.4)

HEALTH = Recognizer("health", "SENSITIVE_DATA", _stated(HEALTH_LABELS, r"\w\s\-.", 3, 60), 0.85,
                    labelled=True, min_chars=3, gate=LABEL, labels=HEALTH_LABELS)
RELIGION = Recognizer("religion", "SENSITIVE_DATA", _stated(RELIGION_LABELS, r"\w\s\-", 2, 30), 0.85,
                      labelled=True, min_chars=3, gate=LABEL, labels=RELIGION_LABELS)
POLITICS = Recognizer("politics", "SENSITIVE_DATA", _stated(POLITICS_LABELS, r"\w\s\-", 2, 40), 0.85,
                      labelled=True, min_chars=3, gate=LABEL, labels=POLITICS_LABELS)
ETHNICITY = Recognizer("ethnicity", "SENSITIVE_DATA", _stated(ETHNICITY_LABELS, r"\w\s\-", 2, 30), 0.85,
                       labelled=True, min_chars=3, gate=LABEL, labels=ETHNICITY_LABELS)
UNION = Recognizer("union", "SENSITIVE_DATA", _stated(UNION_LABELS, r"\w\s\-", 2, 40), 0.85,
                   labelled=True, min_chars=3, gate=LABEL, labels=UNION_LABELS)

EMAIL = Recognizer("email", "EMAIL_ADDRESS",
                   # Starts only where a run of name characters starts (or a match has ended); at most 127 labels.
                   UNICODE + r"(?:\G|(?<![\w.+%-]))[\w.+%-]++@[\w-]++(?:\.[\w-]++){0,125}\.[A-Za-z]{2,}", 1.0, needs="@")
IBAN_ANY = Recognizer("iban_any", "IBAN_CODE", UNICODE_ANYCASE + r"(?=..\d)\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}"
                      r"(?: ?[A-Z0-9]{1,3})?\b", 1.0, gate=DIGITS, check="iban")
CARD_ANY = Recognizer("card_any", "CREDIT_CARD",
                      UNICODE + r"(?=[3-6])\b(?:4\d{3}|5[1-5]\d{2}|6\d{3}|3\d{3})[- ]?\d{3,4}[- ]?\d{3,4}[- ]?\d{3,5}\b",
                      1.0, gate=DIGITS, check="luhn")
# A first name followed by another capitalised word, and one that is not.
NAME_FOLLOWED = Recognizer("first_name_followed", "PERSON", _name_pattern(FIRST_NAMES, "="), 0.8, gate=NAME)
NAME_ALONE = Recognizer("first_name", "PERSON", _name_pattern(FIRST_NAMES, "!"), 0.65, gate=NAME,
                        check="name_context")

SENSITIVE = (HEALTH, RELIGION, POLITICS, ETHNICITY, UNION)
EU = (IPV4, IPV6, EU_IBAN, VISA, MASTERCARD, AMEX, DATE_DE, DATE_ISO, PLATE_AT, PLATE_DE, TAX_DE, PASSPORT_AT)
REGISTRY: tuple[Recognizer, ...] = (
    AT_UID, AT_IBAN, AT_SVNR, PHONE_INTL, PHONE_LOCAL, FIRMENBUCH, DOC_METADATA,
    CREDENTIAL_LABEL, CREDENTIAL_STATED, API_KEY, BEARER, CONN_STRING, PRIVATE_KEY,
    *EU, *SENSITIVE, NAME_FOLLOWED, NAME_ALONE, EMAIL, IBAN_ANY, CARD_ANY,
)

def _label_gate(registry: Sequence[Recognizer]) -> Callable[[Column], Column]:
    """Whether a text can hold a label of any recognizer behind the label gate.

    One pattern of all label letters in either case.  A look at classes of the next letters goes first, so its many branches
    are tried at few characters.
    """
    stems = sorted({stem for rec in registry if rec.gate == LABEL for stem in _stems(rec.labels)})
    long = [s for s in stems if len(s) > SHORT_LABEL and not any(len(t) > SHORT_LABEL and t in s and t != s for t in stems)]
    short = [s for s in stems if len(s) <= SHORT_LABEL]

    def pattern(words: list[str], end: str = "") -> str:
        ahead = "".join(_either({w[i] for w in words}) for i in range(min(map(len, words))))
        return f"(?={ahead})" + word_tree(words, _either) + end

    parts = [pattern(long)] if long else []
    if short:
        parts.append(pattern(short, r"[\s\x1c-\x1f\x85\p{Z}:=]"))
    return lambda text: text.rlike("|".join(parts))


GATES = {
    DIGIT: lambda text: text.rlike(r"\p{Nd}"),
    DIGITS: lambda text: text.rlike(r"\p{Nd}{3}"),
    NAME: lambda text: text.rlike("(?U)" + _first_names(FIRST_NAMES)),
}
BOOST, BOOST_FLOOR, BOOST_WORDS = 0.35, 0.4, 5


def iban_valid(code: Column) -> Column:
    """Remainder rule of bank account numbers: the rearranged digits leave 1 when divided by 97."""
    bare = F.upper(F.regexp_replace(code, r"(?U)\s", ""))
    turned = F.concat(F.substring(bare, F.lit(5), F.length(bare)), F.substring(bare, 1, 4))

    def step(acc: Column, char: Column) -> Column:
        digit = F.ascii(char) - F.when(char.between("0", "9"), F.lit(48)).otherwise(F.lit(55))
        return F.when(digit > 9, (acc * 100 + digit) % 97).otherwise((acc * 10 + digit) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


def card_valid(number: Column) -> Column:
    return F.call_function("luhn_check", F.regexp_replace(number, r"(?U)[\s-]", ""))


# Five words up to the end behind white space.
ENOUGH = rf"(?U)\s\S++(?:\s++\S++){{{BOOST_WORDS - 1}}}\s*+\z"


def _context_before(body: Column, at: Column, holds: Callable[[Column], Column]) -> Column:
    """Whether the last five white-space words before an offset hold a context word; ``body`` is in blocks.

    A window of 64 characters mostly tells; otherwise a wider one or the whole beginning is asked.
    """

    def window(sizes: tuple[int, ...]) -> Column:
        begin = F.greatest(at - sizes[0], F.lit(0)) if sizes else F.lit(0)
        piece = F.lower(cut_blocks(body, begin, at))
        if not sizes:
            return holds(piece)
        return let(
            piece,
            lambda p: F.when(holds(p), F.lit(True)).when((at <= sizes[0]) | p.rlike(ENOUGH), F.lit(False)).otherwise(window(sizes[1:])),
        )

    return window((64, 160, 8192))


def _context_pattern(rec: Recognizer) -> str:
    words = [w.lower() for w in rec.context]
    first = "".join(sorted({quote(w[0]) for w in words}))
    # The shorter of two that begin alike will do.
    return f"(?=[{first}])" + word_tree([w for w in words if not any(w != v and w.startswith(v) for v in words)], quote)


def _described(rec: Recognizer, parts: Column, boost: bool) -> Column:
    """A recognizer's facts beside the parts it cut its text into."""
    boosted = boost and bool(rec.context)
    text = lambda value: F.lit(value).cast("string")
    return F.struct(
        text(rec.name).alias("name"), text(rec.entity_type).alias("entity_type"), F.lit(float(rec.score)).alias("score"),
        F.lit(rec.labelled).alias("labelled"), F.lit(rec.min_chars if rec.labelled else 0).alias("min_chars"),
        text(rec.check).alias("check"),
        text(_context_pattern(rec) if boosted else None).alias("context"),
        F.lit(round(min(1.0, max(rec.score + BOOST, BOOST_FLOOR)), 6)).alias("better"), parts.alias("parts"),
    )


def _holds_context(body: Column, context: Column, patterns: Sequence[str], last: bool = False) -> Column:
    """Whether a text, or its ``last`` five words, holds a word of ``context``, one of ``patterns``.

    As constants the patterns are compiled once, not for each span.
    """

    def asked(p: str) -> str:
        return rf"(?U){p}\S*+(?:\s++\S++){{0,{BOOST_WORDS - 1}}}+\s*+\z" if last else p

    return reduce(lambda rest, p: F.when(context == p, F.rlike(body, F.lit(asked(p)))).otherwise(rest), patterns, F.lit(False))


def _spans_of(text: Column, low: Column, hit: Column, contexts: Sequence[str]) -> Column:
    """The spans of one recognizer's parts, with its checks and score changes; ``contexts`` are the patterns it may name."""
    found = sp.spans_of_parts(
        hit["parts"], hit["entity_type"], hit["score"], hit["name"], hit["labelled"], hit["min_chars"]
    )
    words = UNICODE_ANYCASE + f"(?:{NAME_CONTEXT})"

    def near_name(body: Column, s: Column) -> Column:
        before = cut_blocks(body, F.greatest(s["start"] - 30, F.lit(0)), s["start"])
        return sp.changed(s, score=F.when(before.rlike(words), F.lit(0.85)).otherwise(s["score"]))

    def near_context(body: Column, s: Column) -> Column:
        higher = _context_before(body, s["start"], lambda piece: _holds_context(piece, hit["context"], contexts, last=True))
        return sp.changed(s, score=F.when(higher, hit["better"]).otherwise(s["score"]))

    def checked(f: Column) -> Column:
        return (
            F.when(hit["check"] == "iban", F.filter(f, lambda s: iban_valid(s["text"])))
            .when(hit["check"] == "luhn", F.filter(f, lambda s: card_valid(s["text"])))
            .when(hit["check"] == "name_context", _per_span(text, f, near_name))
            .otherwise(f)
        )

    # A text without any of the words has no context to look at.
    context = hit["context"].isNotNull() & _holds_context(low, hit["context"], contexts)
    return let(
        let(found, checked), lambda f: F.when((F.size(f) > 0) & context, _per_span(text, f, near_context)).otherwise(f)
    )


def _per_span(text: Column, found: Column, change) -> Column:
    """``change(blocks of the text, span)`` of each span."""
    return let(blocks(text), lambda body: F.transform(found, lambda s: change(body, s)))


def _find_all(text: Column, parts: Sequence[Column], contexts: Sequence[str]) -> Column:
    """Spans of all recognizers: what is done with their parts stands once in the plan, not once for each."""
    hits = F.filter(F.array(*parts), lambda r: F.size(r["parts"]) > 0)
    spans = let(
        F.struct(hits.alias("hits"), F.lower(text).alias("low")),
        lambda w: F.flatten(F.transform(w["hits"], lambda hit: _spans_of(text, w["low"], hit, contexts))),
    )
    return let(F.coalesce(spans, sp.no_spans()), lambda found: sp.own_texts(text, found))


def _contexts(registry: Sequence[Recognizer], boost: bool) -> list[str]:
    return list(dict.fromkeys(_context_pattern(r) for r in registry if boost and r.context))


def find(text: Column, rec: Recognizer, *, boost: bool = False) -> Column:
    """Spans of one recognizer."""
    parts = _described(rec, sp.match_parts(sp.searched(text), rec.pattern, rec.labelled), boost)
    return _find_all(text, [parts], _contexts([rec], boost))


def term_pattern(terms: Sequence[str]) -> str:
    """Whole-term alternation in the given order, any case."""
    body = "|".join(quote(t) for t in terms)
    return UNICODE_ANYCASE + rf"(?<!\w)(?:{body})(?!\w)"


def find_terms(text: Column, terms: Sequence[str]) -> Column:
    """Deny-list terms as CUSTOM spans of score 1."""
    if not terms:
        return sp.no_spans()
    return sp.scan(text, term_pattern(terms), "CUSTOM", 1.0, "deny_list")


_BUILT: dict = {}


def built(key: tuple, build) -> Column:
    """Build a large expression once per application; the driver spends seconds on it otherwise."""
    app = SparkContext._active_spark_context.applicationId
    if _BUILT.get("app") != app:
        _BUILT.clear()
        _BUILT["app"] = app
    if key not in _BUILT:
        _BUILT[key] = build()
    return _BUILT[key]


def found_spans(
    text: Column | str,
    *,
    registry: Sequence[Recognizer] = REGISTRY,
    deny_terms: Sequence[str] = (),
    boost: bool = True,
    extra: Column | None = None,
) -> Column:
    """The raw, unfiltered spans of all recognizers, the deny list and an ``extra`` span column.

    A deny list of many hundred terms is found faster with ``terms.join_terms``; pass its spans, which are the same, as
    ``extra``.
    """
    if isinstance(text, str):
        key = ("found", text, tuple(registry), tuple(deny_terms), boost)
        patterns = built(
            key, lambda: found_spans(F.col(text), registry=registry, deny_terms=deny_terms, boost=boost)
        )
        if extra is None:
            return patterns
        return F.concat(patterns, F.coalesce(extra.cast(sp.SPANS_TYPE), sp.no_spans()))
    wanted = {r.gate for r in registry} - {ANY}
    tests = {**GATES, LABEL: _label_gate(registry)}
    gates = {g: F.coalesce(test(text), F.lit(False)).alias(g) for g, test in tests.items() if g in wanted}

    def all_found(gate: Column) -> Column:
        parts = []
        for rec in registry:
            cut_up = sp.match_parts(gate["body"], rec.pattern, rec.labelled)
            if rec.needs is not None:
                cut_up = F.when(gate["body"].contains(rec.needs), cut_up)
            if rec.gate != ANY:
                cut_up = F.when(gate[rec.gate], cut_up)
            parts.append(_described(rec, F.coalesce(cut_up, F.array().cast("array<string>")), boost))
        found = [_find_all(text, parts, _contexts(registry, boost))] if parts else [sp.no_spans()]
        if deny_terms:
            found.append(F.coalesce(find_terms(text, list(deny_terms)), sp.no_spans()))
        if extra is not None:
            found.append(F.coalesce(extra.cast(sp.SPANS_TYPE), sp.no_spans()))
        return F.concat(*found)

    # Bound once per row: the optimizer cannot copy the gates into each of their uses.
    return let(F.struct(sp.searched(text).alias("body"), *gates.values()), all_found)


def keep_spans(
    found: Column,
    *,
    threshold: float = CONFIDENCE,
    allowed: Sequence[str] | None = None,
    requested: Sequence[str] | Column | None = None,
    locations: bool = False,
    person_filter: bool = True,
) -> Column:
    """Filters between recognizing and resolving; ``locations`` admits places, minus known non-places."""
    kinds = list(allowed if allowed is not None else KEPT_TYPES) + (["LOCATION"] if locations else [])

    def rule(s: Column) -> Column:
        keep = (s["score"] >= threshold) & s["entity_type"].isin(*kinds)
        if requested is not None:
            wanted = requested if isinstance(requested, Column) else literal_array(requested)
            keep = keep & (wanted.isNull() | F.array_contains(wanted, s["entity_type"]))
        if person_filter:
            keep = keep & ~((s["entity_type"] == "PERSON") & fold_key(s["text"]).isin(*PRODUCT_NAMES))
        if locations:
            key = fold_key(s["text"])
            keep = keep & ~((s["entity_type"] == "LOCATION") & (key.isin(*NO_PLACES) | (F.length(key) <= 2)))
        return keep

    return F.filter(found, rule)


def detect(
    df: DataFrame,
    text: str = "text",
    *,
    registry: Sequence[Recognizer] = REGISTRY,
    deny_terms: Sequence[str] = (),
    boost: bool = True,
    extra: Column | None = None,
    into: str = "spans",
    **filters,
) -> DataFrame:
    """Add the detected spans of each text: found, filtered, contained ones removed, by position."""
    found = found_spans(text, registry=registry, deny_terms=deny_terms, boost=boost, extra=extra)
    return df.withColumn(into, sp.clean_spans(keep_spans(found, **filters)))


# Fixed values of a detection in parts: what it looks at in front of a border, and about how long a part is.
TAIL, PART = 256, 1 << 16
# The least number of characters inside a private key.
KEY_CHARS = 20


def border_clear(text: Column) -> Column:
    """Whether no pattern of ``REGISTRY`` can match or look across a line end behind ``text``, from any earlier start.

    The last word ends in four letters and a full stop: nothing that takes white space goes on behind that but numbers of
    the insured after their label, first names (which look at the next word) and private keys. Six words are the context that
    the next spans may ask for. Keys that begin further up are the matter of ``detect_parts``.
    """
    tail = F.right(text, F.lit(TAIL))
    words = F.size(F.split(F.trim(F.regexp_replace(tail, r"(?U)\s+", " ")), " "))
    name = rf"(?U)(?<!\S){word_tree(FIRST_NAMES)}{NAME_TAIL}\z"
    number = UNICODE_ANYCASE + rf"(?:{SVNR_LABELS})[.:\s]*\z"
    clear = tail.rlike(r"\p{L}{4}\.\z") & (words > BOOST_WORDS) & ~tail.rlike(name) & ~tail.rlike(number)
    return F.coalesce(clear & ~tail.contains("-----BEGIN"), F.lit(False))


def detect_parts(
    df: DataFrame, key: str = "doc_id", order: str = "at", text: str = "text", part_size: int = PART, into: str = "spans"
) -> DataFrame:
    """Detect in texts of any length, each given as pieces (key, order, text) to be joined by line ends.

    Gives (key, part, offset, text, spans): the text in parts of about ``part_size`` characters and the finds of ``detect`` in
    the whole text, each in the part where it begins, with places inside that part; ``offset`` is the part's place in the
    text.  A part only ends where no pattern can look across, so pieces without such an end stay together.  Only lengths and
    the ends of pieces go through a window over a text; its rows are never in one task.
    """
    body = F.col(text)
    # Pieces of one place come in the order of their texts; only those carry their text along.
    twins = F.count(F.lit(1)).over(W.partitionBy(key, order))
    pieces = df.select(F.col(key).alias("key"), F.col(order).alias("at"), body.alias("text"), F.when(twins > 1, body).alias("twin"))
    pieces = stage(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    body = F.col("text")
    unclosed = F.regexp_replace(body, PRIVATE_KEY.pattern, "").contains("-----BEGIN")
    facts = pieces.select(
        "key", "at", "twin", "row", (F.length(body) + 1).cast("long").alias("size"), border_clear(body).alias("clear"),
        F.when(border_clear(body), F.right(body, F.lit(TAIL))).alias("tail"), F.coalesce(unclosed, F.lit(False)).alias("open"),
        F.coalesce(body.contains("-----END"), F.lit(False)).alias("end"),
        F.coalesce(F.substring(body, KEY_CHARS + 1, 2**31 - 1).contains("-----END"), F.lit(False)).alias("closes"),
    )
    whole = W.partitionBy("key")
    along = whole.orderBy("at", "twin", "row")
    before = along.rowsBetween(W.unboundedPreceding, -1)
    upto = along.rowsBetween(W.unboundedPreceding, 0)
    facts = facts.withColumns({"n": F.row_number().over(along), "offset": F.coalesce(F.sum("size").over(before), F.lit(0))})
    last = lambda flag, window: F.coalesce(F.max(F.when(F.col(flag), F.col("n"))).over(window), F.lit(0))
    facts = facts.withColumns({"opened": last("open", upto), "closed": last("closes", upto), "ends": last("end", whole)})
    # A key may go on behind this piece: it was opened, not surely closed since, and there is an end further down.
    pending = (F.col("opened") > 0) & (F.col("closed") <= F.col("opened")) & (F.col("ends") > F.col("n"))
    facts = facts.withColumn("block", F.floor(F.col("offset") / part_size))
    facts = facts.withColumn("clear", F.col("clear") & ~pending & (F.col("block") > 0))
    # The first clear border of each stretch of that many characters, but for the first stretch.
    cuts = F.sum(F.col("clear").cast("int")).over(W.partitionBy("key", "block").orderBy("n").rowsBetween(W.unboundedPreceding, 0))
    facts = facts.withColumn("cut", (F.col("clear") & (cuts == 1)).cast("int"))
    ordered = whole.orderBy("n")
    facts = facts.withColumns({
        "part": F.coalesce(F.sum("cut").over(ordered.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
        "halo": F.when(F.lag("cut").over(ordered) == 1, F.lag("tail").over(ordered)),
    })
    placed = facts.select("row", "n", "part", "offset", "halo").join(pieces.select("row", "key", "text"), "row")
    parts = placed.groupBy("key", "part").agg(
        F.sort_array(F.collect_list(F.struct("n", "text"))).alias("lines"), F.min("offset").alias("offset"),
        F.min_by("halo", "n").alias("halo"),
    )
    joined = F.array_join(F.transform("lines", lambda r: r["text"]), "\n")
    front = F.coalesce(F.concat("halo", F.lit("\n")), F.lit(""))
    parts = parts.select("key", "part", "offset", joined.alias("text"), front.alias("front"))
    # Searched with the end of what stands in front, whose own finds are those of the part before.
    found = detect(parts.withColumn("searched", F.concat("front", "text")), "searched")
    ahead = F.length("front")
    own = F.transform(
        F.filter("spans", lambda s: s["start"] >= ahead),
        lambda s: sp.changed(s, start=s["start"] - ahead, end=s["end"] - ahead),
    )
    return found.select(F.col("key").alias(key), "part", "offset", F.col("text").alias(text), own.alias(into))


def attach_annotations(
    df: DataFrame, annotations: DataFrame, key: str = "doc_id", text: str = "text", into: str = "annotations"
) -> DataFrame:
    """Spans from an outside model (key, entity_type, start, end, score) as an array beside their text."""
    per_text = annotations.groupBy(key).agg(
        F.collect_list(F.struct("entity_type", "start", "end", "score")).alias("__a")
    )
    with_text = lambda body: F.transform(
        F.col("__a"),
        lambda a: sp.span(
            a["entity_type"], a["start"], a["end"], a["score"], cut_blocks(body, a["start"], a["end"]),
            F.lit("external"),
        ),
    )

    joined = df.join(per_text, key, "left")
    return joined.withColumn(into, F.coalesce(let(blocks(F.col(text)), with_text), sp.no_spans())).drop("__a")


def model_annotations(
    df: DataFrame, make_model: Callable[[], Callable[[list[str]], list[list[tuple[str, int, int, float]]]]],
    key: str = "doc_id", text: str = "text", batch_size: int = 64,
) -> DataFrame:
    """Annotations (key, entity_type, start, end, score) of an outside model, for ``attach_annotations``.

    ``make_model`` is called once for each task and gives a function from texts to their finds.  Texts go to it in Arrow
    batches, ``batch_size`` at a time; a null text has no finds.
    """
    kind = df.schema[key].dataType.simpleString()

    def annotate(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_model()
        for frame in frames:
            for at in range(0, len(frame), batch_size):
                part = frame.iloc[at : at + batch_size]
                found = model(part[text].tolist())
                rows = [(k, *f) for k, finds in zip(part[key], found, strict=True) for f in finds]
                yield pd.DataFrame(rows, columns=[key, "entity_type", "start", "end", "score"])

    asked = df.select(key, text).where(F.col(text).isNotNull())
    return asked.mapInPandas(annotate, f"`{key}` {kind}, entity_type string, start int, `end` int, score double")
