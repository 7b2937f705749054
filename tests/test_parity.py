"""Every pattern against an independent matcher over random texts, and offsets against slicing."""

import random

import pytest
import regex
from pyspark.sql import functions as F

from hushframe import constants as c
from hushframe.operators import recognizers as rec

PIECES = [
    "ATU12345678", "atu87654321", "AT48 3200 0000 1234 5678", "AT483200000012345678", "DE89370400440532013000",
    "SVNr: ", "Sozialversicherungsnummer ", "1234 010180", "1234010180", "+43 664 123456", "0664/1234567", "FN 123456a",
    "fn12345 b", "Auftraggeber: ", "Kunde:\n", "erstellt  für ", "im Auftrag von ", "Max Gruber", "Anna", "MARIA,", "(Jürgen)",
    "jürgen", "Dr. ", "Frau ", "Passwort: ", "pin = ", "secret\t", "'geheim1'", '"abc"', "mein Passwort ist ", "my key = ",
    "sk-" + "a1" * 12, "ghp_" + "B" * 36, "AKIA" + "Z9" * 8, "Bearer eyJ" + "a" * 24 + ".eyJ" + "b" * 24 + "." + "c" * 24,
    "postgres://user:pw@host/db", "REDIS://1234567890", "-----BEGIN RSA PRIVATE KEY-----", "x" * 25, "-----END RSA PRIVATE KEY-----",
    "192.168.0.1", "1.2.3.4.5", "2001:0db8:85a3:0000:0000:8a2e:0370:7334", "4111 1111 1111 1111", "5555-5555-5555-4444",
    "3782 822463 10005", "24.12.2023", "2023-12-24", "W 12345X", "M AB 1234", "12/345/67890", "P1234567", "Diagnose: ",
    "Migräne mit Aura", "Religion ", "evangelisch", "Partei: ", "Gewerkschaft:\n", "Abstammung: ", "a.b+c@mail.example.org",
    "ü@ß.de", "😀", "ä", "ß", "_", "9", "\n", " ", "  ", ", ", ". ", "; ", "-", " ", " ", "\r", "日本", "٣٤٥", "é", "ſecret: x1234",
]


ODD = ["PİN: 12345", "pın 123456", "DİAGNOSE: Grippe,", "Paſſwort: abcdef", "Thomaſ", "\u212aarl", "\u212aey: ", "TO\u212aEN "]


def make_texts(n, seed, more=()):
    rng = random.Random(seed)
    pieces = [*PIECES, *more]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randrange(1, 14)):
            parts += [rng.choice(pieces), rng.choice(["", " ", " ", "\n", ","])]
        out.append("".join(parts))
    return out


def expected(r, text):
    """Spans by plain matching: Unicode classes, \\n as the only line end."""
    body, _, rest = r.pattern.partition(")")
    flags = regex.V0 | regex.UNICODE | (regex.IGNORECASE if "i" in body else 0)
    out = []
    for m in regex.finditer(rest, text, flags):
        if r.labelled:
            value = m.group(2).strip()
            if len(value) >= r.min_chars:
                out.append((m.start(2), m.start(2) + len(value)))
        else:
            out.append((m.start(), m.end()))
    return out


@pytest.fixture(scope="module")
def cases(spark):
    items = make_texts(400, 7)
    df = spark.createDataFrame(list(enumerate(items)), "doc_id long, text string").repartition(8)
    found = [
        F.transform(rec.find(F.col("text"), r), lambda s: F.struct(s["start"], s["end"], s["text"])).alias(r.name)
        for r in rec.REGISTRY if r.check is None
    ]
    return items, {row["doc_id"]: row for row in df.select("doc_id", *found).collect()}


@pytest.mark.parametrize("r", [r for r in rec.REGISTRY if r.check is None], ids=lambda r: r.name)
def test_pattern(cases, r):
    items, rows = cases
    for i, text in enumerate(items):
        got = [(s["start"], s["end"]) for s in rows[i][r.name]]
        assert got == expected(r, text), repr(text)
        assert all(text[s["start"] : s["end"]] == s["text"] for s in rows[i][r.name])


def test_gates_lose_nothing(spark):
    """All patterns together, behind their gates, find what each finds alone."""
    df = spark.createDataFrame(list(enumerate(make_texts(300, 11, ODD * 4))), "doc_id long, text string").repartition(8)
    alone = F.concat(*[rec.find(F.col("text"), r) for r in rec.REGISTRY])
    gated = rec.found_spans("text", boost=False)
    assert df.where(~gated.eqNullSafe(alone)).count() == 0


def first_names(text):
    """The name rule from one search per word: name, closing punctuation, and what comes next."""
    found = []
    for m in regex.finditer(r"(?<!\S)(\p{Lu}\S*?)([.,;:!?\"'()\[\]{}]*)(?!\S)", text):
        if m[1].lower() not in c.FIRST_NAMES:
            continue
        lead = text[: m.start()][-30:]
        if regex.match(r"\s*\p{Lu}", text, pos=m.end()):
            score = 0.8
        else:
            score = 0.85 if regex.search(f"(?i)(?:{c.NAME_CONTEXT})", lead) else 0.65
        found.append((m.start(1), m.end(1), score))
    return found


def test_first_name_rule(spark):
    items = make_texts(500, 3, ["Thomaſ", "\u212aarl"])
    df = spark.createDataFrame(list(enumerate(items)), "doc_id long, text string").repartition(8)
    names = F.concat(rec.find(F.col("text"), rec.NAME_FOLLOWED), rec.find(F.col("text"), rec.NAME_ALONE))
    for row in df.select("doc_id", names.alias("s")).collect():
        got = sorted((s["start"], s["end"], s["score"]) for s in row["s"])
        assert got == first_names(items[row["doc_id"]]), repr(items[row["doc_id"]])
