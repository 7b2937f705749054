"""Codenames, restoring and marked-up views."""

import random

import pytest

import duckdb  # noqa: F401  (the check queries need it; fail early if it is absent)
from pyspark.sql import functions as F

from hushframe import constants as c
from hushframe.operators import annotate, pseudonym
from hushframe.operators import recognizers as rec
from hushframe.operators import rehydrate as rh
from hushframe.operators import spans as sp


def anonymize(texts, text):
    row = pseudonym.anonymize(rec.detect(texts(text))).first()
    return row["anonymized"], row["mapping"]


def test_persons_get_names_and_numbers_get_brackets(texts):
    text, mapping = anonymize(texts, "Herr Thomas und Frau Maria, UID ATU12345678, thomas heisst Thomas.")
    assert text == "Herr Arion und Frau Brynn, UID [AT_UID_NR_1], thomas heisst Arion."
    assert mapping == {"Arion": "Thomas", "Brynn": "Maria", "[AT_UID_NR_1]": "ATU12345678"}


def test_nothing_to_do(texts):
    assert anonymize(texts, "ganz harmlos") == ("ganz harmlos", {})
    assert anonymize(texts, "") == ("", {})


def test_one_key_one_codename_across_types(spark):
    text = "Nova trifft nova"
    spans = [("ORG", 0, 4, 0.9, "Nova", "t"), ("PERSON", 12, 16, 0.9, "nova", "t")]
    df = spark.createDataFrame([(1, text, spans)], f"doc_id long, text string, spans {sp.SPANS_TYPE}")
    row = pseudonym.anonymize(df).first()
    assert row["anonymized"] == "Nexon Corp trifft Nexon Corp"
    # The last spelling is the one put back.
    assert row["mapping"] == {"Nexon Corp": "nova"}


def test_pool_wraps(spark):
    numbers = spark.range(1, 90).select(
        F.col("id"),
        pseudonym.render(F.lit("PERSON"), F.col("id")).alias("name"),
        pseudonym.render(F.lit("CUSTOM"), F.col("id")).alias("term"),
        pseudonym.render(F.lit("MISC"), F.col("id")).alias("other"),
    )
    rows = {r["id"]: r for r in numbers.collect()}
    assert rows[1]["name"] == "Arion" and rows[40]["name"] == "Neva"
    assert rows[41]["name"] == "Arion-2" and rows[81]["name"] == "Arion-3"
    assert rows[17]["term"] == c.CUSTOM_NAMES[0] + "-2" and rows[5]["other"] == "[MISC_5]"


@pytest.mark.parametrize("far", [1, 99_991])
def test_numbers_over_buckets_equal_one_running_count(spark, far):
    """The two-level count against a plain loop, with one group that holds nearly everything; buckets given and found."""
    rng = random.Random(5)
    rows = [(d * far, rng.randrange(1000), rng.choice(["PERSON"] * 9 + ["CREDENTIAL"]), f"k{rng.randrange(60)}") for d in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, start int, entity_type string, key string")
    book = pseudonym.codebook(df, [], ["doc_id", "start"], F.floor(F.col("doc_id") / 7) if far == 1 else None)
    got = {r["key"]: r["codename"] for r in book.collect()}
    want, counts = {}, {}
    for _, _, kind, key in sorted(rows):
        if key not in want:
            counts[kind] = n = counts.get(kind, 0) + 1
            names = c.PERSON_NAMES
            lap = (n - 1) // len(names)
            want[key] = f"[{kind}_{n}]" if kind != "PERSON" else names[(n - 1) % len(names)] + (f"-{lap + 1}" if lap else "")
    assert got == want


def test_corpus_scope_shares_names(texts):
    df = rec.detect(texts("Herr Thomas kam", "Frau Maria kam", "thomas und Thomas, Maria auch"))
    out, book = pseudonym.anonymize_scoped(df, ["doc_id"], [], ["doc_id"], F.floor(F.col("doc_id") / 2))
    got = [r["anonymized"] for r in out.orderBy("doc_id").collect()]
    assert got == ["Herr Arion kam", "Frau Brynn kam", "thomas und Arion, Brynn auch"]
    assert {r["codename"]: r["original"] for r in book.collect()} == {"Arion": "Thomas", "Brynn": "Maria"}


def restore(spark, text, mapping, fn=rh.rehydrate):
    df = spark.createDataFrame([(text, mapping)], "text string, m map<string,string>")
    return df.select(fn(F.col("text"), F.col("m")).alias("r")).first()["r"]


def test_restoring_tolerates_variants(spark):
    m = {"[PERSON_1]": "Thomas Gruber", "[AT_IBAN_1]": "AT48"}
    assert restore(spark, "Lieber [PERSON_1], [AT_IBAN_1]!", m) == "Lieber Thomas Gruber, AT48!"
    assert restore(spark, "Lieber [person_1]!", m) == "Lieber Thomas Gruber!"
    assert restore(spark, "Lieber PERSON_1!", m) == "LieberThomas Gruber!"
    assert restore(spark, "Lieber [ PERSON_1 ]!", m) == "Lieber Thomas Gruber!"
    assert restore(spark, "Lieber (PERSON_1)!", m) == "Lieber Thomas Gruber!"
    assert restore(spark, "x [Person 1] y", m) == "x Thomas Gruber y"
    assert restore(spark, "[PERSON-1] [PERSON_1]", m) == "[PERSON-1] Thomas Gruber"
    assert restore(spark, "nichts", {}) == "nichts"


def test_longest_codename_first(spark):
    m = {"Arion": "Eins", "Arion-2": "Zwei", "[P_1]": "eins", "[P_10]": "zehn"}
    assert restore(spark, "Arion-2 Arion [P_10] [P_1]", m) == "Zwei Eins zehn eins"


def test_originals_are_literal(spark):
    m = {"Arion": r"a$1\b", "[X_1]": r"\E(.*"}
    assert restore(spark, "arion [x_1]", m) == r"a$1\b \E(.*"


def test_json_leaves(spark):
    shape = "struct<id:int,parts:array<struct<text:string>>>"
    df = spark.createDataFrame(
        [('{"id": 7, "parts": [{"text": "Arion sagt"}, {"text": null}]}', {"Arion": 'Max "M"\n\\'})],
        "body string, m map<string,string>",
    )
    out = df.select(F.from_json(rh.rehydrate_json(F.col("body"), F.col("m")), shape).alias("j")).first()["j"]
    assert out["id"] == 7 and out["parts"][0]["text"] == 'Max "M"\n\\ sagt' and out["parts"][1]["text"] is None


def test_sessions_end(spark):
    vault = spark.createDataFrame([("s", "Arion", "Max")], "session_id string, codename string, original string")
    vault = vault.withColumn("created_at", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    asked = spark.createDataFrame(
        [("s", "Arion", "2024-01-01 00:30:00"), ("s", "Arion", "2024-01-01 00:30:01"), ("t", "Arion", "2024-01-01 00:00:00")],
        "session_id string, text string, at string",
    ).withColumn("asked_at", F.col("at").cast("timestamp"))
    rows = rh.rehydrate_sessions(asked, vault, ["session_id", "at"]).orderBy("session_id", "at").collect()
    assert [(r["status"], r["rehydrated_text"]) for r in rows] == [("ok", "Max"), ("missing", None), ("missing", None)]


def test_marks_and_escapes(texts):
    df = rec.detect(texts('<b> Passwort: "a&b1" </b>'))
    out = df.select(annotate.annotate_html(F.col("text"), F.col("spans")).alias("h")).first()["h"]
    assert out.startswith("&lt;b&gt; Passwort: &quot;<mark ") and 'title="CREDENTIAL (90%)">a&amp;b1&quot;</mark>' in out
    assert texts("a<b").select(annotate.annotate_html(F.col("text"), sp.no_spans()).alias("h")).first()["h"] == "a&lt;b"


def test_dense_long_text_round_trip(spark, texts):
    """A log full of addresses: thousands of spans in one row."""
    lines = [f"Host 10.{i % 256}.{i // 256}.7 von Frau Anna, Passwort: geheim{i}" for i in range(1500)]
    df = pseudonym.anonymize(rec.detect(texts("\n".join(lines))))
    row = df.select(
        F.size("mapping").alias("n"), (rh.rehydrate_exact(F.col("anonymized"), F.col("mapping")) == F.col("text")).alias("same")
    ).first()
    assert row["same"] and row["n"] > 3000


def test_candidates_cover_all_ways_of_matching(spark):
    """Gathering only the possible codenames gives what the whole map gives."""
    rng = random.Random(1)
    book = {f"[{t}_{n}]": f"<{t}{n}>" for t in ("AT_IBAN", "PERSON", "ORG", "ORGANIZATION", "EU_PII") for n in range(1, 130)}
    book |= {f"{n}-{k}" if k > 1 else n: f"<{n}{k}>" for n in c.PERSON_NAMES + c.ORG_NAMES + c.CUSTOM_NAMES for k in range(1, 5)}
    names = list(book)

    def bent(name):
        way = rng.randrange(6)
        return [name, name.lower(), name.strip("[]"), name.replace("[", "( ").replace("]", " )"), name.replace("_", " "),
                name.replace("_", "")][way]

    rows = [(i, "one" if i % 3 else "two", " ".join(bent(rng.choice(names)) + rng.choice([" x", ",", "", "7"]) for _ in range(12))) for i in range(120)]
    asked = spark.createDataFrame(rows, "rid long, session_id string, text string")
    vault = spark.createDataFrame([("one", k, v) for k, v in book.items()], "session_id string, codename string, original string")
    got = rh.attach_mappings(asked, vault, ["rid"]).select("rid", rh.rehydrate(F.col("text"), F.col("mapping")).alias("r"))
    whole = spark.createDataFrame([(book,)], "m map<string,string>")
    want = asked.where("session_id = 'one'").crossJoin(whole).select("rid", rh.rehydrate(F.col("text"), F.col("m")).alias("r"))
    want = want.unionByName(asked.where("session_id = 'two'").select("rid", F.col("text").alias("r")))
    assert {r["rid"]: r["r"] for r in got.collect()} == {r["rid"]: r["r"] for r in want.collect()}
    assert got.where("length(r) > 0").count() == 120


def test_json_keeps_every_field(spark):
    body = '{"b": null, "usage": {"n": 7}, "text": "Arion", "x": [1, 2.50]}'
    df = spark.createDataFrame([(body, {"Arion": 'a"\n'})], "body string, m map<string,string>")
    out = df.select(rh.rehydrate_json(F.col("body"), F.col("m")).alias("j")).first()["j"]
    assert out == body.replace("Arion", 'a\\"\\n')


def test_sessions_with_repeated_rows_and_own_types(spark):
    from datetime import datetime, timedelta

    t = datetime(2024, 5, 1, 12)
    rows = [("s", "[PROJECT_1]", "Silberfuchs"), ("s", "[PROJECT_1]", "Silberfuchs"), ("s", "[DATE_TIME_12]", "morgen")]
    vault = spark.createDataFrame([(*r, t) for r in rows], "session_id string, codename string, original string, created_at timestamp")
    asked = [
        (1, "s", "Projekt [PROJECT_1] ab [ date time 12 ]", t + timedelta(seconds=1800)),
        (2, "s", "project 1", t + timedelta(seconds=1801)),
        (3, "x", "[PROJECT_1]", t),
    ]
    responses = spark.createDataFrame(asked, "id long, session_id string, text string, asked_at timestamp")
    got = {r.id: (r.status, r.rehydrated_text) for r in rh.rehydrate_sessions(responses, vault, ["id"]).collect()}
    assert got == {1: ("ok", "Projekt Silberfuchs ab morgen"), 2: ("missing", None), 3: ("missing", None)}
    assert rh.rehydrate_sessions(responses.limit(0), vault, ["id"]).count() == 0


def test_splice_and_codenames_of_many_spans_are_right(texts):
    """Longer than a block of text and than a part of a walk."""
    from hushframe.operators import pseudonym
    from hushframe.operators import recognizers as rec

    addresses = [f"10.{i % 7}.{i % 250}.{i // 250}" for i in range(900)]
    row = pseudonym.anonymize(rec.detect(texts("😀 " + " ".join(addresses)), registry=(rec.IPV4,))).first()
    numbers: dict = {}
    want = [f"[EU_PII_{numbers.setdefault(a, len(numbers) + 1)}]" for a in addresses]
    assert row["anonymized"] == "😀 " + " ".join(want)
    assert row["mapping"] == {f"[EU_PII_{n}]": a for a, n in numbers.items()}


def test_sessions_with_several_writes(spark):
    """What lives at a question: written up to then, no older than the lifetime; of one codename the last spelling."""
    from datetime import datetime, timedelta

    t = datetime(2024, 5, 1, 23, 50)
    at = lambda minutes: t + timedelta(minutes=minutes)
    rows = [("s", "Arion", "Max", at(0)), ("s", "Brynn", "Eva", at(0)), ("s", "Arion", "MAX", at(20)), ("s", "Arion", "MAX", at(20)), ("s", "Arion", "Max", at(40))]
    vault = spark.createDataFrame(rows, "session_id string, codename string, original string, created_at timestamp")
    asked = [(i, "s", "Arion, Brynn", at(m)) for i, m in enumerate([-1, 0, 10, 20, 30, 35, 45, 70, 71])]
    responses = spark.createDataFrame(asked, "id long, session_id string, text string, asked_at timestamp")
    got = {r.id: (r.status, r.rehydrated_text) for r in rh.rehydrate_sessions(responses, vault, ["id"]).collect()}
    assert got == {
        0: ("missing", None), 1: ("ok", "Max, Eva"), 2: ("ok", "Max, Eva"), 3: ("ok", "MAX, Eva"), 4: ("ok", "MAX, Eva"),
        5: ("ok", "MAX, Brynn"), 6: ("ok", "Max, Brynn"), 7: ("ok", "Max, Brynn"), 8: ("missing", None),
    }
    # What is asked beside does not matter.
    alone = rh.rehydrate_sessions(responses.where("id = 5"), vault, ["id"]).first()
    assert alone["rehydrated_text"] == "MAX, Brynn"


def test_sessions_live_by_their_latest_write(spark):
    from datetime import datetime, timedelta

    from pyspark.sql import functions as F

    from hushframe.sources import vault

    t = datetime(2024, 5, 1, 10)
    rows = [("s", "Arion", "Max", t), ("s", "Arion", "Max", t + timedelta(minutes=20)), ("later", "Arion", "Max", t + timedelta(hours=5))]
    held = spark.createDataFrame(rows, "session_id string, codename string, original string, created_at timestamp")
    for minute, want in ((10, (1, 0)), (40, (1, 0)), (50, (1, 0)), (51, (0, 1))):
        now = F.lit(t + timedelta(minutes=minute))
        assert tuple(vault.session_stats(held, now).first()) == want, minute


def test_vault_repeats_and_forgets(spark, tmp_path):
    from datetime import date, datetime, timedelta

    from hushframe.sources import vault

    path, t = str(tmp_path / "vault"), datetime(2024, 5, 1, 12)
    rows = [(f"s{k}", f"[X_{k}]", f"secret{k}", t + timedelta(hours=8 * k)) for k in range(9)]
    held = spark.createDataFrame(rows, "session_id string, codename string, original string, created_at timestamp")
    for write in ("a", "b", "a"):  # the first one is repeated
        vault.append(held.where("session_id < 's5'" if write == "a" else "session_id >= 's5'"), path, write)
    now, ttl = "2024-05-03 12:00:00", 86_400
    names = lambda: sorted(r.session_id for r in vault.load(spark, path).collect())
    assert names() == [r[0] for r in rows]
    vault.compact(spark, path, date(2024, 5, 2))
    vault.compact(spark, path, date(2024, 5, 2))
    assert names() == [r[0] for r in rows]
    live = [r[0] for r in rows if (datetime(2024, 5, 3, 12) - r[3]).total_seconds() <= ttl]
    vault.sweep(spark, path, now, ttl)
    assert names() == live and vault.days(spark, path) == [date(2024, 5, 2), date(2024, 5, 3), date(2024, 5, 4)]
    vault.sweep(spark, path, now, ttl)  # again, nothing more
    assert names() == live
    assert sorted(r.session_id for r in vault.load_live(spark, path, now, ttl).collect()) == live
    # Nothing of what is gone lies anywhere in the folder.
    kept = b"".join(p.read_bytes() for p in (tmp_path / "vault").rglob("*.parquet"))
    assert b"secret0" not in kept
    vault.append(held.where("session_id = 's0'"), path, "late")
    assert "s0" in names()


def test_large_maps_restore_like_small_ones(spark, monkeypatch):
    """Trying only the entries a text can need gives what trying all gives, also where an original holds a codename."""
    rng = random.Random(6)
    book = {f"[{t}_{n}]": f"<{t} {n}>" for t in ("AT_IBAN", "PERSON", "ORG") for n in range(1, 60)}
    book |= {f"{n}-{k}" if k > 1 else n: f"{n.upper()} Nr. {k}" for n in c.PERSON_NAMES + c.ORG_NAMES for k in range(1, 4)}
    book |= {"[ORG_7]": "Arion und [PERSON_3]", "[PERSON_3]": "person_4 (alt)", "[PERSON_4]": "org 9", "x.y": "Punkt", "a b c": "Satz", "": "leer"}
    del book[""]
    names = list(book)

    def bent(name):
        return [name, name.lower(), name.strip("[]"), name.replace("[", "( ").replace("]", " )"), name.replace("_", " "), name.replace("_", "-")][rng.randrange(6)]

    said = [" ".join(bent(rng.choice(names)) + rng.choice([" x", ",", "", "7"]) for _ in range(10)) for _ in range(80)] + ["[ORG_7]", "", "nichts"]
    df = spark.createDataFrame([(i, t, book) for i, t in enumerate(said)], "id long, text string, m map<string,string>")
    got = {}
    for few in (0, 10**9):
        monkeypatch.setattr(rh, "FEW", few)
        out = df.select("id", rh.rehydrate(F.col("text"), F.col("m")).alias("all"), rh.rehydrate_exact(F.col("text"), F.col("m")).alias("exact"))
        got[few] = {r.id: (r["all"], r["exact"]) for r in out.collect()}
    assert got[0] == got[10**9] and sum(r[0] != t for r, t in zip(got[0].values(), said)) > 70


def test_maps_of_ten_thousand_codenames(spark):
    """Time in proportion to text and map: four times the codenames in clearly less than sixteen times the time."""
    import time

    took = {}
    for n in (2_500, 10_000):
        book = {f"[PERSON_{k}]": f"Name {k}" for k in range(1, n + 1)}
        said = [" ".join(f"[person_{(i * 37 + k * 11) % n + 1}] ja" for k in range(40)) for i in range(16)]
        df = spark.createDataFrame([(i, t, book) for i, t in enumerate(said)], "id long, text string, m map<string,string>").repartition(4).cache()
        df.count()
        out = df.select("id", rh.rehydrate(F.col("text"), F.col("m")).alias("r"))
        out.collect()
        started = time.perf_counter()
        rows = out.collect()
        took[n] = time.perf_counter() - started
        assert all(r["r"] == " ".join(f"Name {(r.id * 37 + k * 11) % n + 1} ja" for k in range(40)) for r in rows)
    assert took[10_000] < 10 * took[2_500] + 1


def test_sql_rewrites_the_spans_it_is_given(spark, texts):
    """With spans, also none at all, nothing is detected again; without it detects."""
    from hushframe.functions import sqlfuncs

    sqlfuncs.register(spark)
    said = "Herr Thomas und Frau Maria, UID ATU12345678."
    rows = texts(said).withColumn("one", F.expr("filter(pii_spans(text), s -> s.entity_type = 'AT_UID_NR')"))
    got = spark.sql(
        """SELECT pii_anonymize(text, one).anonymized AS one, pii_anonymize(text).anonymized AS whole,
          pii_anonymize(text, pii_spans(text)).mapping AS mapping, pii_anonymize(text).mapping AS found,
          pii_anonymize(text, filter(one, s -> false)).anonymized AS none FROM {t}""",
        t=rows,
    ).first()
    assert got["one"] == "Herr Thomas und Frau Maria, UID [AT_UID_NR_1]."
    assert got["whole"] == "Herr Arion und Frau Brynn, UID [AT_UID_NR_1]."
    assert got["mapping"] == got["found"] and len(got["found"]) == 3
    assert got["none"] == said
