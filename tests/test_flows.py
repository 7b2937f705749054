"""Files, chats, sensitivity, admission and streams."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hushframe.operators import admission, chat, sensitivity
from hushframe.plans import fixtures as fx
from hushframe.sources import files, sse, vault
from hushframe.streaming import answers, limits, messages, runs


def test_files_from_a_folder(spark, tmp_path):
    data = {
        "a.txt": "Grüße\nzwei".encode(), "b.CSV": "Grüße".encode("latin-1"), "d.exe": b"x", "e.pdf": b"%PDF",
        "noext": b"x", "long.md": b"y" * 51_000,
    }
    for name, content in data.items():
        (tmp_path / name).write_bytes(content)
    out = files.ingest(files.read_files(spark, str(tmp_path)))
    rows = {r["path"].rsplit("/", 1)[1]: r for r in out.collect()}
    assert {n: r["status"] for n, r in rows.items()} == {
        "a.txt": "ok", "b.CSV": "ok", "d.exe": "unsupported", "e.pdf": "needs_extractor",
        "noext": "unsupported", "long.md": "ok",
    }
    assert (rows["a.txt"]["text"], rows["a.txt"]["encoding"], rows["a.txt"]["line_count"]) == ("Grüße\nzwei", "utf-8", 2)
    assert (rows["b.CSV"]["text"], rows["b.CSV"]["encoding"]) == ("Grüße", "latin-1") and len(rows["b.CSV"]["warnings"]) == 1
    assert len(rows["long.md"]["text"]) == 50_000 and "50,000" in rows["long.md"]["warnings"][0]


def test_file_size_limit(spark):
    df = spark.createDataFrame([("a.txt", 10 * 1024 * 1024), ("b.txt", 10 * 1024 * 1024 + 1), ("c.txt", 0)], "path string, n int")
    df = df.select("path", F.encode(F.repeat(F.lit("x"), F.col("n")), "UTF-8").alias("content"))
    assert [r["status"] for r in files.ingest(df).orderBy("path").collect()] == ["ok", "too_large", "empty"]


@pytest.mark.parametrize(
    "name, mime, kind",
    [("a.PDF", None, "PDF"), ("a.b.docx", None, "DOCX"), ("x.JPEG", None, "IMAGE"), ("x", "text/html", "TEXT"),
     ("x.zip", "application/zip", None), ("x.exe", None, None), ("", "image/png", "IMAGE")],
)
def test_formats(spark, name, mime, kind):
    df = spark.createDataFrame([(name, mime)], "n string, m string")
    assert df.select(files.file_format(F.col("n"), F.col("m")).alias("f")).first()["f"] == kind


def test_vault_prunes_old_days(spark, tmp_path):
    rows = spark.sql(
        "select 's' session_id, 'Arion' codename, 'Max' original, timestamp '2024-01-02 00:10:00' created_at union all "
        "select 't', 'Arion', 'Eva', timestamp '2024-01-01 00:00:00'"
    )
    vault.append(rows, str(tmp_path / "v"))
    live = vault.load_live(spark, str(tmp_path / "v"), "2024-01-02 00:20:00")
    assert [r["original"] for r in live.collect()] == ["Max"]
    assert "PartitionFilters: [isnotnull(day" in live._jdf.queryExecution().toString()


def test_content_blocks_and_hint(spark):
    body = (
        '{"messages":[{"role":"user","content":"eins"},{"role":"assistant","content":"nein"},{"role":"user","content":'
        '[{"type":"text","text":"zwei"},{"type":"image"},{"type":"text","text":" "}]},{"role":"user","content":5}]}'
    )
    df = spark.createDataFrame([(1, body)], "conv_id long, body string")
    rows = [(r["message"], r["block"], r["text"]) for r in chat.content_blocks(df).orderBy("message", "block").collect()]
    assert rows[:2] == [(0, 0, "eins"), (2, 0, "zwei")]
    talk = spark.createDataFrame(
        [(1, 0, "system", "S"), (1, 1, "user", "u"), (2, 0, "user", "v"), (3, 0, "user", "w")],
        "conv_id long, turn long, role string, text string",
    )
    codes = spark.createDataFrame([(1, "[X_1]"), (2, "[X_1]"), (3, "Arion")], "conv_id long, codename string")
    out = {(r["conv_id"], r["turn"]): r["text"] for r in chat.add_system_hint(talk, codes, hint="H").collect()}
    assert out == {(1, 0): "S\n\nH", (1, 1): "u", (2, 0): "v", (2, -1): "H", (3, 0): "w"}


def test_event_lines(spark):
    df = spark.createDataFrame(
        [(0, 'data: {"choices":[{"delta":{"content":"ä"}}]}'), (1, "data: [DONE]"), (2, "data: {oops"), (3, ": ping"),
         (4, 'data: {"type":"content_block_delta","delta":{"type":"text_delta","text":"b"}}'), (5, 'data: {"type":"x"}')],
        "i int, line string",
    )
    assert [(r["kind"], r["delta"]) for r in sse.parse(df).orderBy("i").collect()] == [
        ("delta", "ä"), ("done", None), ("bad", None), ("other", None), ("delta", "b"), ("event", None),
    ]


def test_chunks(spark):
    long = " ".join(f"Satz Nummer {i} ist hier." for i in range(20))
    df = spark.createDataFrame([(f" a \n\n{long}\n" + "x" * 300,), (" ",)], "text string")
    first, blank = [r["c"] for r in df.select(sensitivity.chunks(F.col("text")).alias("c")).collect()]
    assert first[0] == "a" and first[-1] == "x" * 300 and " ".join(first[1:-1]) == long
    assert all(len(p) <= 200 for p in first[:-1]) and blank == [" "]


def test_risk_levels(spark):
    df = spark.createDataFrame([(0.0, 0), (0.55, 1), (0.6, 1), (0.55, 2), (0.7, 1), (0.5, 4)], "top double, n int")
    got = [r["l"] for r in df.select(sensitivity.risk(F.col("top"), F.col("n")).alias("l")).collect()]
    assert got == ["low", "low", "medium", "medium", "high", "high"]


def test_report_of_single_texts(texts):
    rows = sensitivity.report(texts("Das ist vertraulich.", "alles gut", " ", None)).orderBy("doc_id").collect()
    assert [r["risk_level"] for r in rows] == ["high", "low", "low", "low"]
    assert rows[0]["summary"].startswith("Vertraulicher Inhalt erkannt (Zugangsdaten")
    assert rows[1]["summary"] == "Keine sensiblen Inhalte erkannt." and rows[2]["summary"].startswith("Kein Text")


# ------------------------------------------------------------------ admission


def simulate(rows, key_limit, day_limit, gap):
    """The rule, request by request."""
    out, last, used, total, day = {}, {}, {}, 0, None
    for us, rid, key in sorted(rows):
        if us // 86_400_000_000 != day:
            day, last, used, total = us // 86_400_000_000, {}, {}, 0
        if key in last and us - last[key] < gap * 1_000_000:
            out[rid] = "delay"
        elif total >= day_limit:
            out[rid] = "global"
        elif used.get(key, 0) >= key_limit:
            out[rid] = "key"
        else:
            out[rid], last[key], total = "", us, total + 1
            used[key] = used.get(key, 0) + 1
    return out


def requests(rng, n, keys, span):
    """Two days; key 0 makes a third of all requests."""
    return [
        (rng.randrange(2) * 86_400_000_000 + rng.randrange(span) * 100_000, i, 0 if rng.random() < 0.33 else rng.randrange(keys))
        for i in range(n)
    ]


def as_frame(spark, rows):
    df = spark.createDataFrame(rows, "us long, id long, key long")
    return df.select(F.timestamp_micros("us").alias("ts"), "id", "key")


@pytest.mark.parametrize("seed, keys, span, limit", [(1, 5, 300, (3, 12)), (2, 40, 80, (2, 50)), (3, 3, 2000, (20, 45)), (4, 8, 40, (20, 200))])
def test_admission_equals_simulation(spark, seed, keys, span, limit):
    rows = requests(random.Random(seed), 600, keys, span)
    done = admission.rate_limit(as_frame(spark, rows), "key", "ts", "id", key_limit=limit[0], day_limit=limit[1])
    assert {r["id"]: r["reason"] for r in done.collect()} == simulate(rows, *limit, 1.0)


def test_admission_stream_in_batches(spark, tmp_path):
    rows = sorted(requests(random.Random(9), 500, 6, 400))
    folder = str(tmp_path / "in")
    limiter = limits.StreamLimiter(spark, "bigint", "key", "ts", "id", key_limit=4, day_limit=20)
    for at in range(0, 500, 125):
        as_frame(spark, rows[at : at + 125]).coalesce(1).write.mode("append").parquet(folder)
        limiter(as_frame(spark, rows[at : at + 125]), at // 125)
    # A repeated batch replaces its own output.
    limiter(as_frame(spark, rows[375:]), 3)
    got = spark.read.parquet(limiter.decisions)
    assert got.count() == 500
    assert {r["id"]: r["reason"] for r in got.collect()} == simulate(rows, 4, 20, 1.0)


# ------------------------------------------------------------------ streams

CODES = {"Arion": "Thomas", "Arion-2": "Maria", "[P_1]": "eins", "[P_10]": "zehn", "Ar": "kurz"}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["Ar", "ion", "-", "2", "[P_", "1", "0", "]", " ", "x", "Arion-"]), max_size=20), st.data())
def test_stream_text_does_not_depend_on_cuts(parts, data):
    text = "".join(parts)
    cuts = sorted(data.draw(st.lists(st.integers(0, len(text)), max_size=8)))
    codes, out, rest = answers.Codes(CODES), [], ""
    for a, b in zip([0, *cuts], [*cuts, len(text)]):
        settled, rest = codes.advance(rest + text[a:b], False)
        out.append(settled)
    out.append(codes.advance(rest, True)[0])
    names = sorted(CODES, key=len, reverse=True)
    assert "".join(out) == re.sub("|".join(map(re.escape, names)), lambda m: CODES[m.group()], text)


def test_stream_pieces_over_batches(spark, tmp_path):
    """Pieces arrive in several batches and out of order; a repeated piece counts once."""
    text = "Hi Arion-2, [P_10] und Arion"
    pieces = [(i, text[i * 3 : i * 3 + 3]) for i in range(0, 10)]
    schema = "stream_id string, seq long, kind string, delta string, line string, shape string, mapping string"
    import json

    rows = [("s", i, "delta", t, None, "choices", json.dumps(CODES) if i == 0 else None) for i, t in pieces]
    rows += [("s", 10, "end", "", None, "choices", None), rows[4]]
    folder = str(tmp_path / "in")
    random.Random(3).shuffle(rows)
    for at in range(0, len(rows), 4):
        spark.createDataFrame(rows[at : at + 4], schema).coalesce(1).write.mode("append").parquet(folder)
    out = answers.rehydrate_stream(runs.read_stream(spark, folder, schema, per_trigger=1))
    got = runs.drain(out, "pieces").orderBy("seq", "part").collect()
    assert "".join(r["text"] for r in got) == "Hi Maria, zehn und Thomas"


def test_message_stream_keeps_names_between_batches(spark):
    shape = "conv_id long, turn long, role string, text string"
    handler = messages.StreamAnonymizer(spark)
    handler(spark.createDataFrame([(1, 0, "user", "Herr Thomas kam"), (2, 0, "user", "Frau Maria kam")], shape), 0)
    handler(spark.createDataFrame([(1, 1, "user", "Frau Maria und Thomas"), (1, 2, "assistant", "Thomas")], shape), 1)
    handler.rewrite()
    rows = spark.read.parquet(handler.texts).orderBy("conv_id", "turn").collect()
    assert [r["text"] for r in rows] == ["Herr Arion kam", "Frau Brynn und Arion", "Thomas", "Frau Arion kam"]
    # A repeated batch changes nothing; a later one still counts on.
    handler(spark.createDataFrame([(1, 1, "user", "Frau Maria und Thomas"), (1, 2, "assistant", "Thomas")], shape), 1)
    handler(spark.createDataFrame([(1, 3, "user", "mit THOMAS und Anna")], shape), 2)
    handler.rewrite()
    assert spark.read.parquet(handler.texts).count() == 5
    rows = spark.read.parquet(handler.texts).where("turn = 3").collect()
    assert [r["text"] for r in rows] == ["mit Arion und Cael"]
    assert {(r["conv_id"], r["codename"]): r["original"] for r in handler.mappings(spark).collect()} == {
        (1, "Arion"): "THOMAS", (1, "Brynn"): "Maria", (1, "Cael"): "Anna", (2, "Arion"): "Maria",
    }


def test_message_stream_of_many_batches_and_a_hot_conversation(spark):
    """The result of one batch over all; a batch takes in no more than its own identifiers, however many came before."""
    from hushframe.operators import chat

    shape = "conv_id long, turn long, role string, text string"
    people = ["Thomas", "Maria", "Anna", "Stefan", "Markus", "Karl", "Eva", "Julia"]
    said, rng = [], random.Random(4)
    for turn in range(48):
        conv = 5 if turn % 3 else turn  # two thirds of all messages are of one conversation
        a, b = rng.choice(people[: 2 + turn // 8]), rng.choice(people)
        said.append((conv, turn, "user" if turn % 7 else "assistant", f"Herr {a} und Frau {b}, IP 10.0.{turn % 5}.7, Mail m{turn}@x.at"))
    said.append((6, 100, "user", "nichts"))
    want, _ = chat.anonymize_chat(spark.createDataFrame(said, shape))
    want = sorted((r.conv_id, r.turn, r.anonymized) for r in want.collect())
    handler, taken = messages.StreamAnonymizer(spark), []
    for k in range(4):
        handler(spark.createDataFrame(said[12 * k : 12 * k + 12], shape), k)
        if k != 1:  # two batches at once the second time
            taken.append(sum(p["numInputRows"] for p in handler.rewrite()))
    handler(spark.createDataFrame(said[48:], shape), 4)  # a batch without identifiers
    assert sum(p["numInputRows"] for p in handler.rewrite()) == 1
    got = spark.read.parquet(handler.texts)
    assert sorted((r.conv_id, r.turn, r.text) for r in got.collect()) == want
    own = [spark.read.parquet(f"{handler.firsts}/id={k}").count() for k in range(4)]
    assert taken == [own[0], own[1] + own[2], own[3]]


def test_silent_stream_is_flushed(spark, tmp_path):
    """A stream without an end row gives its held-back text after a silence."""
    import time

    schema = "stream_id string, seq long, kind string, delta string, line string, shape string, mapping string"
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")

    def put(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(folder)

    put(("s", 0, "delta", "Hi Ar", None, "choices", '{"Arion": "Max", "Ar": "kurz"}'))
    pieces = answers.rehydrate_stream(runs.read_stream(spark, folder, schema), idle_ms=500)
    query = pieces.writeStream.format("parquet").option("path", out).option(
        "checkpointLocation", str(tmp_path / "c")).trigger(processingTime="200 milliseconds").start()
    try:
        got, until = [], time.time() + 60
        while len(got) < 2 and time.time() < until:
            time.sleep(0.5)
            got = spark.read.schema(answers.OUTPUT).parquet(out).orderBy("seq", "part").collect() if query.lastProgress else []
    finally:
        query.stop()
    assert [r["text"] for r in got] == ["Hi ", "kurz"]


def test_pieces_after_a_silence_are_restored():
    """A flushed stream keeps its map and number, until its state goes for good."""
    from types import SimpleNamespace

    class Value(dict):
        exists = lambda self: "v" in self
        get = lambda self: self["v"]
        update = lambda self, v: self.__setitem__("v", v)

    class Map(dict):
        containsKey = lambda self, k: k in self
        getValue = lambda self, k: self[k]
        updateValue = lambda self, k, v: self.__setitem__(k, v)
        removeKey = lambda self, k: self.pop(k)
        iterator = lambda self: list(self.items())

    timers, value, early = [], Value(), Map()
    handle = SimpleNamespace(
        getValueState=lambda *a: value, getMapState=lambda *a: early, listTimers=lambda: list(timers), deleteTimer=timers.remove, registerTimer=timers.append)
    at = SimpleNamespace(getCurrentProcessingTimeInMs=lambda: 1000)
    processor = answers.AnswerProcessor(500, 9000)
    processor.init(handle)
    columns = ["seq", "kind", "delta", "line", "shape", "mapping"]

    def put(*rows):
        import pandas as pd

        frames = processor.handleInputRows(("s",), iter([pd.DataFrame([(*r, None, "choices", m) for *r, m in rows], columns=columns)]), at)
        return "".join(t or "" for f in frames for t in f["text"])

    def silence():
        timers.clear()
        return "".join(t or "" for f in processor.handleExpiredTimer(("s",), at, None) for t in f["text"])

    assert put((0, "delta", "Hallo Ari", '{"Arion": "Max"}')) == "Hallo " and timers == [1500]
    assert silence() == "Ari" and timers == [10000]
    assert put((1, "delta", "Arion!", None)) == "Max!" and timers == [1500]
    assert put((4, "delta", "vier Arion", None), (3, "delta", "drei ", None)) == "" and len(early) == 2
    assert put((2, "delta", "zwei ", None)) == "zwei drei vier Max" and not early
    assert silence() == "" and value["v"][-1]
    assert put((8, "delta", "Arion,", None), (9, "end", "", None)) == "Max," and not value and not early and not timers
    assert put((0, "delta", "x Ari", '{"Arion": "Max"}')) == "x " and silence() == "Ari" and silence() == "" and not value


def test_report_from_texts_alone(texts):
    df = texts("Diagnose und Befund, Therapie, Medikation, Patientenakte, Krankengeschichte", "ganz anderes")
    rows = sensitivity.analyze(df).orderBy("doc_id").collect()
    assert [f["category"] for f in rows[0]["flags"]] == ["MEDICAL"] and rows[0]["risk_level"] == "high"
    assert rows[1]["flags"] == []


def test_outside_encoder(texts):
    def make():
        import numpy as np

        return lambda batch: np.array([[float("Vertrag" in str(t)), 1.0 - float("Vertrag" in str(t))] for t in batch], dtype="float32")

    df = texts("Vertrag eins", "nichts")
    rows = sensitivity.analyze(df, encode=sensitivity.model_encoder(make)).orderBy("doc_id").collect()
    assert [f["category"] for f in rows[0]["flags"]] == ["LEGAL"] and len(rows[1]["flags"]) == 6


def test_too_many_categories_are_refused(spark):
    df = spark.range(1200).select(F.col("id").cast("string").alias("category"), F.array(F.lit(1.0)).alias("vector"))
    vectors = spark.range(1).select("id", F.array(F.lit(1.0)).alias("embedding"))
    with pytest.raises(Exception, match="more than 1000 rows"):
        sensitivity.category_flags(vectors, df, ["id"]).collect()


def test_lenient_files_and_text_report(spark):
    df = spark.createDataFrame([("a.log", bytearray(b"x")), ("b.yml", bytearray(b"y"))], "path string, content binary")
    assert [r["status"] for r in files.ingest(df, lenient=True).collect()] == ["ok", "ok"]
    row = spark.createDataFrame([("Hi Arion", {"Arion": "Max"})], "anonymized string, mapping map<string,string>")
    assert row.select(files.report_text().alias("t")).first()["t"].endswith("(1 replacements) ---\n  Arion -> Max")


def test_answer_state_ends_with_the_stream(spark, tmp_path):
    schema = "stream_id string, seq long, kind string, delta string, line string, shape string, mapping string"
    folder, checkpoint = str(tmp_path / "in"), str(tmp_path / "c")
    rows = [("s", 0, "delta", "Hi Ari", None, "choices", '{"Arion": "Max"}'), ("s", 1, "delta", "on", None, "choices", None), ("s", 2, "end", "", None, "choices", None), ("t", 0, "delta", "open", None, "choices", "{}")]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(folder)
    out = answers.rehydrate_stream(runs.read_stream(spark, folder, schema))
    query = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 1
    got = spark.read.parquet(str(tmp_path / "out")).where("stream_id = 's'").orderBy("seq", "part").collect()
    assert "".join(r["text"] for r in got) == "Hi Max"


def test_early_pieces_come_out_in_order_after_a_silence():
    rows, held, ended = answers.settle(answers.Codes({"Arion": "Max"}), {4: ["delta", "Ari", None, "choices"], 6: ["delta", "on!", None, "choices"]}, "x ", [4, 6])
    assert "".join(r[2] for r in rows) == "x Max!" and held == "" and not ended


def test_no_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from hushframe.session import work_folder

    settings = {"spark.master": "spark://host:7077"}
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        work_folder(SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: settings.get(k, d))), "x")


def test_folder_with_empty_files(spark, tmp_path):
    from hushframe.sources import folder

    rows = [(f"f{k}.{'txt' if k % 2 else 'md'}", bytearray(b"x" * (k % 3))) for k in range(40)]
    df = spark.createDataFrame(rows, "name string, content binary").repartition(5)
    place = str(tmp_path / "in")
    assert folder.write(df, place) == 40 and folder.write(df, place) == 40  # again: the same files
    got = files.read_files(spark, place)
    assert sorted((r["path"].rpartition("/")[2], r["length"], bytes(r["content"])) for r in got.collect()) == sorted((n, len(b), bytes(b)) for n, b in rows)
    assert files.read_files(spark, place, "*.md").count() == 20
    status = {r["path"].rpartition("/")[2]: r["status"] for r in files.ingest(got).collect()}
    assert status["f0.md"] == "empty" and status["f1.txt"] == "ok"
    (tmp_path / "none").mkdir()
    assert files.read_files(spark, str(tmp_path / "none")).count() == 0


def test_the_driver_lists_no_files_of_many_folders(spark, tmp_path):
    from hushframe.sources import folder

    place = str(tmp_path / "in")
    names = [f"f{k}.txt" for k in range(2000)]
    folder.write(spark.createDataFrame([(n, bytearray(b"x")) for n in names], "name string, content binary"), place)
    parts = folder.FolderReader({"path": "file://" + place}).partitions()
    assert len(parts) == folder.DEALT and not any(p.files for p in parts) and all(p.below for p in parts)
    assert sorted(r["path"].rpartition("/")[2] for r in files.read_files(spark, place).collect()) == sorted(names)
    # Few folders, one of them deep, and files beside them: listed as they are.
    for k in range(3):
        (tmp_path / "few" / str(k) / "deep").mkdir(parents=True)
        (tmp_path / "few" / str(k) / "deep" / "a.txt").write_text("a")
        (tmp_path / "few" / f"{k}.txt").write_text("b")
    assert files.read_files(spark, str(tmp_path / "few")).count() == 6


def test_stream_of_many_files_and_a_last_one(spark):
    """The table keeps its files, they come in one batch, and the last row in the next one."""
    seen = []
    rows = spark.range(40).repartition(4)
    stream = runs.as_stream(rows, "numbers", spark.range(99, 100))
    runs.drain_batches(stream, "numbers", lambda df, _: seen.append((sorted(r["id"] for r in df.collect()), df.select(F.input_file_name()).distinct().count())))
    assert [ids for ids, _ in seen] == [list(range(40)), [99]] and seen[0][1] == 4


def test_answers_go_as_rows():
    """The stream hands rows to the processor and takes rows: no frame for each answer."""
    from types import SimpleNamespace

    from pyspark.sql import Row

    state = SimpleNamespace(exists=lambda: False, clear=lambda: None)
    processor = answers.AnswerRows()
    processor.init(SimpleNamespace(getValueState=lambda *a: state, getMapState=lambda *a: state))
    columns = Row("stream_id", *answers.PIECE_COLUMNS)
    rows = [columns("s", 1, "end", "", None, "choices", None), columns("s", None, "delta", "x", None, "choices", None), columns("s", 0, "delta", "Ari", None, "choices", '{"Ari": "Max"}')]
    out = list(processor.handleInputRows(("s",), iter(rows), None))
    assert [r.asDict() for r in out] == [{"stream_id": "s", "seq": 0, "part": 0, "text": "Max", "line": None}]


def test_rows_of_one_row_group_are_dealt_over_the_cores(spark, tmp_path):
    path = str(tmp_path / "documents.parquet")
    words = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.sha2(F.concat(F.col("id").cast("string"), i.cast("string")), 256)), " ")
    spark.range(400).select(F.col("id").alias("doc_id"), words.alias("text")).coalesce(1).write.parquet(path)
    # Files are cut into many more splits than they have row groups.
    small = {"spark.sql.files.maxPartitionBytes": "16k", "spark.sql.files.openCostInBytes": "1k"}
    before = {k: spark.conf.get(k) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        assert fx.table(spark, str(tmp_path), "documents").rdd.getNumPartitions() > 8
        sizes = [r["count"] for r in fx.documents(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(sizes) == 400 and max(sizes) < 80


class _Store:
    """A state store that counts what it is asked for."""

    def __init__(self):
        self.calls, self.value, self.timers = [], None, []

    def getValueState(self, *given):
        return self

    getMapState = getValueState

    def __getattr__(self, name):
        def asked(*given):
            self.calls.append(name)
            if name == "update":
                self.value = given[0]
            if name == "registerTimer":
                self.timers.append(given[0])
            return {"get": self.value, "exists": self.value is not None, "listTimers": self.timers}.get(name)

        return asked


def test_a_stream_that_comes_whole_asks_the_store_once():
    store, processor = _Store(), answers.AnswerRows()
    processor.init(store)
    rows = [("s", 0, "delta", "Hallo Ar", None, "choices", '{"Arion": "Anna"}'), ("s", 1, "delta", "ion", None, "choices", None), ("s", 2, "end", "", None, "choices", None)]
    assert "".join(r["text"] for r in processor.handleInputRows(("s",), iter(rows), None)) == "Hallo Anna"
    assert store.calls == ["exists"]


def test_a_new_session_has_no_timers_to_list():
    from hushframe.streaming import sessions

    store, processor = _Store(), sessions.SweepProcessor(10)
    processor.init(store)
    assert list(processor.handleInputRows(("s",), iter([("s", None, 5000), ("s", None, 7000)]), None)) == []
    assert store.calls == ["get", "update", "registerTimer"] and store.value == (7000,) and store.timers == [17001]
    list(processor.handleInputRows(("s",), iter([("s", None, 6000)]), None))
    assert store.calls[3:] == ["get", "listTimers", "deleteTimer", "update", "registerTimer"] and store.value == (7000,)
