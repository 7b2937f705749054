"""Chat, shards, classifiers, WARC, packing and the pipeline."""

import base64
import hashlib
import random
import subprocess
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from conftest_llm import ODD, SF
from pyspark.sql import functions as F

import corpus_pipeline
from hushframe.llm import chat, packing, quality, queries, shards, toxicity, warc
from hushframe.llm.common import table

# -- chat

TURNS = [
    (1, 0, "user", "plain"), (1, 1, "assistant", "reply \\ </turn> ### x: \\b\\e\\h"), (1, 2, "user", None), (1, 3, "assistant", ""),
    (2, 1, "assistant", "é漢🙂"), (2, 0, "system", "### assistant: no</turn>\n"), (3, 0, "user", "alone"), (4, 5, "a: b", "</turn"), (4, 5, "a: b", "</turn"),
    (4, None, None, ": "), (None, 0, "assistant", "of no conversation"),
    (-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok"),
]


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, formatted string, position int")


def test_chat_reads_back(spark):
    turns, some = chat.expand(conversations(spark, TURNS))
    said = defaultdict(list)
    for conv, turn, role, text in TURNS:
        said[conv].append((turn is not None, turn, role or "", text or ""))
    want = {}
    for conv, rows in said.items():
        rows.sort(key=lambda r: (r[0], r[1] or 0, r[2], r[3]))
        trained = "".join(r[3] for r in rows if r[2] == "assistant")
        whole = "".join(f"{r[2]}\n{r[3]}\n" for r in rows)
        want[conv] = (len(rows), hashlib.sha256(whole.encode()).hexdigest(), len(trained), hashlib.sha256(trained.encode()).hexdigest())
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(turns, some).collect()}
    assert got == want


def test_chat_examples_hold_all_turns_before_and_train_one_reply(spark):
    turns, some = chat.expand(conversations(spark, TURNS))
    assert some.count() == sum(r[2] == "assistant" for r in TURNS)
    written = {(r.conv_id, r.position): r for r in chat.render(turns, some).collect()}
    assert len(written) == some.count()
    last = written[1, 4]
    assert last.text.count(chat.CLOSE) == 4 and last.text[last.loss_start : last.loss_end] == ""
    second = written[1, 2]
    assert second.text.startswith("### user: plain</turn>\n### assistant: ")
    coded = second.text[second.loss_start : second.loss_end]
    for raw, code in reversed(chat.ESCAPES):
        coded = coded.replace(code, raw)
    assert coded == "reply \\ </turn> ### x: \\b\\e\\h"
    assert second.loss_end + len(chat.CLOSE) == len(second.text)


def test_chat_empty_table(spark):
    assert chat.read_back(*chat.expand(conversations(spark, []))).count() == 0


# -- shards


def check_shards(rows, docs, n):
    sizes, counts, slots = Counter(), Counter(), defaultdict(list)
    for r in rows:
        sizes[r["shard"]] += r["size"]
        counts[r["shard"]] += 1
        slots[r["shard"]].append(r["slot"])
        assert 0 <= r["shard"] < n and r["law"] == "bytes" and r["grown_shard"] is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in docs)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    return sizes, counts


def test_shards_are_level_with_a_hot_group(docs_of):
    r = random.Random(1)
    docs = [(i, "w " * r.randint(1, 400)) for i in range(2000)] + [(5000 + i, "hot " * 50) for i in range(1000)]
    rows = shards.mark(docs_of(docs), 8).collect()
    sizes, counts = check_shards(rows, docs, 8)
    mean = sum(sizes.values()) / 8
    assert max(sizes.values()) < 1.02 * mean and min(sizes.values()) > 0.98 * mean
    assert max(counts.values()) < 1.1 * min(counts.values())
    text, at = dict(docs), defaultdict(set)
    for row in rows:
        at[text[row["doc_id"]]].add(row["shard"])
    assert all(len(s) == 1 for t, s in at.items() if not t.startswith("hot"))


def test_shards_odd_rows(docs_of):
    check_shards(shards.mark(docs_of(ODD), 3).collect(), ODD, 3)
    assert shards.mark(docs_of([])).count() == 0


# -- classifiers


def labelled(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, quality int, toxic int, score string")


def prose(seed, n, bad=()):
    r = random.Random(seed)
    said = ["".join(r.choice(["th", "er", "an", "on", "re", "in"]) for _ in range(r.randint(1, 4))) for _ in range(n)]
    for word in bad:
        said[r.randrange(n)] = word
    return " ".join(said)


def fixture():
    insults = ["idiot", "moron", "scum", "stupid"]
    docs = [(i, prose(i, 40 + i % 200, [insults[i % 4], insults[i % 3]] if i % 4 == 0 else ())) for i in range(600)]
    docs = [(i, t if i % 3 else " ".join(w.upper() + "!!" for w in t.split())) for i, t in docs]
    return docs, [(i, int(i % 3 != 0), int(i % 4 == 0)) for i in range(600)]


@pytest.mark.parametrize(("operator", "column", "parts", "held"), [(toxicity, "toxic", 5, 0), (quality, "quality", 3, 1)])
def test_classifier_on_held_out_rows(spark, docs_of, operator, column, parts, held):
    docs, labels = fixture()
    rows = operator.mark(docs_of(docs), labelled(spark, labels)).collect()
    assert len(rows) == len(docs)
    known = {i: (q, t)[column == "toxic"] for i, q, t in labels}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % parts == held) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    right = [r.predicted == known[r.doc_id] for r in rows if r.held_out]
    assert sum(right) >= 0.95 * len(right)


@pytest.mark.parametrize("operator", [toxicity, quality])
def test_classifier_never_learns_from_held_out_labels(spark, docs_of, operator):
    docs, labels = fixture()
    parts, held = (5, 0) if operator is toxicity else (3, 1)
    turned = [(i, 1 - q, 1 - t) if zlib.crc32(str(i).encode()) % parts == held else (i, q, t) for i, q, t in labels]
    score = lambda rows: {r.doc_id: r.score for r in operator.mark(docs_of(docs).coalesce(1), labelled(spark, rows).coalesce(1)).collect()}
    assert score(labels) == score(turned)


@pytest.mark.parametrize("operator", [toxicity, quality])
def test_classifier_odd_rows(spark, docs_of, operator):
    docs, labels = fixture()
    odd = [(i if i is None else 10_000 + i, t) for i, t in ODD]
    labels += [(None, 1, 1), (20_000, None, None), (1, 1, 0), (77_777, 1, 1)]
    rows = operator.mark(docs_of(docs + odd), labelled(spark, labels)).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in docs + odd)
    assert all(0 <= r.score <= 1 and r.held_out is not None for r in rows)
    by = {r.doc_id: r for r in rows}
    assert by[10_001].score == by[10_002].score == by[10_003].score
    assert operator.mark(docs_of([]), labelled(spark, [])).count() == 0
    assert operator.mark(docs_of(ODD), labelled(spark, [])).count() == len(ODD)
    assert operator.mark(docs_of(docs[:4]), labelled(spark, [(1, 1, 1), (2, 1, 1)])).count() == 4


@pytest.mark.parametrize("texts", [["", ""], ["   ", "!!"], ["", "word"], ["word", None]])
def test_toxicity_learned_from_texts_without_words(spark, docs_of, texts):
    model = toxicity.fit([t or "" for t in texts], [0, 1])
    assert model.blank and model.score("some text") == model.score("") == 0.5
    docs = docs_of([(6, texts[0]), (7, texts[1]), (5, "a text")])
    labels = spark.createDataFrame([(6, 0), (7, 1)], "doc_id long, toxic int")
    assert sorted(r.doc_id for r in toxicity.mark(docs, labels).collect()) == [5, 6, 7]


def test_toxicity_learns_within_a_few_bytes_for_each_n_gram():
    """The driver holds the sample's n-grams once; no step makes wide copies of all of them."""
    import tracemalloc

    r = random.Random(3)
    texts = [" ".join(f"w{r.randrange(5000)}" for _ in range(250)) + (" grimblefop" if k % 4 == 0 else "") for k in range(2000)]
    n = sum(len(toxicity.grams(t.encode()).bucket) for t in texts)
    tracemalloc.start()
    try:
        model = toxicity.fit(texts, [int(k % 4 == 0) for k in range(2000)], rounds=2)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    fixed = 40 * toxicity.BUCKETS * toxicity.WIDTH + 24_000_000  # table, its sums and copies, and one part of the sample at work
    assert n > 5_000_000 and not model.blank
    assert peak < 3 * n + fixed, (peak, n)


def test_toxicity_knows_misspellings_in_long_texts_and_keeps_clean_ones(spark, docs_of):
    docs, labels = fixture()
    more = [(9001, prose(1, 3000, ["idiott"])), (9002, prose(2, 3000)), (9003, ""), (9004, None)]
    by = {r.doc_id: r.predicted for r in toxicity.mark(docs_of(docs + more), labelled(spark, labels)).collect()}
    assert (by[9001], by[9002], by[9003], by[9004]) == (1, 0, 0, 0)
    kept = toxicity.drop_toxic(docs_of(docs + more), labelled(spark, labels))
    assert kept.columns == docs_of([]).columns
    assert {r.doc_id for r in kept.collect()} == {i for i, p in by.items() if not p}


def test_text_parts_and_subwords():
    text = ("word " * 1000).encode()
    assert b"".join(toxicity.parts(text, 64)) == text
    assert all(p.endswith(b" ") for p in toxicity.parts(text, 64))
    assert b"".join(toxicity.parts(b"x" * 1000, 64)) == b"x" * 1000
    one = toxicity.grams(b"Tree")
    # " tree ": four of three bytes, three of four, two of five.
    assert len(one.bucket) == 9 and (np.sort(one.bucket) == np.sort(toxicity.grams(b"...tREE?").bucket)).all()
    assert len(toxicity.grams(b" ".join([b"a"] * (2 * toxicity.WORDS + 1))).start) == 3
    assert len(toxicity.grams(b"?!").start) == 0


def test_temperature_undoes_a_scale():
    rng = np.random.default_rng(0)
    logit = rng.normal(0, 2, 20_000)
    y = (rng.random(20_000) < 1 / (1 + np.exp(-logit))).astype(float)
    assert abs(quality.temperature(5 * logit, y, np.ones(len(y))) - 5) < 0.4


# -- WARC


def pages(spark, rows):
    return spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, key string")


PAGES = [
    (5, "http://a/\r\nX: y", "<p>é</p>"), (3, "http://b", "<p>é</p>"), (9, None, None), (8, "http://c", ""), (1, "ü", "x" * 100_000), (1, "ü", "x" * 100_000),
    (None, "http://d", "x" * 100_000), (2, "http://e", "WARC/1.1\r\n\r\n HTTP/1.1\r\n\r\nbody"), (-4, "http://f", "<p>é</p>\n"),
]


@pytest.mark.parametrize("least", [0, 50])
def test_warc_round_trip(spark, least):
    first = {}
    for i, _, html in PAGES:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    want = []
    for i, _, html in PAGES:
        raw = (html or "").encode()
        again = len(raw) >= least and i != first[html or ""]
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", first[html or ""] if again else None))
    got = warc.round_trip(pages(spark, PAGES), least)
    assert sorted((tuple(r) for r in got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr) == sorted(want, key=repr)
    assert Counter(bytes(r.payload) for r in got.where("record_type = 'response'").collect()) == Counter((PAGES[k][2] or "").encode() for k, w in enumerate(want) if w[3] == "response")
    assert warc.round_trip(pages(spark, [])).count() == 0


def test_warc_splits_own_each_record_once(spark, tmp_path):
    class Bytes:
        def __init__(self, data):
            self.data = data

        def read_at(self, n, at):
            return self.data[at : at + n]

    r = random.Random(0)
    records = [warc.record(k, f"http://x/{k}", bytes(r.randrange(256) for _ in range(r.randint(0, 400))) + warc.MAGIC * 3, "D", None, level=r.choice([0, 6])) for k in range(60)]
    data = b"".join(records)
    for size in (1, 13, 100, 1000, len(data)):
        got = [p for a in range(0, len(data), size) for p, _ in warc.members(Bytes(data), len(data), a, min(a + size, len(data)))]
        assert got == np.cumsum([0, *map(len, records[:-1])]).tolist()
    # A record that is cut off or damaged is left out, the ones behind it are found.
    hurt = data[: len(records[0]) + 30] + b"?" * 50 + data[len(records[0]) + 80 :]
    assert [p for p, _ in warc.members(Bytes(hurt), len(hurt), 0, len(hurt))][:1] == [0]
    assert len(list(warc.members(Bytes(hurt), len(hurt), 0, len(hurt)))) == 59
    path = tmp_path / "x.warc.gz"
    path.write_bytes(data)
    read = warc.read(warc.archives_of(spark, [str(path)]), split_bytes=500)
    assert read.count() == 60
    # Each split has a task of its own, however small the table of splits is.
    assert read.rdd.getNumPartitions() == -(-len(data) // 500)
    tasks = read.select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks > 20


def test_warc_reports_damaged_records(spark, tmp_path, monkeypatch):
    records = [warc.record(k, f"http://x/{k}", f"page {k} ".encode() * 50, "D", None) for k in range(20)]
    data = bytearray(b"".join(records))
    at = sum(map(len, records[:7]))
    data[at + len(records[7]) - 20 : at + len(records[7]) - 10] = b"?" * 10
    path = tmp_path / "x.warc.gz"
    path.write_bytes(data[: -len(records[19]) // 2])  # and the last one is cut off
    for size in (100, 10_000):
        rows = warc.read(warc.archives_of(spark, [str(path)]), split_bytes=size).collect()
        assert sorted(r.page_id for r in rows if r.record_type != "damaged") == [k for k in range(19) if k != 7]
        places = {int(r.url.rpartition("#")[2]) for r in rows if r.record_type == "damaged"}
        assert places == {at, sum(map(len, records[:19]))}
    whole = warc.write

    def hurt(*args):
        listing = whole(*args)
        for r in listing.collect():
            file = r.path.removeprefix("file://")
            kept = open(file, "rb").read()
            open(file, "wb").write(kept[:-30])
        return listing

    monkeypatch.setattr(warc, "write", hurt)
    with pytest.raises(ValueError, match="damaged"):
        warc.round_trip(pages(spark, PAGES))


def test_shards_are_level_with_many_tasks(spark, docs_of):
    r = random.Random(3)
    docs = [(i, f"{i} " + "w " * int(60 * r.paretovariate(1.6))) for i in range(6000)]
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        rows = shards.mark(docs_of(docs), 8).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", usual)
    sizes, counts = check_shards(rows, docs, 8)
    assert max(sizes.values()) < 1.005 * min(sizes.values())
    assert max(counts.values()) < 1.05 * min(counts.values())


# -- packing


def check_packing(rows, capacity=packing.CAPACITY):
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def ids(text):
    from tokenizers import Tokenizer

    if not hasattr(ids, "tokenizer"):
        ids.tokenizer = Tokenizer.from_file(packing.public_tokenizer())
    return [*ids.tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def test_packing_rows_and_ids(spark, docs_of):
    docs = ODD + [(r.doc_id + 100, r.text) for r in table(spark, SF, "documents").collect()]
    rows = packing.mark(docs_of(docs), packing.public_tokenizer()).collect()
    want = []
    for i, text in docs:
        said = ids(text)
        for p in range(-(-len(said) // 2048)):
            piece = said[2048 * p : 2048 * (p + 1)]
            want.append((i, p, 2048 * p, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes())))
    assert sorted((tuple(r)[:5] for r in rows), key=repr) == sorted(want, key=repr)
    used, lengths = check_packing(rows), Counter(w[3] for w in want)
    assert used <= sum(n for _, n in packing.best_fit(lengths, 2048))
    assert used - packing.lower_bound(lengths, 2048) <= 1
    assert packing.mark(docs_of([]), packing.public_tokenizer()).count() == 0


def test_encoder_equals_the_whole_tokenizer():
    encode = packing.encoder(packing.public_tokenizer()).encode
    letters = [*"aBéÉß×÷ªµ²¼ÖÿΣςİ漢ﬁÅ'<|!1 \n\t\x1c\x85\xa0 ", "́", "'s", "'LL", "<|endoftext|>", "'re"]
    for seed in range(1500):
        r = random.Random(seed)
        text = "".join(r.choice(letters) for _ in range(r.randint(0, 14)))
        assert encode(text) == np.array(ids(text)[:-1], "<u4").tobytes(), repr(text)


def fewest(items, capacity):
    best = [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] >= items[i]:
                bins[k] -= items[i]
                go(i + 1, bins)
                bins[k] += items[i]
        go(i + 1, [*bins, capacity - items[i]])

    go(0, [])
    return best[0]


def test_bin_completion_is_optimal_on_small_cases():
    for seed in range(200):
        r = random.Random(seed)
        items = sorted((r.randint(1, 20) for _ in range(r.randint(1, 10))), reverse=True)
        made = packing.complete(Counter(items), 20)
        assert Counter(n for lengths, times in made for n in lengths * times) == Counter(items)
        assert all(sum(lengths) <= 20 for lengths, _ in made)
        assert sum(t for _, t in made) == fewest(items, 20) >= packing.lower_bound(Counter(items), 20)


def test_bin_completion_beats_or_equals_best_fit():
    for seed in range(6):
        r = random.Random(seed)
        counts = Counter(r.randint(1, r.choice([300, 900, 2047])) for _ in range(300))
        assert packing.lower_bound(counts, 2048) <= sum(t for _, t in packing.complete(counts, 2048, 300)) <= sum(t for _, t in packing.best_fit(counts, 2048))


def test_bin_completion_fills_sequences_with_many_pieces():
    counts = {n: 100 for n in range(350, 461)}
    made = packing.complete(counts, 2048)
    held = Counter()
    for lengths, times in made:
        assert sum(lengths) <= 2048
        for n in lengths:
            held[n] += times
    assert held == counts
    # Five pieces share a sequence, never six; best-fit decreasing needs 2,400.
    assert sum(t for _, t in made) == packing.lower_bound(counts, 2048) == 2220


def test_bin_completion_holds_little_memory():
    """A deep search over 2,000 lengths, in a process of its own: what it adds to the peak."""
    script = """
import random, resource
from collections import Counter
from hushframe.llm import packing
r = random.Random(2)
counts = Counter(min(2048, max(1, int(r.lognormvariate(5.2, 1.0)))) for _ in range(250_000))
assert len(counts) > 2000
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
made = packing.complete(counts, 2048)
assert len(made) > 2000
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    done = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, check=True, cwd=Path(__file__).parents[2])
    assert int(done.stdout) < 150


@pytest.mark.parametrize("live", [1, 3, 1000])
def test_bin_completion_does_not_depend_on_what_is_remembered(monkeypatch, live):
    cases = [Counter(random.Random(k).choices(range(1, 40), k=60)) for k in range(12)]
    usual = [packing.complete(c, 50, 400) for c in cases]
    monkeypatch.setattr(packing, "LIVE", live)
    assert [packing.complete(c, 50, 400) for c in cases] == usual
    # Without a bound the search ends with a proof.
    for k in range(30):
        items = random.Random(k).choices(range(3, 21), k=8)
        assert sum(t for _, t in packing.complete(Counter(items), 20, None)) == fewest(items, 20)


def test_bin_completion_ends_where_most_fillings_are_dominated():
    r = random.Random(1)
    counts = Counter(r.randint(1, 2047) for _ in range(3000))
    made = sum(t for _, t in packing.complete(counts, 2048, 50))
    assert packing.lower_bound(counts, 2048) <= made <= sum(t for _, t in packing.best_fit(counts, 2048))


# -- registered queries and the pipeline


def test_checks_are_of_queries():
    assert set(queries.CHECKS) <= set(queries.QUERIES)
    assert {q.split("_")[0] for q in queries.QUERIES} == {f"op{n}" for n in range(1, 14)} | {"pipeline"}


def test_registered_queries_with_sql(spark):
    import duckdb

    db = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "embeddings"):
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    for name, sql in queries.CHECKS.items():
        if sql is None:
            continue
        df = queries.QUERIES[name](spark, SF)
        result = db.execute(sql)
        columns = [d[0] for d in result.description]
        assert sorted(columns) == sorted(df.columns)
        assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == sorted(result.fetchall())


def test_registered_queries_without_sql(spark):
    """Rows and columns of the contracts; the operators' own tests hold the values."""
    sizes = {n: table(spark, SF, n).count() for n in ("documents", "pages")}
    want = {
        "op5_shards": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"], "op6_simhash": ["doc_id", "fingerprint", "component_id"],
        "op7_quality": ["doc_id", "held_out", "score", "predicted"], "op8_toxicity": ["doc_id", "held_out", "score", "predicted"],
        "op9_warc": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
        "op10_packing": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    }
    for name, columns in want.items():
        df = queries.QUERIES[name](spark, SF)
        assert df.columns[: len(columns)] == columns, name
        rows = df.count()
        assert rows > sizes["documents"] if name == "op10_packing" else rows == sizes["pages" if name == "op9_warc" else "documents"], name


def test_pipeline_against_brute_force(spark):
    from test_text_operators import contamination, near_rows

    docs = table(spark, SF, "documents")
    labels = table(spark, SF, "labels")
    rejected = {r.doc_id for r in toxicity.mark(docs, labels).where("predicted = 1").collect()}
    left = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id not in rejected]
    last = {}
    for i, t in left:
        last[t or ""] = max(i, last.get(t or "", i))
    left = [(i, t) for i, t in left if last[t or ""] == i]
    keep = set(near_rows(left))
    left = [(i, t) for i, t in left if i in keep]
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    hit = {r[0] for r in contamination(left, items) if r[5]}
    left = [(i, t) for i, t in left if i not in hit]
    rows = corpus_pipeline.run(spark, SF).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, t in left for _ in range(-(-len(ids(t)) // 2048)))
    check_packing(rows)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "near-duplicates", "decontamination", "packing"]
