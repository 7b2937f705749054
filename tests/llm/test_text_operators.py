"""Decontamination, substrings and SimHash against brute force."""

import hashlib
import random
import re

import pytest
import xxhash
import corpus_pipeline
from conftest_llm import ODD, SF

from hushframe.llm import decontaminate, simhash, substrings
from hushframe.llm import near as near_sets
from hushframe.llm.suffixes import repeated, suffix_order

# -- decontamination

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def contamination(docs, items, window=10):
    windows = {}
    for item, text in items:
        said = WORDS.findall(lower(text))
        for i in range(max(1, len(said) - window + 1)) if said else ():
            windows.setdefault(tuple(said[i : i + window]), set()).add("" if item is None else str(item))
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        said = WORDS.findall(lower(text))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(said) - n + 1):
                owners = windows.get(tuple(said[i : i + n]))
                if owners:
                    hit |= set(range(i, i + n))
                    found |= owners
        out.append((doc, len(said), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def marked(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()), key=repr)


def benchmark(spark, items):
    return spark.createDataFrame([(i, t, "q") for i, t in items], "item_id long, text string, hits string")


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_decontamination_random(spark, docs_of, block_bytes):
    r = random.Random(3)
    vocabulary = ["a", "B", "ba", "é", "É", "7", "x9", "tree"]
    text = lambda n: "".join(r.choice(vocabulary) + r.choice([" ", ", ", "\n", "--", "\x00", "  "]) for _ in range(n))
    items = [(k, text(r.choice([0, 1, 2, 5, 9, 10, 11, 14]))) for k in range(12)] + [(3, None), (None, "tree B a"), (40, "...")]
    docs = [(k, text(r.randint(0, 60)) + (items[r.randrange(12)][1].upper() if k % 3 == 0 else "")) for k in range(60)]
    assert marked(decontaminate.mark(docs_of(docs), benchmark(spark, items), block_bytes=block_bytes)) == contamination(docs, items)


def test_decontamination_odd_rows(spark, docs_of):
    items = [(1, "same text here"), (2, "same text here"), (3, ""), (4, "ÉTÉ été"), (5, "x" * 200_000)]
    assert marked(decontaminate.mark(docs_of(ODD), benchmark(spark, items))) == contamination(ODD, items)
    kept = decontaminate.drop_contaminated(docs_of(ODD), benchmark(spark, items))
    assert kept.columns == docs_of([]).columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 6, 8]


def test_decontamination_spans_are_of_the_original(spark, docs_of):
    text = "Before: «The QUICK, brown\tfox—9 times», after"
    row = decontaminate.mark(docs_of([(1, text)]), benchmark(spark, [(1, "the quick brown fox")])).first()
    # The dash lies beyond ASCII, so it is a part of a word.
    assert row.n_hit == 0
    row = decontaminate.mark(docs_of([(1, text)]), benchmark(spark, [(1, "QUICK, Brown")])).first()
    (start, end), = row.spans
    assert text[start:end] == "QUICK, brown"


def test_decontamination_empty_tables(spark, docs_of):
    assert decontaminate.mark(docs_of([]), benchmark(spark, [(1, "a")])).count() == 0
    assert decontaminate.mark(docs_of([(1, "a")]), benchmark(spark, [])).first().contaminated is False


# -- substrings


def substring_rows(docs, length=100):
    """In order of id (null first); rows that repeat an id in the order given."""
    seen, out = set(), []
    for doc, text in sorted(docs, key=lambda d: (d[0] is not None, d[0])):
        raw = (text or "").encode()
        gone, done = bytearray(len(raw)), 0
        for i in range(len(raw) - length + 1):
            said = raw[i : i + length]
            if said in seen:
                gone[max(i, done) : i + length] = b"\1" * (i + length - max(i, done))
                done = i + length
            seen.add(said)
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        spans = sum(1 for i in range(len(raw)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((doc, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def substring_marks(df, **options):
    rows = substrings.mark(df, **options).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    return sorted((tuple(r) for r in rows.collect()), key=repr)


def test_suffix_order_and_repeats():
    import numpy as np

    for seed in range(60):
        r = random.Random(seed)
        length = r.choice([7, 8, 15, 20])
        letters = r.choice([b"ab", b"abc", b"\x00\xff", bytes(range(256)), b"a"])
        pieces = [bytes(r.choice(letters) for _ in range(r.randint(1, 60))) for _ in range(r.randint(1, 8))]
        pieces += [pieces[0] * 2, pieces[-1][:10] * 3]
        doc, start = np.array([r.randint(0, 3) for _ in pieces]), 1000 * np.arange(len(pieces))
        seen, want = set(), set()
        for d, s, said in sorted((int(doc[k]), int(start[k]) + i, p[i : i + length]) for k, p in enumerate(pieces) for i in range(len(p) - length + 1)):
            if said in seen:
                want.add((d, s))
            seen.add(said)
        assert set(zip(*(x.tolist() for x in repeated(pieces, doc, start, length)), strict=True)) == want
        text = np.concatenate([np.append(np.frombuffer(p, np.uint8).astype(np.uint16) + 1, np.uint16(0)) for p in pieces])
        suffixes = [(lambda t: t[: t.index(0)])(text[i:].tolist()) for i in suffix_order(text, 300)]
        assert suffixes == sorted(suffixes) and len(suffixes) == len(text)


@pytest.mark.parametrize("most_pieces", [4096, 1, 0])
def test_substrings_random(docs_of, most_pieces):
    r = random.Random(5)
    base = ["".join(r.choice("abc ") for _ in range(300)) for _ in range(4)]
    docs = []
    for i in range(80):
        k, b = r.random(), r.choice(base)
        edge = lambda: "".join(r.choice("xyz") for _ in range(r.randint(0, 30)))
        if k < 0.3:
            docs.append((i, "a" * r.randint(0, 500)))
        elif k < 0.5:
            docs.append((i, "ab c" * r.randint(0, 100)))
        elif k < 0.8:
            at = r.randint(0, 200)
            docs.append((i, edge() + b[at : at + r.randint(0, 180)] + edge()))
        else:
            docs.append((i, "".join(r.choice("ab") for _ in range(r.randint(0, 150))) + "é" * r.randint(0, 90)))
    assert substring_marks(docs_of(docs), most_pieces=most_pieces) == substring_rows(docs)


def test_substrings_odd_rows(docs_of):
    assert substring_marks(docs_of(ODD).coalesce(1)) == substring_rows(ODD)
    long = [(1, "lorem ipsum dolor " * 20), (1, "lorem ipsum dolor " * 20), (None, "lorem ipsum dolor " * 9), (0, None)]
    assert substring_marks(docs_of(long).coalesce(1)) == substring_rows(long)


def test_substrings_parts_of_a_long_text(docs_of, monkeypatch):
    monkeypatch.setattr(substrings, "PART", 500)
    r = random.Random(1)
    text = "".join(r.choice("abcdefgh ") for _ in range(3000))
    docs = [(1, text), (2, text[700:1900] + "end"), (3, "new" + text[-800:])]
    assert substring_marks(docs_of(docs)) == substring_rows(docs)


def test_substrings_empty_table(docs_of):
    assert substring_marks(docs_of([])) == []


def test_substrings_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert substring_marks(docs) == substring_rows([(r.doc_id, r.text) for r in docs.collect()])


# -- SimHash


def simhash_rows(docs, radius=4):
    marks = []
    for doc, text in docs:
        said = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
        shingles = [" ".join(said[i : i + 4]) for i in range(max(1, len(said) - 3))] if said else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        marks.append((doc, sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))))
    root = list(range(len(marks)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(marks)):
        for j in range(i):
            if (marks[i][1] ^ marks[j][1]).bit_count() <= radius:
                root[find(i)] = find(j)
    first = {}
    for i, (doc, _) in enumerate(marks):
        if doc is not None:
            first[find(i)] = min(doc, first.get(find(i), doc))
    return sorted(((doc, f"{fp:016x}", first.get(find(i))) for i, (doc, fp) in enumerate(marks)), key=repr)


def simhash_marks(df, **options):
    return sorted((tuple(r) for r in simhash.mark(df, **options).collect()), key=repr)


def near(n=90, seed=2):
    r = random.Random(seed)
    base = [[r.choice(["The", "tree", "été", "a", "b", "house", "wood", "x"]) + str(r.randint(0, 40)) for _ in range(150)] for _ in range(6)]
    docs = []
    for i in range(n):
        said = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2, 3])):
            said[r.randrange(len(said))] = f"new{r.random()}"
        docs.append((1000 - i, r.choice([" ", "\n", "\t "]).join(said)))
    return docs


def test_simhash_odd_rows(docs_of):
    assert simhash_marks(docs_of(ODD)) == simhash_rows(ODD)
    assert simhash_marks(docs_of([(None, "one two"), (None, "one two"), (3, "other")])) == simhash_rows([(None, "one two"), (None, "one two"), (3, "other")])


@pytest.mark.parametrize("blocks", [None, 7])
def test_simhash_near(docs_of, blocks):
    assert simhash_marks(docs_of(near()), blocks=blocks) == simhash_rows(near())


def test_links_lose_none(spark):
    r = random.Random(4)
    base = [r.getrandbits(64) for _ in range(30)]
    prints = set(base)
    for _ in range(300):
        fp = r.choice(base)
        for _ in range(r.randint(0, 6)):
            fp ^= 1 << r.randrange(64)
        prints.add(fp)
    signed = [(fp - (1 << 64) if fp >> 63 else fp,) for fp in prints]
    nodes = spark.createDataFrame(signed, "fp long")
    for options in ({}, {"cell_rows": 5}, {"blocks": 6}):
        found = {tuple(r) for r in simhash.components(simhash.links(nodes, 4, **options)).collect()}
        root = {}
        for u, v in found:
            root[u] = v
        label = lambda x: root.get(x, x)
        for (a,) in signed:
            for (b,) in signed:
                if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4:
                    assert label(a) == label(b)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (502, 501)], "u long, v long")
    got = {tuple(r) for r in simhash.components(edges).collect()}
    assert got == {(i, 0) for i in range(1, 201)} | {(501, 500), (502, 500)}


def test_simhash_keep_one(docs_of):
    docs = docs_of(near())
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in simhash_rows(near())})
    assert simhash.keep_one(docs_of([])).count() == 0
    assert simhash.keep_one(docs_of([(None, "a b"), (None, "a b"), (None, "c d")])).count() == 2


def test_simhash_empty_table(docs_of):
    assert simhash_marks(docs_of([])) == []


# -- near-duplicates of the pipeline


def near_rows(docs, shingle=5):
    """Of each component of links with a Jaccard similarity of 0.8 or more the smallest id."""
    sets = []
    for _, text in docs:
        said = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
        sets.append({" ".join(said[i : i + shingle]) for i in range(max(1, len(said) - shingle + 1))} if said else set())
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    keep = {}
    for i, (doc, _) in enumerate(docs):
        keep[find(i)] = min(doc, keep.get(find(i), doc))
    return sorted(keep.values())


def altered(n=240, seed=5):
    """Copies with one to ten words in 150 replaced, on both sides of 0.8."""
    r = random.Random(seed)
    base = [[r.choice(["The", "tree", "été", "wood"]) + str(r.randint(0, 40)) for _ in range(150)] for _ in range(40)]
    docs = []
    for i in range(n):
        said = list(r.choice(base))
        for _ in range(r.choice([0, 1, 2, 3, 4, 6, 10])):
            said[r.randrange(len(said))] = f"new{r.random()}"
        docs.append((1000 - i, r.choice([" ", "\n", "\t "]).join(said)))
    return docs + [(5000, "a b"), (5001, "A  b"), (5002, "c"), (5003, ""), (5004, None)]


def test_near_keeps_one_of_each_component_at_four_fifths(docs_of):
    docs = docs_of(altered())
    kept = near_sets.keep_one(docs)
    assert kept.columns == docs.columns
    want = near_rows(altered())
    assert sorted(r.doc_id for r in kept.collect()) == want
    # Most of these links lie beyond four bits.
    assert len({c for _, _, c in simhash_rows(altered())}) > len(want) + 20
    assert near_sets.keep_one(docs_of([])).count() == 0
    assert near_sets.keep_one(docs_of([(None, "a b"), (None, "a b"), (None, "c d")])).count() == 2


def test_near_links_do_not_depend_on_cells(docs_of, monkeypatch):
    monkeypatch.setattr(near_sets.links, "__defaults__", (3,))
    assert sorted(r.doc_id for r in near_sets.keep_one(docs_of(altered())).collect()) == near_rows(altered())


def test_near_links_by_fingerprint_too(spark):
    """Few runs, often repeated, and ends of their own: one fingerprint for sets far apart in similarity."""
    said = " ".join(f"wort{i}" for i in range(9))
    texts = [" ".join([said] * 300 + [f"{k}ende{i}" for i in range(8)]) for k in "ab"]
    other = [" ".join(f"{k}neu{i}" for i in range(60)) for k in "cd"]
    docs = [(3, texts[0]), (1, texts[1]), (4, other[0]), (2, other[1]), (5, ""), (6, None)]
    assert near_rows([(i, t or "") for i, t in docs[:4]]) == [1, 2, 3, 4]
    marks = dict((r["doc_id"], r["component_id"]) for r in simhash.mark(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert marks == {1: 1, 3: 1, 2: 2, 4: 4, 5: 5, 6: 5}
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in near_sets.keep_one(df).collect()) == [1, 2, 3, 4, 5]
    assert sorted(r["doc_id"] for r in corpus_pipeline.distinct(spark, df, "").collect()) == [1, 2, 4, 5]
