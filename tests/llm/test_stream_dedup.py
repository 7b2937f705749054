import hashlib
from collections import defaultdict

import pytest
from conftest_llm import ODD, SF
from pyspark.sql import functions as F

from hushframe.llm import stream_dedup


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return sorted(out, key=repr)


def got(marked):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.digest) for r in marked.collect()), key=repr)


def test_odd_rows(docs_of):
    marked = stream_dedup.mark(docs_of(ODD))
    assert got(marked) == brute(ODD)
    assert marked.where("kept").groupBy("digest").count().where("count != 1").count() == 0
    assert marked.where("kept").count() == len({t or "" for _, t in ODD})


def test_many_batches_keep_their_state(docs_of):
    rows = [(i, f"text {i % 7}") for i in range(60)]
    marked = stream_dedup.mark(docs_of(rows).repartition(6), files_per_batch=1)
    assert got(marked) == brute(rows)


@pytest.mark.parametrize("digest", [lambda t: F.length(t).cast("string"), lambda t: F.lit("one")])
def test_equal_digests_of_different_texts_are_told_apart(docs_of, digest):
    rows = [(1, "ab"), (2, "cd"), (3, "ab"), (4, "xyz"), (5, "cd"), (6, "ab"), (7, None), (8, "")]
    marked = stream_dedup.mark(docs_of(rows), digest=digest)
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in marked.collect()) == [
        (1, 6, 3, False), (2, 5, 2, False), (3, 6, 3, False), (4, 4, 1, True), (5, 5, 2, True), (6, 6, 3, True), (7, 8, 2, False), (8, 8, 2, True),
    ]


def test_keep_one(docs_of):
    docs = docs_of(ODD)
    kept = stream_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(2, ""), (3, " \n\t"), *ODD[5:6], *ODD[7:]], key=repr)


def test_empty_table(docs_of):
    assert stream_dedup.mark(docs_of([])).count() == 0
    assert stream_dedup.keep_one(docs_of([])).count() == 0


def test_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert got(stream_dedup.mark(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])
