"""Token counts, hard negatives and whitening."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from conftest_llm import ODD, SF
from pyspark.sql import functions as F

from hushframe.llm import bidiagonal, negatives, queries, token_counts, whitening
from hushframe.llm.common import table

# -- token counts


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=token_counts.public_vocabulary())


def test_token_counts_of_all_documents(spark, library):
    docs = {r.doc_id: r.text or "" for r in table(spark, SF, "documents").collect()}
    rows = queries.QUERIES["op13_token_counts"](spark, SF).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in rows} == {
        i: (len(t.encode()), n := len(library.encode(t)), n > 4096) for i, t in docs.items()
    }
    assert len(rows) == len(docs) and any(r.over_limit for r in rows)


def test_token_counts_of_odd_texts(spark, docs_of, library):
    rows = token_counts.mark(docs_of(ODD), token_counts.public_vocabulary()).collect()
    assert sorted((r.n_bytes, r.n_tokens) for r in rows) == sorted((len((t or "").encode()), len(library.encode(t or ""))) for _, t in ODD)
    assert token_counts.mark(docs_of([]), token_counts.public_vocabulary()).collect() == []


def test_merges_as_the_library(library):
    merges, rng = token_counts.Merges(token_counts.public_vocabulary()), random.Random(5)
    texts = ["", " ", "   ", "▁", " ▁ x", "<s></s><unk><0x41>", " " * 500 + "w" + " " * 37, "日本語🙂👩‍👩‍👧 текст", "1234 5", "a\x00b\r\n\tc", "x" * 5000]
    texts += ["".join(rng.choice(" ▁\n\tabcdeinthr12é日🙂.,<>_/\x00йд") for _ in range(rng.randint(0, 50))) for _ in range(5000)]
    assert [merges.tokens(t) for t in texts] == [len(library.encode(t)) for t in texts]
    # The same when nothing is remembered, and when a worker forgets all the time.
    assert [merges.merged(token_counts.BLANK + t.replace(" ", token_counts.BLANK)) if t else 0 for t in texts[:300]] == [len(library.encode(t)) for t in texts[:300]]


def test_merges_forget(library, monkeypatch):
    monkeypatch.setattr(token_counts, "CACHE", 3)
    merges = token_counts.Merges(token_counts.public_vocabulary())
    texts = ["one two three four", "four five six", "one two", "six seven eight nine ten", "one"] * 3
    assert [merges.tokens(t) for t in texts] == [len(library.encode(t)) for t in texts]


def test_other_vocabularies_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(token_counts.public_vocabulary(), "rb") as f:
        model.ParseFromString(f.read())
    model.normalizer_spec.remove_extra_whitespaces = True
    path = tmp_path / "other.model"
    path.write_bytes(model.SerializeToString())
    with pytest.raises(ValueError, match="changes texts"):
        token_counts.Merges(str(path))


# -- vectors

INF, NAN = float("inf"), float("nan")
VECTORS = "vec_id long, embedding array<double>, label int, x string, row string, place string, label_ string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, k, "x", "r", "p", "l") for i, v, k in rows], VECTORS)


def odd_vectors(rng, n=300, dims=5):
    # Few values, so that many scores tie.
    rows = [(i, [float(rng.randint(-3, 3)) / 4 for _ in range(dims)], rng.randint(0, 2)) for i in range(n)]
    rows += [(n, None, 1), (n + 1, [1.0, None, 0.0, 0.0, 0.0], 1), (n + 2, [1.0, NAN, 0.0, 0.0, 0.0], 1), (n + 3, [INF, 0.0, 0.0, 0.0, 0.0], 2), (n + 4, [0.5] * 5, None)]
    rows += [(None, [0.5] * 5, 1), (None, [-0.5] * 5, 0), (100, [0.75] * 5, 1), (100, [0.75] * 5, 1), (7, [0.25] * 5, 2)]
    return rows + [(n + 5, [], 1), (n + 6, [0.5, 0.5], 0), (n + 7, [1.0] * 7, 2)]


# -- hard negatives


def mined(rows, n_positives, n_negatives, low, high, scale=256):
    """The contract by brute force; ties between rows of one id are left open, so scores and ids are compared."""
    kept = []
    for i, v, label in rows:
        if label is None or v is None or any(c is None or not math.isfinite(c) for c in v):
            continue
        kept.append((i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, [math.floor(scale * c) for c in v]))
    dot = lambda a, b: sum(p * q for p, q in zip(a, b, strict=False))
    rank = lambda r: (-r[0], r[1] is None, r[1] or 0)
    out = []
    for k, (anchor, label, x) in enumerate(kept):
        if anchor is None or anchor % 100:
            continue
        scored = [(dot(x, y), i, other) for j, (i, other, y) in enumerate(kept) if j != k]
        for score, positive, _ in sorted([s for s in scored if s[2] == label], key=rank)[:n_positives]:
            fit = sorted([s for s in scored if s[2] != label and low * score <= 100 * s[0] <= high * score], key=rank)
            out += [(anchor, positive, r, i, score, s) for r, (s, i, _) in enumerate(fit[:n_negatives], 1)]
    return sorted(out, key=repr)


def mine(spark, rows, n_positives=5, n_negatives=10, low=30, high=90):
    held = negatives.clean(vectors(spark, rows), flip=F.col("vec_id") % 7 == 0)
    found = negatives.mine(held, F.col("vec_id") % 100 == 0, n_positives, n_negatives, low, high)
    return sorted((tuple(r) for r in found.drop("anchor_row", "positive_row", "negative_row").collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_negatives_against_brute_force(spark, monkeypatch, seed):
    rows = odd_vectors(random.Random(seed))
    assert mine(spark, rows) == mined(rows, 5, 10, 30, 90)
    # In many small blocks, with other numbers.
    monkeypatch.setattr(negatives, "ANCHORS", 2)
    monkeypatch.setattr(negatives, "CANDIDATES", 40)
    assert mine(spark, rows, 2, 3, -50, 100) == mined(rows, 2, 3, -50, 100)


def test_negatives_of_a_hot_vector_and_label(spark, monkeypatch):
    monkeypatch.setattr(negatives, "CANDIDATES", 64)
    rng = random.Random(9)
    rows = [(i, [0.5, 0.25, 0.125] if i % 3 else [rng.random() for _ in range(3)], 4 if i % 3 else rng.randint(0, 5)) for i in range(600)]
    assert mine(spark, rows) == mined(rows, 5, 10, 30, 90)


def test_negatives_without_anchors_or_rows(spark):
    assert mine(spark, []) == []
    assert mine(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []
    assert mine(spark, [(100, [1.0], 1)]) == []
    assert mine(spark, [(100, [], 1), (101, [], 1), (102, [], 3)]) == [(100, 101, 1, 102, 0, 0)]


@pytest.mark.parametrize("low,high,dims,count", [(-256, 256, 64, 300), (0, 5, 3, 7), (-(2**40), 2**40, 5, 33), (-(2**63), 2**63 - 1, 4, 9), (5, 6, 1, 1), (-9, -3, 8, 20)])
def test_packed_products_are_exact(low, high, dims, count):
    rng = np.random.default_rng(count)
    x = rng.integers(low, high, (count, dims), dtype=np.int64)
    anchors = [rng.integers(low, high, dims, dtype=np.int64).tolist() for _ in range(3)] + [[0] * dims]
    packed = negatives.Packed(x, max(sum(map(abs, a)) for a in anchors))
    for a in anchors:
        want = [min(max(sum(p * q for p, q in zip(r, a, strict=True)), -(2**63)), 2**63 - 1) for r in x.tolist()]
        assert packed.scores(a).tolist() == want


# -- whitening


def whitened(rows, most=16):
    """Exact sums with fractions, directions from numpy."""
    kept = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v, _ in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    dims = max((len(x) for _, x in kept), default=0)
    kept = [(i, x + [1_000_000] * (dims - len(x))) for i, x in kept]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    away = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(x, sums, strict=True)] for x in fit]).reshape(n, dims)
    values, axes = np.linalg.eigh(away.T @ away / n)
    values, axes = values[::-1][:most], axes[:, ::-1][:, :most]
    some = values > values[0] * 1e-12
    values, axes = values[some], axes[:, some]
    share = values / (away * away).sum() * n
    all_away = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(x, sums, strict=True)] for _, x in kept])
    return [
        (i, k + 1, n, sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True)), w[k], share[k])
        for (i, x), w in zip(kept, all_away @ axes / np.sqrt(values), strict=True)
        for k in range(len(values))
    ]


def same_whitening(got, want):
    """Rows in any order, each component with either sign."""
    assert len(got) == len(want)
    assert sorted(repr((r.vec_id, r.component, r.n, r.deviation)) for r in got) == sorted(repr(w[:4]) for w in want)
    for k in {w[1] for w in want}:
        mine = sorted(((str(r.vec_id), r.deviation, abs(r.whitened)) for r in got if r.component == k))
        other = sorted(((str(w[0]), w[3], abs(w[4])) for w in want if w[1] == k))
        assert np.allclose([m[2] for m in mine], [o[2] for o in other], atol=1e-8)
        signs = {r.vec_id: r.whitened for r in got if r.component == k}
        ratio = [signs[w[0]] * w[4] for w in want if w[1] == k and abs(w[4]) > 1e-6 and w[0] is not None and sum(v[0] == w[0] for v in want) == len({v[1] for v in want})]
        assert all(r > 0 for r in ratio) or all(r < 0 for r in ratio)
    assert np.allclose(sorted({(r.component, r.explained) for r in got}), sorted({(w[1], w[5]) for w in want}), rtol=1e-9)
    assert {r.identity_error for r in got} == {max((r.identity_error for r in got), default=0)} or not got
    assert all(r.identity_error < 1e-8 for r in got)


def test_whitening_against_brute_force(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in table(spark, SF, "embeddings").collect()]
    same_whitening(queries.QUERIES["op12_whitening"](spark, SF).collect(), whitened(rows))


def test_whitening_of_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    rng = np.random.default_rng(4)
    rows = [(i, [float(c) for c in rng.normal(size=5) * [5, 4, 3, 2, 1]], 0) for i in range(200)]
    rows += [(i, rows[0][1], 0) for i in range(200, 300)]  # a hot vector is fitted once
    rows += odd_vectors(random.Random(3), 0)[:5] + [(None, [0.5] * 5, 1), (5, [1.0, 2.0], 1), (6, [], 1)]
    same_whitening(whitening.mark(vectors(spark, rows).repartition(13)).collect(), whitened(rows))


def test_whitening_without_variance(spark):
    for rows in ([], [(1, [1.0, 2.0], 0)], [(1, [1.0, 2.0], 0)] * 3, [(1, [], 0), (2, [], 0)], [(1, None, 0)]):
        assert whitening.mark(vectors(spark, rows)).collect() == []
    # One direction in three dimensions.
    line = [(i, [float(i), 2.0 * i, 7.0], 0) for i in range(20)]
    got = whitening.mark(vectors(spark, line)).collect()
    assert {r.component for r in got} == {1} and all(abs(r.explained - 1) < 1e-12 for r in got)
    same_whitening(got, whitened(line))


def test_whitening_of_large_entries(spark):
    """Deviations beyond a long's range stay at the largest long, others are exact."""
    rows = [(i, [1e13 * i, float(i % 3)], 0) for i in range(12)] + [(99, [1e300, -1e300], 0)]
    got = whitening.mark(vectors(spark, rows)).collect()
    assert {r.deviation for r in got} == {2**63 - 1} and len(got) == 26
    small = [(i, [1e3 * i, float(i % 3)], 0) for i in range(12)]
    same_whitening(whitening.mark(vectors(spark, small)).collect(), whitened(small))


def orthogonal(rng, n):
    return np.linalg.qr(rng.normal(size=(n, n)))[0]


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64])
def test_bidiagonal_solver(n):
    rng = np.random.default_rng(n)
    kinds = [
        np.triu(rng.normal(size=(n, n))), np.eye(n), orthogonal(rng, n) * 3, np.diag(np.repeat(np.arange(n, 0, -1.0), 2)[:n]),
        orthogonal(rng, n) @ np.diag(1 + 1e-8 * np.arange(n)) @ orthogonal(rng, n), orthogonal(rng, n) @ np.diag(1 + 1e-6 * np.arange(n)) @ orthogonal(rng, n),
        orthogonal(rng, n) @ np.diag(10.0 ** -np.linspace(0, 6, n)) @ orthogonal(rng, n), np.outer(rng.normal(size=n), rng.normal(size=n)),
        orthogonal(rng, n) @ np.diag(np.repeat(np.arange(n, 0, -1.0), 3)[:n]) @ orthogonal(rng, n), np.zeros((n, n)),
    ]
    for m in kinds:
        squares, v = bidiagonal.decompose(m, n)
        want = np.linalg.svd(m)[1] ** 2
        top = want[0] or 1.0
        assert np.abs(squares - want[: len(squares)]).max(initial=0) < 1e-13 * top and (np.diff(squares) <= 0).all()
        assert np.abs(v.T @ v - np.eye(len(squares))).max(initial=0) < 1e-8
        assert np.abs(m.T @ (m @ v) - v * squares).max(initial=0) < 1e-13 * top
        assert len(squares) == (0 if not m.any() else n)


def test_tall_tables_reduce_to_the_same_triangle():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(500, 12))
    r = None
    for i in range(0, 500, 70):
        r = bidiagonal.block_qr(r, x[i : i + 70])
    assert np.allclose(r.T @ r, x.T @ x)
