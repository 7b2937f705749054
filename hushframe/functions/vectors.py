"""Vector expressions over ``ARRAY<FLOAT>`` / ``ARRAY<DOUBLE>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, null for a zero vector."""
    scale = norm(a) * norm(b)
    return F.when(scale > 0, dot(a, b) / scale)


def histogram(slots: Column, dims: int) -> Column:
    """How often each number from 0 on stands in an array of whole numbers below ``dims``: one sort, one pass."""
    every = F.sequence(F.lit(0).cast("bigint"), F.lit(dims - 1).cast("bigint"))

    def counts(s: Column) -> Column:
        # Where the run of each number ends; each stands once more than it is to be counted.
        ends = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == F.size(s)) | (F.get(s, i) != F.get(s, i - 1)))
        return let(ends, lambda e: F.transform(e, lambda at, d: (at - F.coalesce(F.get(e, d - 1), F.lit(0)) - 1).cast("float")))

    return let(F.sort_array(F.concat(slots, every)), counts)


def unit(a: Column) -> Column:
    """Vector scaled to length one, null for a zero vector."""
    length = norm(a)
    return F.when(length > 0, F.transform(a, lambda x: x.cast("double") / length))


def hashed_word(word: Column, dims: int = 8) -> Column:
    """A word's vector from its MD5: no model needed, equal words are equal, others as good as unrelated."""
    return let(
        F.md5(word),
        lambda h: F.transform(
            F.sequence(F.lit(0), F.lit(dims - 1)),
            lambda i: F.conv(F.substring(h, i * 4 + 1, F.lit(4)), 16, 10).cast("double") / 32768.0 - 1,
        ),
    )


def hashed_text(text: Column, dims: int = 8) -> Column:
    """Sum of the vectors of a text's white-space words."""
    words = F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")
    none = F.array(*[F.lit(0.0)] * dims)
    return F.aggregate(
        F.transform(words, lambda w: hashed_word(w, dims)), none, lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b)
    )
