"""Span algebra inside one document row.

A row carries its spans as ``ARRAY<STRUCT<entity_type, start, end, score, text, recognizer>>`` next
to its text, so finding, filtering, resolving and rewriting need no shuffle at all.  ``explode_spans``
gives the long table when spans are the result.

Overlap rules compare spans pairwise only inside a *cluster*, a run of spans that overlap in a chain.
A text with thousands of spans (a log full of addresses) therefore costs one sorted pass, not the
square of its spans.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blocks, cut_blocks, let, strip, walk

SPAN_TYPE = (
    "struct<entity_type:string,start:int,end:int,score:double,text:string,recognizer:string>"
)
SPANS_TYPE = f"array<{SPAN_TYPE}>"


def no_spans() -> Column:
    return F.array().cast(SPANS_TYPE)


def span(entity_type, start, end, score, text, recognizer) -> Column:
    return F.struct(
        entity_type.cast("string").alias("entity_type"),
        start.cast("int").alias("start"),
        end.cast("int").alias("end"),
        score.cast("double").alias("score"),
        text.cast("string").alias("text"),
        recognizer.cast("string").alias("recognizer"),
    )


def changed(s: Column, **fields: Column) -> Column:
    """A span with some other fields."""
    names = ("entity_type", "start", "end", "score", "text", "recognizer")
    return span(*[fields.get(n, s[n]) for n in names])


# Two Unicode noncharacters.  The first marks match borders; a text that holds it itself is searched
# with the second one in its place, which no pattern can tell apart.
MARK, STAND_IN = "\ufdd0", "\ufdd1"


def searched(text: Column) -> Column:
    """The text as it is searched: without the mark."""
    return F.when(text.contains(MARK), F.translate(text, MARK, STAND_IN)).otherwise(text)


def match_parts(body: Column, pattern: str | Column, labelled: bool = False) -> Column:
    """A searched text cut at its matches: gap, label, value, rest, gap, ...; empty without a match.

    One replacing pass marks the borders of all matches, a split at the marks gives the parts.
    """
    rx = pattern if isinstance(pattern, Column) else F.lit(pattern)
    marks = f"{MARK}$1{MARK}$2{MARK}$3{MARK}" if labelled else f"{MARK}{MARK}$0{MARK}{MARK}"
    none = F.array().cast("array<string>")
    return let(F.regexp_replace(body, rx, marks), lambda m: F.when(m.contains(MARK), F.split(m, MARK, -1)).otherwise(none))


def spans_of_parts(parts: Column, entity_type: Column, score: Column, recognizer: Column, stripped: Column, min_chars: Column) -> Column:
    """Spans of the values; the lengths of the parts add up to offsets. ``stripped`` values lose white space at their ends."""

    def step(at: Column, i: Column) -> tuple[Column, Column]:
        gap, label, value, rest = (F.get(parts, i * 4 + k) for k in range(4))
        begin = at + F.length(gap) + F.length(label)
        kept = F.when(stripped, F.length(strip(value))).otherwise(F.length(value))
        found = let(
            kept,
            lambda n: F.when(
                n >= min_chars, F.array(span(entity_type, begin, begin + n, score, F.left(value, n), recognizer))
            ).otherwise(no_spans()),
        )
        return begin + F.length(value) + F.length(rest), found

    count = F.floor(F.size(parts) / 4).cast("int")
    return F.when(count > 0, walk(F.sequence(F.lit(0), count - 1), F.lit(0), SPAN_TYPE, step)).otherwise(no_spans())


def own_texts(text: Column, spans: Column) -> Column:
    """Spans of a text that was searched with the stand-in get their values from the text itself."""
    from_text = let(
        blocks(text), lambda b: F.transform(spans, lambda s: changed(s, text=cut_blocks(b, s["start"], s["end"])))
    )
    return F.when(text.contains(MARK), from_text).otherwise(spans)


def scan(
    text: Column,
    pattern: str | Column,
    entity_type: str,
    score: float,
    recognizer: str,
    *,
    labelled: bool = False,
    min_chars: int = 1,
) -> Column:
    """All matches of a pattern as spans.

    ``labelled`` patterns are three groups, label, value and rest; the span is the value without
    surrounding white space.  A pattern column serves terms that differ from row to row.
    """
    spans = let(
        match_parts(searched(text), pattern, labelled),
        lambda parts: spans_of_parts(
            parts, F.lit(entity_type), F.lit(score), F.lit(recognizer), F.lit(labelled), F.lit(min_chars if labelled else 0)
        ),
    )
    return let(spans, lambda found: own_texts(text, found))


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (a["end"] > b["start"])


def width(a: Column) -> Column:
    return a["end"] - a["start"]


def _sorted(spans: Column, *keys: Callable[[Column], Column]) -> Column:
    """Order by the keys; the built-in order of structs needs no comparing expression."""
    keyed = F.transform(
        spans, lambda s: F.struct(*[key(s).alias(f"k{i}") for i, key in enumerate(keys)], s.alias("item"))
    )
    return F.transform(F.sort_array(keyed), lambda k: k["item"])


def by_position(spans: Column) -> Column:
    """Order by start; ties by longer, then better score, then type and recognizer."""
    return _sorted(
        spans,
        lambda s: s["start"], lambda s: -s["end"], lambda s: -s["score"], lambda s: s["entity_type"], lambda s: s["recognizer"],
    )


def by_strength(spans: Column) -> Column:
    """Order by score, then length, both descending; ties by start and type."""
    return _sorted(
        spans,
        lambda s: -s["score"], lambda s: -width(s), lambda s: s["start"], lambda s: s["entity_type"], lambda s: s["recognizer"],
    )


def _chains(spans: Column, out_type: str, close: Callable[[Column], Column]) -> Column:
    """Walk the chains of overlapping spans by position; ``close`` turns a chain into output."""

    def step(state: Column, item: Column) -> tuple[Column, Column]:
        joins = item["start"] < state["reach"]
        after = F.struct(
            F.when(joins, F.concat(state["chain"], F.array(item))).otherwise(F.array(item)).alias("chain"),
            F.when(joins, F.greatest(state["reach"], item["end"])).otherwise(item["end"]).alias("reach"),
        )
        return after, F.when(joins, F.array().cast(f"array<{out_type}>")).otherwise(close(state["chain"]))

    start = F.struct(no_spans().alias("chain"), F.lit(0).alias("reach"))
    return walk(by_position(spans), start, out_type, step, lambda state: close(state["chain"]))


def per_cluster(spans: Column, rule: Callable[[Column], Column]) -> Column:
    """Apply ``rule`` to each chain of overlapping spans; input and output are ordered by position."""
    return _chains(spans, SPAN_TYPE, lambda chain: F.when(F.size(chain) > 1, rule(chain)).otherwise(chain))


def _drop_contained(chain: Column) -> Column:
    def hidden(x: Column, y: Column) -> Column:
        inside = (y["start"] <= x["start"]) & (x["end"] <= y["end"]) & (y["score"] >= x["score"])
        return inside & (width(y) > width(x))

    return F.filter(chain, lambda x: ~F.exists(chain, lambda y: hidden(x, y)))


def _drop_repeated(chain: Column) -> Column:
    """Of spans equal in type and position keep the best one (the chain is in position order)."""

    def step(acc: Column, item: Column) -> Column:
        known = F.exists(
            acc,
            lambda y: (y["start"] == item["start"])
            & (y["end"] == item["end"])
            & (y["entity_type"] == item["entity_type"]),
        )
        return F.when(known, acc).otherwise(F.concat(acc, F.array(item)))

    return F.aggregate(chain, no_spans(), step)


def remove_contained(spans: Column) -> Column:
    """Drop a span strictly inside a longer one whose score is at least its own."""
    return per_cluster(spans, _drop_contained)


def remove_repeated(spans: Column) -> Column:
    return per_cluster(spans, _drop_repeated)


def clean_spans(spans: Column) -> Column:
    """``remove_repeated`` and ``remove_contained`` in one pass."""
    return per_cluster(spans, lambda chain: let(_drop_repeated(chain), _drop_contained))


def _greedy(chain: Column) -> Column:
    def step(acc: Column, item: Column) -> Column:
        blocked = F.exists(acc, lambda kept: overlaps(item, kept))
        return F.when(blocked, acc).otherwise(F.concat(acc, F.array(item)))

    return by_position(F.aggregate(by_strength(chain), no_spans(), step))


def resolve_overlaps(spans: Column) -> Column:
    """Best score first, then longer; keep what overlaps nothing kept; ordered by start."""
    return per_cluster(spans, _greedy)


def first_wins(spans: Column) -> Column:
    """Walk by start and skip every span that begins before the last kept one ends."""

    def step(reach: Column, item: Column) -> tuple[Column, Column]:
        keep = item["start"] >= reach
        return F.when(keep, item["end"]).otherwise(reach), F.when(keep, F.array(item)).otherwise(no_spans())

    return walk(by_position(spans), F.lit(0), SPAN_TYPE, step)


def splice(
    text: Column,
    spans: Column,
    inserts: Column,
    plain: Callable[[Column], Column] = lambda c: c,
) -> Column:
    """Text with each span replaced by the insert of the same index; spans must be disjoint and sorted.

    ``plain`` is applied to the stretches between the spans.
    """
    pairs = F.zip_with(
        spans,
        inserts,
        lambda s, i: F.struct(s["start"].alias("start"), s["end"].alias("end"), i.alias("put")),
    )

    def joined(b: Column) -> Column:
        def step(at: Column, part: Column) -> tuple[Column, Column]:
            return part["end"], F.array(plain(cut_blocks(b, at, part["start"])), part["put"])

        pieces = walk(pairs, F.lit(0), "string", step)
        tail = plain(cut_blocks(b, F.get(spans, F.size(spans) - 1)["end"], F.length(text)))
        return F.array_join(F.concat(pieces, F.array(tail)), "")

    return F.when(F.size(spans) == 0, plain(text)).otherwise(let(blocks(text), joined))


def explode_spans(df: DataFrame, keys: list[str], spans: str = "spans") -> DataFrame:
    """Long span table: the key columns and one row per span.

    The coalesce keeps the optimizer from adding a non-empty filter on the column, which would compute
    the whole detection again below the projection.
    """
    return df.select(*keys, F.inline(F.coalesce(F.col(spans), no_spans())))


def clusters(spans: Column) -> Column:
    """Chains of overlapping spans as ``ARRAY<ARRAY<span>>``."""
    none = F.array().cast(f"array<{SPANS_TYPE}>")
    return _chains(spans, SPANS_TYPE, lambda chain: F.when(F.size(chain) > 0, F.array(chain)).otherwise(none))


def overlap_pairs(df: DataFrame, key: str = "doc_id", spans: str = "spans") -> DataFrame:
    """Each pair of overlapping spans of a document, the earlier one first.

    Only spans of one cluster meet, so a long document does not produce the square of its spans.
    """
    chain = df.select(key, F.explode(clusters(F.col(spans))).alias("chain"))
    left = chain.select(key, "chain", F.posexplode("chain").alias("i", "a"))
    # The chain is ordered by start, so a later span overlaps if it begins before this one ends.
    later = F.filter(
        F.slice(F.col("chain"), F.col("i") + 2, F.size("chain")),
        lambda b: (b["start"] < F.col("a.end")) & (b["end"] > F.col("a.start")),
    )
    return left.select(key, "a", F.explode(later).alias("b"))


#: Code points of a bin of the interval join.
BIN = 4096


def interval_join(
    left: DataFrame, right: DataFrame, key: str = "doc_id", rule: Callable[[Column, Column], Column] = overlaps, bin_size: int = BIN
) -> DataFrame:
    """Pairs of rows of two long tables (key, start, end, ...) of one document that share a place: (key, a, b).

    Rows meet on (document, bin of offsets) and are then held against ``rule``, which must ask for a shared character, so a
    document with a third of all rows is spread over its bins and nothing is gathered.  A pair that shares several bins
    comes from the first.  Rows without a key, an offset or any character meet nothing.
    """

    def binned(rows: DataFrame, name: str) -> DataFrame:
        whole = F.struct(*[F.col(c) for c in rows.columns if c != key]).alias(name)
        first, last = F.floor(F.col("start") / bin_size).cast("int"), F.floor((F.col("end") - 1) / bin_size).cast("int")
        return rows.where(F.col("start") < F.col("end")).select(F.col(key), whole, F.explode(F.sequence(first, last)).alias("__bin"))

    met = binned(left, "a").join(binned(right, "b"), [key, "__bin"])
    both = F.greatest(F.col("a.start"), F.col("b.start"))
    return met.where(rule(F.col("a"), F.col("b")) & (F.floor(both / bin_size) == F.col("__bin"))).drop("__bin")
