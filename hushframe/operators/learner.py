"""Finding further identifying terms of a text from what a first pass detected.

Everything stays in the document row.  Proper nouns come from a token array; without a tagger the
default is a capitalised word that does not begin a sentence.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import constants as c
from ..functions.text import UNICODE, fold_key, let, literal_array, walk
from . import recognizers as rec
from . import spans as sp
from . import terms

PROPER = r"(?<=[^\s.!?]\s)\p{Lu}\w*"
PROPER_TOKEN = UNICODE + PROPER
# Possessive: the engine takes the words in a loop, so a list of any length costs no stack.
PROPER_RUN = UNICODE + PROPER + r"+(?: \p{Lu}\w*+)++"
JOINERS = ["und", "and", "&"]


def proper_nouns(text: Column) -> Column:
    """Default tagger: capitalised words inside a sentence, as spans."""
    return sp.scan(text, PROPER_TOKEN, "PROPN", 1.0, "capitalised")


def proper_runs(text: Column) -> Column:
    """Two or more of them in a row, as spans."""
    return sp.scan(text, PROPER_RUN, "PROPN", 1.0, "capitalised_run")


def token_runs(tokens: DataFrame) -> DataFrame:
    """Runs of at least two PROPN rows of a token table (doc_id, idx, start, end, text, pos)."""
    order = W.partitionBy("doc_id").orderBy("idx")
    proper = tokens.where(F.col("pos") == "PROPN")
    island = proper.withColumn("island", F.col("idx") - F.row_number().over(order))
    runs = island.groupBy("doc_id", "island").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda t: t["text"]), " "
        ).alias("text"),
    )
    return runs.where(F.col("n") >= 2).drop("n", "island")


def _together(spans: Column, others: Column) -> Column:
    """Places of spans (kind 0) and others (kind 1) in one array in order of their start; ``at`` is an item's index."""

    def marked(items: Column, kind: int) -> Column:
        return F.transform(
            items, lambda s, i: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"), i.alias("at"))
        )

    return F.sort_array(F.concat(marked(spans, 0), marked(others, 1)))


def _both(items: Column, spans: Column, body: Callable[[Column, Column], Column]) -> Column:
    """``body(items, spans)`` with both computed once, as they are asked for at each step."""
    return let(F.struct(items.alias("items"), spans.alias("spans")), lambda w: body(w["items"], w["spans"]))


def uncovered(candidates: Column, spans: Column) -> Column:
    """Candidates that do not begin inside a span."""
    return _both(candidates, spans, _uncovered)


def _uncovered(candidates: Column, spans: Column) -> Column:
    """The same of computed columns: one walk over spans and candidates together."""

    def step(reach: Column, e: Column) -> tuple[Column, Column]:
        free = (e["kind"] == 1) & (e["start"] >= reach)
        after = F.when(e["kind"] == 0, F.greatest(reach, e["end"])).otherwise(reach)
        return after, F.when(free, F.array(e["at"])).otherwise(_no_places())

    walked = _picked(candidates, walk(_together(spans, candidates), F.lit(0), "int", step))
    return F.when(F.size(spans) > 0, walked).otherwise(candidates)


def untouched(candidates: Column, spans: Column) -> Column:
    """Candidates that share no character with a span."""
    return _both(uncovered(candidates, spans), spans, _not_reaching)


def _not_reaching(candidates: Column, spans: Column) -> Column:
    """Candidates that begin outside all spans and end before the next: a walk from the end."""

    def step(first: Column, e: Column) -> tuple[Column, Column]:
        free = (e["kind"] == 1) & (e["end"] <= first)
        after = F.when(e["kind"] == 0, e["start"]).otherwise(first)
        return after, F.when(free, F.array(e["at"])).otherwise(_no_places())

    backwards = F.reverse(_together(spans, candidates))
    walked = _picked(candidates, walk(backwards, F.lit(2**31 - 1), "int", step))
    return F.when(F.size(spans) > 0, walked).otherwise(candidates)


def _no_places() -> Column:
    return F.array().cast("array<int>")


def _picked(items: Column, places: Column) -> Column:
    return F.transform(places, lambda at: F.get(items, at))


def _frequency(low: Column, term: Column) -> Column:
    return _count(low, F.lower(term))


def _count(low: Column, needle: Column) -> Column:
    # Bytes are known, characters have to be counted.
    gone = F.octet_length(F.replace(low, needle, F.lit("")))
    return ((F.octet_length(low) - gone) / F.octet_length(needle)).cast("int")


#: Known texts that are looked up one by one; more are met by sorting.
FEW_KNOWN = 64


def _known(spans: Column) -> Column:
    """The texts of spans as they are compared."""
    return F.array_distinct(F.filter(F.transform(spans, lambda s: fold_key(s["text"])), lambda k: k.isNotNull()))


def _unknown(texts: Column, known: Column, stop_terms: Sequence[str], min_chars: int) -> Column:
    """Distinct texts that are long enough and neither ``known`` nor stop terms."""
    # The stop terms are a set of constants, looked up as such.
    long = F.filter(F.array_distinct(texts), lambda t: (F.length(t) >= min_chars) & ~F.lower(t).isin(*stop_terms))
    none = F.array().cast("array<string>")

    def sorted_out(w: Column) -> Column:
        """One sort and one walk over both."""
        barred = F.transform(w["barred"], lambda k: F.struct(k.alias("key"), F.lit(0).alias("kind"), F.lit("").alias("term")))
        asked = F.transform(w["long"], lambda t: F.struct(F.lower(t).alias("key"), F.lit(1).alias("kind"), t.alias("term")))

        def step(last: Column, e: Column) -> tuple[Column, Column]:
            free = (e["kind"] == 1) & ~e["key"].eqNullSafe(last)
            return F.when(e["kind"] == 0, e["key"]).otherwise(last), F.when(free, F.array(e["term"])).otherwise(none)

        return walk(F.sort_array(F.concat(barred, asked)), F.lit(None).cast("string"), "string", step)

    def left(w: Column) -> Column:
        fresh = F.filter(w["long"], lambda t: ~F.array_contains(w["barred"], F.lower(t)))
        return F.when(F.size(w["barred"]) == 0, w["long"]).when(F.size(w["barred"]) <= FEW_KNOWN, fresh).otherwise(sorted_out(w))

    # Met by hash: mostly few of the texts are known.
    barred = lambda found: F.array_intersect(F.transform(found, F.lower), known)
    kept = let(long, lambda found: let(F.struct(found.alias("long"), barred(found).alias("barred")), left))
    return F.when(F.size(known) > 0, kept).otherwise(long)


def _rare(text: Column, found: Column) -> Column:
    """Terms that are rare in the text."""
    return let(F.lower(text), lambda low: F.filter(found, lambda t: _frequency(low, t) <= c.TERM_MAX_COUNT))


def _free_texts(candidates: Column, spans: Column) -> Column:
    """Of computed columns."""
    return F.transform(_uncovered(candidates, spans), lambda t: t["text"])


def signal_terms(text: Column, candidates: Column, spans: Column, stop_terms: Sequence[str], min_chars: int) -> Column:
    """Distinct candidate texts that are unknown, uncovered, no stop terms and rare in the text."""
    return let(
        F.struct(candidates.alias("candidates"), spans.alias("spans")),
        lambda w: _rare(text, _unknown(_free_texts(w["candidates"], w["spans"]), _known(w["spans"]), stop_terms, min_chars)),
    )


def proper_terms(text: Column, spans: Column, stop_terms: Sequence[str] = c.DEFAULT_STOP_TERMS) -> Column:
    """Single proper nouns the first pass missed."""
    return signal_terms(text, proper_nouns(text), spans, stop_terms, c.TERM_MIN_CHARS)


def proper_run_terms(text: Column, spans: Column, stop_terms: Sequence[str] = c.DEFAULT_STOP_TERMS) -> Column:
    """Sequences of proper nouns the first pass missed."""
    return signal_terms(text, proper_runs(text), spans, stop_terms, 1)


def model_terms(
    text: Column, annotations: Column, tokens: Column, spans: Column, stop_terms: Sequence[str] = c.DEFAULT_STOP_TERMS, rare: bool = True
) -> Column:
    """Annotated names a type filter dropped: PER and ORG always, MISC if it is made of proper nouns.

    Coverage does not matter here, only whether the text itself is already known.  Without ``rare`` terms are not counted
    in the text, for a caller that does so later.
    """
    found = _named(annotations, tokens, _known(spans), stop_terms)
    return _rare(text, found) if rare else found


def _named(annotations: Column, tokens: Column, known: Column, stop_terms: Sequence[str]) -> Column:
    """``model_terms`` from the known texts, not counted."""

    def proper_only(a: Column) -> Column:
        parts = F.filter(F.split(a["text"], r"(?U)[^\w&]+"), lambda w: w != "")
        return F.forall(
            parts,
            lambda w: w.isin(*JOINERS)
            | F.exists(
                tokens,
                lambda t: (t["text"] == w) & (t["start"] >= a["start"]) & (t["start"] < a["end"]),
            ),
        )

    accepted = F.filter(
        annotations,
        lambda a: a["entity_type"].isin("PER", "ORG") | ((a["entity_type"] == "MISC") & proper_only(a)),
    )
    return _unknown(F.transform(accepted, lambda a: F.trim(a["text"])), known, stop_terms, c.TERM_MIN_CHARS)


def _mean(vectors: Column) -> Column:
    """Direction of the mean of some vectors; null without vectors or without a direction."""

    def add(acc: Column, v: Column) -> Column:
        return F.when(F.size(acc) == 0, v).otherwise(F.zip_with(acc, v, lambda a, b: a + b))

    def unit(total: Column) -> Column:
        length = F.sqrt(F.aggregate(total, F.lit(0.0), lambda acc, x: acc + x * x))
        return let(length, lambda n: F.when(n > 0, F.transform(total, lambda x: x / n)))

    given = F.filter(vectors, lambda v: v.isNotNull())
    return let(F.aggregate(given, F.array().cast("array<double>"), add), unit)


def similar_terms(
    text: Column,
    phrases: Column,
    tokens: Column,
    spans: Column,
    encode: Callable[[Column], Column],
    stop_terms: Sequence[str] = c.DEFAULT_STOP_TERMS,
    threshold: float = c.TERM_SIMILARITY,
    rare: bool = True,
) -> Column:
    """Phrases, clear of all spans, whose mean word vector is close to that of a detected type.

    ``encode`` gives a word's vector (array of doubles) or null; a type's vector is the mean over the tokens inside its
    spans.  ``rare`` as for ``model_terms``.
    """
    found = _similar(uncovered(phrases, spans), tokens, spans, _known(spans), encode, stop_terms, threshold)
    return _rare(text, found) if rare else found


def _similar(
    free: Column, tokens: Column, spans: Column, known: Column, encode: Callable[[Column], Column], stop_terms: Sequence[str],
    threshold: float = c.TERM_SIMILARITY,
) -> Column:
    """``similar_terms`` from the phrases that begin outside all spans and the known texts, not counted."""
    member = "struct<kind:string,vector:array<double>>"

    def inside(w: Column, open_: Column, e: Column) -> tuple[Column, Column]:
        near = F.filter(open_, lambda o: o["end"] > e["start"])
        after = F.when(
            e["kind"] == 0,
            F.flatten(F.array(near, F.array(F.struct(e["end"].alias("end"), F.get(w["spans"], e["at"])["entity_type"].alias("kind"))))),
        ).otherwise(near)
        holders = F.filter(near, lambda o: (e["kind"] == 1) & (o["end"] >= e["end"]))
        return after, F.transform(
            holders, lambda o: F.struct(o["kind"].alias("kind"), encode(F.get(w["tokens"], e["at"])["text"]).alias("vector"))
        )

    def close(w: Column) -> Column:
        members = walk(
            _together(w["spans"], w["tokens"]), F.array().cast("array<struct<end:int,kind:string>>"), member, partial(inside, w)
        )
        centres = let(
            members,
            lambda m: F.transform(
                F.array_distinct(F.transform(m, lambda x: x["kind"])),
                lambda k: _mean(F.transform(F.filter(m, lambda x: x["kind"] == k), lambda x: x["vector"])),
            ),
        )

        def alike(phrase: Column, centre: Column) -> Column:
            dot = F.aggregate(F.zip_with(phrase, centre, lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
            return F.coalesce(dot > threshold, F.lit(False))

        clear = F.transform(_not_reaching(w["free"], w["spans"]), lambda p: F.trim(p["text"]))
        fresh = _unknown(clear, w["known"], stop_terms, c.TERM_MIN_CHARS)
        return let(
            F.filter(centres, lambda v: v.isNotNull()),
            lambda cs: F.filter(
                fresh,
                lambda t: let(
                    _mean(F.transform(F.split(t, r"(?U)\s+"), encode)), lambda v: F.exists(cs, lambda x: alike(v, x))
                ),
            ),
        )

    return let(F.struct(free.alias("free"), tokens.alias("tokens"), spans.alias("spans"), known.alias("known")), close)


def learned_terms(
    text: Column,
    spans: Column,
    *,
    stop_terms: Sequence[str] = c.DEFAULT_STOP_TERMS,
    extra: Sequence[Column] = (),
    limit: int = c.TERMS_PER_TEXT,
) -> Column:
    """Union of the signals, final filters, rarest first, at most ``limit`` per text.

    ``extra`` holds the terms of further signals (``model_terms``, ``similar_terms``).  The limit is the feature itself: a
    text gets no more than that many learned terms.  Terms are counted in their final order, and no longer once
    enough of them occur a single time.
    """
    free = uncovered(F.concat(proper_nouns(text), proper_runs(text)), spans)
    return _learned(text, free, _known(spans), stop_terms, extra, limit)


def _learned(text: Column, free: Column, known: Column, stop_terms: Sequence[str], extra: Sequence[Column], limit: int) -> Column:
    """``learned_terms`` from the phrases that begin outside all spans and the known texts."""
    ranked_type = "struct<n:int,key:string,term:string>"

    def finish(w: Column) -> Column:
        own = F.transform(w["free"], lambda t: t["text"])
        found = _unknown(own, w["known"], stop_terms, c.TERM_MIN_CHARS)
        if extra:
            found = _unknown(F.concat(found, *extra), F.array().cast("array<string>"), stop_terms, c.TERM_MIN_CHARS)
        ordered = F.sort_array(F.transform(found, lambda t: F.struct(F.lower(t).alias("key"), t.alias("term"))))

        def count(singles: Column, e: Column) -> tuple[Column, Column]:
            n = F.when(singles < limit, _count(w["low"], e["key"])).otherwise(F.lit(c.TERM_MAX_COUNT + 1))
            picked = let(
                F.struct(n.alias("n"), e["key"].alias("key"), e["term"].alias("term")),
                lambda x: F.when(x["n"] <= c.TERM_MAX_COUNT, F.array(x)).otherwise(F.array().cast(f"array<{ranked_type}>")),
            )
            return singles + (n == 1).cast("int"), picked

        ranked = walk(ordered, F.lit(0), ranked_type, count)
        return F.transform(F.slice(F.sort_array(ranked), 1, limit), lambda r: r["term"])

    work = F.struct(free.alias("free"), known.alias("known"), F.lower(text).alias("low"))
    return let(work, finish)


def detect_two_pass(
    df: DataFrame,
    text: str = "text",
    *,
    stop_terms: Sequence[str] = c.DEFAULT_STOP_TERMS,
    deny_terms: Sequence[str] = (),
    registry: Sequence[rec.Recognizer] = rec.REGISTRY,
    proper: Column | None = None,
    annotations: Column | None = None,
    encode: Callable[[Column], Column] | None = None,
    into: str = "spans",
    **filters,
) -> DataFrame:
    """Detect, learn terms where something was found, detect again with them.

    The patterns run once: the second pass only adds the spans of the learned terms.  ``proper`` holds the proper nouns of
    a tagger as spans; with it a PERSON needs one inside.  ``annotations`` (an outside model's spans) and ``encode`` (word
    vectors) switch on the second and third signal of learning; they use the built-in tagger where ``proper`` is missing.
    """
    body = F.col(text)
    none = F.array().cast("array<string>")

    def finish(found: Column) -> Column:
        kept = sp.clean_spans(rec.keep_spans(found, **filters))
        return kept if proper is None else person_pos_check(kept, proper)

    # One column for each step: the optimizer keeps columns that are used more than once apart, so each is computed once.
    found = rec.found_spans(text, registry=registry, deny_terms=deny_terms)
    out = df.withColumn("__found", found)
    out = out.withColumn("__first", finish(F.col("__found")))
    first = F.col("__first")
    out = out.withColumn("__nouns", proper_nouns(body))
    # The signals share the phrases outside all spans and the texts that are known.
    out = out.withColumns({"__free": uncovered(F.concat("__nouns", proper_runs(body)), first), "__known": _known(first)})
    free, known = F.col("__free"), F.col("__known")
    nouns = F.col("__nouns") if proper is None else proper
    steps = {}
    if annotations is not None:
        steps["__named"] = _named(annotations, nouns, known, stop_terms)
    if encode is not None:
        steps["__similar"] = _similar(free, nouns, first, known, encode, stop_terms)
    for name, step in steps.items():
        out = out.withColumn(name, F.when(F.size(first) > 0, step).otherwise(none))
    learned = _learned(body, free, known, stop_terms, [F.col(n) for n in steps], c.TERMS_PER_TEXT)
    out = out.withColumn("__learned", F.when(F.size(first) > 0, learned).otherwise(none))
    terms_ = F.col("__learned")
    again = finish(F.concat(F.col("__found"), terms.find_row_terms(body, terms.longest_first(terms_))))
    out = out.withColumn(into, F.when(F.size(terms_) > 0, again).otherwise(first))
    return out.drop("__found", "__first", "__nouns", "__free", "__known", "__learned", *steps)


def person_pos_check(spans: Column, tokens: Column) -> Column:
    """Keep a PERSON only if a proper noun begins inside it."""
    return _both(tokens, spans, _person_pos_check)


def _person_pos_check(tokens: Column, spans: Column) -> Column:
    """The same of computed columns: one walk from the end, with the nearest noun at hand."""

    def step(nearest: Column, e: Column) -> tuple[Column, Column]:
        fine = (e["kind"] == 0) & ((F.get(spans, e["at"])["entity_type"] != "PERSON") | (nearest < e["end"]))
        after = F.when(e["kind"] == 1, e["start"]).otherwise(nearest)
        return after, F.when(fine, F.array(e["at"])).otherwise(_no_places())

    # At one start the noun comes first on the way back, so it counts for the span.
    kept = walk(F.reverse(_together(spans, tokens)), F.lit(2**31 - 1), "int", step)
    return F.when(F.exists(spans, lambda s: s["entity_type"] == "PERSON"), _picked(spans, F.reverse(kept))).otherwise(spans)


def doc_kind(answer: Column) -> Column:
    """Classifier answer reduced to a known kind: first word, lower-cased, without final punctuation."""
    word = F.rtrim(F.lower(F.regexp_extract(answer, r"(?U)^\s*(\S+)", 1)), F.lit(".,;:!?"))
    return F.when(word.isin(*c.DOC_KINDS), word).otherwise(F.lit(c.DEFAULT_KIND))
