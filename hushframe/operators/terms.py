"""Deny-list terms: parsing, set operations, and finding them in texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, occurrences, quoted, strip
from ..session import stage
from . import recognizers as rec
from . import spans as sp


def parse(lists: DataFrame, column: str, separator: str = "\n") -> DataFrame:
    """Terms of separated lists: stripped, blanks dropped, with their position."""
    rest = [c for c in lists.columns if c != column]
    return (
        lists.select(*rest, F.posexplode(F.split(column, separator)).alias("pos", "raw"))
        .withColumn("term", strip(F.col("raw")))
        .where(F.col("term") != "")
        .select(*rest, F.col("pos").cast("bigint").alias("pos"), "term")
    )


def merge(persistent: DataFrame, request: DataFrame) -> DataFrame:
    """Union of two (pos, term) lists, persistent terms first, each term at its first place."""
    both = persistent.select(F.lit(0).alias("list"), "pos", "term").unionByName(
        request.select(F.lit(1).alias("list"), "pos", "term")
    )
    return both.groupBy("term").agg(F.min(F.struct("list", "pos")).alias("at")).select(
        F.col("at.list").cast("bigint").alias("list"), F.col("at.pos").cast("bigint").alias("pos"), "term"
    )


def add(known: DataFrame, new: DataFrame) -> DataFrame:
    """Known terms and the new ones that are neither blank nor known."""
    fresh = new.select(strip(F.col("term")).alias("term")).where(F.col("term") != "").distinct()
    return known.select("term").unionByName(fresh.join(known.select("term"), "term", "left_anti"))


def remove(known: DataFrame, gone: DataFrame, any_case: bool = False) -> DataFrame:
    """Known terms without the given ones."""
    if not any_case:
        drop = gone.select(strip(F.col("term")).alias("term")).distinct()
        return known.select("term").join(drop, "term", "left_anti")
    drop = gone.select(F.lower(strip(F.col("term"))).alias("key")).distinct()
    keyed = known.select("term", F.lower("term").alias("key"))
    return keyed.join(drop, "key", "left_anti").select("term")


def find(df: DataFrame, terms: Sequence[str], text: str = "text", into: str = "spans") -> DataFrame:
    """Terms in the order given, as one alternation per text, without a shuffle; ``join_terms`` finds the same faster for
    a long list."""
    found = F.coalesce(rec.find_terms(F.col(text), list(terms)), sp.no_spans())
    return df.withColumn(into, found)


WORD = r"(?U)\w+"


def longest_first(terms: Column) -> Column:
    """An order for terms that have none of their own."""
    keyed = F.transform(terms, lambda t: F.struct((-F.length(t)).alias("n"), t.alias("term")))
    return F.transform(F.sort_array(keyed), lambda k: k["term"])


def row_pattern(terms: Column) -> Column:
    """Alternation of a term array in its order, whole terms, any case."""
    return F.concat(
        F.lit(r"(?diuU)(?<!\w)(?:"), F.array_join(F.transform(terms, quoted), "|"), F.lit(r")(?!\w)")
    )


def find_row_terms(text: Column, terms: Column) -> Column:
    """CUSTOM spans of the terms that stand in the same row; the first term in their order wins at a place."""
    some = F.size(F.coalesce(terms, F.array().cast("array<string>"))) > 0
    found = let(row_pattern(terms), lambda rx: sp.scan(text, rx, "CUSTOM", 1.0, "deny_list"))
    return F.coalesce(F.when(some, found), sp.no_spans())


#: Bits of a filter for each of its hashes, and the most bits of all (8 MB): beyond it more passes that has no partner.
BITS_EACH, MOST_BITS = 16, 1 << 26


def _bits(h: Column, bits: int) -> list[Column]:
    """The places of a hash in a filter of so many bits."""
    return [F.pmod(F.xxhash64(h, F.lit(k)), F.lit(bits)) for k in range(3)]


def _mask(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))


def bloom_filter(hashes: DataFrame, column: str) -> tuple[DataFrame, int]:
    """A Bloom filter of a table of hashes: one row with an array of longs, and its number of bits."""
    bits = 64
    while bits < min(BITS_EACH * hashes.count(), MOST_BITS):
        bits *= 2
    places = hashes.select(F.explode(F.array(*_bits(F.col(column), bits))).alias("at"))
    words = places.groupBy(F.shiftright("at", 6).cast("long").alias("id")).agg(F.bit_or(_mask(F.col("at"))).alias("bits"))
    # No more than MOST_BITS / 64 longs.
    whole = hashes.sparkSession.range(bits // 64).join(words, "id", "left")
    filled = F.array_sort(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))))
    return whole.agg(F.transform(filled, lambda w: w["bits"]).alias("bloom")), bits


def might_hold(bloom: Column, bits: int, h: Column) -> Column:
    """Whether a filter may hold a hash; it holds all that were put in, and few others."""
    found = F.lit(True)
    for place in _bits(h, bits):
        found = found & (F.get(bloom, F.shiftright(place, 6).cast("int")).bitwiseAND(_mask(place)) != 0)
    return found


def run_hash(words: Column) -> Column:
    """One hash of a sequence of word hashes."""
    return F.xxhash64(words)


def _word_runs(hashes: Column, size: Column) -> Column:
    """The hashes of all runs of ``size`` words of an array of word hashes."""
    last = F.size(hashes) - size
    runs = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: run_hash(F.slice(hashes, i + 1, size)))
    return F.when((last >= 0) & (size > 0), runs).otherwise(F.array().cast("array<bigint>"))


def text_runs(df: DataFrame, by_run: DataFrame, key: str, text: str) -> DataFrame:
    """(key, run): the runs of words of each text that may be one of a list (run, words).

    Words are hashed once and runs are hashes of hashes. A Bloom filter of the list is asked before anything is shuffled,
    so what is shuffled is about as much as what is found.
    """
    bloom, bits = bloom_filter(by_run, "run")
    sizes = by_run.agg(F.collect_set("words").alias("sizes"))
    signs = F.regexp_extract_all(F.col(text), F.lit(r"(?U)[^\w\s]"), F.lit(0))
    single = F.transform(F.array_distinct(signs), lambda c: F.xxhash64(c))
    words = F.transform(F.regexp_extract_all(F.lower(F.col(text)), F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w))

    def every(w: Column) -> Column:
        of_signs = F.when(F.array_contains(w["sizes"], 0), single).otherwise(F.array().cast("array<bigint>"))
        return F.array_distinct(F.concat(of_signs, F.flatten(F.transform(w["sizes"], lambda n: _word_runs(w["hashes"], n)))))

    sized = df.select(key, text).withColumn("__sizes", sizes.scalar())
    runs = let(F.struct(words.alias("hashes"), F.col("__sizes").alias("sizes")), every)
    # A subquery can't be asked inside the array, so its elements become rows first; they go no further than this stage.
    return sized.select(key, F.explode(runs).alias("run")).where(might_hold(bloom.scalar(), bits, F.col("run")))


def candidate_terms(df: DataFrame, terms: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, terms): for each text the terms of a long list whose words it holds in a row, in the order of the list.

    Texts and terms meet on a hash of the whole sequence of words of a term, so a first word shared by most terms
    makes no pairs; a term without any word meets texts on its first character.  Each distinct run of a text counts
    once, and only if a Bloom filter of the list lets it pass.  The join follows the measured size of the term list: small
    lists are broadcast, large ones are shuffled and hot runs are split at run time.
    """
    split = F.regexp_extract_all(F.lower(F.col("term")), F.lit(WORD), F.lit(0))
    if "pos" not in terms.columns:
        terms = terms.withColumn("pos", -F.length("term"))
    first = terms.where(F.length("term") > 0).groupBy("term").agg(F.min("pos").alias("pos"))
    own = F.when(F.size(split) > 0, run_hash(F.transform(split, lambda w: F.xxhash64(w)))).otherwise(F.xxhash64(F.left(F.trim("term"), F.lit(1))))
    listed = first.select("term", "pos", F.size(split).alias("words"), own.alias("run"))
    # Written: the filter and the join both read it.
    by_run = stage(
        listed.groupBy("run").agg(F.min("words").alias("words"), F.collect_list(F.struct("pos", "term")).alias("spellings")), "term-runs"
    )
    pairs = text_runs(df, by_run, key, text).join(by_run, "run").select(key, "spellings")
    gathered = pairs.groupBy(key).agg(F.sort_array(F.flatten(F.collect_list("spellings"))).alias("terms"))
    return gathered.select(key, F.transform("terms", lambda t: t["term"]).alias("terms"))


def join_terms(
    df: DataFrame, terms: DataFrame, key: str = "doc_id", text: str = "text", into: str = "spans"
) -> DataFrame:
    """A term list (pos, term) of any length: each text is searched only for the terms whose words it holds in a row.

    Finds what ``find`` finds with the terms in order of ``pos``; a list without that column goes longest first.
    """
    listed = candidate_terms(df, terms, key, text)
    joined = df.join(listed, key, "left")
    low = F.lower(F.col(text))
    present = let(low, lambda t: F.filter(F.col("terms"), lambda x: t.contains(F.lower(x))))
    return joined.withColumn(into, find_row_terms(F.col(text), present)).drop("terms")


def term_counts(df: DataFrame, text: Column, term: Column) -> DataFrame:
    return df.withColumn("frequency", occurrences(text, term))
