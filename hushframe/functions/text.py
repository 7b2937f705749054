"""Text expressions with code-point offsets, all JVM-side."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# ``(?U)`` makes \\w \\d \\s \\b follow Unicode, ``(?d)`` leaves \\n as the only line end.
UNICODE = "(?dU)"
UNICODE_ANYCASE = "(?diuU)"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it many times inside ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    """Remove white space of every kind at both ends (``trim`` removes blanks only)."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def fold_key(text: Column) -> Column:
    """Comparison key of an identifier: stripped and lower-cased."""
    return F.lower(strip(text))


def cut(text: Column, start: Column, end: Column) -> Column:
    """Half-open slice ``[start, end)`` in code points."""
    return F.substring(text, start + 1, end - start)


#: Code points of a block.
BLOCK = 1024


def blocks(text: Column) -> Column:
    """A text in blocks of equal length, so that a slice far behind its beginning costs no walk from there."""
    cut_up = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    return F.when(F.length(text) <= BLOCK, F.array(text)).otherwise(cut_up)


def cut_blocks(parts: Column, start: Column, end: Column) -> Column:
    """``cut`` of a text given in blocks."""
    first = F.floor(start / BLOCK).cast("int")
    size = F.greatest(F.floor((end - 1) / BLOCK).cast("int") - first + 1, F.lit(1))
    near = F.when(size == 1, F.get(parts, first)).otherwise(F.array_join(F.slice(parts, first + 1, size), ""))
    return F.coalesce(F.substring(near, start - first * BLOCK + 1, end - start), F.lit(""))


#: Items that a walk takes between two copies of its output.
WALK = 64


def walk(
    items: Column,
    state: Column,
    out_type: str,
    step: Callable[[Column, Column], tuple[Column, Column]],
    last: Callable[[Column], Column] | None = None,
) -> Column:
    """Carry a state along an array and gather what each step gives out.

    ``step`` takes state and item and returns the next state and an array of ``out_type``; ``last`` turns the final
    state into one more array.  The output grows part by part, so an array of many thousand items costs no square.
    """
    none = F.array().cast(f"array<{out_type}>")

    def one(acc: Column, item: Column) -> Column:
        after, out = step(acc["state"], item)
        # Flattened, as concat goes through a lazy list for each item.
        return F.struct(after.alias("state"), F.flatten(F.array(acc["out"], out.cast(f"array<{out_type}>"))).alias("out"))

    def part(acc: Column, chunk: Column) -> Column:
        done = F.aggregate(chunk, F.struct(acc["state"].alias("state"), none.alias("out")), one)
        return let(
            done,
            lambda d: F.struct(d["state"].alias("state"), F.concat(acc["parts"], F.array(d["out"])).alias("parts")),
        )

    def chunked(all_items: Column) -> Column:
        size = F.size(all_items)
        cut_up = F.transform(
            F.sequence(F.lit(0), F.floor((size - 1) / WALK).cast("int")),
            lambda i: F.slice(all_items, i * WALK + 1, F.lit(WALK)),
        )
        return F.when(size > 0, cut_up).otherwise(F.array(all_items))

    start = F.struct(state.alias("state"), F.array().cast(f"array<array<{out_type}>>").alias("parts"))

    def finish(acc: Column) -> Column:
        gathered = F.flatten(acc["parts"])
        return gathered if last is None else F.concat(gathered, last(acc["state"]).cast(f"array<{out_type}>"))

    return F.aggregate(let(items, chunked), start, part, finish)


def html_escape(text: Column) -> Column:
    """The five HTML escapes; the ampersand goes first."""
    for raw, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(escaped))
    return text


def percent(score: Column) -> Column:
    """A share as whole percent, ties to even."""
    return F.concat(F.bround(score * 100, 0).cast("int").cast("string"), F.lit("%"))


def mask_key(key: Column) -> Column:
    """Show the first eight and last four characters of a long key only."""
    return F.when(
        F.length(key) > 12, F.concat(F.left(key, F.lit(8)), F.lit("..."), F.right(key, F.lit(4)))
    ).otherwise(F.lit("***"))


def occurrences(text: Column, term: Column) -> Column:
    """Non-overlapping, case-insensitive count of ``term``."""
    low, needle = F.lower(text), F.lower(term)
    # Bytes are known, characters have to be counted.
    gone = F.octet_length(F.replace(low, needle, F.lit("")))
    return F.when(
        F.octet_length(needle) > 0, ((F.octet_length(low) - gone) / F.octet_length(needle)).cast("bigint")
    ).otherwise(F.lit(0).cast("bigint"))


def line_count(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("bigint")


def file_suffix(name: Column) -> Column:
    """Last suffix with its dot, lower-cased; empty if there is none."""
    return F.lower(F.regexp_extract(name, r"(?s)(\.[^.]*)\z", 1))


def quote(term: str) -> str:
    """A literal inside a Java regular expression."""
    return re.sub(r"([^\w\s])", r"\\\1", term)


def quoted(term: Column) -> Column:
    """The same for a column value."""
    return F.concat(F.lit("\\Q"), F.replace(term, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def replacement(value: Column) -> Column:
    """A value as a literal replacement of ``regexp_replace``."""
    value = F.replace(value, F.lit("\\"), F.lit("\\\\"))
    return F.replace(value, F.lit("$"), F.lit("\\$"))


# A character outside the alphabet whose lower case is a plain letter.
_FOLDS_TO = {"k": "\u212a"}


def any_case(char: str) -> str:
    """One character in either case as an explicit class, quicker than the ignore-case flag."""
    if not char.isalpha():
        return quote(char)
    return "[" + char.lower() + char.upper() + _FOLDS_TO.get(char.lower(), "") + "]"


def word_tree(words: Iterable[str], letter: Callable[[str], str] = any_case) -> str:
    """One any-case pattern for many words that shares common beginnings, longest word first; ``letter`` is that of one character."""
    tree: dict = {}
    for word in words:
        node = tree
        for char in word:
            node = node.setdefault(char, {})
        node[""] = {}

    def render(node: dict) -> str:
        ends = "" in node
        parts = [letter(char) + render(child) for char, child in sorted(node.items()) if char]
        if not parts:
            return ""
        body = parts[0] if len(parts) == 1 and not ends else "(?:" + "|".join(parts) + ")"
        return body + "?" if ends else body

    return render(tree)


def literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def literal_array(values: Iterable[str]) -> Column:
    values = list(values)
    if not values:
        return F.array().cast("array<string>")
    return F.array(*[F.lit(v) for v in values])
