"""Benchmark decontamination with an Aho-Corasick automaton over words.

Texts and benchmark items are normalised alike: ASCII letters in lower case, words are runs of ASCII digits, letters
and everything beyond ASCII. The automaton runs over word numbers, so one pass over a text's words finds every window
of every item; hits are word intervals, and those are mapped back to characters of the original text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .common import id_and_text

WINDOW = 10
#: Normalised bytes of benchmark text in one automaton (about 100 bytes of memory for each word of each window).
BLOCK_BYTES = 1 << 20
#: A word in the original text, where letters are not yet in lower case.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words(text: str) -> list[bytes]:
    return text.encode().translate(_FOLD).split()


class Automaton:
    """All windows of some items. ``patterns``: word numbers of a window to the numbers of its items."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        import ahocorasick

        self.ids = [i for i, _ in items]
        self.numbers: dict[bytes, int] = {}
        patterns: dict[tuple[int, ...], set[int]] = {}
        for k, (_, said) in enumerate(items):
            seq = tuple(self.numbers.setdefault(w, len(self.numbers) + 1) for w in said)
            for i in range(max(1, len(seq) - window + 1)) if seq else ():
                patterns.setdefault(seq[i : i + window], set()).add(k)
        self.tree = None
        if patterns:
            self.tree = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
            for seq, owners in patterns.items():
                self.tree.add_word(seq, (len(seq), owners))
            self.tree.make_automaton()
        self.shortest = min(map(len, patterns), default=0)

    def find(self, said: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """Hit word intervals, merged, and the items that occur."""
        merged: list[list[int]] = []
        owners: set[int] = set()
        if self.tree is None or len(said) < self.shortest:
            return merged, owners
        get = self.numbers.get
        numbers = np.array([get(w, 0) for w in said], np.int32)
        # A word of no item ends every match, so the automaton starts anew behind it; stretches too short for any window
        # cannot match.
        ends = np.append(np.flatnonzero(numbers == 0), len(numbers))
        starts = np.append(0, ends[:-1] + 1)
        for k in np.flatnonzero(ends - starts >= self.shortest).tolist():
            first = int(starts[k])
            for end, (n, who) in self.tree.iter(tuple(numbers[first : int(ends[k])].tolist())):
                start = first + end - n + 1
                while merged and start <= merged[-1][1]:
                    start = min(start, merged.pop()[0])
                merged.append([start, first + end + 1])
                owners |= who
        return merged, {self.ids[k] for k in owners}


def mark(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, spans.

    A null or wordless text has no words and no hits; an item without words has no windows. An item's id is taken as
    text, null as empty; items that repeat count once per id. ``spans`` are hit ranges of the original text, in code
    points. A benchmark of more than ``block_bytes`` is cut by items into blocks, each with an automaton of its own
    that all texts pass; a task holds one at a time. Empty tables give no rows or no hits.
    """
    rows = _scanned(id_and_text(docs, id_col, text_col), "text", benchmark, item_col, item_text_col, window, block_bytes)
    return rows.mapInArrow(
        _summary, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, spans array<array<int>>"
    )


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The rows without a hit, with all their columns."""
    rows = _scanned(docs, text_col, benchmark, item_col, item_text_col, window, block_bytes)
    return rows.where(F.size(HITS) == 0).drop(N_WORDS, HITS, ITEMS)


N_WORDS, HITS, ITEMS = "_bench_words", "_bench_hits", "_bench_items"


def _scanned(docs: DataFrame, text_col: str, benchmark: DataFrame, item_col: str, item_text_col: str, window: int, block_bytes: int) -> DataFrame:
    """The rows with the word count, the hit word intervals and the items found."""
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(item_text_col).cast("string"), F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // block_bytes) or 1
    rows = docs.withColumns({N_WORDS: F.lit(0).cast("long"), HITS: F.array().cast("array<array<int>>"), ITEMS: F.array().cast("array<string>")})
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block)
        # Bounded: about block_bytes of items.
        said = spark.sparkContext.broadcast([(r.item, words(r.text)) for r in part.collect()])
        rows = rows.mapInArrow(_scan(said, text_col, window), rows.schema)
        if block + 1 < blocks:
            rows = stage(rows, "decontaminate")
    return rows


def _scan(said, text_col: str, window: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(said.value, window)
        for batch in batches:
            counts, hits, items = [], [], []
            for text, had_hits, had_items in zip(batch[text_col], batch[HITS].to_pylist(), batch[ITEMS].to_pylist(), strict=True):
                text_words = words(text.as_py() or "")
                found, names = automaton.find(text_words)
                counts.append(len(text_words))
                hits.append(_union(had_hits, found))
                items.append(sorted(names.union(had_items)))
            new = {
                N_WORDS: pa.array(counts, pa.int64()),
                HITS: pa.array(hits, pa.list_(pa.list_(pa.int32()))),
                ITEMS: pa.array(items, pa.list_(pa.string())),
            }
            names = batch.schema.names
            yield pa.RecordBatch.from_arrays([new.get(n, batch[n]) for n in names], names)

    return scan


def _union(a: list[list[int]], b: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for start, end in sorted(a + b):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("n_hit", "n_items", "items_sha256", "contaminated", "items", "spans")}
        for text, hits, items in zip(batch["text"], batch[HITS].to_pylist(), batch[ITEMS].to_pylist(), strict=True):
            spans = []
            if hits:
                at = [m.span() for m in WORD.finditer(text.as_py())]
                spans = [[at[a][0], at[b - 1][1]] for a, b in hits]
            n_hit = sum(b - a for a, b in hits)
            # Sorted by code point, which is also the order of UTF-8 bytes.
            for v, known in zip((n_hit, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), n_hit > 0, items, spans), out.values(), strict=True):
                known.append(v)
        types = [pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], batch[N_WORDS], *(pa.array(v, t) for v, t in zip(out.values(), types, strict=True))], ["doc_id", "n_words", *out]
        )
