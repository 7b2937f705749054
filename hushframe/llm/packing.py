"""Best-fit packing by bin completion.

Only lengths matter to a packing, and there are at most ``capacity`` of them, so the search runs over the counts of each
length: a table of bounded size, however many documents there are. Bin completion takes the largest length left, looks
at the fillings around it that no other filling dominates, and prunes by the waste that a better packing may still have;
best-fit decreasing gives the first incumbent. The answer is a list of patterns (lengths of a sequence, how many such
sequences). Pieces are then numbered within their length and find their sequence and offset by a join on
(length, range of numbers).
"""

from __future__ import annotations

import os
import re
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .common import id_and_text, partitions

CAPACITY, END_ID = 2048, 0
#: Distinct chunks of text whose ids a worker remembers.
CACHE = 400_000
#: Nodes that the search may open, and fillings that it may look at for each.
NODES, LOOKS = 6_000, 50
#: Nodes of the search, the deepest ones, that hold tables of sums (up to ``capacity`` numbers of ``capacity`` bits each).
LIVE = 32

Pattern = tuple[tuple[int, ...], int]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences that any packing needs: by volume, by number, and by lengths that can't share a sequence (Martello and Toth)."""
    best = -(-sum(n * c for n, c in counts.items()) // capacity)
    # Of the lengths from one on, at most so many as of the smallest of them share a sequence.
    number = 0
    for n in sorted(counts, reverse=True):
        number += counts[n]
        best = max(best, -(-number // (capacity // n)))
    for small in sorted({n for n in counts if 2 * n <= capacity} | {0}):
        whole = sum(c for n, c in counts.items() if n > capacity - small)
        half = {n: c for n, c in counts.items() if capacity - small >= n and 2 * n > capacity}
        rest = sum(n * c for n, c in counts.items() if small <= n and 2 * n <= capacity)
        free = sum(c * (capacity - n) for n, c in half.items())
        best = max(best, whole + sum(half.values()) + max(0, -(-(rest - free) // capacity)))
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing over counts: sequences with equal contents are one pattern."""
    open_bins: dict[int, list[Pattern]] = {}
    rooms: list[int] = []  # room left, ascending, of the patterns in open_bins
    done: list[Pattern] = []

    def put(room: int, pattern: Pattern) -> None:
        if not room:
            done.append(pattern)
            return
        if room not in open_bins:
            open_bins[room] = []
            insort(rooms, room)
        open_bins[room].append(pattern)

    for n in sorted(counts, reverse=True):
        left = counts[n]
        while left:
            at = bisect_left(rooms, n)
            if at == len(rooms):
                # New sequences; one takes as many of this length as it holds, the last what is left.
                each = capacity // n
                full, over = divmod(left, each)
                if full:
                    put(capacity - each * n, ((n,) * each, full))
                if over:
                    put(capacity - over * n, ((n,) * over, 1))
                break
            room = rooms[at]
            lengths, times = open_bins[room].pop()
            if not open_bins[room]:
                del open_bins[room], rooms[at]
            each = min(room // n, left)
            use = min(times, left // each)
            if use < times:
                put(room, (lengths, times - use))
            put(room - each * n, (lengths + (n,) * each, use))
            left -= use * each
    return done + [p for bins in open_bins.values() for p in bins]


def fillings(room: int, counts: dict[int, int]) -> Iterator[tuple[int, ...]]:
    """Fillings of ``room`` by any number of the lengths left, least waste first; of equal waste larger parts first.

    Sums that the smaller lengths can make are known as bits, so the search by depth never takes a part that leads nowhere.
    """
    have = sorted(n for n, c in counts.items() if c and n <= room)
    if not have:
        yield ()
        return
    # Bit s of the k-th: the k smallest lengths can make the sum s.
    sums, mask = [1], (1 << room + 1) - 1
    for n in have:
        made, left, k = sums[-1], min(counts[n], room // n), 1
        while left:
            k = min(k, left)
            made |= made << n * k & mask
            left, k = left - k, 2 * k
        sums.append(made)

    def fill(total: int, k: int) -> Iterator[tuple[int, ...]]:
        if not total:
            yield ()
            return
        # The largest part is one of the k smallest lengths; without it, and without any smaller, the sum is out of reach.
        for at in range(min(k, bisect_left(have, total + 1)) - 1, -1, -1):
            if not sums[at + 1] >> total & 1:
                return
            n = have[at]
            for times in range(min(counts[n], total // n), 0, -1):
                if sums[at] >> total - times * n & 1:
                    for rest in fill(total - times * n, at):
                        yield (n,) * times + rest

    for total in range(room, 0, -1):
        if sums[-1] >> total & 1:
            yield from fill(total, len(have))


def dominated(filling: tuple[int, ...], waste: int, have: list[int], counts: dict[int, int]) -> bool:
    """Whether another filling is at least as good: one with a further length, or with a larger one in place of one or two.

    One filling dominates another if the other's lengths can be put, in parts, into places no smaller than theirs. The first
    of ``fillings`` never is.
    """
    used = Counter(filling)
    # What a larger length could take the place of: nothing, one part, or two (then it may also be as large as both).
    places = {(0, 1)} | {(n, n + 1) for n in used}
    places |= {(a + b, a + b) for a, c in used.items() for b in used if a < b or a == b and c > 1}
    for size, least in places:
        for at in range(bisect_left(have, least), bisect_left(have, size + waste + 1)):
            if counts[have[at]] > used[have[at]]:
                return True
    return False


class _Node:
    """A place in the search: the largest length left there, and how far its fillings have been tried."""

    __slots__ = ("top", "tries", "seen", "waste", "step")

    def __init__(self, top: int):
        self.top, self.tries, self.seen, self.waste, self.step = top, None, 0, 0, None


def complete(counts: dict[int, int], capacity: int, nodes: int | None = NODES) -> list[Pattern]:
    """A packing of few sequences: branch and bound over bin completions, started from best-fit decreasing.

    ``nodes`` bounds the search; with None it goes on until the packing is proven to be the smallest. The counts of what is left are
    one table, changed on the way down and put back on the way up. Only the LIVE deepest nodes hold tables of their own;
    an earlier one makes them again when the search comes back to it.
    """
    left = {n: c for n, c in counts.items() if c}
    best = best_fit(left, capacity)
    best_size, floor, total = sum(t for _, t in best), lower_bound(left, capacity), sum(n * c for n, c in left.items())
    lengths, unplaced, used, waste = sorted(left, reverse=True), sum(left.values()), 0, 0
    looks = None if nodes is None else nodes * LOOKS
    stack: list[_Node] = []

    def deeper() -> None:
        # The largest length is in any filling of the node, so one of it is set aside.
        stack.append(_Node(next(n for n in lengths if left[n])))
        left[stack[-1].top] -= 1
        if len(stack) > LIVE:
            stack[-1 - LIVE].tries = None

    if left:
        deeper()
    while stack and best_size > floor and (nodes is None or nodes > 0 and looks > 0):
        node = stack[-1]
        if node.step is not None:
            filling, times = node.step
            for n in filling:
                left[n] += times
            left[node.top] -= 1
            unplaced, used, waste = unplaced + times * len(filling), used - times, waste - times * node.waste
            node.step = None
        # A better packing wastes at most this much in all its sequences together; later fillings waste more.
        slack = (best_size - 1) * capacity - total - waste
        filling, times = None, 0
        if node.waste <= slack:
            if node.tries is None:
                node.tries = islice(_tries(node.top, left, capacity), node.seen, None)
            filling, times = next(node.tries, (None, 0))
        if filling is None or capacity - sum(filling) > slack:
            left[node.top] += 1
            stack.pop()
            continue
        node.seen, node.waste = node.seen + 1, capacity - sum(filling)
        if nodes is not None:
            looks -= 1
        if not times or times * node.waste > slack:
            continue
        if nodes is not None:
            nodes -= 1
        for n in filling:
            left[n] -= times
        left[node.top] += 1
        node.step, unplaced, used, waste = (filling, times), unplaced - times * len(filling), used + times, waste + times * node.waste
        if unplaced:
            deeper()
        elif used < best_size:
            best_size, best = used, [at.step for at in stack]
    return best


def _tries(top: int, left: dict[int, int], capacity: int) -> Iterator[tuple[tuple[int, ...], int]]:
    """Every filling around ``top``, as often as it fits and then, on the way back, less often; 0 times if dominated."""
    have = sorted(n for n, c in left.items() if c)
    for f in fillings(capacity - top, left):
        filling = (top, *f)
        if dominated(f, capacity - sum(filling), have, left):
            yield filling, 0
            continue
        for times in range(min((left[n] + (n == top)) // k for n, k in Counter(filling).items()), 0, -1):
            yield filling, times


#: Chunks of ASCII and Latin-1 letters: no normal form to find, each letter has one lower-case letter.
SIMPLE = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
#: How the vocabulary file cuts a chunk into words, for the characters of SIMPLE in lower case.
CUT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
#: Byte-level vocabularies write printable Latin-1 bytes as themselves and the others from U+0100 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = dict(zip(_PRINTABLE, map(chr, _PRINTABLE), strict=True)) | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


class Encoder(dict):
    """Chunks to ids, as little-endian unsigned 32-bit.

    White space always separates words of this vocabulary, so the ids of a text are those of its chunks between ASCII
    white space. Chunks and words repeat, and a worker remembers the ids of many. The usual chunks are cut here and only
    their words go to the vocabulary; all others pass the whole tokenizer.
    """

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.whole = Tokenizer.from_file(tokenizer_file)
        self.model = self.whole.model
        self.words: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        for remembered in (self, self.words):
            if len(remembered) > CACHE:
                remembered.clear()
        return b"".join(map(self.__getitem__, text.encode().split()))

    def __missing__(self, chunk: bytes) -> bytes:
        text = chunk.decode()
        if SIMPLE.fullmatch(text) and "<|" not in text:
            ids = b"".join([self.words.get(w) or self.word(w) for w in CUT.findall(text.lower())])
        else:
            ids = np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        self[chunk] = ids
        return ids

    def word(self, word: str) -> bytes:
        tokens = self.model.tokenize("".join(map(BYTE_CHARS.__getitem__, word.encode())))
        self.words[word] = ids = b"".join([t.id.to_bytes(4, "little") for t in tokens])
        return ids


_ENCODERS: dict[str, Encoder] = {}


def encoder(tokenizer_file: str) -> Encoder:
    """One for each worker, so that what it remembers outlives a task."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    if tokenizer_file not in _ENCODERS:
        _ENCODERS[tokenizer_file] = Encoder(tokenizer_file)
    return _ENCODERS[tokenizer_file]


def pieces(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of each document: doc_id, piece, start, length, ids (binary). Only a document's last is shorter than the capacity."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer_file).encode, END_ID.to_bytes(4, "little")
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                rows = [
                    (doc_id, p, p * capacity, min(capacity, len(said) // 4 - p * capacity), said[4 * p * capacity : 4 * (p + 1) * capacity])
                    for doc_id, said in zip(part["doc_id"].to_pylist(), [encode(t) + end for t in part["text"].to_pylist()], strict=True)
                    for p in range(-(-len(said) // (4 * capacity)))
                ]
                columns = zip(*rows, strict=True)
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "piece", "start", "length", "ids"])

    return id_and_text(docs, id_col, text_col).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids binary")


def pack(found: DataFrame, capacity: int = CAPACITY, nodes: int | None = NODES) -> DataFrame:
    """``sequence_id`` and ``offset`` for rows with a ``length`` from 1 to ``capacity``.

    ``found`` is read several times: give a written table. Rows of equal length are interchangeable, so any numbering
    of them gives a packing of the same size. Sequence numbers are gapless; an empty table gives none.
    """
    spark = found.sparkSession
    # At most `capacity` rows, whatever the input.
    counts = {r.length: r["count"] for r in found.groupBy("length").count().collect()}
    places, first, taken = [], 0, Counter()
    for lengths, times in complete(counts, capacity, nodes):
        offset = 0
        of = Counter(lengths)
        slot = Counter()
        for n in lengths:
            # Of the numbers of this length, `of[n]` go to each copy of the pattern in turn.
            places.append((n, taken[n], of[n], times, slot[n], first, offset))
            slot[n] += 1
            offset += n
        for n, k in of.items():
            taken[n] += k * times
        first += times
    # As long as the list of patterns, which the counts bound.
    table = spark.createDataFrame(
        places or [(0, 0, 1, 0, 0, 0, 0)], "length long, lowest long, each long, times long, slot long, first long, offset long"
    ).select("length", "lowest", F.struct("each", "times", "slot", "first", "offset").alias("place"))
    by_length = table.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("lowest", "place"))).alias("places"))
    numbered = number(found, "length", "rank")
    # The patterns of a length in order of their numbers; the last that begins at or before a rank holds it.
    inside = F.filter("places", lambda p: (p["lowest"] <= F.col("rank")) & (F.col("rank") < p["lowest"] + p["place"]["each"] * p["place"]["times"]))
    at = F.filter(inside, lambda p: F.pmod(F.col("rank") - p["lowest"], p["place"]["each"]) == p["place"]["slot"])[0]
    joined = numbered.join(F.broadcast(by_length), "length").withColumn("at", at)
    copy = F.expr("(rank - at.lowest) div at.place.each")
    return joined.select(*found.columns, (F.col("at.place.first") + copy).alias("sequence_id"), F.col("at.place.offset").alias("offset"))


def number(rows: DataFrame, group: str, name: str) -> DataFrame:
    """Gapless numbers from 0 within ``group``; a group of any size is numbered in parts that stand behind one another."""
    parts = partitions(rows)
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64(*rows.columns), F.lit(parts)).cast("int"))
    sizes = dealt.groupBy(group, "_part").count()
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(group, "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(group, "_part").orderBy(*[c for c in rows.columns if c != group])
    return dealt.withColumn("_row", F.row_number().over(within)).join(sizes, [group, "_part"]).withColumn(name, F.col("_before") + F.col("_row") - 1).drop("_part", "_before", "_row")


def mark(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", nodes: int | None = NODES) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. ``nodes`` bounds the search (see ``complete``).

    A document is its ids and one id 0, so an empty or null text is one piece of length 1. Repeated rows and null ids
    are packed like any other row. An empty table gives no rows.
    """
    cut = pieces(docs, tokenizer_file, capacity, id_col, text_col)
    # Not in Python: a second Python step would be a second worker for each task, with all it remembers.
    cut = cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(stage(cut, "pieces"), capacity, nodes)


def public_tokenizer(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)

