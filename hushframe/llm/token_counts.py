"""Token counts of whole texts by byte-pair merging.

The vocabulary is a sentencepiece file of the kind BPE with byte fallback. A text starts as a linked list of its
characters. A heap holds the adjacent pairs that make a piece of the vocabulary, and the pair with the lowest rank
(the leftmost of equal ones) is merged until none is left. The count is the number of characters less the number of
merges; a character that the vocabulary lacks counts its UTF-8 bytes. No ids are made.

A merge never passes a place that no piece passes, so texts are cut there first: before a run of blanks, and between
characters of different families (those that pieces of the vocabulary link). A worker remembers the counts of short chunks.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text

LIMIT = 4096
#: Chunks whose counts a worker remembers, and the longest of them in characters.
CACHE, LONG = 400_000, 48
BLANK = "▁"
#: The kinds of pieces in a vocabulary file, and the kind of model.
NORMAL, USER_DEFINED, UNUSED, BPE = 1, 4, 5, 2


class Merges(dict):
    """Chunks to their numbers of tokens, for one vocabulary file."""

    def __init__(self, model_file: str):
        from sentencepiece import sentencepiece_model_pb2

        super().__init__()
        model = sentencepiece_model_pb2.ModelProto()
        with open(model_file, "rb") as f:
            model.ParseFromString(f.read())
        norm, kinds = model.normalizer_spec, {p.type for p in model.pieces}
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError(f"{model_file} changes texts before it cuts them")
        if model.trainer_spec.model_type != BPE or not model.trainer_spec.byte_fallback or kinds & {USER_DEFINED, UNUSED}:
            raise ValueError(f"{model_file} is not a plain byte-pair vocabulary with byte fallback")
        scores = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        order = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.rank = {piece: order[s] for piece, s in scores.items()}
        self.prefix = BLANK if norm.add_dummy_prefix else ""
        self.cut = re.compile(_cuts(scores), re.DOTALL)
        self.old: dict[str, int] = {}

    def tokens(self, text: str) -> int:
        """Of a whole text; none of an empty one."""
        if len(self) > CACHE:
            # What has not been seen since the last time goes.
            self.old = dict(self)
            self.clear()
        return sum(map(self.__getitem__, self.cut.findall(self.prefix + text.replace(" ", BLANK)))) if text else 0

    def __missing__(self, chunk: str) -> int:
        count = self.old.get(chunk) or self.merged(chunk)
        if len(chunk) <= LONG:
            self[chunk] = count
        return count

    def merged(self, chunk: str) -> int:
        """Symbols left when no adjacent pair makes a piece, in time n log n."""
        rank, n, heap = self.rank.get, len(chunk), []
        # A symbol is known by where it begins: the one behind it begins at `end` (0: merged away), the one before at `before`.
        end, before, count = [*range(1, n + 1)], [*range(-1, n)], n
        for i in range(n - 1):
            if (r := rank(chunk[i : i + 2])) is not None:
                heap.append((r, i, i + 1, i + 2))
        heapify(heap)
        while heap:
            _, left, right, stop = heappop(heap)
            if end[left] != right or end[right] != stop:
                continue  # one of the two has been merged since
            end[left], end[right] = stop, 0
            count -= 1
            if stop < n:
                before[stop] = left
                if (r := rank(chunk[left : end[stop]])) is not None:
                    heappush(heap, (r, left, stop, end[stop]))
            near = before[left]
            if near >= 0 and (r := rank(chunk[near:stop])) is not None:
                heappush(heap, (r, near, left, stop))
        return count + sum(len(c.encode()) - 1 for i, c in enumerate(chunk) if end[i] == i + 1 and c not in self.rank)


def _cuts(pieces: Iterable[str]) -> str:
    """A pattern for chunks whose borders no piece passes: blanks, then characters of one family."""
    family: dict[str, str] = {}

    def head(c: str) -> str:
        while family.setdefault(c, c) != c:
            family[c] = c = family[family[c]]
        return c

    for piece in pieces:
        said = piece.lstrip(BLANK)
        if BLANK in said:
            return ".+"
        if len(piece) > 1 and said:
            for a, b in pairwise(said):
                family[head(a)] = head(b)
            head(said[0])
    members: dict[str, list[str]] = {}
    for c in family:
        members.setdefault(head(c), []).append(c)
    # Large families first, as most texts are made of them.
    kinds = ["".join(sorted(m)) for m in sorted(members.values(), key=len, reverse=True)]
    alone = "".join(map(re.escape, kinds))
    return "|".join([*(f"{BLANK}*[{re.escape(k)}]+" for k in kinds), f"{BLANK}+", f"[^{BLANK}{alone}]+"])


_MERGES: dict[str, Merges] = {}


def merges(model_file: str) -> Merges:
    """One for each worker, so that what it remembers outlives a task."""
    if model_file not in _MERGES:
        _MERGES[model_file] = Merges(model_file)
    return _MERGES[model_file]


def mark(docs: DataFrame, model_file: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens).

    ``model_file`` has to be at this path on every worker. A null or empty text has no tokens. Repeated rows and rows
    without an id are counted like any other; an empty table gives no rows. There is no shuffle; a task holds one batch.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = merges(model_file).tokens
        for batch in batches:
            counted = pa.array([tokens(t.as_py()) for t in batch["text"]], pa.int64())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["n_bytes"], counted], ["doc_id", "n_bytes", "n_tokens"])

    rows = id_and_text(docs, id_col, text_col).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def public_vocabulary(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
