"""Duplicate substrings by suffix sorting: which bytes lie in a string that also starts earlier.

Equal strings of ``length`` bytes have the same smallest gram, so every document is cut into runs of strings with one
smallest gram, and runs of a gram meet under its hash: first as hashes only, where equal runs are folded (all but the
first of them are repeats) and grams that occur in one place are dropped; then, for the few that are left, with their
bytes, as pieces. Under each gram the suffixes of the pieces are sorted in two stages and repeats are read off the common
prefixes of neighbours. Grams with very many different pieces are told apart by more of their surroundings first, and
what is still too many is cut into single strings, which are dealt out by themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .common import FILE, ROW, groups_of, located, partitions
from .suffixes import GRAM, repeated, runs

LENGTH = 100
#: Strings of a document cut at once, and bytes of text whose runs leave a task together.
PART, FLUSH = 1 << 21, 1 << 24
#: Pieces under one gram that are sorted together.
MOST_PIECES = 4096
#: Bytes of pieces whose suffixes are sorted at once.
SORTED = 1 << 21
#: Spans of offsets that are told apart under a frequent gram.
SPANS = 4
_GONE = 255  # in place of an offset: the run is a repeat
_FIELDS = [("key", "<i8"), ("hash", "<u8"), ("value", "<u4"), ("start", "<u4"), ("size", "<u4"), ("offset", "u1"), ("mark", "u1")]
_SELF, _FOLDED = 1, 2


def _codec() -> pa.Codec:
    return pa.Codec("zstd", compression_level=1)


def _packed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + _codec().compress(data, asbytes=True)


def _unpacked(data: bytes) -> bytes:
    return _codec().decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """key, doc_id, text: the key is the id where ids tell rows apart, else a number in order of id (null first) and place."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    unclear = rows.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1)
    if not unclear.take(1):
        return rows.select(F.col("doc_id").alias("key"), "doc_id", "text")
    docs = located(docs)
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"), FILE, ROW)
    order = ["doc_id", FILE, ROW]
    ids = stage(ids.repartitionByRange(partitions(ids), *[F.col(c).asc_nulls_first() for c in order]).withColumn("part", F.spark_partition_id()), "substring-ids")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = ids.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    number = F.row_number().over(Window.partitionBy("part").orderBy(*[F.col(c).asc_nulls_first() for c in order]))
    numbered = ids.withColumn("row", number).join(counts, "part").select(FILE, ROW, (F.col("before") + F.col("row")).alias("key"))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), FILE, ROW)
    return stage(texts.join(numbered, [FILE, ROW]).select("key", "doc_id", "text"), "substring-keys")


def _cut(length: int, buckets: int):
    import xxhash

    digest = xxhash.xxh3_64_intdigest

    def runs_of(texts: list[tuple[int, int, bytes]]) -> np.ndarray:
        """``texts``: key, first place, bytes."""
        data = b"".join(t for _, _, t in texts)
        bounds = np.cumsum([0, *(len(t) for _, _, t in texts)])
        start, size, value, offset = runs(np.frombuffer(data, np.uint8), bounds, length)
        doc = np.searchsorted(bounds, start, "right") - 1
        out = np.zeros(len(start), _FIELDS + [("bucket", "<u4")])
        hashes, marks = [], []
        for a, b, g in zip(start.tolist(), (start + size + length - 1).tolist(), offset.tolist(), strict=True):
            piece = data[a:b]
            hashes.append(digest(piece))
            marks.append(_SELF if piece.find(piece[g : g + GRAM], g + 1) >= 0 else 0)
        out["hash"], out["mark"] = np.array(hashes, np.uint64), marks
        out["key"], out["start"] = np.array([k for k, _, _ in texts], np.int64)[doc], start - bounds[doc] + np.array([f for _, f, _ in texts], np.int64)[doc]
        out["value"], out["size"], out["offset"] = value & np.uint64(0xFFFFFFFF), size, offset
        out["bucket"] = (value >> np.uint64(32)) % np.uint64(buckets)
        return out

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, held, found, total = [], 0, [], 0
        for batch in batches:
            for key, text in zip(batch["key"].to_pylist(), batch["text"], strict=True):
                raw = text.as_py().encode()
                # A text is cut in parts that overlap by all but one byte of a string.
                for first in range(0, len(raw) - length + 1, PART):
                    part = raw[first : first + PART + length - 1]
                    texts.append((key, first, part))
                    held += len(part)
                    if held >= PART:
                        found.append(runs_of(texts))
                        total += held
                        texts, held = [], 0
                    if total >= FLUSH:
                        yield _dealt(found)
                        found, total = [], 0
        if texts:
            found.append(runs_of(texts))
        if found:
            yield _dealt(found)

    return cut


def _dealt(found: list[np.ndarray]) -> pa.RecordBatch:
    """Runs by bucket. Of equal runs all but the first are marked."""
    rows = np.concatenate(found)
    order = np.lexsort((rows["start"], rows["key"], rows["hash"], rows["value"], rows["bucket"]))
    rows = rows[order]
    same = (rows["hash"][1:] == rows["hash"][:-1]) & (rows["value"][1:] == rows["value"][:-1]) & (rows["bucket"][1:] == rows["bucket"][:-1])
    rows["mark"][1:][same] |= _FOLDED
    buckets, starts = np.unique(rows["bucket"], return_index=True)
    payloads = []
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(rows)], strict=True):
        part = rows[a:b]
        part = part[np.lexsort((part["start"], part["key"]))]  # ids in order take less room
        payloads.append(_packed(b"".join(np.ascontiguousarray(part[name]).tobytes() for name, _ in _FIELDS)))
    return pa.RecordBatch.from_arrays([pa.array(buckets.astype(np.int32)), pa.array(payloads, pa.binary())], ["bucket", "payload"])


def _runs_in(payload: bytes) -> np.ndarray:
    raw = _unpacked(payload)
    n = len(raw) // np.dtype(_FIELDS).itemsize
    out, at = np.empty(n, _FIELDS), 0
    for name, kind in _FIELDS:
        width = np.dtype(kind).itemsize
        out[name] = np.frombuffer(raw, kind, n, at)
        at += n * width
    return out


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs that are repeats, and the first of equal runs where a gram has different ones or comes twice in one."""
    for group in groups_of(batches, ["bucket"]):
        rows = np.concatenate([_runs_in(p.as_py()) for p in group.column("payload")])
        gone = [rows[rows["mark"] & _FOLDED > 0]]
        rows = rows[rows["mark"] & _FOLDED == 0]
        values, inverse, times = np.unique(rows["value"], return_inverse=True, return_counts=True)
        rows = rows[(times[inverse] > 1) | (rows["mark"] & _SELF > 0)]
        rows = rows[np.lexsort((rows["start"], rows["key"], rows["hash"], rows["value"]))]
        other = rows["value"][1:] != rows["value"][:-1]
        first = np.append(True, other | (rows["hash"][1:] != rows["hash"][:-1])) if len(rows) else np.zeros(0, bool)
        gone.append(rows[~first])
        rows = rows[first]
        values, inverse, times = np.unique(rows["value"], return_inverse=True, return_counts=True)
        rows = rows[(times[inverse] > 1) | (rows["mark"] & _SELF > 0)]
        gone = np.concatenate(gone)
        gone["offset"] = _GONE
        out = np.concatenate([gone, rows])
        for i in range(0, len(out), 65536):
            part = out[i : i + 65536]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part["key"]), pa.array(part["start"].astype(np.int32)), pa.array(part["size"].astype(np.int32)), pa.array(part["offset"].astype(np.int32))],
                ["key", "start", "size", "offset"],
            )


_TOUCHED = "key long, doc_id long, n_bytes long, kept_sha256 string, data binary, gone binary, pieces array<struct<anchor:bigint,start:int,size:int,offset:int,piece:binary>>"


def _touch(length: int):
    """Texts without any mark are done; the others keep their bytes, the repeats known so far, and their pieces."""
    import xxhash

    def touch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                rows = []
                for row in whole.slice(i, 256).to_pylist():
                    data = _unpacked(row["data"])
                    out = {"key": row["key"], "doc_id": row["doc_id"], "n_bytes": len(data), "kept_sha256": None, "data": None, "gone": None, "pieces": None}
                    if not row["marks"]:
                        out["kept_sha256"] = hashlib.sha256(data).hexdigest()
                    else:
                        marks = row["marks"]
                        gone = [(m["start"], m["size"]) for m in marks if m["offset"] == _GONE]
                        out |= {"data": row["data"], "gone": np.array(gone, "<i4").tobytes(), "pieces": []}
                        for m in marks:
                            if m["offset"] != _GONE:
                                piece = data[m["start"] : m["start"] + m["size"] + length - 1]
                                anchor = xxhash.xxh3_64_intdigest(piece[m["offset"] : m["offset"] + GRAM]) - (1 << 63)
                                out["pieces"].append({"anchor": anchor, "start": m["start"], "size": m["size"], "offset": m["offset"], "piece": piece})
                    rows.append(out)
                yield pa.RecordBatch.from_pylist(rows, _touch_schema())

    return touch


def _touch_schema() -> pa.Schema:
    piece = pa.struct([("anchor", pa.int64()), ("start", pa.int32()), ("size", pa.int32()), ("offset", pa.int32()), ("piece", pa.binary())])
    return pa.schema(
        [("key", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("kept_sha256", pa.string()), ("data", pa.binary()), ("gone", pa.binary()), ("pieces", pa.list_(piece))]
    )


def _surroundings(length: int, spans: int = SPANS):
    """Pieces cut so that all strings of one hold the same surroundings of their gram, and dealt out by those.

    A string is told by the first gram in it with the smallest hash and by its span of offsets to that gram; strings of
    one span share the bytes from the farthest offset's end to the nearest one's beginning.
    """
    import xxhash

    width = length - GRAM + 1
    edges = [width * k // spans for k in range(spans + 1)]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                piece, gram = row["piece"], row["piece"][row["offset"] : row["offset"] + GRAM]
                at, i = row["offset"], 0
                while i < row["size"] and at >= 0:
                    for low, high in zip(edges[:-1], edges[1:], strict=True):
                        # Strings i with low <= at - i < high, from the current one on.
                        a, b = max(i, at - high + 1), min(row["size"], at - low + 1)
                        if a < b:
                            # What the strings of this span have in common, whichever of them are here.
                            around = piece[at - low : at - high + 1 + length]
                            rows.append({"anchor": xxhash.xxh3_64_intdigest(bytes([low]) + around) - (1 << 63), "key": row["key"], "start": row["start"] + a, "size": b - a, "piece": piece[a : b + length - 1]})
                    i, at = max(i, at + 1), piece.find(gram, at + 1)
            for i in range(0, len(rows), 4096):
                yield pa.RecordBatch.from_pylist(rows[i : i + 4096], pa.schema([("anchor", pa.int64()), ("key", pa.int64()), ("start", pa.int32()), ("size", pa.int32()), ("piece", pa.binary())]))

    return cut


def _sort(length: int):
    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, docs, starts, held = [], [], [], 0
        for group in groups_of(batches, ["anchor"]):
            if group.num_rows == 1 and group["size"][0].as_py() == 1:
                continue
            pieces += group.column("piece").to_pylist()
            docs.append(group.column("key").to_numpy(zero_copy_only=False))
            starts.append(group.column("start").to_numpy(zero_copy_only=False).astype(np.int64))
            held += sum(map(len, pieces[-group.num_rows :]))
            if held >= SORTED:
                yield _runs_of(*repeated(pieces, np.concatenate(docs), np.concatenate(starts), length))
                pieces, docs, starts, held = [], [], [], 0
        if pieces:
            yield _runs_of(*repeated(pieces, np.concatenate(docs), np.concatenate(starts), length))

    return sort


def _runs_of(key: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    order = np.lexsort((start, key))
    key, start = key[order], start[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(key)))
    return pa.RecordBatch.from_arrays([pa.array(key[first], pa.int64()), pa.array(start[first].astype(np.int32)), pa.array(size.astype(np.int32))], ["key", "start", "size"])


def _finish(length: int):
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                part = whole.slice(i, 256)
                removed, spans, digests, kept = [], [], [], []
                for packed, known, more in zip(part["data"], part["gone"], part["more"].to_pylist(), strict=True):
                    data = _unpacked(packed.as_py())
                    gone = np.frombuffer(known.as_py(), "<i4").reshape(-1, 2).tolist() + [[m["start"], m["size"]] for m in more or ()]
                    merged: list[list[int]] = []
                    for start, size in sorted(gone):
                        end = start + size + length - 1
                        if merged and start <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], end)
                        else:
                            merged.append([start, end])
                    digest, at = hashlib.sha256(), 0
                    for start, end in merged:
                        digest.update(data[at:start])
                        at = end
                    digest.update(data[at:])
                    removed.append(sum(b - a for a, b in merged))
                    spans.append(len(merged))
                    digests.append(digest.hexdigest())
                    kept.append(merged)
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], part["n_bytes"], pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests), pa.array(kept, pa.list_(pa.list_(pa.int64())))],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"],
                )

    return finish


def mark(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", most_pieces: int = MOST_PIECES) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed (byte ranges).

    A byte is removed if a string of ``length`` bytes over it also starts earlier: in a document of smaller id, or earlier
    in the same one. A null id is the smallest; rows that repeat an id count as documents in order of their place. A null
    or short text loses nothing. An empty table gives no rows. ``length`` is at least twice the gram.
    """
    if length < 2 * GRAM:
        raise ValueError(f"length {length} is below {2 * GRAM}")
    rows = keyed(docs, id_col, text_col)
    buckets = partitions(rows)
    cut = rows.select("key", "text").mapInArrow(_cut(length, buckets), "bucket int, payload binary")
    folded = cut.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(_fold, "key long, start int, size int, offset int")
    marks = folded.groupBy("key").agg(F.collect_list(F.struct("start", "size", "offset")).alias("marks"))
    packed = rows.mapInArrow(_pack, "key long, doc_id long, data binary")
    touched = stage(packed.join(marks, "key", "left").select("key", "doc_id", "data", "marks").mapInArrow(_touch(length), _TOUCHED), "substring-texts")

    pieces = touched.select("key", F.inline("pieces"))
    frequent = stage(pieces.groupBy("anchor").count().where(F.col("count") > most_pieces).select("anchor"), "substring-frequent")
    columns = ["anchor", "key", "start", "size", "piece"]
    apart = pieces.join(frequent, "anchor", "left_semi").mapInArrow(_surroundings(length), "anchor long, key long, start int, size int, piece binary")
    apart = stage(apart, "substring-apart")
    still = stage(apart.groupBy("anchor").count().where(F.col("count") > most_pieces).select("anchor"), "substring-still")
    to_sort = pieces.join(frequent, "anchor", "left_anti").select(columns).unionByName(apart.join(still, "anchor", "left_anti").select(columns))
    by_sorting = to_sort.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_sort(length), "key long, start int, size int")

    # Single strings: copies fold under their own bytes, and nothing else can be equal to them.
    single = apart.join(still, "anchor", "left_semi").select("key", "start", "piece", F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("i"))
    single = single.select("key", (F.col("start") + F.col("i")).alias("start"), F.expr(f"substring(piece, i + 1, {length})").alias("said"))
    first = stage(single.groupBy("said").agg(F.min(F.struct("key", "start")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("said", "first"), "substring-first")
    by_folding = single.join(first, "said").where((F.col("key") != F.col("first.key")) | (F.col("start") != F.col("first.start"))).select("key", "start", F.lit(1).alias("size"))

    more = stage(by_sorting.unionByName(by_folding), "substring-repeats").groupBy("key").agg(F.collect_list(F.struct("start", "size")).alias("more"))
    texts = touched.where("data is not null").select("key", "doc_id", "n_bytes", "data", "gone")
    done = texts.join(more, "key", "left").select("doc_id", "n_bytes", "data", "gone", "more").mapInArrow(
        _finish(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<array<long>>"
    )
    whole = touched.where("data is null").select(
        "doc_id", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), "kept_sha256", F.array().cast("array<array<long>>").alias("removed")
    )
    return done.unionByName(whole)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts travel packed: they are the bulk of what is shuffled."""
    for batch in batches:
        data = pa.array([_packed(t.as_py().encode()) for t in batch["text"]], pa.binary())
        yield pa.RecordBatch.from_arrays([batch["key"], batch["doc_id"], data], ["key", "doc_id", "data"])
