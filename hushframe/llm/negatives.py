"""Hard negatives of anchors, scored with packed products.

Vectors become integers. The components of many candidates in one dimension are raised above zero and written side by
side into the fields of one wide integer. An anchor multiplies that integer by its own component, once, and adds up the
products of all dimensions: every field then holds the exact inner product with one candidate, but for a known constant.
Fields are so wide that none runs into its neighbour, whatever the components.

Anchors and candidates are dealt into blocks, and each pair of blocks (a cell) is one group of a shuffle, so a task holds
two blocks of bounded size. A first pass over the cells scores only rows of the anchor's label and finds the positives;
the second scores the others and keeps, for each anchor and positive, the best few in its range of scores. Both hand on
a bounded number of rows for each anchor and cell, which a window merges.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .common import partitions

#: Rows in a block of anchors and in one of candidates.
ANCHORS, CANDIDATES = 1024, 2048
LONG_MIN, LONG_MAX = -(1 << 63), (1 << 63) - 1


class Packed:
    """Candidates' components in the fields of wide integers, one integer for each dimension.

    A field has ``width`` bytes, enough for the product with any anchor whose absolute components sum to ``most``.
    """

    def __init__(self, rows: np.ndarray, most: int):
        self.count, dims = rows.shape
        self.low = int(rows.min(initial=0)) if dims else 0
        self.range = (int(rows.max(initial=0)) if dims else 0) - self.low
        bits = max(1, (most * self.range).bit_length())
        self.width = 4 if bits <= 32 else -(-bits // 64) * 8
        # Above zero the difference always fits 64 bits without a sign, also where it wraps as one with a sign.
        raised = (rows.astype(np.uint64) - np.uint64(self.low % (1 << 64))).T
        fields = np.zeros((dims, self.count, self.width // 4), "<u4")
        fields[:, :, 0] = raised & np.uint64(0xFFFFFFFF)
        if self.width > 4:
            fields[:, :, 1] = raised >> np.uint64(32)
        self.wide = [int.from_bytes(f.tobytes(), "little") for f in fields]
        self.ones = int.from_bytes((b"\x01" + bytes(self.width - 1)) * self.count, "little")

    def scores(self, anchor: list[int]) -> np.ndarray:
        """Exact inner products with all candidates; a score beyond a long's range becomes the nearest long."""
        # Negative components take at most this much from a field; with it added first, no field falls below zero.
        lift = -sum(a for a in anchor if a < 0) * self.range
        total = lift * self.ones
        for a, w in zip(anchor, self.wide, strict=True):
            if a:
                total += a * w
        shift, most = self.low * sum(anchor) - lift, sum(map(abs, anchor)) * self.range
        raw = total.to_bytes(self.width * self.count, "little")
        if self.width <= 8 and most + abs(shift) <= LONG_MAX:
            return np.frombuffer(raw, f"<u{self.width}").astype(np.int64) + shift
        exact = [int.from_bytes(raw[i : i + self.width], "little") + shift for i in range(0, len(raw), self.width)]
        return np.array([min(max(s, LONG_MIN), LONG_MAX) for s in exact], np.int64)


def matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    """Lists of integers as rows of ``dims`` numbers; a shorter list is zero beyond its end."""
    lists = column.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(lists).to_numpy(zero_copy_only=False)
    if (lengths == dims).all():
        return flat.reshape(len(lengths), dims)
    out = np.zeros((len(lengths), dims), np.int64)
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def _widest(*tables: pa.Table) -> int:
    return max(pc.max(pc.list_value_length(t["x"])).as_py() or 0 for t in tables)


def _first(scores: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Of the places ``at``, in order, the first ``n`` by falling score; of equal scores the earlier place."""
    if len(at) > 4 * n:
        # Ties with the n-th stay for the sort.
        kept = scores[at]
        at = at[kept >= np.partition(kept, len(kept) - n)[len(kept) - n]]
    return at[np.argsort(-scores[at].astype(object) if scores[at].min(initial=0) == LONG_MIN else -scores[at], kind="stable")][:n]


def clean(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 256, flip: Column | None = None) -> DataFrame:
    """``row``, ``vec_id``, ``label``, ``x`` of the rows that take part, written out. ``flip`` marks rows whose label becomes (label+1)%10."""
    vector, label = F.col(vector_col).cast("array<double>"), F.col(label_col).cast("long")
    usable = label.isNotNull() & vector.isNotNull() & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    label = label if flip is None else F.when(flip, (label + 1) % 10).otherwise(label)
    rows = table.where(usable).select(
        F.col(id_col).cast("long").alias("vec_id"), label.alias("label"), F.transform(vector, lambda c: F.floor(c * scale)).alias("x")
    )
    # The numbers are written, so that they are the same whenever the table is read.
    return stage(rows.select(F.monotonically_increasing_id().alias("row"), "*"), "vectors")


def _cells(anchors: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables with the cell (``a``, ``c``) of each block of the one and block of the other; dealt alike, a cell or two to a task.

    Each anchor goes to every block of candidates and each candidate to every block of anchors: a searched set in blocks.
    """
    a, c = (max(1, -(-t.count() // size)) for t, size in ((anchors, ANCHORS), (rows, CANDIDATES)))
    tasks = max(partitions(rows), min(2 * a * c, 100_000))
    own = lambda blocks: F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    return (
        anchors.withColumn("a", own(a)).withColumn("c", every(c)).repartition(tasks, "a", "c"),
        rows.withColumn("c", own(c)).withColumn("a", every(a)).repartition(tasks, "a", "c"),
    )


def _ordered(rows: pa.Table, *first: str) -> pa.Table:
    """By id, those without one behind; rows of one id by their number."""
    return rows.sort_by([*((f, "ascending") for f in first), ("vec_id", "ascending"), ("row", "ascending")])


def _emit(schema: pa.Schema, parts: list[list[np.ndarray]]) -> pa.Table:
    if not parts:
        return schema.empty_table()
    return pa.table([pa.array(np.concatenate(p), t) if not isinstance(p[0], pa.Array) else pa.concat_arrays(p) for p, t in zip(zip(*parts, strict=True), schema.types, strict=True)], schema=schema)


def _runs(labels: np.ndarray) -> Iterator[tuple[int, int]]:
    yield from pairwise([0, *(np.flatnonzero(labels[1:] != labels[:-1]) + 1).tolist(), len(labels)])


def positives(rows: DataFrame, anchors: DataFrame, n: int) -> DataFrame:
    """For each anchor its first ``n`` other rows of the same label: row (the anchor's), place (from 1), positive_row, positive_id, positive_score."""
    schema = pa.schema([("row", pa.int64()), ("positive_row", pa.int64()), ("positive_id", pa.int64()), ("positive_score", pa.int64())])

    def score(asked: pa.Table, held: pa.Table) -> pa.Table:
        if not asked.num_rows or not held.num_rows:
            return schema.empty_table()
        dims = _widest(asked, held)
        held = _ordered(held, "label")
        anchor, most = _anchors(asked, dims)
        row, ids, labels = held["row"].to_numpy(), held["vec_id"].combine_chunks(), held["label"].to_numpy()
        x, of = matrix(held["x"], dims), asked["label"].to_numpy()
        parts = []
        # Rows of one label lie together: an anchor meets those of its own label only.
        for a, b in _runs(labels):
            mine = np.flatnonzero(of == labels[a])
            if not len(mine):
                continue
            packed = Packed(x[a:b], most)
            for i in mine.tolist():
                own = asked["row"][i].as_py()
                scores = packed.scores(anchor[i])
                at = _first(scores, np.flatnonzero(row[a:b] != own), n)
                parts.append([np.full(len(at), own), row[a:b][at], ids.slice(a, b - a).take(pa.array(at)), scores[at]])
        return _emit(schema, parts)

    asked, held = _cells(anchors, rows)
    found = asked.groupBy("a", "c").cogroup(held.groupBy("a", "c")).applyInArrow(score, "row long, positive_row long, positive_id long, positive_score long")
    best = Window.partitionBy("row").orderBy(F.desc("positive_score"), F.asc_nulls_last("positive_id"), "positive_row")
    return found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= n)


def _anchors(asked: pa.Table, dims: int) -> tuple[list[list[int]], int]:
    """Anchors as Python integers, and the largest sum of absolute components."""
    anchor = matrix(asked["x"], dims).tolist()
    return anchor, max(sum(map(abs, a)) for a in anchor)


def negatives(rows: DataFrame, anchors: DataFrame, n: int, low: int, high: int) -> DataFrame:
    """For each anchor and entry of its ``wanted`` (place, score) the first ``n`` rows of another label in range:
    row, place, rank, negative_row, negative_id, negative_score."""
    schema = pa.schema([("row", pa.int64()), ("place", pa.int32()), ("negative_row", pa.int64()), ("negative_id", pa.int64()), ("negative_score", pa.int64())])

    def score(asked: pa.Table, held: pa.Table) -> pa.Table:
        if not asked.num_rows or not held.num_rows:
            return schema.empty_table()
        dims = _widest(asked, held)
        held = _ordered(held)
        anchor, most = _anchors(asked, dims)
        packed = Packed(matrix(held["x"], dims), most)
        row, ids, labels = held["row"].to_numpy(), held["vec_id"].combine_chunks(), held["label"].to_numpy()
        parts = []
        for i, (own, label, wanted) in enumerate(zip(asked["row"].to_pylist(), asked["label"].to_pylist(), asked["wanted"].to_pylist(), strict=True)):
            # low * positive <= 100 * negative <= high * positive, as whole numbers.
            ranges = [(w["place"], -(-low * w["score"] // 100), high * w["score"] // 100) for w in wanted]
            ranges = [(p, a, b) for p, a, b in ranges if a <= b]
            if not ranges:
                continue
            scores = packed.scores(anchor[i])
            other = (labels != label) & (scores >= max(LONG_MIN, min(a for _, a, _ in ranges))) & (scores <= min(LONG_MAX, max(b for _, _, b in ranges)))
            at = np.flatnonzero(other)
            kept = scores[at]
            for place, least, top in ranges:
                best = _first(scores, at[(kept >= least) & (kept <= top)], n)
                parts.append([np.full(len(best), own), np.full(len(best), place, np.int32), row[best], ids.take(pa.array(best)), scores[best]])
        return _emit(schema, parts)

    asked, held = _cells(anchors, rows)
    found = asked.groupBy("a", "c").cogroup(held.groupBy("a", "c")).applyInArrow(score, "row long, place int, negative_row long, negative_id long, negative_score long")
    best = Window.partitionBy("row", "place").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id"), "negative_row")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)


def mine(rows: DataFrame, is_anchor: Column, n_positives: int = 5, n_negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """Hard negatives among ``rows`` (a table of ``clean``) for those that ``is_anchor`` names.

    One row per anchor, positive and negative: anchor_id, positive_id, rank, negative_id, positive_score, negative_score,
    and the numbers of the three rows. An anchor's positives are the first ``n_positives`` other rows of its label by
    score, ties by smaller id. Negatives have another label and a score from ``low`` to ``high`` hundredths of the
    positive's; a positive of negative score has none. Repeated rows count each, also as positive of one another. Rows
    without an id stand behind those with one. Vectors of different lengths are compared as if the shorter ended in
    zeros. An empty table, or one without anchors, gives no rows.
    """
    anchors = rows.where(is_anchor)
    found = stage(positives(rows, anchors, n_positives), "positives")
    wanted = found.groupBy("row").agg(F.collect_list(F.struct("place", F.col("positive_score").alias("score"))).alias("wanted"))
    asked = stage(anchors.join(wanted, "row"), "anchors")
    best = negatives(rows, asked.select("row", "label", "x", "wanted"), n_negatives, low, high)
    named = asked.select("row", F.col("vec_id").alias("anchor_id"))
    return best.join(found, ["row", "place"]).join(named, "row").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score",
        F.col("row").alias("anchor_row"), "positive_row", "negative_row",
    )
