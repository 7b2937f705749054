"""Near-duplicates by the similarity of their sets of word runs.

Two documents are linked if their sets of five-word runs have a Jaccard similarity of 0.8 or more. Candidates meet under
bands of a min-hash signature; a pair at 0.8 shares no band with a probability of 5e-8, more similar pairs even less. Of what
meets, only rows with a partner whose signature agrees in more than half go on, each pair under its first common band (a
pair at 0.8 agrees less with a probability under 1e-9). Their sets are then compared as they are, so every link is exact,
and a component is walked from one of its rows: what is already reached is not compared again. Equal sets are one node.
SimHash alone does not serve here: pairs at 0.8 lie up to 14 of 64 bits apart, and bit blocks for such a radius hold three or
four bits each. ``keep_one`` with a radius takes its links as well, so that a component holds what either of the two links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .common import FILE, ROW, groups_of, located
from .simhash import drop_others, fingerprint, named, shingle_hashes
from .simhash import links as bit_links

SHINGLE, SEED = 5, 42
#: Similarity of a link, as a fraction.
LIKE = (4, 5)
#: Bands of a signature and min-hashes of a band.
BANDS, BAND = 32, 4
#: Min-hashes, of all, in which a pair agrees before its sets are compared.
AGREE = 70
#: Rows and word runs that one comparison cell takes; more under one band are split into pairs of parts.
CELL_ROWS, CELL_RUNS = 1024, 2_000_000
_DRAW = np.random.default_rng(SEED)
_FLIP = _DRAW.integers(0, 2**64, BANDS * BAND, dtype=np.uint64)
_ODD = _DRAW.integers(0, 2**64, BANDS * BAND, dtype=np.uint64) | np.uint64(1)


def runs(text: str) -> np.ndarray:
    """The hashes of a text's runs of words, ascending, each once."""
    return np.unique(np.array(shingle_hashes(text, SHINGLE), np.uint64))


def bands(said: np.ndarray) -> np.ndarray:
    """The min-hash signature, a number for each band: 16 bits of each of its min-hashes."""
    least = np.full(BANDS * BAND, ~np.uint64(0))
    for i in range(0, len(said), 2048):
        mixed = (said[i : i + 2048, None] ^ _FLIP) * _ODD
        np.minimum(least, (mixed ^ mixed >> np.uint64(29)).min(axis=0), out=least)
    return least.astype(np.uint16).view(np.int64)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    for batch in batches:
        for i in range(0, batch.num_rows, 512):
            part = batch.slice(i, 512)
            sets = [runs(t.as_py()) for t in part["text"]]
            fp = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            rest = [n for n in part.schema.names if n != "text"]
            columns = [
                *(part[n] for n in rest), pa.array(fp), pa.array(np.array([len(s) for s in sets], np.int32)),
                pa.array([bands(s) for s in sets], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, [*rest, "fp", "n", "keys"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 512):
            part = batch.slice(i, 512)
            yield pa.RecordBatch.from_arrays([part["fp"], pa.array([runs(t.as_py()).tobytes() for t in part["text"]], pa.binary())], ["fp", "runs"])


def links(rows: DataFrame, texts: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Links (u, v) between distinct sets ``fp``: in each cell a spanning forest of all its links."""
    num, den = LIKE
    met = rows.select("fp", "n", F.posexplode("keys").alias("band", "key")).distinct()
    # Of two linked sets the smaller has at least 4/5 of the larger's runs; what has no such neighbour under a key is alone.
    by_size = Window.partitionBy("band", "key").orderBy("n")
    below, above = F.lag("n").over(by_size) * den >= F.col("n") * num, F.col("n") * den >= F.lead("n").over(by_size) * num
    met = met.withColumn("met", F.coalesce(below, F.lit(False)) | F.coalesce(above, F.lit(False)))
    met = stage(met.where("met").select("band", "key", "fp", "n"), "near-met")
    parts = F.ceil(F.greatest(F.count(F.lit(1)) / cell_rows, F.sum("n") / CELL_RUNS)).cast("int")
    large = met.groupBy("band", "key").agg(parts.alias("m")).where("m > 1")
    own = F.pmod(F.xxhash64("fp"), F.col("m")).cast("int")
    cells = F.when(F.col("m").isNull(), F.array(F.lit("0"))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda j: F.concat_ws(":", F.least(j, own), F.greatest(j, own)))
    )
    cell = met.join(large, ["band", "key"], "left").select("band", "key", "fp", "n", F.explode(cells).alias("c"))
    cell = cell.select(F.xxhash64("band", "key", "c").alias("cell"), "band", "fp", "n")
    signed = rows.join(met.select("fp").distinct(), "fp", "left_semi").groupBy("fp").agg(F.first("keys").alias("keys"))
    alike = cell.join(signed, "fp").repartition("cell").sortWithinPartitions("cell").mapInArrow(_alike, "cell long, fp long")
    alike = stage(alike, "near-alike")
    # One row of each set gives its text.
    owner = rows.join(alike.select("fp").distinct(), "fp", "left_semi").groupBy("fp").agg(F.min(F.struct(FILE, ROW)).alias("at"))
    owner = owner.select("fp", F.col("at")[FILE].alias(FILE), F.col("at")[ROW].alias(ROW))
    sets = texts.select(FILE, ROW, "text").join(owner, [FILE, ROW]).select("fp", "text").mapInArrow(_runs, "fp long, runs binary")
    return alike.join(sets, "fp").repartition("cell").sortWithinPartitions("cell").mapInArrow(_compare, "u long, v long")


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a cell that have a partner in it, by size and signature, whose first common band is the cell's."""
    num, den = LIKE
    cells, fps, n = [], [], 0
    for group in groups_of(batches, ["cell"]):
        m = group.num_rows
        if m < 2:
            continue
        size, fp = (group.column(c).to_numpy().astype(np.int64) for c in ("n", "fp"))
        keys = group.column("keys").combine_chunks().flatten().to_numpy().reshape(m, BANDS)
        marks, band, some = np.ascontiguousarray(keys).view(np.uint16), group.column("band")[0].as_py(), np.zeros(m, bool)
        for i in range(0, m, 64):
            near = (size[i : i + 64, None] * den >= size * num) & (size * den >= size[i : i + 64, None] * num)
            near &= (marks[i : i + 64, None] == marks).sum(axis=2) >= AGREE
            near &= (keys[i : i + 64, None] == keys).argmax(axis=2) == band
            near[np.arange(len(near)), np.arange(i, i + len(near))] = False
            some |= near.any(axis=0)
        if some.any():
            cells.append(group.column("cell").to_numpy()[some])
            fps.append(fp[some])
            n += len(fps[-1])
        if n > 65536:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cells)), pa.array(np.concatenate(fps))], ["cell", "fp"])
            cells, fps, n = [], [], 0
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cells)), pa.array(np.concatenate(fps))], ["cell", "fp"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for group in groups_of(batches, ["cell"]):
        if group.num_rows > 1:
            fp = group.column("fp").to_numpy(zero_copy_only=False)
            root = forest([np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("runs")])
            linked = np.flatnonzero(root != np.arange(len(root)))
            if len(linked):
                yield pa.RecordBatch.from_arrays([pa.array(fp[linked]), pa.array(fp[root[linked]])], ["u", "v"])


def forest(sets: list[np.ndarray]) -> np.ndarray:
    """For each set the first one of its component; links are exact. No set is empty."""
    num, den = LIKE
    root = np.arange(len(sets))
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    names, flat = np.unique(np.concatenate(sets), return_inverse=True)
    own = np.split(flat, np.cumsum(size)[:-1])
    # The sets that no component has reached yet, one after the other in `flat`.
    left, alive = root.copy(), np.ones(len(sets), bool)
    for seed in range(len(sets)):
        if not alive[seed]:
            continue
        alive[seed], queue = False, [seed]
        while queue:
            i = queue.pop()
            if 2 * np.count_nonzero(alive[left]) < len(left):
                left = left[alive[left]]
                flat = np.concatenate([own[k] for k in left]) if len(left) else flat[:0]
            if not len(left):
                break
            held = np.zeros(len(names), bool)
            held[own[i]] = True
            shared = np.add.reduceat(held[flat], np.cumsum(size[left]) - size[left], dtype=np.int64)
            near = left[alive[left] & (shared * (num + den) >= num * (size[left] + size[i]))]
            alive[near], root[near] = False, seed
            queue.extend(near.tolist())
    return root


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = np.array([fingerprint(t.as_py()) for t in batch["text"]], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch[FILE], batch[ROW], pa.array(out)], [FILE, ROW, "bits"])


def fingerprint_links(rows: DataFrame, texts: DataFrame, radius: int) -> DataFrame:
    """Links (u, v) between sets ``fp`` whose texts have SimHash fingerprints at most ``radius`` bits apart.

    One set stands for all sets of a fingerprint; the others link to it.
    """
    bits = texts.select(FILE, ROW, "text").mapInArrow(_fingerprints, f"{FILE} string, {ROW} long, bits long")
    sets = stage(bits.join(rows.select(FILE, ROW, "fp"), [FILE, ROW]).select("bits", "fp").distinct(), "near-bits")
    first = stage(sets.groupBy("bits").agg(F.min("fp").alias("first")), "near-fingerprints")
    same = sets.join(first, "bits").where("fp <> first").select(F.col("fp").alias("u"), F.col("first").alias("v"))
    u, v = (first.select(F.col("bits").alias(c), F.col("first").alias(f"{c}_first")) for c in "uv")
    apart = bit_links(first.select(F.col("bits").alias("fp")), radius).join(u, "u").join(v, "v")
    return same.unionAll(apart.select(F.col("u_first").alias("u"), F.col("v_first").alias("v")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int | None = None) -> DataFrame:
    """Of each component the row with the smallest id (a null id last), with all its columns.

    With a ``radius``, texts whose SimHash fingerprints differ in at most so many bits are linked too.
    """
    docs = located(docs)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), FILE, ROW)
    rows = stage(texts.mapInArrow(_sets, f"doc_id long, {FILE} string, {ROW} long, fp long, n int, keys array<long>"), "near-sets")
    nodes = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "near-nodes")
    edges = links(rows, texts)
    if radius is not None:
        edges = edges.unionAll(fingerprint_links(rows, texts, radius))
    return drop_others(docs, named(rows.select("doc_id", FILE, ROW, "fp"), nodes, edges))
