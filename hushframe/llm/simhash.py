"""SimHash near-duplicates by tiled exact comparison.

Fingerprints that differ in at most ``radius`` of 64 bits share the value of at least ``blocks - radius`` of ``blocks``
bit blocks, so rows are dealt out by the values of every such choice of blocks and no link is lost. What meets under a
value is sorted by population count and compared tile against tile with exclusive-or and bit counts; pairs of tiles
whose population counts differ by more than the radius are skipped. Equal fingerprints are one node; links become
components by rounds of star contraction in the cluster.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .common import FILE, ROW, groups_of, id_and_text, located

SHINGLE, RADIUS, SEED = 4, 4, 42
TILE = 512
#: Rows that one comparison cell takes; more under one value are split into pairs of parts.
CELL_ROWS = 8192
#: Shingles hashed before their bits are counted.
HASHES = 1 << 17


def shingle_hashes(text: str, shingle: int = SHINGLE) -> list[int]:
    """XXH64 of each run of words; ASCII letters in lower case, words split at ASCII white space."""
    import xxhash

    said = text.encode().lower().split()
    if not said:
        return []
    joined = b" ".join(said)
    if len(said) <= shingle:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    ends = np.cumsum(np.fromiter(map(len, said), np.int64, len(said)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts[: len(said) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)]


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How often each of 64 bits is set, lowest bit first."""
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), HASHES):
        bits = np.unpackbits(hashes[i : i + HASHES].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return total


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    hashes = shingle_hashes(text, shingle)
    if not hashes:
        return 0
    counts = bit_counts(np.array(hashes, np.uint64))
    return int(sum(1 << b for b in np.flatnonzero(2 * counts > len(hashes)).tolist()))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = np.array([fingerprint(t.as_py()) for t in batch["text"]], np.uint64).view(np.int64)
        rest = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*(batch[n] for n in rest), pa.array(out)], [*rest, "fp"])


def links(nodes: DataFrame, radius: int = RADIUS, blocks: int | None = None, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Links (u, v) between distinct fingerprints ``fp`` within the radius: in each cell a spanning forest of all its links."""
    size = nodes.count()
    if blocks is None:
        blocks = radius + 1
        # Longer keys for more nodes, so that about the same number meets under a value.
        while size >> (64 * (blocks - radius) // blocks) > 512:
            blocks += 1
    bits = [64 * k // blocks for k in range(blocks + 1)]
    keys = []
    for t, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(((1 << (bits[k + 1] - bits[k])) - 1) << bits[k] for k in chosen)
        mask -= (mask >> 63) << 64
        keys.append(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(mask).cast("long")).alias("key")))
    dealt = nodes.select("fp", F.bit_count("fp").alias("pop"), F.inline(F.array(*keys)).alias("t", "key"))
    # A value with many rows is compared in cells, one for each pair of its parts.
    large = dealt.groupBy("t", "key").count().where(F.col("count") > cell_rows).select("t", "key", F.ceil(F.col("count") / cell_rows).cast("int").alias("m"))
    dealt = dealt.join(large, ["t", "key"], "left")
    own = F.pmod(F.xxhash64("fp"), F.col("m")).cast("int")
    cells = F.when(F.col("m").isNull(), F.array(F.lit("0"))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda j: F.concat_ws(":", F.least(j, own), F.greatest(j, own)))
    )
    cell = dealt.select("t", "key", F.explode(cells).alias("c"), "fp", "pop")
    cell = cell.select(F.xxhash64("t", "key", "c").alias("cell"), "fp", "pop")
    return cell.repartition("cell").sortWithinPartitions("cell", "pop").mapInArrow(_compare(radius), "u long, v long")


def _compare(radius: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        us, vs, n = [], [], 0
        for group in groups_of(batches, ["cell"]):
            if group.num_rows > 1:
                fp = group.column("fp").to_numpy(zero_copy_only=False)
                root = forest(fp.view(np.uint64), group.column("pop").to_numpy(zero_copy_only=False), radius)
                linked = np.flatnonzero(root != np.arange(len(root)))
                if len(linked):
                    us.append(fp[linked])
                    vs.append(fp[root[linked]])
                    n += len(linked)
            if n > 65536:
                yield _pairs(us, vs)
                us, vs, n = [], [], 0
        if n:
            yield _pairs(us, vs)

    return compare


def _pairs(us, vs) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])


def forest(fp: np.ndarray, pop: np.ndarray, radius: int = RADIUS, tile: int = TILE) -> np.ndarray:
    """For each row (sorted by population count) the first row of its component within the rows given."""
    root = np.arange(len(fp))
    for i in range(0, len(fp), tile):
        for j in range(i, len(fp), tile):
            if int(pop[j]) - int(pop[min(i + tile, len(fp)) - 1]) > radius:
                break  # the counts of all later tiles are farther still
            near = np.bitwise_count(fp[i : i + tile, None] ^ fp[None, j : j + tile]) <= radius
            a, b = np.nonzero(np.triu(near, 1) if i == j else near)
            if len(a):
                _unite(root, a + i, b + j)
    return root


def _unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            return
        np.minimum.at(root, np.maximum(ra[apart], rb[apart]), np.minimum(ra[apart], rb[apart]))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up


def components(edges: DataFrame) -> DataFrame:
    """(u, v): every node u that has a link and is not the smallest of its component, with that smallest node v.

    Large-star and small-star steps, each written to the shared folder, until the links no longer change.
    """
    now = stage(_down(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))), "links")
    mark = _signature(now)
    while True:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _down(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        now = stage(_down(small), "links")
        before, mark = mark, _signature(now)
        if mark == before:
            return now


def _down(edges: DataFrame) -> DataFrame:
    return edges.where("u > v").distinct()


def _signature(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def _grouped(rows: DataFrame, radius: int, blocks: int | None) -> DataFrame:
    """Rows with ``doc_id`` and ``fp`` get ``component_id`` and ``root``, a fingerprint that stands for the component."""
    rows = stage(rows, "fingerprints")
    nodes = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "nodes")
    return named(rows, nodes, links(nodes.select("fp"), radius, blocks))


def named(rows: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows with ``fp`` get ``component_id`` and ``root`` from the links between nodes (``fp``, ``first_id``)."""
    roots = components(edges).withColumnsRenamed({"u": "fp", "v": "root"})
    nodes = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    first = nodes.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rows.join(nodes.join(first, "root").select("fp", "root", "component_id"), "fp")


def mark(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, blocks: int | None = None) -> DataFrame:
    """One row per document: doc_id, fingerprint (hex), component_id (smallest id that links reach).

    A null text is empty; texts without words have fingerprint zero and link like any other. A null id belongs to its
    component but never names it; a component of null ids only has a null name. Repeated rows stay repeated. An empty
    table gives no rows.
    """
    rows = id_and_text(docs, id_col, text_col).mapInArrow(_fingerprints, "doc_id long, fp long")
    return _grouped(rows, radius, blocks).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """Of each component the row with the smallest id (a null id last), with all its columns."""
    docs = located(docs)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), FILE, ROW)
    rows = rows.mapInArrow(_fingerprints, f"doc_id long, {FILE} string, {ROW} long, fp long")
    return drop_others(docs, _grouped(rows, radius, None))


def drop_others(docs: DataFrame, grouped: DataFrame) -> DataFrame:
    """Of each ``root`` the located row with the smallest id stays."""
    grouped = stage(grouped, "groups")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", FILE, ROW)
    first = grouped.groupBy("root").agg(F.min(order).alias("keep"))
    dropped = grouped.join(first, "root").where((F.col("keep")[FILE] != F.col(FILE)) | (F.col("keep")[ROW] != F.col(ROW))).select(FILE, ROW)
    return docs.join(dropped, [FILE, ROW], "left_anti").drop(FILE, ROW)
