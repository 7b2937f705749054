"""Sharding by vector bin packing.

A group of equal texts is a vector of bytes, tokens and rows, as shares of the whole table. Groups that weigh something
beside a shard are few (their shares are bounded from below, so their number is bounded from above); one that is too large
for a quarter of a shard is cut into parts. All other groups are added up into a fixed number of bundles by a hash of their
text. Groups and bundles are placed in one pass on the driver, largest first, each into the shard whose residual capacity
has the highest dot product with its vector, so the result does not depend on the number of tasks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .common import FILE, ROW, id_and_text, located, partitions

SHARDS = 40
#: Bytes that a row takes beside its text.
ROW_BYTES = 16
#: A group is large from this part of a shard on; a part of a group has at most the second.
LARGE, PART = 1 / 64, 1 / 4
#: Bundles of light groups, so many rows on the driver whatever the input.
BUNDLES = 50_000
MEASURES = ("size", "tokens", "rows")
#: The law is on bytes, so they count most where the measures disagree.
WEIGHTS = np.array([4.0, 1.0, 1.0])


def place(vectors: np.ndarray, residual: np.ndarray) -> np.ndarray:
    """The shard of each vector, largest first; ``residual`` (shards x measures) is used up. Ties go to the first shard."""
    out = np.empty(len(vectors), np.int32)
    for k in np.argsort(-vectors.max(axis=1), kind="stable") if len(vectors) else ():
        out[k] = best = int(np.argmax(residual @ (WEIGHTS * vectors[k])))
        residual[best] -= vectors[k]
    return out


def mark(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``bytes``: the sizes of the shards are nearly equal, and so are their tokens and rows. Equal texts share
    a shard unless they are more than a quarter of one. A null text is empty and has the row's own bytes only. Null ids
    and repeated rows are placed like any other. Slots number the rows of a shard from 0. An empty table gives no rows.
    """
    spark = docs.sparkSession
    text = F.col("text")
    rows = located(stage(
        id_and_text(docs, id_col, text_col).select(
            "doc_id", (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
            (F.length(text) - F.length(F.replace(text, F.lit(" "))) + 1).cast("long").alias("tokens"), F.sha2(text, 256).alias("key"),
        ),
        "shard-rows",
    ))
    sums = [F.sum(m).alias(m) for m in ("size", "tokens")] + [F.count(F.lit(1)).alias("rows")]
    groups = stage(rows.groupBy("key").agg(*sums), "shard-groups")
    totals = groups.agg(*(F.sum(m).cast("double").alias(m) for m in MEASURES)).first().asDict()
    totals = {m: totals[m] or 1.0 for m in MEASURES}
    share = F.greatest(*(F.col(m) / F.lit(totals[m]) for m in MEASURES))
    # At most len(MEASURES) * shards / LARGE groups can have such a share.
    large = groups.where(share >= LARGE / shards).select("key", F.ceil(share * shards / PART).cast("int").alias("parts"))
    rows = rows.join(F.broadcast(large), "key", "left").withColumn("part", F.when(F.col("parts") > 1, F.pmod(F.xxhash64(FILE, ROW), F.col("parts"))).otherwise(F.lit(0)).cast("int"))
    # Parts of large groups, and bundles of all others: both bounded, whatever the input.
    bundle = F.when(F.col("parts").isNull(), F.pmod(F.xxhash64("key"), F.lit(BUNDLES)).cast("int"))
    rows = rows.withColumn("unit", F.when(bundle.isNull(), F.concat_ws(":", "key", "part")).otherwise(bundle.cast("string")))
    units = rows.groupBy("unit").agg(*sums).orderBy("unit").collect()
    residual = np.full((shards, len(MEASURES)), 1 / shards)
    chosen = place(np.array([[r[m] / totals[m] for m in MEASURES] for r in units], float).reshape(-1, len(MEASURES)), residual)
    unit_at = spark.createDataFrame([(r.unit, int(s)) for r, s in zip(units, chosen, strict=True)], "unit string, shard int")
    placed = rows.join(F.broadcast(unit_at), "unit")
    placed = stage(placed.select("doc_id", "size", "text_crc32", "shard"), "shard-placed")
    return _slots(placed, shards).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def _slots(rows: DataFrame, shards: int) -> DataFrame:
    """Gapless numbers in each shard; a shard is numbered in parts that stand behind one another."""
    parts = partitions(rows)
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(parts)).cast("int"))
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("shard", "_part").count().select("shard", "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("shard", "_part").orderBy("doc_id", "text_crc32", "size")
    numbered = dealt.withColumn("_row", F.row_number().over(within)).join(sizes, ["shard", "_part"])
    return numbered.withColumn("slot", F.col("_before") + F.col("_row") - 1)
