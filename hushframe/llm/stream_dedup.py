"""Exact deduplication by a stateful stream.

A log of (digest, identifier, content locator) runs as a stream into keyed state on disk that never expires: for each
digest the state keeps the stable identifier and the locator of the row that stays, and the number of rows. A digest
alone decides nothing: rows whose digest was seen before are compared byte for byte with the content at the locator,
and where a digest stands for different texts, the texts themselves make the groups.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stage, work_folder
from .common import FILE, ROW, located

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    # One bounded block cache and write buffer for all partitions of an executor.
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4",
    # A partition's store is closed after its batch: an executor holds as many as it has running tasks.
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    # Many small stores: none reserves megabytes of disk for a log of kilobytes.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
HOLDER = "struct<doc_id:bigint,file:string,row:bigint>"


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def mark(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, files_per_batch: int = 256,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, digest, and the row's place.

    Of rows with identical texts (null counts as empty) the one with the largest id stays; a null id is smaller than
    any other. Of rows that repeat both id and text exactly one is marked as kept. An empty table gives no rows.
    Other columns are not read. ``files_per_batch``: files of the log that one micro-batch takes.
    """
    spark = docs.sparkSession
    docs = located(docs)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    seen = docs.select(F.col(id_col).cast("long").alias("doc_id"), digest(text).alias("digest"), F.col(FILE).alias("file"), F.col(ROW).alias("row"))
    log_path = work_folder(spark, "dedup-log")
    seen.write.parquet(log_path)
    log = spark.read.schema(seen.schema).parquet(log_path)
    classes = _holders(spark, log_path, seen.schema, files_per_batch)

    # Hits: rows whose digest has another row, with their whole text.
    several = classes.where("n > 1").select("digest", "holder", "n")
    hits = stage(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), digest(text).alias("digest"), F.col(FILE).alias("file"), F.col(ROW).alias("row"), text.alias("text"))
        .join(several.select("digest", "holder"), "digest"),
        "dedup-hits",
    )
    at_holder = (F.col("file") == F.col("holder.file")) & (F.col("row") == F.col("holder.row"))
    # All texts of a digest are the holder's if the least and the greatest are equal; they are combined before the shuffle,
    # so a digest with a third of all rows costs one row for each task.
    ends = hits.groupBy("digest").agg(F.min("text").alias("least"), F.max("text").alias("greatest"))
    mixed = stage(ends.where(F.col("least") != F.col("greatest")).select("digest"), "dedup-mixed")
    split = hits.join(mixed, "digest", "left_semi")
    by_text = split.groupBy("digest", "text").agg(F.max(F.struct("doc_id", "file", "row")).alias("holder"), F.count(F.lit(1)).alias("n"))

    plain = log.join(mixed, "digest", "left_anti").join(classes, "digest")
    apart = split.drop("holder").join(by_text, ["digest", "text"])
    columns = [
        "doc_id", F.col("holder.doc_id").alias("keep_id"), F.col("n").alias("group_size"), at_holder.alias("kept"), "digest",
        F.col("file").alias(FILE), F.col("row").alias(ROW),
    ]
    return plain.select(columns).unionByName(apart.select(columns))


def _holders(spark: SparkSession, log_path: str, schema, files_per_batch: int) -> DataFrame:
    """The state after the whole log: digest, holder, n."""
    out = work_folder(spark, "dedup-state")
    before = {k: spark.conf.get(k, None) for k in STATE}
    for key, value in STATE.items():
        spark.conf.set(key, value)
    try:
        keyed = (
            spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(log_path)
            .groupBy("digest").agg(F.max(F.struct("doc_id", "file", "row")).alias("holder"), F.count(F.lit(1)).alias("n"))
        )
        # A batch that runs again after a failure writes the same folder again.
        query = (
            keyed.writeStream.outputMode("update")
            .foreachBatch(lambda rows, batch: rows.write.mode("overwrite").parquet(f"{out}/batch={batch}"))
            .option("checkpointLocation", work_folder(spark, "dedup-checkpoint"))
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    spark.createDataFrame([], f"digest string, holder {HOLDER}, n bigint").write.mode("append").parquet(f"{out}/batch=-1")
    changes = spark.read.schema(f"digest string, holder {HOLDER}, n bigint").parquet(out)
    # Holder and count only grow, so the last of a key's changes is the largest. Written, so that joins with it can split a
    # digest that has many rows.
    return stage(changes.groupBy("digest").agg(F.max("holder").alias("holder"), F.max("n").alias("n")), "dedup-classes")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows that stay, with all their columns."""
    docs = located(docs)
    dropped = mark(docs.drop(FILE, ROW), **options).where("not kept").select(FILE, ROW)
    return docs.join(dropped, [FILE, ROW], "left_anti").drop(FILE, ROW)
