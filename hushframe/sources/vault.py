"""The vault: codenames and originals per session, as a partitioned parquet table."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import SESSION_TTL_SECONDS

SCHEMA = "session_id string, codename string, original string, created_at timestamp"


def append(rows: DataFrame, path: str, write_id: str | None = None) -> None:
    """Append mappings; day partitions let a read by age skip whole folders.

    Rebalancing gives each day few files and splits a day that holds most rows.  A write with an id can be repeated: it
    takes the place of what it wrote to the same days before.
    """
    dated = rows.select("session_id", "codename", "original", "created_at").withColumn("day", F.to_date("created_at"))
    dated = dated.withColumn("write", F.lit(write_id or uuid.uuid4().hex))
    writer = dated.hint("rebalance", "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("day", "write").parquet(path)


def days(spark: SparkSession, path: str) -> list[datetime.date]:
    """The days that hold rows, as many as the retention allows."""
    return sorted(r["day"] for r in load(spark, path).select("day").distinct().collect())


def _empty(spark: SparkSession, folder: str, *partitions: str) -> None:
    """Remove all rows below a folder."""
    nothing = spark.createDataFrame([], SCHEMA + "".join(f", {p} string" for p in partitions))
    nothing.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(*partitions).parquet(folder)


def compact(spark: SparkSession, path: str, day: datetime.date, keep: Column | None = None) -> None:
    """The writes of a day as one, each row once; ``keep`` names the rows that stay.

    The new write is there before the old ones go: broken off, it leaves each row at least once, and repeated rows count once.
    """
    rows = load(spark, path).where(F.col("day") == F.lit(day))
    # As many as were written to a day since it was last compacted.
    writes = [r["write"] for r in rows.select("write").distinct().collect()]
    kept = (rows if keep is None else rows.where(keep)).drop("day", "write").distinct()
    kept.write.parquet(f"{path}/day={day}/write=compacted-{uuid.uuid4().hex}")
    for write in writes:
        _empty(spark, f"{path}/day={day}/write={write}")


def sweep(spark: SparkSession, path: str, now, ttl: int = SESSION_TTL_SECONDS) -> None:
    """Remove what is past its lifetime at ``now`` (a timestamp literal): days before its edge as a whole, the edge's day by rows."""
    moment = F.lit(now).cast("timestamp")
    edge = spark.range(1).select(F.to_date(moment - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(ttl)))).first()[0]
    for day in days(spark, path):
        if day < edge:
            _empty(spark, f"{path}/day={day}", "write")
        elif day == edge:
            compact(spark, path, day, ~expired(F.col("created_at"), moment, ttl))


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA + ", day date, write string").parquet(path)


def load_live(spark: SparkSession, path: str, now, ttl: int = SESSION_TTL_SECONDS) -> DataFrame:
    """Rows that are not expired at ``now`` (a timestamp literal); old days are pruned."""
    moment = F.lit(now).cast("timestamp")
    edge = moment - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(ttl))
    rows = load(spark, path)
    return rows.where((F.col("day") >= F.to_date(edge)) & ~expired(F.col("created_at"), moment, ttl))


def expired(created_at: Column, now: Column, ttl: int = SESSION_TTL_SECONDS) -> Column:
    """Strictly older than the lifetime; an age equal to it is still valid."""
    return F.unix_micros(now) - F.unix_micros(created_at) > ttl * 1_000_000


def session_stats(vault: DataFrame, now: Column, ttl: int = SESSION_TTL_SECONDS) -> DataFrame:
    """Number of live and expired sessions at a moment; the latest write up to then decides, later ones are not there yet."""
    sessions = vault.where(F.col("created_at") <= now).groupBy("session_id").agg(F.max("created_at").alias("created_at"))
    gone = expired(F.col("created_at"), now, ttl)
    return sessions.agg(
        F.count_if(~gone).cast("bigint").alias("live"), F.count_if(gone).cast("bigint").alias("expired")
    )


def session_ids(key: Column | None = None) -> Column:
    """A random id, or one derived from a key where runs must repeat."""
    return F.uuid() if key is None else F.sha2(key.cast("string"), 256)
