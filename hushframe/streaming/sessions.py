"""Answers meeting their session while both arrive as streams."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..constants import SESSION_TTL_SECONDS
from ..operators.rehydrate import rehydrate, replacements_made
from .runs import use_rocksdb


def join_sessions(
    responses: DataFrame, sessions: DataFrame, ttl: int = SESSION_TTL_SECONDS, late: str = "1 hour"
) -> DataFrame:
    """Responses with the map of a session that is at most ``ttl`` seconds old; ``status`` is ``missing`` without one.

    ``sessions(session_id, mapping, created_at)`` expire by the interval bound: once the watermark is
    past a session's end, Spark drops it from the join state, and an answer that can no longer meet a session comes
    out as missing.  Rows later than ``late`` are dropped; ``late_rows`` counts them.
    """
    use_rocksdb(responses.sparkSession)
    asked = responses.withWatermark("asked_at", late)
    opened = sessions.withColumnRenamed("session_id", "sid").withWatermark("created_at", late)
    joined = asked.join(
        opened,
        F.expr(
            f"session_id = sid and asked_at >= created_at and asked_at <= created_at + interval {ttl} seconds"
        ),
        "leftOuter",
    )
    alive = F.col("sid").isNotNull()
    return joined.withColumns(
        {
            "status": F.when(alive, F.lit("ok")).otherwise(F.lit("missing")),
            "rehydrated_text": F.when(alive, rehydrate(F.col("text"), F.col("mapping"))),
            "replacements_made": F.when(alive, replacements_made(F.col("text"), F.col("mapping"))),
        }
    ).drop("sid", "mapping", "created_at")


def late_rows(progress: list[dict]) -> int:
    """Rows that a finished query's stateful operators dropped as too late, from its progress reports."""
    return sum(o.get("numRowsDroppedByWatermark", 0) for p in progress for o in p.get("stateOperators", []))


SWEPT = Row("session_id", "created_ms")


class SweepProcessor(StatefulProcessor):
    """Keeps sessions until their lifetime is over and reports each one that goes.

    Rows are (session_id, created_at, created_ms).  A state store is asked through a socket, so what is sure is not asked for.
    """

    def __init__(self, ttl: int):
        self.ttl_ms = ttl * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", "created_ms long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        newest = max(r[2] for r in rows)
        if kept := self.session.get():
            newest = max(newest, kept[0])
            # Only a session that is kept has a timer.
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        self.session.update((newest,))
        # An age of exactly the lifetime is still alive.
        self.handle.registerTimer(newest + self.ttl_ms + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        created = self.session.get()[0]
        self.session.clear()
        yield SWEPT(key[0], created)

    def close(self) -> None:
        pass


def sweep_sessions(sessions: DataFrame, ttl: int = SESSION_TTL_SECONDS, late: str = "0 seconds") -> DataFrame:
    """(session_id, created_ms) of every session whose lifetime is over, once event time is past it; its state is gone.

    A session that is saved again lives on from there.  Rows without a time are left out.
    """
    use_rocksdb(sessions.sparkSession)
    # A write without a time never ends by time: it is left to the batch sweep of the vault.
    rows = sessions.select("session_id", "created_at").where("created_at is not null").withWatermark("created_at", late)
    return rows.withColumn("created_ms", F.unix_millis("created_at")).groupBy("session_id").transformWithState(
        statefulProcessor=SweepProcessor(ttl), outputStructType="session_id string, created_ms long", outputMode="Append",
        timeMode="EventTime",
    )
