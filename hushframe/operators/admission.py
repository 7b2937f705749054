"""Admission of requests: minimum gap per key, daily cap per key, daily cap over all keys.

Only admitted requests count, so the rule is sequential inside a key.  The batch form still never
gathers a hot key: two neighbouring non-empty gap-wide slots always hold an admission, so the first
``2 * key_limit`` slots of a key and day decide everything, and a ranked filter drops the rest before
the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..constants import DAY_LIMIT, KEY_LIMIT, MIN_GAP_SECONDS
from .pseudonym import salted_join

CANDIDATES = "array<struct<us:bigint,id:bigint>>"


def daily_usage(events: DataFrame, key: str, ts: str) -> DataFrame:
    """Requests per UTC day and key."""
    return events.groupBy(F.to_date(ts).alias("day"), F.col(key).alias("key")).agg(
        F.count(F.lit(1)).cast("bigint").alias("requests")
    )


def _greedy(moments: Column, limit: Column, last: Column, gap_us: int) -> Column:
    """Admissions of one key and day: walk in time order, keep what is far enough from the last kept."""

    def step(acc: Column, m: Column) -> Column:
        far = acc["last"].isNull() | (m["us"] - acc["last"] >= gap_us)
        take = far & (F.size(acc["kept"]) < limit)
        return F.struct(
            F.when(take, m["us"]).otherwise(acc["last"]).alias("last"),
            F.when(take, F.concat(acc["kept"], F.array(m))).otherwise(acc["kept"]).alias("kept"),
        )

    start = F.struct(last.cast("bigint").alias("last"), F.array().cast(CANDIDATES).alias("kept"))
    return F.aggregate(moments, start, step, lambda acc: acc["kept"])


def prepare(events: DataFrame, key: str, ts: str, event_id: str) -> DataFrame:
    return events.select(
        F.col(key).alias("key"),
        F.to_date(ts).alias("day"),
        F.unix_micros(F.col(ts).cast("timestamp")).alias("us"),
        F.col(event_id).cast("bigint").alias("id"),
    )


def admitted_requests(
    requests: DataFrame,
    state: DataFrame | None = None,
    *,
    key_limit: int = KEY_LIMIT,
    day_limit: int = DAY_LIMIT,
    min_gap: float = MIN_GAP_SECONDS,
) -> DataFrame:
    """(key, day, us, id) of the admitted requests of ``prepare``-d rows.

    ``state(key, day, us, id)`` holds the requests admitted earlier; it is bounded by the daily cap.
    """
    gap_us = max(1, int(round(min_gap * 1_000_000)))
    # Requests of a key at the same instant: only the first can pass.
    moments = requests.groupBy("key", "day", "us").agg(F.min("id").alias("id"))
    if state is not None:
        past = state.groupBy("key", "day").agg(
            F.max("us").alias("last"), F.count(F.lit(1)).cast("int").alias("used")
        )
        moments = salted_join(moments, past, ["key", "day"], F.col("us"), how="left").where(
            F.col("last").isNull() | (F.col("us") - F.col("last") >= gap_us)
        )
    else:
        moments = moments.withColumns({"last": F.lit(None).cast("bigint"), "used": F.lit(0)})
    slots = W.partitionBy("key", "day").orderBy(F.floor(F.col("us") / gap_us))
    early = moments.withColumn("slot", F.dense_rank().over(slots)).where(F.col("slot") <= 2 * key_limit)
    folded = early.groupBy("key", "day").agg(
        F.array_sort(F.collect_list(F.struct("us", "id"))).alias("moments"),
        F.max("last").alias("last"),
        F.coalesce(F.max("used"), F.lit(0)).alias("used"),
    )
    kept = _greedy(F.col("moments"), F.lit(key_limit) - F.col("used"), F.col("last"), gap_us)
    candidates = folded.select("key", "day", F.inline(kept))
    order = W.partitionBy("day").orderBy("us", "id")
    ranked = candidates.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= day_limit)
    if state is not None:
        used = state.groupBy("day").agg(F.count(F.lit(1)).alias("day_used"))
        ranked = ranked.join(used, "day", "left").where(
            F.col("nth") + F.coalesce(F.col("day_used"), F.lit(0)) <= day_limit
        )
    return ranked.select("key", "day", "us", "id")


def decide(
    requests: DataFrame,
    admitted: DataFrame,
    *,
    key_limit: int = KEY_LIMIT,
    day_limit: int = DAY_LIMIT,
    min_gap: float = MIN_GAP_SECONDS,
) -> DataFrame:
    """(id, key, day, allowed, reason) of every request; reasons are delay, global, key or empty."""
    gap_us = max(1, int(round(min_gap * 1_000_000)))
    per_key = admitted.groupBy("key", "day").agg(
        F.array_sort(F.collect_list(F.struct("us", "id"))).alias("mine")
    )
    nth = W.partitionBy("day").orderBy("us", "id")
    # One row per calendar day that reached its cap.
    full = (
        admitted.withColumn("n", F.row_number().over(nth))
        .where(F.col("n") == day_limit)
        .select("day", F.struct("us", "id").alias("full_at"))
    )
    joined = salted_join(requests, per_key, ["key", "day"], F.col("id"), how="left")
    joined = joined.join(F.broadcast(full), "day", "left")
    here = F.struct(F.col("us").alias("us"), F.col("id").alias("id"))
    mine = F.coalesce(F.col("mine"), F.array().cast(CANDIDATES))
    earlier = F.filter(mine, lambda m: m < here)
    last = F.element_at(earlier, F.size(earlier))["us"]
    reason = (
        F.when(F.array_contains(mine, here), F.lit(""))
        .when((F.size(earlier) > 0) & (F.col("us") - F.when(F.size(earlier) > 0, last) < gap_us), F.lit("delay"))
        .when(F.col("full_at") < here, F.lit("global"))
        .otherwise(F.lit("key"))
    )
    return joined.select("id", "key", "day", reason.alias("reason")).withColumn("allowed", F.col("reason") == "")


def rate_limit(events: DataFrame, key: str, ts: str, event_id: str, **limits) -> DataFrame:
    """Decision for each request of a table."""
    requests = prepare(events, key, ts, event_id)
    return decide(requests, admitted_requests(requests, **limits), **limits)
