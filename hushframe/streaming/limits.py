"""Admission of requests that arrive as a stream.

Each micro-batch runs the batch rule on top of what earlier batches admitted.  The admitted requests are
the state; the daily cap bounds them.  State and decisions are written per batch id, so a repeated
batch replaces its own output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import admission
from ..session import work_folder
from .runs import drain_batches

NO_DAY = "0001-01-01"


class StreamLimiter:
    """Batch handler with its state and decision folders; keys are of the type of the input.

    State lies in folders by day, so a batch lists and reads only what was admitted on its own days.
    """

    def __init__(self, spark, kind: str, key: str, ts: str, event_id: str, folder: str | None = None, **limits):
        base = folder or work_folder(spark, "limits")
        self.state, self.decisions = f"{base}/state", f"{base}/decisions"
        self.columns, self.limits = (key, ts, event_id), limits
        self.state_schema = f"key {kind}, us bigint, id bigint"
        # The day of no request, so that there is a folder before the first admission.
        spark.createDataFrame([], self.state_schema).write.mode("overwrite").parquet(f"{self.state}/day={NO_DAY}/batch=-1")
        self.decision_schema = f"id bigint, key {kind}, day date, reason string, allowed boolean"

    def read_state(self, spark, days: list, batch_id: int, before: bool) -> DataFrame:
        """What was admitted on the given days, before a batch or by it."""
        # A pattern finds what is there of the days asked for and lists no other day.
        folders = f"{self.state}/day={{{','.join([*days, NO_DAY])}}}"
        schema = self.state_schema + ", day date, batch bigint"
        state = spark.read.schema(schema).option("basePath", self.state).parquet(folders)
        which = F.col("batch") < batch_id if before else F.col("batch") == batch_id
        return state.where(which).select("key", "day", "us", "id")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        requests = admission.prepare(batch, *self.columns)
        # The days of a batch, a few.
        days = sorted(str(r["day"]) for r in requests.select("day").where("day is not null").distinct().collect())
        past = self.read_state(spark, days, batch_id, before=True)
        fresh = admission.admitted_requests(requests, past, **self.limits).withColumn("batch", F.lit(batch_id).cast("bigint"))
        # A repeated batch overwrites its own folders.
        fresh.hint("rebalance", "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(self.state)
        admitted = past.unionByName(self.read_state(spark, days, batch_id, before=False))
        decided = admission.decide(requests, admitted, **self.limits)
        decided.write.mode("overwrite").parquet(f"{self.decisions}/batch={batch_id}")


def limit_stream(requests: DataFrame, key: str, ts: str, event_id: str, **limits) -> DataFrame:
    """Process a stream of requests to its end; returns the decisions."""
    spark = requests.sparkSession
    limiter = StreamLimiter(spark, requests.schema[key].dataType.simpleString(), key, ts, event_id, **limits)
    drain_batches(requests, "limits", limiter)
    return spark.read.schema(limiter.decision_schema + ", batch bigint").parquet(limiter.decisions).drop("batch")
