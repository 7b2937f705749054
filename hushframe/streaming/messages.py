"""Anonymizing chat messages as they arrive, with codenames that stay the same over a conversation.

Two queries run behind one another. The first detects: it writes each batch of messages with its spans, and of every
conversation the identifiers in it, each once with its first place (combined before the shuffle, so a conversation with
a third of all messages costs one row per identifier and task). The second numbers: keyed state holds the number of every
identifier of a conversation and a counter for each group of codenames. It takes only the identifiers of new batches,
and its batches are then rewritten from the folders they came in, so what a batch reads does not grow with the ones
before it. All output is written per batch id, and an identifier that is known keeps its number: a repeated batch
replaces its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..constants import POOL_OF_TYPE
from ..functions.text import fold_key
from ..operators import chat, pseudonym
from ..operators import spans as sp
from ..session import work_folder
from .runs import drain_batches, use_rocksdb

SCOPE = ["conv_id"]
SPANS = "array<struct<start:int,end:int,entity_type:string,original:string,key:string>>"
ARRIVED = f"conv_id bigint, turn bigint, role string, text string, spans {SPANS}, batch bigint"
FIRSTS = "conv_id bigint, key string, turn bigint, start int, entity_type string, batch bigint"
NUMBERED = "conv_id bigint, key string, entity_type string, number bigint, batch bigint"
TEXTS = "conv_id bigint, turn bigint, role string, text string"
VAULT = "conv_id bigint, codename string, original string, turn bigint, batch bigint"
#: Numbered identifiers that the processor hands on at once.
ROWS = 10_000


class Codenumbers(StatefulProcessor):
    """Numbers of a conversation's identifiers, in reading order within what arrives together.

    State: identifier to (type, number), and group to the highest number in use. A row without an identifier only says
    that its batch has arrived and passes as it is.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getMapState("known", "key string", "entity_type string, number long")
        self.used = handle.getMapState("used", "name string", "number long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out, used, before = [], {}, {}
        asked = pd.concat(rows).sort_values(["batch", "turn", "start", "key"], kind="stable")
        for name, entity_type, batch in zip(asked["key"], asked["entity_type"], asked["batch"], strict=True):
            if name is None:
                out.append((key[0], None, None, 0, batch))
                continue
            if used.get(name) is None:
                used[name] = self.known.getValue((name,)) if self.known.containsKey((name,)) else None
            if used[name] is None:
                group = POOL_OF_TYPE.get(entity_type, entity_type)
                if group not in before:
                    before[group] = self.used.getValue((group,))[0] if self.used.containsKey((group,)) else 0
                before[group] += 1
                used[name] = (entity_type, before[group])
                self.known.updateValue((name,), used[name])
            out.append((key[0], name, *used[name], batch))
        for group, number in before.items():
            self.used.updateValue((group,), (number,))
        for at in range(0, len(out), ROWS):
            part = pd.DataFrame(out[at : at + ROWS], columns=["conv_id", "key", "entity_type", "number", "batch"])
            yield part.astype({"conv_id": "int64", "number": "int64", "batch": "int64"})

    def close(self) -> None:
        pass


class StreamAnonymizer:
    """The handlers of both queries and their folders. Called with a batch of messages it detects; ``rewrite`` ends the rest."""

    def __init__(self, spark, folder: str | None = None):
        self.spark, self.base = spark, folder or work_folder(spark, "messages")
        self.arrived, self.firsts, self.texts, self.vault = (f"{self.base}/{f}" for f in ("arrived", "firsts", "texts", "vault"))

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        """Detect, and hand the batch on. The identifiers are written last: when they are there, all else is."""
        resolved = F.transform(
            sp.resolve_overlaps(F.col("spans")),
            lambda s: F.struct(
                s["start"].alias("start"), s["end"].alias("end"), s["entity_type"].alias("entity_type"),
                s["text"].alias("original"), fold_key(s["text"]).alias("key"),
            ),
        )
        path = f"{self.arrived}/batch={batch_id}"
        found = chat.detect_user_turns(batch).select("conv_id", "turn", "role", "text", resolved.alias("spans"))
        found.write.mode("overwrite").parquet(path)
        spark = batch.sparkSession
        occurrences = spark.read.schema(ARRIVED).parquet(path).select("conv_id", "turn", F.inline("spans"))
        firsts = pseudonym.first_seen(occurrences.where("conv_id is not null"), SCOPE, ["turn", "start"])
        # A batch without any identifier has to be known of, too. No number is null: a null key would make all keys of a
        # task floating-point numbers on their way to the processor.
        mark = spark.createDataFrame([(-1, None, 0, 0, None, batch_id)], FIRSTS)
        handed = firsts.withColumn("batch", F.lit(batch_id).cast("bigint")).select(*mark.columns).unionByName(mark)
        handed.write.mode("overwrite").parquet(f"{self.firsts}/id={batch_id}")

    def numbered(self) -> DataFrame:
        """The stream of numbered identifiers: one row per conversation, identifier and batch."""
        use_rocksdb(self.spark)
        # A detection that runs again replaces files; what is gone then comes again under another name.
        firsts = self.spark.readStream.schema(FIRSTS).option("ignoreMissingFiles", "true").parquet(f"{self.firsts}/id=*")
        return firsts.groupBy(*SCOPE).transformWithStateInPandas(
            statefulProcessor=Codenumbers(), outputStructType=NUMBERED, outputMode="Append", timeMode="None"
        )

    def name(self, numbered: DataFrame, batch_id: int) -> None:
        """Rewrite the messages of the batches whose identifiers are numbered here."""
        spark = numbered.sparkSession
        path = f"{self.base}/numbered/part={batch_id}"
        numbered.write.mode("overwrite").parquet(path)
        numbered = spark.read.schema(NUMBERED).parquet(path)
        # As many as were detected since the last time.
        batches = [r["batch"] for r in numbered.select("batch").distinct().collect()]
        if not batches:
            return
        folders = [f"{self.arrived}/batch={b}" for b in sorted(batches)]
        arrived = spark.read.schema(ARRIVED).option("basePath", self.arrived).parquet(*folders)
        names = numbered.where("key is not null").dropDuplicates(["batch", *SCOPE, "key"]).select(
            "batch", *SCOPE, "key", pseudonym.render(F.col("entity_type"), F.col("number")).alias("codename")
        )
        occurrences = arrived.select("batch", "conv_id", "turn", F.inline("spans"))
        named = pseudonym.salted_join(occurrences, names, ["batch", *SCOPE, "key"], F.struct("conv_id", "turn"))
        per_text = named.groupBy("batch", "conv_id", "turn").agg(
            F.array_sort(F.collect_list(F.struct("start", "end", "codename"))).alias("named")
        )
        joined = arrived.drop("spans").join(per_text, ["batch", "conv_id", "turn"], "left")
        places = F.coalesce(F.col("named"), F.array().cast("array<struct<start:int,end:int,codename:string>>"))
        text = sp.splice(F.col("text"), places, F.transform(places, lambda s: s["codename"]))
        self._replace(joined.select("batch", "conv_id", "turn", "role", text.alias("text")), self.texts)
        spelled = named.groupBy("batch", "conv_id", "codename").agg(
            F.max_by("original", F.struct("turn", "start")).alias("original"), F.max("turn").alias("turn")
        )
        self._replace(spelled, self.vault)

    @staticmethod
    def _replace(rows: DataFrame, path: str) -> None:
        """Write the batches that are there in place of what they wrote before."""
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    def rewrite(self) -> list[dict]:
        """Number and rewrite all that has been detected since the last time; returns the query's progress."""
        return drain_batches(self.numbered(), "numbers", self.name, f"{self.base}/checkpoint")

    def mappings(self, spark) -> DataFrame:
        """(conv_id, codename, original): the last spelling of every identifier so far."""
        rows = spark.read.schema(VAULT).parquet(self.vault)
        return rows.groupBy("conv_id", "codename").agg(
            F.max_by("original", F.struct("turn", "batch")).alias("original")
        )


def anonymize_stream(messages: DataFrame) -> DataFrame:
    """Process a stream of messages to its end; returns the rewritten messages.

    Where messages never end, run both queries side by side: ``writeStream.foreachBatch`` with the anonymizer itself on the
    messages, and with its ``name`` on ``numbered()``.
    """
    spark = messages.sparkSession
    handler = StreamAnonymizer(spark)
    drain_batches(messages, "messages", handler)
    handler.rewrite()
    return spark.read.schema(TEXTS + ", batch bigint").parquet(handler.texts).drop("batch")
