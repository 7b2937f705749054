"""Session settings and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "hushframe", **extra: str) -> SparkSession:
    """A session with the settings the operators expect; the master comes from the caller."""
    builder = SparkSession.builder.appName(app)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_LOCAL: dict[str, str] = {}


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the shared folder named by ``spark.checkpoint.dir``.

    Only a session that runs in one process may go without that setting; it gets a local folder of its own.  On a
    cluster each executor would write to its own disk, so the missing setting is an error there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = tempfile.mkdtemp(prefix="hushframe-")
        base = _LOCAL[app]
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def stage(df, purpose: str):
    """Write a table to the shared folder and read it back.

    Used where several branches need the same costly result: the work is done once, the lineage is cut,
    and a lost executor only costs reading the files again.
    """
    spark = df.sparkSession
    path = work_folder(spark, purpose)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
