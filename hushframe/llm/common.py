"""Helpers that the corpus operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stage

FILE, ROW = "_at_file", "_at_row"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, so that other columns can have any name; a null text is empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def located(docs: DataFrame) -> DataFrame:
    """The rows with the place of each in its file. A place tells repeated rows apart, also those without an id.

    A table that does not come from files is written to the shared folder first.
    """
    try:
        return _with_place(docs)
    except AnalysisException:
        return _with_place(stage(docs, "located"))


def _with_place(docs: DataFrame) -> DataFrame:
    meta = docs.metadataColumn("_metadata")
    return docs.withColumns({FILE: meta.getField("file_path"), ROW: meta.getField("row_index")})


def fold(key: Column, parts: int) -> Column:
    """CRC32 of a key as text, modulo ``parts``; null for a null key."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(parts))


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def groups_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of equal keys out of batches that are sorted by them; one run is held at a time."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        if rest is not None:
            now = pa.concat_tables([rest, now])
        cuts = _cuts(now, keys)
        for a, b in zip(cuts[:-2], cuts[1:-1], strict=True):
            yield now.slice(a, b - a)
        rest = now.slice(cuts[-2])
    if rest is not None:
        yield rest


def _cuts(rows: pa.Table, keys: list[str]) -> list[int]:
    import numpy as np

    new = np.zeros(rows.num_rows, bool)
    new[0] = True
    for key in keys:
        column = rows.column(key).to_numpy(zero_copy_only=False)
        new[1:] |= column[1:] != column[:-1]
    return [*np.flatnonzero(new).tolist(), rows.num_rows]
