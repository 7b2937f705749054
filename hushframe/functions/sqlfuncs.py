"""SQL names for the row-level functions, so plain SQL users can call them.

Each is a SQL function whose body is the text of the same expression that the DataFrame function builds; nothing
runs in Python.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import pseudonym, rehydrate
from ..operators import spans as sp
from ..operators.recognizers import REGISTRY, Recognizer, found_spans, keep_spans
from .sqltext import as_sql
from .text import fold_key, mask_key, occurrences


def register(spark: SparkSession, registry: Sequence[Recognizer] = REGISTRY, deny_terms: Sequence[str] = (), **filters) -> None:
    """Create the functions in the session.

    ``pii_spans`` gives what ``recognizers.detect`` gives, ``pii_anonymize`` what ``pseudonym.anonymize`` gives on top of
    it, ``pii_rehydrate`` what ``rehydrate.rehydrate`` gives.  ``pii_anonymize`` takes the spans of a text that has them
    already, and only detects without.
    """
    text = F.col("text")
    spans = sp.clean_spans(keep_spans(found_spans(text, registry=registry, deny_terms=deny_terms), **filters))
    done = pseudonym.anonymized(text, F.coalesce(F.col("spans"), F.call_function("pii_spans", text)))
    spans_type = sp.SPANS_TYPE.replace("end:", "`end`:")
    bodies = {
        "mask_key(k STRING) RETURNS STRING": mask_key(F.col("k")),
        "pii_fold_key(x STRING) RETURNS STRING": fold_key(F.col("x")),
        "pii_term_count(text STRING, term STRING) RETURNS BIGINT": occurrences(text, F.col("term")),
        "pii_rehydrate(text STRING, mapping MAP<STRING, STRING>) RETURNS STRING": rehydrate.rehydrate(text, F.col("mapping")),
        f"pii_spans(text STRING) RETURNS {spans_type}": spans,
        f"pii_anonymize(text STRING, spans {spans_type} DEFAULT NULL) RETURNS STRUCT<anonymized: STRING, mapping: MAP<STRING, STRING>>": F.struct(
            done["anonymized"].alias("anonymized"), done["mapping"].alias("mapping")
        ),
    }
    for head, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {as_sql(body)}")
