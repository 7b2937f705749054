"""Documents and files: admission by size, format routing, text decoding, truncation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as c
from ..functions.text import file_suffix, line_count, literal_map
from . import folder

OK, REJECTED = "ok", "rejected"


def read_documents(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """A text table in any built-in format."""
    return spark.read.format(fmt).options(**options).load(path)


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Files below a folder as (path, modificationTime, length, content), those of zero bytes included."""
    return folder.read(spark, path, glob)


def admit_length(df: DataFrame, text: str = "text", limit: int = c.MAX_REQUEST_CHARS) -> DataFrame:
    """Adds ``status``: texts over the limit are rejected."""
    return df.withColumn(
        "status", F.when(F.length(text) <= limit, F.lit(OK)).otherwise(F.lit(REJECTED))
    )


def file_format(name: Column, mime: Column | None = None, lenient: bool = False) -> Column:
    """Format by the last suffix, else by MIME type, else null; ``lenient`` tries the rest as text."""
    if lenient:
        return F.coalesce(file_format(name, mime), F.lit("TEXT"))
    by_suffix = F.element_at(literal_map(c.FORMAT_OF_EXTENSION), file_suffix(name))
    if mime is None:
        return by_suffix
    return F.coalesce(by_suffix, F.element_at(literal_map(c.FORMAT_OF_MIME), mime))


def megabytes(size: Column) -> Column:
    return F.format_string("%.1f", size / (1024 * 1024))


def decode(content: Column) -> Column:
    """(text, encoding): UTF-8 where the bytes are valid, Latin-1 otherwise."""
    utf8 = F.try_validate_utf8(content.cast("string"))
    return F.struct(
        F.coalesce(utf8, F.decode(content, "ISO-8859-1")).alias("text"),
        F.when(utf8.isNotNull(), F.lit("utf-8")).otherwise(F.lit("latin-1")).alias("encoding"),
    )


LATIN_WARNING = "Datei wurde mit Latin-1 Encoding gelesen (UTF-8 fehlgeschlagen)."


def truncate(text: Column, limit: int = c.MAX_FILE_CHARS) -> Column:
    return F.left(text, F.lit(limit))


def truncation_warning(text: Column, limit: int = c.MAX_FILE_CHARS) -> Column:
    """Warning with both lengths; null if nothing was cut."""
    return F.when(
        F.length(text) > limit,
        F.concat(
            F.lit("Text wurde auf "), F.format_number(F.lit(limit), 0), F.lit(" Zeichen gekuerzt (Original: "),
            F.format_number(F.length(text), 0), F.lit(" Zeichen)."),
        ),
    )


def ingest(
    files: DataFrame,
    name: str = "path",
    content: str = "content",
    mime: str | None = None,
    limit: int = c.MAX_FILE_CHARS,
    lenient: bool = False,
    max_bytes: int = c.MAX_FILE_BYTES,
) -> DataFrame:
    """Text of each file with its metadata; files that cannot be used keep the reason in ``status``.

    Adds status, format, text, encoding, line_count, pages, warnings.  Only text formats are decoded
    here; PDF, office and image files are marked ``needs_extractor``.
    """
    size = F.length(content)
    kind = file_format(F.col(name), F.col(mime) if mime else None, lenient)
    status = (
        F.when(size > max_bytes, F.lit("too_large"))
        .when(size == 0, F.lit("empty"))
        .when(kind.isNull(), F.lit("unsupported"))
        .when(kind != "TEXT", F.lit("needs_extractor"))
        .otherwise(F.lit(OK))
    )
    rest = [col for col in files.columns if col != content]
    out = files.select(
        *rest,
        size.cast("bigint").alias("size"),
        status.alias("status"),
        kind.alias("format"),
        F.when(status == OK, decode(F.col(content))).alias("__d"),
    )
    full = F.col("__d.text")
    warnings = F.filter(
        F.array(
            F.when(F.col("__d.encoding") == "latin-1", F.lit(LATIN_WARNING)), truncation_warning(full, limit)
        ),
        lambda w: w.isNotNull(),
    )
    return out.select(
        *rest, "size", "status", "format",
        truncate(full, limit).alias("text"),
        F.col("__d.encoding").alias("encoding"),
        line_count(full).alias("line_count"),
        F.when(F.col("status") == OK, F.lit(1)).alias("pages"),
        warnings.alias("warnings"),
    )


def report_json(text: str = "anonymized", mapping: str = "mapping") -> Column:
    """Report of one anonymized text as a JSON object."""
    return F.to_json(
        F.struct(
            F.col(text).alias("anonymized_text"),
            F.col(mapping).alias("mappings"),
            F.size(mapping).alias("entities_found"),
        )
    )


def report_text(text: str = "anonymized", mapping: str = "mapping") -> Column:
    """The same as readable text."""
    lines = F.transform(F.map_entries(mapping), lambda e: F.concat(F.lit("  "), e["key"], F.lit(" -> "), e["value"]))
    return F.concat(
        F.lit("--- Anonymized Text ---\n"), F.col(text),
        F.lit("\n\n--- Mappings ("), F.size(mapping).cast("string"), F.lit(" replacements) ---\n"),
        F.array_join(lines, "\n"),
    )


def write_report(df: DataFrame, path: str, fmt: str = "json") -> None:
    df.write.mode("append").format(fmt).save(path)
