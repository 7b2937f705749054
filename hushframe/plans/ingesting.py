"""Queries over sources: admission by length, files, formats, lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as c
from ..functions.text import line_count
from ..session import work_folder
from ..sources import files, folder, vault
from . import fixtures as fx
from . import sql
from .registry import big, query


@query(
    "doc_length_admission",
    f"select doc_id, length(text) as chars, case when length(text) <= {c.MAX_REQUEST_CHARS} then 'ok' else 'rejected' end as status from documents",
)
def doc_length_admission(spark, sf_dir):
    df = files.admit_length(fx.documents(spark, sf_dir))
    return df.select("doc_id", big(F.length("text")).alias("chars"), "status")


@query(
    "text_line_stats",
    "select doc_id, length(text) - length(replace(text, chr(10), '')) + 1 as line_count from documents",
)
def text_line_stats(spark, sf_dir):
    return fx.documents(spark, sf_dir).select("doc_id", line_count(F.col("text")).alias("line_count"))


@query(
    "text_truncate",
    """select doc_id, md5(substr(text, 1, 1000)) as text_md5, case when length(text) > 1000 then
      'Text wurde auf 1,000 Zeichen gekuerzt (Original: ' || format('{:,}', length(text)) || ' Zeichen).' end as warning from documents""",
)
def text_truncate(spark, sf_dir):
    text = F.col("text")
    return fx.documents(spark, sf_dir).select(
        "doc_id", F.md5(files.truncate(text, 1000)).alias("text_md5"), files.truncation_warning(text, 1000).alias("warning")
    )


SUFFIXES = ".txt,.PDF,.md,.exe,.csv,.docx,.json,,.tar.gz,.JPeG"
MIMES = "text/plain,application/zip,application/pdf"
_FORMAT = (
    "coalesce(case "
    + " ".join(f"when suffix = {sql.q(k)} then {sql.q(v)}" for k, v in c.FORMAT_OF_EXTENSION.items())
    + " end, case "
    + " ".join(f"when mime = {sql.q(k)} then {sql.q(v)}" for k, v in c.FORMAT_OF_MIME.items())
    + " end)"
)
_SUFFIX = "lower(regexp_extract(name, '(\\.[^.]*)$', 1))"
_NAMES = f"concat('scan', cast(page_id as string), {fx.pick(SUFFIXES, 'page_id')})"


@query(
    "format_routing",
    f"""with named as (
      select page_id, 'url' as source, url as name, cast(null as varchar) as mime from pages
      union all select page_id, 'file', {_NAMES}, case when page_id % 4 < 3 then {fx.pick(MIMES, 'page_id')} end from pages),
    s as (select *, {_SUFFIX} as suffix from named)
    select page_id, source, coalesce({_FORMAT}, 'unsupported') as format from s""",
)
def format_routing(spark, sf_dir):
    pages = fx.table(spark, sf_dir, "pages")
    by_url = pages.select("page_id", F.lit("url").alias("source"), F.col("url").alias("name"), F.lit(None).cast("string").alias("mime"))
    by_file = pages.selectExpr(
        "page_id", "'file' as source", f"{_NAMES} as name", f"case when page_id % 4 < 3 then {fx.pick(MIMES, 'page_id')} end as mime"
    )
    kind = files.file_format(F.col("name"), F.col("mime"))
    return by_url.unionByName(by_file).select("page_id", "source", F.coalesce(kind, F.lit("unsupported")).alias("format"))


_FILE_LIMIT = 20_000
_FILE = f"concat('doc', cast(doc_id as string), {fx.pick(SUFFIXES, 'doc_id')})"


@query(
    "file_ingest",
    f"""with f as (
      select doc_id, {_FILE} as name, text, cast(null as varchar) as mime from documents
      union all select doc_id, concat('empty-', {_FILE}), '', null from documents),
    t as (select *, {_SUFFIX} as suffix, regexp_matches(text, '[^\\x00-\\x7F]') as wide from f),
    g as (select *, {_FORMAT} as kind, case when doc_id % 2 = 0 then strlen(text) else length(text) end as size from t),
    h as (select *, case when size = 0 then 'empty' when kind is null then 'unsupported' when kind <> 'TEXT' then 'needs_extractor' else 'ok' end as status from g)
    select name, size, status, kind as format, case when status = 'ok' then md5(substr(text, 1, {_FILE_LIMIT})) end as text_md5,
      case when status = 'ok' then case when doc_id % 2 = 1 and wide then 'latin-1' else 'utf-8' end end as encoding,
      case when status = 'ok' then length(text) - length(replace(text, chr(10), '')) + 1 end as line_count,
      case when status = 'ok' then cast(doc_id % 2 = 1 and wide as bigint) + cast(length(text) > {_FILE_LIMIT} as bigint) else 0 end as warnings
    from h""",
)
def file_ingest(spark, sf_dir):
    """The documents as files of a folder, in two encodings, each beside an empty one, under all kinds of names."""
    text = F.col("text")
    content = F.when(F.col("doc_id") % 2 == 0, F.encode(text, "UTF-8")).otherwise(F.encode(text, "ISO-8859-1"))
    both = F.array(
        F.struct(F.expr(_FILE).alias("name"), content.alias("content")),
        F.struct(F.concat(F.lit("empty-"), F.expr(_FILE)).alias("name"), F.lit(b"").alias("content")),
    )
    path = work_folder(spark, "files")
    folder.write(fx.documents(spark, sf_dir).select(F.inline(both)), path)
    read = files.read_files(spark, path).withColumn("name", F.element_at(F.split("path", "/"), -1))
    out = files.ingest(read, name="name", limit=_FILE_LIMIT)
    return out.select(
        "name", "size", "status", "format", F.md5("text").alias("text_md5"), "encoding", "line_count",
        big(F.size("warnings")).alias("warnings"),
    )


@query(
    "file_sizes",
    """select doc_id, printf('%.1f', strlen(text) * 997 / 1048576.0) as size_text, sha256(cast(doc_id as varchar)) as session_id from documents""",
)
def file_sizes(spark, sf_dir):
    """Sizes as text, as if each document were 997 times as long, and session ids that a run repeats."""
    df = fx.documents(spark, sf_dir)
    return df.select(
        "doc_id", files.megabytes(F.octet_length("text") * 997).alias("size_text"), vault.session_ids(F.col("doc_id")).alias("session_id")
    )
