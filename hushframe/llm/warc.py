"""WARC archives: writing pages into them and reading them in splits.

An archive is a row of gzip members, one for each record. Reading needs no index: a task gets a byte range, looks for the
gzip magic, takes a place for a member only if its header decodes to a WARC record, and owns the records that start in
its range; the last one is read on beyond the end of the range. Files are opened through pyarrow's file systems, so
archives can be in any store that those reach.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stage, work_folder

#: Bytes of a split, and of one read.
SPLIT_BYTES, READ_BYTES = 8 << 20, 1 << 20
MOST_TASKS = 100_000
MAGIC = b"\x1f\x8b\x08"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_PREFIX = "urn:page:"
#: Pages come without a fetch time; the format wants a date.
DATE = "1970-01-01T00:00:00Z"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def header_value(text: str) -> str:
    """Control characters and non-ASCII would end or break a header line: percent-encoded."""
    return "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in text)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, level: int = 6) -> bytes:
    """One gzip member. A revisit keeps the digest and the length of the payload, but not the payload."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{ID_PREFIX}{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {header_value(url or '')}",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if revisit:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <{ID_PREFIX}{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def write(pages: DataFrame, least_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Archives of the pages in the shared folder; the result lists them: path, n_bytes, n_records.

    A null html is an empty payload, a null url an empty one. Of rows with equal payloads of at least ``least_bytes``
    bytes those with the smallest page_id are responses, all others revisits of it; a null page_id comes after any other,
    and rows that repeat the smallest id are all responses. A task that runs again writes a new file; only listed files
    count.
    """
    folder = folder or work_folder(pages.sparkSession, "warc")
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("key", F.sha2("payload", 256))
    first = stage(rows.groupBy("key").agg(F.min("page_id").alias("first_id")), "warc-first")
    rows = rows.join(first, "key")
    again = (F.length("payload") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    rows = rows.select("page_id", "url", "payload", F.when(again, F.col("first_id")).alias("refers_to"))
    listing = rows.mapInArrow(_writer(folder), "path string, n_bytes long, n_records long")
    return stage(listing, "warc-list")


def _writer(folder: str):
    def write_archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        task = TaskContext.get()
        name = f"part-{task.partitionId() if task else 0:05d}-{uuid.uuid4().hex}.warc.gz"
        out, size, n = None, 0, 0
        for batch in batches:
            for page_id, url, payload, refers_to in zip(*(batch[c] for c in ("page_id", "url", "payload", "refers_to")), strict=True):
                if out is None:
                    store, at = fs.FileSystem.from_uri(folder)
                    store.create_dir(at, recursive=True)
                    out = store.open_output_stream(f"{at}/{name}", compression=None)  # it would compress by the name
                payload = payload.as_py()
                member = record(page_id.as_py(), url.as_py(), payload, sha1_base32(payload), refers_to.as_py())
                out.write(member)
                size, n = size + len(member), n + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "n_bytes": pa.array([size], pa.int64()), "n_records": pa.array([n], pa.int64())})

    return write_archive


class Window:
    """Bytes of a file from a place on, read as they are asked for; what lies behind is let go."""

    def __init__(self, file, start: int, size: int):
        self.file, self.start, self.size, self.data = file, start, size, b""

    @property
    def end(self) -> int:
        return self.start + len(self.data)

    def more(self, n: int = READ_BYTES) -> bool:
        got = self.file.read_at(min(n, self.size - self.end), self.end) if self.end < self.size else b""
        self.data += got
        return bool(got)

    def drop(self, to: int) -> None:
        self.data, self.start = self.data[to - self.start :], to


def members(file, size: int, start: int, end: int, damaged: bool = False) -> Iterator[tuple[int, bytes | None]]:
    """(place, decoded bytes) of the records that start in [start, end); with ``damaged`` also (place, None) of those that break off.

    A place with the magic is a member only if it decodes to a WARC header; a record is handed over only if its member
    decodes to the end, its checksum included. After a record the search goes on behind it, so nothing inside a record's
    compressed bytes is looked at unless a range begins there.
    """
    window = Window(file, start, size)
    while True:
        at = window.data.find(MAGIC)
        while at < 0 and window.end < end + len(MAGIC) - 1:
            window.drop(max(window.start, window.end - len(MAGIC) + 1))  # the magic may lie across two reads
            if not window.more():
                break
            at = window.data.find(MAGIC)
        place = window.start + at
        if at < 0 or place >= end:
            return
        window.drop(place)
        decoded, length = decode(window)
        if decoded is None:
            if damaged and length < 0:
                yield place, None
            window.drop(place + 1)
        else:
            yield place, decoded
            window.drop(place + length)


def decode(window: Window) -> tuple[bytes | None, int]:
    """The member at the window's start and its compressed length; None and 0 if there is no WARC record, None and -1 if one breaks off."""
    unpack, out, fed, begin = zlib.decompressobj(31), [], 0, b""
    broken = lambda: (None, -1 if begin.startswith(b"WARC/") else 0)
    while not unpack.eof:
        if fed == len(window.data) and not window.more():
            return broken()
        part = window.data[fed : fed + READ_BYTES]
        fed += len(part)
        try:
            if len(begin) < len(b"WARC/"):
                # No more than that, so that damage behind it does not hide the beginning.
                begin += unpack.decompress(part, len(b"WARC/") - len(begin))
                if not b"WARC/".startswith(begin[: len(b"WARC/")]):
                    return None, 0
                part = unpack.unconsumed_tail
            out.append(unpack.decompress(part))
        except zlib.error:
            return broken()
    return begin + b"".join(out), fed - len(unpack.unused_data)


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """WARC headers (names in lower case) and payload of a decoded record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        headers[name.strip().lower()] = value.strip()
    block = rest[: int(headers.get("content-length", 0))]
    return headers, block.partition(b"\r\n\r\n")[2] if "application/http" in headers.get("content-type", "") else block


_PAGE = re.compile(rf"<{ID_PREFIX}(-?\d+)>")
_LENGTH = re.compile(rb"(?i)\r\ncontent-length:\s*(\d+)")


def read(archives: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Records of the listed archives (path, n_bytes): page_id, url, record_type, refers_to, payload, payload_bytes, payload_digest.

    ``payload`` is null for a revisit; its ``payload_bytes`` and digest are those of the full payload, from its headers.
    Those of a response are measured. A record that breaks off (a file cut short, bytes changed) has the record_type
    ``damaged`` and its place in ``url``, all else is null. Splits are dealt out evenly, one to a task.
    """
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n_bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))
    splits = archives.where("n_bytes > 0").select("path", "n_bytes", F.explode(starts).alias("start"))
    splits = splits.withColumn("end", F.least(F.col("start") + split_bytes, "n_bytes"))
    # A split is a few bytes here and megabytes in the store: their number, not their size, says how many tasks there are.
    tasks = archives.agg(F.sum(F.ceil(F.greatest(F.col("n_bytes"), F.lit(0)) / split_bytes))).first()[0] or 1
    return splits.repartition(min(int(tasks), MOST_TASKS)).mapInArrow(
        _reader, "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string"
    )


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    schema = pa.schema(
        [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]
    )
    for batch in batches:
        for split in batch.to_pylist():
            store, at = fs.FileSystem.from_uri(split["path"])
            rows, held = [], 0
            with store.open_input_file(at) as file:
                for place, raw in members(file, split["n_bytes"], split["start"], split["end"], damaged=True):
                    if raw is None:
                        rows.append({"url": f"{split['path']}#{place}", "record_type": "damaged"})
                        continue
                    headers, payload = parse(raw)
                    page = _PAGE.match(headers.get("warc-record-id", ""))
                    refers = _PAGE.match(headers.get("warc-refers-to", ""))
                    row = {"page_id": int(page[1]) if page else None, "url": headers.get("warc-target-uri"), "record_type": headers.get("warc-type"), "refers_to": int(refers[1]) if refers else None}
                    if row["record_type"] == "revisit":
                        length = _LENGTH.search(raw.partition(b"\r\n\r\n")[2])
                        row |= {"payload": None, "payload_bytes": int(length[1]) if length else None, "payload_digest": headers.get("warc-payload-digest", "").removeprefix("sha1:")}
                    else:
                        row |= {"payload": payload, "payload_bytes": len(payload), "payload_digest": sha1_base32(payload)}
                    rows.append(row)
                    held += len(payload)
                    if held >= READ_BYTES or len(rows) >= 1000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)


def round_trip(pages: DataFrame, least_bytes: int = 0, payloads: bool = True) -> DataFrame:
    """Pages written to archives and read back, with or without the payloads. An empty table gives no archives and no rows.

    What was read is written to the shared folder and counted: it fails if a record is damaged or their number is not that of the listing.
    """
    listing = write(pages, least_bytes)
    back = read(listing)
    back = stage(back if payloads else back.drop("payload"), "warc-back")
    want = listing.agg(F.sum("n_records")).first()[0] or 0
    found, hurt = back.agg(F.count(F.lit(1)), F.count(F.when(F.col("record_type") == "damaged", 1))).first()
    if hurt or found != want:
        raise ValueError(f"{want} records were written, {found - hurt} read back, {hurt} damaged")
    return back


def archives_of(spark: SparkSession, paths: list[str]) -> DataFrame:
    """A listing for archives that others wrote; it opens each only for its size."""

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            sizes = []
            for path in batch["path"].to_pylist():
                store, at = fs.FileSystem.from_uri(path)
                sizes.append(store.get_file_info(at).size)
            yield pa.RecordBatch.from_arrays([batch["path"], pa.array(sizes, pa.int64())], ["path", "n_bytes"])

    return spark.createDataFrame([(p,) for p in paths], "path string").mapInArrow(sized, "path string, n_bytes long")
