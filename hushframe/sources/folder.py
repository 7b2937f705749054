"""Files of a folder as rows, files without any byte included, and rows as files.

Spark's own file reader skips empty files, so this is a data source of its own, through pyarrow's file systems. Where there are
many folders, the driver only lists those and tasks list what is in them; ``write`` deals files over folders for that.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from fnmatch import fnmatch

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"
#: Bytes that a task reads; opening a file counts like so many of them.
TASK_BYTES, OPEN_BYTES = 64 << 20, 1 << 20
#: Tasks for files that the driver has listed: a larger folder gives larger tasks.
TASKS = 4096
#: From so many folders on, the driver leaves what is in them to the tasks, one to a folder.
FOLDERS = 64
#: Folders that ``write`` deals files over.
DEALT = 256


class Files(InputPartition):
    """Some files of a folder (path, modification time in microseconds, length), or a folder whose files the task lists."""

    def __init__(self, files: list[tuple[str, int, int]], below: str | None = None):
        super().__init__(None)
        self.files, self.below = files, below


class FolderReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder, self.glob = options["path"], options.get("pathglobfilter", options.get("pathGlobFilter", "*"))

    def listed(self, store, at: str, recursive: bool) -> tuple[list[tuple[str, int, int]], list[str]]:
        """(files, folders) of a folder, the files in order."""
        from pyarrow import fs

        files, folders = [], []
        for f in store.get_file_info(fs.FileSelector(at, recursive=recursive)):
            if f.type == fs.FileType.Directory:
                folders.append(f.path)
            elif f.type == fs.FileType.File and fnmatch(f.base_name, self.glob):
                files.append((f.path, (f.mtime_ns or 0) // 1000, f.size))
        return sorted(files), sorted(folders)

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(self.folder)
        files, folders = [], deque([at])
        while folders and len(folders) < FOLDERS:
            more, below = self.listed(store, folders.popleft(), False)
            files += more
            folders += below
        files.sort()
        most = max(TASK_BYTES, sum(f[2] + OPEN_BYTES for f in files) // TASKS)
        parts, room = [], 0
        for file in files:
            cost = file[2] + OPEN_BYTES
            if not parts or cost > room:
                parts.append([])
                room = most
            parts[-1].append(file)
            room -= cost
        return [Files(p) for p in parts] + [Files([], f) for f in folders] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(self.folder)
        schema = pa.schema([("path", pa.string()), ("modificationTime", pa.timestamp("us", "UTC")), ("length", pa.int64()), ("content", pa.binary())])
        files = partition.files if partition.below is None else self.listed(store, partition.below, True)[0]
        for path, changed, _ in files:
            with store.open_input_stream(path, compression=None) as file:
                content = file.read()
            yield pa.RecordBatch.from_pydict({"path": [path], "modificationTime": [changed], "length": [len(content)], "content": [content]}, schema=schema)


class FolderSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "hushframe_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FolderReader:
        return FolderReader(self.options)


def read(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """All files below a folder, empty ones too: path, modificationTime, length, content. A task holds one file at a time."""
    spark.dataSource.register(FolderSource)
    reader = spark.read.format(FolderSource.name())
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def write(rows: DataFrame, folder: str, name: str = "name", content: str = "content") -> int:
    """Each row as a file of that name; a row that is written again replaces its file. Returns how many were written.

    Files lie in folders by a hash of their name, so no listing holds all of them.
    """

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(folder)
        store.create_dir(at, recursive=True)
        made = set()
        for batch in batches:
            for file, said in zip(batch["name"], batch["content"], strict=True):
                said_name = f"{file.as_py()}"
                below = f"{at}/{zlib.crc32(said_name.encode()) % DEALT:03d}"
                if below not in made:
                    store.create_dir(below, recursive=True)
                    made.add(below)
                with store.open_output_stream(f"{below}/{said_name}", compression=None) as out:
                    out.write(said.as_buffer())
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    asked = rows.select(F.col(name).alias("name"), F.coalesce(F.col(content).cast("binary"), F.lit(b"")).alias("content"))
    return asked.mapInArrow(put, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
