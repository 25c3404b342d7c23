"""``.tar.gz`` archives as a data source that streams their entries."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from siltstone.functions.values import MAX_FILE_BYTES
from siltstone.sources.storage import new_folder

MAX_ARCHIVE_BYTES = 250_000_000
SUFFIX = ".tar.gz"
_COLUMNS = "archive string, path string, size long, content binary"


def _at(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class _Limited(io.RawIOBase):
    """A stream that gives an error once more than so many bytes of it are read."""

    def __init__(self, stream, name: str, most: int):
        self.stream, self.name, self.left, self.most = stream, name, most, most

    def readable(self) -> bool:
        return True

    def read(self, n: int = -1) -> bytes:
        data = self.stream.read(n if n >= 0 else None)
        self.left -= len(data)
        if self.left < 0:
            raise ValueError(f"{self.name} has more than {self.most} bytes")
        return data


class _Archive(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    """A task for each archive. Conditions on paths are tested on an entry's header, before its content is read."""

    def __init__(self, options):
        self.root, self.names, self.prefixes = options["path"], None, []
        self.most, self.largest = int(options.get("maxArchiveBytes", MAX_ARCHIVE_BYTES)), int(options.get("maxFileBytes", MAX_FILE_BYTES))

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, StringStartsWith) and f.attribute == ("path",):
                self.prefixes.append(f.value)
            elif isinstance(f, EqualTo | In) and f.attribute == ("path",):
                own = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.names = own if self.names is None else self.names & own
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, root = _at(self.root)
        info = store.get_file_info(root)
        found = [info] if info.is_file else store.get_file_info(fs.FileSelector(root, recursive=True))
        return [_Archive(f.path) for f in sorted(found, key=lambda f: f.path) if f.is_file and f.path.endswith(SUFFIX)]

    def _wanted(self, entry: tarfile.TarInfo) -> str | None:
        name = entry.name.partition("/")[2]
        sound = entry.isfile() and name and entry.size <= self.largest and (self.names is None or name in self.names)
        return name if sound and all(name.startswith(p) for p in self.prefixes) else None

    def _entries(self, archive: str) -> Iterator[tuple[int, str, tarfile.TarInfo, tarfile.TarFile]]:
        with _at(self.root)[0].open_input_stream(archive, compression=None) as raw, tarfile.open(fileobj=_Limited(raw, archive, self.most), mode="r|gz") as tar:
            for i, entry in enumerate(tar):
                if name := self._wanted(entry):
                    yield i, name, entry, tar
                tar.members = []  # else it keeps every header

    def read(self, partition: _Archive) -> Iterator[tuple]:
        last = {name: i for i, name, _, _ in self._entries(partition.path)}  # headers only
        for i, name, entry, tar in self._entries(partition.path):
            if last[name] == i:
                yield partition.path, name, entry.size, tar.extractfile(entry).read()


class ArchiveSource(DataSource):
    """``(archive, path, size, content)`` of the files in archives below a folder; the first segment of their paths goes.

    Entries are streamed, twice: once for headers, since of entries of one path the last counts, and once for contents.
    An archive of more than ``maxArchiveBytes`` compressed bytes gives an error as soon as so many are read; files over
    ``maxFileBytes`` are passed over. The store must be one that ``pyarrow.fs`` reads.
    """

    @classmethod
    def name(cls) -> str:
        return "tar_gz"

    def schema(self) -> str:
        return _COLUMNS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def archived_files(spark: SparkSession, path: str, max_archive: int = MAX_ARCHIVE_BYTES, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("tar_gz").option("maxArchiveBytes", max_archive).option("maxFileBytes", max_bytes).load(path)


def write_archives(files: DataFrame, folder: str | None = None, top: str = "snapshot") -> str:
    """An archive for each partition of ``files`` (``path, text``), below ``folder`` or a new one; returns the folder. An
    archive is written beside and then renamed, so that one that a lost task left half written doesn't count."""
    folder = folder or new_folder(files.sparkSession, "archives")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, root = _at(folder)
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        draft, n = f"{root}/part-{part:05d}.{attempt}.draft", 0
        store.create_dir(root, recursive=True)
        with store.open_output_stream(draft, compression=None) as raw, tarfile.open(fileobj=raw, mode="w|gz") as tar:
            for batch in batches:
                for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    data = (text or "").encode()
                    entry = tarfile.TarInfo(f"{top}/{path}")
                    entry.size = len(data)
                    tar.addfile(entry, io.BytesIO(data))
                    n += 1
        store.move(draft, f"{root}/part-{part:05d}{SUFFIX}")
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    files.select("path", F.col("text").cast("string")).mapInArrow(write, "n long").agg(F.sum("n")).collect()
    return folder
