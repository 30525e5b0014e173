"""Python data sources: binary records, recordings and users' formats for ``spark.read.format``, records for ``write``.

Records of a fixed size need no scan, so a file is cut into ranges of whole records, each a partition; a recording's
range of bytes tells from its header which samples of which channels lie in it. Files are reached through PyArrow's
file systems (local and mounted paths, and the stores it knows by their address); for a store that only Spark reads
there are the functions of ``readers``.

Call :func:`register` once a session.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from pointloom.sources.readers import _CHANNEL, _EVENT, _FULL_SCALE, _GENERAL, IMPORTERS, parse_records

SPLIT_BYTES = 64 << 20
BATCH_ROWS = 1 << 16
#: Partitions of a read, whatever the number of files and ranges, and what opening a file counts for in them.
MOST_PARTITIONS, OPEN_BYTES = 512, 16 << 10
RECORDS = "file string, idx long, columns array<double>"
SAMPLES = "file string, channel long, name string, units string, idx long, t double, raw int, value double"
EVENTS = "file string, position long, t double, text string"


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") or path.startswith("/") else f"/{path}")


def data_files(path: str) -> list[tuple[str, int]]:
    """Paths and sizes of a folder's files, or of the one file; hidden ones and markers left out."""
    fs, root = file_system(path)
    info = fs.get_file_info(root)
    found = [info] if info.is_file else fs.get_file_info(pafs.FileSelector(root, recursive=True))
    hidden = lambda p: any(x[:1] in "._" for x in p[len(root) :].split("/") if x)
    return sorted((f.path, f.size) for f in found if f.is_file and not hidden(f.path))


@dataclass
class FileRange:
    file: str
    start: int
    end: int


@dataclass
class FileRanges(InputPartition):
    ranges: list[FileRange]


def bundled(ranges: list[FileRange], most: int = MOST_PARTITIONS) -> list[FileRanges]:
    """A partition for each range, or where there are more than ``most`` as many of about equal size."""
    if len(ranges) <= most:
        return [FileRanges([r]) for r in ranges]
    share = sum(r.end - r.start + OPEN_BYTES for r in ranges) / most
    out, begun = {}, 0
    for r in ranges:
        own = out.setdefault(int(begun / share), [])
        if own and (own[-1].file, own[-1].end) == (r.file, r.start):
            own[-1] = FileRange(r.file, own[-1].start, r.end)
        else:
            own.append(r)
        begun += r.end - r.start + OPEN_BYTES
    return [FileRanges(own) for own in out.values()]


def file_ranges(path: str, split: int, align: int = 1, offset: int = 0) -> list[FileRanges]:
    """Ranges of all files, of whole records of ``align`` bytes behind the first ``offset``."""
    step = max(1, split // align) * align
    out = []
    for file, size in data_files(path):
        end = offset + (size - offset) // align * align
        out += [FileRange(file, at, min(at + step, end)) for at in range(offset, end, step)]
    return bundled(out)


class RecordsReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.columns, self.size = int(options["columns"]), int(options["size"])
        self.swap = options.get("swap", "false").lower() == "true"
        self.extremes = json.loads(options["extremes"]) if "extremes" in options else None
        self.split, self.offset = int(options.get("split_bytes", SPLIT_BYTES)), int(options.get("offset", 0))
        self.width = self.columns * self.size

    def partitions(self) -> list[FileRanges]:
        return file_ranges(self.path, self.split, self.width, self.offset)

    def read(self, partition: FileRanges) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(self.path)
        for own in partition.ranges:
            yield from self._read(fs, own)

    def _read(self, fs: pafs.FileSystem, partition: FileRange) -> Iterator[pa.RecordBatch]:
        with fs.open_input_file(partition.file) as f:
            for at in range(partition.start, partition.end, BATCH_ROWS * self.width):
                n = min(BATCH_ROWS * self.width, partition.end - at)
                a = parse_records(f.read_at(n, at), self.columns, self.size, self.swap, extremes=self.extremes)
                idx = (at - self.offset) // self.width + np.arange(len(a))
                cells = pa.ListArray.from_arrays(np.arange(len(a) + 1, dtype=np.int32) * self.columns, a.ravel())
                yield pa.RecordBatch.from_arrays([pa.array([partition.file] * len(a)), pa.array(idx), cells], ["file", "idx", "columns"])


@dataclass
class Written(WriterCommitMessage):
    path: str | None


class RecordsWriter(DataSourceArrowWriter):
    """Each task writes a file under a hidden name; only a commit of them all gives them their names."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.size, self.overwrite = options["path"], int(options["size"]), overwrite
        self.swap = options.get("swap", "false").lower() == "true"
        self.extremes = json.loads(options["extremes"]) if "extremes" in options else None
        self.job = uuid.uuid4().hex

    def _packed(self, a: np.ndarray) -> bytes:
        kind = {8: "f8", 4: "f4", 2: "u2", 1: "u1"}[self.size]
        if self.size < 4:
            if self.extremes is None:
                raise ValueError("whole numbers need the columns' extremes")
            low, high = np.array(self.extremes, float).T
            a = np.clip(np.rint((a - low) / np.where(high > low, high - low, 1) * (256**self.size - 1)), 0, 256**self.size - 1)
        return a.astype((">" if self.swap else "<") + kind).tobytes()

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        fs, root = file_system(self.path)
        context = TaskContext.get()
        temporary = f"{root}/.{self.job}-{context.partitionId():06d}-{context.taskAttemptId()}"
        fs.create_dir(root, recursive=True)
        n = 0
        with fs.open_output_stream(temporary) as f:
            for batch in iterator:
                cells = batch.column("columns")
                if batch.num_rows:
                    f.write(self._packed(np.asarray(cells.flatten()).astype(float).reshape(batch.num_rows, -1)))
                    n += batch.num_rows
        if not n:
            fs.delete_file(temporary)
        return Written(temporary if n else None)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = file_system(self.path)
        before = [p for p, _ in data_files(self.path)] if self.overwrite else []
        for m in messages:
            if m is not None and m.path:
                fs.move(m.path, f"{root}/part-{m.path.rpartition('/')[2].split('-')[1]}-{self.job}.bin")
        for p in before:
            fs.delete_file(p)

    def abort(self, messages: list[Written | None]) -> None:
        fs, _ = file_system(self.path)
        for m in messages:
            if m is not None and m.path:
                fs.delete_file(m.path)


class Records(DataSource):
    """Options: path, columns (numbers a record), size (1, 2, 4 or 8 bytes), swap, extremes (JSON, for sizes 1 and 2),
    offset, split_bytes. Written is the column ``columns`` (array of double)."""

    @classmethod
    def name(cls) -> str:
        return "loom_records"

    def schema(self) -> str:
        return RECORDS

    def reader(self, schema) -> RecordsReader:
        return RecordsReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> RecordsWriter:
        return RecordsWriter(dict(self.options), overwrite)


class RecordingsReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("split_bytes", SPLIT_BYTES))
        self.events = options.get("events", "false").lower() == "true"

    def partitions(self) -> list[FileRanges]:
        if self.events:  # they stand at a file's end
            return bundled([FileRange(file, 0, size) for file, size in data_files(self.path)])
        return file_ranges(self.path, self.split)

    def read(self, partition: FileRanges) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(self.path)
        for own in partition.ranges:
            yield from self._read(fs, own)

    def _read(self, fs: pafs.FileSystem, partition: FileRange) -> Iterator[pa.RecordBatch]:
        text = lambda b: b.split(b"\0")[0].decode("latin-1").strip()
        with fs.open_input_file(partition.file) as f:
            g = _GENERAL.unpack(f.read_at(_GENERAL.size, 0))
            n_channels, step, samples, n_events = g[1], g[2] / (g[3] or 1.0), g[4], g[11]
            whole = _CHANNEL.size + 2 * samples
            if self.events:
                at = _GENERAL.size + n_channels * whole
                n = max(0, min(n_events, (partition.end - at) // _EVENT.size))
                found = [(p, p * step, text(t)) for p, _, t in _EVENT.iter_unpack(f.read_at(n * _EVENT.size, at))] if n else []
                frame = pd.DataFrame(found, columns=["position", "t", "text"])
                frame.insert(0, "file", partition.file)
                schema = pa.schema([("file", pa.string()), ("position", pa.int64()), ("t", pa.float64()), ("text", pa.string())])
                yield pa.RecordBatch.from_pandas(frame, schema, preserve_index=False)
                return
            for channel in range(n_channels):
                at = _GENERAL.size + channel * whole
                first = at + _CHANNEL.size
                # a sample belongs to the range that its first byte is in
                low = max(0, -(-(partition.start - first) // 2))
                high = min(samples, -(-(partition.end - first) // 2))
                if low >= high:
                    continue
                label, coefficient, offset, _, _, _, _, units, _ = _CHANNEL.unpack(f.read_at(_CHANNEL.size, at))
                for k in range(low, high, BATCH_ROWS):
                    n = min(BATCH_ROWS, high - k)
                    raw = np.frombuffer(f.read_at(2 * n, first + 2 * k), "<i2")
                    idx = np.arange(k, k + n)
                    columns = [[partition.file] * n, np.full(n, channel), [text(label)] * n, [text(units)] * n, idx, idx * step, raw.astype(np.int32), raw * (coefficient / _FULL_SCALE) + offset]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [c.split()[0] for c in SAMPLES.split(", ")])


class Recordings(DataSource):
    """Options: path, split_bytes, events (true for the events in place of the samples). All channels are given; a
    channel without a signal has raw values of 0 alone."""

    @classmethod
    def name(cls) -> str:
        return "loom_recordings"

    def schema(self) -> str:
        return EVENTS if self.options.get("events", "false").lower() == "true" else SAMPLES

    def reader(self, schema) -> RecordingsReader:
        return RecordingsReader(dict(self.options))


class ImportedReader(DataSourceReader):
    def __init__(self, path: str, names: list[str], text: bool, parse: Callable):
        self.path, self.names, self.text, self.parse = path, names, text, parse

    def partitions(self) -> list[FileRanges]:
        return bundled([FileRange(file, 0, size) for file, size in data_files(self.path)])

    def read(self, partition: FileRanges) -> Iterator[tuple]:
        fs, _ = file_system(self.path)
        for own in partition.ranges:
            yield from self._read(fs, own)

    def _read(self, fs: pafs.FileSystem, partition: FileRange) -> Iterator[tuple]:
        with fs.open_input_stream(partition.file) as f:
            data = f.read()
        rows = self.parse(data.decode() if self.text else data)
        rows = rows[self.names].itertuples(index=False, name=None) if isinstance(rows, pd.DataFrame) else rows
        for row in rows:
            yield (partition.file, *row)


def importer(name: str) -> type[DataSource]:
    """A data source of a format that ``readers.register_importer`` has added; a file is read in one task."""
    columns, text, parse = IMPORTERS[name]
    names = [c.strip().split()[0] for c in columns.split(",")]

    class Imported(DataSource):
        @classmethod
        def name(cls) -> str:
            return f"loom_{name}"

        def schema(self) -> str:
            return f"file string, {columns}"

        def reader(self, schema) -> ImportedReader:
            return ImportedReader(self.options["path"], names, text, parse)

    return Imported


def register(spark: SparkSession) -> None:
    """Make the sources known to the session: loom_records, loom_recordings, and loom_<format> for each importer."""
    spark.dataSource.register(Records)
    spark.dataSource.register(Recordings)
    for name in IMPORTERS:
        spark.dataSource.register(importer(name))
