"""Spark data sources ``fasta``, ``genbank``, ``embl`` and ``gff3``: batch and streaming, reading and writing.

    register(spark)
    spark.read.format("fasta").load("genomes/*.fa.gz").where("name = 'chr1'")
    rows.write.format("gff3").option("compression", "gzip").mode("append").save("folder")
    spark.readStream.format("fasta").load("folder")

Reading.  Files are planned as ranges of ``rangeBytes`` (see ``ranges``), block gzip like plain text.  ``scaffold_id`` is the number of the range, and in it the place of the
record: it depends on the files and ``rangeBytes`` alone, not on the cluster, so every plan over a source has the same ids.  Filters on the name (equal, in, prefix) reach the
parser, which leaves other records' sequences unread (``spark.sql.python.filterPushdown.enabled``).

Writing.  A task writes to a folder of the job's own below the target; only the driver's commit moves the files of the tasks that succeeded to the target and then marks it with
``_SUCCESS``; a failed job leaves nothing behind.  Parts are numbered like the partitions, so a sorted table stays sorted.  ``compression=gzip`` writes block gzip.

Streams.  A stream reads files in the order of their time and path, each once; an offset is the last of them, and ``maxFiles`` bounds a batch (not with the trigger
``availableNow``, under which Spark asks a Python source for one batch only).  Files must appear whole, by a rename, and not with a time
before that of files already read.  A streaming sink names its files after the batch, so that a batch that comes again replaces itself.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from weakref import WeakSet

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, StringStartsWith, WriterCommitMessage

from strandloom.sources import formats, ranges

_SEQUENCE = "scaffold_id bigint, name string, sequence string, length int"
_FEATURE = "seqid string, source string, type string, start bigint, end bigint, score double, strand string, phase string, attributes string"
#: Records of one range, as bits of an id.
ID_BITS = 33
#: Characters of sequences in a batch, about, and rows.
BATCH_CHARS, BATCH_ROWS = 8 << 20, 10_000
#: Rows of a written batch that are Python objects at a time.
SLICE_ROWS = 64
_ENDINGS = {"fasta": "fa", "genbank": "gbk", "embl": "embl", "gff3": "gff3"}


@dataclass
class Task(InputPartition):
    """The ranges of one task."""

    ranges: list[ranges.Range]


def _accepts(filters: list[Filter]) -> Callable[[str], bool]:
    def one(f: Filter) -> Callable[[str], bool]:
        if isinstance(f, EqualTo):
            return lambda name: name == f.value
        if isinstance(f, In):
            return lambda name: name in f.value
        return lambda name: name.startswith(f.value)

    tests = [one(f) for f in filters]
    return lambda name: all(t(name) for t in tests)


def _batches(task: Task, kind: str, filters: list[Filter]) -> Iterator[pa.RecordBatch]:
    """The records of a task's ranges."""
    wanted = _accepts(filters) if filters else None
    rows: list[tuple] = []
    size = 0
    types = [pa.int64(), pa.string(), pa.string(), pa.int32()] if kind != "gff3" else [pa.string()] * 3 + [pa.int64()] * 2 + [pa.float64()] + [pa.string()] * 3
    names = [c.split()[0] for c in (_FEATURE if kind == "gff3" else _SEQUENCE).split(", ")]

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    for r in task.ranges:
        fs, at = ranges.opened(r.path)
        with fs.open_input_file(at) as data:
            for i, found in formats.records(data, kind, r.begin, r.end, wanted):
                if kind != "gff3":
                    found = ((r.number << ID_BITS) + i, *found, len(found[1]))
                    size += found[3]
                rows.append(found)
                if size >= BATCH_CHARS or len(rows) >= BATCH_ROWS:
                    yield batch()
                    rows, size = [], 0
    if rows:
        yield batch()


def _paths(options: dict[str, str]) -> list[str]:
    if "paths" in options:  # one a line
        return options["paths"].split("\n")
    if "path" not in options:
        raise ValueError("no path")
    return [options["path"]]


class _Reader(DataSourceReader):
    def __init__(self, kind: str, options: dict[str, str]):
        self.kind, self.paths, self.size, self.filters = kind, _paths(options), int(options.get("rangeBytes", ranges.RANGE_BYTES)), []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        name = ("seqid",) if self.kind == "gff3" else ("name",)
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith)) and f.attribute == name:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        return [Task(t) for t in ranges.planned(ranges.listed(self.paths), self.size)] or [Task([])]

    def read(self, partition: Task) -> Iterator[pa.RecordBatch]:
        return _batches(partition, self.kind, self.filters)


class _StreamReader(DataSourceStreamReader):
    """Offsets are the time (nanoseconds) and path of the last file read."""

    def __init__(self, kind: str, options: dict[str, str]):
        self.kind, self.paths, self.size = kind, _paths(options), int(options.get("rangeBytes", ranges.RANGE_BYTES))
        self.most = int(options.get("maxFiles", 1 << 30))
        self.last: dict | None = None

    def _files(self) -> list[tuple[tuple[int, str], tuple[str, pafs.FileInfo]]]:
        return sorted(((i.mtime_ns or 0, path), (path, i)) for path, i in ranges.listed(self.paths))

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        now = self.last or self.initialOffset()
        new = [k for k, _ in self._files() if k > (now["time"], now["path"])][: self.most]
        if new:
            self.last = {"time": new[-1][0], "path": new[-1][1]}
            return self.last
        return now

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        self.last = max(end, self.last or end, key=lambda x: (x["time"], x["path"]))  # where a restarted stream goes on
        key = lambda x: (x["time"], x["path"])
        # ranges are numbered through all files up to these, so that ids of other batches differ
        tasks = ranges.planned([f for k, f in self._files() if k <= key(end)], self.size)
        new = {path for (t, path), _ in self._files() if key(start) < (t, path) <= key(end)}
        return [Task(t) for task in tasks if (t := [r for r in task if r.path in new])]

    def read(self, partition: Task) -> Iterator[pa.RecordBatch]:
        return _batches(partition, self.kind, [])


@dataclass
class Written(WriterCommitMessage):
    """A task's file in the job's folder, and its name in the target; none for a task without rows."""

    file: str | None
    name: str | None


class _Sink:
    """What batch and streaming sinks share."""

    def __init__(self, kind: str, options: dict[str, str]):
        self.kind, self.path, self.packed = kind, _paths(options)[0].rstrip("/"), options.get("compression", "none").lower() in ("gzip", "gz", "bgzip")
        self.job = uuid.uuid4().hex

    @property
    def own(self) -> str:
        return f"{self.path}/_temporary-{self.job}"

    def _write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        fs, own = ranges.opened(self.own)
        out, file = None, f"{own}/{uuid.uuid4().hex}"
        for batch in batches:
            if batch.num_rows and out is None:
                self._prepare()
                out = fs.open_output_stream(file, compression=None)
                out = ranges.BlockGzip(out) if self.packed else out
            for row in (r for i in range(0, batch.num_rows, SLICE_ROWS) for r in batch.slice(i, SLICE_ROWS).to_pylist()):
                out.write(formats.render(self.kind, row).encode("utf-8", "replace"))
        if out is None:
            return Written(None, None)
        out.close()
        part = TaskContext.get().partitionId()
        return Written(file, f"part-{part:05d}-{self.job}.{_ENDINGS[self.kind]}{'.gz' if self.packed else ''}")

    def _prepare(self) -> None:
        """Before a task's first row."""

    def _create(self) -> None:
        fs, own = ranges.opened(self.own)
        fs.create_dir(own, recursive=True)

    def _discard(self) -> None:
        fs, own = ranges.opened(self.own)
        if fs.get_file_info(own).type == pafs.FileType.Directory:
            fs.delete_dir(own)


class _Writer(_Sink, DataSourceArrowWriter):
    def __init__(self, kind: str, options: dict[str, str], overwrite: bool):
        super().__init__(kind, options)
        self.overwrite = overwrite
        self._create()  # once, by the driver: a task that is killed late must not make the folder anew

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        return self._write(iterator)

    def commit(self, messages: list[Written | None]) -> None:
        fs, target = ranges.opened(self.path)
        fs.create_dir(target, recursive=True)
        if self.overwrite:
            for old in fs.get_file_info(pafs.FileSelector(target)):
                if old.type == pafs.FileType.File:
                    fs.delete_file(old.path)
        for m in messages:
            if m and m.file:
                fs.move(m.file, f"{target}/{m.name}")
        self._discard()
        fs.open_output_stream(f"{target}/_SUCCESS").close()

    def abort(self, messages: list[Written | None]) -> None:
        self._discard()


class _StreamWriter(_Sink, DataSourceStreamArrowWriter):
    def _prepare(self) -> None:
        self._create()  # every commit takes it away

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        return self._write(iterator)

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        fs, target = ranges.opened(self.path)
        fs.create_dir(target, recursive=True)
        mine = f"batch-{batchId:010d}-"
        for old in fs.get_file_info(pafs.FileSelector(target)):  # of an earlier try
            if old.base_name.startswith(mine):
                fs.delete_file(old.path)
        for m in messages:
            if m and m.file:
                fs.move(m.file, f"{target}/{mine}{m.name}")
        self._discard()

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        self._discard()


class _Source(DataSource):
    kind: str

    @classmethod
    def name(cls) -> str:
        return cls.kind

    def schema(self) -> str:
        return _FEATURE if self.kind == "gff3" else _SEQUENCE

    def reader(self, schema) -> _Reader:
        return _Reader(self.kind, self.options)

    def streamReader(self, schema) -> _StreamReader:
        return _StreamReader(self.kind, self.options)

    def _checked(self, schema) -> None:
        need = set(formats.GFF3) if self.kind == "gff3" else {"name", "sequence"}
        if missing := need - set(schema.fieldNames()):
            raise ValueError(f"columns missing for {self.kind}: {', '.join(sorted(missing))}")

    def writer(self, schema, overwrite: bool) -> _Writer:
        self._checked(schema)
        return _Writer(self.kind, self.options, overwrite)

    def streamWriter(self, schema, overwrite: bool) -> _StreamWriter:
        self._checked(schema)
        return _StreamWriter(self.kind, self.options)


class Fasta(_Source):
    kind = "fasta"


class GenBank(_Source):
    kind = "genbank"


class Embl(_Source):
    kind = "embl"


class Gff3(_Source):
    kind = "gff3"


_known: WeakSet[SparkSession] = WeakSet()


def register(spark: SparkSession) -> None:
    """Makes the formats known to a session."""
    if spark not in _known:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
        for source in (Fasta, GenBank, Embl, Gff3):
            spark.dataSource.register(source)
        _known.add(spark)
