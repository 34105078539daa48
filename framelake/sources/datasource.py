"""Containers as Spark data sources: planned partitions, streams with offsets, writers that commit.

    register(spark)
    spark.read.format("units").load(path)             path, unit_idx, header_offset, payload_offset, size, pts, payload, error
    spark.readStream.format("units").load(path)       the same for files that appear and grow
    df.write.format("units").mode("append").save(path)     pts, payload: one container for each partition
    frames.write.format("y4m").mode("append").save(path)   stream, frame, header, planes: one file for each stream

Reading.  A file is cut into ranges of `splitBytes`; each is a task of its own.  Containers have no
marks to begin at, so a task hops from header to header (a few bytes each) up to its range and then
reads the units that begin there, one at a time: no task holds more than a unit, and every payload is read
once.  What containers.units says of malformed files holds here too.

Streams.  The offset names, for each file, the byte behind the last whole unit and its number, so a
unit that is still being written waits for the next batch.  `unitsPerBatch` bounds a batch in each file.

Writing.  A task writes to a hidden folder below the path; the commit moves its files, and what failed or
was killed leaves only hidden files, which no reader lists.

Paths go through pyarrow's file systems (local, hdfs, s3, gs); what only Spark can open is read by
containers.units.
"""

from __future__ import annotations

import json
import struct
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

from .containers import CHROMA, MAX_UNIT_BYTES, UNIT_SCHEMA, ivf_file_header

SPLIT_BYTES = 128 << 20
UNITS_PER_BATCH = 100_000


def register(spark: SparkSession) -> None:
    for source in (UnitSource, Y4mSource):
        spark.dataSource.register(source)


def working_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; a temporary one only on a single machine that names none."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='framelake-')}"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def listed(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files at or below a path, hidden ones aside, in order."""
    from pyarrow import fs

    system, root = filesystem(path)
    info = system.get_file_info(root)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and not any(part.startswith(("_", ".")) for part in f.path[len(root) :].split("/")))


@dataclass
class Unit:
    header_offset: int
    payload_offset: int
    size: int
    pts: int | None = None
    error: str | None = None

    @property
    def end(self) -> int:
        return self.payload_offset + self.size


def _ivf_at(file, at: int, length: int, cap: int) -> Unit:
    file.seek(at)
    head = file.read(12)
    if len(head) < 12:
        return Unit(at, at, length - at, None, "ivf/frame-header-truncated")
    size, pts = struct.unpack("<IQ", head)
    error = "unit/too-large" if size > cap else "ivf/frame-truncated" if at + 12 + size > length else None
    return Unit(at, at + 12, size, pts, error)


def _annexb_at(file, at: int, length: int, cap: int) -> Unit:
    file.seek(at)
    head, size = file.read(8), 0
    for n, byte in enumerate(head):
        size |= (byte & 127) << 7 * n
        if byte < 128:
            break
    else:
        return Unit(at, at, 0, None, "annexb/length-unended") if len(head) == 8 else Unit(at, at + len(head), 0, None, "annexb/length-truncated")
    start = at + n + 1
    error = "unit/too-large" if size > cap else "annexb/empty-unit" if not size else "annexb/unit-truncated" if start + size > length else None
    return Unit(at, start, size, None, error)


def walked(file, length: int, cap: int, at: int = 0, index: int = 0) -> Iterator[tuple[int, Unit]]:
    """(number, unit) from a place that begins a unit (0: of the file) to the end or the first error; payloads are not read."""
    file.seek(0)
    head = file.read(32)
    step = _ivf_at if head[:4] == b"DKIF" else _annexb_at
    if at == 0 and step is _ivf_at:
        if len(head) < 32:
            yield 0, Unit(0, 0, length, None, "ivf/header-truncated")
            return
        at = struct.unpack_from("<H", head, 6)[0]
    while at < length:
        unit = step(file, at, length, cap)
        yield index, unit
        if unit.error:
            return
        at, index = unit.end, index + 1


@dataclass
class Range(InputPartition):
    """Units of a file that begin from `low` up to `high`; the walk sets out at (at, index)."""

    path: str
    length: int
    low: int
    high: int
    at: int = 0
    index: int = 0


class _Reading:
    def __init__(self, options: dict):
        self.path = options["path"]
        self.cap = int(options.get("maxUnitBytes", MAX_UNIT_BYTES))
        self.split = max(1, int(options.get("splitBytes", SPLIT_BYTES)))
        self.fail_fast = options.get("failFast", "false").lower() == "true"

    def read(self, part: Range | None) -> Iterator[tuple]:
        from decimal import Decimal

        if part is None:  # what Spark plans where there are no files
            return
        system, _ = filesystem(self.path)
        with system.open_input_file(part.path) as file:
            for index, unit in walked(file, part.length, self.cap, part.at, part.index):
                if unit.header_offset >= part.high:
                    return
                if unit.header_offset < part.low:
                    continue
                if unit.error and self.fail_fast:
                    raise ValueError(f"{part.path}: {unit.error} at byte {unit.header_offset}")
                file.seek(unit.payload_offset)
                payload = None if unit.error else file.read(unit.size)
                yield part.path, index, unit.header_offset, unit.payload_offset, unit.size, None if unit.pts is None else Decimal(unit.pts), payload, unit.error


class UnitReader(_Reading, DataSourceReader):
    def partitions(self) -> list[Range]:
        return [Range(path, length, low, min(low + self.split, length)) for path, length in listed(self.path) for low in range(0, length, self.split)]


class UnitStreamReader(_Reading, DataSourceStreamReader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.most = int(options.get("unitsPerBatch", UNITS_PER_BATCH))
        self.seen: dict[str, list[int]] = {}

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        """Behind the last whole unit of each file; at most so many units further than before."""
        system, _ = filesystem(self.path)
        for path, length in listed(self.path):
            at, index = self.seen.get(path, [0, 0])
            if at >= length:
                continue
            with system.open_input_file(path) as file:
                for n, (k, unit) in enumerate(walked(file, length, self.cap, at, index)):
                    if unit.error or n == self.most:  # what is cut off may be whole next time
                        break
                    at, index = unit.end, k + 1
            self.seen[path] = [at, index]
        return {"files": json.dumps(self.seen, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        before, after = (json.loads(x["files"]) for x in (start, end))
        for path, place in before.items():  # a restarted query goes on where it was
            self.seen.setdefault(path, place)
        moved = [(path, *before.get(path, [0, 0]), at) for path, (at, _) in after.items() if at > before.get(path, [0, 0])[0]]
        return [Range(path, end_at, at, end_at, at, index) for path, at, index, end_at in moved]


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class _Committing(DataSourceWriter):
    """Files are written to a hidden folder and moved by the commit."""

    def __init__(self, options: dict, overwrite: bool):
        self.options, self.overwrite = options, overwrite
        self.path, self.staging = options["path"], f"_staging-{uuid.uuid4().hex}"

    def opened(self, name: str):
        system, root = filesystem(self.path)
        system.create_dir(f"{root}/{self.staging}", recursive=True)
        return system.open_output_stream(f"{root}/{self.staging}/{name}")

    def commit(self, messages: list[Written]) -> None:
        system, root = filesystem(self.path)
        system.create_dir(root, recursive=True)
        if self.overwrite:
            for path, _ in listed(self.path):
                system.delete_file(path)
        for name in (n for m in messages if m for n in m.files):
            system.move(f"{root}/{self.staging}/{name}", f"{root}/{name}")
        self._clear()

    def abort(self, messages: list[Written]) -> None:
        self._clear()

    def _clear(self) -> None:
        from pyarrow import fs

        system, root = filesystem(self.path)
        if system.get_file_info(f"{root}/{self.staging}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{self.staging}")


def annexb_length(n: int) -> bytes:
    out = bytearray()
    while n >= 128:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


class UnitWriter(_Committing):
    """Rows (pts, payload) of a partition in order, as one IVF or length-prefixed file; options container, width, height, rate, scale."""

    def write(self, rows: Iterator) -> Written:
        ivf = self.options.get("container", "ivf") == "ivf"
        out, name = None, f"part-{uuid.uuid4().hex}.{'ivf' if ivf else 'av2'}"
        try:
            for row in rows:
                if out is None:
                    out = self.opened(name)
                    if ivf:
                        out.write(ivf_file_header(*(int(self.options.get(k, d)) for k, d in (("width", 0), ("height", 0), ("rate", 30), ("scale", 1)))))
                if ivf:
                    out.write(struct.pack("<IQ", len(row.payload), int(row.pts)))
                elif not row.payload:
                    raise ValueError("a length-prefixed unit can't be empty")
                else:
                    out.write(annexb_length(len(row.payload)))
                out.write(row.payload)
        finally:
            if out is not None:
                out.close()
        return Written([] if out is None else [name])


class Y4mWriter(_Committing):
    """Rows (stream, frame, header, planes) sorted by stream: the header line once, then each frame; a stream can't change its header.

    With the option `raw` planes follow each other without lines.
    """

    def write(self, rows: Iterator) -> Written:
        raw = self.options.get("raw", "false").lower() == "true"
        out, stream, header, names = None, None, None, []
        try:
            for row in rows:
                if out is None or row.stream != stream:
                    if out is not None:
                        out.close()
                    stream, header = row.stream, row.header
                    names.append(f"{stream}-{uuid.uuid4().hex}.{'yuv' if raw else 'y4m'}")
                    out = self.opened(names[-1])
                    if not raw:
                        out.write(header.encode())
                if row.header != header:
                    raise ValueError(f"stream {stream}: frame {row.frame} has another format")
                if not raw:
                    out.write(b"FRAME\n")
                out.write(row.planes)
        finally:
            if out is not None:
                out.close()
        return Written(names)


class UnitSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "units"

    def schema(self) -> str:
        return UNIT_SCHEMA

    def reader(self, schema) -> UnitReader:
        return UnitReader(self.options)

    def streamReader(self, schema) -> UnitStreamReader:
        return UnitStreamReader(self.options)

    def writer(self, schema, overwrite: bool) -> UnitWriter:
        if not {"pts", "payload"} <= set(schema.names):
            raise ValueError("units need pts and payload")
        return UnitWriter(self.options, overwrite)


class Y4mSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "y4m"

    def schema(self) -> str:
        return "stream string, frame long, header string, planes binary"

    def writer(self, schema, overwrite: bool) -> Y4mWriter:
        return Y4mWriter(self.options, overwrite)


def frames_of_rows(rows: DataFrame, header: str, chroma: str = "420", bit_depth: int = 8) -> DataFrame:
    """(stream, frame, header, planes) from rows of samples (stream, frame, plane, y, samples), as the y4m sink takes them."""
    from pyspark.sql import functions as F

    if chroma not in CHROMA:
        raise ValueError(chroma)
    value = (lambda v: F.concat(F.lpad(F.hex(v.cast("long") % 256), 2, "0"), F.lpad(F.hex(F.shiftright(v.cast("long"), 8)), 2, "0"))) if bit_depth > 8 else (lambda v: F.lpad(F.hex(v.cast("long")), 2, "0"))
    line = F.array_join(F.transform("samples", value), "")
    lines = F.array_sort(F.collect_list(F.struct("plane", "y", line.alias("hex"))))  # the lines of one picture
    planes = F.unhex(F.array_join(F.transform(lines, lambda r: r["hex"]), ""))
    return rows.groupBy(F.col("stream").cast("string").alias("stream"), "frame").agg(planes.alias("planes")).select("stream", "frame", F.lit(header).alias("header"), "planes")


def write_y4m(frames: DataFrame, path: str, raw: bool = False, mode: str = "append") -> None:
    """One file for each stream; frames pass one at a time through the task of their stream."""
    register(frames.sparkSession)
    ordered = frames.select("stream", "frame", "header", "planes").repartition("stream").sortWithinPartitions("stream", "frame")
    ordered.write.format("y4m").option("raw", str(raw).lower()).mode(mode).save(path)
