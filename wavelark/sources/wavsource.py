"""WAV files as a Spark data source, format `wav`: read in byte ranges, with pushed-down ranges of samples, and written by two-phase commit.

Reading. Files are listed once (names and sizes, no contents) and cut into byte ranges of `splitBytes`;
small files share a partition. A task parses a file's header itself, reads the frames that begin in its
range, and nothing else, so a recording of any length spreads over many tasks. Bounds on `sample_idx`
and values of `recording_id` that a query filters by are pushed into the source: files and frames
outside aren't read. Option `table` chooses what a row is:

* `samples` (default): recording_id, sample_idx, value in [-1, 1), the mean of the channels; with
  `channels=each` also channel, a row for each.
* `blocks`: recording_id, first_sample, samples: up to `blockFrames` values at once. Blocks end where ranges do.
* `recordings`: recording_id, filename, path, duration_seconds, rate, channels, n_frames, width, from headers alone.

`start` and `seconds` restrict `samples` and `blocks` to a stretch of each file, by its own rate.
`id=stem` makes the file's name without extension the recording_id; by default it is the path.

PCM of 1 to 4 bytes and IEEE floats are read, also in RF64 files and in those whose data size was never
filled in (the file's end counts). Anything else is an error that names the file; `ignoreCorrupt=true` passes over such files.

Writing takes rows (name, samples) or (name, first_sample, samples, n_frames); `write` in `sources.wav`
prepares the second form, in which one file's blocks come in order. A task writes into a folder of its own
under `_temporary`; the commit moves the files of the tasks that counted into place, and an abort, or
a failed attempt, leaves none.

Files are reached through pyarrow's file systems (local, HDFS, object stores), on driver and executors alike.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage,
)

EXTENSION = ".wav"
SPLIT_BYTES, BLOCK_FRAMES = 32 << 20, 65_536
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"

SCHEMAS = {
    "samples": "recording_id string, sample_idx long, value double",
    "blocks": "recording_id string, first_sample long, samples array<float>",
    "recordings": "recording_id string, filename string, path string, duration_seconds double, rate int, channels int, n_frames long, width int",
}


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path)


@dataclass
class Header:
    rate: int
    channels: int
    width: int
    floating: bool
    data: int  # where samples begin
    n_frames: int

    @property
    def frame(self) -> int:
        return self.channels * self.width


def read_header(f: pa.NativeFile, size: int) -> Header:
    """What the chunks before the samples say. Raises ValueError for what isn't a WAV file that can be read."""
    form, _, kind = struct.unpack("<4sI4s", f.read(12).ljust(12, b"\0"))
    if form not in (b"RIFF", b"RF64") or kind != b"WAVE":
        raise ValueError("not a WAV file")
    at, known, wide = 12, None, None
    while at + 8 <= size:
        f.seek(at)
        name, length = struct.unpack("<4sI", f.read(8))
        if name == b"ds64":
            wide = struct.unpack("<QQ", f.read(16))[1]
        elif name == b"fmt ":
            body = f.read(min(length, 40))
            tag, channels, rate, _, _, bits = struct.unpack("<HHIIHH", body[:16])
            if tag == 0xFFFE and len(body) >= 26:  # extensible: the tag proper is in its sub-format
                tag = struct.unpack("<H", body[24:26])[0]
            if tag not in (1, 3) or bits % 8 or bits // 8 not in ((1, 2, 3, 4) if tag == 1 else (4, 8)) or not channels or not rate:
                raise ValueError(f"format {tag} of {bits} bits can't be read")
            known = (rate, channels, bits // 8, tag == 3)
        elif name == b"data":
            if known is None:
                raise ValueError("samples without a format")
            held = wide if wide is not None and length == 0xFFFFFFFF else length
            held = min(held, size - at - 8) if held not in (0, 0xFFFFFFFF) else size - at - 8
            return Header(*known, at + 8, held // (known[1] * known[2]))
        at += 8 + length + length % 2
    raise ValueError("no samples")


def to_float(data: bytes, width: int, floating: bool = False) -> np.ndarray:
    """Little-endian samples as float32 in [-1, 1)."""
    if floating:
        return np.frombuffer(data, {4: "<f4", 8: "<f8"}[width]).astype(np.float32)
    if width == 1:
        return (np.frombuffer(data, np.uint8).astype(np.float32) - 128) / 128
    if width == 3:
        raw = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int32)
        return ((raw[:, 0] << 8 | raw[:, 1] << 16 | raw[:, 2] << 24) / 2**31).astype(np.float32)
    return (np.frombuffer(data, {2: "<i2", 4: "<i4"}[width]) / 2.0 ** (8 * width - 1)).astype(np.float32)


def to_pcm(samples: np.ndarray, width: int) -> bytes:
    """Samples as little-endian PCM: clipped, rounded half to even."""
    top = 2.0 ** (8 * width - 1)
    x = np.rint(np.clip(np.asarray(samples, np.float64), -1, 1 - 1 / top) * top).astype(np.int64)
    if width == 1:
        return (x + 128).astype(np.uint8).tobytes()
    if width == 3:
        return x.astype("<i4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
    return x.astype({2: "<i2", 4: "<i4"}[width]).tobytes()


def pcm_header(n_frames: int, rate: int, width: int) -> bytes:
    """The header of a mono PCM file; RF64 where the size passes 32 bits."""
    size = n_frames * width
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, rate * width, width, 8 * width)
    if size + 80 < 1 << 32:
        return struct.pack("<4sI4s", b"RIFF", 4 + len(fmt) + 8 + size + size % 2, b"WAVE") + fmt + struct.pack("<4sI", b"data", size)
    ds64 = struct.pack("<4sIQQQI", b"ds64", 28, 4 + 36 + len(fmt) + 8 + size + size % 2, size, n_frames, 0)
    return struct.pack("<4sI4s", b"RF64", 0xFFFFFFFF, b"WAVE") + ds64 + fmt + struct.pack("<4sI", b"data", 0xFFFFFFFF)


@dataclass
class Pieces(InputPartition):
    """Byte ranges (path, from, to, size of the file) that one task reads."""

    ranges: list[tuple[str, int, int, int]]


class WavReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        options = {k.lower(): v for k, v in options.items()}  # their case doesn't count
        self.table = options.get("table", "samples")
        if self.table not in SCHEMAS:
            raise ValueError(f"table is one of {', '.join(SCHEMAS)}")
        self.path = options["path"]
        self.by_stem = options.get("id", "path") == "stem"
        self.each = options.get("channels", "mean") == "each" and self.table == "samples"
        self.split, self.block = int(options.get("splitbytes", SPLIT_BYTES)), int(options.get("blockframes", BLOCK_FRAMES))
        self.start, self.seconds = float(options.get("start", 0)), float(options["seconds"]) if "seconds" in options else None
        self.ignore = options.get("ignorecorrupt", "false").lower() == "true"
        self.first, self.last, self.only = 0, None, None  # pushed bounds, ends included, and pushed recordings
        self.bytes_read = 0

    def recording(self, path: str) -> str:
        return os.path.splitext(os.path.basename(path))[0] if self.by_stem else path

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes bounds on sample_idx and values of recording_id; both are met exactly, so Spark needn't look again."""
        place = {"samples": ("sample_idx",)}.get(self.table)  # a block holds more than one place
        for x in filters:
            at, value = getattr(x, "attribute", None), getattr(x, "value", None)
            if isinstance(x, IsNotNull) and at in (place, ("recording_id",)):
                continue
            if at == ("recording_id",) and isinstance(x, (EqualTo, In)):
                these = set(value) if isinstance(x, In) else {value}
                self.only = these if self.only is None else self.only & these
            elif at == place and place and isinstance(x, (GreaterThan, GreaterThanOrEqual)):
                self.first = max(self.first, value + isinstance(x, GreaterThan))
            elif at == place and place and isinstance(x, (LessThan, LessThanOrEqual)):
                self._until(value - isinstance(x, LessThan))
            elif at == place and place and isinstance(x, EqualTo):
                self.first = max(self.first, value)
                self._until(value)
            else:
                yield x

    def _until(self, last: int) -> None:
        self.last = last if self.last is None else min(self.last, last)

    def partitions(self) -> list[Pieces]:
        files, root = located(self.path)
        info = files.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.is_file else files.get_file_info(fs.FileSelector(root, recursive=True))
        hidden = lambda p: any(x[:1] in "_." for x in p[len(root) :].split("/") if x)
        found = sorted((x.path, x.size) for x in found if x.is_file and x.path.lower().endswith(EXTENSION) and not hidden(x.path))
        found = [x for x in found if self.only is None or self.recording(x[0]) in self.only]
        step = self.split if self.table != "recordings" else 1 << 62
        out, size = [Pieces([])], 0
        for path, n in found:
            for at in range(0, max(n, 1), step):
                end = min(at + step, n)
                # a header costs a task about as much as some thousand frames, so many small files are dealt out too
                if out[-1].ranges and size + end - at > self.split:
                    out.append(Pieces([]))
                    size = 0
                out[-1].ranges.append((path, at, end, n))
                size += max(end - at if self.table != "recordings" else 0, 1 << 16)
        return out

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        files = located(self.path)[0]
        for path, begin, end, size in partition.ranges:
            with files.open_input_file(path) as f:
                try:
                    head = read_header(f, size)
                except (ValueError, struct.error) as e:
                    if self.ignore:
                        continue
                    raise ValueError(f"{path}: {e}") from e
                self.bytes_read += head.data
                yield from self._recording(path, head) if self.table == "recordings" else self._samples(f, path, head, begin, end, size)

    def _recording(self, path: str, h: Header) -> Iterator[pa.RecordBatch]:
        row = {"recording_id": self.recording(path), "filename": os.path.basename(path), "path": path, "duration_seconds": h.n_frames / h.rate, "rate": h.rate, "channels": h.channels, "n_frames": h.n_frames, "width": h.width}
        kinds = [pa.string(), pa.string(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int64(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds, strict=True)], list(row))

    def _samples(self, f: pa.NativeFile, path: str, h: Header, begin: int, end: int, size: int) -> Iterator[pa.RecordBatch]:
        """The frames that begin in this range and lie within all bounds, in blocks."""
        frame_at = lambda byte: min(max(0, -(-(byte - h.data) // h.frame)), h.n_frames)
        first, stop = frame_at(begin), h.n_frames if end >= size else frame_at(end)
        first = max(first, self.first, min(max(0, round(self.start * h.rate)), h.n_frames))
        if self.seconds is not None:
            stop = min(stop, min(max(0, round(self.start * h.rate)), h.n_frames) + round(self.seconds * h.rate))
        if self.last is not None:
            stop = min(stop, self.last + 1)
        name = self.recording(path)
        for at in range(first, stop, self.block):
            n = min(self.block, stop - at)
            f.seek(h.data + at * h.frame)
            raw = f.read(n * h.frame)
            self.bytes_read += len(raw)
            x = to_float(raw, h.width, h.floating).reshape(n, h.channels)
            if self.table == "blocks":
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([at], pa.int64()), pa.array([x.mean(axis=1)], pa.list_(pa.float32()))], ["recording_id", "first_sample", "samples"])
            elif self.each:
                for c in range(h.channels):
                    yield pa.RecordBatch.from_arrays([pa.repeat(name, n), pa.array(np.arange(at, at + n)), pa.array(x[:, c].astype(np.float64)), pa.repeat(pa.scalar(c, pa.int32()), n)], ["recording_id", "sample_idx", "value", "channel"])
            else:
                yield pa.RecordBatch.from_arrays([pa.repeat(name, n), pa.array(np.arange(at, at + n)), pa.array(x.mean(axis=1, dtype=np.float64))], ["recording_id", "sample_idx", "value"])


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # where a file is, and its name


class WavWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.rate, self.width = int(options["rate"]), int(options.get("width", 2))
        if self.width not in (1, 2, 3, 4):
            raise ValueError("width is 1 to 4 bytes")
        self.job = uuid.uuid4().hex

    def _job(self, root: str) -> str:
        return f"{root}/_temporary/{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, root = located(self.path)
        task = TaskContext.get()
        folder = f"{self._job(root)}/{task.partitionId()}-{task.taskAttemptId()}" if task else f"{self._job(root)}/0"
        done, out, name, at, n_frames = [], None, None, 0, 0

        def close() -> None:
            if out is None:
                return
            if at != n_frames:
                raise ValueError(f"{name}: {at} frames came, {n_frames} were announced")
            out.write(b"\0" * (n_frames * self.width % 2))
            out.close()

        try:
            for batch in iterator:
                col = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
                for i in range(batch.num_rows):
                    samples = np.asarray(col["samples"][i].values) if col["samples"][i].is_valid else np.zeros(0)
                    here, first = col["name"][i].as_py(), col["first_sample"][i].as_py() if "first_sample" in col else 0
                    if here != name or "first_sample" not in col:
                        close()
                        out, name, at = None, here, 0
                        n_frames = col["n_frames"][i].as_py() if "n_frames" in col else len(samples)
                        if not name or os.path.isabs(name) or {"", ".", ".."} & set(name.split("/")):
                            raise ValueError(f"{name!r} is no name for a file")
                        file = name if name.lower().endswith(EXTENSION) else name + EXTENSION
                        target = f"{folder}/{file}"
                        files.create_dir(os.path.dirname(target), recursive=True)
                        out = files.open_output_stream(target)
                        out.write(pcm_header(n_frames, self.rate, self.width))
                        done.append((target, file))
                    if first < at:
                        raise ValueError(f"{name}: sample {first} came after sample {at - 1}")
                    while at < first:  # a gap is silence
                        n = min(first - at, BLOCK_FRAMES)
                        out.write(to_pcm(np.zeros(n), self.width))
                        at += n
                    out.write(to_pcm(samples, self.width))
                    at += len(samples)
            close()
        except BaseException:
            if out is not None and not out.closed:
                out.close()
            if files.get_file_info(folder).type != fs.FileType.NotFound:
                files.delete_dir(folder)
            raise
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        files, root = located(self.path)
        moves = [x for m in messages if m for x in m.files]
        names = [x[1] for x in moves]
        if twice := sorted(x for x, n in Counter(names).items() if n > 1):
            raise ValueError(f"written more than once: {twice[:5]}")
        files.create_dir(root, recursive=True)
        there = {x.path for x in files.get_file_info(fs.FileSelector(root, recursive=True)) if x.is_file and x.path.lower().endswith(EXTENSION) and "/_temporary/" not in x.path}
        if self.overwrite:
            for x in there:
                files.delete_file(x)
        elif clash := sorted(there & {f"{root}/{x}" for x in names}):
            raise FileExistsError(f"already there: {clash[:5]}")
        for source, name in moves:
            if "/" in name:
                files.create_dir(os.path.dirname(f"{root}/{name}"), recursive=True)
            files.move(source, f"{root}/{name}")
        self._clear(files, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*located(self.path))

    def _clear(self, files: fs.FileSystem, root: str) -> None:
        if files.get_file_info(self._job(root)).type != fs.FileType.NotFound:
            files.delete_dir(self._job(root))
        rest = f"{root}/_temporary"
        if files.get_file_info(rest).type != fs.FileType.NotFound and not files.get_file_info(fs.FileSelector(rest)):
            files.delete_dir(rest)


class WavSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        each = ", channel int" if self.options.get("channels") == "each" and self.options.get("table", "samples") == "samples" else ""
        return SCHEMAS.get(self.options.get("table", "samples"), SCHEMAS["samples"]) + each

    def reader(self, schema) -> WavReader:
        return WavReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WavWriter:
        return WavWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, and lets Spark push filters into Python sources, which this one needs."""
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(WavSource)
