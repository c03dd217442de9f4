"""Data sources of audio: WAV files by byte range, and logs of PCM messages as a stream with offsets.

Files are opened through pyarrow's file systems (local or shared folders, and the stores that it knows), in the
tasks that read them. A long file is many partitions, and no task holds more than its range.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Bytes of a range, samples of a row at most, and of a batch of rows, about.
RANGE_BYTES, ROW_SAMPLES, BATCH_SAMPLES = 32 << 20, 4_096, 1 << 16
#: Bytes that opening a file counts as, when small files are gathered into a partition.
OPEN_BYTES = 64 << 10
#: Samples of a message, and its bytes: a sequence number of 32 bits, then 16-bit samples.
MESSAGE = 320
MESSAGE_BYTES = 4 + 2 * MESSAGE


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def files(uri: str, ending: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files with an ending under a folder, in order; a file is itself."""
    store, path = opened(uri)
    info = store.get_file_info(path)
    every = [info] if info.is_file else store.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
    return sorted((x.path, x.size) for x in every if x.is_file and x.path.endswith(ending) and not x.base_name.startswith(("_", ".")))


class WavHeader:
    """Format and place of the samples of a PCM WAV file; reads the chunk headers only."""

    def __init__(self, stream, size: int):
        if stream.read(4) != b"RIFF" or len(stream.read(4)) < 4 or stream.read(4) != b"WAVE":
            raise ValueError("not a WAV file")
        self.rate = self.channels = self.width = 0
        while True:
            head = stream.read(8)
            if len(head) < 8:
                raise ValueError("a WAV file without samples")
            name, n = struct.unpack("<4sI", head)
            if name == b"data":
                self.start = stream.tell()
                self.bytes = min(n, size - self.start)  # a recording that was cut off says more than it has
                break
            body = stream.read(n + n % 2)
            if name == b"fmt ":
                kind, self.channels, self.rate, _, _, bits = struct.unpack_from("<HHIIHH", body)
                self.width = bits // 8
                self.floats = kind == 3
                if kind not in (1, 3, 0xFFFE) or self.width not in ((4, 8) if self.floats else (1, 2, 4)) or not self.channels:
                    raise ValueError("only PCM WAV of 8, 16 or 32 bits, or floats of 32 or 64")
        self.frame = self.width * self.channels


class Parts(InputPartition):
    """Parts (path, bytes of the file, start, stop) of files that a task reads one after the other."""

    def __init__(self, parts: list[tuple[str, int, int, int]]):
        self.parts = parts


def gathered(parts: Iterator[tuple[str, int, int, int]], most: int) -> list[Parts]:
    """Parts of files as partitions of about `most` bytes, so that many small files are few tasks."""
    out, own, n = [], [], 0
    for part in parts:
        weight = part[3] - part[2] + OPEN_BYTES
        if own and n + weight > most:
            out.append(Parts(own))
            own, n = [], 0
        own.append(part)
        n += weight
    return [*out, Parts(own)] if own else out


class WavReader(DataSourceReader):
    def __init__(self, options):
        self.uri, self.step = options["path"], int(options.get("rangeBytes", RANGE_BYTES))
        self.most = int(options.get("partitionBytes", self.step))
        self.strict = str(options.get("strict", "false")).lower() == "true"

    def partitions(self):
        """By the sizes of the files alone; headers are read by the tasks. A range is read with the part in which it begins."""
        return gathered(
            ((path, size, low, min(low + self.most, size)) for path, size in files(self.uri, ".wav") for low in range(0, max(size, 1), self.most)), self.most
        ) or [Parts([])]

    def _rows(self, store, path: str, size: int, low: int, high: int) -> Iterator[tuple[str, int, int, int, np.ndarray]]:
        with store.open_input_file(path) as f:
            try:
                head = WavHeader(f, size)
            except (ValueError, struct.error):
                if self.strict:
                    raise
                return
            step = max(self.step // head.frame, 1) * head.frame
            stop = head.start + head.bytes // head.frame * head.frame
            first, high = head.start + max(-(-(low - head.start) // step), 0) * step, min(high, stop)
            if first >= high:
                return
            end = min(first - (-(high - first) // step) * step, stop)  # of the last range that begins in this part
            row = min(step, ROW_SAMPLES * head.frame)
            block = max(BATCH_SAMPLES * head.frame // row, 1) * row if row == step else step
            for start in range(first, end, block):  # many short ranges, or a long one
                until = min(start + block, end)
                some = block if row == step else row
                for at in range(start, until, some):
                    f.seek(at)
                    mono = self._mono(f.read(min(some, until - at)), head)
                    for i in range(0, len(mono), row // head.frame):
                        place = at + i * head.frame
                        yield path, place if row == step else start, (place - head.start) // head.frame, head.rate, mono[i : i + row // head.frame]

    @staticmethod
    def _mono(raw: bytes, head: WavHeader) -> np.ndarray:
        if head.floats:
            x = np.frombuffer(raw, f"<f{head.width}").astype(np.float64)
        elif head.width == 1:
            x = (np.frombuffer(raw, np.uint8).astype(np.float64) - 128) / 128
        else:
            x = np.frombuffer(raw, f"<i{head.width}") / float(1 << (8 * head.width - 1))
        return x if head.channels == 1 else x.reshape(-1, head.channels).mean(1)

    def read(self, partition: Parts) -> Iterator[pa.RecordBatch]:
        store, _ = opened(self.uri)
        rows, n = [], 0
        for part in partition.parts:
            for row in self._rows(store, *part):
                rows.append(row)
                n += len(row[4])
                if n >= BATCH_SAMPLES:
                    yield self._batch(rows)
                    rows, n = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        *columns, samples = zip(*rows, strict=True)
        types = pa.string(), pa.int64(), pa.int64(), pa.int32()
        ends = np.concatenate([[0], np.cumsum([len(x) for x in samples])]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(samples)))
        return pa.RecordBatch.from_arrays([*(pa.array(v, t) for v, t in zip(columns, types, strict=True)), lists], ["path", "range", "first", "rate", "samples"])


class WavSource(DataSource):
    """spark.read.format("wav_ranges"): rows of up to 4,096 mono samples in -1..1, with the place of the first one in its file.

    Floats are taken as they are. Options: path; rangeBytes; partitionBytes, of the ranges that a task reads (default: rangeBytes); strict, to fail on files that aren't PCM WAV (else they have no rows).
    """

    @classmethod
    def name(cls):
        return "wav_ranges"

    def schema(self):
        return "path string, range long, first long, rate int, samples array<double>"

    def reader(self, schema):
        return WavReader(self.options)


class MessageReader(DataSourceStreamReader):
    """Offsets: bytes taken of each log. Logs only grow; a message that isn't whole yet waits."""

    def __init__(self, options):
        self.uri, self.step = options["path"], max(int(options.get("rangeBytes", RANGE_BYTES)) // MESSAGE_BYTES, 1) * MESSAGE_BYTES

    def initialOffset(self):
        return {}

    def latestOffset(self):
        return {path: size - size % MESSAGE_BYTES for path, size in files(self.uri, ".pcm")}

    def partitions(self, start, end):
        return gathered(
            ((path, stop, low, min(low + self.step, stop)) for path, stop in sorted(end.items()) for low in range(start.get(path, 0), stop, self.step)), self.step
        )

    def read(self, partition: Parts) -> Iterator[pa.RecordBatch]:
        store, _ = opened(self.uri)
        form = np.dtype([("seq", "<u4"), ("samples", "<i2", MESSAGE)])
        some = max(BATCH_SAMPLES // MESSAGE, 1) * MESSAGE_BYTES
        names, found, n = [], [], 0
        for path, _, low, high in partition.parts:
            session = path.rsplit("/", 1)[-1].removesuffix(".pcm")
            with store.open_input_file(path) as f:
                for at in range(low, high, some):
                    f.seek(at)
                    got = np.frombuffer(f.read(min(some, high - at)), form)
                    names += [session] * len(got)
                    found.append(got)
                    n += len(got)
                    if n * MESSAGE_BYTES >= some:
                        yield self._batch(names, found)
                        names, found, n = [], [], 0
        if found:
            yield self._batch(names, found)

    @staticmethod
    def _batch(names: list[str], found: list[np.ndarray]) -> pa.RecordBatch:
        rows = np.concatenate(found)
        samples = pa.array(np.ascontiguousarray(rows["samples"]).reshape(-1), pa.int16())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * MESSAGE), samples)
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(rows["seq"].astype(np.int64)), lists], ["session", "seq", "samples"])


class MessageSource(DataSource):
    """spark.readStream.format("pcm_messages"): (session, seq, samples) of logs session.pcm that grow. Options: path, rangeBytes."""

    @classmethod
    def name(cls):
        return "pcm_messages"

    def schema(self):
        return "session string, seq long, samples array<short>"

    def streamReader(self, schema):
        return MessageReader(self.options)


def register(spark) -> None:
    spark.dataSource.register(WavSource)
    spark.dataSource.register(MessageSource)


def wav_bytes(samples: np.ndarray, rate: int, channels: int = 1) -> bytes:
    """A WAV file: of 16-bit samples, or of 64-bit floats if the samples are floats."""
    kind, width = (3, 8) if samples.dtype.kind == "f" else (1, 2)
    data = np.ascontiguousarray(samples, "<f8" if kind == 3 else "<i2").tobytes()
    form = struct.pack("<HHIIHH", kind, channels, rate, rate * channels * width, channels * width, 8 * width)
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<I", 16) + form + b"data" + struct.pack("<I", len(data)) + data


def put(uri: str, name: str, data: bytes, append: bool = False) -> None:
    """Write or extend a file in a folder of a store."""
    store, path = opened(uri)
    store.create_dir(path, recursive=True)
    with (store.open_append_stream if append else store.open_output_stream)(f"{path}/{name}") as f:
        f.write(data)
