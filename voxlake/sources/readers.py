"""Sources: JSON lines in three modes, CSV, recursive listings, session folders, PCM audio and frames, resumed work."""

from __future__ import annotations

import io
import struct
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from . import pcm

BAD = "_bad_line"
#: Bytes of a batch of lines or paths, about, and of a file that are read at once.
BATCH_BYTES, BLOCK = 1 << 20, 1 << 16


def _schema(schema: str | StructType) -> StructType:
    return StructType.fromDDL(schema) if isinstance(schema, str) else schema


def jsonl(spark: SparkSession, path: str, schema: str | StructType, name: str | None = None) -> DataFrame:
    """Rows of JSON lines; blank lines are skipped, other lines that don't parse are rows of nulls.

    With a name, of the files so called in all folders under path.
    """
    rows = spark.read.schema(_schema(schema))
    return (rows.option("recursiveFileLookup", True).option("pathGlobFilter", name) if name else rows).json(path)


def jsonl_tolerant(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Rows of JSON lines with the column `_bad_line`: the line where it doesn't parse or has other types, else null."""
    with_bad = StructType([*_schema(schema).fields, StructField(BAD, StringType())])
    return spark.read.schema(with_bad).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD).json(path)


def jsonl_strict(spark: SparkSession, path: str, schema: str | StructType, duration: str | None = None) -> DataFrame:
    """Rows of JSON lines; reading raises at a line that doesn't parse, or whose duration is not finite or below 0 (null: 0)."""
    rows = jsonl_tolerant(spark, path, schema)
    # every column takes part, so that none is pruned and lines are parsed whole
    whole = F.pmod(F.xxhash64(*[c for c in rows.columns if c != BAD]), F.lit(1)) == 0
    fault = F.when(F.col(BAD).isNotNull() & whole, F.concat(F.lit("bad line: "), F.substring(BAD, 1, 200)))
    if duration:
        x = F.coalesce(F.col(duration).cast("double"), F.lit(0.0))
        fault = fault.when(F.isnan(x) | (x < 0) | (x == float("inf")), F.concat(F.lit("bad duration: "), x.cast("string")))
    fine = F.when(fault.isNotNull(), F.raise_error(fault).cast("boolean")).otherwise(F.lit(True))
    return rows.where(fine).drop(BAD)


def csv(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """Rows of CSV files with a header, as strings; a byte-order mark before the header is dropped."""
    rows = spark.read.option("header", True).option("recursiveFileLookup", recursive).option("multiLine", False).csv(path)
    return rows.toDF(*[c.lstrip("﻿") for c in rows.columns])


def episodes(spark: SparkSession, path: str, sentinel: str = "no_captions_found.csv", least_rows: int = 50) -> DataFrame:
    """CSV rows of all files under path, with the column `file`; files named `sentinel` or of fewer rows are left out."""
    rows = csv(spark, path, recursive=True).withColumn("file", F.input_file_name())
    rows = rows.where(~F.col("file").endswith(f"/{sentinel}"))
    enough = rows.groupBy("file").agg(F.count("*").alias("n")).where(F.col("n") >= least_rows).select("file")
    return rows.join(enough, "file", "left_semi")


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, modificationTime) of the files under a folder of any store that Spark reads; contents aren't read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return rows.select("path", "length", "modificationTime")


def _roots(spark: SparkSession, path: str) -> list[str]:
    """Addresses for pyarrow of the folders that a path or pattern names; none if there are none, or pyarrow doesn't know the store."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place)
    uris = [x.getPath().toUri().toASCIIString() for x in found or []]
    uris = [f"file://{x.removeprefix('file:')}" if x.startswith("file:/") and not x.startswith("file://") else x for x in uris]
    try:
        for uri in uris[:1]:
            pcm.opened(uri)
    except (OSError, ValueError, NotImplementedError):
        return []
    return uris


def _inside(store: fs.FileSystem, path: str, name: str) -> list[fs.FileInfo]:
    """The folders in a folder that Spark's listings take, and its file of that name; a file is itself."""
    info = store.get_file_info(path)
    every = [info] if info.is_file else store.get_file_info(fs.FileSelector(path))
    hidden = lambda x: x.startswith(".") or (x.startswith("_") and "=" not in x) or x.endswith("._COPYING_")
    return [x for x in every if (x.is_file and x.base_name == name) or (x.type == fs.FileType.Directory and not hidden(x.base_name))]


def _gathered(rows: Iterator[tuple], **types: pa.DataType) -> Iterator[pa.RecordBatch]:
    some, n = [], 0
    batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), types.values(), strict=True)], list(types))
    for row in rows:
        some.append(row)
        n += 64 + sum(map(len, row))
        if n >= BATCH_BYTES:
            yield batch()
            some, n = [], 0
    if some:
        yield batch()


def folder_lines(spark: SparkSession, roots: list[str], name: str) -> DataFrame:
    """(folder, value): the lines of the files so called in all folders under the roots (of one store); blank lines are skipped.

    Tasks list the folders and read the files: two levels are listed and dealt out, the folders below walked by the task that reads
    them. The driver knows the roots alone, however many files there are. The planner takes the rows as of unknown size, so they
    are joined by shuffles unless a run shows that they are few.
    """
    first, n = roots[0], int(spark.conf.get("spark.sql.shuffle.partitions"))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = pcm.opened(first)
        yield from _gathered(((x.path,) for batch in batches for path in batch["path"].to_pylist() for x in _inside(store, path, name)), path=pa.string())

    def lines(store: fs.FileSystem, path: str) -> Iterator[tuple[str, bytes]]:
        todo = [path]
        while todo:
            for x in _inside(store, todo.pop(), name):
                if not x.is_file:
                    todo.append(x.path)
                    continue
                folder = x.path.split("/")[-2]
                with store.open_input_stream(x.path) as f:
                    for part in (p.removeprefix(b"\xef\xbb\xbf") for line in io.BufferedReader(f, BLOCK) for p in line.splitlines()):
                        if part.strip(b" \t"):
                            yield folder, part

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = pcm.opened(first)
        yield from _gathered((row for batch in batches for path in batch["path"].to_pylist() for row in lines(store, path)), folder=pa.string(), value=pa.binary())

    folders = spark.createDataFrame([(pcm.opened(x)[1],) for x in roots], "path string")
    for _ in range(2):
        folders = folders.mapInArrow(listed, "path string").repartition(n, "path")
    return folders.mapInArrow(read, "folder string, value binary")


def session_folders(spark: SparkSession, path: str, meta: str, turns: str, ratings: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sessions, turns, ratings) of folders with meta.json, turns.jsonl and mos.jsonl; only sessions with consent.

    The folder is the session, at any depth under path; turns and ratings of others are dropped. Tasks list the folders; in a store
    that only Spark reaches, the driver does, and needs memory for every file.
    """
    roots = _roots(spark, path)

    def read(name: str, schema: str) -> DataFrame:
        if not roots:
            folder = F.replace(F.regexp_extract(F.input_file_name(), r"/([^/]+)/[^/]+$", 1), F.lit("+"), F.lit("%2B"))
            return jsonl(spark, path, schema, name).withColumn("folder", F.url_decode(folder))
        # as with Spark's reader of JSON lines, an array has a row for each of its objects, and a line that doesn't parse is a row of nulls
        kind = ArrayType(_schema(schema))
        rows = F.coalesce(F.from_json(F.try_validate_utf8(F.col("value").cast("string")), kind), F.array(F.lit(None).cast(kind.elementType)))
        rows = folder_lines(spark, roots, name).select(F.col("folder").alias("_folder"), F.explode(rows).alias("_row"))
        return rows.select("_row.*", "_folder").withColumn("folder", F.col("_folder")).drop("_folder")

    sessions = read("meta.json", meta).where("consent <=> true")
    ids = sessions.select("folder")
    return sessions, read("turns.jsonl", turns).join(ids, "folder", "left_semi"), read("mos.jsonl", ratings).join(ids, "folder", "left_semi")


def remaining(rows: DataFrame, done: DataFrame | None, key: str) -> DataFrame:
    """Rows whose key is not in the output written so far (None: nothing was)."""
    return rows if done is None else rows.join(done.select(key).distinct(), key, "left_anti")


def memory_peaks(samples: DataFrame, roles: DataFrame) -> DataFrame:
    """(stamp, pid, mib) of processes and (pid, role) -> one row: samples, peak by role, peak of the stamps that have all roles."""
    by = samples.join(roles, "pid").groupBy("stamp", "role").agg(F.sum("mib").alias("mib"))  # a row per process
    n = roles.select("role").distinct().count()
    totals = by.groupBy("stamp").agg(F.sum("mib").alias("total"), F.count("*").alias("n"))
    peaks = by.groupBy("role").agg(F.max("mib").alias("peak"))
    peaks = peaks.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("role", "peak")))).alias("peak"))
    return totals.agg(F.count("*").alias("samples"), F.max(F.when(F.col("n") == n, F.col("total"))).alias("stack")).crossJoin(peaks)


# ---- audio ---------------------------------------------------------------------------------------


def resampled(x: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Samples at another rate: a windowed-sinc low-pass at the lower Nyquist rate, evaluated at the new times."""
    if rate == to or not len(x):
        return x.astype(np.float32)
    n, half, cut = max(1, round(len(x) * to / rate)), 16, min(1.0, to / rate)
    reach = int(np.ceil(half / cut))
    at = np.arange(n) * rate / to
    near = np.floor(at).astype(int)[:, None] + np.arange(-reach + 1, reach + 1)
    gap = at[:, None] - near
    weight = cut * np.sinc(cut * gap) * np.where(np.abs(gap) < reach, 0.5 + 0.5 * np.cos(np.pi * gap / reach), 0)
    inside = (near >= 0) & (near < len(x))
    weight = np.where(inside, weight, 0)
    return ((x[np.clip(near, 0, len(x) - 1)] * weight).sum(1) / np.maximum(weight.sum(1), 1e-9)).astype(np.float32)


def decoded(data: bytes, rate: int = 16_000) -> np.ndarray | None:
    """A PCM WAV file as mono floats in -1..1 at `rate`; None if it is none."""
    try:
        with wave.open(io.BytesIO(data)) as w:
            width, channels, own, raw = w.getsampwidth(), w.getnchannels(), w.getframerate(), w.readframes(w.getnframes())
    except (wave.Error, EOFError):
        return None
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif width in (2, 4):
        x = np.frombuffer(raw, f"<i{width}").astype(np.float32) / float(1 << (8 * width - 1))
    else:
        return None
    return resampled(x.reshape(-1, channels).mean(1), own, rate)


def audio(spark: SparkSession, path: str, rate: int = 16_000) -> DataFrame:
    """(path, samples, seconds) of the WAV files under a folder; files that don't decode have nulls."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [decoded(x, rate) for x in batch["content"]]
            yield pd.DataFrame({"path": batch["path"], "samples": pd.Series(found, index=batch.index, dtype=object), "seconds": [None if x is None else len(x) / rate for x in found]})

    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.wav").load(path)
    return rows.select("path", "content").mapInPandas(run, "path string, samples array<float>, seconds double")


#: Samples of a message of a live client.
MESSAGE = 320


def frames(messages: DataFrame) -> DataFrame:
    """(session, data) binary messages -> (session, seq, playback, samples, fault).

    A message is a sequence number (little-endian, 32 bits), then optionally the
    playback level (32-bit float), then 320 samples of 16 bits. Others are faults.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for session, data in zip(batch["session"], batch["data"], strict=True):
                data = bytes(data or b"")
                head = {4 + 2 * MESSAGE: "<I", 8 + 2 * MESSAGE: "<If"}.get(len(data))
                if head is None:
                    out.append((session, None, None, None, f"{len(data)} bytes"))
                    continue
                got = struct.unpack_from(head, data)
                samples = np.frombuffer(data, "<i2", MESSAGE, struct.calcsize(head)).tolist()
                out.append((session, got[0], got[1] if len(got) > 1 else None, samples, None))
            rows = pd.DataFrame(out, columns=["session", "seq", "playback", "samples", "fault"])
            rows["seq"] = rows["seq"].astype("Int64")
            yield rows

    return messages.select("session", "data").mapInPandas(run, "session string, seq long, playback double, samples array<short>, fault string")
