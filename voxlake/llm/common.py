"""Shared pieces of the training-data operators: words, checkpoints, reading."""

from __future__ import annotations

import ctypes
import gc
import shutil
import string
import tempfile
import uuid
import weakref
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of lower-cased text: ASCII letters and digits and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words before A-Z are lower-cased.
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Runs of anything but ASCII white space.
CHUNK = r"[^\x20\x09-\x0D]+"

#: Largest number of rows that is ever broadcast by hint; every use counts first.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; `lower` does the same, faster, on pure ASCII."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def words(text: Column) -> Column:
    """Array of words; null text has none."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def grams(hashes: Column, k: int) -> Column:
    """Hash of every k consecutive elements, in order; empty if there are fewer."""
    n = F.size(hashes)
    return F.when(
        n >= k,
        F.transform(
            F.sequence(F.lit(0), n - k),
            lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(k)]),
        ),
    ).otherwise(F.array().cast("array<bigint>"))


#: The setting by which Spark drops the shuffle files of a query when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows of an Arrow batch while a step is written: texts are long, and two batches of each worker are in memory.
ARROW_ROWS = 2_000
#: Rows of two numbers that are worth a file of their own.
FILE_ROWS = 100_000
_places: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir.

    Where that is unset, a folder of this machine serves a local master (tests);
    on a cluster executors would not see it, so that is an error.
    """
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        given = f"{tempfile.gettempdir()}/checkpoints"
    return given.rstrip("/")


def _folder(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def scratch(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder; what is written there goes when the JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    place, system = _folder(spark, path)
    system.deleteOnExit(place)
    return path


def stored(df: DataFrame, path: str) -> None:
    """Write `df` to `path`; the shuffle files that the write needed go at once, and Arrow batches have ARROW_ROWS rows."""
    spark = df.sparkSession
    how = {SHUFFLE_CLEANUP: "true", "spark.sql.execution.arrow.maxRecordsPerBatch": str(ARROW_ROWS)}
    before = {k: spark.conf.get(k) for k in how}
    try:
        for k, v in how.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def few_files(df: DataFrame, rows: int) -> DataFrame:
    """`df`, of about so many rows, in a file for each core or each FILE_ROWS: every file costs its task three processes on a local disk."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // FILE_ROWS)))


def saved(df: DataFrame, name: str = "step") -> DataFrame:
    """Write `df` to the shared folder and read it back: lineage ends there.

    The files go with `discard`, or when the JVM ends. A lost executor costs only the tasks it ran.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    stored(df, path)
    out = spark.read.schema(df.schema).parquet(path)
    _places[out] = path
    return out


def discard(*steps: DataFrame) -> None:
    """Delete the files of saved steps that nothing reads any more."""
    for step in steps:
        place, system = _folder(step.sparkSession, _places.pop(step))
        system.delete(place, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether `df` has at most `rows` rows; reads no more than it must."""
    return df.limit(rows + 1).count() <= rows


def hinted(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df` with a broadcast hint if it is small, else as it is (a shuffle join)."""
    return F.broadcast(df) if small(df, rows) else df


def components(links: DataFrame) -> DataFrame:
    """Connected components of `links` (a bigint, b bigint) as (id, component_id).

    component_id is the smallest id reachable. Alternates large-star and
    small-star steps; every round is written to the shared folder and no list
    of neighbours is gathered: each step needs only the minimum of a node's
    neighbours, which is pre-aggregated before the shuffle.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = saved(edges.where("u <> v").distinct(), "links")
    rows, before = edges.count(), None
    while True:
        last = edges
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        # large star: greater neighbours move to the least of the neighbourhood
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = large.where("u <> v").distinct()
        # small star: lesser neighbours, and the node itself, move to the least
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        own = least.select("u", F.col("m").alias("v"))
        edges = saved(few_files(moved.unionByName(own).where("u <> v").distinct(), rows), "links")
        discard(last)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        rows, before = now[0], now
    nodes = edges.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct()
    return nodes.unionByName(roots)


_held: dict[str, Callable[[], None]] = {}


def give_back() -> None:
    """Return freed memory to the machine, as far as the C library can: a worker goes on with another operator beside the JVM, the driver with the next step."""
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def hold(owner: str, clear: Callable[[], None]) -> None:
    """A worker's memory of words belongs to one operator at a time: those of others are cleared, as workers outlive steps."""
    if owner not in _held:
        for other in _held.values():
            other()
        if _held:
            give_back()
        _held.clear()
        _held[owner] = clear


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hand this package to the executors, once for each Spark application."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        package = Path(__file__).resolve().parents[1]
        archive = shutil.make_archive(f"{tempfile.mkdtemp()}/{package.name}", "zip", package.parent, package.name)
        sc.addPyFile(archive)
        _shipped.add(sc.applicationId)


def map_pandas(df: DataFrame, function, schema) -> DataFrame:
    """mapInPandas with this package at hand on the executors."""
    ship(df.sparkSession)
    return df.mapInPandas(function, schema)


def column_udf(spark: SparkSession, function, schema: str, *cols) -> Column:
    """A column computed from whole columns as pandas Series, batch by batch; other columns stay in the JVM."""
    ship(spark)
    return F.pandas_udf(function, schema)(*cols)
