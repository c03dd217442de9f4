"""Streams replayed from files: the events in four parts, each a micro-batch; the rows equal those of the batch folds."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.functions.dialect import Duck
from voxlake.sources.places import scratch
from voxlake.streaming import stateful

from .folds import fold
from .registry import ORACLE, query

PARTS = 4
#: Rows of a replayed file, about.
FILE_ROWS = 1_000_000


def replay(rows: DataFrame, order: str = "seq") -> DataFrame:
    """Rows as a stream of PARTS micro-batches, by ranges of the number `order`; a part has as many files as its rows need."""
    spark, path, by = rows.sparkSession, scratch(rows.sparkSession, "replay"), F.expr(order)
    least, most, n = rows.agg(F.min(by), F.max(by), F.count("*")).first()
    least, most, files = least or 0, most or 0, max(1, n // PARTS // FILE_ROWS)
    for i in range(PARTS):  # one after the other: the source takes files by age
        low, high = least + (most - least) * i // PARTS, least + (most - least) * (i + 1) // PARTS
        some = (by > low) & (by <= high) if i else by <= high
        rows.where(some).repartition(files).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as rows of a stream: key, seq, p, ts, value."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), (F.col("value") / 100).alias("p"), F.col("ts").cast("timestamp").alias("ts"), "value")


def _replayed(spark: SparkSession, sf_dir: str, by: str = "seq") -> DataFrame:
    return replay(frames(spark, sf_dir), by)


def landed(events: DataFrame) -> DataFrame:
    """All rows that a stream writes until its files are used up."""
    spark = events.sparkSession
    path, at = scratch(spark, "landed"), scratch(spark, "offsets")
    done = events.writeStream.format("parquet").option("path", path).option("checkpointLocation", at).outputMode("append")
    done.queryName(f"replay-{uuid.uuid4().hex[:8]}").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(events.schema).parquet(path)


def _sessions(spark: SparkSession, sf_dir: str, machine, **how) -> DataFrame:
    found = landed(stateful.sessions(_replayed(spark, sf_dir), machine, **how)).where("event <> 'disconnected'")
    return found.select(F.col("key").alias("user_id"), F.col("seq").alias("event_id"), "event")


def _sql(name: str) -> str:
    return f"SELECT user_id, event_id, event FROM ({ORACLE[name]}) q"


@query(_sql("session_hysteresis"))
def stream_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sessions(spark, sf_dir, stateful.Endpointer)


@query(_sql("provisional_events"))
def stream_provisional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sessions(spark, sf_dir, stateful.Provisional)


@query(_sql("duck_stop_resume"))
def stream_controller(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sessions(spark, sf_dir, stateful.Controller, content=True)


@query("""WITH a AS (SELECT user_id, event_id, value >= 50 AS high, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
b AS (SELECT *, i - row_number() OVER (PARTITION BY user_id, high ORDER BY event_id) AS run FROM a)
SELECT user_id, event_id, 'fire' AS event FROM (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY event_id) AS k FROM b WHERE high) x WHERE k = 3""")
def stream_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sessions(spark, sf_dir, stateful.Debouncer)


HELD = fold(
    Duck(), "", "SELECT user_id, event_id, value >= 50 AS up FROM events", "user_id", "event_id", "event_id up",
    {"high": ("CAST(0 AS bigint)", "CASE WHEN x.up THEN CASE WHEN a.high + 1 = 3 THEN 0 ELSE a.high + 1 END ELSE 0 END"),
     "low": ("CAST(0 AS bigint)", "CASE WHEN x.up THEN 0 WHEN a.low + 1 = 2 THEN 0 ELSE a.low + 1 END")},
    {"event": "CAST(CASE WHEN x.up AND a.high + 1 = 3 THEN 'released' WHEN NOT x.up AND a.low + 1 = 2 THEN 'discarded' END AS string)"})


@query(HELD + " SELECT g AS user_id, event_id, event FROM folded WHERE event IS NOT NULL")
def stream_hold_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sessions(spark, sf_dir, stateful.HoldBack)


@query("SELECT DISTINCT user_id, event_id // 2 AS turn FROM events")
def stream_acks(spark: SparkSession, sf_dir: str) -> DataFrame:
    acks = _replayed(spark, sf_dir).select(F.col("key").alias("session"), F.expr("seq div 2").alias("turn"), "ts", "value")
    return landed(stateful.latest_acks(acks, "400 days")).select(F.col("session").alias("user_id"), "turn")


@query("""WITH h AS (SELECT date_trunc('hour', ts) AS hour, ts, value FROM events)
SELECT CAST(epoch_us(hour) // 3600000000 AS bigint) AS hour, count(*) AS n, round(sum(value), 4) AS total FROM h WHERE hour + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY hour""")
def stream_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = landed(stateful.counts(_replayed(spark, sf_dir, "unix_micros(ts)")))
    return out.select(F.floor(F.unix_seconds("hour") / 3600).alias("hour"), "n", F.round("total", 4).alias("total"))
