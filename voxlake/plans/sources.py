"""Audio and message sources, restarted micro-batches, fenced appends, table functions: over files that come from the tables."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from voxlake.functions.dialect import Spark as SparkDialect
from voxlake.sources import fenced, pcm
from voxlake.sources.places import scratch, stored
from voxlake.streaming import batches

from .catalogue import segments
from .registry import ORACLE, query
from .sql import opened
from .streams import frames, landed, replay

RATE = 16_000


def _uri(path: str) -> str:
    return path if "://" in path else f"file://{path}"


@query(f"""SELECT user_id, count(*) AS samples, round(count(*) / {RATE}e0, 6) AS seconds, CAST(greatest(1, (count(*) - 64) // 32 + 1) AS bigint) AS frames,
  CAST(sum(CAST(round(value * 100) AS bigint)) AS bigint) AS level, CAST(ceil(count(*) / 8e0) AS bigint) AS ranges FROM events WHERE value IS NOT NULL GROUP BY user_id""")
def wav_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A WAV file per user, written by tasks; read by ranges of 8 samples, as a long recording is by ranges of megabytes.

    Samples are floats, as a level may be beyond 16 bits. A task reads many ranges.
    """
    folder = _uri(scratch(spark, "wav"))
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").where("value IS NOT NULL").select("user_id", "event_id", (F.round(F.col("value") * 100) / 32_768).alias("x"))

    def write(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        pcm.put(folder, f"{key[0]}.wav", pcm.wav_bytes(group.sort_values("event_id")["x"].to_numpy(), RATE))
        return pd.DataFrame({"user_id": [key[0]]})

    stored(rows.groupBy("user_id").applyInPandas(write, "user_id long"), "wav-names")
    pcm.register(spark)
    read = spark.read.format("wav_ranges").option("path", folder).option("rangeBytes", 8 * 8).option("partitionBytes", pcm.RANGE_BYTES).load()
    level = F.aggregate("samples", F.lit(0).cast("long"), lambda a, x: a + F.round(x * 32_768).cast("long"))
    user = F.expr(r"try_cast(regexp_extract(path, '([^/]+)[.]wav$', 1) AS long)").alias("user_id")
    found = read.groupBy(user).agg(F.sum(F.size("samples")).alias("samples"), F.sum(level).alias("level"), F.count_distinct("range").alias("ranges"), F.max("rate").alias("rate"))
    frames_ = F.greatest(F.lit(1), F.floor((F.col("samples") - 64) / 32) + 1).cast("long")
    return found.select("user_id", "samples", F.round(F.col("samples") / F.col("rate"), 6).alias("seconds"), frames_.alias("frames"), "level", "ranges")


@query("SELECT user_id, event_id, CAST(round(value * 100) AS bigint) AS level FROM events WHERE value IS NOT NULL")
def message_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs of PCM messages that grow while they are read: the second half is appended once the first was taken.

    A level is four samples, its 16-bit words, repeated over the message.
    """
    folder = _uri(scratch(spark, "messages"))
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").where("value IS NOT NULL").select("user_id", "event_id", F.round(F.col("value") * 100).cast("long").alias("x"))
    rows = rows.withColumn("late", F.percent_rank().over(Window.partitionBy("user_id").orderBy("event_id")) > 0.5)

    def write(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("event_id")
        words = np.ascontiguousarray(group["x"], "<i8").view("<i2").reshape(-1, 4)
        data = b"".join(struct.pack("<I", seq) + np.tile(x, pcm.MESSAGE // 4).tobytes() for seq, x in zip(group["event_id"], words, strict=True))
        pcm.put(folder, f"{key[0]}.pcm", data, append=bool(group["late"].iloc[0]))
        return pd.DataFrame({"user_id": [key[0]]})

    pcm.register(spark)
    path, at = scratch(spark, "landed"), scratch(spark, "offsets")
    for late in (False, True):
        stored(rows.where(F.col("late") == late).groupBy("user_id").applyInPandas(write, "user_id long"), "log-names")
        stream = spark.readStream.format("pcm_messages").option("path", folder).load()
        word = lambda i: F.get("samples", F.lit(pcm.MESSAGE - 4 + i)).cast("long")
        level = word(3)
        for i in (2, 1, 0):
            level = F.shiftleft(level, 16).bitwiseOR(word(i).bitwiseAND(F.lit(0xFFFF).cast("long")))
        level = stream.select(F.expr("try_cast(session AS long)").alias("user_id"), F.col("seq").alias("event_id"), level.alias("level"))
        level.writeStream.format("parquet").option("path", path).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(level.schema).parquet(path)


@query("SELECT event_id, round(max(value) * 2, 6) AS doubled FROM events GROUP BY event_id")
def resumed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream whose worker is stopped between the write and the commit of its second micro-batch, and started again."""
    rows = frames(spark, sf_dir).select(F.col("seq").alias("event_id"), "value")
    stream = replay(rows, "event_id")
    path, at = scratch(spark, "batches"), scratch(spark, "offsets")
    work = lambda found: found.select("event_id", F.round(F.col("value") * 2, 6).alias("doubled"))

    def crash(number: int) -> None:
        if number == 1:
            raise RuntimeError("stopped before the commit")

    try:
        batches.run(stream, path, at, work, "event_id", crash)
    except Exception as error:
        if "stopped before the commit" not in str(error):
            raise
    batches.run(stream, path, at, work, "event_id")
    return batches.written(spark, path).select("event_id", "doubled")


@query("""WITH a AS (SELECT doc_id, 1 AS version FROM documents WHERE doc_id % 2 = 0), b AS (SELECT doc_id, 2 FROM documents WHERE doc_id % 2 = 1)
SELECT version, count(*) AS n, CAST(sum(doc_id) AS bigint) AS ids FROM (SELECT * FROM a UNION ALL SELECT * FROM b) t GROUP BY version""")
def fenced_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two writers that have read the same version: the second is refused, reads again and appends; a third one's repeated ids are refused."""
    table = fenced.FencedTable(spark, scratch(spark, "fenced"), "doc_id long, lang string")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    even, odd, check = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1"), fenced.new_keys("doc_id")
    seen = table.version()
    table.append(even, check, onto=seen)
    try:
        table.append(odd, check, onto=seen)
        raise AssertionError("a stale writer must be refused")
    except fenced.Conflict:
        table.append_again(odd, check)
    try:
        table.append(even, check)
        raise AssertionError("repeated ids must be refused")
    except ValueError:
        pass
    return table.rows().groupBy("version").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


# ---- table functions --------------------------------------------------------------------------------


@udtf(returnType="turn: bigint, overlap: double")
class WindowCandidates:
    """Candidate pairs of a window: every second pair of neighbours that doesn't overlap the one taken before."""

    def eval(self, turns: list):
        rows = sorted(turns, key=lambda t: (t["start"], t["stop"], t["turn"]))
        until = -1.0
        for a, b in list(zip(rows, rows[1:], strict=False))[::2]:
            lengths = a["stop"] - a["start"], b["stop"] - b["start"]
            if a["speaker"] == b["speaker"] or b["start"] - a["stop"] > 2.5 or min(lengths) < 0.25:
                continue
            if min(a["start"], b["start"]) < until:
                continue
            until = max(a["stop"], b["stop"])
            overlap = min(a["stop"], b["stop"]) - max(a["start"], b["start"])
            if overlap >= 0.2:
                yield a["turn"], round(overlap, 6)


@query(ORACLE["qa_candidates"])
def window_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`qa_candidates` by a table function, called for each window with LATERAL."""
    spark.udtf.register("window_candidates", WindowCandidates)
    text = f"""WITH {segments(SparkDialect())}, w AS (SELECT conv_id, collect_list(struct(turn, speaker, start, stop)) AS turns FROM seg GROUP BY conv_id)
SELECT w.conv_id, c.turn, c.overlap FROM w, LATERAL window_candidates(w.turns) c"""
    return opened(spark, sf_dir, text)
