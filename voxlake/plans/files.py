"""Round trips through the sources and sinks: tables are written as files in the shared folder and read back."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxlake.sources import pcm, readers, sinks
from voxlake.sources.places import scratch, stored

from .registry import query

#: Folders over the folders of sessions, so that a listing is so many tasks.
SHARDS = 256


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ROW = "doc_id long, source string, lang string, duration double"
MANIFEST = "SELECT doc_id, source, lang, n_chars / 150e0 AS duration FROM documents"


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", "source", "lang", (F.col("n_chars") / F.lit(150.0)).alias("duration"))


@query(f"SELECT lang, count(*) AS n, round(sum(duration), 4) AS seconds FROM ({MANIFEST}) m GROUP BY lang")
def jsonl_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "manifest")
    sinks.write_jsonl(_manifest(spark, sf_dir), path)
    return readers.jsonl(spark, path, ROW).groupBy("lang").agg(F.count("*").alias("n"), F.round(F.sum("duration"), 4).alias("seconds"))


@query("""SELECT CAST(sum(CASE WHEN doc_id % 10 <> 0 THEN 1 ELSE 0 END) AS bigint) AS rows_, CAST(sum(CASE WHEN doc_id % 10 = 0 THEN 1 ELSE 0 END) AS bigint) AS schema_errors,
  round(sum(CASE WHEN doc_id % 10 <> 0 THEN n_chars / 150e0 ELSE 0e0 END), 4) AS seconds FROM documents""")
def jsonl_tolerant_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "torn")
    line = F.to_json(F.struct("doc_id", "source", "lang", "duration"))
    torn = F.when(F.col("doc_id") % 10 == 0, F.expr("substr(line, 1, length(line) - 9)")).otherwise(F.col("line"))
    _manifest(spark, sf_dir).select("doc_id", line.alias("line")).select(torn.alias("value")).write.text(path)
    rows = readers.jsonl_tolerant(spark, path, ROW)
    bad = F.col(readers.BAD).isNotNull()
    rows = rows.select(bad.alias("bad"), "duration", "doc_id")
    return rows.agg(F.count_if(~F.col("bad")).alias("rows_"), F.count_if("bad").alias("schema_errors"), F.round(F.sum(F.when(~F.col("bad"), F.col("duration")).otherwise(0.0)), 4).alias("seconds"))


@query(f"SELECT source, count(*) AS n, round(max(duration), 6) AS longest FROM ({MANIFEST}) m GROUP BY source")
def jsonl_strict_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "strict")
    sinks.write_jsonl(_manifest(spark, sf_dir), path)
    rows = readers.jsonl_strict(spark, path, ROW, "duration")
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.round(F.max("duration"), 6).alias("longest"))


@query("SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY c_mktsegment")
def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "sheet")
    rows = _table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    rows.toDF("﻿c_custkey", "c_mktsegment", "c_acctbal").write.option("header", True).csv(path)
    found = readers.csv(spark, path)
    return found.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum(F.col("c_acctbal").cast("double")), 2).alias("balance"))


@query("SELECT l_shipmode AS kind, count(*) AS n FROM (SELECT 'k' || (l_partkey % 40) AS l_shipmode FROM lineitem WHERE l_partkey % 40 < 30 OR l_orderkey % 400 = 0) x GROUP BY ALL HAVING count(*) >= 50")
def episode_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "episodes")
    rows = _table(spark, sf_dir, "lineitem").where("l_partkey % 40 < 30 OR l_orderkey % 400 = 0")
    rows = rows.select("l_orderkey", F.concat(F.lit("k"), F.col("l_partkey") % 40).alias("kind"))
    rows.withColumn("episode", F.col("kind")).repartition("episode").write.partitionBy("episode").option("header", True).csv(path)  # a file per episode
    return readers.episodes(spark, path).groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT lang, count(DISTINCT lang) AS files, count(*) > 0 AS filled FROM documents GROUP BY lang")
def file_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "listed")
    _table(spark, sf_dir, "documents").select("doc_id", "lang").repartition("lang").write.partitionBy("lang").json(path)
    found = readers.listing(spark, path, "*.json").select(F.regexp_extract("path", "lang=([^/]+)/", 1).alias("lang"), "length")
    return found.groupBy("lang").agg(F.count("*").alias("files"), (F.sum("length") > 0).alias("filled"))


@query("""WITH m AS (SELECT conv_id, conv_id % 4 <> 0 AS consent FROM conversations GROUP BY conv_id)
SELECT m.conv_id, count(*) AS turns, max(c.turn) % 5 AS mos FROM m JOIN conversations c ON m.conv_id = c.conv_id WHERE consent GROUP BY m.conv_id""")
def session_log_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder per session with its three files, written by the tasks that hold the sessions, in folders of SHARDS; read by tasks that list them."""
    path, by, n = scratch(spark, "sessions"), Window.partitionBy("conv_id"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = path if "://" in path else f"file://{path}"
    talks = _table(spark, sf_dir, "conversations").repartition(n, "conv_id")
    talks = talks.select("conv_id", "turn", (F.col("conv_id") % 4 != 0).alias("consent"), (F.max("turn").over(by) % 5).alias("mos"))
    talks = talks.withColumn("shard", F.pmod(F.xxhash64("conv_id"), F.lit(SHARDS))).sortWithinPartitions("conv_id")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of a task's sessions, which come one after the other; a session's turns are written as they come."""
        store, top = pcm.opened(place)
        line = lambda row, *names: (json.dumps({k: row[k] for k in names}) + "\n").encode()
        done = 0
        for conv_id, session in groupby((row for batch in batches for row in batch.to_pylist()), key=lambda row: row["conv_id"]):
            first = next(session)
            pcm.put(f"{place}/{first['shard']}/{conv_id}", "meta.json", line(first, "conv_id", "consent"))
            pcm.put(f"{place}/{first['shard']}/{conv_id}", "mos.jsonl", line(first, "conv_id", "mos"))
            with store.open_output_stream(f"{top}/{first['shard']}/{conv_id}/turns.jsonl", buffer_size=1 << 16) as f:
                for row in chain([first], session):
                    f.write(line(row, "conv_id", "turn"))
            done += 1
        yield pa.RecordBatch.from_pydict({"sessions": pa.array([done], pa.int64())})

    store, top = pcm.opened(place)
    store.create_dir(top)  # no sessions are an empty folder
    stored(talks.mapInArrow(write, "sessions long"), "session-counts")
    _, turns, ratings = readers.session_folders(spark, path, "conv_id long, consent boolean", "conv_id long, turn long", "conv_id long, mos long")
    return turns.groupBy("conv_id").agg(F.count("*").alias("turns")).join(ratings.select("conv_id", "mos"), "conv_id")


@query("""WITH s AS (SELECT date_trunc('hour', ts) AS stamp, CASE WHEN user_id % 3 = 0 THEN 'asr' ELSE 'llm' END AS role, sum(value) AS mib FROM events
  WHERE user_id % 3 < 2 GROUP BY ALL), t AS (SELECT stamp, sum(mib) AS total, count(*) AS n FROM s GROUP BY stamp)
SELECT count(*) AS samples, round(max(CASE WHEN n = 2 THEN total END), 4) AS stack, round((SELECT max(mib) FROM s WHERE role = 'asr'), 4) AS asr, round((SELECT max(mib) FROM s WHERE role = 'llm'), 4) AS llm FROM t""")
def memory_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "memory")
    rows = _table(spark, sf_dir, "events").select(F.date_trunc("hour", "ts").cast("string").alias("stamp"), F.concat(F.lit("p"), F.col("user_id") % 3).alias("pid"), F.col("value").alias("mib"))
    rows.write.option("header", True).csv(path)
    samples = readers.csv(spark, path).withColumn("mib", F.col("mib").cast("double"))
    roles = spark.createDataFrame([("p0", "asr"), ("p1", "llm")], "pid string, role string")
    got = readers.memory_peaks(samples, roles)
    return got.select("samples", F.round("stack", 4).alias("stack"), F.round(F.col("peak")["asr"], 4).alias("asr"), F.round(F.col("peak")["llm"], 4).alias("llm"))


@query("SELECT count(*) AS remaining, CAST(sum(doc_id) AS bigint) AS ids FROM documents WHERE doc_id % 3 <> 0")
def resume_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "done")
    rows = _manifest(spark, sf_dir)
    sinks.append_jsonl(rows.where("doc_id % 6 = 0"), path, "duration")
    sinks.append_jsonl(rows.where("doc_id % 6 = 3"), path, "duration")
    left = readers.remaining(rows, readers.jsonl_strict(spark, path, ROW), "doc_id")
    return left.agg(F.count("*").alias("remaining"), F.sum("doc_id").alias("ids"))


@query(f"SELECT CASE WHEN doc_id % 10 = 0 THEN 'test' ELSE 'train' END AS split, count(*) AS n, round(sum(duration), 4) AS seconds FROM ({MANIFEST}) m GROUP BY 1")
def split_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "splits")
    rows = _manifest(spark, sf_dir).withColumn("split", F.when(F.col("doc_id") % 10 == 0, "test").otherwise("train"))
    sinks.by_split(rows, path)
    found = [spark.read.schema(ROW).json(f"{path}/split={s}").withColumn("split", F.lit(s)) for s in ("train", "test")]
    return found[0].unionByName(found[1]).groupBy("split").agg(F.count("*").alias("n"), F.round(F.sum("duration"), 4).alias("seconds"))


@query("""SELECT conv_id, turn, '[{"role":"user","content":' || to_json(u) || '},{"role":"assistant","content":' || to_json(a) || '}]' AS value FROM (
  SELECT conv_id, turn, regexp_replace(text, '[^A-Za-z ]', '', 'g') AS u, lead(regexp_replace(text, '[^A-Za-z ]', '', 'g')) OVER w AS a, role, lead(role) OVER w AS next_role
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) x WHERE role = 'user' AND next_role = 'assistant'""")
def conversation_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, by = scratch(spark, "export"), Window.partitionBy("conv_id").orderBy("turn")
    talks = _table(spark, sf_dir, "conversations").withColumn("user", F.regexp_replace("text", "[^A-Za-z ]", ""))
    talks = talks.select("conv_id", "turn", "role", "user", F.lead("user").over(by).alias("assistant"), F.lead("role").over(by).alias("next"))
    sinks.conversation_pairs(talks.where("role = 'user' AND next = 'assistant'")).write.json(path)
    return readers.jsonl(spark, path, "conv_id long, turn long, value string")


@query("SELECT lang, count(*) AS n FROM documents WHERE doc_id % 20 = 0 GROUP BY lang")
def review_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "review")
    sinks.review_sheet(_table(spark, sf_dir, "documents").where("doc_id % 20 = 0").select("doc_id", "lang"), path, ["verdict", "notes"])
    return readers.csv(spark, path).where("coalesce(verdict, '') = ''").groupBy("lang").agg(F.count("*").alias("n"))


@query("SELECT true AS same_in_any_order, true AS other_with_a_row_more, count(*) AS n FROM documents")
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _manifest(spark, sf_dir)
    whole, other = sinks.content_hash(rows), sinks.content_hash(rows.unionByName(rows.where("doc_id % 50 = 0")))
    same = sinks.content_hash(rows.repartition(5, "lang").select("lang", "duration", "doc_id", "source"))
    return rows.agg(F.lit(whole == same).alias("same_in_any_order"), F.lit(whole != other).alias("other_with_a_row_more"), F.count("*").alias("n"))
