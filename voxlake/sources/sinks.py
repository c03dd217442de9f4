"""Sinks: JSON lines, guarded appends, reports, review sheets, outputs by split, nested exports, content hashes."""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .places import exists
from .readers import csv, jsonl_strict


def write_jsonl(rows: DataFrame, path: str) -> None:
    """Replace `path` by the rows as JSON lines. Files appear only when the whole write commits; nulls are written."""
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def append_jsonl(rows: DataFrame, path: str, duration: str | None = None) -> int:
    """Append rows to JSON lines after reading all of these again, strictly; returns how many there were.

    A line that doesn't parse stops the append. Writers are kept apart by Spark's commit protocol: files are added whole.
    """
    before = 0
    if exists(rows.sparkSession, path):
        before = jsonl_strict(rows.sparkSession, path, rows.schema, duration).count()
    rows.write.mode("append").option("ignoreNullFields", False).json(path)
    return before


def _plain(x):
    if isinstance(x, float) and not math.isfinite(x):
        raise ValueError("a report holds a number that is not finite")
    if isinstance(x, dict):
        return {str(k): _plain(v) for k, v in x.items()}
    return [_plain(v) for v in x] if isinstance(x, (list, tuple)) else x


def report(row: DataFrame, path: str) -> str:
    """Write a one-row DataFrame as one JSON object with sorted keys; returns it. Numbers must be finite."""
    rows = row.limit(2).collect()
    if len(rows) != 1:
        raise ValueError("a report is one row")
    text = json.dumps(_plain(rows[0].asDict(recursive=True)), sort_keys=True, ensure_ascii=False, default=str)
    row.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return text


def review_sheet(rows: DataFrame, path: str, answers: list[str]) -> None:
    """Write a CSV sheet with blank columns for reviewers; an existing sheet in which any of them is filled stays, with an error."""
    spark = rows.sparkSession
    if exists(spark, path):
        old = csv(spark, path)
        filled = [F.trim(F.coalesce(F.col(a), F.lit(""))) != "" for a in answers if a in old.columns]
        if filled and old.where(F.greatest(*filled) if len(filled) > 1 else filled[0]).limit(1).count():
            raise ValueError(f"{path} holds answers of reviewers")
    blank = rows.withColumns({a: F.lit("") for a in answers})
    blank.coalesce(1).write.mode("overwrite").option("header", True).csv(path)  # a sheet is for people: one file


def by_split(rows: DataFrame, path: str, split: str = "split") -> None:
    """Replace `path` by JSON lines in a folder per split."""
    rows.write.mode("overwrite").partitionBy(split).json(path)


def conversation_pairs(pairs: DataFrame) -> DataFrame:
    """(conv_id, turn, user, assistant) -> (conv_id, turn, value): a JSON array of the two turns."""
    said = lambda role, text: F.struct(F.lit(role).alias("role"), F.col(text).alias("content"))
    return pairs.select("conv_id", "turn", F.to_json(F.array(said("user", "user"), said("assistant", "assistant"))).alias("value"))


def content_hash(rows: DataFrame) -> str:
    """A hash of the rows as a multiset: the same for any order and partitioning. Columns count in the order of their names."""
    each = F.sha2(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}), 256)
    part = lambda i: F.sum(F.conv(F.substring(each, 15 * i + 1, 15), 16, 10).cast("decimal(38,0)"))
    got = rows.agg(F.count("*").alias("n"), *[part(i).alias(f"s{i}") for i in range(4)])
    return got.select(F.sha2(F.concat_ws("|", "n", *[F.coalesce(F.col(f"s{i}"), F.lit(0)) for i in range(4)]), 256)).first()[0]


def log_progress(spark: SparkSession, every: int = 1):
    """Print a line per `every` micro-batches of any stream of the session; returns the listener, to be removed again."""
    from pyspark.sql.streaming import StreamingQueryListener

    class Progress(StreamingQueryListener):
        def onQueryStarted(self, event):
            pass

        def onQueryProgress(self, event):
            if event.progress.batchId % every == 0:
                print(json.dumps({"batch": event.progress.batchId, "rows": event.progress.numInputRows}))

        def onQueryIdle(self, event):
            pass

        def onQueryTerminated(self, event):
            pass

    listener = Progress()
    spark.streams.addListener(listener)
    return listener
