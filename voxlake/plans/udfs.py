"""Queries of the operators that SQL can't express; their tests compare them with plain Python."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxlake.operators import selection, signal, text

from .registry import query


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def composed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", text.composed("text").alias("text"))


@query()
def blake_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = _table(spark, sf_dir, "documents").select("source").distinct()
    return sources.select("source", text.pair_split("source").alias("split"), text.held_out("source").alias("held_out"))


@query()
def safe_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", text.safe_name(F.col("url")).alias("name"))


@query()
def token_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Window.partitionBy("conv_id").orderBy("turn")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.lag("text").over(by).alias("before")).where("before IS NOT NULL")
    return rows.select("conv_id", "turn", F.round(text.similarity("before", "text"), 6).alias("similarity"))


@query()
def clause_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(text.clause_list("text")).alias("place", "clause"))
    return rows


@query()
def weighted_fair(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("episode_id")).agg(
        F.min("o_orderpriority").alias("channel"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("size"))
    rows = orders.withColumns({"weight": F.lit(1.0) / (1 + F.length("channel") % 4), "priority": (F.col("episode_id") % 3).cast("int")})
    total = rows.agg(F.sum("size")).first()[0] or 0
    return selection.fair_shares(rows, total // 4, total // 4 + total // 1000, 0.55)


@query()
def set_cover_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", "source", (F.col("n_chars") % 5).alias("bucket"))
    return selection.covering(rows, ["lang", "source", "bucket"], 40)


@query()
def clip_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips: each vector's numbers as the levels of a few tones."""
    rows = _table(spark, sf_dir, "embeddings").where("embedding IS NOT NULL").select(F.col("vec_id").alias("id"), "embedding")
    wave = F.transform(F.sequence(F.lit(0), F.lit(3_199)), lambda i: F.sin(i * F.lit(0.06)) * (1 + F.get("embedding", i % 8).cast("double")))
    out = signal.clip_features(rows.select("id", wave.alias("samples")))
    return out.select("id", "frames", F.round("snr_db", 4).alias("snr_db"), F.round("f0", 2).alias("f0"), F.round("voiced", 4).alias("voiced"))


@query()
def boosted_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").where("embedding IS NOT NULL").select("vec_id", "embedding", (F.col("label") % 2).cast("double").alias("y"))
    model = signal.boosted(rows.where("vec_id % 5 <> 0"), "y", "embedding", maxIter=5, maxDepth=3)
    return model.transform(signal.as_vectors(rows, "embedding")).select("vec_id", F.col("prediction").cast("int").alias("predicted"))
