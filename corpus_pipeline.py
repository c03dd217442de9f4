"""The training-data pipeline: five stages over `documents`, each written and read again as the next one's input.

All but the last keep the columns of their input. Rows without doc_id or text are
documents like others: they have no shingles, no benchmark words and no words to
mix, so they pass the filters, and the mix has nothing of empty ones. Repeated
rows each count; an empty table stays empty; texts of any length are taken whole.
Of near copies that tie, the smallest doc_id stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voxlake.llm.common import saved, table
from voxlake.llm.decontaminate import contamination
from voxlake.llm.mixing import mixed
from voxlake.llm.ngram_join import one_of_each
from voxlake.llm.tokens import tokenised, tokenizer_path
from voxlake.llm.toxicity import clean


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go."""
    return clean(docs, table(spark, sf_dir, "labels"))


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five words, a similarity of 0.8 or more."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    from pyspark.sql import functions as F

    found = contamination(docs, table(spark, sf_dir, "benchmark")).where("contaminated")
    found = found.select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h")).distinct()
    return docs.join(found, docs.doc_id.eqNullSafe(found._d) & (F.xxhash64("text") == found._h), "left_anti")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources are mixed to their target weights: texts keep what is drawn, twice drawn parts come twice."""
    return mixed(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids are written as compressed planes and read back: doc_id, start, n_tokens, ids_crc32."""
    return tokenised(docs, tokenizer_path())


STAGES = [
    ("toxicity", toxicity),
    ("ngram_join", ngram_join),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_output", token_output),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: A fitted model, a tokenizer and a draw decide the rows; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None
