"""Queries written once for Spark SQL and the oracle; Catalyst plans them over the Parquet tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from voxlake.functions.dialect import Duck, Spark

from .registry import ORACLE, QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def opened(spark: SparkSession, sf_dir: str, text: str, **more: DataFrame) -> DataFrame:
    """The rows of Spark SQL over the test tables, of which those that it names are opened, and over DataFrames that it names in braces."""
    used = [t for t in TABLES if re.search(rf"\b{t}\b", text)]
    frames = {f"t_{t}": spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used}
    named = text.replace("{", "{{").replace("}", "}}")
    for name in more:
        named = named.replace(f"{{{{{name}}}}}", f"{{{name}}}")
    return spark.sql(re.sub(rf"\b(FROM|JOIN) ({'|'.join(used)})\b", r"\1 {t_\2}", named), **frames, **more)


def add(name: str, build: Callable[[Spark], str], oracle: bool = True) -> None:
    """Register `name`: build(dialect) gives its SQL."""
    text = build(Spark())

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return opened(spark, sf_dir, text)

    run.__name__ = name
    QUERIES[name] = run
    if oracle:
        ORACLE[name] = build(Duck())
