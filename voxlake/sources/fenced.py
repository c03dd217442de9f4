"""Appends that are fenced: a writer commits only onto the version that it has read and checked."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another writer has committed since."""


class FencedTable:
    """Rows in folders of Parquet files, and one small file per version that names the version's folder.

    Version n + 1 is created only if no file of that name is there, in one step, on file systems whose `create` without
    overwriting is atomic (local, HDFS). So of two writers that have checked the same version one commits and the
    other is told. Readers see the folders of committed versions only.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._system = self._hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, version: int):
        return self._hadoop.Path(f"{self.path}/_versions/{version:012d}.json")

    def version(self) -> int:
        """The newest version; 0 before the first append."""
        folder = self._hadoop.Path(f"{self.path}/_versions")
        if not self._system.exists(folder):
            return 0
        return max((int(x.getPath().getName()[:12]) for x in self._system.listStatus(folder) if x.getPath().getName().endswith(".json")), default=0)

    def rows(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest by default, with the column `version` that each came with."""
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], f"{self.schema}, version int")
        named = self.spark.read.text([str(self._at(v)) for v in range(1, version + 1)])  # a row per version
        folders = [r["folder"] for r in named.select(F.get_json_object("value", "$.folder").alias("folder")).collect()]
        return self.spark.read.schema(f"{self.schema}, version int").parquet(*[f"{self.path}/{f}" for f in folders])

    def append(self, rows: DataFrame, check: Callable[[DataFrame, DataFrame], bool], onto: int | None = None) -> int:
        """Append rows if `check(rows before, rows)` is true of the version they go onto; returns the new version.

        onto: the version that the writer has seen, the newest by default. If another writer commits first, Conflict is raised and nothing is added.
        """
        onto = self.version() if onto is None else onto
        folder = f"data-{uuid.uuid4().hex}"
        rows.withColumn("version", F.lit(onto + 1)).write.parquet(f"{self.path}/{folder}")
        written = self.spark.read.schema(f"{self.schema}, version int").parquet(f"{self.path}/{folder}")
        try:
            if not check(self.rows(onto), written):
                raise ValueError("the rows don't fit those before them")
            try:
                stream = self._system.create(self._at(onto + 1), False)
            except Exception as error:
                if self._system.exists(self._at(onto + 1)):
                    raise Conflict(f"version {onto + 1} is there already") from error
                raise
            stream.write(bytearray(json.dumps({"version": onto + 1, "folder": folder}).encode()))
            stream.close()
        except Exception:
            self._system.delete(self._hadoop.Path(f"{self.path}/{folder}"), True)
            raise
        return onto + 1

    def append_again(self, rows: DataFrame, check: Callable[[DataFrame, DataFrame], bool], tries: int = 5) -> int:
        """`append`, read and checked anew when another writer was faster."""
        for left in reversed(range(tries)):
            try:
                return self.append(rows, check)
            except Conflict:
                if not left:
                    raise
        raise AssertionError("unreachable")


def new_keys(key: str) -> Callable[[DataFrame, DataFrame], bool]:
    """A check: keys are not null, not repeated, and not in the rows before."""

    def check(before: DataFrame, rows: DataFrame) -> bool:
        keys = rows.select(key)
        return not (
            keys.where(F.col(key).isNull()).limit(1).count()
            or keys.groupBy(key).count().where("count > 1").limit(1).count()
            or keys.join(before.select(key), key, "left_semi").limit(1).count()
        )

    return check
