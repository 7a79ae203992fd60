"""Versioned facts: each generation is written whole, then one pointer names the current one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Generations:
    """Facts by generation below a folder.  A reader sees a whole generation or the one before."""

    def __init__(self, folder: str):
        self.folder = folder

    def _path(self, n: int) -> str:
        return f"{self.folder}/generation={n}"

    def number(self, spark: SparkSession) -> int | None:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/committed")
        if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return None
        return spark.read.schema("n int").parquet(f"{self.folder}/committed").agg(F.max("n")).first()[0]

    def current(self, spark: SparkSession) -> DataFrame | None:
        n = self.number(spark)
        return None if n is None else spark.read.parquet(self._path(n))

    def patched(self, spark: SparkSession, fresh: DataFrame, asked: list[str]) -> DataFrame:
        """The current facts with the asked files replaced; fresh rows of other files are an error."""
        stray = fresh.where(~F.col("file").isin(asked)).limit(1).collect()
        if stray:
            raise ValueError(f"{stray[0]['file']} was not asked for")
        old = self.current(spark)
        return fresh if old is None else old.where(~F.col("file").isin(asked)).unionByName(fresh)

    def commit(self, spark: SparkSession, facts: DataFrame) -> int:
        n = (self.number(spark) or 0) + 1
        facts.write.mode("overwrite").parquet(self._path(n))
        spark.createDataFrame([(n,)], "n int").coalesce(1).write.mode("append").parquet(f"{self.folder}/committed")
        return n


def on_batch(store: Generations, extract: Callable[[list[str]], DataFrame]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: re-extracts the files of a batch of changes (kind, path) and commits.

    A batch names files, not facts, so what reaches the driver is bounded by the edit.
    """

    def run(changes: DataFrame, _: int) -> None:
        paths = [r["path"] for r in changes.select("path").distinct().collect()]
        if paths:
            store.commit(changes.sparkSession, store.patched(changes.sparkSession, extract(paths), paths))

    return run
