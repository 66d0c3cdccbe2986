"""Answers of outside services, kept by key: a lookup is a join, and only what was never answered is asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class AnswerCache:
    """Answers (key, value) in a table that is bucketed by key; a null value is the answer that there is none.

    Each write-back makes a new version beside the old one and then marks it as the last, so a reader has either; the one
    before stays until the next write-back, for those that still read it.
    """

    def __init__(self, spark: SparkSession, name: str, root: str, buckets: int = 64) -> None:
        self.spark, self.name, self.root, self.buckets = spark, name, root.rstrip("/"), buckets
        self._paths = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._paths(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        marks = self._paths(f"{self.root}/versions")
        return max((int(f.getPath().getName()) for f in self._files.listStatus(marks)), default=0) if self._files.exists(marks) else 0

    def _declared(self, version: int) -> str:
        table = f"{self.name}_v{version}"
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {table} (key STRING, value STRING) USING parquet CLUSTERED BY (key) SORTED BY (key) INTO {self.buckets} BUCKETS "
            f"LOCATION '{self.root}/v={version}'")
        return table

    def answers(self) -> DataFrame:
        version = self.version()
        return self.spark.table(self._declared(version)) if version else self.spark.createDataFrame([], "key string, value string")

    def look_up(self, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(asked (key, nth, ...) with `known` and `value`, what is to be asked for: each unknown key once, with the other
        columns of its first row by nth).  Null keys are neither known nor asked for.

        The table meets the rows in its own buckets, so it is not shuffled.
        """
        held = self.answers().withColumn("known", F.lit(True))
        found = asked.join(held, "key", "left").withColumn("known", F.coalesce("known", F.lit(False)))
        others = [c for c in asked.columns if c != "key"]
        first = F.min_by(F.struct(*others), "nth").alias("first")
        return found, found.where("NOT known AND key IS NOT NULL").groupBy("key").agg(first).select("key", "first.*")

    def write_back(self, fresh: DataFrame) -> int:
        """Keep fresh answers (key, value; the largest of a key's, an answer before none), in place of older ones; the new
        version."""
        version = self.version() + 1
        once = fresh.where("key IS NOT NULL").groupBy("key").agg(F.max("value").alias("value"))
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_v{version}")  # of a write-back that was lost on the way
        self._files.delete(self._paths(f"{self.root}/v={version}"), True)
        rows = self.answers().join(once.select("key"), "key", "left_anti").unionByName(once)
        rows.repartition(self.buckets, "key").write.insertInto(self._declared(version))
        self._files.create(self._paths(f"{self.root}/versions/{version}")).close()
        if version > 2:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_v{version - 2}")
            self._files.delete(self._paths(f"{self.root}/v={version - 2}"), True)
        return version
