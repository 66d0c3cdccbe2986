"""Results that are made part by part and resumed: what was finished before a run was lost is not made again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: what a result hangs on: the case, the payload that was judged, and the judge
RESUME_KEYS = ("case_id", "output_hash", "model")


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def finished_parts(spark: SparkSession, path: str) -> list[int]:
    """Parts whose marker was set; others may be half written."""
    files, place = _file_system(spark, f"{path}/_finished")
    return sorted(int(f.getPath().getName()) for f in files.listStatus(place)) if files.exists(place) else []


def finished(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of all finished parts."""
    parts = finished_parts(spark, path)
    if not parts:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/part={p}" for p in parts])


def split_by_results(wanted: DataFrame, results: DataFrame, keys: tuple[str, ...] = RESUME_KEYS) -> tuple[DataFrame, DataFrame]:
    """(results that still hold, wanted rows that have none): a result holds for just the same case, payload and model;
    null keys are equal to null.  Of results that repeat a key one is kept: the first, by all its columns as text."""
    same = [F.col(f"w.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    one = F.min_by(F.struct("*"), F.to_json(F.struct("*"))).alias("row")
    once = results.groupBy(*keys).agg(one).select("row.*")
    left = wanted.alias("w").join(once.alias("r"), same, "left_anti")
    held = once.alias("r").join(wanted.select(*keys).distinct().alias("w"), same, "left_semi")
    return held, left


def make_in_parts(wanted: DataFrame, make: Callable[[DataFrame], DataFrame], path: str, every: int = 100_000, keys: tuple[str, ...] = RESUME_KEYS) -> DataFrame:
    """make(rows) for all of wanted, about `every` rows at a time; the finished results.

    Rows are dealt to parts by a hash of their keys.  A part is one distributed job that replaces its own folder and then
    sets a marker, so a part that was lost on the way counts as not begun.  Started again with the same wanted rows, it
    makes the missing parts only; the number of parts is set when the first part is begun.
    """
    spark = wanted.sparkSession
    files, counted = _file_system(spark, f"{path}/_parts")
    if files.exists(counted):
        parts = int(files.listStatus(counted)[0].getPath().getName())
    else:
        parts = max(1, -(-wanted.count() // every))
        files.create(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_parts/{parts}")).close()
    dealt = wanted.withColumn("_part", F.pmod(F.xxhash64(*keys), F.lit(parts)))
    schema = None
    for part in sorted(set(range(parts)) - set(finished_parts(spark, path))):
        made = make(dealt.where(F.col("_part") == part).drop("_part"))
        schema = made.schema
        made.write.mode("overwrite").parquet(f"{path}/part={part}")
        files.create(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_finished/{part}")).close()
    return finished(spark, path, schema or make(wanted.limit(0)).schema)
