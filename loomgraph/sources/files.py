"""Readers and writers: text folders, exports, JSON documents, checkpoints of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def text_folder(spark: SparkSession, path: str) -> DataFrame:
    """(text, source_document, file_path) of every *.txt of a folder; the document is the file's stem."""
    rows = spark.read.text(path, wholetext=True, pathGlobFilter="*.txt")
    name = F.col("_metadata.file_name")
    return rows.select(F.col("value").alias("text"), F.regexp_replace(name, r"\.txt$", "").alias("source_document"), F.col("_metadata.file_path").alias("file_path"))


def export(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """A CSV, TSV or parquet export, by its extension."""
    reader = spark.read.schema(schema) if schema else spark.read
    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "parquet":
        return reader.parquet(path)
    if kind in ("csv", "tsv"):
        return reader.csv(path, header=True, sep="," if kind == "csv" else "\t", multiLine=True, escape='"')
    raise ValueError(f"no reader for .{kind}")


def json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One record a line; blank lines are skipped."""
    return spark.read.schema(schema).json(path).dropna(how="all")


def json_document(spark: SparkSession, path: str, field: str, element: str) -> DataFrame:
    """The records of an array field of one JSON document."""
    rows = spark.read.schema(f"{field} array<{element}>").json(path, multiLine=True)
    return rows.select(F.explode(field).alias("r")).select("r.*")


def headed_names(spark: SparkSession, path: str, first: int | None = None, head: str = "### SOURCE:") -> DataFrame:
    """(position, name) of the lines of a text file that start with a heading, in file order."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("position", "line"))
    found = lines.where(F.startswith("line", F.lit(head))).select("position", F.trim(F.substring("line", len(head) + 1, 1_000_000)).alias("name"))
    return found.orderBy("position").limit(first) if first is not None else found


def compound_snapshot(raw: DataFrame) -> DataFrame:
    """The trimmed columns of a compound export; an empty name falls back to the systematic one; rows without a
    structure go."""
    name = F.coalesce(F.nullif(F.trim("name"), F.lit("")), F.nullif(F.trim("iupac_name"), F.lit("")))
    return raw.select(
        "organisms", "canonical_smiles", name.alias("name"), "molecular_formula", F.col("np_likeness").try_cast("double").alias("np_likeness"),
        F.col("annotation_level").try_cast("int").alias("annotation_level")).where("canonical_smiles IS NOT NULL AND canonical_smiles <> ''")


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_json_document(df: DataFrame, path: str) -> None:
    """Each row as one JSON text with its nulls, in a folder of text files."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def write_part(df: DataFrame, path: str, part: str) -> None:
    """One part of a resumable result: a folder of its own, replaced as a whole when its run is repeated."""
    df.write.mode("overwrite").parquet(f"{path}/part={part}")


def residue(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What is still to be made."""
    return wanted.join(done.select(*keys).distinct(), keys, "left_anti")
