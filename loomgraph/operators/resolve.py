"""Who is meant: lookups by several keys in turn, first rows of several kinds, sentences about verdicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.text import contained_spans


def resolved_in_turn(asked: DataFrame, records: DataFrame, steps: Sequence[tuple[str, Column, Column]], failed: DataFrame, record_id: str = "record_id") -> DataFrame:
    """asked with (record, method, ok): the first record by id that the first step with a hit gives.

    A step is (name, key of an asked row, key of a record); an asked key that is null or empty skips the step.  failed
    (step, key) lists lookups that failed for now: without a hit a row with such a step is not ok, as it may exist; a hit
    after one counts.  One join a step, each against one row a key.
    """
    rows, best, method, lost = asked, None, None, F.lit(False)
    for i, (name, own, theirs) in enumerate(steps):
        key, hit, bad = f"_key{i}", f"_hit{i}", f"_bad{i}"
        once = records.select(F.nullif(theirs, F.lit("")).alias(key), record_id).dropna().groupBy(key).agg(F.min(record_id).alias(hit))
        down = failed.where(F.col("step") == name).select(F.col("key").alias(key), F.lit(True).alias(bad)).distinct()
        rows = rows.withColumn(key, F.nullif(own, F.lit(""))).join(once, key, "left").join(down, key, "left")
        # a lookup that failed gives nothing, whatever there is
        found = F.when(F.col(bad).isNull(), F.col(hit))
        best = found if best is None else F.coalesce(best, found)
        one = F.when(found.isNotNull(), name)
        method = one if method is None else F.coalesce(method, one)
        lost = lost | F.col(bad).isNotNull()
    return rows.select(*asked.columns, best.alias("record"), F.coalesce(method, F.lit("none")).alias("method"), (best.isNotNull() | ~lost).alias("ok"))


def first_by_key(rows: DataFrame, keys: Sequence[Column], order: Sequence[str]) -> DataFrame:
    """The first row by `order` of those with one key, which is the first of `keys` that is neither null nor empty; rows
    without a key all stay.  Columns are as before."""
    key = F.coalesce(*[F.when(k != "", F.concat(F.lit(f"{i}:"), k)) for i, k in enumerate(keys)])
    every = F.struct(*rows.columns)
    first = rows.where(key.isNotNull()).groupBy(key.alias("_key")).agg(F.min_by(every, F.struct(*order)).alias("_row")).select("_row.*")
    return first.unionByName(rows.where(key.isNull()))


def resolved_or_all(found: DataFrame, every: DataFrame, group: str, name: str) -> DataFrame:
    """(group, name, fell_back): what was found for a group of `every`, and all of the group's where nothing was."""
    none = every.join(found.select(group).distinct(), group, "left_anti")
    return found.select(group, name, F.lit(False).alias("fell_back")).distinct().unionByName(none.select(group, name, F.lit(True).alias("fell_back")).distinct())


def column_means(rows: DataFrame, columns: Sequence[str] | None = None, digits: int = 6) -> DataFrame:
    """(column, mean, n) of numeric columns over all rows that have a value, from one pass."""
    names = list(columns or [c for c, t in rows.dtypes if t in ("tinyint", "smallint", "int", "bigint", "float", "double") or t.startswith("decimal")])
    one = rows.agg(*[F.struct(F.round(F.avg(c), digits).alias("mean"), F.count(c).alias("n")).alias(c) for c in names])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c)["mean"].alias("mean"), F.col(c)["n"].alias("n")) for c in names])).alias("c")).select("c.*")


# fixed values: where a canonical name comes from
ORGANISM_SURE, ORGANISM_SAID = "gemini+coconut", "gemini_unverified_organism"
CHEMICAL_SURE, CHEMICAL_SAID = "gemini+pubchem", "gemini_unverified_chemical"
# fixed values: what is said of each verdict, and of what stands beside it
SUFFIXES = ("corroborated by {} sibling source(s)", "{} path(s) reach a syndrome component", "malady mapping is unverified")
SENTENCES = {
    "strong_support": "{count} {bucket}-tier path(s) close the loop on '{disease}', top score {score}.",
    "moderate_support": "Loop closes on '{disease}' via {bucket}-tier evidence ({closed} closing path(s)).",
    "partial_support": "Loop closes on '{disease}' but only via {bucket}-tier evidence ({closed} closing path(s)).",
    "unsupported": "{paths} mechanistic path(s) exist but none reach '{disease}'.",
    "mechanistic_only": "{paths} mechanistic path(s) exist but the malady has no Modern_Disease mapping to check against.",
}
BARE = {"traditional_only": "No compounds linked to this source — claim is purely traditional."}


def _filled(template: str, **values: Column) -> Column:
    """A sentence with its fields put in."""
    parts = []
    for piece in template.split("{"):
        name, end, rest = piece.rpartition("}")
        parts += [values[name], F.lit(rest)] if end else [F.lit(piece)]
    return F.concat(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def rationale(siblings: Column) -> Column:
    """Why a verdict's row (columns of the verdicts) got its verdict; `siblings` counts the sources that say the same."""
    said = F.array_compact(F.array(
        F.when(siblings > 0, _filled(SUFFIXES[0].replace("{}", "{n}"), n=siblings)),
        F.when(F.col("paths_component_closed") > 0, _filled(SUFFIXES[1].replace("{}", "{n}"), n=F.col("paths_component_closed"))),
        F.when(F.col("primary_mapping_quality") == "silver", SUFFIXES[2])))
    suffix = F.when(F.size(said) > 0, F.concat(F.lit(" ("), F.array_join(said, "; "), F.lit(")"))).otherwise("")
    values = {
        "count": F.col("top_bucket_path_count"), "bucket": F.col("top_bucket"), "disease": F.col("primary_disease"), "closed": F.col("paths_loop_closed"),
        "paths": F.col("path_count"), "score": F.col("top_bucket_max_score").cast("decimal(18,6)").cast("decimal(18,3)")}
    out = F.lit("")
    for verdict, template in SENTENCES.items():
        out = F.when(F.col("verdict") == verdict, F.concat(_filled(template, **values), suffix)).otherwise(out)
    for verdict, text in BARE.items():
        out = F.when(F.col("verdict") == verdict, text).otherwise(out)
    return out


def canonical_records(answers: DataFrame, organisms: DataFrame, chemicals: DataFrame) -> DataFrame:
    """The record of each answer (name, canonical, kind, part, failed): name, canonical_raw, canonical_type, canonical_name,
    canonical_part, canonical_source.

    An organism is sure if some name of organisms (name) contains it, a chemical if chemicals (name) has it, case apart.
    Containment goes by contained_spans, so no answer is held against names that can't contain it.  An organism without a part is whole; an answer without a canonical name, or of another kind,
    is uncanonicalized; one that failed is an error.
    """
    canonical, part, kind = F.trim(F.coalesce("canonical", F.lit(""))), F.lower(F.trim(F.coalesce("part", F.lit("")))), F.col("kind")
    key = F.lower(canonical)
    asked = answers.where(kind == "organism").select(key.alias("text")).where("text <> ''").distinct()
    names = organisms.select(F.col("name").alias("doc_id"), F.col("name").alias("text")).dropna().distinct()
    inside = contained_spans(names, asked.select(F.col("text").alias("item_id"), "text")).select(F.col("item_id").alias("_inside"), F.lit(True).alias("_is")).distinct()
    known = chemicals.select(F.lower(F.trim("name")).alias("_known"), F.lit(True).alias("_chemical")).dropna().distinct()
    rows = answers.join(inside, key == F.col("_inside"), "left").join(known, key == F.col("_known"), "left")
    organism, chemical = (kind == "organism") & (canonical != ""), (kind == "chemical") & (canonical != "")
    failed = F.coalesce("failed", F.lit(False))

    def said(error, of_organism, of_chemical, other):
        return F.when(failed, error).when(organism, of_organism).when(chemical, of_chemical).otherwise(other)

    return rows.select(
        "name", F.when(failed, "").otherwise(canonical).alias("canonical_raw"), said("error", "organism", "chemical", "uncanonicalized").alias("canonical_type"),
        said(F.lit(None), canonical, canonical, F.lit(None)).alias("canonical_name"), said("", F.when(part != "", part).otherwise("whole"), "", "").alias("canonical_part"),
        said("error", F.when(F.col("_is"), ORGANISM_SURE).otherwise(ORGANISM_SAID), F.when(F.col("_chemical"), CHEMICAL_SURE).otherwise(CHEMICAL_SAID), "uncanonicalized").alias("canonical_source"))
