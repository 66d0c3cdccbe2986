"""What provider records say, as columns: identities of targets, accessions, synonyms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SYNONYM = "struct<syn_type:string,component_synonym:string>"
TARGET_RECORD = (
    f"target_chembl_id string, target_type string, pref_name string, tax_id bigint, target_components array<struct<accession:string,target_component_synonyms:array<{SYNONYM}>>>")


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def target_identity(record: Column) -> Column:
    """(target_chembl_id, target_type, target_name, uniprot_id, gene_symbol, ncbi_tax_id) of a target's record, empty where
    it says nothing: a single protein is known by its first component's accession and first gene symbol, an organism by its
    taxon, complexes and families by their own id alone."""
    kind = _text(record["target_type"])
    first = F.get(record["target_components"], 0)
    symbols = F.filter(first["target_component_synonyms"], lambda s: s["syn_type"] == "GENE_SYMBOL")
    single, organism = kind == "SINGLE PROTEIN", kind == "ORGANISM"
    return F.struct(
        _text(record["target_chembl_id"]).alias("target_chembl_id"), kind.alias("target_type"), _text(record["pref_name"]).alias("target_name"),
        F.when(single, _text(first["accession"])).otherwise("").alias("uniprot_id"), F.when(single, _text(F.get(symbols, 0)["component_synonym"])).otherwise("").alias("gene_symbol"),
        F.when(organism, _text(record["tax_id"])).otherwise("").alias("ncbi_tax_id"))


def accessions(record: Column) -> Column:
    """The distinct accessions of a target's components, in their order."""
    return F.array_distinct(F.filter(F.transform(record["target_components"], lambda c: c["accession"]), lambda a: F.coalesce(a != "", F.lit(False))))


def distinct_terms(terms: Column) -> Column:
    """Terms of a list, empty ones left out; of those that differ by case only the first stays, in order."""
    some = F.filter(F.coalesce(terms, F.array().cast("array<string>")), lambda t: F.coalesce(t != "", F.lit(False)))
    low = F.transform(some, F.lower)
    return F.filter(some, lambda t, i: F.array_position(low, F.lower(t)) == i + 1)
