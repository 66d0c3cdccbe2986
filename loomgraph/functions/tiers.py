"""Evidence tiers and scores as column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: tier order, and the tier of each evidence type
TIER_RANK = {"unrated": 0, "wood": 1, "bronze": 2, "silver": 3, "gold": 4}
EX_TIER = {
    "pubchem_chemical_canonical": "gold", "coconut_organism_canonical": "gold", "pubchem_chemical_unverified": "silver",
    "coconut_organism_alias": "silver", "pubchem_chemical_formula": "bronze", "coconut_organism_unverified": "bronze",
}
TGT_TIER = {
    "chembl_mechanism": "gold", "chembl_activity_strong": "silver", "chembl_activity_moderate": "bronze",
    "chembl_activity_weak": "wood", "chembl_phenotypic": "wood",
}
REL_TIER = {
    "ncbi_pathogen_consensus": "gold", "ncbi_pathogen_efo": "gold", "ncbi_pathogen_doid": "gold", "ot_association_strong": "gold",
    "ot_association_moderate": "silver", "ot_association_complex_aggregate": "silver", "ncbi_pathogen_llm_verified": "silver",
    "ot_association_weak": "bronze",
}
MAP_QUALITY = {"gemini+icd10_exact": "gold", "gemini+mesh_exact": "gold", "gemini+snomed_exact": "gold", "gemini_unverified": "silver"}
VERDICT_LADDER = {
    "traditional_only": 0, "mechanistic_only": 1, "unsupported": 2, "partial_support": 3, "moderate_support": 4, "strong_support": 5,
}


def lookup(values: dict, key: Column) -> Column:
    """The value of a key, null where it is null or unknown."""
    return F.try_element_at(F.create_map(*map(F.lit, chain.from_iterable(values.items()))), key)


def tier_rank(values: dict[str, str], evidence_type: Column) -> Column:
    """Rank of the tier of an evidence type; null where there is none or it isn't known."""
    return lookup({k: TIER_RANK[v] for k, v in values.items()}, evidence_type)


def tier_name(rank: Column) -> Column:
    return lookup({v: k for k, v in TIER_RANK.items()}, rank)


def or_unrated(rank: Column) -> Column:
    """0 where a rank isn't known, so that a strange evidence type sinks its path."""
    return F.coalesce(rank, F.lit(0))


def weakest(*ranks: Column) -> Column:
    """Rank of the weakest known edge of a path; 0 (unrated) without any."""
    return F.coalesce(F.least(*ranks), F.lit(0))


def association_type(score: Column) -> Column:
    """Evidence type of an association score: 0.7, 0.4 and 0.2 are the floors; null below."""
    return F.when(score >= 0.7, "ot_association_strong").when(score >= 0.4, "ot_association_moderate").when(score >= 0.2, "ot_association_weak")


def activity_type(pchembl: Column, mechanism: Column) -> Column:
    """Evidence type of a measured activity; without a value it is phenotypic."""
    return (
        F.when(mechanism, "chembl_mechanism").when(pchembl.isNull(), "chembl_phenotypic")
        .when(pchembl >= 7, "chembl_activity_strong").when(pchembl >= 6, "chembl_activity_moderate").otherwise("chembl_activity_weak")
    )


def phase_type(phase: Column) -> Column:
    """Evidence type of a clinical phase; null for phase 0."""
    return F.when(phase >= 4, "chembl_indication_approved").when(phase == 3, "chembl_indication_phase3").when(phase == 2, "chembl_indication_phase2").when(phase == 1, "chembl_indication_phase1")


def verdict(has_compounds: Column, has_mapping: Column, closed: Column, top_rank: Column, top_count: Column) -> Column:
    return (
        F.when(~has_compounds, "traditional_only").when(~has_mapping, "mechanistic_only").when(closed == 0, "unsupported")
        .when((top_rank == 4) & (top_count >= 2), "strong_support").when(top_rank >= 3, "moderate_support").otherwise("partial_support")
    )


def verdict_delta(after: Column, before: Column) -> Column:
    """Steps up the ladder from before to after; an unknown verdict stands at -1."""
    return F.coalesce(lookup(VERDICT_LADDER, after), F.lit(-1)) - F.coalesce(lookup(VERDICT_LADDER, before), F.lit(-1))


def clamp01(value: Column) -> Column:
    """Into 0 to 1; null, NaN and text that is no number give 0."""
    number = value.try_cast("double")
    return F.when(number.isNull() | F.isnan(number), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), number)))


def composite(loop: Column, bucket: Column, sources: Column, score: Column) -> Column:
    return 1000 * loop.cast("int") + 100 * bucket + 10 * sources + score
