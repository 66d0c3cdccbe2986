"""Names and keys as column expressions: normal forms, matching, identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: words that name a part of a plant or its product
PART_WORDS = [
    "pericarpium", "fructus", "radix", "rhizoma", "folium", "flos", "semen", "herba", "cortex", "exocarpium", "endocarpium", "mesocarpium",
    "bulbus", "tuber", "lignum", "ramulus", "spica", "stigma", "gummi", "resina", "oleum", "succus", "aqua", "pollen",
]


def collapse(text: Column) -> Column:
    """Lower case, white space runs to one space, trimmed."""
    return F.lower(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")))


def match_form(text: Column) -> Column:
    """Tolerant form for exact matching: bracketed clauses and apostrophes go, other punctuation becomes a space."""
    plain = F.regexp_replace(text, r"(?U)\s*[\(\[\{][^\)\]\}]*[\)\]\}]", "")
    plain = F.regexp_replace(plain, "['’ʼ]", "")
    return F.coalesce(collapse(F.regexp_replace(plain, r"(?U)[^\w\s]+", " ")), F.lit(""))


def name_tokens(name: Column) -> Column:
    """Lower-case ASCII words of a name without part words, in order and with repeats."""
    words = F.split(F.lower(F.regexp_replace(name, r"[^a-zA-Z0-9\s]", " ")), r"\s+")
    return F.filter(words, lambda w: (w != "") & ~w.isin(*PART_WORDS))


def plain_name(name: Column) -> Column:
    return F.array_join(name_tokens(name), " ")


def name_match(a: Column, b: Column) -> Column:
    """Loose match of two names: equal or one inside the other in plain form, two words in common, or the same words
    but for one each of at least four letters that differ by one edit.  A name of part words only matches nothing."""
    ta, tb = F.array_distinct(name_tokens(a)), F.array_distinct(name_tokens(b))
    na, nb = plain_name(a), plain_name(b)
    both = F.size(F.array_intersect(ta, tb))
    only_a, only_b = F.array_except(ta, tb), F.array_except(tb, ta)
    xa, xb = F.try_element_at(only_a, F.lit(1)), F.try_element_at(only_b, F.lit(1))
    typo = (both >= 1) & (F.size(only_a) == 1) & (F.size(only_b) == 1) & (F.least(F.length(xa), F.length(xb)) >= 4) & (F.levenshtein(xa, xb) <= 1)
    inside = F.contains(na, nb) | F.contains(nb, na)
    return F.coalesce((na != "") & (nb != "") & (inside | (both >= 2) | F.coalesce(typo, F.lit(False))), F.lit(False))


def genus_species(name: Column) -> Column:
    """The first two words, lower-cased; null for fewer."""
    words = F.filter(F.split(collapse(name), " "), lambda w: w != "")
    return F.when(F.size(words) >= 2, F.array_join(F.slice(words, 1, 2), " "))


def organisms(cell: Column) -> Column:
    """Names in a cell separated by bars, normalised, without blanks."""
    return F.filter(F.transform(F.split(cell, r"[|]"), collapse), lambda x: x != "")


def part_of(part: Column) -> Column:
    return F.coalesce(F.nullif(F.lower(F.trim(part)), F.lit("")), F.lit("whole"))


def unstructured_key(name: Column) -> Column:
    """Key of a compound without a structure."""
    return F.concat(F.lit("unstructured:"), F.regexp_replace(F.lower(F.trim(name)), r"\s+", "_"))


def planar_key(inchikey: Column) -> Column:
    return F.substring(inchikey, 1, 14)


def curie_kind(curie: Column) -> Column:
    """Ontology of an identifier by its prefix; null if it is none of the known."""
    up = F.upper(F.replace(curie, F.lit("_"), F.lit(":")))
    kinds = ("EFO", "MONDO", "DOID", "MESH", "HP", "ORPHANET")
    out = F.when(up.startswith(kinds[0] + ":"), kinds[0].lower())
    for k in kinds[1:]:
        out = out.when(up.startswith(k + ":"), k.lower())
    return out


def looks_like_formula(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^(?:[A-Z][a-z]?\d*){2,}$"), F.lit(False))


def without_fence(answer: Column) -> Column:
    """The JSON of an answer that may stand in a code fence."""
    return F.trim(F.regexp_replace(F.regexp_replace(answer, r"^\s*```[a-zA-Z]*\s*", ""), r"\s*```\s*$", ""))


def binomials(aliases: Column) -> Column:
    """Latin binomials in an array of aliases: the first of each alias, once whatever its case, in order."""
    found = F.filter(F.transform(aliases, lambda a: F.regexp_extract(a, r"\b([A-Z][a-z]+)\s+([a-z]+)\b", 0)), lambda x: x != "")
    plain = F.transform(found, lambda x: F.regexp_replace(x, r"\s+", " "))
    return F.filter(plain, lambda x, i: F.array_position(F.transform(plain, F.lower), F.lower(x)) == i + 1)


def nearest_rank(values: Column, percent: int) -> Column:
    """Percentile by nearest rank of an array: position p/100 * (n - 1), halves to even; null for an empty array."""
    ordered = F.array_sort(values)
    return F.try_element_at(ordered, (F.bround(F.lit(percent) / 100 * (F.size(ordered) - 1)) + 1).cast("int"))


# fixed values: assays that count, and relations that make of a value one
SOUND_ASSAYS, SOUND_RELATIONS = ("B", "F"), ("", "=", "==", "~", "~=")


def sound_activity(rows: DataFrame) -> DataFrame:
    """Rows (assay, relation, remark, ...) of a sound assay, with no bound for a value and without a remark on validity."""
    blank = F.lit("")
    return rows.where(
        F.col("assay").isin(*SOUND_ASSAYS) & F.coalesce("relation", blank).isin(*SOUND_RELATIONS) & (F.coalesce("remark", blank) == ""))
