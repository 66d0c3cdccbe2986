"""Signals of a herbal entry in prose, and the words by which a source is looked for."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomgraph.functions.names import PART_WORDS

# fixed values: what an entry, a treatment and a remark on compatibility say, as alternatives of one pattern each
ENTRY = (
    "radix|rhizoma|fructus|pericarpium|herba|folium|cortex|semen|flos|bulbus|exocarpium|ramulus|spica|stigma|is acrid|is bitter|is sweet|is sour|"
    "is salty|is warm|is cold|is neutral|mainly treats|protracted taking|grows in|grows on"
)
THERAPY = (
    "mainly treats|treats hundreds|treats|cures|indicated for|is acrid|is bitter|is sweet|is sour|is salty|is warm|is cold|is cool|is neutral|"
    "is balanced|is hot|nontoxic|disinhibits|disperses|tonifies|nourishes|relieves|brightens|warms the|clears (?:heat|the)|harmonizes|invigorates|"
    "protracted taking|long-term taking|lightens the body|calms the spirit|quiets the spirit|stops bleeding|stops pain"
)
COMPATIBILITY = (
    "envoy of|envoys of|envoys are|averse to|clashes with|fears|kills the toxin|kills the toxins|will become better if it acquires|is the envoy of|"
    "is the assistant of"
)
# fixed values: genitives of plant names and their nominatives
NOMINATIVES = {
    "zanthoxyli": "zanthoxylum", "cnidii": "cnidium", "citri": "citrus", "ephedrae": "ephedra", "glycyrrhizae": "glycyrrhiza", "astragali": "astragalus",
    "rhei": "rheum", "puerariae": "pueraria", "coptidis": "coptis", "scutellariae": "scutellaria", "phellodendri": "phellodendron", "salviae": "salvia",
    "curcumae": "curcuma", "zingiberis": "zingiber", "cinnamomi": "cinnamomum", "angelicae": "angelica", "ligustici": "ligusticum",
    "rehmanniae": "rehmannia", "atractylodis": "atractylodes", "alismatis": "alisma", "sophorae": "sophora", "fritillariae": "fritillaria",
    "anemarrhenae": "anemarrhena", "artemisiae": "artemisia",
}
ENDINGS, LEAST_LETTERS = ("i", "ae", "is"), 4
LEAST_ENTRY = 2


@dataclass(frozen=True)
class Signals:
    """Alternatives of words that speak of an entry, of a treatment, and of compatibility."""

    entry: str = ENTRY
    therapy: str = THERAPY
    compatibility: str = COMPATIBILITY


def count_of(text: Column, alternatives: str) -> Column:
    return F.regexp_count(text, F.lit(rf"(?iU)\b(?:{alternatives})\b"))


def is_entry(text: Column, signals: Signals = Signals()) -> Column:
    return count_of(text, signals.entry) >= LEAST_ENTRY


def is_treatment(text: Column, signals: Signals = Signals()) -> Column:
    return count_of(text, signals.therapy) >= 1


def is_compatibility_only(text: Column, signals: Signals = Signals()) -> Column:
    """Remarks on compatibility with fewer than half as many on treatment (none, for one or two remarks)."""
    return outnumbered(count_of(text, signals.compatibility), count_of(text, signals.therapy))


def outnumbered(compatibility: Column, therapy: Column) -> Column:
    return (compatibility >= 1) & (therapy < F.greatest(F.lit(1), F.floor(compatibility / 2)))


def search_keywords(name: Column) -> Column:
    """Distinct words of at least four letters to look for a source by: its words but names of parts, their nominatives,
    and what is left of them without a genitive ending; sorted."""
    words = F.filter(F.split(F.lower(F.trim(name)), r"(?U)\s+"), lambda w: (w != "") & ~w.isin(*PART_WORDS))
    table = F.create_map(*[F.lit(x) for pair in NOMINATIVES.items() for x in pair])

    def forms(w: Column) -> Column:
        stems = [F.when(w.endswith(e) & (F.length(w) > len(e) + 3), F.substring(w, F.lit(1), F.length(w) - len(e))) for e in ENDINGS]
        return F.array_compact(F.array(w, F.try_element_at(table, w), *stems))

    found = F.array_distinct(F.flatten(F.transform(words, forms)))
    return F.array_sort(F.filter(found, lambda w: F.length(w) >= LEAST_LETTERS))
