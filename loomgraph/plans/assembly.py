"""Linkers as plans over tables: routing of sources, planners of targets, mapping of maladies.

What an outside service would answer stands in tables that are derived from the graph, so a plan joins answers instead
of asking for them one by one: transient failures, missing ids and outside names are columns of those tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import names as N
from loomgraph.functions import tiers as T
from loomgraph.operators import paths as P
from loomgraph.plans.registry import Registry
from loomgraph.sources.projection import Graph, active

ENTRIES = Registry()
entry = ENTRIES.entry

# fixed values: confidence of each kind of evidence, and what a part of a plant takes off it
EXTRACTION_PRIOR = {
    "coconut_organism_canonical": 0.7, "coconut_organism_alias": 0.55, "coconut_organism_unverified": 0.5,
    "pubchem_chemical_canonical": 0.8, "pubchem_chemical_unverified": 0.55, "pubchem_chemical_formula": 0.5,
}
PART_PENALTY = 0.1
TARGET_PRIOR = {
    "ot_association_strong": 0.85, "ot_association_moderate": 0.65, "ot_association_weak": 0.45, "ot_association_complex_aggregate": 0.7,
    "ncbi_pathogen_efo": 0.9, "ncbi_pathogen_doid": 0.9, "ncbi_pathogen_consensus": 0.92, "ncbi_pathogen_llm_verified": 0.75,
}
MAPPING_PRIOR = {
    "primary|icd10": 0.85, "primary|mesh": 0.8, "primary|snomed": 0.8, "syndrome_component|icd10": 0.7, "syndrome_component|mesh": 0.65,
    "syndrome_component|snomed": 0.65,
}
SYMPTOM_PENALTY, LEAST_SCORE, SUBUNITS, MOST_COMPONENTS = 0.05, 0.2, 10, 2

LINK_SQL = """
, assoc AS (SELECT tg.dst AS target_id, k.dst AS disease_id, CAST(count(*) * 23 % 100 AS integer) AS pct FROM targets tg JOIN known k ON k.src = tg.src GROUP BY tg.dst, k.dst)
, hits AS (SELECT a.target_id, a.pct, a.pct / 100.0::double AS score, d.name AS disease, CASE WHEN d.mesh_id <> '' THEN 'id' ELSE 'name' END AS tier
  FROM assoc a LEFT JOIN disease d ON d.disease_id = a.disease_id AND NOT coalesce(d.archived, false))
, kinds AS (SELECT target_id, right(uniprot_id, 1) AS last, uniprot_id,
  CASE WHEN target_id LIKE 'Brand#55%' THEN 'PROTEIN FAMILY' WHEN target_id LIKE 'Brand#54%' THEN 'NUCLEIC-ACID' ELSE target_type END AS kind FROM target)
, single AS (SELECT k.target_id, h.score, h.disease FROM kinds k JOIN hits h USING (target_id) WHERE kind = 'SINGLE PROTEIN' AND last NOT IN ('3', '5'))
, subunits AS (SELECT c.target_id AS complex_id, s.target_id, c.last FROM kinds c JOIN kinds s ON s.uniprot_id = c.uniprot_id AND s.kind = 'SINGLE PROTEIN' WHERE c.kind = 'PROTEIN COMPLEX' AND c.last <> '1')
, complexes AS (SELECT u.complex_id AS target_id, u.target_id AS subunit, h.score, h.disease FROM subunits u JOIN hits h ON h.target_id = u.target_id WHERE u.last <> '5')
, org AS (SELECT k.target_id, k.last, h.disease, h.pct, k.last IN ('1', '2') AND h.pct % 3 = 0 AS efo, k.last IN ('1', '2') AND h.pct % 5 = 0 AS doid FROM kinds k JOIN hits h USING (target_id) WHERE kind = 'ORGANISM' AND last <> '3')
, cand AS (SELECT target_id, disease, 'efo' AS said FROM org WHERE efo UNION ALL SELECT target_id, disease, 'doid' FROM org WHERE doid
  UNION ALL SELECT target_id, disease, 'llm' FROM org o WHERE NOT EXISTS (SELECT 1 FROM org p WHERE p.target_id = o.target_id AND (p.efo OR p.doid)))
, edges AS (
  SELECT target_id, disease, CASE WHEN max(score) >= 0.7::double THEN 'ot_association_strong' WHEN max(score) >= 0.4::double THEN 'ot_association_moderate' ELSE 'ot_association_weak' END AS evidence_type, max(score) AS score, '' AS detail
    FROM single WHERE score >= 0.2::double AND disease IS NOT NULL GROUP BY target_id, disease
  UNION ALL SELECT target_id, disease, 'ot_association_complex_aggregate', max(score), arg_min(subunit, (-score, subunit)) FROM complexes WHERE score >= 0.2::double AND disease IS NOT NULL GROUP BY target_id, disease
  UNION ALL SELECT target_id, disease, CASE WHEN bool_or(said = 'efo') AND bool_or(said = 'doid') THEN 'ncbi_pathogen_consensus' WHEN bool_or(said = 'llm') THEN 'ncbi_pathogen_llm_verified'
      WHEN bool_or(said = 'efo') THEN 'ncbi_pathogen_efo' ELSE 'ncbi_pathogen_doid' END, NULL,
    CASE WHEN bool_or(said = 'efo') AND bool_or(said = 'doid') THEN 'efo+doid' WHEN bool_or(said = 'llm') THEN 'llm_verified' WHEN bool_or(said = 'efo') THEN 'efo' ELSE 'doid' END
    FROM cand WHERE disease IS NOT NULL GROUP BY target_id, disease)
, drops AS (SELECT target_id, count(*) FILTER (score < 0.2::double OR disease IS NULL) AS dropped FROM (SELECT * FROM single UNION ALL SELECT target_id, score, disease FROM complexes) GROUP BY target_id
  UNION ALL SELECT target_id, count(*) FILTER (disease IS NULL) FROM cand GROUP BY target_id)
, linked AS (SELECT target_id, count(*) AS n FROM edges GROUP BY target_id)
"""


def outside_associations(g: Graph) -> DataFrame:
    """(target_id, curie, outside_name, pct): what the association service would say, with ids and names of its own."""
    seen = P.compound_targets(g).select("compound_id", "target_id").join(P.edge(g.known, "compound_id", "disease_id"), "compound_id")
    counts = seen.groupBy("target_id", "disease_id").agg((F.count("*") * 23 % 100).cast("int").alias("pct"))
    said = g.disease.select("disease_id", F.nullif("mesh_id", F.lit("")).alias("curie"), F.concat(F.upper("name"), F.lit(" (disorder)")).alias("outside_name"))
    return counts.join(said, "disease_id").drop("disease_id")


def match_diseases(g: Graph, asked: DataFrame) -> DataFrame:
    """asked (curie, outside_name, ...) with the active disease it means, by id, else by tolerant name, and which told.
    Of diseases that share an id or a name the first by name counts."""
    mine = active(g.disease)
    ids = mine.where("mesh_id <> ''").groupBy(F.col("mesh_id").alias("curie")).agg(F.min("name").alias("by_id"))
    forms = mine.groupBy(N.match_form(F.col("name")).alias("form")).agg(F.min("name").alias("by_name"))
    found = asked.withColumn("form", N.match_form(F.col("outside_name"))).join(ids, "curie", "left").join(forms, "form", "left")
    tier = F.when(F.col("by_id").isNotNull(), "id").when(F.col("by_name").isNotNull(), "name").otherwise("none")
    return found.withColumn("disease", F.coalesce("by_id", "by_name")).withColumn("tier", tier).drop("form", "by_id", "by_name")


def target_kinds(g: Graph) -> DataFrame:
    """(target_id, kind, protein, last): kinds with families and strangers among them; last digit of the protein's id."""
    t = F.col("target_id")
    kind = F.when(t.startswith("Brand#55"), "PROTEIN FAMILY").when(t.startswith("Brand#54"), "NUCLEIC-ACID").otherwise(F.col("target_type"))
    return g.target.select(t, kind.alias("kind"), F.col("uniprot_id").alias("protein"), F.right(F.col("uniprot_id"), F.lit(1)).alias("last"))


def target_hits(g: Graph) -> dict[str, DataFrame]:
    """Matched associations by branch: single proteins, complexes by subunit, organisms by what said so."""
    hits = match_diseases(g, outside_associations(g)).withColumn("score", F.col("pct") / 100)
    kinds = target_kinds(g)
    ok = (F.col("score") >= LEAST_SCORE) & F.col("disease").isNotNull()
    single = kinds.where("kind = 'SINGLE PROTEIN' AND last NOT IN ('3', '5')").join(hits, "target_id").withColumn("ok", ok)
    parts = kinds.where("kind = 'SINGLE PROTEIN'").select("protein", F.col("target_id").alias("subunit"))
    nth = F.row_number().over(Window.partitionBy("target_id").orderBy("subunit"))
    units = kinds.where("kind = 'PROTEIN COMPLEX' AND last <> '1'").join(parts, "protein").withColumn("nth", nth).where(F.col("nth") <= SUBUNITS)
    complexes = units.where("last <> '5'").join(hits.withColumnRenamed("target_id", "subunit"), "subunit").withColumn("ok", ok)
    knows = F.col("last").isin("1", "2")
    organisms = kinds.where("kind = 'ORGANISM' AND last <> '3'").join(hits, "target_id").withColumn(
        "said", F.array_compact(F.array(F.when(knows & (F.col("pct") % 3 == 0), "efo"), F.when(knows & (F.col("pct") % 5 == 0), "doid"))))
    silent = organisms.groupBy("target_id").agg((F.max(F.size("said")) == 0).alias("silent"))
    organisms = organisms.join(silent, "target_id").withColumn("said", F.explode(F.when(F.col("silent"), F.array(F.lit("llm"))).otherwise(F.col("said"))))
    return {"single": single, "units": units, "complexes": complexes, "organisms": organisms.withColumn("ok", F.col("disease").isNotNull())}


def target_edges(h: dict[str, DataFrame]) -> DataFrame:
    """One edge a target and disease: the best score, of a complex with the subunit that has it, of an organism with who
    said so."""
    key = ["target_id", "disease"]
    single = h["single"].where("ok").groupBy(*key).agg(F.max("score").alias("score")).select(
        *key, T.association_type(F.col("score")).alias("evidence_type"), "score", F.lit("").alias("detail"))
    best = F.max(F.struct("score", F.col("subunit")))
    complexes = h["complexes"].where("ok").groupBy(*key).agg(F.min(F.struct((-F.col("score")).alias("s"), "subunit")).alias("best"), best.alias("b")).select(
        *key, F.lit("ot_association_complex_aggregate").alias("evidence_type"), F.col("b.score").alias("score"), F.col("best.subunit").alias("detail"))
    said = F.collect_set("said")
    organisms = h["organisms"].where("ok").groupBy(*key).agg(said.alias("said"))

    def has(x: str) -> Column:
        return F.array_contains("said", x)

    label = F.when(has("efo") & has("doid"), "efo+doid").when(has("llm"), "llm_verified").when(has("efo"), "efo").otherwise("doid")
    kind = T.lookup({"efo+doid": "ncbi_pathogen_consensus", "llm_verified": "ncbi_pathogen_llm_verified", "efo": "ncbi_pathogen_efo", "doid": "ncbi_pathogen_doid"}, label)
    organisms = organisms.select(*key, kind.alias("evidence_type"), F.lit(None).cast("double").alias("score"), label.alias("detail"))
    return single.unionByName(complexes).unionByName(organisms)


@entry("lk10_12_target_edges", LINK_SQL + """
SELECT target_id, disease, evidence_type, score, detail, CASE evidence_type WHEN 'ot_association_strong' THEN 0.85 WHEN 'ot_association_moderate' THEN 0.65 WHEN 'ot_association_weak' THEN 0.45
  WHEN 'ot_association_complex_aggregate' THEN 0.7 WHEN 'ncbi_pathogen_consensus' THEN 0.92 WHEN 'ncbi_pathogen_llm_verified' THEN 0.75 ELSE 0.9 END::double AS confidence FROM edges""")
def planned_edges(g: Graph) -> DataFrame:
    return target_edges(target_hits(g)).withColumn("confidence", T.lookup(TARGET_PRIOR, F.col("evidence_type")))


@entry("lk13_target_statuses", LINK_SQL + """
SELECT k.target_id, CASE WHEN kind = 'PROTEIN FAMILY' THEN 'skipped_protein_family' WHEN kind = 'NUCLEIC-ACID' THEN 'skipped_unknown_type'
  WHEN kind = 'SINGLE PROTEIN' AND k.last = '3' THEN 'skipped_no_uniprot' WHEN kind = 'ORGANISM' AND k.last = '3' THEN 'skipped_no_tax_id'
  WHEN kind = 'PROTEIN COMPLEX' AND k.target_id NOT IN (SELECT complex_id FROM subunits) THEN 'skipped_no_subunits'
  WHEN kind IN ('SINGLE PROTEIN', 'PROTEIN COMPLEX') AND k.last = '5' THEN 'error' WHEN l.n > 0 THEN 'linked' ELSE 'no_associations' END AS status,
  coalesce(l.n, 0) AS linked, coalesce(d.dropped, 0) AS dropped FROM kinds k LEFT JOIN linked l USING (target_id) LEFT JOIN drops d USING (target_id)""")
def target_statuses(g: Graph) -> DataFrame:
    """Every target goes to one of five branches; a transient answer is an error and nothing of the target is changed."""
    h = target_hits(g)
    linked = target_edges(h).groupBy("target_id").agg(F.count("*").alias("linked"))
    bad = [h[n].where("NOT ok").select("target_id") for n in ("single", "complexes", "organisms")]
    dropped = bad[0].union(bad[1]).union(bad[2]).groupBy("target_id").agg(F.count("*").alias("dropped"))
    units = h["units"].select("target_id").distinct().withColumn("units", F.lit(True))
    rows = target_kinds(g).join(units, "target_id", "left").join(linked, "target_id", "left").join(dropped, "target_id", "left")
    kind, last = F.col("kind"), F.col("last")
    status = (
        F.when(kind == "PROTEIN FAMILY", "skipped_protein_family").when(~kind.isin("SINGLE PROTEIN", "PROTEIN COMPLEX", "ORGANISM"), "skipped_unknown_type")
        .when((kind == "SINGLE PROTEIN") & (last == "3"), "skipped_no_uniprot").when((kind == "ORGANISM") & (last == "3"), "skipped_no_tax_id")
        .when((kind == "PROTEIN COMPLEX") & F.col("units").isNull(), "skipped_no_subunits").when((kind != "ORGANISM") & (last == "5"), "error")
        .when(F.col("linked") > 0, "linked").otherwise("no_associations"))
    return rows.select("target_id", status.alias("status"), F.coalesce("linked", F.lit(0)).alias("linked"), F.coalesce("dropped", F.lit(0)).alias("dropped"))


@entry("lk20_target_summary", LINK_SQL + """
SELECT evidence_type, count(*) AS edges, count(DISTINCT target_id) AS targets, count(DISTINCT disease) AS diseases FROM edges GROUP BY evidence_type""")
def target_summary(g: Graph) -> DataFrame:
    return target_edges(target_hits(g)).groupBy("evidence_type").agg(
        F.count("*").alias("edges"), F.count_distinct("target_id").alias("targets"), F.count_distinct("disease").alias("diseases"))


ROUTE_SQL = """
, asked AS (SELECT source_id, name AS source, canonical_type, canonical_part, CASE WHEN canonical_source IS NULL THEN NULL WHEN source_id % 3 = 0 THEN 'gemini+coconut' WHEN source_id % 3 = 1 THEN 'gemini+pubchem' ELSE 'gemini' END AS said,
    CASE WHEN canonical_type = 'chemical' AND source_id % 9 >= 6 THEN 'C' || (source_id % 9) || 'H12' ELSE canonical_name END AS canonical,
    CASE source_id % 4 WHEN 0 THEN 'Planta alba' WHEN 1 THEN 'Radix longa' WHEN 2 THEN 'Herba fusca' END AS alias FROM source)
, organisms AS (SELECT organism, count(DISTINCT inchikey) AS n FROM (SELECT 'canon ' || (compound_id % 6) AS organism, inchikey FROM compound
    UNION ALL SELECT CASE compound_id % 3 WHEN 0 THEN 'planta alba' ELSE 'radix longa' END, inchikey FROM compound) GROUP BY organism)
, chemicals AS (SELECT 'canon ' || k AS name FROM range(3) r(k)), formulas AS (SELECT * FROM (VALUES ('C6H12', 2), ('C7H12', 1)) f(formula, candidates))
, routed AS (SELECT a.*, CASE WHEN said IS NULL THEN 'skipped_no_auditor' WHEN coalesce(canonical, '') = '' THEN 'skipped_uncanonicalized'
    WHEN canonical_type = 'organism' AND o.n IS NOT NULL THEN 'canonical' WHEN canonical_type = 'organism' AND p.n IS NOT NULL THEN 'alias'
    WHEN canonical_type = 'chemical' AND c.name IS NOT NULL THEN 'name' WHEN canonical_type = 'chemical' AND f.formula IS NOT NULL THEN 'formula' ELSE 'no_compounds_found' END AS way,
    o.n AS by_name, p.n AS by_alias, f.candidates
  FROM asked a LEFT JOIN organisms o ON o.organism = a.canonical LEFT JOIN organisms p ON p.organism = lower(a.alias) LEFT JOIN chemicals c ON c.name = a.canonical LEFT JOIN formulas f ON f.formula = a.canonical)
, evidence AS (SELECT *, CASE way WHEN 'canonical' THEN CASE WHEN said = 'gemini+coconut' THEN 'coconut_organism_canonical' ELSE 'coconut_organism_unverified' END WHEN 'alias' THEN 'coconut_organism_alias'
    WHEN 'name' THEN CASE WHEN said = 'gemini+pubchem' THEN 'pubchem_chemical_canonical' ELSE 'pubchem_chemical_unverified' END WHEN 'formula' THEN 'pubchem_chemical_formula' END AS evidence_type FROM routed)
SELECT source, CASE WHEN evidence_type IS NULL THEN way ELSE 'linked' END AS status, evidence_type, CASE way WHEN 'canonical' THEN by_name WHEN 'alias' THEN by_alias WHEN 'name' THEN 1 WHEN 'formula' THEN 1 ELSE 0 END AS compounds,
  round(CASE evidence_type WHEN 'coconut_organism_canonical' THEN 0.7 WHEN 'coconut_organism_alias' THEN 0.55 WHEN 'coconut_organism_unverified' THEN 0.5 WHEN 'pubchem_chemical_canonical' THEN 0.8 WHEN 'pubchem_chemical_unverified' THEN 0.55 WHEN 'pubchem_chemical_formula' THEN 0.5 END::double
    - CASE WHEN canonical_type = 'organism' AND canonical_part <> 'whole' THEN 0.1 ELSE 0 END, 3) AS confidence,
  CASE WHEN evidence_type IS NULL THEN NULL WHEN canonical_type = 'organism' THEN 'species_level' ELSE 'compound_level' END AS resolution, CASE WHEN way = 'formula' THEN candidates > 1 END AS ambiguous FROM evidence"""


@entry("lk01_02_source_routing", ROUTE_SQL)
def source_routing(g: Graph) -> DataFrame:
    """Where the compounds of a source come from: an organism by its canonical name in the inverted index, then by its
    Latin aliases; a chemical by name, then by formula; with the confidence its edges get.

    The index is counted by name before sources meet it, so a common organism costs a source one row.
    """
    spark, s = g.source.sparkSession, F.col("source_id")
    canonical = F.when((F.col("canonical_type") == "chemical") & (s % 9 >= 6), F.concat(F.lit("C"), (s % 9).cast("string"), F.lit("H12"))).otherwise(F.col("canonical_name"))
    said = F.when(F.col("canonical_source").isNotNull(), F.when(s % 3 == 0, "gemini+coconut").when(s % 3 == 1, "gemini+pubchem").otherwise("gemini"))
    alias = F.when(s % 4 == 0, "old Planta  alba").when(s % 4 == 1, "Radix longa, dried").when(s % 4 == 2, "Herba fusca")
    asked = g.source.select("source_id", F.col("name").alias("source"), "canonical_type", "canonical_part", said.alias("said"), canonical.alias("canonical"), F.array(F.lit("no name"), alias).alias("aliases"))
    i = F.col("compound_id")
    cells = g.compound.select("inchikey", F.concat(F.lit("Canon "), (i % 6).cast("string"), F.lit("|"), F.when(i % 3 == 0, "Planta alba").otherwise("Radix longa"), F.lit("| ")).alias("organisms"))
    index = cells.select("inchikey", F.explode(N.organisms(F.col("organisms"))).alias("organism")).groupBy("organism").agg(F.count_distinct("inchikey").alias("n"))
    chemicals = spark.range(3).select(F.concat(F.lit("canon "), F.col("id").cast("string")).alias("canonical"), F.lit(True).alias("by_chemical"))
    formulas = spark.createDataFrame([("C6H12", 2), ("C7H12", 1)], "canonical string, candidates int")
    by_name = index.select(F.col("organism").alias("canonical"), F.col("n").alias("by_name"))
    rows = asked.join(by_name, "canonical", "left").join(F.broadcast(chemicals), "canonical", "left").join(F.broadcast(formulas), "canonical", "left")
    # the first alias that the index knows
    tried = asked.select("source_id", F.posexplode(N.binomials(F.array_compact("aliases"))).alias("pos", "alias")).join(index, F.lower("alias") == F.col("organism"))
    rows = rows.join(tried.groupBy("source_id").agg(F.min(F.struct("pos", "n")).alias("by_alias")), "source_id", "left")
    organism, chemical = F.col("canonical_type") == "organism", F.col("canonical_type") == "chemical"
    way = (
        F.when(F.col("said").isNull(), "skipped_no_auditor").when(F.coalesce("canonical", F.lit("")) == "", "skipped_uncanonicalized")
        .when(organism & F.col("by_name").isNotNull(), "canonical").when(organism & F.col("by_alias").isNotNull(), "alias")
        .when(chemical & F.col("by_chemical"), "name").when(chemical & N.looks_like_formula(F.col("canonical")) & F.col("candidates").isNotNull(), "formula")
        .otherwise("no_compounds_found"))
    rows = rows.withColumn("way", way)
    sure = F.when(F.col("way") == "canonical", F.when(F.col("said") == "gemini+coconut", "coconut_organism_canonical").otherwise("coconut_organism_unverified")).when(
        F.col("way") == "alias", "coconut_organism_alias").when(
        F.col("way") == "name", F.when(F.col("said") == "gemini+pubchem", "pubchem_chemical_canonical").otherwise("pubchem_chemical_unverified")).when(F.col("way") == "formula", "pubchem_chemical_formula")
    rows = rows.withColumn("evidence_type", sure)
    penalty = F.when(organism & (N.part_of(F.col("canonical_part")) != "whole"), PART_PENALTY).otherwise(0.0)
    linked = F.col("evidence_type").isNotNull()
    return rows.select(
        "source", F.when(linked, "linked").otherwise(F.col("way")).alias("status"), "evidence_type",
        F.when(F.col("way") == "canonical", F.col("by_name")).when(F.col("way") == "alias", F.col("by_alias.n")).when(linked, 1).otherwise(0).alias("compounds"),
        F.when(linked, F.round(F.greatest(F.lit(0.0), T.lookup(EXTRACTION_PRIOR, F.col("evidence_type")) - penalty), 3)).alias("confidence"),
        F.when(linked, F.when(organism, "species_level").otherwise("compound_level")).alias("resolution"),
        F.when(F.col("way") == "formula", F.col("candidates") > 1).alias("ambiguous"))


MAP_SQL = """
, answers AS (SELECT m.name AS malady, CASE length(m.name) % 6 WHEN 0 THEN 'disease' WHEN 1 THEN 'symptom' WHEN 2 THEN 'syndrome' WHEN 3 THEN 'ambiguous' WHEN 4 THEN 'tcm_no_equivalent' ELSE 'wonder' END AS kind FROM malady m)
, plans AS (SELECT a.malady, a.kind, mp.rank AS pos, CASE WHEN mp.rank = 1 THEN 'primary' ELSE 'syndrome_component' END AS role, d.name AS disease,
    CASE WHEN d.icd10_code IS NOT NULL THEN 'icd10' WHEN d.mesh_id <> '' THEN 'mesh' END AS db FROM answers a JOIN maps mp ON mp.src = a.malady JOIN disease d ON d.disease_id = mp.dst WHERE mp.rank = 1 OR a.kind IN ('syndrome', 'symptom'))
, shape AS (SELECT a.malady, a.kind, count(p.pos) FILTER (p.role = 'primary') AS primaries, count(p.pos) FILTER (p.role <> 'primary') AS components FROM answers a LEFT JOIN plans p USING (malady) GROUP BY a.malady, a.kind)
, judged AS (SELECT *, CASE WHEN kind = 'tcm_no_equivalent' THEN CASE WHEN primaries + components > 0 THEN 'must have no mapping' END WHEN kind IN ('disease', 'symptom', 'ambiguous') THEN
    CASE WHEN primaries <> 1 THEN 'must have one primary mapping' WHEN components > 0 THEN 'must have no component' END WHEN kind = 'syndrome' THEN CASE WHEN primaries <> 1 THEN 'must have one primary mapping' WHEN components > 2 THEN 'must have two components at most' END
    ELSE 'unknown kind' END AS violation FROM shape)
, kept AS (SELECT p.*, row_number() OVER (PARTITION BY p.malady ORDER BY p.pos) AS new_rank FROM plans p JOIN judged j USING (malady) WHERE j.violation IS NULL AND p.kind <> 'tcm_no_equivalent' AND p.db IS NOT NULL
    AND (p.role = 'primary' OR EXISTS (SELECT 1 FROM plans q WHERE q.malady = p.malady AND q.role = 'primary' AND q.db IS NOT NULL)))
"""


def mapping_plans(g: Graph) -> tuple[DataFrame, DataFrame]:
    """(answers, plans): the kind that a malady is said to be and whether that answer is well formed; and its proposed
    mappings with the data base that knows the name."""
    kinds = ["disease", "symptom", "syndrome", "ambiguous", "tcm_no_equivalent", "wonder"]
    answers = g.malady.select(F.col("name").alias("malady"), F.element_at(F.array(*map(F.lit, kinds)), F.length("name") % 6 + 1).alias("kind"))
    known = g.disease.select("disease_id", F.col("name").alias("disease"), F.when(F.col("icd10_code").isNotNull(), "icd10").when(F.col("mesh_id") != "", "mesh").alias("db"))
    plans = P.edge(g.maps, "malady", "disease_id", pos="rank").join(answers, "malady").where("pos = 1 OR kind IN ('syndrome', 'symptom')").join(known, "disease_id")
    plans = plans.withColumn("role", F.when(F.col("pos") == 1, "primary").otherwise("syndrome_component"))
    counts = plans.groupBy("malady").agg(F.count_if(F.col("role") == "primary").alias("primaries"), F.count_if(F.col("role") != "primary").alias("components"))
    shape = answers.join(counts, "malady", "left").fillna(0, ["primaries", "components"])
    kind, one = F.col("kind"), F.when(F.col("primaries") != 1, "must have one primary mapping")
    violation = (
        F.when(kind == "tcm_no_equivalent", F.when(F.col("primaries") + F.col("components") > 0, "must have no mapping"))
        .when(kind.isin("disease", "symptom", "ambiguous"), F.coalesce(one, F.when(F.col("components") > 0, "must have no component")))
        .when(kind == "syndrome", F.coalesce(one, F.when(F.col("components") > MOST_COMPONENTS, "must have two components at most"))).otherwise("unknown kind"))
    return shape.withColumn("violation", violation), plans


def kept_mappings(answers: DataFrame, plans: DataFrame) -> DataFrame:
    """Mappings that are written: a verified primary, and with it, for syndromes, verified components; ranked anew."""
    fine = plans.where("db IS NOT NULL").join(answers.where("violation IS NULL AND kind <> 'tcm_no_equivalent'").select("malady"), "malady", "left_semi")
    led = fine.join(fine.where("role = 'primary'").select("malady"), "malady", "left_semi")
    rows = led.withColumn("new_rank", F.row_number().over(Window.partitionBy("malady").orderBy("pos"))).where(F.col("new_rank") <= MOST_COMPONENTS + 1)
    penalty = F.when(F.col("kind") == "symptom", SYMPTOM_PENALTY).otherwise(0.0)
    return rows.withColumn("confidence", F.round(T.lookup(MAPPING_PRIOR, F.concat_ws("|", "role", "db")) - penalty, 3))


@entry("lk16_17_mapping_edges", MAP_SQL + """
SELECT malady, disease, role, db, new_rank, round(CASE role WHEN 'primary' THEN CASE db WHEN 'icd10' THEN 0.85 ELSE 0.8 END ELSE CASE db WHEN 'icd10' THEN 0.7 ELSE 0.65 END END::double - CASE WHEN kind = 'symptom' THEN 0.05 ELSE 0 END, 3) AS confidence FROM kept WHERE new_rank <= 3""")
def mapping_edges(g: Graph) -> DataFrame:
    return kept_mappings(*mapping_plans(g)).select("malady", "disease", "role", "db", "new_rank", "confidence")


@entry("lk15_18_mapping_status", MAP_SQL + """
SELECT j.malady, CASE WHEN violation IS NOT NULL THEN 'error' ELSE kind END AS classification, violation, CASE WHEN violation IS NOT NULL THEN 'error' WHEN kind = 'tcm_no_equivalent' THEN kind
  WHEN EXISTS (SELECT 1 FROM kept k WHERE k.malady = j.malady) THEN 'linked' WHEN primaries > 0 THEN 'unverified' ELSE 'tcm_no_equivalent' END AS status,
  (SELECT count(*) FROM kept k WHERE k.malady = j.malady AND new_rank <= 3) AS edges FROM judged j""")
def mapping_status(g: Graph) -> DataFrame:
    """What becomes of each malady: a malformed answer is an error, an unverified primary is not written."""
    answers, plans = mapping_plans(g)
    edges = kept_mappings(answers, plans).groupBy("malady").agg(F.count("*").alias("edges"))
    rows, bad = answers.join(edges, "malady", "left").fillna(0, ["edges"]), F.col("violation").isNotNull()
    status = F.when(bad, "error").when(F.col("kind") == "tcm_no_equivalent", "tcm_no_equivalent").when(F.col("edges") > 0, "linked").when(
        F.col("primaries") > 0, "unverified").otherwise("tcm_no_equivalent")
    return rows.select("malady", F.when(bad, "error").otherwise(F.col("kind")).alias("classification"), "violation", status.alias("status"), "edges")


@entry("fn18_prior_of_edges", """
SELECT s.name AS source, x.evidence_type, count(*) AS edges, round(CASE x.evidence_type WHEN 'coconut_organism_canonical' THEN 0.7 WHEN 'coconut_organism_alias' THEN 0.55 WHEN 'pubchem_chemical_formula' THEN 0.5 END::double
  - CASE WHEN s.canonical_type = 'organism' AND s.canonical_part <> 'whole' THEN 0.1 ELSE 0 END, 3) AS confidence FROM extracted x JOIN source s ON s.source_id = x.dst GROUP BY ALL""")
def prior_of_edges(g: Graph) -> DataFrame:
    """The prior confidence of a source's extraction edges by kind; null for kinds without one."""
    rows = P.edge(g.extracted, "compound_id", "source_id", evidence_type="evidence_type").join(g.source.select("source_id", F.col("name").alias("source"), "canonical_type", "canonical_part"), "source_id")
    penalty = F.when((F.col("canonical_type") == "organism") & (N.part_of(F.col("canonical_part")) != "whole"), PART_PENALTY).otherwise(0.0)
    prior = T.lookup(EXTRACTION_PRIOR, F.col("evidence_type"))
    confidence = F.when(prior.isNotNull(), F.round(F.greatest(F.lit(0.0), prior - penalty), 3))
    return rows.select("source_id", "source", "evidence_type", confidence.alias("confidence")).groupBy("source", "evidence_type", "confidence").agg(F.count("*").alias("edges"))
