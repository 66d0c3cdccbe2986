"""The named graph queries.  Each entry pairs a DataFrame plan over the graph with SQL for a second engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators import paths as P
from loomgraph.plans.registry import Registry
from loomgraph.sources.projection import Graph, active

ENTRIES = Registry()
entry = ENTRIES.entry

CLOSED_SQL = """
, closed AS (
  SELECT s.source_id, s.name AS source, m.name AS malady, d.name AS disease, d.disease_id, x.src AS compound_id, c.name AS compound,
    tg.dst AS target_id, t.name AS target, x.confidence * tg.confidence * r.confidence * mp.confidence AS score
  FROM treats tt JOIN source s ON s.source_id = tt.src JOIN malady m ON m.name = tt.dst
  JOIN maps mp ON mp.src = m.name AND coalesce(mp.is_primary, true)
  JOIN disease d ON d.disease_id = mp.dst
  JOIN extracted x ON x.dst = s.source_id JOIN compound c ON c.compound_id = x.src
  JOIN targets tg ON tg.src = x.src JOIN target t ON t.target_id = tg.dst
  JOIN relates r ON r.src = tg.dst AND r.dst = d.disease_id
  WHERE NOT coalesce(s.archived, false) AND NOT coalesce(m.archived, false) AND NOT coalesce(d.archived, false)
)"""
CLAIM_SQL = CLOSED_SQL + """
SELECT source, malady, disease, count(*) AS num_converging_paths, sum(CAST(round(score * 1000000) AS bigint))::double / count(*) / 1000000 AS avg_path_confidence,
  string_agg(compound || '|' || target || '|' || CAST(round(score * 1000000) AS bigint), ';' ORDER BY compound || '|' || target || '|' || CAST(round(score * 1000000) AS bigint)) AS evidence_paths
FROM closed {where} GROUP BY source, malady, disease"""


# the mean is taken over whole millionths, so that it doesn't hang on the order of the sum
def validate_claims(g: Graph, source: str | None = None) -> DataFrame:
    """Closed evidence loops per (source, malady, disease), with their count, mean score and evidence."""
    found = P.closed_paths(g)
    if source is not None:
        found = found.where(F.col("source") == source)
    score = F.col("ex") * F.col("tgt") * F.col("rel") * F.col("mp")
    found = P.with_target(g, P.with_compound(g, found)).withColumn("score", score)
    text = F.concat_ws("|", "compound", "target", P.micro(F.col("score")).cast("string"))
    return found.groupBy("source", "malady", "disease").agg(
        F.count("*").alias("num_converging_paths"), (F.sum(P.micro(F.col("score"))) / F.count("*") / 1_000_000).alias("avg_path_confidence"),
        F.array_join(F.array_sort(F.collect_list(text)), ";").alias("evidence_paths"))


ENTRIES["gq01_validate_claims"] = (validate_claims, CLAIM_SQL.format(where=""))
ENTRIES["gq02_claims_of_source"] = (
    lambda g: validate_claims(g, "Supplier#000000003"), CLAIM_SQL.format(where="WHERE source = 'Supplier#000000003'"))


def novel_compounds(g: Graph, disease: str, limit: int, strict: bool = False) -> DataFrame:
    """Routes back from a disease to compounds, scored with cross-validation.

    As the filter follows an optional match, a known treatment only loses its cross-validation; strict drops it.
    """
    wanted = active(g.disease).where(F.col("name") == disease).select("disease_id")
    routes = P.claims(g).join(P.mapped(g), "malady").join(wanted, "disease_id").join(P.source_compounds(g), "source_id").join(
        P.compound_targets(g), "compound_id")
    known = P.edge(g.known, "compound_id", "disease_id").withColumn("is_known", F.lit(True))
    routes = routes.join(known, ["compound_id", "disease_id"], "left").join(P.target_diseases(g), ["target_id", "disease_id"], "left")
    if strict:
        routes = routes.where("is_known IS NULL")
    cross = F.when(F.col("is_known").isNull(), F.coalesce("rel", F.lit(0.0))).otherwise(0.0)
    path = F.col("mp") * F.col("tt") * F.col("ex") * F.col("tgt")
    routes = routes.withColumn("path", path).withColumn("cross", cross).withColumn("composite", path * (1 + F.col("cross")))
    top = routes.orderBy(F.round("composite", 9).desc_nulls_last(), "compound_id", "source", "malady", "target_id").limit(limit)
    return P.with_target(g, P.with_compound(g, top)).select(
        "compound_id", "compound", "source", "malady", "target", F.round("path", 6).alias("discovery_path_score"),
        F.round("cross", 6).alias("cross_validation_score"), F.round("composite", 6).alias("composite_score"))


NOVEL_SQL = """
, routes AS (
  SELECT x.src AS compound_id, s.name AS source, m.name AS malady, tg.dst AS target_id, k.src IS NOT NULL AS is_known,
    mp.confidence * tt.confidence * x.confidence * tg.confidence AS path,
    CASE WHEN k.src IS NULL THEN coalesce(r.confidence, 0) ELSE 0 END AS cross_score
  FROM disease d JOIN maps mp ON mp.dst = d.disease_id AND coalesce(mp.is_primary, true)
  JOIN malady m ON m.name = mp.src JOIN treats tt ON tt.dst = m.name JOIN source s ON s.source_id = tt.src
  JOIN extracted x ON x.dst = s.source_id JOIN targets tg ON tg.src = x.src
  LEFT JOIN known k ON k.src = x.src AND k.dst = d.disease_id LEFT JOIN relates r ON r.src = tg.dst AND r.dst = d.disease_id
  WHERE d.name = 'NATION_{n}' AND NOT coalesce(d.archived, false) AND NOT coalesce(m.archived, false) AND NOT coalesce(s.archived, false)
), top AS (
  SELECT *, path * (1 + cross_score) AS composite FROM routes {where}
  ORDER BY round(path * (1 + cross_score), 9) DESC NULLS LAST, compound_id, source, malady, target_id LIMIT 50
)
SELECT compound_id, c.name AS compound, source, malady, t.name AS target, round(path, 6) AS discovery_path_score,
  round(cross_score, 6) AS cross_validation_score, round(composite, 6) AS composite_score
FROM top JOIN compound c USING (compound_id) JOIN target t USING (target_id)"""


for _name, _strict in (("gq03_novel_compounds", False), ("gq03_novel_compounds_strict", True)):
    ENTRIES[_name] = (
        lambda g, strict=_strict: novel_compounds(g, "NATION_3", 50, strict),
        NOVEL_SQL.format(n=3, where="WHERE NOT is_known" if _strict else ""))


@entry("gq04_unsupported_claims", """
SELECT s.name AS source, m.name AS malady, round(tt.confidence, 6) AS claim_confidence, 'No mechanistic support found' AS flag
FROM treats tt JOIN source s ON s.source_id = tt.src JOIN malady m ON m.name = tt.dst
WHERE NOT coalesce(s.archived, false) AND NOT coalesce(m.archived, false)
  AND EXISTS (SELECT 1 FROM extracted x WHERE x.dst = tt.src)
  AND NOT EXISTS (SELECT 1 FROM extracted x JOIN targets tg ON tg.src = x.src JOIN relates r ON r.src = tg.dst
    JOIN maps mp ON mp.dst = r.dst AND coalesce(mp.is_primary, true) WHERE x.dst = tt.src AND mp.src = tt.dst)""")
def unsupported_claims(g: Graph) -> DataFrame:
    some = P.claims(g).join(P.source_compounds(g), "source_id", "left_semi")
    pairs = some.join(P.mapped(g), "malady").select("source_id", "malady", "disease_id")
    asked = pairs.join(P.source_compounds(g).select("source_id", "compound_id"), "source_id")
    met = asked.join(P.compound_diseases(g).select("compound_id", "disease_id"), ["compound_id", "disease_id"], "left_semi").select("source_id", "malady").distinct()
    return some.join(met, ["source_id", "malady"], "left_anti").select(
        "source", "malady", F.round("tt", 6).alias("claim_confidence"), F.lit("No mechanistic support found").alias("flag"))


@entry("gq05_graph_stats", """
SELECT (SELECT count(*) FROM source WHERE NOT coalesce(archived, false)) + (SELECT count(*) FROM malady WHERE NOT coalesce(archived, false))
   + (SELECT count(*) FROM disease WHERE NOT coalesce(archived, false)) + (SELECT count(*) FROM compound WHERE NOT coalesce(archived, false))
   + (SELECT count(*) FROM target) + (SELECT count(*) FROM preparation) AS total_nodes,
  (SELECT count(*) FROM extracted) + (SELECT count(*) FROM treats) + (SELECT count(*) FROM maps) + (SELECT count(*) FROM targets)
   + (SELECT count(*) FROM relates) + (SELECT count(*) FROM known) + (SELECT count(*) FROM prepared) AS total_edges,
  (SELECT count(*) FROM source WHERE NOT coalesce(archived, false)) AS sources,
  (SELECT count(*) FROM malady WHERE NOT coalesce(archived, false)) AS maladies,
  (SELECT count(*) FROM compound WHERE NOT coalesce(archived, false)) AS compounds,
  (SELECT count(*) FROM disease WHERE NOT coalesce(archived, false)) AS diseases""")
def graph_stats(g: Graph) -> DataFrame:
    parts = None
    for kind, tables in (("node", g.nodes), ("edge", g.edges)):
        for name, df in tables.items():
            df = active(df) if kind == "node" else df
            one = df.select(F.lit(kind).alias("kind"), F.lit(name).alias("name"))
            parts = one if parts is None else parts.union(one)

    def count(test):
        return F.count(F.when(test, 1))

    return parts.agg(
        count(F.col("kind") == "node").alias("total_nodes"), count(F.col("kind") == "edge").alias("total_edges"),
        *[count(F.col("name") == n).alias(a) for n, a in (("source", "sources"), ("malady", "maladies"), ("compound", "compounds"), ("disease", "diseases"))])


@entry("gq06_unlinked_sources", """
SELECT name, canonical_name FROM source WHERE NOT coalesce(archived, false) AND source_id NOT IN (SELECT dst FROM extracted)""")
def unlinked_sources(g: Graph) -> DataFrame:
    return active(g.source).join(g.extracted.select(F.col("dst").alias("source_id")), "source_id", "left_anti").select("name", "canonical_name")


def resumable(df: DataFrame, status: str, retry: tuple[str, ...] | None, force: bool = False) -> DataFrame:
    """Rows a linker may take: never tried, or with one of the retry statuses, or all if forced."""
    if force:
        return df
    return df.where(F.col(status).isNull() | F.col(status).isin(*(retry or ("",))))


def _resume_entries() -> None:
    plans = {
        "gq07_linkable_sources": ("source", "linker_status", ("error",), "canonical_source IS NOT NULL", ["name", "canonical_name", "canonical_source", "canonical_type", "canonical_part"]),
        "gq08_linkable_sources_retry": ("source", "linker_status", ("error", "no_compounds_found"), "canonical_source IS NOT NULL", ["name", "canonical_name", "canonical_source", "canonical_type", "canonical_part"]),
        "gq09_linkable_sources_force": ("source", None, (), "canonical_source IS NOT NULL", ["name", "canonical_name", "canonical_source", "canonical_type", "canonical_part"]),
        "gq11_linkable_compounds": ("compound", "target_linker_status", (), "inchikey IS NOT NULL", ["inchikey", "name", "smiles"]),
        "gq12_linkable_compounds_retry": ("compound", "target_linker_status", ("error", "no_targets_found"), "inchikey IS NOT NULL", ["inchikey", "name", "smiles"]),
        "gq13_linkable_compounds_force": ("compound", None, (), "inchikey IS NOT NULL", ["inchikey", "name", "smiles"]),
        "gq14_linkable_for_indications": ("compound", "kt_linker_status", (), "inchikey IS NOT NULL AND chembl_id <> ''", ["inchikey", "name", "chembl_id"]),
        "gq15_linkable_for_indications_retry": ("compound", "kt_linker_status", ("error", "no_indications_found"), "inchikey IS NOT NULL AND chembl_id <> ''", ["inchikey", "name", "chembl_id"]),
        "gq16_linkable_for_indications_force": ("compound", None, (), "inchikey IS NOT NULL AND chembl_id <> ''", ["inchikey", "name", "chembl_id"]),
        "gq18_linkable_targets": ("target", "td_linker_status", (), "target_id IS NOT NULL", ["target_id", "name", "target_type", "uniprot_id"]),
        "gq19_linkable_targets_retry": ("target", "td_linker_status", ("error", "no_associations"), "target_id IS NOT NULL", ["target_id", "name", "target_type", "uniprot_id"]),
        "gq20_linkable_targets_force": ("target", None, (), "target_id IS NOT NULL", ["target_id", "name", "target_type", "uniprot_id"]),
        "gq22_mappable_maladies": ("malady", "mapper_status", (), "true", ["name", "description", "source_document"]),
        "gq23_mappable_maladies_retry": ("malady", "mapper_status", ("error", "tcm_no_equivalent", "unverified"), "true", ["name", "description", "source_document"]),
        "gq24_mappable_maladies_force": ("malady", None, (), "true", ["name", "description", "source_document"]),
    }
    for name, (label, status, retry, guard, columns) in plans.items():
        test = "true" if status is None else f"({status} IS NULL" + "".join(f" OR {status} = '{r}'" for r in retry) + ")"
        sql = f"SELECT {', '.join(columns)} FROM {label} WHERE NOT coalesce(archived, false) AND {guard} AND {test}"

        def plan(g, label=label, status=status, retry=retry, guard=guard, columns=columns):
            rows = resumable(active(g.nodes[label]).where(guard), status or "", retry, status is None)
            return rows.select(*columns).orderBy(columns[0])

        ENTRIES[name] = (plan, sql)


_resume_entries()


@entry("gq10_unlinked_compounds", "SELECT inchikey, name FROM compound WHERE NOT coalesce(archived, false) AND compound_id NOT IN (SELECT src FROM targets)")
def unlinked_compounds(g: Graph) -> DataFrame:
    return active(g.compound).join(g.targets.select(F.col("src").alias("compound_id")), "compound_id", "left_anti").select("inchikey", "name")


@entry("gq17_all_diseases", "SELECT name, mesh_id, icd10_code FROM disease WHERE NOT coalesce(archived, false)")
def all_diseases(g: Graph) -> DataFrame:
    return active(g.disease).select("name", "mesh_id", "icd10_code")


@entry("gq21_unmapped_maladies", "SELECT name, description FROM malady WHERE NOT coalesce(archived, false) AND name NOT IN (SELECT src FROM maps)")
def unmapped_maladies(g: Graph) -> DataFrame:
    return active(g.malady).join(g.maps.select(F.col("src").alias("name")), "name", "left_anti").select("name", "description")


@entry("gq25_sources_with_degree", """
SELECT name, (SELECT count(*) FROM extracted WHERE dst = source_id) + (SELECT count(*) FROM treats WHERE src = source_id)
  + (SELECT count(*) FROM prepared WHERE src = source_id) AS degree
FROM source WHERE NOT coalesce(archived, false)""")
def sources_with_degree(g: Graph) -> DataFrame:
    return active(g.source).join(P.degree(g, "source").withColumnRenamed("id", "source_id"), "source_id", "left").select(
        "name", F.coalesce("degree", F.lit(0)).alias("degree")).orderBy("degree", "name")


@entry("gq26_maladies_with_mapping", """
SELECT m.name AS malady, m.description, d.name AS disease, r.confidence AS conf, r.mapping_source AS method
FROM malady m LEFT JOIN (maps r JOIN disease d ON d.disease_id = r.dst AND coalesce(r.is_primary, true)) ON r.src = m.name
WHERE NOT coalesce(m.archived, false)""")
def maladies_with_mapping(g: Graph) -> DataFrame:
    right = P.mapped(g).join(P.node(g.disease, "disease_id", "disease_id", disease="name"), "disease_id")
    return active(g.malady).withColumnRenamed("name", "malady").join(right, "malady", "left").select(
        "malady", "description", "disease", F.col("mp").alias("conf"), F.col("mp_source").alias("method"))


@entry("gq27_overmapped_diseases", """
SELECT disease, malady_count, array_to_string(names[1:10], ';') AS sample_maladies FROM (
  SELECT d.name AS disease, count(*) AS malady_count, list(r.src ORDER BY r.src) AS names
  FROM maps r JOIN disease d ON d.disease_id = r.dst WHERE coalesce(r.is_primary, true) AND NOT coalesce(d.archived, false)
  GROUP BY d.disease_id, d.name HAVING count(*) > 1)""")
def overmapped_diseases(g: Graph, threshold: int = 1) -> DataFrame:
    return P.mapped(g).join(P.node(active(g.disease), "disease_id", "disease_id", disease="name"), "disease_id").groupBy(
        "disease_id", "disease").agg(F.count("*").alias("malady_count"), F.array_sort(F.collect_list("malady")).alias("names")).where(
        F.col("malady_count") > threshold).select("disease", "malady_count", F.array_join(F.slice("names", 1, 10), ";").alias("sample_maladies"))


@entry("gq28_archived_stats", """
SELECT label, reason, count(*) AS cnt FROM (
  SELECT 'source' AS label, archive_reason AS reason FROM source WHERE archived
  UNION ALL SELECT 'malady', archive_reason FROM malady WHERE archived
  UNION ALL SELECT 'disease', archive_reason FROM disease WHERE archived
  UNION ALL SELECT 'compound', NULL FROM compound WHERE archived) GROUP BY label, reason""")
def archived_stats(g: Graph) -> DataFrame:
    rows = None
    for label, df in g.nodes.items():
        reason = F.col("archive_reason") if "archive_reason" in df.columns else F.lit(None).cast("string")
        one = df.where("archived").select(F.lit(label).alias("label"), reason.alias("reason"))
        rows = one if rows is None else rows.union(one)
    return rows.groupBy("label", "reason").agg(F.count("*").alias("cnt"))


@entry("gq29_full_evidence_chain", """
SELECT s.name AS source, m.name AS malady, round(tt.confidence, 6) AS tt_conf, d.name AS mapped_disease, mp.confidence AS map_conf,
  mp.mapping_source AS map_method, c.inchikey, c.name AS compound, c.smiles, x.confidence AS ex_conf, t.name AS target, t.uniprot_id AS uniprot,
  round(tg.pchembl, 6) AS pchembl, tg.evidence_type AS tgt_type, tg.confidence AS tgt_conf, d2.name AS reached_disease,
  r.confidence AS rel_conf, coalesce(d2.name = d.name, false) AS loop_closed
FROM treats tt JOIN source s ON s.source_id = tt.src JOIN malady m ON m.name = tt.dst
JOIN maps mp ON mp.src = m.name AND coalesce(mp.is_primary, true) JOIN disease d ON d.disease_id = mp.dst
JOIN extracted x ON x.dst = s.source_id JOIN compound c ON c.compound_id = x.src
LEFT JOIN targets tg ON tg.src = x.src LEFT JOIN target t ON t.target_id = tg.dst
LEFT JOIN relates r ON r.src = tg.dst LEFT JOIN disease d2 ON d2.disease_id = r.dst
WHERE NOT coalesce(s.archived, false) AND NOT coalesce(m.archived, false) AND NOT coalesce(d.archived, false)""")
def full_evidence_chain(g: Graph, source: str | None = None, malady: str | None = None) -> DataFrame:
    """Paths of claims with optional targets and diseases; of all claims, or of one."""
    rows = P.claims(g)
    if source is not None:
        rows = rows.where((F.col("source") == source) & (F.col("malady") == malady))
    rows = rows.join(P.mapped(g), "malady").join(P.node(active(g.disease), "disease_id", "mapped_id", mapped_disease="name"), F.col("disease_id") == F.col("mapped_id")).drop("disease_id")
    tg = P.with_target(g, P.compound_targets(g), target="name", uniprot="uniprot_id")
    rel = P.target_diseases(g).join(P.node(g.disease, "disease_id", "disease_id", reached_disease="name"), "disease_id")
    rows = rows.join(P.source_compounds(g), "source_id").join(tg, "compound_id", "left").join(rel, "target_id", "left")
    rows = P.with_compound(g, rows, compound="name", smiles="smiles", inchikey="inchikey")
    return rows.select(
        "source", "malady", F.round("tt", 6).alias("tt_conf"), "mapped_disease", F.col("mp").alias("map_conf"), F.col("mp_source").alias("map_method"),
        "inchikey", "compound", "smiles", F.col("ex").alias("ex_conf"), "target", "uniprot", F.round("pchembl", 6).alias("pchembl"), "tgt_type",
        F.col("tgt").alias("tgt_conf"), "reached_disease", F.col("rel").alias("rel_conf"),
        F.coalesce(F.col("reached_disease") == F.col("mapped_disease"), F.lit(False)).alias("loop_closed"))


@entry("gq30_target_genericity", """
SELECT t.name AS target, t.uniprot_id AS uniprot, count(DISTINCT r.dst) AS disease_count FROM target t JOIN relates r ON r.src = t.target_id GROUP BY t.name, t.uniprot_id""")
def target_genericity(g: Graph) -> DataFrame:
    return P.with_target(g, P.target_diseases(g), target="name", uniprot="uniprot_id").groupBy("target", "uniprot").agg(
        F.count_distinct("disease_id").alias("disease_count"))


@entry("gq31_compound_ubiquity", """
SELECT c.name AS compound, count(DISTINCT s.source_id) AS source_count FROM extracted x JOIN compound c ON c.compound_id = x.src
JOIN source s ON s.source_id = x.dst WHERE NOT coalesce(s.archived, false) GROUP BY c.name""")
def compound_ubiquity(g: Graph) -> DataFrame:
    rows = P.source_compounds(g).join(active(g.source).select("source_id"), "source_id", "left_semi")
    return P.with_compound(g, rows).groupBy("compound").agg(F.count_distinct("source_id").alias("source_count"))


@entry("gq32_cross_source_compounds", """
SELECT s1.name AS source, tt.dst AS malady, c.name AS shared_compound, s2.name AS other_source
FROM treats tt JOIN source s1 ON s1.source_id = tt.src JOIN extracted x1 ON x1.dst = tt.src JOIN compound c ON c.compound_id = x1.src
JOIN extracted x2 ON x2.src = x1.src JOIN treats t2 ON t2.src = x2.dst AND t2.dst = tt.dst JOIN source s2 ON s2.source_id = x2.dst
WHERE s2.name <> s1.name AND NOT coalesce(s2.archived, false)""")
def cross_source_compounds(g: Graph) -> DataFrame:
    """A compound of a claim's source that another active source of the same malady has too."""
    holds = P.edge(g.treats, "source_id", "malady").join(P.source_compounds(g).select("compound_id", "source_id"), "source_id")
    other = holds.withColumnRenamed("source_id", "other_id").join(P.node(active(g.source), "source_id", "other_id", other_source="name"), "other_id")
    both = holds.join(other, ["compound_id", "malady"]).where("source_id <> other_id").join(P.node(g.source, "source_id", "source_id", source="name"), "source_id")
    return P.with_compound(g, both, shared_compound="name").select("source", "malady", "shared_compound", "other_source")


@entry("gq33_target_convergence", """
SELECT s1.name AS source, tt.dst AS malady, t.name AS converged_target, t.uniprot_id AS uniprot, c1.name AS compound_from_source,
  c2.name AS compound_from_other, s2.name AS other_source
FROM source s1 JOIN treats tt ON tt.src = s1.source_id JOIN extracted x1 ON x1.dst = s1.source_id JOIN compound c1 ON c1.compound_id = x1.src
JOIN targets g1 ON g1.src = x1.src JOIN target t ON t.target_id = g1.dst JOIN targets g2 ON g2.dst = g1.dst JOIN compound c2 ON c2.compound_id = g2.src
JOIN extracted x2 ON x2.src = g2.src JOIN treats t2 ON t2.src = x2.dst AND t2.dst = tt.dst JOIN source s2 ON s2.source_id = x2.dst
WHERE s1.name = 'Supplier#000000003' AND tt.dst = (SELECT min(dst) FROM treats JOIN source ON source_id = src WHERE name = 'Supplier#000000003')
  AND s2.name <> s1.name AND c2.name <> c1.name AND NOT coalesce(s2.archived, false)""")
def target_convergence(g: Graph, source: str = "Supplier#000000003", malady: str | None = None) -> DataFrame:
    """Different compounds of different sources of a malady that hit one target; the malady defaults to the source's first."""
    one = P.edge(g.treats, "source_id", "malady").join(P.node(g.source.where(F.col("name") == source), "source_id", "source_id", source="name"), "source_id")
    if malady is None:
        one = one.groupBy("source_id", "source").agg(F.min("malady").alias("malady"))
    else:
        one = one.where(F.col("malady") == malady)
    hits = P.with_compound(g, P.source_compounds(g).select("compound_id", "source_id").join(P.compound_targets(g).select("compound_id", "target_id"), "compound_id"))
    mine = one.join(hits, "source_id").select("source", "malady", "source_id", "target_id", F.col("compound").alias("compound_from_source"))
    theirs = hits.withColumnRenamed("source_id", "other_id").withColumnRenamed("compound", "compound_from_other").drop("compound_id").join(
        P.edge(g.treats, "other_id", "malady"), "other_id").join(P.node(active(g.source), "source_id", "other_id", other_source="name"), "other_id")
    met = mine.join(theirs, ["target_id", "malady"]).where("source_id <> other_id AND compound_from_source <> compound_from_other")
    return P.with_target(g, met, converged_target="name", uniprot="uniprot_id").select(
        "source", "malady", "converged_target", "uniprot", "compound_from_source", "compound_from_other", "other_source")


@entry("gq34_compound_profile", """
SELECT c.inchikey, c.name AS compound, c.smiles,
  (SELECT string_agg(DISTINCT s.name, ';' ORDER BY s.name) FROM extracted x JOIN source s ON s.source_id = x.dst WHERE x.src = c.compound_id AND NOT coalesce(s.archived, false)) AS sources,
  (SELECT count(*) FROM (SELECT DISTINCT t.name, t.uniprot_id, tg.pchembl, tg.evidence_type FROM targets tg JOIN target t ON t.target_id = tg.dst WHERE tg.src = c.compound_id)) AS targets,
  (SELECT string_agg(DISTINCT d.name, ';' ORDER BY d.name) FROM targets tg JOIN relates r ON r.src = tg.dst JOIN disease d ON d.disease_id = r.dst WHERE tg.src = c.compound_id) AS diseases_via_targets,
  (SELECT string_agg(d.name || ':' || k.clinical_phase, ';' ORDER BY d.name || ':' || k.clinical_phase) FROM known k JOIN disease d ON d.disease_id = k.dst WHERE k.src = c.compound_id) AS known_treats
FROM compound c""")
def compound_profile(g: Graph) -> DataFrame:
    """Each neighbourhood of a compound is gathered alone and then joined, so they do not multiply one another."""
    def listed(df, value, alias):
        return df.groupBy("compound_id").agg(F.array_join(F.array_sort(F.collect_set(value)), ";").alias(alias))

    names = P.node(g.disease, "disease_id", "disease_id", disease="name")
    sources = listed(P.source_compounds(g).join(P.node(active(g.source), "source_id", "source_id", source="name"), "source_id"), "source", "sources")
    hits = P.with_target(g, P.compound_targets(g), target="name", uniprot="uniprot_id").groupBy("compound_id").agg(
        F.count_distinct("target", "uniprot", "pchembl", "tgt_type").alias("targets"))
    reach = listed(P.compound_targets(g).join(P.target_diseases(g), "target_id").select("compound_id", "disease_id").distinct().join(names, "disease_id"), "disease", "diseases_via_targets")
    known = listed(P.edge(g.known, "compound_id", "disease_id", phase="clinical_phase").join(names, "disease_id").withColumn(
        "both", F.concat_ws(":", "disease", F.col("phase").cast("string"))), "both", "known_treats")
    out = g.compound.select("compound_id", "inchikey", F.col("name").alias("compound"), "smiles")
    for part in (sources, hits, reach, known):
        out = out.join(part, "compound_id", "left")
    return out.withColumn("targets", F.coalesce("targets", F.lit(0))).drop("compound_id")
