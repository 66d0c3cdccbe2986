"""Coverage reports, exports, rank metrics and edge perturbation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import names
from loomgraph.operators import dml, metrics
from loomgraph.operators import paths as P
from loomgraph.operators.ranking import placed
from loomgraph.plans import nominate, validate
from loomgraph.plans.nominate import NOMINATE_SQL
from loomgraph.plans.registry import Registry
from loomgraph.plans.validate import PATH_SQL
from loomgraph.sources.projection import Graph, active

ENTRIES = Registry()
entry = ENTRIES.entry


@entry("iq06_backward_routes", NOMINATE_SQL + "SELECT disease, malady, source, inchikey, round(tt, 6) AS tt, ex FROM back")
def backward_routes(g: Graph) -> DataFrame:
    return nominate.historical_routes(g).select("disease", "malady", "source", "inchikey", F.round("tt", 6).alias("tt"), "ex")


@entry("iq07_forward_paths", """
SELECT c.inchikey, t.target_id, d.name AS disease, tg.evidence_type AS tgt_type, r.evidence_type AS rel_type
FROM targets tg JOIN compound c ON c.compound_id = tg.src JOIN target t ON t.target_id = tg.dst JOIN relates r ON r.src = tg.dst JOIN disease d ON d.disease_id = r.dst
WHERE NOT coalesce(c.archived, false) AND NOT coalesce(d.archived, false)""")
def forward_paths(g: Graph) -> DataFrame:
    rows = P.compound_targets(g).join(P.target_diseases(g), "target_id").join(P.node(active(g.disease), "disease_id", "disease_id", disease="name"), "disease_id")
    return rows.join(P.node(active(g.compound), "compound_id", "compound_id", inchikey="inchikey"), "compound_id").select("inchikey", "target_id", "disease", "tgt_type", "rel_type")


@entry("iq12_sibling_sources", """
SELECT DISTINCT s1.name AS source, t1.dst AS malady, s2.name AS sibling FROM treats t1 JOIN treats t2 ON t2.dst = t1.dst AND t2.src <> t1.src
JOIN source s1 ON s1.source_id = t1.src JOIN source s2 ON s2.source_id = t2.src JOIN extracted x1 ON x1.dst = t1.src JOIN extracted x2 ON x2.dst = t2.src AND x2.src = x1.src
WHERE NOT coalesce(s2.archived, false)""")
def sibling_sources(g: Graph) -> DataFrame:
    """Other active sources of a malady that share a compound with the claim's source."""
    holds = P.edge(g.treats, "source_id", "malady").join(P.source_compounds(g).select("compound_id", "source_id"), "source_id")
    other = holds.withColumnRenamed("source_id", "other_id").join(P.node(active(g.source), "source_id", "other_id", sibling="name"), "other_id")
    met = holds.join(other, ["compound_id", "malady"]).where("source_id <> other_id").select("source_id", "malady", "sibling").distinct()
    return met.join(P.node(g.source, "source_id", "source_id", source="name"), "source_id").select("source", "malady", "sibling")


@entry("iq13_other_maladies", """
SELECT s.name AS source, tt.dst AS malady, d.name AS primary_disease FROM treats tt JOIN source s ON s.source_id = tt.src
LEFT JOIN (maps mp JOIN disease d ON d.disease_id = mp.dst AND mp.is_primary) ON mp.src = tt.dst WHERE NOT coalesce(s.archived, false)""")
def other_maladies(g: Graph) -> DataFrame:
    strict = P.mapped(g, strict=True).join(P.node(g.disease, "disease_id", "disease_id", primary_disease="name"), "disease_id").select("malady", "primary_disease")
    rows = P.edge(g.treats, "source_id", "malady").join(P.node(active(g.source), "source_id", "source_id", source="name"), "source_id")
    return rows.join(strict, "malady", "left").select("source", "malady", "primary_disease")


@entry("iq17_nodes_per_document", """
SELECT label, source_document, count(*) AS n FROM (SELECT 'source' AS label, source_document FROM source UNION ALL SELECT 'malady', source_document FROM malady) GROUP BY ALL""")
def nodes_per_document(g: Graph) -> DataFrame:
    rows = g.source.select(F.lit("source").alias("label"), "source_document").union(g.malady.select(F.lit("malady").alias("label"), "source_document"))
    return rows.groupBy("label", "source_document").agg(F.count("*").alias("n"))


@entry("iq18_confidence_histogram", """
SELECT count(*) FILTER (confidence >= 0.9) AS very_high, count(*) FILTER (confidence >= 0.7 AND confidence < 0.9) AS high, count(*) FILTER (confidence >= 0.5 AND confidence < 0.7) AS medium,
 count(*) FILTER (confidence < 0.5) AS low, count(*) FILTER (confidence IS NULL) AS missing, count(*) AS total FROM extracted""")
def confidence_histogram(g: Graph) -> DataFrame:
    c = F.col("confidence")
    return g.extracted.agg(
        F.count_if(c >= 0.9).alias("very_high"), F.count_if((c >= 0.7) & (c < 0.9)).alias("high"), F.count_if((c >= 0.5) & (c < 0.7)).alias("medium"),
        F.count_if(c < 0.5).alias("low"), F.count_if(c.isNull()).alias("missing"), F.count("*").alias("total"))


@entry("iq19_canonical_distribution", "SELECT canonical_source, canonical_type, count(*) AS n FROM source GROUP BY ALL")
def canonical_distribution(g: Graph) -> DataFrame:
    return g.source.groupBy("canonical_source", "canonical_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"))


@entry("iq24_disease_coverage", """
SELECT count(*) AS diseases, count(*) FILTER (disease_id IN (SELECT dst FROM known)) AS with_known, count(*) FILTER (disease_id IN (SELECT dst FROM maps WHERE coalesce(is_primary, true))) AS with_mapping,
 count(*) FILTER (disease_id IN (SELECT dst FROM relates)) AS with_targets FROM disease WHERE NOT coalesce(archived, false)""")
def disease_coverage(g: Graph) -> DataFrame:
    rows = active(g.disease).select("disease_id")
    for name, edges in (("with_known", g.known), ("with_mapping", P.mapped(g).withColumnRenamed("disease_id", "dst")), ("with_targets", g.relates)):
        rows = rows.join(edges.select(F.col("dst").alias("disease_id")).distinct().withColumn(name, F.lit(1)), "disease_id", "left")
    return rows.agg(F.count("*").alias("diseases"), *[F.count(n).alias(n) for n in ("with_known", "with_mapping", "with_targets")])


@entry("iq29_active_sources", "SELECT name FROM source WHERE NOT coalesce(archived, false)")
def active_sources(g: Graph) -> DataFrame:
    return active(g.source).select("name").orderBy("name")


@entry("iq31_maladies_of_sources", "SELECT s.name AS source, m.name AS malady FROM treats tt JOIN source s ON s.source_id = tt.src JOIN malady m ON m.name = tt.dst WHERE NOT coalesce(m.archived, false)")
def maladies_of_sources(g: Graph) -> DataFrame:
    return P.edge(g.treats, "source_id", "malady").join(P.node(active(g.malady), "name", "malady"), "malady").join(
        P.node(g.source, "source_id", "source_id", source="name"), "source_id").select("source", "malady")


@entry("iq36_edge_export", """
SELECT 'extracted' AS kind, c.name AS src_name, s.name AS dst_name, round(x.confidence, 6) AS confidence FROM extracted x JOIN compound c ON c.compound_id = x.src JOIN source s ON s.source_id = x.dst
UNION ALL SELECT 'treats', s.name, t.dst, round(t.confidence, 6) FROM treats t JOIN source s ON s.source_id = t.src""")
def edge_export(g: Graph) -> DataFrame:
    names = P.node(g.source, "source_id", "source_id", source="name")
    one = P.with_compound(g, P.source_compounds(g)).join(names, "source_id").select(F.lit("extracted").alias("kind"), F.col("compound").alias("src_name"), F.col("source").alias("dst_name"), F.round("ex", 6).alias("confidence"))
    two = P.edge(g.treats, "source_id", "malady", tt="confidence").join(names, "source_id").select(F.lit("treats").alias("kind"), F.col("source").alias("src_name"), F.col("malady").alias("dst_name"), F.round("tt", 6).alias("confidence"))
    return one.unionByName(two)


@entry("ev02_recall_at_k", NOMINATE_SQL + """
, gold AS (SELECT k.src, k.dst, d.name AS disease FROM known k JOIN disease d ON d.disease_id = k.dst WHERE EXISTS (SELECT 1 FROM cards c WHERE c.compound_id = k.src AND c.disease_id = k.dst))
SELECT gold.disease, count(*) AS gold, count(*) FILTER (o.rank <= 20) AS hits, round(count(*) FILTER (o.rank <= 20) / count(*), 6) AS recall, min(o.rank) AS first_rank
FROM gold JOIN open o ON o.compound_id = gold.src AND o.disease_id = gold.dst GROUP BY gold.disease""")
def recall_at_k(g: Graph, k: int = 20) -> DataFrame:
    """Known treatments among the first k cards of each disease when nothing is masked."""
    hits = nominate.ranked_whole(g).where("is_known")
    return hits.groupBy("disease").agg(
        F.count("*").alias("gold"), F.count_if(F.col("rank") <= k).alias("hits"), F.round(F.count_if(F.col("rank") <= k) / F.count("*"), 6).alias("recall"), F.min("rank").alias("first_rank"))


@entry("wn08_planar_dedup", NOMINATE_SQL + """
SELECT disease, inchikey, row_number() OVER (PARTITION BY disease ORDER BY rank) AS new_rank FROM (SELECT *, row_number() OVER (PARTITION BY disease_id, substr(inchikey, 1, 14) ORDER BY rank) AS nth FROM open) WHERE nth = 1""")
def planar_dedup(g: Graph) -> DataFrame:
    """The best card of each planar key, ranked anew."""
    rows = nominate.ranked_whole(g).withColumn("planar", F.substring("inchikey", 1, 14))
    best = rows.groupBy("disease", "planar").agg(F.min(F.struct("rank", "inchikey")).alias("b")).select("disease", "b.rank", "b.inchikey")
    return placed(best, ["disease"], [F.col("rank")], "new_rank").select("disease", "inchikey", "new_rank")


@entry("ev13_perturbed_edges", """
, keyed AS (SELECT src, dst, row_number() OVER (ORDER BY md5('7' || '|' || src || '|' || dst), src, dst) AS place, round_even(40 * (SELECT count(*) FROM treats) / 100, 0) AS k FROM treats)
SELECT src, dst, false AS moved FROM keyed WHERE place > k
UNION ALL SELECT src, coalesce(lead(dst) OVER (ORDER BY place), first_value(dst) OVER (ORDER BY place)) AS dst, true FROM keyed WHERE place <= k""")
def perturbed_edges(g: Graph) -> DataFrame:
    return metrics.perturb(g.treats.select("src", "dst"), 40, "7")


@entry("ev04_spearman", NOMINATE_SQL + """
, pts AS (SELECT disease, inchikey, unique_sources AS a, forward_max_score AS b FROM cards), r AS (SELECT disease, row_number() OVER (PARTITION BY disease ORDER BY a, inchikey) AS ra, row_number() OVER (PARTITION BY disease ORDER BY b, inchikey) AS rb FROM pts)
SELECT disease, count(*) AS n, CASE WHEN count(*) < 2 THEN 0 ELSE round(1 - 6 * sum((ra - rb) * (ra - rb))::double / (count(*)::double * (count(*)::double * count(*) - 1)), 6) END AS rho FROM r GROUP BY disease""")
def spearman(g: Graph) -> DataFrame:
    return metrics.spearman(nominate.cards(g), "disease", "unique_sources", "forward_max_score", "inchikey")


@entry("iq05_disease_anchor", """
SELECT disease_id, name, nullif(mesh_id, '') AS mesh_id, icd10_code, (SELECT count(*) FROM maps WHERE dst = disease_id AND coalesce(is_primary, true)) AS mapped_maladies FROM disease WHERE name = 'NATION_3' AND NOT coalesce(archived, false)""")
def disease_anchor(g: Graph, name: str = "NATION_3") -> DataFrame:
    """One disease by name with its ids and the number of maladies that map to it first."""
    counts = P.mapped(g).groupBy("disease_id").agg(F.count("*").alias("mapped_maladies"))
    rows = active(g.disease).where(F.col("name") == name).join(counts, "disease_id", "left")
    return rows.select("disease_id", "name", F.nullif("mesh_id", F.lit("")).alias("mesh_id"), "icd10_code", F.coalesce("mapped_maladies", F.lit(0)).alias("mapped_maladies"))


for _name, _test in (("iq15_uncanonicalised_sources", "canonical_name IS NULL"), ("iq15_uncanonicalised_sources_force", "true")):
    ENTRIES[_name] = (
        lambda g, test=_test: active(g.source).where(test).select("name", "source_document"),
        f"SELECT name, source_document FROM source WHERE NOT coalesce(archived, false) AND {_test}")


@entry("iq16_canonicalised_sources", """
SELECT name, canonical_name, canonical_part, (SELECT count(*) FROM extracted WHERE dst = source_id) + (SELECT count(*) FROM treats WHERE src = source_id) + (SELECT count(*) FROM prepared WHERE src = source_id) AS degree
FROM source WHERE NOT coalesce(archived, false) AND canonical_name IS NOT NULL""")
def canonicalised_sources(g: Graph) -> DataFrame:
    rows = active(g.source).where("canonical_name IS NOT NULL").join(P.degree(g, "source").withColumnRenamed("id", "source_id"), "source_id", "left")
    return rows.select("name", "canonical_name", "canonical_part", F.coalesce("degree", F.lit(0)).alias("degree"))


@entry("iq25_names_for_ids", "SELECT DISTINCT c.inchikey, c.name FROM compound c JOIN known k ON k.src = c.compound_id")
def names_for_ids(g: Graph) -> DataFrame:
    """Names of the compounds that a list of ids asks for (here: those with a known treatment)."""
    asked = g.known.select(F.col("src").alias("compound_id"))
    return g.compound.join(asked, "compound_id", "left_semi").select("inchikey", "name").distinct()


@entry("iq26_maladies_by_live_edges", """
SELECT s.name AS source, t.dst AS malady FROM treats t JOIN source s ON s.source_id = t.src JOIN malady m ON m.name = t.dst
WHERE NOT coalesce(s.archived, false) AND NOT coalesce(m.archived, false) AND t.dst IN (SELECT src FROM maps)""")
def maladies_by_live_edges(g: Graph) -> DataFrame:
    """Maladies of a source where neither end nor the edge is archived (an edge to an unmapped malady counts as archived)."""
    gone = g.malady.join(g.maps.select(F.col("src").alias("name")), "name", "left_anti")
    live = active(dml.cascade(g.treats, gone, "name", "dst"))
    rows = P.edge(live, "source_id", "malady").join(P.node(active(g.source), "source_id", "source_id", source="name"), "source_id")
    return rows.join(P.node(active(g.malady), "name", "malady"), "malady").select("source", "malady")


@entry("iq35_resolve_names", """
, asked AS (SELECT DISTINCT upper(name) AS said FROM compound WHERE smiles LIKE 'C1%')
SELECT a.said, min(c.compound_id) AS compound_id FROM asked a LEFT JOIN compound c ON lower(trim(c.name)) = lower(trim(a.said)) AND NOT coalesce(c.archived, false) GROUP BY a.said""")
def resolve_names(g: Graph) -> DataFrame:
    """Names as they were said, resolved to the first active compound of that name whatever its case; null where none is."""
    asked = g.compound.where("smiles LIKE 'C1%'").select(F.upper("name").alias("said")).distinct()
    mine = active(g.compound).groupBy(F.lower(F.trim("name")).alias("key")).agg(F.min("compound_id").alias("compound_id"))
    return asked.join(mine, F.lower(F.trim("said")) == F.col("key"), "left").select("said", "compound_id")


@entry("flt14_sound_activities", """
, measured AS (SELECT src, dst, pchembl, CASE WHEN src % 5 = 0 THEN '>' WHEN src % 5 = 1 THEN '' WHEN src % 5 = 2 THEN '~' WHEN src % 5 = 3 THEN NULL ELSE '=' END AS relation,
  CASE WHEN dst LIKE '%AF' THEN 'A' WHEN dst LIKE '%RF' THEN 'B' ELSE 'F' END AS assay, CASE WHEN src % 11 = 0 THEN 'outside range' WHEN src % 11 = 1 THEN '' END AS remark FROM targets)
SELECT src, dst, round(pchembl, 6) AS pchembl FROM measured WHERE assay IN ('B', 'F') AND coalesce(relation, '') IN ('', '=', '==', '~', '~=') AND coalesce(remark, '') = ''""")
def sound_activities(g: Graph) -> DataFrame:
    """Activities of the right kind of assay whose value is one and that nobody doubts."""
    i, t = F.col("src"), F.col("dst")
    relation = F.when(i % 5 == 0, ">").when(i % 5 == 1, "").when(i % 5 == 2, "~").when(i % 5 == 4, "=")
    assay = F.when(t.endswith("AF"), "A").when(t.endswith("RF"), "B").otherwise("F")
    remark = F.when(i % 11 == 0, "outside range").when(i % 11 == 1, "")
    rows = g.targets.select("src", "dst", "pchembl", relation.alias("relation"), assay.alias("assay"), remark.alias("remark"))
    return names.sound_activity(rows).select("src", "dst", F.round("pchembl", 6).alias("pchembl"))


@entry("dml16_verdict_writeback", PATH_SQL + """
SELECT t.src, t.dst, v.verdict, v.path_count FROM treats t LEFT JOIN (SELECT s.source_id, v.* FROM verdicts v JOIN source s ON s.name = v.source) v ON v.source_id = t.src AND v.malady = t.dst""")
def verdict_writeback(g: Graph) -> DataFrame:
    """Claim edges with the verdict stamped on them; edges without one keep nothing."""
    found = validate.verdicts(g).join(P.node(g.source, "name", "source", source_id="source_id"), "source").select(
        F.col("source_id").alias("src"), F.col("malady").alias("dst"), "verdict", "path_count")
    empty = g.treats.withColumn("verdict", F.lit(None).cast("string")).withColumn("path_count", F.lit(None).cast("long"))
    return dml.set_edge_properties(empty, found, ["verdict", "path_count"]).select("src", "dst", "verdict", "path_count")


@entry("dml17_nomination_audit", NOMINATE_SQL + """
SELECT d.name, coalesce(n.candidates, 0) AS candidates, coalesce(n.closed, 0) AS closed FROM disease d LEFT JOIN (SELECT disease_id, count(*) AS candidates, count(*) FILTER (has_loop_closure) AS closed FROM ranked GROUP BY disease_id) n USING (disease_id)""")
def nomination_audit(g: Graph) -> DataFrame:
    """Diseases with the size of their last nomination stamped on them."""
    counts = nominate.cards(g).where("NOT is_known").groupBy("disease_id").agg(F.count("*").alias("candidates"), F.count_if("has_loop_closure").alias("closed"))
    return g.disease.join(counts, "disease_id", "left").select("name", F.coalesce("candidates", F.lit(0)).alias("candidates"), F.coalesce("closed", F.lit(0)).alias("closed"))


@entry("au03_merged_sources", """
, grouped AS (SELECT canonical_name, canonical_part, min(source_id) AS keeper FROM source WHERE NOT coalesce(archived, false) AND canonical_name IS NOT NULL GROUP BY ALL HAVING count(*) > 1)
, merged AS (SELECT s.source_id AS old, g.keeper FROM source s JOIN grouped g USING (canonical_name, canonical_part) WHERE NOT coalesce(s.archived, false) AND s.source_id <> g.keeper)
SELECT (SELECT count(*) FROM (SELECT DISTINCT coalesce(m.keeper, t.src), t.dst FROM treats t LEFT JOIN merged m ON m.old = t.src)) AS edges, (SELECT count(*) FROM source WHERE coalesce(archived, false) OR source_id IN (SELECT old FROM merged)) AS archived,
  (SELECT count(*) FROM merged) AS merged""")
def merged_sources(g: Graph) -> DataFrame:
    """A merge carried out: edges move to the keeper of each group and fold, what was merged is archived."""
    live = active(g.source).where("canonical_name IS NOT NULL")
    keepers = live.groupBy("canonical_name", "canonical_part").agg(F.min("source_id").alias("keeper"), F.count("*").alias("n")).where("n > 1")
    merged = live.join(keepers, ["canonical_name", "canonical_part"]).where("source_id <> keeper").select(F.col("source_id").alias("old"), "keeper")
    edges = dml.retarget(g.treats, merged).agg(F.count("*").alias("edges"))
    nodes = dml.archive(g.source, merged.select(F.col("old").alias("source_id")), "source_id", "merged").agg(F.count_if(F.coalesce("archived", F.lit(False))).alias("archived"))
    return edges.crossJoin(nodes).crossJoin(merged.agg(F.count("*").alias("merged")))  # three single rows
