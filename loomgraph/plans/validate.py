"""Claim validation: path features, verdicts and what is derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import tiers as T
from loomgraph.operators import paths as P
from loomgraph.plans.registry import Registry
from loomgraph.sources.projection import Graph, active

ENTRIES = Registry()
entry = ENTRIES.entry

PATH_SQL = """
, anchor AS (
  SELECT s.source_id, s.name AS source, m.name AS malady, tt.confidence AS tt, pd.name AS primary_disease, pm.mapping_source AS primary_mapping_source
  FROM treats tt JOIN source s ON s.source_id = tt.src JOIN malady m ON m.name = tt.dst
  LEFT JOIN (maps pm JOIN disease pd ON pd.disease_id = pm.dst AND NOT coalesce(pd.archived, false) AND pm.is_primary) ON pm.src = m.name
  WHERE NOT coalesce(s.archived, false) AND NOT coalesce(m.archived, false)
), comps AS (
  SELECT mp.src AS malady, d.name AS disease FROM maps mp JOIN disease d ON d.disease_id = mp.dst
  WHERE NOT coalesce(mp.is_primary, true) AND NOT coalesce(d.archived, false)
), features AS (
  SELECT x.dst AS source_id, c.inchikey, c.name AS compound, tg.dst AS target_id, d.name AS reached_disease,
    tg.evidence_type IS NOT NULL AS has_target, r.evidence_type IS NOT NULL AS has_disease,
    round(x.confidence * coalesce(tg.confidence, 1) * coalesce(r.confidence, 1), 6) AS path_score,
    least(CASE x.evidence_type WHEN 'coconut_organism_canonical' THEN 4 WHEN 'coconut_organism_alias' THEN 3 WHEN 'pubchem_chemical_formula' THEN 2 ELSE 0 END,
      CASE tg.evidence_type WHEN 'chembl_mechanism' THEN 4 WHEN 'chembl_activity_strong' THEN 3 WHEN 'chembl_activity_moderate' THEN 2 WHEN 'chembl_activity_weak' THEN 1 END,
      CASE r.evidence_type WHEN 'ot_association_strong' THEN 4 WHEN 'ot_association_moderate' THEN 3 END) AS rank
  FROM extracted x JOIN compound c ON c.compound_id = x.src AND NOT coalesce(c.archived, false)
  LEFT JOIN targets tg ON tg.src = x.src LEFT JOIN relates r ON r.src = tg.dst LEFT JOIN disease d ON d.disease_id = r.dst
), claim_paths AS (
  SELECT a.*, f.inchikey, f.compound, f.target_id, f.reached_disease, f.has_target, f.has_disease, f.path_score, f.rank,
    coalesce(f.reached_disease = a.primary_disease, false) AS loop_closed,
    EXISTS (SELECT 1 FROM comps k WHERE k.malady = a.malady AND k.disease = f.reached_disease) AS component_closed
  FROM anchor a LEFT JOIN features f USING (source_id)
), rollup AS (
  SELECT source_id, source, malady, tt, primary_disease, primary_mapping_source, count(inchikey) AS path_count,
    count(*) FILTER (has_target) AS paths_with_target, count(*) FILTER (has_disease) AS paths_with_disease,
    count(*) FILTER (loop_closed) AS paths_loop_closed, count(*) FILTER (component_closed) AS paths_component_closed,
    count(DISTINCT inchikey) AS unique_compounds, count(DISTINCT target_id) AS unique_targets,
    count(*) FILTER (rank = 4) AS n_gold, count(*) FILTER (rank = 3) AS n_silver, count(*) FILTER (rank = 2) AS n_bronze, count(*) FILTER (rank = 1) AS n_wood,
    count(*) FILTER (rank = 0) AS n_unrated, max(rank) AS top, max(path_score) FILTER (rank = 0) AS s0, max(path_score) FILTER (rank = 4) AS s4, max(path_score) FILTER (rank = 3) AS s3, max(path_score) FILTER (rank = 2) AS s2, max(path_score) FILTER (rank = 1) AS s1
  FROM claim_paths GROUP BY ALL
), verdicts AS (
  SELECT source, malady, round(tt, 6) AS treats_confidence, primary_disease,
    CASE WHEN primary_mapping_source IS NULL THEN 'missing' WHEN primary_mapping_source = 'gemini+mesh_exact' THEN 'gold' ELSE 'silver' END AS primary_mapping_quality,
    path_count, paths_with_target, paths_with_disease, paths_loop_closed, paths_component_closed, unique_compounds, unique_targets,
    n_gold, n_silver, n_bronze, n_wood,
    CASE top WHEN 4 THEN 'gold' WHEN 3 THEN 'silver' WHEN 2 THEN 'bronze' WHEN 1 THEN 'wood' ELSE 'unrated' END AS top_bucket,
    CASE top WHEN 4 THEN n_gold WHEN 3 THEN n_silver WHEN 2 THEN n_bronze WHEN 1 THEN n_wood ELSE n_unrated END AS top_bucket_path_count,
    coalesce(CASE top WHEN 4 THEN s4 WHEN 3 THEN s3 WHEN 2 THEN s2 WHEN 1 THEN s1 ELSE s0 END, 0) AS top_bucket_max_score,
    CASE WHEN path_count = 0 THEN 'traditional_only' WHEN primary_disease IS NULL THEN 'mechanistic_only' WHEN paths_loop_closed = 0 THEN 'unsupported'
      WHEN top = 4 AND n_gold >= 2 THEN 'strong_support' WHEN top >= 3 THEN 'moderate_support' ELSE 'partial_support' END AS verdict
  FROM rollup
)
"""


def path_features(g: Graph) -> DataFrame:
    """Paths of every source with optional target and disease: tier rank (weakest edge), score and what they reach.

    Paths hang on the source alone, so they are built once a source and not once a claim.  An unknown kind of
    extraction sinks its path; unknown kinds of later edges don't count.
    """
    return _features(g, P.source_compounds(g))


def _features(g: Graph, held: DataFrame) -> DataFrame:
    comp = P.node(active(g.compound), "compound_id", "compound_id", compound="name", inchikey="inchikey")
    rel = P.target_diseases(g).join(P.node(g.disease, "disease_id", "disease_id", reached_disease="name"), "disease_id")
    rows = held.join(comp, "compound_id").join(P.compound_targets(g), "compound_id", "left").join(rel, "target_id", "left")
    rank = T.weakest(T.or_unrated(T.tier_rank(T.EX_TIER, F.col("ex_type"))), T.tier_rank(T.TGT_TIER, F.col("tgt_type")), T.tier_rank(T.REL_TIER, F.col("rel_type")))
    score = F.col("ex") * F.coalesce("tgt", F.lit(1.0)) * F.coalesce("rel", F.lit(1.0))
    return rows.select(
        "source_id", "inchikey", "compound", "target_id", "reached_disease", F.col("tgt_type").isNotNull().alias("has_target"),
        F.col("rel_type").isNotNull().alias("has_disease"), F.round(score, 6).alias("path_score"), rank.alias("rank"))


def claimed_features(g: Graph, claims: DataFrame) -> DataFrame:
    """Paths of the sources that have a claim."""
    return _features(g, P.source_compounds(g).join(claims.select("source_id"), "source_id", "left_semi"))


def anchors(g: Graph) -> DataFrame:
    """Claims with their strictly primary disease (or null) and the distinct component diseases."""
    diseases = P.node(active(g.disease), "disease_id", "disease_id", disease="name")
    first = P.mapped(g, strict=True).join(diseases, "disease_id").select(
        "malady", F.col("disease").alias("primary_disease"), F.col("mp_source").alias("primary_mapping_source"))
    parts = P.edge(g.maps.where("NOT coalesce(is_primary, true)"), "malady", "disease_id").join(diseases, "disease_id").groupBy("malady").agg(
        F.array_sort(F.collect_set("disease")).alias("component_diseases"))
    return P.claims(g).join(first, "malady", "left").join(parts, "malady", "left")


def verdicts(g: Graph) -> DataFrame:
    """One row per active claim: path counts by kind and tier, the top tier and the verdict.

    Paths are rolled up a source, and a source and reached disease, before claims meet them: only how many paths close
    a claim's loop hangs on the claim.
    """
    def count(test):
        return F.count(F.when(test, 1))

    rank, claims = F.col("rank"), anchors(g)
    rows = claimed_features(g, claims)
    whole = rows.groupBy("source_id").agg(
        F.count("inchikey").alias("path_count"), count(F.col("has_target")).alias("paths_with_target"),
        count(F.col("has_disease")).alias("paths_with_disease"), F.count_distinct("inchikey").alias("unique_compounds"),
        F.count_distinct("target_id").alias("unique_targets"), count(rank == 4).alias("n_gold"), count(rank == 3).alias("n_silver"),
        count(rank == 2).alias("n_bronze"), count(rank == 1).alias("n_wood"), count(rank == 0).alias("n_unrated"), F.max("rank").alias("top"),
        F.max(F.struct("rank", "path_score")).alias("best"))
    reached = rows.where("reached_disease IS NOT NULL").groupBy("source_id", F.col("reached_disease").alias("disease")).agg(F.count("*").alias("n"))
    key = ["source_id", "malady"]
    closed = claims.select(*key, F.col("primary_disease").alias("disease")).join(reached, ["source_id", "disease"]).select(*key, F.col("n").alias("paths_loop_closed"))
    parts = claims.select(*key, F.explode("component_diseases").alias("disease")).join(reached, ["source_id", "disease"]).groupBy(*key).agg(
        F.sum("n").alias("paths_component_closed"))
    found = claims.join(whole, "source_id", "left").join(closed, key, "left").join(parts, key, "left")
    found = found.fillna(0, [c for c in (*whole.columns, *closed.columns, *parts.columns) if c.startswith(("path", "unique", "n_"))])
    top = F.col("top")
    top_count = F.when(top == 4, F.col("n_gold")).when(top == 3, F.col("n_silver")).when(top == 2, F.col("n_bronze")).when(top == 1, F.col("n_wood")).otherwise(F.col("n_unrated"))
    source = F.col("primary_mapping_source")
    return found.select(
        "source", "malady", F.round("tt", 6).alias("treats_confidence"), "primary_disease",
        F.when(source.isNull(), "missing").otherwise(F.coalesce(T.lookup(T.MAP_QUALITY, source), F.lit("silver"))).alias("primary_mapping_quality"),
        "path_count", "paths_with_target", "paths_with_disease", "paths_loop_closed", "paths_component_closed", "unique_compounds", "unique_targets",
        "n_gold", "n_silver", "n_bronze", "n_wood", F.coalesce(T.tier_name(top), F.lit("unrated")).alias("top_bucket"),
        top_count.alias("top_bucket_path_count"), F.coalesce("best.path_score", F.lit(0.0)).alias("top_bucket_max_score"),
        T.verdict(F.col("path_count") > 0, F.col("primary_disease").isNotNull(), F.col("paths_loop_closed"), F.coalesce(top, F.lit(0)), top_count).alias("verdict"))


ENTRIES["ta02_verdicts"] = (verdicts, PATH_SQL + "SELECT * FROM verdicts")


@entry("ta01_path_features", PATH_SQL + "SELECT source_id, inchikey, target_id, reached_disease, has_target, has_disease, path_score, rank FROM features")
def features(g: Graph) -> DataFrame:
    return path_features(g).drop("compound")


@entry("ta03_verdict_summary", PATH_SQL + """
SELECT verdict, top_bucket, count(*) AS n, round(count(*) FILTER (paths_loop_closed > 0) / count(*), 3) AS loop_rate FROM verdicts GROUP BY verdict, top_bucket""")
def verdict_summary(g: Graph) -> DataFrame:
    return verdicts(g).groupBy("verdict", "top_bucket").agg(
        F.count("*").alias("n"), F.round(F.count(F.when(F.col("paths_loop_closed") > 0, 1)) / F.count("*"), 3).alias("loop_rate"))


@entry("ta04_requested_claims", PATH_SQL + """
SELECT q.source, q.malady, coalesce(v.verdict, 'claim_not_found') AS verdict, coalesce(v.path_count, 0) AS path_count
FROM (SELECT s.name AS source, t.dst AS malady FROM treats t JOIN source s ON s.source_id = t.src UNION SELECT name, 'no such malady' FROM source) q
LEFT JOIN verdicts v ON v.source = q.source AND v.malady = q.malady""")
def requested_claims(g: Graph) -> DataFrame:
    """Verdicts of asked pairs; one that is no active claim gets claim_not_found.  (Pairs: all claims, archived or not,
    and one of every source with a malady that doesn't exist.)"""
    names = P.node(g.source, "source_id", "source_id", source="name")
    asked = P.edge(g.treats, "source_id", "malady").join(names, "source_id").select("source", "malady").union(
        names.select("source", F.lit("no such malady"))).distinct()
    return asked.join(verdicts(g).select("source", "malady", "verdict", "path_count"), ["source", "malady"], "left").select(
        "source", "malady", F.coalesce("verdict", F.lit("claim_not_found")).alias("verdict"), F.coalesce("path_count", F.lit(0)).alias("path_count"))


@entry("wn01_top_paths", PATH_SQL + """
SELECT source, malady, pos, inchikey, target_id, reached_disease, path_score FROM (
  SELECT *, row_number() OVER (PARTITION BY source_id, malady ORDER BY (NOT (has_target AND has_disease)), (NOT loop_closed), rank DESC, path_score DESC,
    inchikey, target_id NULLS FIRST, reached_disease NULLS FIRST) AS pos FROM claim_paths WHERE inchikey IS NOT NULL) WHERE pos <= 5""")
def top_paths(g: Graph, keep: int = 5) -> DataFrame:
    return best_paths(g, keep).select("source", "malady", "pos", "inchikey", "target_id", "reached_disease", "path_score")


def best_paths(g: Graph, keep: int = 5) -> DataFrame:
    """The best paths of each claim: whole chains first, then closed loops, then tier and score; ties by ids.

    Whether a path closes the loop hangs on the disease it reaches, so the best of every source and reached disease
    are enough: claims meet these few and not all paths.
    """
    claims = anchors(g)
    order = [F.desc("rank"), F.desc("path_score"), F.col("inchikey"), F.asc_nulls_first("target_id"), F.asc_nulls_first("reached_disease")]
    full = (F.col("has_target") & F.col("has_disease")).alias("full")
    rows = claimed_features(g, claims).select("*", full).withColumn(
        "nth", F.row_number().over(Window.partitionBy("source_id", "full", "reached_disease").orderBy(*order))).where(F.col("nth") <= keep)
    rows = claims.select("source_id", "source", "malady", "primary_disease").join(rows, "source_id").withColumn(
        "closed", F.coalesce(F.col("reached_disease") == F.col("primary_disease"), F.lit(False)))
    best = Window.partitionBy("source_id", "malady").orderBy((~F.col("full")).cast("int"), (~F.col("closed")).cast("int"), *order)
    return rows.withColumn("pos", F.row_number().over(best)).where(F.col("pos") <= keep)


@entry("ta09_graph_only_projection", PATH_SQL + """
SELECT source, malady, round(greatest(0, least(1, (CASE top_bucket WHEN 'gold' THEN 0.85 WHEN 'silver' THEN 0.65 WHEN 'bronze' THEN 0.45 WHEN 'wood' THEN 0.25 ELSE 0.15 END
   - CASE primary_mapping_quality WHEN 'gold' THEN 0 WHEN 'silver' THEN 0.1 ELSE 0.2 END)::double)), 6) AS plausibility,
  CASE WHEN path_count = 0 THEN 0 ELSE round(paths_loop_closed / path_count, 6) END AS coherence FROM verdicts""")
def graph_only_projection(g: Graph) -> DataFrame:
    bucket = T.lookup({"gold": 0.85, "silver": 0.65, "bronze": 0.45, "wood": 0.25, "unrated": 0.15}, F.col("top_bucket"))
    penalty = T.lookup({"gold": 0.0, "silver": 0.1, "missing": 0.2}, F.col("primary_mapping_quality"))
    return verdicts(g).select(
        "source", "malady", F.round(T.clamp01(bucket - penalty), 6).alias("plausibility"),
        F.when(F.col("path_count") == 0, 0.0).otherwise(F.round(F.col("paths_loop_closed") / F.col("path_count"), 6)).alias("coherence"))


@entry("iq03_corroboration", """
SELECT s1.name AS source, tt.dst AS malady, count(DISTINCT x2.dst) AS sibling_sources, count(DISTINCT x1.src) AS shared_compounds
FROM treats tt JOIN source s1 ON s1.source_id = tt.src JOIN extracted x1 ON x1.dst = tt.src JOIN extracted x2 ON x2.src = x1.src AND x2.dst <> x1.dst
JOIN treats t2 ON t2.src = x2.dst AND t2.dst = tt.dst JOIN source s2 ON s2.source_id = x2.dst AND NOT coalesce(s2.archived, false)
GROUP BY s1.name, tt.dst""")
def corroboration(g: Graph) -> DataFrame:
    """Other active sources of the same malady that share a compound, and the compounds shared."""
    holds = P.edge(g.treats, "source_id", "malady").join(P.source_compounds(g).select("compound_id", "source_id"), "source_id")
    other = holds.withColumnRenamed("source_id", "other_id").join(active(g.source).select(F.col("source_id").alias("other_id")), "other_id", "left_semi")
    return holds.join(other, ["compound_id", "malady"]).where("source_id <> other_id").groupBy("source_id", "malady").agg(
        F.count_distinct("other_id").alias("sibling_sources"), F.count_distinct("compound_id").alias("shared_compounds")).join(
        P.node(g.source, "source_id", "source_id", source="name"), "source_id").drop("source_id")


@entry("iq04_list_claims", """
SELECT s.name AS source, m.name AS malady FROM treats tt JOIN source s ON s.source_id = tt.src JOIN malady m ON m.name = tt.dst
WHERE NOT coalesce(s.archived, false) AND NOT coalesce(m.archived, false)""")
def list_claims(g: Graph) -> DataFrame:
    return P.claims(g).select("source", "malady").orderBy("source", "malady")
