"""Queries of who is meant and why: molecules in turn, names one to one, first rows, rationales, orphans put away."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import names as N
from loomgraph.functions import provider as V
from loomgraph.functions import tiers as T
from loomgraph.operators import dml, metrics
from loomgraph.operators import paths as P
from loomgraph.operators import resolve as R
from loomgraph.plans import linkers, nominate, validate
from loomgraph.plans.registry import Registry
from loomgraph.plans.tables import read
from loomgraph.plans.validate import PATH_SQL
from loomgraph.sources.projection import Graph

ENTRIES = Registry()
entry = ENTRIES.entry
TABLES: dict = {}


def on_tables(name: str, sql: str | None):
    def keep(f):
        TABLES[name] = (f, sql)
        return f

    return keep


@entry("src15_resolved_molecules", """
, mol AS (SELECT compound_id AS id, CASE WHEN compound_id % 3 = 0 THEN inchikey END AS ik, CASE WHEN compound_id % 5 = 0 THEN smiles || '|' || (compound_id % 40) END AS smi, CASE WHEN compound_id % 7 = 0 THEN upper(name) END AS nm FROM compound)
, asked AS (SELECT compound_id, CASE WHEN compound_id % 2 = 0 THEN inchikey ELSE 'unstructured:' || inchikey END AS inchikey, CASE WHEN compound_id % 4 <> 0 THEN smiles || '|' || (compound_id % 40) ELSE '' END AS smiles, CASE WHEN compound_id % 11 = 0 THEN 'Unknown' ELSE name END AS name FROM compound)
, j AS (SELECT a.compound_id, (SELECT min(id) FROM mol WHERE ik = a.inchikey AND a.inchikey NOT LIKE 'unstructured:%') AS h1, (SELECT min(id) FROM mol WHERE smi = nullif(a.smiles, '')) AS h2, (SELECT min(id) FROM mol WHERE nm = upper(a.name) AND lower(a.name) <> 'unknown') AS h3,
    a.inchikey LIKE '%7' AND a.inchikey NOT LIKE 'unstructured:%' AS f1, a.smiles LIKE '%|13' AS f2 FROM asked a)
SELECT compound_id, coalesce(CASE WHEN NOT f1 THEN h1 END, CASE WHEN NOT f2 THEN h2 END, h3) AS record, CASE WHEN NOT f1 AND h1 IS NOT NULL THEN 'inchikey' WHEN NOT f2 AND h2 IS NOT NULL THEN 'smiles' WHEN h3 IS NOT NULL THEN 'name' ELSE 'none' END AS method,
  coalesce(CASE WHEN NOT f1 THEN h1 END, CASE WHEN NOT f2 THEN h2 END, h3) IS NOT NULL OR NOT (f1 OR f2) AS ok FROM j""")
def resolved_molecules(g: Graph) -> DataFrame:
    """Compounds looked up by structure key, then by structure, then by name; some lookups failed for now."""
    p = F.col("compound_id")
    smiles = F.concat_ws("|", "smiles", (p % 40).cast("string"))
    records = g.compound.select(
        p.alias("record_id"), F.when(p % 3 == 0, F.col("inchikey")).alias("ik"), F.when(p % 5 == 0, smiles).alias("smi"), F.when(p % 7 == 0, F.upper("name")).alias("nm"))
    asked = g.compound.select(
        p, F.when(p % 2 == 0, F.col("inchikey")).otherwise(F.concat(F.lit("unstructured:"), "inchikey")).alias("inchikey"),
        F.when(p % 4 != 0, smiles).otherwise("").alias("smiles"), F.when(p % 11 == 0, "Unknown").otherwise(F.col("name")).alias("name"))
    structured = F.when(~F.startswith("inchikey", F.lit("unstructured:")), F.col("inchikey"))
    named = F.when(F.lower("name") != "unknown", F.lower("name"))
    down = asked.where("inchikey LIKE '%7'").select(F.lit("inchikey").alias("step"), F.col("inchikey").alias("key")).union(
        asked.where("smiles LIKE '%|13'").select(F.lit("smiles").alias("step"), F.col("smiles").alias("key")))
    steps = [("inchikey", structured, F.col("ik")), ("smiles", F.col("smiles"), F.col("smi")), ("name", named, F.lower("nm"))]
    return R.resolved_in_turn(asked, records, steps, down).select("compound_id", "record", "method", "ok")


def loosely_sql(a: str, b: str) -> str:
    """The rule of loose names for names of plain lower-case words."""
    wa, wb = f"list_distinct(string_split(lower({a}), ' '))", f"list_distinct(string_split(lower({b}), ' '))"
    return (
        f"(contains(lower({a}), lower({b})) OR contains(lower({b}), lower({a})) OR len(list_intersect({wa}, {wb})) >= 2 OR (len(list_intersect({wa}, {wb})) >= 1 AND len({wa}) = 2 AND len({wb}) = 2 AND "
        f"EXISTS (SELECT 1 FROM unnest({wa}) x(x), unnest({wb}) y(y) WHERE NOT list_contains({wb}, x) AND NOT list_contains({wa}, y) AND least(length(x), length(y)) >= 4 AND levenshtein(x, y) <= 1)))")


NAMES_SQL = f"""
predicted AS (SELECT p_brand AS brand, p_name AS name, row_number() OVER (PARTITION BY p_brand ORDER BY min(p_partkey)) AS pos FROM part WHERE p_size <= 12 GROUP BY p_brand, p_name)
, gold AS (SELECT p_brand AS brand, p_name AS name, row_number() OVER (PARTITION BY p_brand ORDER BY min(p_partkey)) AS pos FROM part WHERE p_size > 40 GROUP BY p_brand, p_name)
, pairs AS (SELECT p.brand, p.pos AS p, g.pos AS g, p.name AS pn, g.name AS gn FROM predicted p JOIN gold g ON g.brand = p.brand WHERE {loosely_sql('p.name', 'g.name')})
"""


def named_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Names of small parts of each brand as predictions, names of large ones as gold, in order of their first part."""
    part = read(spark, sf_dir, "part")
    first = lambda df: df.groupBy(F.col("p_brand").alias("brand"), F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("pos"))
    return first(part.where("p_size <= 12")), first(part.where("p_size > 40"))


@on_tables("ev01_precision_recall", "WITH RECURSIVE " + NAMES_SQL + """
, wanted AS (SELECT brand, p, list(g ORDER BY g) AS wishes FROM pairs GROUP BY brand, p), sizes AS (SELECT brand, max(pos) AS n FROM predicted GROUP BY brand)
, f AS (SELECT brand, 0::bigint AS p, []::bigint[] AS taken FROM sizes UNION ALL
  SELECT f.brand, f.p + 1, CASE WHEN len(list_filter(coalesce(w.wishes, []), lambda x: NOT list_contains(f.taken, x))) > 0 THEN list_append(f.taken, list_filter(w.wishes, lambda x: NOT list_contains(f.taken, x))[1]) ELSE f.taken END
  FROM f JOIN sizes s ON s.brand = f.brand AND f.p < s.n LEFT JOIN wanted w ON w.brand = f.brand AND w.p = f.p + 1)
, tp AS (SELECT brand, max(len(taken)) AS tp FROM f GROUP BY brand), ng AS (SELECT brand, count(*) AS gold FROM gold GROUP BY brand)
SELECT coalesce(s.brand, ng.brand) AS brand, coalesce(n, 0) AS predicted, coalesce(gold, 0) AS gold, coalesce(tp, 0) AS tp, round(coalesce(tp / nullif(n, 0), 0), 6) AS precision, round(coalesce(tp / nullif(gold, 0), 0), 6) AS recall,
  round(CASE WHEN coalesce(tp, 0) > 0 THEN 2.0 * tp / (n + gold) ELSE 0 END, 6)::double AS f1 FROM sizes s FULL JOIN ng ON ng.brand = s.brand LEFT JOIN tp ON tp.brand = s.brand""")
def precision_and_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted names of each brand against its gold ones, matched loosely and one to one, each to the first that is free."""
    predicted, gold = named_parts(spark, sf_dir)
    rows = metrics.precision_recall(predicted, gold, "brand")
    return rows.select("brand", "predicted", "gold", "tp", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@on_tables("ev09_resolved_or_all", "WITH " + NAMES_SQL.replace("p_size > 40", "p_size = 48").replace("p_size <= 12", "p_size = 3") + """
, found AS (SELECT DISTINCT brand, gn AS name FROM pairs)
SELECT brand, name, false AS fell_back FROM found UNION ALL SELECT DISTINCT brand, name, true FROM gold WHERE brand NOT IN (SELECT brand FROM found)""")
def names_or_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gold names that a brand's predictions mean, and all of the brand's where they mean none."""
    part = read(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.col("p_name").alias("name"), "p_size")
    gold = part.where("p_size = 48").select("brand", "name").distinct()
    asked = part.where("p_size = 3").select("brand", F.col("name").alias("asked")).distinct()
    met = gold.join(asked, "brand").where(metrics.name_match(F.col("asked"), F.col("name")))
    return R.resolved_or_all(met.select("brand", "name"), gold, "brand", "name")


@on_tables("ag15_column_means", """
WITH r AS (SELECT d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT 'n_chars' AS column, round(avg(n_chars), 6) AS mean, count(n_chars) AS n FROM r UNION ALL SELECT 'quality', round(avg(quality), 6), count(quality) FROM r UNION ALL SELECT 'toxic', round(avg(toxic), 6), count(toxic) FROM r""")
def means_of_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of every numeric column over the rows that have a value."""
    labels = read(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return R.column_means(read(spark, sf_dir, "documents").select("doc_id", "n_chars").join(labels, "doc_id", "left").drop("doc_id"))


@entry("ag19_rank_histogram", "" + nominate.ENTRIES["ev10_held_out_recovery"][1].replace(
    "SELECT t.inchikey AS test_inchikey, t.disease AS test_disease, p.rank, p.rank IS NOT NULL AS found", ", trials AS (SELECT p.rank") + ")\nSELECT rank, count(*) AS n FROM trials GROUP BY rank")
def rank_histogram(g: Graph) -> DataFrame:
    """How often a masked pair comes back at each rank; null: not at all."""
    return nominate.held_out_recovery(g).groupBy("rank").agg(F.count("*").alias("n"))


@entry("wn09_first_by_identity", """
, k AS (SELECT compound_id, name, CASE WHEN chembl_id <> '' AND compound_id % 2 = 0 THEN '0:' || left(chembl_id, 3) WHEN smiles <> '' AND compound_id % 3 <> 0 THEN '1:' || smiles WHEN name <> '' AND compound_id % 9 <> 0 THEN '2:' || name END AS key FROM compound)
SELECT compound_id, name FROM k WHERE key IS NULL UNION ALL SELECT min(compound_id), arg_min(name, compound_id) FROM k WHERE key IS NOT NULL GROUP BY key""")
def first_by_identity(g: Graph) -> DataFrame:
    """The first compound of each id, of each structure where there is no id, of each name where there is neither."""
    p = F.col("compound_id")
    rows = g.compound.select("compound_id", "name", F.when(p % 2 == 0, F.left("chembl_id", F.lit(3))).alias("i"), F.when(p % 3 != 0, F.col("smiles")).alias("s"), F.when(p % 9 != 0, F.col("name")).alias("n"))
    return R.first_by_key(rows, [F.col("i"), F.col("s"), F.col("n")], ["compound_id"]).select("compound_id", "name")


@entry("wn10_first_places", """
, o AS (SELECT src, dst, row_number() OVER (ORDER BY confidence DESC, dst, src) AS pos FROM treats) SELECT dst AS malady, min(pos) AS place, count(*) AS n FROM o GROUP BY dst""")
def first_places(g: Graph) -> DataFrame:
    """Where each malady is first named when claims are gone through by confidence: the least key a malady, and how many
    claims come before it, counted by an inequality of sums (a claim's place is never numbered over all rows in one task)."""
    key = F.struct((-F.col("confidence")).alias("c"), F.col("dst").alias("d"), F.col("src").alias("s"))
    rows = g.treats.select("dst", key.alias("key"))
    first = rows.groupBy("dst").agg(F.min("key").alias("first"), F.count("*").alias("n"))
    # of each malady's first key the claims before it: by confidence class, then within the class
    classes = rows.groupBy(F.col("key.c").alias("c")).agg(F.count("*").alias("size"))
    before = F.coalesce(F.sum("size").over(metrics.Window.orderBy("c").rowsBetween(metrics.Window.unboundedPreceding, -1)), F.lit(0))  # as many rows as confidences
    placed = rows.join(first.select(F.col("first.c").alias("c")).distinct(), F.col("key.c") == F.col("c"), "left_semi")
    within = F.row_number().over(metrics.Window.partitionBy("key.c").orderBy("key"))
    at = placed.select("key", F.col("key.c").alias("c"), within.alias("within")).join(classes.select("c", before.alias("before")), "c")
    return first.join(at, F.col("first") == F.col("key")).select(F.col("dst").alias("malady"), (F.col("before") + F.col("within")).alias("place"), "n")


@entry("wn11_first_claims", """
SELECT s.name AS source, t.dst AS malady, round(t.confidence, 6) AS confidence FROM treats t JOIN source s ON s.source_id = t.src WHERE NOT coalesce(s.archived, false)
QUALIFY row_number() OVER (PARTITION BY t.src ORDER BY t.confidence DESC, t.dst) = 1""")
def first_claims(g: Graph) -> DataFrame:
    """The first claim of each active source by confidence."""
    best = g.treats.groupBy(F.col("src").alias("source_id")).agg(F.min(F.struct((-F.col("confidence")).alias("c"), "dst")).alias("b"))
    live = g.source.where("NOT coalesce(archived, false)").select("source_id", F.col("name").alias("source"))
    return best.join(live, "source_id").select("source", F.col("b.dst").alias("malady"), F.round(-F.col("b.c"), 6).alias("confidence"))


SIBLINGS_SQL = ", corroborated AS (" + validate.ENTRIES["iq03_corroboration"][1] + ")"
SCORE_SQL = "CAST(CAST(top_bucket_max_score AS decimal(18,6)) AS decimal(18,3))"


@entry("fn23_rationales", PATH_SQL + SIBLINGS_SQL + f"""
, said AS (SELECT v.*, list_filter([CASE WHEN c.sibling_sources > 0 THEN 'corroborated by ' || c.sibling_sources || ' sibling source(s)' END, CASE WHEN paths_component_closed > 0 THEN paths_component_closed || ' path(s) reach a syndrome component' END,
    CASE WHEN primary_mapping_quality = 'silver' THEN 'malady mapping is unverified' END], lambda x: x IS NOT NULL) AS parts FROM verdicts v LEFT JOIN corroborated c USING (source, malady))
SELECT source, malady, CASE verdict WHEN 'strong_support' THEN top_bucket_path_count || ' ' || top_bucket || '-tier path(s) close the loop on ''' || primary_disease || ''', top score ' || {SCORE_SQL} || '.'
  WHEN 'moderate_support' THEN 'Loop closes on ''' || primary_disease || ''' via ' || top_bucket || '-tier evidence (' || paths_loop_closed || ' closing path(s)).'
  WHEN 'partial_support' THEN 'Loop closes on ''' || primary_disease || ''' but only via ' || top_bucket || '-tier evidence (' || paths_loop_closed || ' closing path(s)).'
  WHEN 'unsupported' THEN path_count || ' mechanistic path(s) exist but none reach ''' || primary_disease || '''.' WHEN 'mechanistic_only' THEN path_count || ' mechanistic path(s) exist but the malady has no Modern_Disease mapping to check against.'
  WHEN 'traditional_only' THEN 'No compounds linked to this source — claim is purely traditional.' ELSE '' END || CASE WHEN len(parts) > 0 AND verdict <> 'traditional_only' THEN ' (' || array_to_string(parts, '; ') || ')' ELSE '' END AS rationale FROM said""")
def rationales(g: Graph) -> DataFrame:
    """A sentence for each claim that says what its verdict rests on."""
    siblings = validate.corroboration(g).select("source", "malady", "sibling_sources")
    rows = validate.verdicts(g).join(siblings, ["source", "malady"], "left")
    return rows.select("source", "malady", R.rationale(F.coalesce("sibling_sources", F.lit(0))).alias("rationale"))


ORPHAN_SQL = linkers.ENTRIES["rev01_orphan_plan"][1].rpartition("\nSELECT o.name")
APPLIED_SQL = ORPHAN_SQL[0] + ", plan AS (SELECT o.name" + ORPHAN_SQL[2] + """), gone AS (SELECT orphan FROM plan WHERE keeper IS NOT NULL AND orphan IN (SELECT name FROM malady WHERE NOT coalesce(archived, false)))
"""


@entry("rev01_orphans_applied", APPLIED_SQL + """
SELECT m.name, coalesce(m.archived, false) OR m.name IN (SELECT orphan FROM gone) AS archived, CASE WHEN m.name IN (SELECT orphan FROM gone) THEN 'orphan' ELSE m.archive_reason END AS archive_reason,
  CASE WHEN m.name IN (SELECT orphan FROM gone) THEN (SELECT count(*) FROM maps WHERE src = m.name) ELSE 0 END AS edges FROM malady m""")
def orphans_applied(g: Graph) -> DataFrame:
    """Maladies after the plan: orphans that have a keeper are put away with their mappings; done again it changes nothing."""
    gone = _actionable(g)
    nodes = dml.archive(g.malady, gone, "name", "orphan")
    edges = g.maps.join(gone.select(F.col("name").alias("src")), "src", "left_semi").groupBy(F.col("src").alias("name")).agg(F.count("*").alias("edges"))
    return nodes.join(edges, "name", "left").select("name", F.coalesce("archived", F.lit(False)).alias("archived"), "archive_reason", F.coalesce("edges", F.lit(0)).alias("edges"))


def _actionable(g: Graph) -> DataFrame:
    plan = linkers.orphan_plan(g).where("keeper IS NOT NULL").select(F.col("orphan").alias("name"))
    return plan.join(g.malady.where("NOT coalesce(archived, false)").select("name"), "name", "left_semi")


@entry("rev01_orphan_summary", APPLIED_SQL + """
SELECT (SELECT count(*) FROM plan) AS orphans_total, (SELECT count(*) FROM plan WHERE keeper IS NOT NULL) AS actionable, (SELECT count(*) FROM gone) AS applied, (SELECT count(*) FROM plan WHERE keeper IS NULL) AS no_keeper,
  (SELECT count(*) FROM maps WHERE src IN (SELECT orphan FROM gone)) AS edges_cascaded""")
def orphan_summary(g: Graph) -> DataFrame:
    """How many orphans there are, how many were put away, and how many mappings with them."""
    plan = linkers.orphan_plan(g).agg(F.count("*").alias("orphans_total"), F.count("keeper").alias("actionable"), F.count_if(F.col("keeper").isNull()).alias("no_keeper"))
    gone = _actionable(g)
    applied = gone.agg(F.count("*").alias("applied"))
    edges = g.maps.join(gone.select(F.col("name").alias("src")), "src", "left_semi").agg(F.count("*").alias("edges_cascaded"))
    return reduce(lambda a, b: a.crossJoin(b), [plan, applied, edges])  # single rows


@entry("au01_canonical_records", """
, a AS (SELECT name, CASE WHEN source_id % 8 = 0 THEN ' ' WHEN source_id % 3 = 0 THEN ' ' || (SELECT substr(min(p_name), 1 + source_id % 4) FROM part WHERE p_partkey = source_id) || ' ' ELSE (SELECT upper(min(p_name)) FROM part WHERE p_partkey = source_id * 2) || ' x' END AS canonical,
    CASE source_id % 5 WHEN 0 THEN 'chemical' WHEN 4 THEN 'mineral' ELSE 'organism' END AS kind, CASE WHEN source_id % 2 = 0 THEN ' Root ' END AS part, source_id % 17 = 0 AS failed FROM source)
, t AS (SELECT name, trim(canonical) AS canonical, kind, part, failed, lower(trim(canonical)) AS key FROM a)
, organisms AS (SELECT DISTINCT lower(name) AS n FROM compound WHERE compound_id % 3 = 0), chemicals AS (SELECT DISTINCT lower(name) AS n FROM compound WHERE compound_id % 2 = 0)
, r AS (SELECT *, CASE WHEN failed THEN 'error' WHEN kind IN ('organism', 'chemical') AND canonical <> '' THEN kind ELSE 'uncanonicalized' END AS type FROM t)
SELECT name, CASE WHEN failed THEN '' ELSE canonical END AS canonical_raw, type AS canonical_type, CASE WHEN type IN ('organism', 'chemical') THEN canonical END AS canonical_name,
  CASE WHEN type = 'organism' THEN coalesce(nullif(lower(trim(part)), ''), 'whole') ELSE '' END AS canonical_part,
  CASE type WHEN 'organism' THEN CASE WHEN EXISTS (SELECT 1 FROM organisms WHERE contains(n, key)) THEN 'gemini+coconut' ELSE 'gemini_unverified_organism' END
    WHEN 'chemical' THEN CASE WHEN key IN (SELECT n FROM chemicals) THEN 'gemini+pubchem' ELSE 'gemini_unverified_chemical' END ELSE type END AS canonical_source FROM r""")
def canonical_sources(g: Graph) -> DataFrame:
    """Sources as an answer names them, confirmed by an index of organisms or of chemicals; answers come as a table."""
    s = F.col("source_id")
    own = g.compound.select(F.col("compound_id").alias("own_id"), F.col("name").alias("own"))
    other = g.compound.select(F.col("compound_id").alias("other_id"), F.col("name").alias("other"))
    rows = g.source.join(own, s == F.col("own_id"), "left").join(other, s * 2 == F.col("other_id"), "left")
    canonical = F.when(s % 8 == 0, " ").when(s % 3 == 0, F.concat(F.lit(" "), F.substring(F.col("own"), (1 + s % 4).cast("int"), F.lit(1000)), F.lit(" "))).otherwise(F.concat(F.upper("other"), F.lit(" x")))
    kind = F.when(s % 5 == 0, "chemical").when(s % 5 == 4, "mineral").otherwise("organism")
    answers = rows.select("name", canonical.alias("canonical"), kind.alias("kind"), F.when(s % 2 == 0, " Root ").alias("part"), (s % 17 == 0).alias("failed"))
    p = F.col("compound_id")
    return R.canonical_records(answers, g.compound.where(p % 3 == 0).select("name"), g.compound.where(p % 2 == 0).select("name"))


def payloads(g: Graph, keep: int = 5) -> DataFrame:
    """(source, malady, paths_top, context): what is known of each claim as nested structs, whole, for consumers that read it
    as JSON: its best paths with what they rest on, and the nodes and edges that it hangs on."""
    disease = F.col("reached_disease")
    rows = validate.best_paths(g, keep).join(validate.anchors(g).select("source_id", "malady", "component_diseases"), ["source_id", "malady"])
    part = F.coalesce(F.array_contains("component_diseases", disease), F.lit(False))
    bucket = F.coalesce(T.tier_name(F.col("rank")), F.lit("unrated"))
    path = F.struct(
        F.col("pos"), F.col("inchikey"), F.col("compound"), F.col("target_id").alias("target"), disease,
        F.struct(bucket.alias("bucket"), F.col("path_score").alias("score"), F.col("closed").alias("loop_closed"), part.alias("component_closed"), "has_target", "has_disease").alias("path"))
    paths = rows.groupBy("source", "malady").agg(F.array_sort(F.collect_list(F.when(F.col("inchikey").isNotNull(), path))).alias("paths_top"))
    source = g.source.select("source_id", F.struct("name", "source_document", "canonical_name", "canonical_part", "canonical_type", "canonical_source").alias("source_node"))
    malady = g.malady.select(F.col("name").alias("malady"), F.struct("name", "description", "source_document").alias("malady_node"))
    first = g.disease.select(F.col("name").alias("primary_disease"), F.struct("name", "icd10_code", "mesh_id").alias("disease_node"))
    claims = validate.anchors(g).join(source, "source_id").join(malady, "malady").join(first, "primary_disease", "left")
    context = F.struct(
        F.col("source_node").alias("source"), F.col("malady_node").alias("malady"), F.struct(F.col("tt").alias("confidence_score")).alias("treats_edge"),
        F.col("disease_node").alias("primary_disease"), F.struct(F.col("primary_mapping_source").alias("mapping_source")).alias("primary_mapping"))
    return claims.select("source", "malady", context.alias("context")).join(paths, ["source", "malady"], "left").select(
        "source", "malady", F.coalesce("paths_top", F.array().cast(paths.schema["paths_top"].dataType)).alias("paths_top"), "context")


@entry("ta05_claim_payloads", PATH_SQL + """
, tops AS (SELECT *, row_number() OVER (PARTITION BY source_id, malady ORDER BY (NOT (has_target AND has_disease)), (NOT loop_closed), rank DESC, path_score DESC, inchikey, target_id NULLS FIRST, reached_disease NULLS FIRST) AS pos FROM claim_paths WHERE inchikey IS NOT NULL)
, p AS (SELECT source, malady, count(*) AS n, string_agg(concat_ws('|', inchikey, compound, coalesce(target_id, '-'), coalesce(reached_disease, '-'), CASE rank WHEN 4 THEN 'gold' WHEN 3 THEN 'silver' WHEN 2 THEN 'bronze' WHEN 1 THEN 'wood' ELSE 'unrated' END,
    CAST(round(path_score * 1000000) AS bigint), loop_closed, component_closed, has_target, has_disease), ';' ORDER BY pos) AS paths FROM tops WHERE pos <= 5 GROUP BY source, malady)
SELECT a.source, a.malady, coalesce(p.n, 0) AS paths, md5(coalesce(p.paths, '')) AS path_digest, concat_ws('|', s.source_document, s.canonical_name, s.canonical_part, s.canonical_type, s.canonical_source, m.description, m.source_document,
  CAST(round(a.tt * 1000000) AS bigint), coalesce(a.primary_disease, '-'), coalesce(d.icd10_code, '-'), coalesce(d.mesh_id, '-'), coalesce(a.primary_mapping_source, '-')) AS context
FROM anchor a JOIN source s ON s.source_id = a.source_id JOIN malady m ON m.name = a.malady LEFT JOIN disease d ON d.name = a.primary_disease LEFT JOIN p ON p.source = a.source AND p.malady = a.malady""")
def claim_payloads(g: Graph) -> DataFrame:
    """The payload of each claim, whole: its paths by their digest, its context as one text."""
    text = lambda c: c.cast("string")
    known = lambda c: F.coalesce(F.col(c), F.lit("-"))
    line = lambda x: F.concat_ws(
        "|", x["inchikey"], x["compound"], F.coalesce(x["target"], F.lit("-")), F.coalesce(x["reached_disease"], F.lit("-")), x["path"]["bucket"], text(P.micro(x["path"]["score"])),
        *(text(x["path"][c]) for c in ("loop_closed", "component_closed", "has_target", "has_disease")))
    context = F.concat_ws(
        "|", *(f"context.source.{c}" for c in ("source_document", "canonical_name", "canonical_part", "canonical_type", "canonical_source")), "context.malady.description", "context.malady.source_document",
        text(P.micro(F.col("context.treats_edge.confidence_score"))), known("context.primary_disease.name"), known("context.primary_disease.icd10_code"), known("context.primary_disease.mesh_id"), known("context.primary_mapping.mapping_source"))
    return payloads(g).select(
        "source", "malady", F.size("paths_top").cast("long").alias("paths"), F.md5(F.array_join(F.transform("paths_top", line), ";").cast("binary")).alias("path_digest"), context.alias("context"))


@entry("lk05_target_identities", """
SELECT target_id, target_type, 'n ' || coalesce(name, '') AS target_name, CASE WHEN target_type = 'SINGLE PROTEIN' THEN coalesce(uniprot_id, '') ELSE '' END AS uniprot_id,
  CASE WHEN target_type = 'SINGLE PROTEIN' AND length(target_id) % 2 = 1 THEN 'G' || substr(target_id, 7) ELSE '' END AS gene_symbol, CASE WHEN target_type = 'ORGANISM' THEN (9000 + length(target_id))::varchar ELSE '' END AS ncbi_tax_id,
  uniprot_id || ';' || 'P' || substr(target_id, 7) AS accessions FROM target""")
def target_identities(g: Graph) -> DataFrame:
    """Who each target is, from its record as the provider's JSON has it."""
    syn = lambda kind, value: F.struct(F.lit(kind).alias("syn_type"), value.alias("component_synonym"))
    own = F.substring("target_id", 7, 100)
    symbol = F.when(F.length("target_id") % 2 == 1, F.concat(F.lit("G"), own))
    named = F.array_compact(F.array(syn("UNIPROT", F.col("name")), F.when(symbol.isNotNull(), syn("GENE_SYMBOL", symbol)), syn("EC_NUMBER", F.lit("1.1")), F.when(symbol.isNotNull(), syn("GENE_SYMBOL", F.lit("later")))))
    component = lambda accession: F.struct(accession.alias("accession"), named.alias("target_component_synonyms"))
    other = F.concat(F.lit("P"), own)
    record = F.to_json(F.struct(
        F.col("target_id").alias("target_chembl_id"), "target_type", F.concat(F.lit("n "), F.coalesce("name", F.lit(""))).alias("pref_name"), (9000 + F.length("target_id")).alias("tax_id"),
        F.array(component(F.col("uniprot_id")), component(other), component(F.col("uniprot_id")), component(F.lit(""))).alias("target_components")))
    parsed = g.target.select("target_id", F.from_json(record, V.TARGET_RECORD).alias("r"))
    return parsed.select("target_id", V.target_identity(F.col("r")).alias("i"), F.array_join(V.accessions(F.col("r")), ";").alias("accessions")).select(
        "target_id", "i.target_type", "i.target_name", "i.uniprot_id", "i.gene_symbol", "i.ncbi_tax_id", "accessions")


@entry("jn13_synonym_tier", """
, asked AS (SELECT n_nationkey AS q, CASE WHEN n_nationkey % 4 = 0 THEN 'D' || n_nationkey END AS mesh, CASE WHEN n_nationkey % 3 = 0 THEN n_name ELSE 'old ' || n_name END AS name,
    CASE n_nationkey % 5 WHEN 0 THEN [] WHEN 1 THEN ['nowhere'] ELSE ['', 'nothing', 'NOTHING', lower(n_name), (SELECT min(n_name) FROM nation b WHERE b.n_nationkey = a.n_nationkey + 1), upper(n_name)] END AS synonyms FROM nation a)
, live AS (SELECT * FROM disease WHERE NOT coalesce(archived, false)), ids AS (SELECT mesh_id, min(name) AS name FROM live WHERE mesh_id <> '' GROUP BY 1), forms AS (SELECT lower(name) AS form, min(name) AS name FROM live GROUP BY 1)
, s AS (SELECT q, unnest(synonyms) AS term, generate_subscripts(synonyms, 1) AS pos FROM asked), syn AS (SELECT q, arg_min(f.name, pos) AS name FROM s JOIN forms f ON f.form = lower(term) GROUP BY q)
SELECT a.q, coalesce(i.name, f.name, y.name) AS disease, CASE WHEN i.name IS NOT NULL THEN 'mesh_id' WHEN f.name IS NOT NULL THEN 'norm_name' WHEN y.name IS NOT NULL THEN 'mesh_synonym' ELSE 'no_match' END AS tier
FROM asked a LEFT JOIN ids i ON i.mesh_id = a.mesh LEFT JOIN forms f ON f.form = lower(a.name) LEFT JOIN syn y ON y.q = a.q""")
def synonym_tier(g: Graph) -> DataFrame:
    """Outside records matched to diseases by id, then by tolerant name, then by the first of their synonyms that names one."""
    n = F.col("disease_id")
    after = g.disease.select((n - 1).alias("disease_id"), F.col("name").alias("after"))
    rows = g.disease.select("disease_id", "name").join(after, "disease_id", "left")
    terms = F.when(n % 5 == 0, F.array().cast("array<string>")).when(n % 5 == 1, F.array(F.lit("nowhere"))).otherwise(
        F.array(F.lit(""), F.lit("nothing"), F.lit("NOTHING"), F.lower("name"), F.col("after"), F.upper("name")))
    asked = rows.select(
        n.alias("q"), F.when(n % 4 == 0, F.concat(F.lit("D"), n.cast("string"))).alias("mesh"), F.when(n % 3 == 0, F.col("name")).otherwise(F.concat(F.lit("old "), "name")).alias("asked"),
        V.distinct_terms(terms).alias("synonyms"))
    live = g.disease.where("NOT coalesce(archived, false)")
    ids = live.where("mesh_id <> ''").groupBy(F.col("mesh_id").alias("mesh")).agg(F.min("name").alias("by_id"))
    forms = live.groupBy(N.match_form(F.col("name")).alias("form")).agg(F.min("name").alias("found"))
    by_term = asked.select("q", F.posexplode("synonyms").alias("pos", "term")).select("q", "pos", N.match_form(F.col("term")).alias("form")).where("form <> ''").join(forms, "form")
    first = by_term.groupBy("q").agg(F.min_by("found", "pos").alias("by_synonym"))
    met = asked.withColumn("form", N.match_form(F.col("asked"))).join(ids, "mesh", "left").join(forms.withColumnRenamed("found", "by_name"), "form", "left").join(first, "q", "left")
    tier = F.when(F.col("by_id").isNotNull(), "mesh_id").when(F.col("by_name").isNotNull(), "norm_name").when(F.col("by_synonym").isNotNull(), "mesh_synonym").otherwise("no_match")
    return met.select("q", F.coalesce("by_id", "by_name", "by_synonym").alias("disease"), tier.alias("tier"))
