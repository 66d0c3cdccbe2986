"""Linking, review and sampling plans: caps, gates, elections, strata, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.functions import names as N
from loomgraph.operators import paths as P
from loomgraph.operators import text
from loomgraph.plans import nominate, validate
from loomgraph.plans.nominate import NOMINATE_SQL
from loomgraph.plans.registry import Registry
from loomgraph.plans.tables import read
from loomgraph.plans.validate import PATH_SQL
from loomgraph.sources.projection import Graph, active
from loomgraph.sources.snapshots import stored

ENTRIES = Registry()
entry = ENTRIES.entry
TABLES: dict = {}


def on_tables(name: str, sql: str | None):
    def keep(f):
        TABLES[name] = (f, sql)
        return f

    return keep


@entry("lk03_target_assembly", """
SELECT src, uniprot_id, dst, round(pchembl, 6) AS pchembl FROM (SELECT tg.src, t.uniprot_id, tg.dst, tg.pchembl,
  row_number() OVER (PARTITION BY tg.src, t.uniprot_id ORDER BY CASE WHEN tg.evidence_type = 'chembl_mechanism' THEN 0 ELSE 1 END, tg.pchembl DESC, tg.dst) AS nth
  FROM targets tg JOIN target t ON t.target_id = tg.dst) WHERE nth = 1""")
def target_assembly(g: Graph) -> DataFrame:
    """One edge a compound and protein: a mechanism covers it, else its most potent activity."""
    rows = P.compound_targets(g).join(P.node(g.target, "target_id", "target_id", uniprot_id="uniprot_id"), "target_id")
    mechanism = F.when(F.col("tgt_type") == "chembl_mechanism", 0).otherwise(1)
    best = rows.groupBy("compound_id", "uniprot_id").agg(F.min(F.struct(mechanism.alias("m"), (-F.col("pchembl")).alias("p"), F.col("target_id").alias("t"))).alias("b"))
    return best.select(F.col("compound_id").alias("src"), "uniprot_id", F.col("b.t").alias("dst"), F.round(-F.col("b.p"), 6).alias("pchembl"))


@entry("wn05_target_cap", """
SELECT src, count(*) FILTER (nth <= 20) AS kept, count(*) FILTER (nth > 20) AS dropped, string_agg(dst, ';' ORDER BY nth) FILTER (nth <= 20) AS targets FROM (SELECT src, dst,
  row_number() OVER (PARTITION BY src ORDER BY CASE WHEN evidence_type = 'chembl_mechanism' THEN 0 ELSE 1 END, pchembl DESC, dst) AS nth FROM targets) GROUP BY src""")
def target_cap(g: Graph, most: int = 20) -> DataFrame:
    """The first targets of a compound, mechanisms before potency, and how many fall off."""
    order = Window.partitionBy("compound_id").orderBy(F.when(F.col("tgt_type") == "chembl_mechanism", 0).otherwise(1), F.desc("pchembl"), "target_id")
    rows = P.compound_targets(g).withColumn("nth", F.row_number().over(order))
    first = F.when(F.col("nth") <= most, F.struct("nth", "target_id"))
    return rows.groupBy(F.col("compound_id").alias("src")).agg(
        F.count_if(F.col("nth") <= most).alias("kept"), F.count_if(F.col("nth") > most).alias("dropped"),
        F.array_join(F.transform(F.array_sort(F.collect_list(first)), lambda x: x["target_id"]), ";").alias("targets"))


@entry("lk08_indication_status", """
SELECT c.inchikey, CASE WHEN count(k.dst) FILTER (k.clinical_phase >= 2 AND NOT coalesce(d.archived, false)) > 0 THEN 'linked' ELSE 'no_indications_found' END AS status,
  count(k.dst) FILTER (k.clinical_phase >= 2 AND NOT coalesce(d.archived, false)) AS linked, count(k.dst) FILTER (k.clinical_phase < 2 OR coalesce(d.archived, false)) AS dropped
FROM compound c LEFT JOIN known k ON k.src = c.compound_id LEFT JOIN disease d ON d.disease_id = k.dst WHERE NOT coalesce(c.archived, false) AND c.chembl_id <> '' GROUP BY c.inchikey""")
def indication_status(g: Graph, least_phase: int = 2) -> DataFrame:
    """Status of each compound after linking: indications of a late enough phase to active diseases count."""
    rows = P.edge(g.known, "compound_id", "disease_id", phase="clinical_phase").join(g.disease.select("disease_id", F.coalesce("archived", F.lit(False)).alias("gone")), "disease_id")
    ok = (F.col("phase") >= least_phase) & ~F.col("gone")
    counts = rows.groupBy("compound_id").agg(F.count_if(ok).alias("linked"), F.count_if(~ok).alias("dropped"))
    wanted = active(g.compound).where("chembl_id <> ''").select("compound_id", "inchikey").join(counts, "compound_id", "left")
    linked = F.coalesce("linked", F.lit(0))
    return wanted.select("inchikey", F.when(linked > 0, "linked").otherwise("no_indications_found").alias("status"), linked.alias("linked"), F.coalesce("dropped", F.lit(0)).alias("dropped"))


@entry("lk17_mapping_selection", """
SELECT src AS malady, d.name AS disease, row_number() OVER (PARTITION BY src ORDER BY rank) AS new_rank, CASE WHEN rank = 1 THEN 'primary' ELSE 'component' END AS role
FROM maps JOIN disease d ON d.disease_id = dst WHERE rank = 1 OR (rank <= 3 AND coalesce(d.mesh_id, '') <> '')""")
def mapping_selection(g: Graph, components: int = 2) -> DataFrame:
    """A malady's primary disease and at most two components that carry an id, ranked anew."""
    rows = P.edge(g.maps, "malady", "disease_id", rank="rank").join(P.node(g.disease, "disease_id", "disease_id", disease="name", mesh="mesh_id"), "disease_id")
    kept = rows.where((F.col("rank") == 1) | ((F.col("rank") <= components + 1) & (F.coalesce("mesh", F.lit("")) != "")))
    return kept.select(
        "malady", "disease", F.row_number().over(Window.partitionBy("malady").orderBy("rank")).alias("new_rank"),
        F.when(F.col("rank") == 1, "primary").otherwise("component").alias("role"))


@entry("rev01_orphan_plan", """
, pd AS (SELECT mp.src AS malady, mp.dst AS disease_id FROM maps mp WHERE coalesce(mp.is_primary, true))
, deg AS (SELECT name, (SELECT count(*) FROM treats WHERE dst = name) AS treats_in FROM malady)
, orphan AS (SELECT m.name, pd.disease_id FROM malady m LEFT JOIN pd ON pd.malady = m.name WHERE m.name NOT IN (SELECT tt.dst FROM treats tt JOIN source s ON s.source_id = tt.src WHERE s.archive_reason = 'orphan'))
SELECT o.name AS orphan, (SELECT arg_min(p2.malady, (-g.treats_in, p2.malady)) FROM pd p2 JOIN deg g ON g.name = p2.malady WHERE p2.disease_id = o.disease_id AND p2.malady <> o.name) AS keeper FROM orphan o""")
def orphan_plan(g: Graph) -> DataFrame:
    """Maladies without claims of the sources that were set aside as orphans, and the sibling of the same disease with
    most claims."""
    aside = g.source.where("archive_reason = 'orphan'").select(F.col("source_id").alias("src"))
    claimed = g.treats.join(aside, "src", "left_semi").select(F.col("dst").alias("name"))
    orphans = g.malady.join(claimed, "name", "left_anti").select(F.col("name").alias("malady"))
    pairs = P.mapped(g).select("malady", "disease_id")
    counts = g.treats.groupBy(F.col("dst").alias("sibling")).agg(F.count("*").alias("n"))
    siblings = pairs.withColumnRenamed("malady", "sibling").join(counts, "sibling", "left")
    met = orphans.join(pairs, "malady").join(siblings, "disease_id").where("malady <> sibling")
    best = met.groupBy("malady").agg(F.min(F.struct((-F.coalesce("n", F.lit(0))).alias("a"), "sibling")).alias("b"))
    return orphans.join(best, "malady", "left").select(F.col("malady").alias("orphan"), F.col("b.sibling").alias("keeper"))


@entry("ag08_status_counts", """
SELECT s.status, count(t.linker_status) AS n FROM (VALUES ('linked'), ('error'), ('no_compounds_found'), ('skipped_uncanonicalized')) s(status) LEFT JOIN source t ON t.linker_status = s.status GROUP BY s.status""")
def status_counts(g: Graph) -> DataFrame:
    """Counts by status with a row for each known status, also where none has it."""
    known = F.array(*map(F.lit, ("linked", "error", "no_compounds_found", "skipped_uncanonicalized")))
    seen = g.source.where("linker_status IS NOT NULL").groupBy(F.col("linker_status").alias("status")).agg(F.count("*").alias("n"))
    return g.source.sparkSession.range(1).select(F.explode(known).alias("status")).join(seen, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


# fixed values: strata of the sample in their order, what puts a claim into one, and how many are drawn
STRATA = [
    ("unsupported_actionable", "verdict = 'unsupported' AND path_count > 0", 8), ("strong_support", "verdict = 'strong_support'", 8),
    ("gold_no_loop_closure", "top_bucket = 'gold' AND paths_loop_closed = 0", 8), ("mechanistic_only", "verdict = 'mechanistic_only'", 4),
    ("traditional_only", "verdict = 'traditional_only'", 2),
]
STRATA_SQL = ", keyed AS (SELECT *, md5('11|' || source || '|' || malady) AS h FROM verdicts)" + "".join(
    f"\n, s{i} AS (SELECT '{name}' AS stratum, source, malady FROM (SELECT *, row_number() OVER (ORDER BY h) AS nth FROM keyed WHERE ({test})"
    + "".join(f" AND (source, malady) NOT IN (SELECT (source, malady) FROM s{j})" for j in range(i)) + f") WHERE nth <= {n})"
    for i, (name, test, n) in enumerate(STRATA)) + "\n, sampled AS (" + " UNION ALL ".join(f"SELECT * FROM s{i}" for i in range(len(STRATA))) + ")\n"


@entry("wn13_stratified_claims", PATH_SQL + STRATA_SQL + "SELECT stratum, source, malady FROM sampled")
def stratified_claims(g: Graph, seed: str = "11") -> DataFrame:
    """A seeded sample of claims, stratum after stratum: who was drawn for one is out, who was not stays for the next.

    Each stratum is a top-n of what the earlier ones left; the few keys that were drawn are all that is kept of them.
    """
    spark, order = g.source.sparkSession, F.md5(F.concat_ws("|", F.lit(seed), "source", "malady").cast("binary"))
    rows = stored(validate.verdicts(g).select("source", "malady", "verdict", "path_count", "top_bucket", "paths_loop_closed", order.alias("h")), "verdicts")
    schema, drawn = "stratum string, source string, malady string", []
    for name, test, n in STRATA:
        taken = spark.createDataFrame(drawn, schema)
        left = rows.where(test).join(F.broadcast(taken), ["source", "malady"], "left_anti")
        drawn += [(name, r.source, r.malady) for r in left.orderBy("h").limit(n).collect()]
    return spark.createDataFrame(drawn, schema)


@entry("tb02_known_treats_split", NOMINATE_SQL + """
, kt AS (SELECT src, count(*) AS n FROM known GROUP BY src)
SELECT c.disease, c.inchikey, c.is_known AS known_here, coalesce(kt.n, 0) - CASE WHEN c.is_known THEN 1 ELSE 0 END AS known_elsewhere FROM cards c LEFT JOIN kt ON kt.src = c.compound_id""")
def known_treats_split(g: Graph) -> DataFrame:
    total = g.known.groupBy(F.col("src").alias("compound_id")).agg(F.count("*").alias("total"))
    return nominate.cards(g).join(total, "compound_id", "left").select(
        "disease", "inchikey", F.col("is_known").alias("known_here"), (F.coalesce("total", F.lit(0)) - F.col("is_known").cast("int")).alias("known_elsewhere"))


@entry("tb03_rerank", NOMINATE_SQL + """
, asked AS (SELECT disease_id, disease, inchikey, 1001 - rank AS wish FROM ranked WHERE rank <= 10 UNION ALL SELECT disease_id, disease, 'unknown', 0 FROM ranked WHERE rank = 1)
SELECT disease, inchikey, row_number() OVER (PARTITION BY disease_id ORDER BY wish, inchikey) AS new_rank FROM (SELECT a.disease_id, a.disease, a.inchikey, min(wish) AS wish FROM asked a JOIN compound c ON c.inchikey = a.inchikey GROUP BY ALL)""")
def rerank(g: Graph) -> DataFrame:
    """An outside order of the first ten joined back: unknown and repeated ids go, ranks start anew."""
    first = nominate.ranked(g).where("rank <= 10")
    asked = first.select("disease", "inchikey", (1001 - F.col("rank")).alias("wish")).unionByName(
        first.where("rank = 1").select("disease", F.lit("unknown").alias("inchikey"), F.lit(0).alias("wish")))
    known = asked.join(g.compound.select("inchikey"), "inchikey", "left_semi").groupBy("disease", "inchikey").agg(F.min("wish").alias("wish"))
    return known.select("disease", "inchikey", F.row_number().over(Window.partitionBy("disease").orderBy("wish", "inchikey")).alias("new_rank"))


@entry("st02_key_sets", """
, a AS (SELECT src FROM extracted), b AS (SELECT src FROM targets)
SELECT 'both' AS part, count(*) AS n FROM (SELECT src FROM a INTERSECT SELECT src FROM b) UNION ALL SELECT 'only_extracted', count(*) FROM (SELECT src FROM a EXCEPT SELECT src FROM b)
UNION ALL SELECT 'either', count(*) FROM (SELECT src FROM a UNION SELECT src FROM b)""")
def key_sets(g: Graph) -> DataFrame:
    """Intersection, difference and union of two key sets from one pass over their flags."""
    flags = g.extracted.select("src", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(g.targets.select("src", F.lit(0).alias("a"), F.lit(1).alias("b")))
    keys = flags.groupBy("src").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    one = keys.agg(F.count_if((F.col("a") == 1) & (F.col("b") == 1)).alias("both"), F.count_if((F.col("a") == 1) & (F.col("b") == 0)).alias("only_extracted"), F.count("*").alias("either"))
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("part"), F.col(c).alias("n")) for c in one.columns])).alias("p")).select("p.part", "p.n")


@on_tables("ag14_slices", """
SELECT slice, key, count(*) AS n, round(avg(quality), 3) AS quality_rate, round(avg(toxic), 3) AS toxic_rate FROM (
  SELECT 'lang' AS slice, lang AS key, quality, toxic FROM documents JOIN labels USING (doc_id) UNION ALL SELECT 'source', source, quality, toxic FROM documents JOIN labels USING (doc_id)) GROUP BY slice, key""")
def slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label rates by several slices from one scan."""
    rows = read(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(read(spark, sf_dir, "labels"), "doc_id")
    keys = F.explode(F.array(*[F.struct(F.lit(c).alias("slice"), F.col(c).alias("key")) for c in ("lang", "source")]))
    return rows.select("quality", "toxic", keys.alias("k")).groupBy("k.slice", "k.key").agg(
        F.count("*").alias("n"), F.round(F.avg("quality"), 3).alias("quality_rate"), F.round(F.avg("toxic"), 3).alias("toxic_rate"))


@on_tables("wn15_char_budget", """
SELECT source, count(*) AS kept, sum(n_chars) AS chars FROM (SELECT source, n_chars, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS running FROM documents) WHERE running <= 20000 GROUP BY source""")
def char_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return text.within_budget(rows, "source", "doc_id", "n_chars", 20_000).groupBy("source").agg(F.count("*").alias("kept"), F.sum("n_chars").alias("chars"))


@on_tables("ev21_resume_residue", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases without a result yet."""
    return read(spark, sf_dir, "documents").select("doc_id", "lang").join(read(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@on_tables("fn05_plain_names", r"""
SELECT DISTINCT p_name AS name, array_to_string(list_filter(string_split(lower(p_name), ' '), lambda x: x <> ''), ' ') AS plain,
  CASE WHEN len(string_split(p_name, ' ')) >= 2 THEN array_to_string(string_split(lower(p_name), ' ')[1:2], ' ') END AS two, 'unstructured:' || replace(lower(p_name), ' ', '_') AS key FROM part""")
def plain_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("name")
    return read(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct().select(
        "name", N.plain_name(name).alias("plain"), N.genus_species(name).alias("two"), N.unstructured_key(name).alias("key"))


@on_tables("fn36_text_shapes", r"""
SELECT doc_id, len(regexp_extract_all(text, '[A-Z][a-z]+ [a-z]+')) AS binomials, len(regexp_extract_all(text, '[.!?]')) AS ends, regexp_matches(text, 'icen[cs]e') AS licence FROM documents""")
def signal_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return read(spark, sf_dir, "documents").select(
        "doc_id", F.regexp_count(t, F.lit("[A-Z][a-z]+ [a-z]+")).cast("long").alias("binomials"), F.regexp_count(t, F.lit("[.!?]")).cast("long").alias("ends"), t.rlike("icen[cs]e").alias("licence"))


@on_tables("fn32_message_digest", """
SELECT conv_id, turn, left(sha256(role || '|' || text), 16) AS payload_hash FROM conversations""")
def payload_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.left(F.sha2(F.concat_ws("|", "role", "text"), 256), F.lit(16)).alias("payload_hash"))


@on_tables("fn31_json_props", """
SELECT event_type, count(*) AS n, sum(CAST(json_extract(props, '$.k') AS bigint))::bigint AS k FROM events GROUP BY event_type""")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.from_json("props", "k bigint")["k"]
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("k"))
