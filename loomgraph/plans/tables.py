"""Queries on single tables and on graph snapshots: mutations, text, matching, rollups, windows of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.functions import names as N
from loomgraph.functions import tiers as T
from loomgraph.operators import dml, matching, text
from loomgraph.operators import paths as P
from loomgraph.plans.registry import Registry
from loomgraph.sources.projection import Graph, active
from loomgraph.streaming import events as E

ENTRIES = Registry()
entry = ENTRIES.entry
#: name -> (function of session and directory, SQL or None)
TABLES: dict = {}


def on_tables(name: str, sql: str | None):
    def keep(f):
        TABLES[name] = (f, sql)
        return f

    return keep


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


INCOMING_SQL = """
, incoming AS (SELECT src, dst, max(confidence) AS confidence FROM (
    SELECT src, dst, confidence / 2 AS confidence FROM treats WHERE src % 3 = 0 UNION ALL SELECT src + 1, dst, 0.25::double FROM treats WHERE src % 5 = 0) GROUP BY src, dst
), kept AS (SELECT * FROM incoming WHERE src IN (SELECT source_id FROM source) AND dst IN (SELECT name FROM malady))
"""
MERGED_SQL = """SELECT coalesce(o.src, n.src) AS src, coalesce(o.dst, n.dst) AS dst, round(coalesce(n.confidence, o.confidence), 6) AS confidence, o.src IS NULL AS created
FROM treats o FULL OUTER JOIN {new} n ON o.src = n.src AND o.dst = n.dst"""


def delivered(g: Graph) -> DataFrame:
    """Claims that come again, and new ones, some of sources that nobody knows."""
    again = g.treats.where("src % 3 = 0").withColumn("confidence", F.col("confidence") / 2)
    fresh = g.treats.where("src % 5 = 0").select((F.col("src") + 1).alias("src"), "dst", F.lit(0.25).alias("confidence"))
    return again.select("src", "dst", "confidence").union(fresh).groupBy("src", "dst").agg(F.max("confidence").alias("confidence"))


@entry("dml02_upsert_edges", INCOMING_SQL + MERGED_SQL.format(new="incoming"))
def upsert_edges(g: Graph) -> DataFrame:
    """Known edges are updated, new ones created, with their ends where these are missing."""
    edges, _, _ = dml.merge_edges(g.treats, delivered(g), g.source, "source_id", g.malady, "name")
    return edges.withColumn("confidence", F.round("confidence", 6))


@entry("dml02_created_ends", INCOMING_SQL + "SELECT source_id, name FROM source UNION ALL SELECT DISTINCT src, NULL FROM incoming WHERE src NOT IN (SELECT source_id FROM source)")
def created_ends(g: Graph) -> DataFrame:
    _, sources, _ = dml.merge_edges(g.treats, delivered(g), g.source, "source_id", g.malady, "name")
    return sources.select("source_id", "name")


@entry("dml08_merge_known_ends", INCOMING_SQL + MERGED_SQL.format(new="kept"))
def merge_known_ends(g: Graph) -> DataFrame:
    """Only edges whose two ends exist are merged."""
    rows = dml.with_endpoints(delivered(g), g.source, "source_id", g.malady, "name")
    return dml.upsert(g.treats, rows, ["src", "dst"]).withColumn("confidence", F.round("confidence", 6))


@entry("dml01_upsert_nodes", """
, fresh AS (SELECT source_id * 2 AS source_id, 'new ' || name AS name FROM source WHERE source_id % 3 = 0)
SELECT coalesce(o.source_id, f.source_id) AS source_id, coalesce(f.name, o.name) AS name, o.canonical_name, o.source_id IS NULL AS created
FROM source o FULL OUTER JOIN fresh f ON f.source_id = o.source_id""")
def upsert_nodes(g: Graph) -> DataFrame:
    fresh = g.source.where("source_id % 3 = 0").select((F.col("source_id") * 2).alias("source_id"), F.concat(F.lit("new "), "name").alias("name"))
    return dml.upsert(g.source, fresh, ["source_id"]).select("source_id", "name", "canonical_name", "created")


@entry("dml03_set_properties", """
SELECT name, CASE WHEN source_id % 4 = 0 THEN 'linked' ELSE linker_status END AS linker_status FROM source""")
def set_node_properties(g: Graph) -> DataFrame:
    """A status stamp on known nodes; what it names besides is not created."""
    done = g.source.where("source_id % 4 = 0").select("source_id", F.lit("linked").alias("linker_status"))
    strangers = g.source.select((-1 - F.col("source_id")).alias("source_id"), F.lit("linked").alias("linker_status"))
    return dml.set_properties(g.source, done.union(strangers), "source_id", ["linker_status"]).select("name", "linker_status")


@entry("dml04_set_edge_properties", "SELECT src, dst, round(CASE WHEN dst LIKE 'B%' THEN confidence / 4 ELSE confidence END, 6) AS confidence FROM treats")
def set_edge_properties(g: Graph) -> DataFrame:
    new = g.treats.where("dst LIKE 'B%'").select("src", "dst", (F.col("confidence") / 4).alias("confidence"))
    strangers = g.treats.select("src", F.lit("nowhere").alias("dst"), F.lit(0.5).alias("confidence")).distinct()
    return dml.set_edge_properties(g.treats, new.union(strangers), ["confidence"]).withColumn("confidence", F.round("confidence", 6))


@entry("dml05_batches", "SELECT count(*) AS rows_sent FROM treats")
def batches_sent(g: Graph) -> DataFrame:
    """Rows sent in batches of about 500, counted batch by batch."""
    return dml.in_batches(g.treats, "src").groupBy("batch").agg(F.count("*").alias("n")).agg(F.sum("n").alias("rows_sent"))


@entry("dml11_detach_delete", """
, gone AS (SELECT source_id FROM source WHERE coalesce(archived, false))
SELECT 'source' AS part, count(*) AS n FROM source WHERE source_id NOT IN (SELECT * FROM gone) UNION ALL SELECT 'treats', count(*) FROM treats WHERE src NOT IN (SELECT * FROM gone)
UNION ALL SELECT 'extracted', count(*) FROM extracted WHERE dst NOT IN (SELECT * FROM gone)""")
def detach_archived(g: Graph) -> DataFrame:
    gone = g.source.where("archived").select("source_id")
    left, edges = dml.detach_delete(g.source, "source_id", gone, {"treats": (g.treats, "src"), "extracted": (g.extracted, "dst")})
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n") for name, df in (("source", left), *edges.items())]
    return counts[0].union(counts[1]).union(counts[2])


@entry("dml20_extraction_records", """
, mentioned AS (SELECT source_id, name, (SELECT list(dst ORDER BY dst) FROM treats WHERE src = source_id) AS found FROM source)
SELECT name AS source, unnest(found) AS malady FROM mentioned WHERE found IS NOT NULL UNION ALL SELECT name, NULL FROM mentioned WHERE found IS NULL""")
def extraction_records(g: Graph) -> DataFrame:
    """Extraction records as JSON text, a source and the maladies it is said to treat, parsed and laid out as edges; a
    record without maladies gives its source alone."""
    found = g.treats.groupBy(F.col("src").alias("source_id")).agg(F.array_sort(F.collect_list("dst")).alias("maladies"))
    records = g.source.join(found, "source_id", "left").select(F.to_json(F.struct("name", "maladies")).alias("json"))
    fenced = records.select(F.concat(F.lit("```json\n"), "json", F.lit("\n```")).alias("answer"))
    parsed = fenced.select(F.from_json(N.without_fence(F.col("answer")), "name string, maladies array<string>").alias("r"))
    return parsed.select(F.col("r.name").alias("source"), F.explode_outer("r.maladies").alias("malady"))


@entry("dml06_backfill_ids", """
SELECT name, coalesce(nullif(mesh_id, ''), 'X' || disease_id) AS mesh_id, coalesce(nullif(icd10_code, ''), CASE WHEN disease_id % 2 = 0 THEN 'Y' || disease_id END) AS icd10_code FROM disease""")
def backfill_ids(g: Graph) -> DataFrame:
    n = F.col("disease_id")
    new = g.disease.select("disease_id", F.concat(F.lit("X"), n.cast("string")).alias("mesh_id"), F.when(n % 2 == 0, F.concat(F.lit("Y"), n.cast("string"))).alias("icd10_code"))
    return dml.backfill(g.disease, new, "disease_id", ["mesh_id", "icd10_code"]).select("name", "mesh_id", "icd10_code")


@entry("dml07_delete_prior_edges", "SELECT src, dst, round(pchembl, 6) AS pchembl FROM targets WHERE src NOT IN (SELECT compound_id FROM compound WHERE target_linker_status = 'error')")
def delete_prior_edges(g: Graph) -> DataFrame:
    gone = g.compound.where("target_linker_status = 'error'").select(F.col("compound_id").alias("src"))
    return dml.delete(g.targets, gone, ["src"]).select("src", "dst", F.round("pchembl", 6).alias("pchembl"))


@entry("dml10_clear_status", "SELECT name, CAST(NULL AS varchar) AS linker_status FROM source")
def clear_status(g: Graph) -> DataFrame:
    return dml.clear_properties(g.source, ["linker_status"]).select("name", "linker_status")


@entry("dml12_archive_unmapped", """
SELECT name, CASE WHEN coalesce(archived, false) THEN true WHEN name NOT IN (SELECT src FROM maps) THEN true ELSE archived END AS archived,
  CASE WHEN coalesce(archived, false) THEN archive_reason WHEN name NOT IN (SELECT src FROM maps) THEN 'unmapped' ELSE archive_reason END AS archive_reason FROM malady""")
def archive_unmapped(g: Graph) -> DataFrame:
    gone = g.malady.join(g.maps.select(F.col("src").alias("name")), "name", "left_anti")
    return dml.archive(g.malady, gone, "name", "unmapped").select("name", "archived", "archive_reason")


@entry("dml13_cascade_counts", "SELECT coalesce(dst NOT IN (SELECT src FROM maps), false) AS archived, count(*) AS n FROM treats GROUP BY 1")
def cascade_counts(g: Graph) -> DataFrame:
    gone = g.malady.join(g.maps.select(F.col("src").alias("name")), "name", "left_anti")
    return dml.cascade(g.treats, gone, "name", "dst").groupBy("archived").agg(F.count("*").alias("n"))


@entry("dml14_retarget_edges", """
, merged AS (SELECT source_id AS old, source_id + 1 AS keeper FROM source WHERE archive_reason IS NOT NULL)
, moved AS (SELECT coalesce(keeper, src) AS src, dst, confidence, src AS was, keeper IS NULL AS own FROM treats LEFT JOIN merged ON old = src)
SELECT src, dst, round(confidence, 6) AS confidence, CASE WHEN NOT own THEN was END AS moved_from FROM (
  SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY confidence DESC NULLS LAST, own DESC, was) AS nth FROM moved) WHERE nth = 1""")
def retarget_edges(g: Graph) -> DataFrame:
    merged = g.source.where("archive_reason IS NOT NULL").select(F.col("source_id").alias("old"), (F.col("source_id") + 1).alias("keeper"))
    return dml.retarget(g.treats, merged).withColumn("confidence", F.round("confidence", 6))


@entry("dml15_alias_union", """
SELECT canonical_name, canonical_part, min(name) AS keeper, array_to_string(list(DISTINCT name ORDER BY name)[2:], ';') AS aliases
FROM source WHERE canonical_name IS NOT NULL GROUP BY canonical_name, canonical_part""")
def alias_union(g: Graph) -> DataFrame:
    found = dml.alias_union(g.source.where("canonical_name IS NOT NULL"), ["canonical_name", "canonical_part"], "name")
    return found.withColumn("aliases", F.array_join("aliases", ";"))


@entry("au02_keeper_election", """
, deg AS (SELECT s.source_id, s.name, s.canonical_name, s.canonical_part, s.canonical_type,
    (SELECT count(*) FROM extracted WHERE dst = s.source_id) + (SELECT count(*) FROM treats WHERE src = s.source_id) + (SELECT count(*) FROM prepared WHERE src = s.source_id) AS degree
  FROM source s WHERE NOT coalesce(s.archived, false) AND s.canonical_name IS NOT NULL)
SELECT canonical_name, canonical_part, (arg_min(name, (CASE WHEN lower(name) = canonical_name THEN 0 ELSE 1 END, -degree, name))) AS keeper, count(*) AS members,
  CASE WHEN bool_and(canonical_type = 'organism') THEN 'auto_merge' ELSE 'borderline' END AS decision
FROM deg GROUP BY canonical_name, canonical_part HAVING count(*) > 1""")
def keeper_election(g: Graph) -> DataFrame:
    """Groups of one canonical name and part: the keeper bears that name, else has most edges, else comes first."""
    rows = active(g.source).where("canonical_name IS NOT NULL").join(P.degree(g, "source").withColumnRenamed("id", "source_id"), "source_id", "left")
    key = F.struct(F.when(F.lower("name") == F.col("canonical_name"), 0).otherwise(1).alias("a"), (-F.coalesce("degree", F.lit(0))).alias("b"), F.col("name").alias("c"))
    grounded = F.every(F.col("canonical_type") == "organism")
    return rows.groupBy("canonical_name", "canonical_part").agg(
        F.min(key).alias("k"), F.count("*").alias("members"), F.when(grounded, "auto_merge").otherwise("borderline").alias("decision")).where("members > 1").select(
        "canonical_name", "canonical_part", F.col("k.c").alias("keeper"), "members", "decision")


@entry("lk06_indications", """
SELECT compound_id, key, max(phase) AS phase FROM (SELECT k.src AS compound_id, coalesce(nullif(d.mesh_id, ''), 'efo:E' || (d.disease_id % 4)) AS key, CAST(floor(k.clinical_phase) AS integer) AS phase
  FROM known k JOIN disease d ON d.disease_id = k.dst) WHERE phase > 1 GROUP BY ALL""")
def indications(g: Graph) -> DataFrame:
    """Indications by mesh id, else by the other id; phases come as text, what is no number counts 0; the best stays."""
    rows = P.edge(g.known, "compound_id", "disease_id", phase="clinical_phase").join(P.node(g.disease, "disease_id", "disease_id", mesh="mesh_id"), "disease_id")
    rows = rows.withColumn("phase_text", F.concat(F.col("phase").cast("string"), F.lit(".0")))
    phase = F.coalesce(F.col("phase_text").try_cast("double").cast("int"), F.lit(0))
    key = F.coalesce(dml.filled("mesh"), F.concat(F.lit("efo:E"), (F.col("disease_id") % 4).cast("string")))
    return rows.select("compound_id", key.alias("key"), phase.alias("phase")).where("phase > 1").groupBy("compound_id", "key").agg(F.max("phase").alias("phase"))


@entry("jn13_tiered_match", """
, asked AS (SELECT n_nationkey AS q, CASE WHEN n_nationkey % 2 = 0 THEN 'D' || n_nationkey END AS mesh, lower(n_name) || ' xs' AS form FROM nation)
, norm AS (SELECT min(name) AS name, lower(name) || ' xs' AS form FROM disease WHERE NOT coalesce(archived, false) GROUP BY 2)
, ids AS (SELECT mesh_id, min(name) AS name FROM disease WHERE NOT coalesce(archived, false) AND mesh_id <> '' GROUP BY 1)
SELECT q, coalesce(i.name, n.name) AS disease, CASE WHEN i.name IS NOT NULL THEN 'id' WHEN n.name IS NOT NULL THEN 'name' ELSE 'none' END AS tier
FROM asked a LEFT JOIN ids i ON i.mesh_id = a.mesh LEFT JOIN norm n ON n.form = a.form""")
def tiered_match(g: Graph) -> DataFrame:
    """Outside records matched to diseases by id first, then by tolerant name; one join a tier, never a product."""
    n = F.col("disease_id")
    asked = g.disease.select(n.alias("q"), F.when(n % 2 == 0, F.concat(F.lit("D"), n.cast("string"))).alias("mesh"), F.concat(F.upper("name"), F.lit(" (old), x's")).alias("asked"))
    mine = active(g.disease)
    ids = mine.where("mesh_id <> ''").groupBy("mesh_id").agg(F.min("name").alias("by_id"))
    forms = mine.groupBy(N.match_form(F.concat("name", F.lit(" xs"))).alias("form")).agg(F.min("name").alias("by_name"))
    found = asked.join(ids, F.col("mesh") == F.col("mesh_id"), "left").join(forms, N.match_form(F.col("asked")) == F.col("form"), "left")
    return found.select(
        "q", F.coalesce("by_id", "by_name").alias("disease"),
        F.when(F.col("by_id").isNotNull(), "id").when(F.col("by_name").isNotNull(), "name").otherwise("none").alias("tier"))


@entry("fn14_17_tiers", """
SELECT c.inchikey, k.clinical_phase, CASE WHEN k.clinical_phase >= 4 THEN 'chembl_indication_approved' WHEN k.clinical_phase = 3 THEN 'chembl_indication_phase3'
  WHEN k.clinical_phase = 2 THEN 'chembl_indication_phase2' WHEN k.clinical_phase = 1 THEN 'chembl_indication_phase1' END AS phase_type, substr(c.inchikey, 1, 14) AS planar
FROM known k JOIN compound c ON c.compound_id = k.src""")
def phase_tiers(g: Graph) -> DataFrame:
    rows = P.with_compound(g, P.edge(g.known, "compound_id", "disease_id", clinical_phase="clinical_phase"), inchikey="inchikey")
    return rows.select("inchikey", "clinical_phase", T.phase_type(F.col("clinical_phase")).alias("phase_type"), N.planar_key(F.col("inchikey")).alias("planar"))


@entry("ag12_nearest_rank", """
, counts AS (SELECT dst, count(*) AS n FROM extracted GROUP BY dst), o AS (SELECT list(n ORDER BY n) AS l, count(*) AS c FROM counts)
SELECT p, l[CAST(round_even(p / 100.0::double * (c - 1), 0) AS integer) + 1] AS value FROM o, (VALUES (0), (25), (50), (90), (100)) v(p)""")
def nearest_rank(g: Graph) -> DataFrame:
    """Percentiles of compounds a source by nearest rank, over counts of counts: as many rows as there are different counts."""
    sizes = g.extracted.groupBy("dst").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("times"))
    upto = sizes.select("n", F.sum("times").over(Window.orderBy("n")).alias("upto"), F.sum("times").over(Window.partitionBy()).alias("all"))
    asked = F.explode(F.array(*map(F.lit, (0, 25, 50, 90, 100)))).alias("p")
    place = F.bround(F.col("p") / 100 * (F.col("all") - 1))
    return upto.select("n", "upto", "all", asked).where(F.col("upto") > place).groupBy("p").agg(F.min("n").alias("value"))


@entry("ag18_degree", """
SELECT 'compound' AS label, sum(n) AS total, max(n) AS most FROM (SELECT c.compound_id, (SELECT count(*) FROM extracted WHERE src = compound_id) + (SELECT count(*) FROM targets WHERE src = compound_id) + (SELECT count(*) FROM known WHERE src = compound_id) AS n FROM compound c)
UNION ALL SELECT 'target', sum(n), max(n) FROM (SELECT target_id, (SELECT count(*) FROM targets WHERE dst = target_id) + (SELECT count(*) FROM relates WHERE src = target_id) AS n FROM target)""")
def degrees(g: Graph) -> DataFrame:
    parts = [P.degree(g, label).agg(F.sum("degree").alias("total"), F.max("degree").alias("most")).select(F.lit(label).alias("label"), "total", "most") for label in ("compound", "target")]
    return parts[0].union(parts[1])


@on_tables("tx02_span_containment", r"""
SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d
ON contains(lower(trim(regexp_replace(d.text, '\s+', ' ', 'g'))), lower(trim(regexp_replace(b.text, '\s+', ' ', 'g'))))""")
def span_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.contained_spans(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@on_tables("tx05_paragraphs", r"""
SELECT doc_id, count(*) AS n, sum(length(p)) AS chars FROM (SELECT doc_id, unnest(list_transform(regexp_split_to_array(text, '\n\s*\n'), lambda x: trim(x))) AS p FROM documents) WHERE length(p) > 50 GROUP BY doc_id""")
def paragraph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = text.paragraphs(read(spark, sf_dir, "documents"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@on_tables("tx03_mention_windows", """
WITH l AS (SELECT doc_id, string_split(lower(text), chr(10)) AS lines FROM documents), h AS (SELECT doc_id, len(lines) AS n, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS i FROM l),
 w AS (SELECT doc_id, n, greatest(i - 15, 0) AS s, i + 16 AS e, i FROM h WHERE contains(line, 'license')),
 f AS (SELECT *, CASE WHEN s <= lag(e) OVER (PARTITION BY doc_id ORDER BY i) THEN 0 ELSE 1 END AS fresh FROM w), g AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM f)
SELECT doc_id, CAST(min(s) AS integer) AS start, CAST(least(max(e), any_value(n)) AS integer) AS end FROM g GROUP BY doc_id, island""")
def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.mention_windows(read(spark, sf_dir, "documents"), F.lit("license"), 15)


@on_tables("tx01_chunks", None)
def chunk_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.chunks(read(spark, sf_dir, "documents")).select("doc_id", "chunk", "start", "end")


@on_tables("fn01_match_form", r"""
SELECT item_id, lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\s*[\(\[\{][^\)\]\}]*[\)\]\}]', '', 'g'), '[''’ʼ]', '', 'g'), '[^\p{L}\p{N}_\s]+', ' ', 'g'), '\s+', ' ', 'g'))) AS form FROM benchmark""")
def match_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select("item_id", N.match_form(F.col("text")).alias("form"))


@on_tables("jn11_fuzzy_names", r"""
WITH n AS (SELECT DISTINCT p_name AS name FROM part), t AS (SELECT name, list_distinct(string_split(lower(name), ' ')) AS w FROM n)
SELECT a.name AS a, b.name AS b FROM t a JOIN t b ON a.name < b.name
WHERE contains(lower(a.name), lower(b.name)) OR contains(lower(b.name), lower(a.name)) OR len(list_intersect(a.w, b.w)) >= 2
  OR (len(list_intersect(a.w, b.w)) >= 1 AND len(a.w) = 2 AND len(b.w) = 2 AND EXISTS (SELECT 1 FROM unnest(a.w) x(x), unnest(b.w) y(y)
      WHERE NOT list_contains(b.w, x) AND NOT list_contains(a.w, y) AND least(length(x), length(y)) >= 4 AND levenshtein(x, y) <= 1))""")
def fuzzy_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of distinct names that match loosely."""
    names = read(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct()
    return matching.loose_pairs(names)


@on_tables("ev05_brier", """
SELECT lang, count(*) AS n, sum(CAST(round(pow(CASE WHEN n_chars > 1000 THEN 0.75 ELSE 0.25 END - quality, 2) * 1000000) AS bigint))::double / count(*) / 1000000 AS brier
FROM documents JOIN labels USING (doc_id) GROUP BY lang""")
def brier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean squared difference of a probability and its label, over whole millionths."""
    p = F.when(F.col("n_chars") > 1000, 0.75).otherwise(0.25)
    rows = read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(read(spark, sf_dir, "labels"), "doc_id")
    return rows.groupBy("lang").agg(F.count("*").alias("n"), (F.sum(P.micro(F.pow(p - F.col("quality"), 2))) / F.count("*") / 1_000_000).alias("brier"))


@on_tables("sm02_event_windows", """
SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n_events, CAST(sum(CAST(round(value * 100) AS bigint)) AS bigint) AS cents
FROM (SELECT DISTINCT ON (event_id) * FROM events) GROUP BY 1, 2""")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.window_counts(E.unique_events(read(spark, sf_dir, "events")))


@on_tables("sm01_unfinished_users", """
SELECT user_id, arg_max(event_type, (ts, event_id)) AS last_type, count(*) AS n FROM events GROUP BY user_id HAVING arg_max(event_type, (ts, event_id)) <> 'purchase'""")
def resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys whose last status is not the terminal one."""
    rows = read(spark, sf_dir, "events").groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("last"), F.count("*").alias("n"))
    return rows.select("user_id", F.col("last.event_type").alias("last_type"), "n").where(F.col("last_type") != "purchase")


@on_tables("wn14_merged_intervals", """
WITH o AS (SELECT user_id, CAST(floor(epoch(ts)) AS bigint) AS s, CAST(floor(epoch(ts)) AS bigint) + 3600 AS e FROM events),
 m AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM o),
 g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT user_id, min(s) AS start_s, max(e) AS end_s, count(*) AS n FROM g GROUP BY user_id, island""")
def merged_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours after events, merged where they touch: gaps and islands a user."""
    start = F.unix_timestamp("ts")
    rows = read(spark, sf_dir, "events").select("user_id", start.alias("s"), (start + 3600).alias("e"))
    line = Window.partitionBy("user_id").orderBy("s", "e")
    fresh = F.when(F.col("s") <= F.max("e").over(line.rowsBetween(Window.unboundedPreceding, -1)), 0).otherwise(1)
    rows = rows.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("user_id", "island").agg(F.min("s").alias("start_s"), F.max("e").alias("end_s"), F.count("*").alias("n")).drop("island")


@on_tables("fn32_conversation_digest", """
SELECT conv_id, sha256(string_agg(role || ':' || text, ' / ' ORDER BY turn, role, text)) AS payload_hash, sum(length(text)) AS chars, count(*) AS turns FROM conversations GROUP BY conv_id""")
def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole messages of a conversation in order, as one text of which the digest and size are given."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", "role", "text").alias("m"))
    text_of = F.transform(F.array_sort(F.collect_list("m")), lambda m: F.concat_ws(":", m["role"], m["text"]))
    return rows.groupBy("conv_id").agg(
        F.sha2(F.array_join(text_of, " / "), 256).alias("payload_hash"), F.sum(F.length("m.text")).alias("chars"), F.count("*").alias("turns"))
