"""Queries that walk: ancestors of classes, families of molecules, chains of merges, matches that open further matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import dml
from loomgraph.operators import hierarchy as H
from loomgraph.plans.registry import Registry
from loomgraph.plans.tables import read
from loomgraph.sources.projection import Graph

ENTRIES = Registry()
entry = ENTRIES.entry
TABLES: dict = {}


def on_tables(name: str, sql: str | None):
    def keep(f):
        TABLES[name] = (f, sql)
        return f

    return keep


def class_parents(g: Graph) -> DataFrame:
    """A hierarchy over the compounds: each under the half of its number, every tenth also under another, rings among them."""
    p = F.col("compound_id")
    halves = g.compound.where(p > 1).select(p.alias("id"), F.floor(p / 2).alias("parent"))
    others = g.compound.where(p % 10 == 0).select(p.alias("id"), F.substring("smiles", 2, 10).cast("long").alias("parent"))
    return halves.union(others)


def class_references(p: Column) -> Column:
    """References of a class as an ontology lists them: several of one prefix, some without a value or a prefix."""
    n = p.cast("string")
    return F.array(
        F.concat(F.lit("MESH:D"), n), F.concat(F.lit("MESH:X"), n), F.lit("no reference"), F.lit(":1"), F.lit("SCTID:"), F.when(p % 2 == 0, F.concat(F.lit("ICD10WHO:W"), n)),
        F.when(p % 3 == 0, F.concat(F.lit("ICD10CM:"), n, F.lit(":a"))), F.when(p % 5 == 0, F.concat(F.lit("SCTID:"), n)))


WALK_SQL = """
, up AS (SELECT compound_id AS id, compound_id // 2 AS parent FROM compound WHERE compound_id > 1 UNION SELECT compound_id, CAST(substr(smiles, 2) AS bigint) FROM compound WHERE compound_id % 10 = 0)
, walk AS (SELECT DISTINCT src AS id, src AS ancestor, 0 AS distance FROM extracted UNION SELECT w.id, u.parent, w.distance + 1 FROM walk w JOIN up u ON u.id = w.ancestor WHERE w.distance < 5 AND u.id <> u.parent)
, near AS (SELECT id, ancestor, min(distance) AS distance FROM walk WHERE ancestor <> id GROUP BY id, ancestor QUALIFY row_number() OVER (PARTITION BY id ORDER BY min(distance), ancestor) <= 5)
"""


@entry("src30_ancestors", WALK_SQL + """
, seen AS (SELECT dst AS asked, src AS nth, src AS id, 0 AS distance FROM extracted UNION ALL SELECT x.dst, x.src, n.ancestor, n.distance FROM extracted x JOIN near n ON n.id = x.src)
, once AS (SELECT asked, id, min({'nth': nth, 'distance': distance, 'id': id}) AS spot FROM seen GROUP BY asked, id)
SELECT asked, CAST(row_number() OVER (PARTITION BY asked ORDER BY spot) AS integer) AS position, id, spot.distance AS distance, 'D' || id AS mesh_id,
  CASE WHEN id % 3 = 0 THEN id || ':a' WHEN id % 2 = 0 THEN 'W' || id ELSE '' END AS icd10_code, CASE WHEN id % 5 = 0 THEN CAST(id AS varchar) ELSE '' END AS snomed_id FROM once""")
def related_with_ancestors(g: Graph) -> DataFrame:
    """Classes that stand in relation to each source, nearest ancestors behind each, with their outside ids."""
    hits = g.extracted.select(F.col("dst").alias("asked"), F.col("src").alias("nth"), F.col("src").alias("id"))
    found = H.related_classes(hits, class_parents(g))
    refs = found.withColumn("refs", H.cross_references(class_references(F.col("id"))))
    got = lambda k: F.try_element_at("refs", F.lit(k))
    return refs.select(
        "asked", "position", "id", "distance", F.coalesce(got("MESH"), F.lit("")).alias("mesh_id"),
        F.coalesce(got("ICD10CM"), got("ICD10WHO"), F.lit("")).alias("icd10_code"), F.coalesce(got("SCTID"), F.lit("")).alias("snomed_id"))


@entry("src31_nearest_ancestors", WALK_SQL + "SELECT distance, count(*) AS n, count(DISTINCT ancestor) AS ancestors, CAST(sum(id * 7 + ancestor) AS bigint) AS checked FROM near GROUP BY distance")
def nearest_ancestors(g: Graph) -> DataFrame:
    """How far away the ancestors of the compounds in use are."""
    found = H.ancestors(g.extracted.select(F.col("src").alias("id")), class_parents(g))
    return found.groupBy("distance").agg(F.count("*").alias("n"), F.count_distinct("ancestor").alias("ancestors"), F.sum(F.col("id") * 7 + F.col("ancestor")).alias("checked"))


@entry("src16_families", """
, m AS (SELECT compound_id AS id, CASE WHEN compound_id % 4 IN (1, 2) AND compound_id > 4 THEN compound_id - compound_id % 4 ELSE compound_id END AS parent FROM compound)
, f AS (SELECT parent, array_to_string(list_prepend(parent, coalesce(list(id ORDER BY id) FILTER (id <> parent), [])), ',') AS family FROM m GROUP BY parent)
SELECT m.id AS asked, m.parent, f.family, (SELECT count(DISTINCT k.dst) FROM known k JOIN m x ON x.id = k.src WHERE x.parent = m.parent) AS diseases FROM m JOIN f USING (parent)""")
def molecule_families(g: Graph) -> DataFrame:
    """Each molecule's parent, that parent's whole family, and the diseases that any of the family is indicated for."""
    p = F.col("compound_id")
    members = g.compound.select(p.alias("id"), F.when((p % 4).isin(1, 2) & (p > 4), p - p % 4).alias("parent"))
    of = members.select("id", F.coalesce("parent", "id").alias("parent"))
    diseases = g.known.select(F.col("src").alias("id"), "dst").join(of, "id").groupBy("parent").agg(F.count_distinct("dst").alias("diseases"))
    rows = of.join(H.families(members), "parent").join(diseases, "parent", "left")
    return rows.select(F.col("id").alias("asked"), "parent", F.array_join(F.col("family").cast("array<string>"), ",").alias("family"), F.coalesce("diseases", F.lit(0)).alias("diseases"))


MERGES_SQL = """
, merged AS (SELECT source_id AS old, CASE WHEN source_id % 29 = 1 AND source_id > 1 THEN source_id - 1 ELSE source_id + 1 END AS keeper FROM source WHERE source_id % 13 IN (0, 9, 10, 11, 12) OR source_id % 29 IN (0, 1))
, chase AS (SELECT old, keeper AS here, [old, keeper] AS way, false AS ring FROM merged UNION ALL
  SELECT c.old, m.keeper, list_append(c.way, m.keeper), list_contains(c.way, m.keeper) FROM chase c JOIN merged m ON m.old = c.here WHERE NOT c.ring)
, ends AS (SELECT old, CASE WHEN ring THEN (SELECT min(x) FROM unnest(way[list_position(way, here):]) t(x)) ELSE here END AS keeper FROM chase c WHERE ring OR here NOT IN (SELECT old FROM merged))
, last AS (SELECT * FROM ends WHERE old <> keeper)
"""


def merges(g: Graph) -> DataFrame:
    """Sources merged into their neighbours: chains of up to six, and rings of two."""
    s = F.col("source_id")
    hit = g.source.where((s % 13).isin(0, 9, 10, 11, 12) | (s % 29).isin(0, 1))
    return hit.select(s.alias("old"), F.when((s % 29 == 1) & (s > 1), s - 1).otherwise(s + 1).alias("keeper"))


@entry("dml14_last_keepers", MERGES_SQL + "SELECT old, keeper FROM last")
def last_keepers(g: Graph) -> DataFrame:
    """Where merged sources end up after all merges."""
    return H.last_of_chains(merges(g))


@entry("dml14_chained_merges", MERGES_SQL + """
, moved AS (SELECT coalesce(keeper, src) AS src, dst, confidence, src AS was, keeper IS NULL AS own FROM treats LEFT JOIN last ON old = src)
SELECT src, dst, round(confidence, 6) AS confidence, CASE WHEN NOT own THEN was END AS moved_from FROM (
  SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY confidence DESC NULLS LAST, own DESC, was) AS nth FROM moved) WHERE nth = 1""")
def chained_merges(g: Graph) -> DataFrame:
    """Claims of merged sources moved to the last keeper of their chain."""
    return dml.retarget(g.treats, H.last_of_chains(merges(g))).withColumn("confidence", F.round("confidence", 6))


@entry("au03_united_aliases", MERGES_SQL + """
, own AS (SELECT source_id, name, [lower(name), canonical_name] AS aliases FROM source)
, part AS (SELECT l.keeper, o.name, o.aliases FROM last l JOIN own o ON o.source_id = l.old), every AS (
  SELECT keeper AS id, unnest(list_append(aliases, name)) AS alias FROM part UNION ALL SELECT source_id, unnest(aliases) FROM own WHERE source_id IN (SELECT keeper FROM last))
SELECT o.name AS keeper, array_to_string(list(DISTINCT e.alias ORDER BY e.alias), ';') AS aliases, (SELECT count(*) FROM last WHERE last.keeper = o.source_id) AS merged
FROM every e JOIN own o ON o.source_id = e.id WHERE e.alias IS NOT NULL AND e.alias <> o.name GROUP BY o.source_id, o.name""")
def united_aliases(g: Graph) -> DataFrame:
    """What a merge leaves at its keeper: the names and aliases of all that were merged into it, over whole chains."""
    own = g.source.select("source_id", "name", F.array(F.lower("name"), "canonical_name").alias("aliases"))
    found = dml.united_aliases(own, H.last_of_chains(merges(g)))
    return found.select(F.col("name").alias("keeper"), F.array_join("aliases", ";").alias("aliases"), "merged")


@on_tables("lk14_index_upgrade", """
WITH RECURSIVE c AS (SELECT row_number() OVER (ORDER BY c_custkey) AS i, c_custkey AS nth, CASE WHEN c_custkey % 4 = 0 THEN 'mesh:D' || (c_custkey % 60) END AS k1,
    ['efo', 'mondo', 'doid'][c_custkey % 3 + 1] || ':' || (c_custkey * 7 % 230) AS k2, ['efo', 'mondo', 'doid'][c_custkey % 3 + 1] AS kind2,
    CASE WHEN c_custkey % 5 < 3 THEN n_name END AS name FROM customer JOIN nation ON c_nationkey = n_nationkey
), start AS (SELECT list('mesh:D' || n_nationkey ORDER BY n_nationkey) AS keys, list(n_name ORDER BY n_nationkey) AS names, list('mesh ' || n_name) AS borne FROM nation WHERE n_nationkey % 5 <> 0 AND n_nationkey % 7 <> 0
), s AS (
  SELECT 0::bigint AS i, keys, names, borne, NULL::bigint AS nth, NULL::varchar AS matched, NULL::varchar AS tier, NULL::varchar AS kind FROM start
  UNION ALL
  SELECT i + 1, keys || CASE WHEN f1 THEN [k1] ELSE [] END || CASE WHEN f2 THEN [k2] ELSE [] END, names || CASE WHEN f1 THEN [name] ELSE [] END || CASE WHEN f2 THEN [name] ELSE [] END,
    borne || CASE WHEN f1 THEN ['mesh ' || name] ELSE [] END || CASE WHEN f2 THEN [kind2 || ' ' || name] ELSE [] END, nth,
    coalesce(names[h1], names[h2], name), CASE WHEN coalesce(h1, h2) IS NOT NULL THEN 'id' WHEN name IS NOT NULL THEN 'name' ELSE 'none' END, CASE WHEN h1 IS NOT NULL THEN 'mesh' WHEN h2 IS NOT NULL THEN kind2 END
  FROM (
    SELECT *, coalesce(h1, h2) IS NULL AND name IS NOT NULL AND k1 IS NOT NULL AND NOT list_contains(borne, 'mesh ' || name) AS f1,
      coalesce(h1, h2) IS NULL AND name IS NOT NULL AND NOT list_contains(borne, kind2 || ' ' || name) AS f2
    FROM (SELECT s.i, s.keys, s.names, s.borne, c.nth, c.k1, c.k2, c.kind2, c.name, nullif(list_position(s.keys, c.k1), 0) AS h1, nullif(list_position(s.keys, c.k2), 0) AS h2 FROM s JOIN c ON c.i = s.i + 1))
)
SELECT nth, matched, tier, kind FROM s WHERE i > 0""")
def index_upgrade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as candidates with a name, an outside id and, some of them, a mesh id, matched in their order to nations:
    matches by name fill ids, which later ones match by."""
    c = F.col("c_custkey")
    nation = read(spark, sf_dir, "nation")
    n = F.col("n_nationkey")
    known = nation.where((n % 5 != 0) & (n % 7 != 0)).select(F.lit("mesh").alias("kind"), F.concat(F.lit("D"), n.cast("string")).alias("id"), F.col("n_name").alias("name"))
    kind = F.element_at(F.array(F.lit("efo"), F.lit("mondo"), F.lit("doid")), (c % 3 + 1).cast("int"))
    mesh = F.when(c % 4 == 0, F.struct(F.lit("mesh").alias("kind"), F.concat(F.lit("D"), (c % 60).cast("string")).alias("id")))
    other = F.struct(kind.alias("kind"), (c * 7 % 230).cast("string").alias("id"))
    rows = read(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == n)  # 25 nations
    candidates = rows.select(c.alias("nth"), F.array_compact(F.array(mesh, other)).alias("keys"), F.when(c % 5 < 3, F.col("n_name")).alias("name"))
    return H.upgraded_index(candidates, known)[0]
