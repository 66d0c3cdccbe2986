"""Queries about what is kept between runs: states of linking, results that still hold, answers, versions, constraints."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import constraints, dml
from loomgraph.plans import validate
from loomgraph.plans.registry import Registry
from loomgraph.plans.tables import read
from loomgraph.plans.validate import PATH_SQL
from loomgraph.sources.cache import AnswerCache
from loomgraph.sources.projection import Graph
from loomgraph.sources.resume import split_by_results
from loomgraph.sources.snapshots import shared_folder
from loomgraph.sources.versions import Versions
from loomgraph.streaming import status

ENTRIES = Registry()
entry = ENTRIES.entry
TABLES: dict = {}


def on_tables(name: str, sql: str | None):
    def keep(f):
        TABLES[name] = (f, sql)
        return f

    return keep


OUTCOME_SQL = """
WITH o AS (SELECT CAST(user_id AS varchar) AS key, event_id AS seq, CASE event_type WHEN 'error' THEN 'transient' WHEN 'view' THEN 'miss' ELSE 'ok' END AS outcome,
    CASE WHEN event_type IN ('view', 'error') THEN [] ELSE list_filter(['k' || json_extract_string(props, '$.k'), event_type], lambda x: event_type <> 'signup') END AS edges FROM events)
, s AS (SELECT key, max(seq) AS seq, arg_max(CASE WHEN outcome = 'transient' THEN 'error' WHEN len(edges) > 0 THEN 'linked' ELSE 'no_targets_found' END, seq) AS status,
    max(seq) FILTER (outcome <> 'transient') AS edge_seq, coalesce(arg_max(edges, seq) FILTER (outcome <> 'transient'), []) AS edges FROM o GROUP BY key)
"""


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as outcomes of a linker: errors are transient, views are misses, the rest finds what it names (signups nothing)."""
    kind = F.col("event_type")
    k = F.concat(F.lit("k"), F.get_json_object("props", "$.k"))
    edges = F.when(kind.isin("view", "error", "signup"), F.array().cast("array<string>")).otherwise(F.array(k, kind))
    outcome = F.when(kind == "error", status.TRANSIENT).when(kind == "view", status.MISS).otherwise(status.OK)
    return read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), outcome.alias("outcome"), edges.alias("edges"))


@on_tables("sm01_settled_states", OUTCOME_SQL + "SELECT key, seq, status, edge_seq, array_to_string(edges, ';') AS edges FROM s")
def settled_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each key after all its outcomes; a transient failure leaves the edges that were there."""
    return status.settled(outcomes(spark, sf_dir)).withColumn("edges", F.array_join("edges", ";"))


@on_tables("sm01_next_runs", OUTCOME_SQL + """
, w AS (SELECT DISTINCT CAST(c_custkey AS varchar) AS key FROM customer WHERE c_custkey <= 200), j AS (SELECT w.key, s.status FROM w LEFT JOIN s USING (key))
SELECT 'default' AS run, coalesce(status, 'new') AS status, count(*) AS n FROM j WHERE status IS NULL GROUP BY status UNION ALL SELECT 'retry', coalesce(status, 'new'), count(*) FROM j WHERE status IS NULL OR status IN ('error', 'no_targets_found') GROUP BY status
UNION ALL SELECT 'force', coalesce(status, 'new'), count(*) FROM j GROUP BY status""")
def next_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the next run would ask for, by default, with a retry of misses, and by force."""
    state = status.settled(outcomes(spark, sf_dir))
    wanted = read(spark, sf_dir, "customer").where("c_custkey <= 200").select(F.col("c_custkey").cast("string").alias("key"))
    runs = [("default", {}), ("retry", {"retry": ("error", "no_targets_found")}), ("force", {"force": True})]
    rows = [status.unfinished(wanted, state, **how).select(F.lit(run).alias("run"), F.coalesce("status", F.lit("new")).alias("status")) for run, how in runs]
    return reduce(DataFrame.unionByName, rows).groupBy("run", "status").agg(F.count("*").alias("n"))


@entry("ev21_resumed_cases", PATH_SQL + """
, cases AS (SELECT source || '|' || malady AS case_id, left(sha256(verdict || ':' || path_count), 16) AS output_hash, verdict FROM verdicts)
, results AS (SELECT case_id, CASE WHEN length(case_id) % 5 = 0 THEN 'stale' ELSE output_hash END AS output_hash, CASE WHEN length(case_id) % 7 = 0 THEN 'other' ELSE 'judge' END AS model FROM cases WHERE verdict <> 'unsupported')
SELECT c.verdict, count(*) AS cases, count(*) FILTER (EXISTS (SELECT 1 FROM results r WHERE r.case_id = c.case_id AND r.output_hash = c.output_hash AND r.model = 'judge')) AS held FROM cases c GROUP BY c.verdict""")
def resumed_cases(g: Graph) -> DataFrame:
    """Cases whose result still holds: of the same case, payload and judge.  Results of older payloads and of other judges
    stand among them."""
    digest = F.left(F.sha2(F.concat_ws(":", "verdict", F.col("path_count").cast("string")), 256), F.lit(16))
    cases = validate.verdicts(g).select(F.concat_ws("|", "source", "malady").alias("case_id"), digest.alias("output_hash"), F.lit("judge").alias("model"), "verdict")
    n = F.length("case_id")
    results = cases.where("verdict <> 'unsupported'").select(
        "case_id", F.when(n % 5 == 0, "stale").otherwise(F.col("output_hash")).alias("output_hash"), F.when(n % 7 == 0, "other").otherwise("judge").alias("model"))
    _, left = split_by_results(cases, results)
    both = cases.groupBy("verdict").agg(F.count("*").alias("cases")).join(left.groupBy("verdict").agg(F.count("*").alias("left")), "verdict", "left")
    return both.select("verdict", "cases", (F.col("cases") - F.coalesce("left", F.lit(0))).alias("held"))


@on_tables("src27_cached_lookups", """
WITH a AS (SELECT lower(p_name) || '#' || p_size AS key, p_partkey AS nth, p_name AS name FROM part), c AS (SELECT DISTINCT key, CASE WHEN length(key) % 3 = 0 THEN NULL ELSE 'C' || length(key) END AS value FROM a WHERE substr(key, 1, 1) < 'm')
, j AS (SELECT a.*, c.key IS NOT NULL AS known, c.value FROM a LEFT JOIN c USING (key))
SELECT 'hit' AS outcome, count(*) AS n, count(DISTINCT key) AS keys, min(nth) AS first FROM j WHERE known AND value IS NOT NULL UNION ALL SELECT 'known miss', count(*), count(DISTINCT key), min(nth) FROM j WHERE known AND value IS NULL
UNION ALL SELECT 'asked', count(DISTINCT key), count(DISTINCT key), min(nth) FROM j WHERE NOT known""")
def cached_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names looked up in a cache that knows some of them, and of some that there is nothing; the rest is asked for once a key."""
    size = F.col("p_size").cast("string")
    asked = read(spark, sf_dir, "part").select(F.concat_ws("#", F.lower("p_name"), size).alias("key"), F.col("p_partkey").alias("nth"), F.col("p_name").alias("name"))
    token = uuid.uuid4().hex
    cache = AnswerCache(spark, f"answers_{token}", f"{shared_folder(spark)}/answers-{token}", buckets=int(spark.conf.get("spark.sql.shuffle.partitions")))
    n = F.length("key")
    cache.write_back(asked.where("substr(key, 1, 1) < 'm'").select("key", F.when(n % 3 != 0, F.concat(F.lit("C"), n.cast("string"))).alias("value")))
    found, missing = cache.look_up(asked)
    kind = F.when(F.col("value").isNull(), "known miss").otherwise("hit")
    known = found.where("known").groupBy(kind.alias("outcome")).agg(F.count("*").alias("n"), F.count_distinct("key").alias("keys"), F.min("nth").alias("first"))
    return known.unionByName(missing.agg(F.count("*").alias("n"), F.count_distinct("key").alias("keys"), F.min("nth").alias("first")).withColumn("outcome", F.lit("asked")))


@entry("dml18_versions", """
SELECT 'main' AS branch, 'source' AS name, count(*) AS n FROM source UNION ALL SELECT 'main', 'treats', count(*) FROM treats UNION ALL SELECT 'trial', 'source', count(*) FROM source WHERE NOT coalesce(archived, false)
UNION ALL SELECT 'trial', 'treats', count(*) FROM treats WHERE src NOT IN (SELECT source_id FROM source WHERE archived)""")
def versions_of_the_graph(g: Graph) -> DataFrame:
    """A clone of the graph from which archived sources are deleted with their claims; the graph itself stays as it was."""
    spark = g.source.sparkSession
    store = Versions(spark, f"{shared_folder(spark)}/versions-{uuid.uuid4().hex}")
    store.commit({"source": g.source, "treats": g.treats}, rules={"source": {"a key": F.col("source_id").isNotNull()}, "treats": {"a sure claim": F.col("confidence").between(0, 1)}})
    store.clone("trial")
    gone = store.read("source", "trial").where("archived").select("source_id")
    left, edges = dml.detach_delete(store.read("source", "trial"), "source_id", gone, {"treats": (store.read("treats", "trial"), "src")})
    store.commit({"source": left, **edges}, "trial")
    counts = [store.read(n, b).agg(F.count("*").alias("n")).select(F.lit(b).alias("branch"), F.lit(n).alias("name"), "n") for b in ("main", "trial") for n in ("source", "treats")]
    return reduce(DataFrame.unionByName, counts)


@entry("dml19_constraints", """
, keys AS (SELECT 'source' AS name, source_id::varchar AS k FROM source UNION ALL SELECT 'compound', inchikey FROM compound UNION ALL SELECT 'compound names', name FROM compound UNION ALL SELECT 'disease ids', nullif(mesh_id, '') FROM disease)
, sizes AS (SELECT name, k, count(*) AS c FROM keys GROUP BY name, k)
SELECT name, 'without_key' AS rule, coalesce(sum(c) FILTER (k IS NULL), 0)::bigint AS n FROM sizes GROUP BY name UNION ALL SELECT name, 'repeated_key', coalesce(sum(c - 1) FILTER (k IS NOT NULL), 0)::bigint FROM sizes GROUP BY name
UNION ALL SELECT 'treats', 'lost_src', count(*) FROM treats WHERE src NOT IN (SELECT source_id FROM source WHERE NOT coalesce(archived, false)) UNION ALL SELECT 'treats', 'lost_dst', count(*) FROM treats WHERE dst NOT IN (SELECT name FROM malady)
UNION ALL SELECT 'known', 'lost_src', count(*) FROM known WHERE src NOT IN (SELECT compound_id FROM compound WHERE chembl_id <> '') UNION ALL SELECT 'known', 'lost_dst', count(*) FROM known WHERE dst NOT IN (SELECT disease_id FROM disease)""")
def constraint_report(g: Graph) -> DataFrame:
    """Keys that are missing or repeated, and edges whose ends aren't among the nodes that count: archived sources, and
    compounds without an outside id, are held not to."""
    keys = [
        (g.source.select(F.col("source_id").cast("string").alias("k")), "source"), (g.compound.select(F.col("inchikey").alias("k")), "compound"),
        (g.compound.select(F.col("name").alias("k")), "compound names"), (g.disease.select(dml.filled("mesh_id").alias("k")), "disease ids")]
    live = g.source.where("NOT coalesce(archived, false)")
    found = [constraints.key_report(t, n, ["k"]) for t, n in keys] + [
        constraints.end_report(g.treats, "treats", {"src": (live, "source_id"), "dst": (g.malady, "name")}),
        constraints.end_report(g.known, "known", {"src": (g.compound.where("chembl_id <> ''"), "compound_id"), "dst": (g.disease, "disease_id")})]
    return reduce(DataFrame.unionByName, found)
