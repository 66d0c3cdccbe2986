"""Nomination of compounds for diseases, held-out recovery, and the inline queries around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import tiers as T
from loomgraph.operators import paths as P
from loomgraph.operators.ranking import placed
from loomgraph.plans.registry import Registry
from loomgraph.sources.projection import Graph, active

ENTRIES = Registry()
entry = ENTRIES.entry

NOMINATE_SQL = """
, back AS (
  SELECT d.disease_id, d.name AS disease, c.inchikey, c.compound_id, s.name AS source, m.name AS malady, tt.confidence AS tt, x.confidence AS ex,
    CASE x.evidence_type WHEN 'coconut_organism_canonical' THEN 4 WHEN 'coconut_organism_alias' THEN 3 WHEN 'pubchem_chemical_formula' THEN 2 ELSE 0 END AS ex_rank
  FROM disease d JOIN maps mp ON mp.dst = d.disease_id AND coalesce(mp.is_primary, true) JOIN malady m ON m.name = mp.src
  JOIN treats tt ON tt.dst = m.name JOIN source s ON s.source_id = tt.src JOIN extracted x ON x.dst = s.source_id JOIN compound c ON c.compound_id = x.src
  WHERE NOT coalesce(d.archived, false) AND NOT coalesce(m.archived, false) AND NOT coalesce(s.archived, false) AND NOT coalesce(c.archived, false)
), forth AS (
  SELECT tg.src AS compound_id, r.dst AS disease_id, tg.dst AS target_id, round(tg.confidence * r.confidence, 6) AS score,
    least(CASE tg.evidence_type WHEN 'chembl_mechanism' THEN 4 WHEN 'chembl_activity_strong' THEN 3 WHEN 'chembl_activity_moderate' THEN 2 WHEN 'chembl_activity_weak' THEN 1 ELSE 0 END,
      CASE r.evidence_type WHEN 'ot_association_strong' THEN 4 WHEN 'ot_association_moderate' THEN 3 ELSE 0 END) AS bucket
  FROM targets tg JOIN relates r ON r.src = tg.dst
), b AS (
  SELECT disease_id, disease, compound_id, inchikey, count(*) AS historical_path_count, count(DISTINCT source) AS unique_sources, count(DISTINCT malady) AS unique_maladies
  FROM back GROUP BY ALL
), f AS (
  SELECT compound_id, disease_id, count(*) AS forward_path_count, count(DISTINCT target_id) AS unique_targets, max(bucket) AS bucket, arg_max(score, bucket * 10 + score) AS max_score
  FROM forth GROUP BY ALL
), cards AS (
  SELECT b.*, coalesce(forward_path_count, 0) AS forward_path_count, coalesce(unique_targets, 0) AS unique_targets, f.compound_id IS NOT NULL AS has_loop_closure,
    coalesce(bucket, 0) AS forward_bucket_rank, coalesce(max_score, 0) AS forward_max_score, k.src IS NOT NULL AS is_known
  FROM b LEFT JOIN f ON f.compound_id = b.compound_id AND f.disease_id = b.disease_id LEFT JOIN known k ON k.src = b.compound_id AND k.dst = b.disease_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY disease_id ORDER BY (NOT has_loop_closure), forward_bucket_rank DESC, unique_sources DESC, unique_maladies DESC, forward_max_score DESC, inchikey) AS rank
  FROM cards WHERE NOT is_known
), open AS (
  SELECT *, row_number() OVER (PARTITION BY disease_id ORDER BY (NOT has_loop_closure), forward_bucket_rank DESC, unique_sources DESC, unique_maladies DESC, forward_max_score DESC, inchikey) AS rank FROM cards
)
"""


def historical_routes(g: Graph) -> DataFrame:
    """Disease back to compounds over mapped maladies and their sources."""
    wanted = P.claims(g).join(P.mapped(g), "malady").join(P.node(active(g.disease), "disease_id", "disease_id", disease="name"), "disease_id")
    comp = P.node(active(g.compound), "compound_id", "compound_id", inchikey="inchikey")
    return wanted.join(P.source_compounds(g), "source_id").join(comp, "compound_id")


def forward_paths(g: Graph) -> DataFrame:
    rank = T.weakest(T.or_unrated(T.tier_rank(T.TGT_TIER, F.col("tgt_type"))), T.or_unrated(T.tier_rank(T.REL_TIER, F.col("rel_type"))))
    return P.compound_targets(g).join(P.target_diseases(g), "target_id").select(
        "compound_id", "disease_id", "target_id", rank.alias("bucket"), F.round(F.col("tgt") * F.col("rel"), 6).alias("score"))


def cards(g: Graph) -> DataFrame:
    """One row per (disease, compound) candidate: both sides are rolled up before they meet.

    A compound that only forward paths reach is no candidate; one without them has bucket 0 and score 0.
    """
    keys = ["compound_id", "disease_id"]
    back = historical_routes(g).groupBy("disease_id", "disease", "compound_id", "inchikey").agg(
        F.count("*").alias("historical_path_count"), F.count_distinct("source").alias("unique_sources"), F.count_distinct("malady").alias("unique_maladies"))
    forth = forward_paths(g).groupBy(*keys).agg(
        F.count("*").alias("forward_path_count"), F.count_distinct("target_id").alias("unique_targets"), F.max(F.struct("bucket", "score")).alias("best"))
    known = P.edge(g.known, *keys).withColumn("is_known", F.lit(True))
    zero = F.lit(0)
    return back.join(forth, keys, "left").join(known, keys, "left").select(
        *back.columns, F.coalesce("forward_path_count", zero).alias("forward_path_count"), F.coalesce("unique_targets", zero).alias("unique_targets"),
        F.col("best").isNotNull().alias("has_loop_closure"), F.coalesce("best.bucket", zero).alias("forward_bucket_rank"),
        F.coalesce("best.score", F.lit(0.0)).alias("forward_max_score"), F.coalesce("is_known", F.lit(False)).alias("is_known"))


def nomination_order() -> list[Column]:
    return [(~F.col("has_loop_closure")).cast("int"), F.desc("forward_bucket_rank"), F.desc("unique_sources"), F.desc("unique_maladies"),
            F.desc("forward_max_score"), F.col("inchikey")]


def ranked(g: Graph, novel_only: bool = True, masked: DataFrame | None = None, require_loop: bool = False) -> DataFrame:
    """Cards ranked in each disease.  Known treatments go, unless the pair stands in masked (compound_id, disease_id)."""
    rows = cards(g)
    if novel_only:
        hidden = rows.join(masked.distinct(), ["compound_id", "disease_id"], "left_semi") if masked is not None else None
        rows = rows.where("NOT is_known") if hidden is None else rows.where("NOT is_known").unionByName(hidden.where("is_known"))
    if require_loop:
        rows = rows.where("has_loop_closure")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("disease_id").orderBy(*nomination_order())))


def ranked_whole(g: Graph) -> DataFrame:
    """All cards with their ranks, known treatments among them: for what looks past the first few of a disease."""
    return placed(cards(g), ["disease_id"], nomination_order(), "rank")


@entry("tb01_nominations", NOMINATE_SQL + """
SELECT disease, rank, inchikey, historical_path_count, unique_sources, unique_maladies, forward_path_count, unique_targets, has_loop_closure,
  forward_bucket_rank, forward_max_score, round(CASE WHEN has_loop_closure THEN 1000 ELSE 0 END + 100 * forward_bucket_rank + 10 * unique_sources + forward_max_score, 6) AS composite_score
FROM ranked WHERE rank <= 20""")
def nominations(g: Graph, top: int = 20) -> DataFrame:
    score = T.composite(F.col("has_loop_closure"), F.col("forward_bucket_rank"), F.col("unique_sources"), F.col("forward_max_score"))
    return ranked(g).where(F.col("rank") <= top).select(
        "disease", "rank", "inchikey", "historical_path_count", "unique_sources", "unique_maladies", "forward_path_count", "unique_targets",
        "has_loop_closure", "forward_bucket_rank", "forward_max_score", F.round(score, 6).alias("composite_score"))


@entry("wn03_top_historical_paths", NOMINATE_SQL + """
SELECT disease, inchikey, source, malady, pos FROM (SELECT *, row_number() OVER (PARTITION BY disease_id, compound_id
  ORDER BY ex_rank DESC, round(CASE WHEN coalesce(tt, 0) = 0 THEN 1 ELSE tt END * ex, 9) DESC, source, malady) AS pos FROM back) WHERE pos <= 3""")
def top_historical_paths(g: Graph, keep: int = 3) -> DataFrame:
    sure = F.round(F.when(F.coalesce("tt", F.lit(0.0)) == 0, 1.0).otherwise(F.col("tt")) * F.col("ex"), 9)
    order = Window.partitionBy("disease_id", "compound_id").orderBy(T.tier_rank(T.EX_TIER, F.col("ex_type")).desc(), sure.desc(), "source", "malady")
    return historical_routes(g).withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= keep).select("disease", "inchikey", "source", "malady", "pos")


@entry("wn04_top_forward_paths", NOMINATE_SQL + """
SELECT inchikey, disease, target_id, score, pos FROM (SELECT b.inchikey, b.disease, f.target_id, f.score, row_number() OVER (PARTITION BY f.compound_id, f.disease_id
  ORDER BY f.bucket DESC, f.score DESC, f.target_id) AS pos FROM b JOIN forth f ON f.compound_id = b.compound_id AND f.disease_id = b.disease_id) WHERE pos <= 3""")
def top_forward_paths(g: Graph, keep: int = 3) -> DataFrame:
    keys = ["compound_id", "disease_id"]
    candidates = historical_routes(g).select(*keys, "inchikey", "disease").distinct()
    order = Window.partitionBy(*keys).orderBy(F.desc("bucket"), F.desc("score"), "target_id")
    return forward_paths(g).join(candidates, keys).withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= keep).select(
        "inchikey", "disease", "target_id", "score", "pos")


TEST_SQL = """
SELECT c.inchikey AS test_inchikey, c.name AS test_compound, d.name AS test_disease, k.clinical_phase
FROM known k JOIN compound c ON c.compound_id = k.src JOIN disease d ON d.disease_id = k.dst
WHERE NOT coalesce(c.archived, false) AND NOT coalesce(d.archived, false) AND {test}"""
HIST = """EXISTS (SELECT 1 FROM extracted x JOIN source s ON s.source_id = x.dst JOIN treats tt ON tt.src = x.dst JOIN malady m ON m.name = tt.dst
  JOIN maps mp ON mp.src = m.name AND coalesce(mp.is_primary, true) WHERE x.src = k.src AND mp.dst = k.dst AND NOT coalesce(s.archived, false) AND NOT coalesce(m.archived, false))"""
FORWARD = "EXISTS (SELECT 1 FROM targets tg JOIN relates r ON r.src = tg.dst WHERE tg.src = k.src AND r.dst = k.dst)"


def known_pairs(g: Graph) -> DataFrame:
    return P.edge(g.known, "compound_id", "disease_id", clinical_phase="clinical_phase").join(
        P.node(active(g.compound), "compound_id", "compound_id", test_inchikey="inchikey", test_compound="name"), "compound_id").join(
        P.node(active(g.disease), "disease_id", "disease_id", test_disease="name"), "disease_id")


def recovery_pairs(g: Graph, mode: str) -> DataFrame:
    """Known treatments to recover: broad (the compound has a source), historical (a route back), strict (and one forth)."""
    rows = known_pairs(g)
    if mode == "broad":
        return rows.join(P.source_compounds(g), "compound_id", "left_semi")
    routes = P.claims(g).join(P.mapped(g), "malady").join(P.source_compounds(g), "source_id")
    rows = rows.join(routes, ["compound_id", "disease_id"], "left_semi")
    return rows.join(forward_paths(g), ["compound_id", "disease_id"], "left_semi") if mode == "strict" else rows


for _id, _mode, _test in (("iq20", "broad", "EXISTS (SELECT 1 FROM extracted x WHERE x.src = k.src)"), ("iq21", "historical", HIST), ("iq22", "strict", f"{HIST} AND {FORWARD}")):
    ENTRIES[f"{_id}_test_set_{_mode}"] = (
        lambda g, mode=_mode: recovery_pairs(g, mode).select("test_inchikey", "test_compound", "test_disease", "clinical_phase"), TEST_SQL.format(test=_test))


@entry("ev10_held_out_recovery", NOMINATE_SQL + f"""
, tests AS (SELECT k.src, k.dst, c.inchikey, substr(c.inchikey, 1, 14) AS planar, d.name AS disease FROM known k JOIN compound c ON c.compound_id = k.src JOIN disease d ON d.disease_id = k.dst
  WHERE NOT coalesce(c.archived, false) AND NOT coalesce(d.archived, false) AND {HIST})
, pool AS (SELECT t.inchikey AS test_inchikey, t.disease, t.planar, c.inchikey, substr(c.inchikey, 1, 14) AS cp, c.has_loop_closure, c.forward_bucket_rank, c.unique_sources, c.unique_maladies, c.forward_max_score
  FROM tests t JOIN cards c ON c.disease_id = t.dst WHERE NOT c.is_known OR substr(c.inchikey, 1, 14) = t.planar)
, firsts AS (SELECT *, row_number() OVER (PARTITION BY test_inchikey, disease, cp ORDER BY (NOT has_loop_closure), forward_bucket_rank DESC, unique_sources DESC, unique_maladies DESC, forward_max_score DESC, inchikey) AS nth FROM pool)
, places AS (SELECT *, row_number() OVER (PARTITION BY test_inchikey, disease ORDER BY (NOT has_loop_closure), forward_bucket_rank DESC, unique_sources DESC, unique_maladies DESC, forward_max_score DESC, inchikey) AS rank FROM firsts WHERE nth = 1)
SELECT t.inchikey AS test_inchikey, t.disease AS test_disease, p.rank, p.rank IS NOT NULL AS found
FROM tests t LEFT JOIN places p ON p.test_inchikey = t.inchikey AND p.disease = t.disease AND p.cp = t.planar""")
def held_out_recovery(g: Graph) -> DataFrame:
    """Rank at which each known pair comes back once it and its planar siblings (same 14-character key) are masked.

    Counted, not looped: with siblings masked, a pair's rank among candidates deduplicated by planar key is 1 plus the
    number of planar groups whose best card beats the pair's own group.  Groups are formed once a disease, over novel
    cards; only the pair's own group also holds known cards.  So each pair meets one disease's ranked groups by a
    rank lookup instead of all its cards.
    """
    planar = F.substring("inchikey", 1, 14)
    key = F.struct(
        F.col("has_loop_closure").cast("int").alias("a"), F.col("forward_bucket_rank").alias("b"), F.col("unique_sources").alias("c"),
        F.col("unique_maladies").alias("d"), F.col("forward_max_score").alias("e"))
    rows = cards(g).select("disease_id", "inchikey", planar.alias("planar"), "is_known", key.alias("key"))
    order = Window.partitionBy("disease_id", "planar").orderBy(F.desc("key"), "inchikey")
    novel = rows.where("NOT is_known").withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth", "is_known")
    own = rows.withColumn("nth", F.row_number().over(order)).where("nth = 1").select("disease_id", "planar", F.col("key").alias("own_key"), F.col("inchikey").alias("own_inchikey"))
    tests = recovery_pairs(g, "historical").select("disease_id", "test_inchikey", "test_disease", F.substring("test_inchikey", 1, 14).alias("planar"))
    asked = tests.select("disease_id", "planar").distinct().join(own, ["disease_id", "planar"])
    # every asked group and every novel group of a disease in one order: a running count of novel groups before
    line = novel.select("disease_id", "planar", "key", "inchikey", F.lit(1).alias("novel")).unionByName(
        asked.select("disease_id", "planar", F.col("own_key").alias("key"), F.col("own_inchikey").alias("inchikey"), F.lit(0).alias("novel")))
    # in two steps, as a disease may hold most of them: whole classes of cards of equal rank but for the score are counted
    # and summed up (a row a class), and within a class there is a running count of its own
    line = line.select("*", F.struct("key.a", "key.b", "key.c", "key.d").alias("class"))
    classes = line.groupBy("disease_id", "class").agg(F.sum("novel").alias("n"))
    above = Window.partitionBy("disease_id").orderBy(F.desc("class")).rowsBetween(Window.unboundedPreceding, -1)
    classes = classes.select("disease_id", "class", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("above"))
    along = Window.partitionBy("disease_id", "class").orderBy(F.desc("key.e"), "inchikey", "novel").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = line.withColumn("before", F.sum("novel").over(along)).where("novel = 0").join(classes, ["disease_id", "class"]).select(
        "disease_id", "planar", (F.col("above") + F.col("before") + 1).alias("rank"))
    return tests.join(counted, ["disease_id", "planar"], "left").select(
        "test_inchikey", "test_disease", "rank", F.col("rank").isNotNull().alias("found"))


@entry("ev11_recovery_summary", ENTRIES["ev10_held_out_recovery"][1].replace("SELECT t.inchikey AS test_inchikey, t.disease AS test_disease, p.rank, p.rank IS NOT NULL AS found", ", trials AS (SELECT t.disease AS test_disease, p.rank") + """)
SELECT test_disease, count(*) AS trials, round(count(*) FILTER (rank <= 1) / count(*), 4) AS recall_at_1, round(count(*) FILTER (rank <= 5) / count(*), 4) AS recall_at_5,
  round(count(*) FILTER (rank <= 10) / count(*), 4) AS recall_at_10, round(sum(coalesce(CAST(round(1000000 / rank) AS bigint), 0)) / count(*) / 1000000, 4) AS mrr FROM trials GROUP BY test_disease""")
def recovery_summary(g: Graph) -> DataFrame:
    def at(k):
        return F.round(F.count(F.when(F.col("rank") <= k, 1)) / F.count("*"), 4).alias(f"recall_at_{k}")

    mrr = F.sum(F.coalesce(F.round(F.lit(1_000_000) / F.col("rank")).cast("long"), F.lit(0))) / F.count("*") / 1_000_000
    return held_out_recovery(g).groupBy("test_disease").agg(F.count("*").alias("trials"), at(1), at(5), at(10), F.round(mrr, 4).alias("mrr"))


@entry("iq08_known_treats_profile", """
SELECT c.inchikey, string_agg(d.name || ':' || k.clinical_phase, ';' ORDER BY d.name) AS treats FROM known k JOIN compound c ON c.compound_id = k.src JOIN disease d ON d.disease_id = k.dst GROUP BY c.inchikey""")
def known_treats_profile(g: Graph) -> DataFrame:
    rows = P.edge(g.known, "compound_id", "disease_id", phase="clinical_phase").join(P.node(g.disease, "disease_id", "disease_id", disease="name"), "disease_id")
    text = F.transform(F.array_sort(F.collect_list(F.struct("disease", "phase"))), lambda x: F.concat_ws(":", x["disease"], x["phase"].cast("string")))
    return P.with_compound(g, rows.groupBy("compound_id").agg(F.array_join(text, ";").alias("treats")), inchikey="inchikey").select("inchikey", "treats")


@entry("iq09_target_genericity_sample", """
SELECT target_id, count(*) AS disease_count, array_to_string(list(name ORDER BY name)[1:10], ';') AS sample FROM (SELECT DISTINCT r.src AS target_id, d.name FROM relates r JOIN disease d ON d.disease_id = r.dst) GROUP BY target_id""")
def target_genericity_sample(g: Graph) -> DataFrame:
    rows = P.target_diseases(g).join(P.node(g.disease, "disease_id", "disease_id", disease="name"), "disease_id")
    return rows.groupBy("target_id").agg(
        F.count_distinct("disease").alias("disease_count"), F.array_join(F.slice(F.array_sort(F.collect_set("disease")), 1, 10), ";").alias("sample"))


@entry("iq10_target_spectrum", """
SELECT inchikey, target, pchembl, pos, total FROM (SELECT c.inchikey, t.name AS target, round(tg.pchembl, 6) AS pchembl, count(*) OVER (PARTITION BY c.inchikey) AS total,
  row_number() OVER (PARTITION BY c.inchikey ORDER BY CASE tg.evidence_type WHEN 'chembl_mechanism' THEN 0 WHEN 'chembl_activity_strong' THEN 1 WHEN 'chembl_activity_moderate' THEN 2 WHEN 'chembl_activity_weak' THEN 3 ELSE 4 END, tg.pchembl DESC, tg.dst) AS pos
  FROM targets tg JOIN compound c ON c.compound_id = tg.src JOIN target t ON t.target_id = tg.dst) WHERE pos <= 5""")
def target_spectrum(g: Graph, keep: int = 5) -> DataFrame:
    """A compound's best targets: mechanisms, then activity strength, then potency; with the number of all."""
    order = Window.partitionBy("compound_id").orderBy(T.tier_rank(T.TGT_TIER, F.col("tgt_type")).desc(), F.desc("pchembl"), "target_id")
    rows = P.compound_targets(g).withColumn("pos", F.row_number().over(order)).withColumn("total", F.count("*").over(Window.partitionBy("compound_id")))
    return P.with_compound(g, P.with_target(g, rows.where(F.col("pos") <= keep)), inchikey="inchikey").select(
        "inchikey", "target", F.round("pchembl", 6).alias("pchembl"), "pos", "total")


@entry("iq11_convergence_in_source", """
SELECT source, target_id, n_compounds, sample FROM (SELECT s.name AS source, x.dst AS sid, tg.dst AS target_id, count(DISTINCT c.name) AS n_compounds,
  array_to_string(list(DISTINCT c.name ORDER BY c.name)[1:8], ';') AS sample, row_number() OVER (PARTITION BY x.dst ORDER BY count(DISTINCT c.name) DESC, tg.dst) AS pos
  FROM extracted x JOIN compound c ON c.compound_id = x.src JOIN targets tg ON tg.src = x.src JOIN source s ON s.source_id = x.dst GROUP BY s.name, x.dst, tg.dst HAVING count(DISTINCT c.name) >= 2) WHERE pos <= 10""")
def convergence_in_source(g: Graph, least: int = 2, keep: int = 10) -> DataFrame:
    """Targets that several compounds of one source hit, the ten widest a source."""
    rows = P.with_compound(g, P.source_compounds(g).join(P.compound_targets(g), "compound_id"))
    found = rows.groupBy("source_id", "target_id").agg(F.array_sort(F.collect_set("compound")).alias("names")).withColumn("n_compounds", F.size("names")).where(F.col("n_compounds") >= least)
    order = Window.partitionBy("source_id").orderBy(F.desc("n_compounds"), "target_id")
    return found.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= keep).join(
        P.node(g.source, "source_id", "source_id", source="name"), "source_id").select(
        "source", "target_id", F.col("n_compounds").cast("long").alias("n_compounds"), F.array_join(F.slice("names", 1, 8), ";").alias("sample"))


@entry("iq23_planar_siblings", """
SELECT a.inchikey, count(*) AS siblings FROM compound a JOIN compound b ON substr(a.inchikey, 1, 14) = substr(b.inchikey, 1, 14) GROUP BY a.inchikey""")
def planar_siblings(g: Graph) -> DataFrame:
    """Compounds with the same planar key: counted a key, then joined, instead of a self-join."""
    keyed = g.compound.select("inchikey", F.substring("inchikey", 1, 14).alias("planar"))
    return keyed.join(keyed.groupBy("planar").agg(F.count("*").alias("siblings")), "planar").select("inchikey", "siblings")


@entry("iq27_breadth", """
SELECT s.name AS source, c.inchikey, count(DISTINCT tg.dst) AS n_targets FROM extracted x JOIN source s ON s.source_id = x.dst JOIN compound c ON c.compound_id = x.src LEFT JOIN targets tg ON tg.src = x.src
WHERE NOT coalesce(s.archived, false) GROUP BY s.name, c.inchikey ORDER BY n_targets DESC, source, inchikey LIMIT 100""")
def breadth(g: Graph, limit: int = 100) -> DataFrame:
    """Compounds of active sources by their number of targets; the limit is over all sources."""
    rows = P.source_compounds(g).join(P.node(active(g.source), "source_id", "source_id", source="name"), "source_id")
    counts = P.compound_targets(g).groupBy("compound_id").agg(F.count_distinct("target_id").alias("n_targets"))
    rows = P.with_compound(g, rows, inchikey="inchikey").join(counts, "compound_id", "left")
    return rows.select("source", "inchikey", F.coalesce("n_targets", F.lit(0)).alias("n_targets")).orderBy(F.desc("n_targets"), "source", "inchikey").limit(limit)


@entry("iq28_sources_with_compounds", """
SELECT s.name AS source, count(DISTINCT c.name) AS n_compounds, array_to_string(list(DISTINCT c.name ORDER BY c.name)[1:50], ';') AS compounds
FROM extracted x JOIN source s ON s.source_id = x.dst JOIN compound c ON c.compound_id = x.src WHERE NOT coalesce(s.archived, false) GROUP BY s.name""")
def sources_with_compounds(g: Graph) -> DataFrame:
    rows = P.with_compound(g, P.source_compounds(g).join(P.node(active(g.source), "source_id", "source_id", source="name"), "source_id"))
    names = F.array_sort(F.collect_set("compound"))
    return rows.groupBy("source").agg(F.count_distinct("compound").alias("n_compounds"), F.array_join(F.slice(names, 1, 50), ";").alias("compounds"))


@entry("iq30_sources_with_closed_loop", """
SELECT DISTINCT s.name AS source FROM source s JOIN treats tt ON tt.src = s.source_id JOIN maps mp ON mp.src = tt.dst JOIN extracted x ON x.dst = s.source_id
JOIN targets tg ON tg.src = x.src JOIN relates r ON r.src = tg.dst AND r.dst = mp.dst WHERE NOT coalesce(s.archived, false)""")
def sources_with_closed_loop(g: Graph) -> DataFrame:
    """Sources with a loop over any mapping, primary or not."""
    wanted = P.edge(g.treats, "source_id", "malady").join(P.edge(g.maps, "malady", "disease_id"), "malady").select("source_id", "disease_id").distinct()
    asked = wanted.join(P.source_compounds(g).select("source_id", "compound_id"), "source_id")
    met = asked.join(P.compound_diseases(g), ["compound_id", "disease_id"], "left_semi").select("source_id")
    return active(g.source).join(met, "source_id", "left_semi").select(F.col("name").alias("source"))


@entry("iq32_closed_loop_compounds", """
SELECT DISTINCT s.name AS source, c.inchikey FROM source s JOIN treats tt ON tt.src = s.source_id JOIN maps mp ON mp.src = tt.dst AND coalesce(mp.is_primary, true)
JOIN extracted x ON x.dst = s.source_id JOIN compound c ON c.compound_id = x.src JOIN targets tg ON tg.src = x.src JOIN relates r ON r.src = tg.dst AND r.dst = mp.dst""")
def closed_loop_compounds(g: Graph) -> DataFrame:
    wanted = P.edge(g.treats, "source_id", "malady").join(P.mapped(g), "malady").select("source_id", "disease_id").distinct()
    asked = wanted.join(P.source_compounds(g).select("source_id", "compound_id"), "source_id")
    met = asked.join(P.compound_diseases(g), ["compound_id", "disease_id"], "left_semi").select("source_id", "compound_id").distinct()
    return P.with_compound(g, met, inchikey="inchikey").join(P.node(g.source, "source_id", "source_id", source="name"), "source_id").select("source", "inchikey")


@entry("iq37_schema_summary", """
SELECT 'node' AS kind, 'source' AS name, count(*) AS n FROM source UNION ALL SELECT 'node', 'compound', count(*) FROM compound UNION ALL SELECT 'node', 'target', count(*) FROM target
UNION ALL SELECT 'node', 'malady', count(*) FROM malady UNION ALL SELECT 'node', 'disease', count(*) FROM disease UNION ALL SELECT 'node', 'preparation', count(*) FROM preparation
UNION ALL SELECT 'edge', 'extracted', count(*) FROM extracted UNION ALL SELECT 'edge', 'treats', count(*) FROM treats UNION ALL SELECT 'edge', 'maps', count(*) FROM maps
UNION ALL SELECT 'edge', 'targets', count(*) FROM targets UNION ALL SELECT 'edge', 'relates', count(*) FROM relates UNION ALL SELECT 'edge', 'known', count(*) FROM known UNION ALL SELECT 'edge', 'prepared', count(*) FROM prepared""")
def schema_summary(g: Graph) -> DataFrame:
    rows = None
    for kind, tables in (("node", g.nodes), ("edge", g.edges)):
        for name, df in tables.items():
            one = df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), F.lit(name).alias("name"), "n")
            rows = one if rows is None else rows.union(one)
    return rows
