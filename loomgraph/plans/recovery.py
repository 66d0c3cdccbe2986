"""What leads recover of a malady's known sources and compounds, beside a baseline that knows no paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators import checks
from loomgraph.operators import paths as P
from loomgraph.operators import recovery as R
from loomgraph.operators.ranking import placed
from loomgraph.plans import review, validate
from loomgraph.plans.registry import Registry
from loomgraph.plans.review import CASE_SQL, LADDER_SQL, LEAD_SQL
from loomgraph.sources.projection import Graph, active
from loomgraph.sources.snapshots import stored

ENTRIES = Registry()
entry = ENTRIES.entry

ARMS = ("kg", "base")
#: a baseline takes a claim as it is told, from this confidence on
TOLD = 0.98

GOLD_SQL = """
, goldc AS (SELECT DISTINCT a.malady AS region, a.source, c.inchikey AS compound FROM anchor a JOIN maps mp ON mp.src = a.malady AND coalesce(mp.is_primary, true) JOIN disease d ON d.disease_id = mp.dst AND NOT coalesce(d.archived, false)
    JOIN extracted x ON x.dst = a.source_id JOIN compound c ON c.compound_id = x.src AND NOT coalesce(c.archived, false) JOIN targets tg ON tg.src = x.src JOIN relates r ON r.src = tg.dst AND r.dst = mp.dst)
"""


def gold_compounds(g: Graph) -> DataFrame:
    """(region, source, compound): compounds of a claim's source that close the claim's loop."""
    live = P.node(active(g.compound), "compound_id", "compound_id", compound="inchikey")
    rows = P.closed_paths(g).select("malady", "source", "compound_id").distinct().join(live, "compound_id")
    return rows.select(F.col("malady").alias("region"), "source", "compound").distinct()


def held_compounds(g: Graph) -> DataFrame:
    """(region, source, compound, tt, ex): what the sources of a malady's claims hold."""
    live = P.node(active(g.compound), "compound_id", "compound_id", compound="inchikey")
    rows = P.claims(g).join(P.source_compounds(g), "source_id").join(live, "compound_id")
    return rows.select(F.col("malady").alias("region"), "source", "compound", "tt", "ex")


def _sum_sql(template: str) -> str:
    return ", ".join(template.format(k=k) for k in R.DEPTHS)


def _wide_sql() -> str:
    ratios = {"src_precision": "tp / nullif(n_named, 0)", "src_recall": "tp / nullif(n_sources, 0)", "src_f1": "2 * tp / nullif(n_named + n_sources, 0)"}
    ratios |= {f"src_recall_{k}": f"h{k} / nullif(n_sources, 0)" for k in R.DEPTHS} | {f"comp_recall_{k}": f"g{k} / nullif(ng, 0)" for k in R.DEPTHS}
    ratios |= {"comp_f1_10": "CASE WHEN g10 > 0 THEN 2 * (g10 / 10) * (g10 / ng) / (g10 / 10 + g10 / ng) END"} | {f"comp_all_recall_{k}": f"a{k} / nullif(na, 0)" for k in R.DEPTHS}
    ratios |= {f"strict_recall_{k}": f"s{k} / 1000000 / nullif(n_sources, 0)" for k in R.DEPTHS} | {"mean_score": "mean_score", "brier": "brier"}
    return ", ".join(f"round(coalesce(max({v}) FILTER (arm = '{arm}'), 0), 6) AS {arm}_{name}" for arm in ARMS for name, v in ratios.items())


@entry("ev08_region_rows", LEAD_SQL + GOLD_SQL + f"""
, held_c AS (SELECT a.malady AS region, a.source, c.inchikey AS compound, a.tt, x.confidence AS ex FROM anchor a JOIN extracted x ON x.dst = a.source_id JOIN compound c ON c.compound_id = x.src AND NOT coalesce(c.archived, false))
, other AS (SELECT region, compound FROM held_c WHERE (region, source) NOT IN (SELECT (region, source) FROM goldc))
, preds AS (SELECT malady AS region, 'kg' AS arm, source, lead AS compound, score FROM leads UNION ALL SELECT region, 'base', source, compound, round(tt * ex, 6) FROM held_c WHERE tt >= {TOLD}::double)
, best_of AS (SELECT r.malady AS region, r.source, coalesce(max(l.score), 0) AS best FROM reviewed r LEFT JOIN leads l ON l.malady = r.malady AND l.source = r.source GROUP BY ALL)
, named AS (SELECT region, 'kg' AS arm, source, row_number() OVER (PARTITION BY region ORDER BY best DESC, source) AS pos FROM best_of UNION ALL SELECT malady, 'base', source, row_number() OVER (PARTITION BY malady ORDER BY tt DESC, source) FROM anchor WHERE tt >= {TOLD}::double)
, gs AS (SELECT DISTINCT region, source FROM goldc), ns AS (SELECT region, count(*) AS n_sources FROM gs GROUP BY region)
, sm AS (SELECT n.region, arm, count(*) AS n_named, count(gs.source) AS tp, {_sum_sql("count(gs.source) FILTER (pos <= {k}) AS h{k}")} FROM named n LEFT JOIN gs ON gs.region = n.region AND gs.source = n.source GROUP BY n.region, arm)
, al AS (SELECT region, compound, max(g) AS g FROM (SELECT region, compound, 1 AS g FROM goldc UNION ALL SELECT region, compound, 0 FROM other) GROUP BY ALL), sz AS (SELECT region, sum(g) AS ng, count(*) AS na FROM al GROUP BY region)
, fp AS (SELECT region, arm, compound, min(place) AS place FROM (SELECT *, row_number() OVER (PARTITION BY region, arm ORDER BY score DESC, compound, source) AS place FROM preds) WHERE place <= 10 GROUP BY ALL)
, cm AS (SELECT region, arm, {_sum_sql("count(*) FILTER (place <= {k} AND g = 1) AS g{k}, count(*) FILTER (place <= {k} AND g IS NOT NULL) AS a{k}")} FROM fp LEFT JOIN al USING (region, compound) GROUP BY ALL)
, att AS (SELECT region, arm, source, compound, place FROM (SELECT *, row_number() OVER (PARTITION BY region, arm, source ORDER BY score DESC, compound) AS place FROM preds) JOIN goldc USING (region, source, compound) WHERE place <= 10)
, st AS (SELECT region, arm, source, {_sum_sql("count(*) FILTER (place <= {k}) / n AS r{k}")} FROM att JOIN (SELECT region, source, count(*) AS n FROM goldc GROUP BY ALL) USING (region, source) GROUP BY region, arm, source, n)
, ss AS (SELECT region, arm, {_sum_sql("sum(CAST(round(r{k} * 1000000) AS bigint)) AS s{k}")} FROM st GROUP BY ALL)
, br AS (SELECT p.region, arm, sum(CAST(round(score * 1000000) AS bigint))::double / count(*) / 1000000 AS mean_score, sum(CAST(round(pow(greatest(0, least(1, score)) - CASE WHEN g.compound IS NULL THEN 0 ELSE 1 END, 2) * 1000000) AS bigint))::double / count(*) / 1000000 AS brier
    FROM preds p LEFT JOIN goldc g ON g.region = p.region AND g.source = p.source AND g.compound = p.compound GROUP BY p.region, arm)
, both_arms AS (SELECT region, compound, max(score) FILTER (arm = 'kg') AS a, max(score) FILTER (arm = 'base') AS b FROM preds GROUP BY ALL HAVING a IS NOT NULL AND b IS NOT NULL)
, rk AS (SELECT region, row_number() OVER (PARTITION BY region ORDER BY a, compound) - row_number() OVER (PARTITION BY region ORDER BY b, compound) AS d FROM both_arms)
, sp AS (SELECT region, count(*) AS n_shared, CASE WHEN count(*) < 2 THEN 0 ELSE round(1 - 6 * sum(d * d)::double / (count(*)::double * (count(*)::double * count(*) - 1)), 6) END AS spearman_shared FROM rk GROUP BY region)
, rv AS (SELECT malady AS region, count(*) AS n_pass1, count(*) FILTER (NOT skipped) AS n_pass2, coalesce(sum(CAST(round(plausibility * 1000000) AS bigint)) FILTER (NOT skipped)::double / nullif(count(*) FILTER (NOT skipped), 0) / 1000000, 0) AS kg_plausibility FROM reviewed GROUP BY malady)
, lw AS (SELECT malady AS region, count(*) FILTER (way = 0) AS n_critic_leads, count(*) FILTER (way = 1) AS n_path_leads, count(*) FILTER (way = 2) AS n_breadth_leads FROM leads GROUP BY malady)
, measures AS (SELECT * FROM (SELECT region, unnest(['kg', 'base']) AS arm FROM rv) LEFT JOIN sm USING (region, arm) LEFT JOIN cm USING (region, arm) LEFT JOIN ss USING (region, arm) LEFT JOIN br USING (region, arm) LEFT JOIN sz USING (region) LEFT JOIN ns USING (region))
, wide AS (SELECT region, {_wide_sql()} FROM measures GROUP BY region)
SELECT rv.region, n_pass1, n_pass2, round(rv.kg_plausibility, 6) AS kg_plausibility, coalesce(n_critic_leads, 0) AS n_critic_leads, coalesce(n_path_leads, 0) AS n_path_leads, coalesce(n_breadth_leads, 0) AS n_breadth_leads,
  coalesce(n_sources, 0) AS n_gold_sources, coalesce(ng, 0)::bigint AS n_gold_compounds, coalesce(na, 0) AS n_all_compounds, (coalesce(na, 0) - coalesce(ng, 0))::bigint AS n_distractor_compounds, wide.* EXCLUDE (region), coalesce(n_shared, 0) AS n_shared,
  coalesce(spearman_shared, 0)::double AS spearman_shared, round(round(rv.kg_plausibility, 6) - base_mean_score, 6) AS plausibility_delta
FROM rv JOIN wide USING (region) LEFT JOIN lw USING (region) LEFT JOIN ns USING (region) LEFT JOIN sz USING (region) LEFT JOIN sp USING (region)""")
def region_rows(g: Graph) -> DataFrame:
    """Every measure of a malady: sources and compounds recovered by leads and by a baseline that takes confident claims and
    what their sources hold as they are, plausibility, calibration, what both name, and where leads come from."""
    opinions = review.opinions_of(g)
    leads = stored(review.leads(g, opinions), "leads")
    gold = stored(gold_compounds(g), "gold")
    held = held_compounds(g)
    others = held.join(gold.select("region", "source").distinct(), ["region", "source"], "left_anti").select("region", "source", "compound")
    told = F.col("tt") >= TOLD
    base = held.where(told).select("region", F.lit("base").alias("arm"), "source", "compound", F.round(F.col("tt") * F.col("ex"), 6).alias("score"))
    predicted = stored(leads.select(F.col("malady").alias("region"), F.lit("kg").alias("arm"), "source", F.col("lead").alias("compound"), "score").unionByName(base), "predicted")
    best = opinions.select("malady", "source").join(leads.groupBy("malady", "source").agg(F.max("score").alias("best")), ["malady", "source"], "left").fillna(0.0, ["best"])
    sources = best.select(F.col("malady").alias("region"), F.lit("kg").alias("arm"), "source", "best").unionByName(
        P.claims(g).where(told).select(F.col("malady").alias("region"), F.lit("base").alias("arm"), "source", F.col("tt").alias("best")))
    named = placed(sources, ["region", "arm"], [F.desc("best"), F.col("source")], "pos")
    live = F.when(~F.col("skipped"), F.col("plausibility"))
    regions = opinions.groupBy(F.col("malady").alias("region")).agg(
        F.count("*").alias("n_pass1"), F.count_if(~F.col("skipped")).alias("n_pass2"), R.mean_micro(live).alias("kg_plausibility"))
    ways = leads.groupBy(F.col("malady").alias("region")).agg(*[F.count_if(F.col("way") == i).alias(n) for i, n in enumerate(("n_critic_leads", "n_path_leads", "n_breadth_leads"))])
    regions = regions.join(ways, "region", "left").fillna(0, ["n_critic_leads", "n_path_leads", "n_breadth_leads"])
    rows = R.region_rows(regions, named, predicted, gold, others, [F.desc("score"), F.col("compound"), F.col("source")], ARMS)
    rows = rows.withColumn("plausibility_delta", F.round("kg_plausibility", 6) - F.round("base_mean_score", 6)).drop("score_delta")
    return rows.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes])


NUMBER_SQL = "CASE substr(h, {i}, 1) WHEN 'a' THEN '1.7' WHEN 'b' THEN 'n/a' ELSE '0.' || (strpos('0123456789cdef', substr(h, {i}, 1)) % 10) END"
FAIL_SQL = "CASE TRY_CAST({f} AS double) IS NULL WHEN true THEN '{f}=' || {f} || ' not a number' ELSE CASE WHEN TRY_CAST({f} AS double) NOT BETWEEN 0 AND 1 THEN '{f}=' || {f} || ' out of [0,1]' END END"


@entry("ev17_all_checks", CASE_SQL + f"""
, topc AS (SELECT source, malady, inchikey FROM (SELECT *, row_number() OVER (PARTITION BY source_id, malady ORDER BY (NOT (has_target AND has_disease)), (NOT loop_closed), rank DESC, path_score DESC,
    inchikey, target_id NULLS FIRST, reached_disease NULLS FIRST) AS pos FROM claim_paths WHERE inchikey IS NOT NULL) WHERE pos <= 5)
, bad AS (SELECT source, malady, count(*) AS n FROM topc WHERE substr(md5(inchikey), 1, 1) < '4' GROUP BY ALL)
, answers AS (SELECT c.*, {NUMBER_SQL.format(i=5)} AS biological_plausibility, {NUMBER_SQL.format(i=6)} AS evidence_coherence, substr(h, 7, 1) < '2' AS no_concerns, substr(h, 8, 1) = 'f' AS no_review, substr(h, 9, 1) < '4' AS agrees,
    CASE WHEN condition = 'kg_critic' THEN coalesce(b.n, 0) ELSE 0 END AS unknown, {LADDER_SQL.format('opinion')} - {LADDER_SQL.format('pass1')} AS step FROM cases c LEFT JOIN bad b USING (source, malady))
, failed AS (SELECT *, concat_ws('; ', {FAIL_SQL.format(f='biological_plausibility')}, {FAIL_SQL.format(f='evidence_coherence')}) AS range_fails FROM answers)
SELECT case_id, NOT (no_concerns OR no_review) AS schema_ok, concat_ws(',', CASE WHEN no_concerns THEN 'concerns' END, CASE WHEN no_review THEN 'requires_human_review' END) AS missing, range_fails = '' AS ranges_ok, range_fails,
  unknown = 0 AS citations_ok, unknown, NOT (contains(lower(rationale), 'loop closes') AND paths_loop_closed = 0) AS loop_ok, NOT ((stated <> step AND stated <> 0) OR (agrees AND step <> 0)) AS delta_ok FROM failed""")
def all_checks(g: Graph) -> DataFrame:
    """Every check of graded cases' answers; what an answer says that no plan derives comes from the digest of its claim."""
    def number(i: int):
        d = review.digit(F.col("h"), i)
        return F.when(d == "a", "1.7").when(d == "b", "n/a").otherwise(F.concat(F.lit("0."), F.pmod(F.instr(F.lit("0123456789cdef"), d), F.lit(10)).cast("string")))

    cases = stored(review.cases(g), "cases")
    tops = stored(validate.top_paths(g).join(cases.select("source", "malady").distinct(), ["source", "malady"], "left_semi").select(
        "source", "malady", "pos", "inchikey", "target_id", "reached_disease"), "shown")
    wrong = F.substring(F.md5(F.col("inchikey").cast("binary")), 1, 1) < "4"
    said = F.when(wrong, F.concat("inchikey", F.lit("x"))).otherwise(F.col("inchikey"))
    evidence = tops.groupBy("source", "malady").agg(F.collect_list(F.struct(said.alias("compound"), F.col("target_id").alias("target"), "reached_disease")).alias("key_evidence"))
    h = F.col("h")
    answers = cases.join(evidence, ["source", "malady"], "left").select(
        "case_id", "pass1", "paths_loop_closed", (F.col("condition") == "kg_critic").alias("has_payload"), F.col("opinion").alias("verdict"),
        number(5).alias("biological_plausibility"), number(6).alias("evidence_coherence"),
        F.coalesce("key_evidence", F.array().cast("array<struct<compound:string,target:string,reached_disease:string>>")).alias("key_evidence"),
        F.when(review.digit(h, 7) >= "2", F.array(F.lit("by rule"))).alias("concerns"), "rationale", F.when(review.digit(h, 8) != "f", review.digit(h, 8) < "8").alias("requires_human_review"),
        F.col("stated").alias("verdict_delta"), (review.digit(h, 9) < "4").alias("agrees_with_pass1"))
    kinds = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(c).alias("name")) for c, kind in (("inchikey", "compound"), ("target_id", "target"), ("reached_disease", "disease"))])
    shown = cases.select("case_id", "source", "malady").join(tops, ["source", "malady"]).select("case_id", F.inline(kinds))
    return checks.checked(answers, shown)
