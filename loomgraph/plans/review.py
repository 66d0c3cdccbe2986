"""Reviews of verdicts and their grading: second opinions, enrichment, leads, cases, checks and summaries.

What a language model or a judge would answer is derived from hashes of the case, so that both engines know it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import tiers as T
from loomgraph.operators import metrics
from loomgraph.operators import paths as P
from loomgraph.operators.ranking import placed
from loomgraph.plans import validate
from loomgraph.plans.linkers import STRATA_SQL, stratified_claims
from loomgraph.plans.registry import Registry
from loomgraph.plans.validate import PATH_SQL
from loomgraph.sources.projection import Graph, active
from loomgraph.sources.snapshots import stored

ENTRIES = Registry()
entry = ENTRIES.entry

# fixed values: verdicts that leave a reviewer nothing to look at
NOT_ACTIONABLE = ("claim_not_found", "traditional_only", "mechanistic_only")

LADDER_SQL = "CASE {} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in T.VERDICT_LADDER.items()) + " ELSE -1 END"
OPINION_SQL = PATH_SQL + f"""
, seen AS (SELECT *, md5(source || '|' || malady) AS h FROM verdicts)
, opinions AS (SELECT *, CASE WHEN substr(h, 1, 1) BETWEEN '0' AND '3' THEN 'unsupported' WHEN substr(h, 1, 1) BETWEEN '4' AND '7' THEN 'moderate_support' WHEN substr(h, 1, 1) IN ('8', '9') THEN 'odd words' ELSE verdict END AS opinion,
    CASE WHEN substr(h, 2, 1) BETWEEN '0' AND '9' THEN '0.' || substr(h, 2, 1) WHEN substr(h, 2, 1) = 'a' THEN '1.7' ELSE 'n/a' END AS said, verdict IN {NOT_ACTIONABLE} AS skipped FROM seen)
, reviewed AS (SELECT source, malady, verdict AS pass1, CASE WHEN skipped THEN verdict ELSE opinion END AS pass2, skipped,
    CASE WHEN skipped THEN 0 ELSE {LADDER_SQL.format('opinion')} - {LADDER_SQL.format('verdict')} END AS delta,
    CASE WHEN skipped THEN 0 ELSE least(1, greatest(0, coalesce(TRY_CAST(said AS double), 0))) END::double AS plausibility, h, top_bucket, paths_loop_closed, path_count FROM opinions)
"""


def digit(h: Column, i: int) -> Column:
    return F.substring(h, i, 1)


def reviewed(g: Graph) -> DataFrame:
    """A second opinion beside each verdict: rungs between the two, whether they agree, plausibility forced into 0 to 1;
    verdicts that leave nothing to review are passed on."""
    rows = validate.verdicts(g).withColumn("h", F.md5(F.concat_ws("|", "source", "malady").cast("binary")))
    first, second = digit(F.col("h"), 1), digit(F.col("h"), 2)
    opinion = F.when(first.between("0", "3"), "unsupported").when(first.between("4", "7"), "moderate_support").when(first.isin("8", "9"), "odd words").otherwise(F.col("verdict"))
    said = F.when(second.between("0", "9"), F.concat(F.lit("0."), second)).when(second == "a", "1.7").otherwise("n/a")
    skipped = F.col("verdict").isin(*NOT_ACTIONABLE)
    return rows.select(
        "source", "malady", F.col("verdict").alias("pass1"), F.when(skipped, F.col("verdict")).otherwise(opinion).alias("pass2"), skipped.alias("skipped"),
        F.when(skipped, 0).otherwise(T.verdict_delta(opinion, F.col("verdict"))).alias("delta"), F.when(skipped, 0.0).otherwise(T.clamp01(said)).alias("plausibility"),
        "h", "top_bucket", "paths_loop_closed", "path_count")


@entry("ta08_second_opinions", OPINION_SQL + "SELECT source, malady, pass1, pass2, skipped, delta, delta = 0 AS agrees, plausibility FROM reviewed")
def second_opinions(g: Graph) -> DataFrame:
    return reviewed(g).select("source", "malady", "pass1", "pass2", "skipped", "delta", (F.col("delta") == 0).alias("agrees"), "plausibility")


@entry("ta08_review_summary", OPINION_SQL + """
SELECT count(*) AS verdicts_in, count(*) FILTER (NOT skipped) AS critiqued, count(*) FILTER (skipped) AS skipped, round(coalesce(count(*) FILTER (NOT skipped AND delta = 0) / nullif(count(*) FILTER (NOT skipped), 0), 0), 3) AS agreement_rate,
  count(*) FILTER (abs(delta) >= 1) AS one_rung, count(*) FILTER (abs(delta) >= 2) AS two_rungs FROM reviewed""")
def review_summary(g: Graph) -> DataFrame:
    live, d = ~F.col("skipped"), F.abs("delta")
    rate = F.coalesce(F.count_if(live & (d == 0)) / F.nullif(F.count_if(live), F.lit(0)), F.lit(0.0))
    return reviewed(g).agg(
        F.count("*").alias("verdicts_in"), F.count_if(live).alias("critiqued"), F.count_if(~live).alias("skipped"), F.round(rate, 3).alias("agreement_rate"),
        F.count_if(d >= 1).alias("one_rung"), F.count_if(d >= 2).alias("two_rungs"))


@entry("ta10_sibling_verdicts", OPINION_SQL + """
, current AS (SELECT source, malady, pass2 AS verdict FROM reviewed WHERE delta <> 0), standing AS (SELECT v.source, v.malady, coalesce(c.verdict, v.verdict) AS verdict FROM verdicts v LEFT JOIN current c USING (source, malady))
SELECT s.name AS source, t.dst AS malady, coalesce(k.verdict, 'not_yet_validated') AS verdict FROM treats t JOIN source s ON s.source_id = t.src LEFT JOIN standing k ON k.source = s.name AND k.malady = t.dst""")
def sibling_verdicts(g: Graph) -> DataFrame:
    """The verdict that stands beside each claim, archived or not: the newest run's where it has one, else the full run's,
    else that there is none yet."""
    rows = reviewed(g)
    newest = rows.where("delta <> 0").select("source", "malady", F.lit(0).alias("age"), F.col("pass2").alias("verdict"))
    both = newest.unionByName(rows.select("source", "malady", F.lit(1).alias("age"), F.col("pass1").alias("verdict")))
    known = both.groupBy("source", "malady").agg(F.min(F.struct("age", "verdict")).alias("b")).select("source", "malady", F.col("b.verdict").alias("verdict"))
    claims = P.edge(g.treats, "source_id", "malady").join(P.node(g.source, "source_id", "source_id", source="name"), "source_id")
    return claims.join(known, ["source", "malady"], "left").select("source", "malady", F.coalesce("verdict", F.lit("not_yet_validated")).alias("verdict"))


@entry("ta06_enrichment_sizes", PATH_SQL + """
, claimed AS (SELECT s.source_id, s.name AS source, t.dst AS malady FROM treats t JOIN source s ON s.source_id = t.src JOIN malady m ON m.name = t.dst WHERE NOT coalesce(s.archived, false) AND NOT coalesce(m.archived, false))
, tg AS (SELECT x.dst AS source_id, count(DISTINCT t.dst) AS targets FROM extracted x JOIN targets t ON t.src = x.src GROUP BY x.dst)
, conv AS (SELECT source_id, count(*) AS convergent FROM (SELECT x.dst AS source_id, t.dst FROM extracted x JOIN targets t ON t.src = x.src GROUP BY x.dst, t.dst HAVING count(DISTINCT x.src) >= 2) GROUP BY source_id)
, held AS (SELECT DISTINCT x.dst AS source_id, x.src FROM extracted x), sib AS (SELECT b.source_id, b.malady, count(DISTINCT o.source_id) AS siblings FROM claimed b JOIN claimed o ON o.malady = b.malady AND o.source_id <> b.source_id
    JOIN held p ON p.source_id = b.source_id JOIN held q ON q.source_id = o.source_id AND q.src = p.src GROUP BY b.source_id, b.malady)
, others AS (SELECT source_id, count(*) - 1 AS other_maladies FROM claimed GROUP BY source_id)
SELECT b.source, b.malady, coalesce(tg.targets, 0) AS targets, coalesce(conv.convergent, 0) AS convergent, coalesce(sib.siblings, 0) AS siblings, others.other_maladies
FROM claimed b LEFT JOIN tg USING (source_id) LEFT JOIN conv USING (source_id) LEFT JOIN sib ON sib.source_id = b.source_id AND sib.malady = b.malady LEFT JOIN others USING (source_id)""")
def enrichment_sizes(g: Graph) -> DataFrame:
    """What a reviewer is told besides the paths of a claim, by how much there is of it.

    Per source: targets and those that two of its compounds hit.  Per claim: other sources of the malady that share a
    compound, by way of (malady, compound) pairs.
    """
    claims = P.claims(g).select("source_id", "source", "malady")
    hit = P.source_compounds(g).select("source_id", "compound_id").join(P.compound_targets(g).select("compound_id", "target_id"), "compound_id")
    by_target = hit.groupBy("source_id", "target_id").agg(F.count_distinct("compound_id").alias("n"))
    targets = by_target.groupBy("source_id").agg(F.count("*").alias("targets"), F.count_if(F.col("n") >= 2).alias("convergent"))
    holds = claims.select("source_id", "malady").join(P.source_compounds(g).select("source_id", "compound_id").distinct(), "source_id")
    other = holds.withColumnRenamed("source_id", "other_id")
    siblings = holds.join(other, ["malady", "compound_id"]).where("source_id <> other_id").groupBy("source_id", "malady").agg(F.count_distinct("other_id").alias("siblings"))
    others = claims.groupBy("source_id").agg((F.count("*") - 1).alias("other_maladies"))
    rows = claims.join(targets, "source_id", "left").join(siblings, ["source_id", "malady"], "left").join(others, "source_id")
    return rows.fillna(0, ["targets", "convergent", "siblings"]).select("source", "malady", "targets", "convergent", "siblings", "other_maladies")


@entry("ta07_review_payload", PATH_SQL + """
, tops AS (SELECT source, malady, string_agg(inchikey || '>' || target_id || '>' || reached_disease, ' ' ORDER BY pos) AS paths FROM (SELECT *, row_number() OVER (PARTITION BY source_id, malady ORDER BY (NOT (has_target AND has_disease)), (NOT loop_closed), rank DESC, path_score DESC,
    inchikey, target_id NULLS FIRST, reached_disease NULLS FIRST) AS pos FROM claim_paths WHERE inchikey IS NOT NULL) WHERE pos <= 5 AND has_target AND has_disease GROUP BY source, malady)
SELECT v.source, v.malady, left(sha256('{"source":"' || v.source || '","malady":"' || v.malady || '","verdict":"' || verdict || '","path_count":' || path_count || ',"paths":"' || coalesce(paths, '') || '"}'), 16) AS payload_hash
FROM verdicts v LEFT JOIN tops t USING (source, malady)""")
def review_payload(g: Graph) -> DataFrame:
    """The JSON that a reviewer is given, whole chains of the best paths only; known by the first half of its digest."""
    chain = F.concat_ws(">", "inchikey", "target_id", "reached_disease")
    tops = validate.top_paths(g).where("target_id IS NOT NULL AND reached_disease IS NOT NULL").groupBy("source", "malady").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", chain.alias("chain")))), lambda x: x["chain"]), " ").alias("paths"))
    rows = validate.verdicts(g).join(tops, ["source", "malady"], "left")
    payload = F.to_json(F.struct("source", "malady", "verdict", "path_count", F.coalesce("paths", F.lit("")).alias("paths")))
    return rows.select("source", "malady", F.left(F.sha2(payload, 256), F.lit(16)).alias("payload_hash"))


@entry("ta09_concerns", PATH_SQL + """
SELECT source, malady, CASE WHEN primary_mapping_quality = 'missing' THEN 'no mapping;' WHEN primary_mapping_quality = 'silver' THEN 'approximate mapping;' ELSE '' END || CASE WHEN path_count > 0 AND paths_with_target = 0 THEN 'no targets;' ELSE '' END
  || CASE WHEN path_count > 0 AND paths_loop_closed = 0 THEN 'no closed loop;' ELSE '' END || CASE WHEN top_bucket IN ('wood', 'unrated') THEN 'weak evidence;' ELSE '' END
  || CASE WHEN n_gold > 0 AND paths_loop_closed = 0 THEN 'gold elsewhere;' ELSE '' END AS concerns,
  primary_mapping_quality = 'silver' OR (n_gold > 0 AND paths_loop_closed = 0) OR verdict = 'moderate_support' AS needs_review FROM verdicts""")
def concerns(g: Graph) -> DataFrame:
    """Concerns by rule, in order, and whether a person should look."""
    quality, open_loop = F.col("primary_mapping_quality"), F.col("paths_loop_closed") == 0
    rules = [
        ((quality == "missing"), "no mapping;"), ((quality == "silver"), "approximate mapping;"), ((F.col("path_count") > 0) & (F.col("paths_with_target") == 0), "no targets;"),
        ((F.col("path_count") > 0) & open_loop, "no closed loop;"), (F.col("top_bucket").isin("wood", "unrated"), "weak evidence;"), ((F.col("n_gold") > 0) & open_loop, "gold elsewhere;")]
    review = (quality == "silver") | ((F.col("n_gold") > 0) & open_loop) | (F.col("verdict") == "moderate_support")
    return validate.verdicts(g).select("source", "malady", F.concat(*[F.when(test, name).otherwise("") for test, name in rules]).alias("concerns"), review.alias("needs_review"))


LEAD_SQL = OPINION_SQL + """
, tops AS (SELECT source, malady, inchikey AS lead, loop_closed, path_score, target_id, reached_disease FROM (SELECT *, row_number() OVER (PARTITION BY source_id, malady ORDER BY (NOT (has_target AND has_disease)), (NOT loop_closed), rank DESC, path_score DESC,
    inchikey, target_id NULLS FIRST, reached_disease NULLS FIRST) AS pos FROM claim_paths WHERE inchikey IS NOT NULL) WHERE pos <= 5)
, breadth AS (SELECT s.name AS source, c.inchikey AS lead, count(DISTINCT tg.dst) AS n FROM extracted x JOIN source s ON s.source_id = x.dst JOIN compound c ON c.compound_id = x.src LEFT JOIN targets tg ON tg.src = x.src WHERE NOT coalesce(s.archived, false) GROUP BY ALL)
, offers AS (SELECT t.malady, t.lead, t.source, 0 AS way, 0.5 + 0.5 * r.plausibility AS score FROM tops t JOIN reviewed r USING (source, malady) WHERE NOT r.skipped AND t.target_id IS NOT NULL AND t.reached_disease IS NOT NULL
  UNION ALL SELECT malady, lead, source, 1, least(0.5, 0.25 + 0.2 * greatest(0, least(1, path_score / 5)) + CASE WHEN loop_closed THEN 0.05 ELSE 0 END) FROM tops
  UNION ALL SELECT r.malady, b.lead, b.source, 2, least(0.25, 0.05 + 0.01 * b.n) FROM reviewed r JOIN breadth b USING (source))
, leads AS (SELECT malady, lead, source, way, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY malady, lead ORDER BY way = 2, round(score, 9) DESC, way, source) AS nth FROM offers) WHERE nth = 1)
"""


def opinions_of(g: Graph) -> DataFrame:
    """Opinions on claims, written once for plans that read them for several ends."""
    return stored(reviewed(g).select("source", "malady", "skipped", "plausibility"), "opinions")


def leads(g: Graph, opinions: DataFrame | None = None) -> DataFrame:
    """The best offer of each compound for a malady: by a reviewer (0.5 to 1), by a path (0.25 to 0.5), and only where
    neither names it by its number of targets (0.25 at most)."""
    tops = validate.top_paths(g)
    closed = F.coalesce(F.col("reached_disease") == F.col("primary_disease"), F.lit(False))
    first = validate.anchors(g).select("source", "malady", "primary_disease")
    tops = tops.join(first, ["source", "malady"]).select("source", "malady", F.col("inchikey").alias("lead"), closed.alias("closed"), "path_score", "target_id", "reached_disease")
    opinions = opinions_of(g) if opinions is None else opinions  # read for two kinds of offers
    critic = tops.where("target_id IS NOT NULL AND reached_disease IS NOT NULL").join(opinions.where("NOT skipped"), ["source", "malady"]).select(
        "malady", "lead", "source", F.lit(0).alias("way"), (0.5 + 0.5 * F.col("plausibility")).alias("score"))
    bonus = F.when(F.col("closed"), 0.05).otherwise(0.0)
    path = tops.select("malady", "lead", "source", F.lit(1).alias("way"), F.least(F.lit(0.5), 0.25 + 0.2 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("path_score") / 5)) + bonus).alias("score"))
    # what a compound is worth by its breadth hangs on the compound alone, so of the sources that offer it for a malady the
    # first counts; that is settled before the pairs are shuffled, and names and numbers are joined to what is left
    held = P.source_compounds(g).join(P.node(active(g.source), "source_id", "source_id", source="name"), "source_id").select("source", "compound_id").distinct()
    first = opinions.select("malady", "source").join(held, "source").groupBy("malady", "compound_id").agg(F.min("source").alias("source"))
    counts = P.compound_targets(g).groupBy("compound_id").agg(F.count_distinct("target_id").alias("n"))
    wide = P.with_compound(g, first.join(counts, "compound_id", "left"), lead="inchikey").select("malady", "source", "lead", F.coalesce("n", F.lit(0)).alias("n"))
    breadth = wide.select("malady", "lead", "source", F.lit(2).alias("way"), F.least(F.lit(0.25), 0.05 + 0.01 * F.col("n")).alias("score"))
    order = F.struct((F.col("way") == 2).alias("a"), (-F.round("score", 9)).alias("b"), F.col("way").alias("c"), F.col("source").alias("d"), "score")
    offers = critic.unionByName(path).unionByName(breadth)
    return offers.groupBy("malady", "lead").agg(F.min(order).alias("o")).select(
        "malady", "lead", F.col("o.d").alias("source"), F.col("o.c").alias("way"), F.round("o.score", 6).alias("score"))


ENTRIES["ev07_leads"] = (leads, LEAD_SQL + "SELECT malady, lead, source, way, score FROM leads")


@entry("ev07_ranked_sources", LEAD_SQL + """
SELECT malady, source, best, row_number() OVER (PARTITION BY malady ORDER BY best DESC, source) AS place FROM (SELECT r.malady, r.source, coalesce(max(l.score), 0) AS best FROM reviewed r LEFT JOIN leads l ON l.malady = r.malady AND l.source = r.source GROUP BY ALL)""")
def ranked_sources(g: Graph) -> DataFrame:
    best = leads(g).groupBy("malady", "source").agg(F.max("score").alias("best"))
    rows = P.claims(g).select("malady", "source").join(best, ["malady", "source"], "left").fillna(0.0, ["best"])
    return placed(rows, ["malady"], [F.desc("best"), F.col("source")])


@entry("ev06_08_recovery_rows", LEAD_SQL + """
, gold AS (SELECT DISTINCT m.src AS malady, c.inchikey AS lead FROM maps m JOIN known k ON k.dst = m.dst AND coalesce(m.is_primary, true) JOIN compound c ON c.compound_id = k.src)
, ranked AS (SELECT *, row_number() OVER (PARTITION BY malady ORDER BY score DESC, lead) AS place FROM leads)
, hit AS (SELECT g.malady, count(*) AS n_gold, count(*) FILTER (r.place <= 10) AS hits FROM gold g LEFT JOIN ranked r USING (malady, lead) GROUP BY g.malady)
SELECT l.malady, count(*) AS leads, count(*) FILTER (way = 0) AS critic_leads, count(*) FILTER (way = 1) AS path_leads, count(*) FILTER (way = 2) AS breadth_leads, coalesce(any_value(h.n_gold), 0) AS n_gold,
  round(coalesce(any_value(h.hits) / any_value(h.n_gold), 0), 6) AS recall_at_10, round(CASE WHEN any_value(h.hits) > 0 THEN 2 * (any_value(h.hits) / 10) * (any_value(h.hits) / any_value(h.n_gold)) / (any_value(h.hits) / 10 + any_value(h.hits) / any_value(h.n_gold)) ELSE 0 END, 6) AS f1_at_10,
  round(sum(CAST(round(pow(score - CASE WHEN g.lead IS NULL THEN 0 ELSE 1 END, 2) * 1000000) AS bigint))::double / count(*) / 1000000, 6) AS brier
FROM leads l LEFT JOIN gold g USING (malady, lead) LEFT JOIN hit h USING (malady) GROUP BY l.malady""")
def recovery_rows(g: Graph, k: int = 10) -> DataFrame:
    """One row of measures a malady: what its leads rest on, how many of the known compounds stand among the first k, and
    how far scores lie from the truth."""
    found = leads(g)
    gold = P.with_compound(g, P.mapped(g).join(P.edge(g.known, "compound_id", "disease_id"), "disease_id"), lead="inchikey").select("malady", "lead").distinct().withColumn("known", F.lit(1))
    rows = placed(found, ["malady"], [F.desc("score"), F.col("lead")]).join(gold, ["malady", "lead"], "left")
    total = gold.groupBy("malady").agg(F.count("*").alias("n_gold"))
    miss = F.pow(F.col("score") - F.coalesce("known", F.lit(0)), 2)
    out = rows.groupBy("malady").agg(
        F.count("*").alias("leads"), *[F.count_if(F.col("way") == i).alias(n) for i, n in enumerate(("critic_leads", "path_leads", "breadth_leads"))],
        F.count_if((F.col("place") <= k) & F.col("known").isNotNull()).alias("hits"), F.round(F.sum(P.micro(miss)) / F.count("*") / 1_000_000, 6).alias("brier")).join(total, "malady", "left")
    recall, precision = F.col("hits") / F.col("n_gold"), F.col("hits") / k
    return out.select(
        "malady", "leads", "critic_leads", "path_leads", "breadth_leads", F.coalesce("n_gold", F.lit(0)).alias("n_gold"), F.round(F.coalesce(recall, F.lit(0.0)), 6).alias("recall_at_10"),
        F.round(F.when(F.col("hits") > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0), 6).alias("f1_at_10"), "brier")


CASE_SQL = OPINION_SQL + STRATA_SQL + """
, conditions AS (SELECT unnest(['graph_only', 'kg_critic']) AS condition)
, cases AS (SELECT condition || '::' || r.source || '::' || r.malady AS case_id, condition, s.stratum, r.source, r.malady, r.pass1, r.top_bucket, r.paths_loop_closed, CASE condition WHEN 'graph_only' THEN r.pass1 ELSE r.pass2 END AS opinion,
    CASE condition WHEN 'graph_only' THEN 0 ELSE CASE WHEN substr(r.h, 3, 1) IN ('0', '1') THEN r.delta + 1 ELSE r.delta END END AS stated, CASE WHEN substr(r.h, 4, 1) < '6' THEN 'The loop closes here.' ELSE 'No loop.' END AS rationale, r.h
  FROM sampled s JOIN reviewed r USING (source, malady), conditions)
, graded AS (SELECT *, 1 + instr('0123456789abcdef', substr(md5(case_id), 1, 1)) % 5 AS score FROM cases)
"""


def cases(g: Graph) -> DataFrame:
    """Cases to grade: sampled claims under two conditions, with what each one says."""
    rows = stratified_claims(g).join(reviewed(g), ["source", "malady"])
    rows = rows.withColumn("condition", F.explode(F.array(F.lit("graph_only"), F.lit("kg_critic"))))
    alone = F.col("condition") == "graph_only"
    slip = F.when(digit(F.col("h"), 3).isin("0", "1"), F.col("delta") + 1).otherwise(F.col("delta"))
    rows = rows.select(
        F.concat_ws("::", "condition", "source", "malady").alias("case_id"), "condition", "stratum", "source", "malady", "pass1", "top_bucket", "paths_loop_closed",
        F.when(alone, F.col("pass1")).otherwise(F.col("pass2")).alias("opinion"), F.when(alone, 0).otherwise(slip).alias("stated"),
        F.when(digit(F.col("h"), 4) < "6", "The loop closes here.").otherwise("No loop.").alias("rationale"), "h")
    grade = F.instr(F.lit("0123456789abcdef"), F.substring(F.md5(F.col("case_id").cast("binary")), 1, 1)) % 5
    return rows.withColumn("score", 1 + grade)


@entry("ev17_18_checked_cases", CASE_SQL + f"""
SELECT case_id, stratum, left(sha256(opinion || '|' || rationale), 16) AS output_hash, NOT (contains(lower(rationale), 'loop closes') AND paths_loop_closed = 0) AS loop_ok,
  NOT (stated <> 0 AND stated <> {LADDER_SQL.format('opinion')} - {LADDER_SQL.format('pass1')}) AS delta_ok FROM cases""")
def checked_cases(g: Graph) -> DataFrame:
    """Checks that need no judge: a rationale may not claim a loop that isn't there, nor a step that isn't one (0 says nothing)."""
    claims_loop = F.contains(F.lower("rationale"), F.lit("loop closes"))
    step = T.verdict_delta(F.col("opinion"), F.col("pass1"))
    return cases(g).select(
        "case_id", "stratum", F.left(F.sha2(F.concat_ws("|", "opinion", "rationale"), 256), F.lit(16)).alias("output_hash"),
        (~(claims_loop & (F.col("paths_loop_closed") == 0))).alias("loop_ok"), (~((F.col("stated") != 0) & (F.col("stated") != step))).alias("delta_ok"))


@entry("ev16_hallucinated_citations", PATH_SQL + """
, cited AS (SELECT source, malady, inchikey, CASE WHEN substr(md5(inchikey), 1, 1) < '4' THEN inchikey || 'x' ELSE inchikey END AS citation FROM claim_paths WHERE inchikey IS NOT NULL)
SELECT source, malady, count(DISTINCT citation) AS cited, count(DISTINCT citation) FILTER (lower(trim(citation)) NOT IN (SELECT lower(trim(inchikey)) FROM compound)) AS unknown FROM cited GROUP BY source, malady""")
def hallucinated_citations(g: Graph) -> DataFrame:
    """Compounds that a review cites, and how many of them nothing it was shown names: a left join of the cited names."""
    seen = P.claims(g).join(P.source_compounds(g), "source_id").join(P.node(active(g.compound), "compound_id", "compound_id", inchikey="inchikey"), "compound_id")
    wrong = F.substring(F.md5(F.col("inchikey").cast("binary")), 1, 1) < "4"
    cited = seen.select("source", "malady", F.when(wrong, F.concat("inchikey", F.lit("x"))).otherwise(F.col("inchikey")).alias("citation")).distinct()
    known = g.compound.select(F.lower(F.trim("inchikey")).alias("key")).distinct().withColumn("known", F.lit(True))
    rows = cited.withColumn("key", F.lower(F.trim("citation"))).join(known, "key", "left")
    return rows.groupBy("source", "malady").agg(F.count("*").alias("cited"), F.count_if(F.col("known").isNull()).alias("unknown"))


@entry("ev19_judge_summary", CASE_SQL + """
SELECT condition, count(*) AS n, round(avg(score), 3) AS mean, median(score) AS median, quantile_cont(score, 0.25) AS q1, quantile_cont(score, 0.75) AS q3, round(stddev_pop(score), 6) AS spread,
  round(count(*) FILTER (score <= 2) / count(*), 3) AS low_rate, array_to_string(list(case_id ORDER BY score, case_id)[1:5], ';') AS lowest FROM graded GROUP BY condition""")
def judge_summary(g: Graph) -> DataFrame:
    """Mean, median, quartiles and spread of grades a condition, the share of low ones and the five lowest cases."""
    s = F.col("score")
    place = F.row_number().over(Window.partitionBy("condition").orderBy("score", "case_id"))
    rows = cases(g).withColumn("place", place)
    low = F.transform(F.array_sort(F.collect_list(F.when(F.col("place") <= 5, F.struct("place", "case_id")))), lambda x: x["case_id"])
    return rows.groupBy("condition").agg(
        F.count("*").alias("n"), F.round(F.avg(s), 3).alias("mean"), F.median(s).alias("median"), F.percentile(s, F.lit(0.25)).alias("q1"), F.percentile(s, F.lit(0.75)).alias("q3"),
        F.round(F.stddev_pop(s), 6).alias("spread"), F.round(F.count_if(s <= 2) / F.count("*"), 3).alias("low_rate"), F.array_join(low, ";").alias("lowest"))


@entry("ev19_judge_slices", CASE_SQL + """
SELECT slice, key, condition, count(*) AS n, round(avg(score), 3) AS mean FROM (SELECT 'stratum' AS slice, stratum AS key, condition, score FROM graded UNION ALL SELECT 'top_bucket', top_bucket, condition, score FROM graded
  UNION ALL SELECT 'loop', CASE WHEN top_bucket = 'gold' AND paths_loop_closed = 0 THEN 'gold_no_loop' ELSE 'other' END, condition, score FROM graded) GROUP BY ALL""")
def judge_slices(g: Graph) -> DataFrame:
    loop = F.when((F.col("top_bucket") == "gold") & (F.col("paths_loop_closed") == 0), "gold_no_loop").otherwise("other")
    keys = F.array(*[F.struct(F.lit(n).alias("slice"), c.alias("key")) for n, c in (("stratum", F.col("stratum")), ("top_bucket", F.col("top_bucket")), ("loop", loop))])
    rows = cases(g).select("condition", "score", F.explode(keys).alias("k"))
    return rows.groupBy("k.slice", "k.key", "condition").agg(F.count("*").alias("n"), F.round(F.avg("score"), 3).alias("mean"))


@entry("ev20_pairwise", CASE_SQL + """
, pairs AS (SELECT a.source || '::' || a.malady AS claim_id, md5('42|' || a.source || '|' || a.malady) < '8' AS a_first, a.score AS sa, b.score AS sb FROM graded a JOIN graded b ON b.source = a.source AND b.malady = a.malady AND a.condition = 'graph_only' AND b.condition = 'kg_critic')
SELECT claim_id, a_first, CASE WHEN sa > sb THEN 'A' WHEN sb > sa THEN 'B' ELSE 'tie' END AS preferred FROM pairs""")
def pairwise(g: Graph) -> DataFrame:
    """Two conditions of a claim side by side, shown in a random order; what the judge prefers is turned back."""
    rows = cases(g).select("source", "malady", "condition", "score")
    a, b = (rows.where(F.col("condition") == c).drop("condition").withColumnRenamed("score", n) for c, n in (("graph_only", "sa"), ("kg_critic", "sb")))
    met = a.join(b, ["source", "malady"]).withColumn("a_first", F.md5(F.concat_ws("|", F.lit("42"), "source", "malady").cast("binary")) < "8")
    shown = F.when(F.col("a_first"), F.struct(F.col("sa").alias("x"), F.col("sb").alias("y"))).otherwise(F.struct(F.col("sb").alias("x"), F.col("sa").alias("y")))
    said = F.when(shown["x"] > shown["y"], "A").when(shown["y"] > shown["x"], "B").otherwise("tie")
    back = F.when(F.col("a_first") | (said == "tie"), said).otherwise(F.when(said == "A", "B").otherwise("A"))
    return met.select(F.concat_ws("::", "source", "malady").alias("claim_id"), "a_first", back.alias("preferred"))


LEVELS = (0, 20, 40, 60, 80, 100)
SWEEP_SQL = "".join(f"""
, m{p} AS (SELECT src, CASE WHEN place > k THEN dst ELSE coalesce(lead(dst) OVER (PARTITION BY place <= k ORDER BY place), first_value(dst) OVER (PARTITION BY place <= k ORDER BY place)) END AS dst FROM (
    SELECT src, dst, row_number() OVER (ORDER BY md5('{p}' || '|' || src || '|' || dst), src, dst) AS place, round_even({p} * (SELECT count(*) FROM relates) / 100, 0) AS k FROM relates))""" for p in LEVELS) + """
, asked AS (SELECT DISTINCT s.source_id, t.dst AS malady, mp.dst AS disease_id FROM treats t JOIN source s ON s.source_id = t.src AND NOT coalesce(s.archived, false) JOIN malady m ON m.name = t.dst AND NOT coalesce(m.archived, false)
    JOIN maps mp ON mp.src = t.dst AND coalesce(mp.is_primary, true)), reach AS (SELECT DISTINCT x.dst AS source_id, tg.dst AS target_id FROM extracted x JOIN targets tg ON tg.src = x.src)
""" + " UNION ALL ".join(f"SELECT {p} AS level, count(DISTINCT (a.source_id, a.malady)) AS closed FROM asked a JOIN reach r USING (source_id) JOIN m{p} e ON e.src = r.target_id AND e.dst = a.disease_id" for p in LEVELS)


@entry("ev14_perturbation_sweep", SWEEP_SQL)
def perturbation_sweep(g: Graph) -> DataFrame:
    """How many claims still close a loop when a growing share of the target-disease edges is dealt anew."""
    asked = P.claims(g).join(P.mapped(g), "malady").select("source_id", "malady", "disease_id").distinct()
    reach = P.source_compounds(g).join(P.compound_targets(g), "compound_id").select("source_id", "target_id").distinct()
    wanted = asked.join(reach, "source_id").select("source_id", "malady", "disease_id", "target_id")
    out = None
    for level in LEVELS:
        dealt = metrics.perturb(g.relates.select("src", "dst"), level, str(level)).select(F.col("src").alias("target_id"), F.col("dst").alias("disease_id"))
        closed = wanted.join(dealt, ["target_id", "disease_id"], "left_semi").select("source_id", "malady").distinct()
        one = closed.agg(F.count("*").alias("closed")).select(F.lit(level).alias("level"), "closed")
        out = one if out is None else out.union(one)
    return out
