"""Places in groups of any size, and measures of what two arms recover, against plain rules."""

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import checks
from loomgraph.operators import recovery as R
from loomgraph.operators.ranking import placed


def test_places_are_those_of_one_sort_however_large_a_group(spark):
    rows = [("hot" if i % 3 else None if i % 2 else "cold", i * 7919 % 1000, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "grp string, score long, id long").repartition(7)
    got = {r.id: r.nth for r in placed(df, ["grp"], [F.desc("score"), F.col("id")], "nth").collect()}
    for grp in ("hot", "cold", None):
        order = sorted((r for r in rows if r[0] == grp), key=lambda r: (-r[1], r[2]))
        assert [got[r[2]] for r in order] == list(range(1, len(order) + 1))


def test_places_of_an_empty_table(spark):
    assert placed(spark.createDataFrame([], "grp string, v long"), ["grp"], [F.col("v")]).columns == ["grp", "v", "place"]
    assert placed(spark.createDataFrame([], "grp string, v long"), ["grp"], [F.col("v")]).count() == 0


GOLD = {"r": {"s1": ["a", "b", "c"], "s2": ["c", "d"]}, "none said": {"s1": ["a"]}}
OTHERS = {"r": {"s9": ["x", "a"]}, "no gold": {"s9": ["x"]}}
SAID = {  # (source, compound, score) by falling score
    ("r", "kg"): [("s1", "a", 0.9), ("s9", "x", 0.8), ("s2", "d", 0.7), ("s1", "q", 0.6), ("s1", "c", 0.5)],
    ("r", "base"): [("s9", "a", 0.95), ("s1", "a", 0.9), ("s2", "c", 0.4), ("s9", "d", 0.2)],
    ("no gold", "kg"): [("s9", "x", 0.5)],
}


def plain(region, arm, depths=(3, 5, 10)):
    """The measures of a region and arm by walking its lists."""
    gold, said = GOLD.get(region, {}), SAID.get((region, arm), [])
    known = {c for cs in gold.values() for c in cs}
    everything = known | {c for cs in OTHERS.get(region, {}).values() for c in cs}
    out = {}
    for k in depths:
        first = {c for _, c, _ in said[:k]}
        out[f"comp_recall_{k}"] = len(known & first) / len(known) if known else 0
        out[f"comp_all_recall_{k}"] = len(everything & first) / len(everything) if everything else 0
        each = [len(set(cs) & {c for s, c, _ in [x for x in said if x[0] == src][:k]}) / len(cs) for src, cs in gold.items()]
        out[f"strict_recall_{k}"] = sum(each) / len(each) if each else 0
    miss = [(p - (c in gold.get(s, []))) ** 2 for s, c, p in said]
    out["brier"] = sum(miss) / len(miss) if miss else 0
    sources = list(dict.fromkeys(s for s, _, _ in said))
    tp = len(set(sources) & set(gold))
    out["src_precision"], out["src_recall"] = tp / len(sources) if sources else 0, tp / len(gold) if gold else 0
    out["src_recall_3"] = len(set(sources[:3]) & set(gold)) / len(gold) if gold else 0
    return out


def test_measures_are_those_of_plain_lists(spark):
    gold = [(r, s, c) for r, by in GOLD.items() for s, cs in by.items() for c in cs] * 2  # repeated rows say nothing new
    others = [(r, s, c) for r, by in OTHERS.items() for s, cs in by.items() for c in cs]
    said = [(r, arm, *x) for (r, arm), xs in SAID.items() for x in xs]
    named = [(r, arm, i + 1, s) for (r, arm), xs in SAID.items() for i, s in enumerate(dict.fromkeys(x[0] for x in xs))]
    regions = spark.createDataFrame([("r",), ("none said",), ("no gold",), ("empty",)], "region string")
    triple = "region string, source string, compound string"
    rows = R.region_rows(
        regions, spark.createDataFrame(named, "region string, arm string, pos int, source string"),
        spark.createDataFrame(said, "region string, arm string, source string, compound string, score double"), spark.createDataFrame(gold, triple),
        spark.createDataFrame(others, triple), [F.desc("score"), F.col("compound")], ("kg", "base")).collect()
    assert {r.region for r in rows} == {"r", "none said", "no gold", "empty"}
    for row in rows:
        for arm in ("kg", "base"):
            for name, value in plain(row.region, arm).items():
                assert row[f"{arm}_{name}"] == pytest.approx(value, abs=1e-6), (row.region, arm, name)
    r = next(r for r in rows if r.region == "r")
    assert (r.n_gold_sources, r.n_gold_compounds, r.n_all_compounds, r.n_distractor_compounds) == (2, 4, 5, 1)
    # a, c and d are named by both; best scores 0.9, 0.5, 0.7 beside 0.95, 0.4, 0.2
    assert (r.n_shared, r.spearman_shared) == (3, 0.5)


def test_checks_of_answers(spark):
    schema = (
        "case_id string, pass1 string, paths_loop_closed long, has_payload boolean, verdict string, biological_plausibility string, evidence_coherence string, "
        "key_evidence array<struct<compound:string,target:string,reached_disease:string>>, concerns array<string>, rationale string, requires_human_review boolean, "
        "verdict_delta int, agrees_with_pass1 boolean")
    sound = ("sound", "unsupported", 0, True, "unsupported", "0", "1.0", [(" A ", "t", None)], [], "No loop closed here.", False, None, True)
    rows = [
        sound, ("fields", *sound[1:8], None, None, *sound[10:]), ("ranges", *sound[1:5], "1.01", "high", *sound[7:]), ("nan", *sound[1:5], "NaN", None, *sound[7:]),
        ("cites", *sound[1:7], [("a", "u", "d"), ("b", "", "D ")], *sound[8:]), ("no payload", *sound[1:3], False, *sound[4:7], [("b", "u", "d")], *sound[8:]),
        ("loop", *sound[1:9], "The Loop-Closure holds", *sound[10:]), ("loop kept", "unsupported", 2, *sound[3:9], "the loop closes", *sound[10:]),
        ("step", *sound[1:11], 1, False), ("silent", "unsupported", 0, True, "strong_support", *sound[5:11], 0, False), ("agrees", "unsupported", 0, True, "strong_support", *sound[5:11], 0, True),
        ("no first", None, 0, True, "strong_support", *sound[5:11], 3, True), ("null lists", *sound[1:7], None, *sound[8:]),
    ]
    shown = [(r[0], kind, name) for r in rows if r[0] != "no payload" for kind, name in (("compound", "a"), ("target", "T"), ("disease", "d"))] * 2
    answers, given = spark.createDataFrame(rows, schema), spark.createDataFrame(shown, "case_id string, kind string, name string")
    found = {r.case_id: r for r in checks.checked(answers, given).collect()}
    names = ("schema_ok", "ranges_ok", "citations_ok", "loop_ok", "delta_ok")
    bad = {c: [n for n in names if not r[n]] for c, r in found.items()}
    assert bad == {
        "sound": [], "fields": ["schema_ok"], "ranges": ["ranges_ok"], "nan": ["schema_ok", "ranges_ok"], "cites": ["citations_ok"], "no payload": [], "loop": ["loop_ok"],
        "loop kept": [], "step": ["delta_ok"], "silent": [], "agrees": ["delta_ok"], "no first": [], "null lists": ["schema_ok"]}
    assert found["fields"].missing == "concerns,rationale" and found["cites"].unknown == 2
    assert found["ranges"].range_fails == "biological_plausibility=1.01 out of [0,1]; evidence_coherence=high not a number"
    assert checks.checked(answers.limit(0), given.limit(0)).count() == 0
