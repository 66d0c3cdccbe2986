"""Lookups in turn, first rows, fallbacks, means and rationales, against plain versions."""

from pyspark.sql import functions as F

from loomgraph.functions import provider as V
from loomgraph.operators import resolve as R


def test_lookups_go_on_where_a_step_gives_nothing(spark):
    asked = spark.createDataFrame([(1, "a", "x", "n"), (2, "zz", "x", "n"), (3, "", "zz", "N"), (4, None, None, "no"), (5, "down", "zz", "no"), (6, "down", "x", None), (7, "down2", "", "")], "i int, a string, b string, c string")
    records = spark.createDataFrame([(20, "a", "y", "n"), (10, "a", "x", "m"), (30, "down", "x", None), (40, "", "", "")], "record_id int, ra string, rb string, rc string")
    failed = spark.createDataFrame([("a", "down"), ("a", "down2"), ("b", "q")], "step string, key string")
    steps = [("a", F.col("a"), F.col("ra")), ("b", F.col("b"), F.col("rb")), ("c", F.lower("c"), F.col("rc"))]
    got = {r.i: (r.record, r.method, r.ok) for r in R.resolved_in_turn(asked, records, steps, failed).collect()}
    assert got == {1: (10, "a", True), 2: (10, "b", True), 3: (20, "c", True), 4: (None, "none", True), 5: (None, "none", False), 6: (10, "b", True), 7: (None, "none", False)}


def test_first_rows_by_several_keys(spark):
    rows = [(1, "k", None, "n"), (2, "k", "s", "n"), (3, None, "s", "n"), (4, "", "s", "m"), (5, None, None, "n"), (6, None, "", "n"), (7, None, None, None), (8, None, "", ""), (9, None, "k", None)]
    df = spark.createDataFrame(rows, "i int, id string, smiles string, name string")
    got = sorted(r.i for r in R.first_by_key(df, [F.col("id"), F.col("smiles"), F.col("name")], ["i"]).collect())
    assert got == [1, 3, 5, 7, 8, 9]  # an id is no structure, and rows without any key are no copies


def test_all_where_none_was_found(spark):
    every = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z"), ("b", "z"), ("c", "w")], "g string, n string")
    found = spark.createDataFrame([("a", "y"), ("a", "y"), ("c", "w")], "g string, n string")
    assert sorted(tuple(r) for r in R.resolved_or_all(found, every, "g", "n").collect()) == [("a", "y", False), ("b", "z", True), ("c", "w", False)]


def test_means_skip_what_is_missing(spark):
    df = spark.createDataFrame([(1, 2.0, "t"), (None, 4.0, "u"), (3, None, None)], "a int, b double, c string").withColumn("d", F.lit(None).cast("double"))
    assert {r.column: (r.mean, r.n) for r in R.column_means(df).collect()} == {"a": (2.0, 2), "b": (3.0, 2), "d": (None, 0)}
    assert {r.n for r in R.column_means(df.limit(0)).collect()} == {0}


def test_rationales(spark):
    columns = "verdict string, primary_disease string, top_bucket string, top_bucket_path_count int, top_bucket_max_score double, paths_loop_closed int, paths_component_closed int, path_count int, primary_mapping_quality string, n int"
    rows = [("strong_support", "flu", "gold", 2, 0.6125, 3, 0, 9, "gold", 0), ("moderate_support", "flu", "silver", 2, 0.5, 3, 4, 9, "silver", 2), ("partial_support", "flu", "wood", 1, 0.5, 1, 0, 9, "gold", 1),
            ("unsupported", "flu", "wood", 1, 0.5, 0, 0, 9, "gold", 0), ("mechanistic_only", None, "wood", 1, 0.5, 0, 0, 9, "missing", 0), ("traditional_only", None, "unrated", 0, 0.0, 0, 0, 0, "silver", 3), ("claim_not_found", None, "x", 0, 0.0, 0, 0, 0, "gold", 0)]
    got = [r.said for r in spark.createDataFrame(rows, columns).coalesce(1).select(R.rationale(F.col("n")).alias("said")).collect()]
    assert got == [
        "2 gold-tier path(s) close the loop on 'flu', top score 0.613.",
        "Loop closes on 'flu' via silver-tier evidence (3 closing path(s)). (corroborated by 2 sibling source(s); 4 path(s) reach a syndrome component; malady mapping is unverified)",
        "Loop closes on 'flu' but only via wood-tier evidence (1 closing path(s)). (corroborated by 1 sibling source(s))",
        "9 mechanistic path(s) exist but none reach 'flu'.",
        "9 mechanistic path(s) exist but the malady has no Modern_Disease mapping to check against.",
        "No compounds linked to this source — claim is purely traditional.", ""]


def test_canonical_records(spark):
    answers = [("a", " Salvia ", "organism", " Root", False), ("b", "salvia m", "organism", None, None), ("c", "Cinnabar", "organism", "", False), ("d", "MERCURY", "chemical", "x", False), ("e", "tin", "chemical", None, False),
               ("f", "odd", "mineral", "x", False), ("g", " ", "organism", "x", False), ("h", None, "chemical", None, False), ("i", "Salvia", "organism", "x", True)]
    got = R.canonical_records(
        spark.createDataFrame(answers, "name string, canonical string, kind string, part string, failed boolean"), spark.createDataFrame([("Salvia miltiorrhiza",), (None,)], "name string"),
        spark.createDataFrame([("Mercury",), ("mercury",), (None,)], "name string"))
    assert sorted(tuple(r) for r in got.collect()) == [
        ("a", "Salvia", "organism", "Salvia", "root", "gemini+coconut"), ("b", "salvia m", "organism", "salvia m", "whole", "gemini+coconut"),
        ("c", "Cinnabar", "organism", "Cinnabar", "whole", "gemini_unverified_organism"), ("d", "MERCURY", "chemical", "MERCURY", "", "gemini+pubchem"),
        ("e", "tin", "chemical", "tin", "", "gemini_unverified_chemical"), ("f", "odd", "uncanonicalized", None, "", "uncanonicalized"), ("g", "", "uncanonicalized", None, "", "uncanonicalized"),
        ("h", "", "uncanonicalized", None, "", "uncanonicalized"), ("i", "", "error", None, "", "error")]


def test_provider_records(spark):
    rows = [('{"target_type":"SINGLE PROTEIN","target_components":[{"accession":"P1","target_component_synonyms":[{"syn_type":"UNIPROT","component_synonym":"u"},{"syn_type":"GENE_SYMBOL","component_synonym":"G1"},{"syn_type":"GENE_SYMBOL","component_synonym":"G2"}]},{"accession":"P2"},{"accession":"P1"},{"accession":""},{}]}',),
            ('{"target_type":"ORGANISM","tax_id":9606,"target_components":[]}',), ('{"target_type":"PROTEIN COMPLEX","target_chembl_id":"C1","tax_id":1,"target_components":[{"accession":"P3"}]}',), ('{"target_type":"SINGLE PROTEIN"}',), ("{}",)]
    got = [(r.i.uniprot_id, r.i.gene_symbol, r.i.ncbi_tax_id, r.a) for r in spark.createDataFrame(rows, "j string").coalesce(1).select(
        F.from_json("j", V.TARGET_RECORD).alias("r")).select(V.target_identity(F.col("r")).alias("i"), V.accessions(F.col("r")).alias("a")).collect()]
    assert got == [("P1", "G1", "", ["P1", "P2"]), ("", "", "9606", []), ("", "", "", ["P3"]), ("", "", "", None), ("", "", "", None)]
    terms = spark.createDataFrame([(["A", "a", "", None, "b", "B ", "A"],), ([],), (None,)], "t array<string>").coalesce(1).select(V.distinct_terms(F.col("t")).alias("t")).collect()
    assert [r.t for r in terms] == [["A", "b", "B "], [], []]
