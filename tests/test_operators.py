import json
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomgraph.functions import names as N
from loomgraph.functions import tiers as T
from loomgraph.functions import signals as S
from loomgraph.operators import dml, matching, metrics, text
from loomgraph.plans import regions
from loomgraph.sources import files
from loomgraph.streaming import events as E

PAIRS_EQUAL = [
    ("Diabetes Mellitus", "diabetes mellitus"), ("Epistaxis (nosebleed)", "Epistaxis"), ("Crohn's disease", "Crohns disease"),
    ("Diabetes mellitus, type 2", "Diabetes mellitus type 2"), ("Ménière’s  disease", "ménières disease"), ("頭痛-一", "頭痛 一"),
]
PAIRS_DIFFERENT = [("pharyngitis", "acute pharyngitis"), ("scrofula", "scrofulas")]


def test_match_form(spark):
    rows = spark.createDataFrame([(a, b, True) for a, b in PAIRS_EQUAL] + [(a, b, False) for a, b in PAIRS_DIFFERENT], "a string, b string, same boolean")
    assert all(r.got == r.same for r in rows.withColumn("got", N.match_form(F.col("a")) == N.match_form(F.col("b"))).collect())


def some_names(seed, n):
    rng = random.Random(seed)
    words = ["acori", "acoti", "graminei", "radix", "fructus", "an", "ginseng", "panax", "gin", "rubra", "rubrum"]
    return [" ".join(rng.choices(words, k=rng.randint(0, 3))) for _ in range(n)]


def match_table(spark, left, right):
    """{(i, k)}: positions of the names that name_match joins."""
    a = spark.createDataFrame(list(enumerate(left)), "i int, a string")
    b = spark.createDataFrame(list(enumerate(right)), "k int, b string")
    return {(r.i, r.k) for r in a.crossJoin(b).where(N.name_match(F.col("a"), F.col("b"))).collect()}


def test_name_match(spark):
    yes = [("Acori graminei", "acoti graminei"), ("Panax ginseng radix", "ginseng"), ("Radix Acori", "acori"), ("a rubra panax", "panax x rubra"), ("cold anvil", "old anvil")]
    no = [("Radix", "Radix"), ("acori graminei", "acoxx graminei"), ("gin an", "gan an"), ("", "x"), ("acori", "acoti"), ("Radix panax", "Radix acori")]
    for pairs, want in ((yes, True), (no, False)):
        got = spark.createDataFrame(pairs, "a string, b string").withColumn("same", N.name_match(F.col("a"), F.col("b"))).collect()
        assert all(r.same == want for r in got)


def test_loose_pairs_lose_none(spark):
    names = sorted({*some_names(1, 60), "ab", "ab cd", "b", "Ginseng", "acoris graminei", "acor graminei", "long ginsengoside name"})
    got = {(r.a, r.b) for r in matching.loose_pairs(spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    assert got == {(names[i], names[k]) for i, k in match_table(spark, names, names) if names[i] < names[k]} and ("ab", "ab cd") in got


def test_small_functions(spark):
    row = spark.range(1).select(
        N.genus_species(F.lit("Panax  ginseng root")).alias("gs"), N.genus_species(F.lit("Panax")).alias("g"), N.organisms(F.lit("A b| |C")).alias("o"),
        N.part_of(F.lit(" ")).alias("p"), N.unstructured_key(F.lit(" Big  Thing ")).alias("u"), N.curie_kind(F.lit("EFO_0001")).alias("c"),
        N.looks_like_formula(F.lit("C6H12O6")).alias("f"), N.looks_like_formula(F.lit("sugar")).alias("nf"),
        N.nearest_rank(F.array(F.lit(5), F.lit(1), F.lit(3), F.lit(9)), 50).alias("r"), N.nearest_rank(F.array().cast("array<int>"), 50).alias("nr"),
        T.clamp01(F.lit("x")).alias("c0"), T.clamp01(F.lit(7)).alias("c1"), T.verdict_delta(F.lit("strong_support"), F.lit("?")).alias("d"),
        T.association_type(F.lit(0.4)).alias("a"), T.activity_type(F.lit(None).cast("double"), F.lit(False)).alias("ph"), T.phase_type(F.lit(0)).alias("p0"),
        T.tier_name(T.weakest(F.lit(4), F.lit(None).cast("int"), F.lit(2))).alias("w")).first()
    assert tuple(row) == ("panax ginseng", None, ["a b", "c"], "whole", "unstructured:big_thing", "efo", True, False, 5, None, 0.0, 1.0, 6,
                          "ot_association_moderate", "chembl_phenotypic", None, "bronze")


def test_upsert_and_backfill(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", ""), (3, "c", "z")], "k int, v string, w string")
    new = spark.createDataFrame([(2, None, "x"), (3, "cc", "y"), (4, "d", None)], "k int, v string, w string")
    got = {r.k: (r.v, r.w, r.created) for r in dml.upsert(old, new, ["k"]).collect()}
    assert got == {1: ("a", None, False), 2: ("b", "x", False), 3: ("cc", "y", False), 4: ("d", None, True)}
    again = dml.upsert(dml.upsert(old, new, ["k"]).drop("created"), new, ["k"])
    assert {r.k: (r.v, r.w) for r in again.collect()} == {k: v[:2] for k, v in got.items()}
    assert {r.k: r.w for r in dml.backfill(old, new, "k", ["w"]).collect()} == {1: None, 2: "x", 3: "z"}


def test_retarget_keeps_the_surer_edge(spark):
    edges = spark.createDataFrame([(1, 9, 0.5), (2, 9, 0.7), (3, 9, None), (2, 8, None)], "src long, dst long, confidence double")
    merged = spark.createDataFrame([(2, 1), (3, 1)], "old long, keeper long")
    got = {(r.src, r.dst): (r.confidence, r.moved_from) for r in dml.retarget(edges, merged).collect()}
    assert got == {(1, 9): (0.7, 2), (1, 8): (None, 2)}


def test_archive_keeps_earlier_reasons(spark):
    nodes = spark.createDataFrame([("a", True, "old"), ("b", None, None), ("c", False, None)], "name string, archived boolean, archive_reason string")
    got = {r.name: (r.archived, r.archive_reason) for r in dml.archive(nodes, nodes.where("name <> 'c'"), "name", "new").collect()}
    assert got == {"a": (True, "old"), "b": (True, "new"), "c": (False, None)}


def brute_end(value, start, size):
    """The end of a chunk by looking at every place in its span."""
    stop = start + size
    if stop >= len(value):
        return len(value)
    for mark in text.BREAKS:
        ends = [i + len(mark) for i in range(start + 1, stop - len(mark) + 1) if value.startswith(mark, i)]
        if ends:
            return max(ends)
    return stop


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .,\n", max_size=300), st.integers(5, 40), st.integers(0, 20))
def test_chunks_cover_the_text_and_advance(value, size, overlap):
    bounds = text.chunk_bounds(value, size, overlap)
    starts = [a for a, _ in bounds]
    assert starts == sorted(set(starts)) and all(0 < b - a <= size for a, b in bounds)
    assert all(b == brute_end(value, a, size) for a, b in bounds)
    assert "".join(value[max(a, bounds[i - 1][1] if i else 0) : b] for i, (a, b) in enumerate(bounds)) == value


def test_chunk_table(spark):
    docs = spark.createDataFrame([(1, "One. Two. Three."), (2, ""), (3, None)], "doc_id long, text string")
    got = [(r.doc_id, r.chunk, r.text) for r in text.chunks(docs, 10, 2).orderBy("doc_id", "chunk").collect()]
    assert got[0] == (1, 0, "One. Two.") and got[-1][2].endswith("Three.") and {g[0] for g in got} == {1}


def test_spans_short_and_long(spark):
    docs = spark.createDataFrame([(1, "xaa bb cc  dd ee ff gg hh tail"), (2, "nothing"), (3, None)], "doc_id long, text string")
    spans = spark.createDataFrame([(1, "AA bb cc dd ee ff gg"), (2, "cc dd"), (3, "zz"), (4, ""), (5, "nothing")], "item_id long, text string")
    assert sorted((r.item_id, r.doc_id) for r in text.contained_spans(docs, spans).collect()) == [(1, 1), (2, 1), (5, 2)]
    assert text.contained_spans(docs, spans.limit(0)).count() == 0
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choices(["a", "bb", "ab", "b", "cab"], k=rng.randint(0, 40)))) for i in range(40)]
    spans = [(i, t) for i, t in enumerate({" ".join(rng.choices(["a", "bb", "ab", "b"], k=rng.randint(1, 8))) for _ in range(60)})]
    got = {(r.item_id, r.doc_id) for r in text.contained_spans(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(spans, "item_id long, text string")).collect()}
    assert got == {(i, d) for i, t in spans for d, whole in docs if t in whole}


def test_windows_merge_where_they_touch(spark):
    lines = ["x"] * 40
    for i in (3, 8, 30):
        lines[i] = "has Needle here"
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, "none"), (3, None)], "doc_id long, text string")
    got = sorted((r.start, r.end) for r in text.mention_windows(docs, F.lit("needle"), 2).collect())
    assert got == [(1, 11), (28, 33)]


def test_precision_and_recall(spark):
    p = spark.createDataFrame([("r", 0, "Panax ginseng"), ("r", 1, "Acoti graminei"), ("r", 2, "nothing"), ("q", 0, "alone")], "region string, pos int, name string")
    g = spark.createDataFrame([("r", 0, "ginseng"), ("r", 1, "acori graminei"), ("s", 0, "only gold")], "region string, pos int, name string")
    got = {r.region: (r.tp, round(r.precision, 3), round(r.recall, 3), round(r.f1, 3)) for r in metrics.precision_recall(p, g, "region").collect()}
    assert got == {"r": (2, 0.667, 1.0, 0.8), "q": (0, 0.0, 0.0, 0.0), "s": (0, 0.0, 0.0, 0.0)}


def test_matching_in_rounds_equals_one_after_the_other(spark):
    want, rows = set(), {"p": [], "g": []}
    for region in range(4):
        predicted, gold = some_names(region, 12), some_names(region + 50, 9)
        rows["p"] += [(region, i, n) for i, n in enumerate(predicted)]
        rows["g"] += [(region, i, n) for i, n in enumerate(gold)]
        table, free = match_table(spark, predicted, gold), set(range(len(gold)))
        for i in range(len(predicted)):
            hit = min((k for k in free if (i, k) in table), default=None)
            if hit is not None:
                free.remove(hit)
                want.add((region, i, hit))
    p, g = (spark.createDataFrame(rows[k], "region int, pos int, name string") for k in "pg")
    assert {tuple(r) for r in metrics.matched(p, g, "region").collect()} == want and want


def test_perturbation_keeps_degrees(spark):
    edges = spark.createDataFrame([(i % 17, i % 23) for i in range(300)], "src long, dst long").distinct()
    assert sorted(map(tuple, metrics.perturb(edges, 0, "s").drop("moved").collect())) == sorted(map(tuple, edges.collect()))
    for p in (40, 100):
        out = metrics.perturb(edges, p, "s")
        for end in ("src", "dst"):
            assert sorted(r[end] for r in out.collect()) == sorted(r[end] for r in edges.collect())
        assert out.where("moved").count() == round(p * edges.count() / 100)
    few = [sorted(map(tuple, metrics.perturb(edges, 40, "s", buckets=b).collect())) for b in (1, 7, 64)]
    assert few[0] == few[1] == few[2]


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "b.txt").write_text("two\n\nlines")
    (tmp_path / "a.txt").write_text("### SOURCE: First one\nx\n### SOURCE: Second\n")
    (tmp_path / "c.md").write_text("no")
    got = files.text_folder(spark, str(tmp_path)).orderBy("source_document").collect()
    assert [(r.source_document, r.text[:3]) for r in got] == [("a", "###"), ("b", "two")]
    assert [r.name for r in files.headed_names(spark, str(tmp_path / "a.txt")).orderBy("position").collect()] == ["First one", "Second"]
    assert [r.name for r in files.headed_names(spark, str(tmp_path / "a.txt"), 1).collect()] == ["First one"]
    (tmp_path / "t.tsv").write_text("x\ty\n1\t2\n")
    assert files.export(spark, str(tmp_path / "t.tsv")).first().y == "2"
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert files.json_lines(spark, str(tmp_path / "l.jsonl"), "a int").count() == 2
    (tmp_path / "d.json").write_text(json.dumps({"verdicts": [{"source": "s", "n": 1}, {"source": "t", "n": None}]}))
    assert files.json_document(spark, str(tmp_path / "d.json"), "verdicts", "struct<source:string,n:int>").count() == 2
    df = spark.createDataFrame([(1, None)], "a int, b string")
    files.write_json_document(df, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first().value == '{"a":1,"b":null}'
    files.write_part(df, str(tmp_path / "parts"), "0")
    files.write_part(df, str(tmp_path / "parts"), "0")
    assert spark.read.parquet(str(tmp_path / "parts")).count() == 1
    raw = spark.createDataFrame([("o", "C", " ", "sys", None, "x", "1"), ("o", None, "n", None, None, None, None)],
                                "organisms string, canonical_smiles string, name string, iupac_name string, molecular_formula string, np_likeness string, annotation_level string")
    assert [tuple(r) for r in files.compound_snapshot(raw).collect()] == [("o", "C", "sys", None, None, 1)]


def test_event_stream_equals_batch(spark, tmp_path):
    path = str(tmp_path / "events")
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").repartition(3).write.parquet(path)
    def run(stream, name, mode):
        stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
        return spark.table(name)

    mine = sorted(map(tuple, run(E.window_counts(E.read_events(spark, path)), "counted", "complete").collect()))
    assert run(E.unique_events(E.read_events(spark, path), "4000 days"), "once", "append").count() == spark.read.parquet(path).count()
    batch = spark.read.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))
    assert mine == sorted(map(tuple, E.window_counts(E.unique_events(batch)).collect()))


def test_budget_by_blocks_equals_a_running_sum(spark):
    rng = random.Random(3)
    rows = [(g, i, rng.choice([0, 1, 5, 30])) for g in "ab" for i in range(200)]
    got = {(r.g, r.i, r.running) for r in text.within_budget(spark.createDataFrame(rows, "g string, i long, n int"), "g", "i", "n", 300, block=7).collect()}
    want = set()
    for g in "ab":
        total = 0
        for _, i, n in (r for r in rows if r[0] == g):
            total += n
            if total <= 300:
                want.add((g, i, total))
    assert got == want


def test_regions_with_news_equal_going_through_them(spark):
    rng = random.Random(4)
    found = {i: set(rng.sample(range(12), rng.randint(1, 4))) for i in range(60)}
    covered, want = set(), set()
    for i, sources in found.items():
        if sources - covered:
            want.add(i)
            covered |= sources
    rows = spark.createDataFrame([(i, s) for i, x in found.items() for s in x], "region int, source int")
    assert {r.region for r in regions.first_of_each(rows).collect()} == want


def test_signals_keywords_and_answers(spark):
    row = spark.range(1).select(
        S.count_of(F.lit("It treats and CURES; mistreats. Radix is acrid, the envoy of all"), S.THERAPY).alias("t"), S.is_entry(F.lit("Radix is warm")).alias("e"),
        S.is_compatibility_only(F.lit("the envoy of x, fears y")).alias("c"), S.is_compatibility_only(F.lit("fears y but treats z")).alias("nc"),
        S.search_keywords(F.lit(" Radix  Glycyrrhizae Citri oil")).alias("k"),
        N.binomials(F.array(F.lit("see Panax  ginseng Mey"), F.lit("panax x"), F.lit(None).cast("string"), F.lit("Coptis chinensis"), F.lit("Panax ginseng"))).alias("b"),
        N.without_fence(F.lit("```json\n{\"a\": 1}\n```")).alias("j"), N.without_fence(F.lit("{}")).alias("j2")).first()
    assert tuple(row) == (3, True, True, False, ["citr", "citri", "citrus", "glycyrrhiz", "glycyrrhiza", "glycyrrhizae"], ["Panax ginseng", "Coptis chinensis"], '{"a": 1}', "{}")


def test_paragraphs_end_at_blank_lines(spark):
    long = "x" * 60
    docs = spark.createDataFrame([(1, f"{long}\n{long}\n \n short \n\n{long}"), (2, None)], "doc_id long, text string")
    assert [(r.paragraph, len(r.text)) for r in text.paragraphs(docs).orderBy("paragraph").collect()] == [(0, 121), (1, 60)]


def test_edges_bring_their_ends(spark):
    edges = spark.createDataFrame([(1, "a", 0.5)], "src long, dst string, confidence double")
    new = spark.createDataFrame([(1, "a", 0.9), (2, "b", 0.1), (2, "a", 0.2)], "src long, dst string, confidence double")
    sources, targets = spark.createDataFrame([(1, "one")], "k long, name string"), spark.createDataFrame([("a",)], "name string")
    for _ in range(2):
        merged, sources, targets = dml.merge_edges(edges, new, sources, "k", targets, "name")
        edges = merged.drop("created")
        assert {(r.src, r.dst): r.confidence for r in edges.collect()} == {(1, "a"): 0.9, (2, "b"): 0.1, (2, "a"): 0.2}
        assert {r.k: r.name for r in sources.collect()} == {1: "one", 2: None} and {r.name for r in targets.collect()} == {"a", "b"}
    left, found = dml.detach_delete(sources, "k", sources.where("k = 2"), {"e": (edges, "src")})
    assert [r.k for r in left.collect()] == [1] and [(r.src, r.dst) for r in found["e"].collect()] == [(1, "a")]
    assert dml.in_batches(spark.range(1700).withColumnRenamed("id", "k"), "k").select("batch").distinct().count() == 4
