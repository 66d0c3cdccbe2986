"""Regions and passages against plain versions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from loomgraph.functions.signals import Signals
from loomgraph.operators import text
from loomgraph.plans import regions

WORDS = ["alpha", "Beta", "gamma", "é", "st", "x_1", "the", "of", "delta"]


def some_paragraphs(seed, n=60):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        marks = [rng.choice([" ", " ", " ", "  ", ", ", "-", ". ", "\n"]) for _ in range(30)]
        words = rng.choices(WORDS, k=30)
        rows.append((i % 7 if i % 3 else 0, i, "".join(w + m for w, m in zip(words, marks, strict=True))))
    return rows + [(1, 1000, ""), (1, 1001, None)]


KEYWORDS = [("a", "alpha"), ("a", "ALPHA"), ("b", "the of"), ("c", "st. the"), ("d", "of-of"), ("e", "é"), ("f", "alpha beta gamma"), ("g", "x_1 the"), ("h", "."),
            ("i", ""), ("j", None), ("k", "omega"), ("l", "lph"), ("m", "the the"), ("n", "of"), ("n", "gamma, delta")]


@pytest.mark.parametrize("seed", range(3))
def test_whole_words_and_phrases(spark, seed):
    rows = some_paragraphs(seed)
    got = regions.tagged(spark.createDataFrame(rows, "doc_id long, paragraph int, text string"), spark.createDataFrame(KEYWORDS, "source string, keyword string"))
    expect = {(d, p, s) for d, p, t in rows for s, k in KEYWORDS if t and k and re.search(r"\w", k) and re.search(rf"\b{re.escape(k)}\b", t, re.I)}
    assert sorted(tuple(r) for r in got.collect()) == sorted(expect)


def test_regions_are_filtered_and_counted(spark):
    herb = "Radix and fructus. It mainly treats cough. " + "filler " * 40
    rows = [(1, 0, herb + "alpha beta"), (1, 1, "plain prose " * 30 + "alpha beta"), (1, 2, "radix radix averse to, fears, clashes with, envoy of. " + "word " * 60 + "alpha beta"),
            (1, 3, "Radix is acrid alpha beta"), (1, 4, herb + "alpha")]
    df = spark.createDataFrame(rows, "doc_id long, paragraph int, text string")
    tags = regions.tagged(df, spark.createDataFrame([("a", "alpha"), ("b", "beta")], "source string, keyword string"))
    got = regions.regions_of(df.withColumnRenamed("paragraph", "first"), tags)
    assert sorted((r.doc_id, r["first"], r.source) for r in got.collect()) == [(1, 0, "a"), (1, 0, "b")]
    # two paragraphs each: a source must stand in both
    windows = spark.createDataFrame([(1, i, herb) for i in range(4)], "doc_id long, first int, text string")
    twice = regions.regions_of(windows, tags, size=2, sources=1, paragraphs_each=2)
    assert sorted((r["first"], r.source) for r in twice.collect()) == [(0, "a"), (0, "b"), (1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, "a")]
    own = Signals(entry="filler", therapy="cough", compatibility="averse")
    assert regions.regions_of(df.withColumnRenamed("paragraph", "first"), tags, signals=own, sources=1).where("source = 'a'").count() == 2


def plain_drawing(gold, others, regions_wanted, k, n, seed):
    import hashlib

    order = lambda names: sorted(set(names), key=lambda s: hashlib.md5(f"{seed}|{s}".encode()).hexdigest())
    gold, queue = order(gold)[: regions_wanted * k], order(others)[: regions_wanted * (k + n)]
    used, seen, out = dict.fromkeys(gold, 0), set(), []
    while len(out) < regions_wanted and len(gold) >= k:
        # least used first; of those the next in the round
        at = len(out) * k
        own = [gold[(at + i) % len(gold)] for i in range(k)]
        assert max(used[s] for s in own) <= min(used.values()) + 1
        if frozenset(own) in seen:
            break
        seen.add(frozenset(own))
        free = [s for s in queue if s not in own][:n]
        queue = [s for s in queue if s not in free] + free
        for s in own:
            used[s] += 1
        out.append((sorted(own), sorted(free)))
    return out


@pytest.mark.parametrize(("n_gold", "n_others", "wanted"), [(9, 30, 5), (7, 12, 20), (3, 4, 4), (2, 9, 3), (12, 12, 9)])
def test_synthetic_regions_are_drawn_least_used_first(spark, n_gold, n_others, wanted):
    gold, others = [f"g{i}" for i in range(n_gold)], [f"g{i}" for i in range(min(n_gold, n_others))] + [f"o{i}" for i in range(max(0, n_others - n_gold))]
    frame = lambda names: spark.createDataFrame([(s,) for s in [*names, None, names[0]]], "source string")
    drawn = regions.synthetic_regions(frame(gold), frame(others), wanted)
    found = {}
    for r in drawn.collect():
        found.setdefault(r.region, ([], []))[not r.is_gold].append(r.source)
    expect = plain_drawing(gold, others, wanted, 3, 7, "42")
    assert [(sorted(a), sorted(b)) for _, (a, b) in sorted(found.items())] == expect
    usage = [sum(s in free for _, free in expect) for s in others]
    if len(others) >= 10:
        assert max(usage) - min(usage) <= 2


def plain_passage(corpus, needles, around, budget):
    needles = [n.lower().strip() for n in needles if len(n.strip()) >= 3]
    lines = corpus.splitlines()
    merged = []
    for i, line in enumerate(lines):
        if any(n in line.lower() for n in needles):
            s, e = max(0, i - around), min(len(lines), i + around + 1)
            if merged and s <= merged[-1][1]:
                merged[-1][1] = e
            else:
                merged.append([s, e])
    parts, total = [], 0
    for s, e in merged:
        block = f"\n--- corpus lines {s + 1}-{e} ---\n" + "\n".join(lines[s:e])
        if total + len(block) > budget:
            if budget - total > 200:
                parts.append(block[: budget - total] + "\n... [truncated] ...")
            break
        parts.append(block)
        total += len(block)
    return len(merged), "\n".join(parts).strip()


@pytest.mark.parametrize("budget", [60_000, 900, 350, 100])
def test_passages(spark, budget):
    rng = random.Random(1)
    docs = []
    for i in range(8):
        lines = [" ".join(rng.choices(["one", "two", "three", "Ban  Mao", "x"], k=rng.randint(0, 12))) for _ in range(80)]
        for at in rng.sample(range(80), 5):
            lines[at] += rng.choice([" Rhizoma Z", " the ROOT of it", " Ban Mao"])
        docs.append((i, rng.choice(["\n", "\r\n"]).join(lines) + rng.choice(["", "\n"])))
    docs += [(100, ""), (101, None)]
    needles = {1: ["rhizoma z", "root of"], 2: [" BAN MAO "], 3: ["xy", "x"], 4: ["nowhere at all"], 5: ["three three"]}
    got = text.passages(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, n) for i, ns in needles.items() for n in ns], "item_id long, needle string"), 3, budget)
    expect = {(i, d): plain_passage(t, ns, 3, budget) for i, ns in needles.items() for d, t in docs if t}
    assert {(r.item_id, r.doc_id): (r.windows, r.passage) for r in got.collect()} == {k: v for k, v in expect.items() if v[0]}


def test_seeds_and_what_stands_in_for_a_passage(spark):
    rows = [("p", " seed ", "c"), ("p", None, "c"), ("", "seed", "c"), ("", "", "c"), (None, None, None), (" ", " ", "")]
    got = [r.w for r in spark.createDataFrame(rows, "p string, s string, c string").select(text.with_seed(F.col("p"), F.col("s"), F.col("c")).alias("w")).collect()]
    head = "--- source.evidence_span (Phase 1 anchor) ---\nseed\n\n"
    bare = "--- source.evidence_span ---\n{}\n--- treats edge evidence_span ---\n{}"
    assert got == [head + "p", "p", head, bare.format("<no anchor>", "c"), bare.format("<no anchor>", "<no treats span>"), bare.format(" ", "<no treats span>")]


def test_paragraph_windows(spark):
    docs = spark.createDataFrame([(1, "\n\n".join("p" * 51 + str(i) for i in range(5)) + "\n\nshort"), (2, "q" * 60), (3, None)], "doc_id long, text string")
    got = [(r.doc_id, r["first"], r.text.count("\n\n")) for r in text.paragraph_windows(docs, 2, 2).orderBy("doc_id", "first").collect()]
    assert got == [(1, 0, 1), (1, 2, 1)]
    assert text.paragraph_windows(docs).count() == 6


def test_paragraphs_lose_spaces_alone(spark):
    """Of every piece, whatever its number, the spaces around it go and its digits stay."""
    body = "x" * 60
    pieces = [f"00 {body} 0", f" \u00a0{body}1\u3000", f"1{body}\t", f"3 {body}\x0b", body[:50] + " "]
    docs = spark.createDataFrame([(1, "\n \t\n".join(pieces)), (2, f"{body}\n\x0b\n{body}"), (3, None)], "doc_id long, text string")
    got = [tuple(r) for r in text.paragraphs(docs).orderBy("doc_id", "paragraph").collect()]
    assert got == [(1, i, p.strip(" \u00a0\u3000")) for i, p in enumerate(pieces[:4])] + [(2, 0, f"{body}\n\x0b\n{body}")]


def test_windows_are_of_trimmed_paragraphs(spark):
    pieces = [f"00 {'x' * 60} 0", f" {'y' * 60}1 ", f"2\u00a0{'z' * 60}2\u00a0"]
    docs = spark.createDataFrame([(1, "\n".join(pieces))], "doc_id long, text string")
    got = [(r["first"], r.text) for r in text.paragraph_windows(docs, 2, 1, mark=r"\n").orderBy("first").collect()]
    trimmed = [p.strip(" \u00a0") for p in pieces]
    assert got == [(i, "\n\n".join(trimmed[i:i + 2])) for i in range(2)]


def test_windows_fit_by_sums_of_their_paragraphs(spark):
    rng = random.Random(4)
    words = ["filler", "cough", "averse", "Filler-cough", "prose", "x" * 30]
    docs = [(i, "\n".join(" ".join(rng.choices(words, k=rng.randint(4, 14))) for _ in range(rng.randint(0, 9)))) for i in range(40)] + [(50, None), (51, "")]
    own = Signals(entry="filler", therapy="cough", compatibility="averse")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    tags = text.paragraphs(df, r"\n").select("doc_id", "paragraph", F.lit("a").alias("source"))
    expect = regions.regions_of(text.paragraph_windows(df, 3, 1, mark=r"\n"), tags, 3, own, least=300, sources=1)
    got = regions.fit_windows(df, 3, r"\n", own, 300)
    assert sorted(map(tuple, got.collect())) == sorted((r.doc_id, r["first"]) for r in expect.collect())
    assert 10 < got.count() < text.paragraph_windows(df, 3, 1, mark=r"\n").count()


def test_keywords_are_hashed_once_and_shuffled_as_hits_only(spark):
    """Words that are no keyword leave no task: what is shuffled is no larger than the places of keywords."""
    df = spark.createDataFrame([(i, 0, f"word{i} " * 50 + "alpha") for i in range(20)], "doc_id long, paragraph int, text string")
    tags = regions.tagged(df, spark.createDataFrame([("a", "alpha"), ("b", "beta gamma")], "source string, keyword string"))
    assert sorted(tuple(r) for r in tags.collect()) == [(i, 0, "a") for i in range(20)]
    plan = tags._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "posexplode" not in plan


def test_passages_between_marks_are_whole(spark):
    """Without a budget nothing is cut, and with a mark only that ends a line, a last empty one included."""
    body = "long line " * 8000
    docs = spark.createDataFrame([(1, f"{body}\na needle\x0bhere\n{body}\n"), (2, "no\n" * 9), (3, None)], "doc_id long, text string")
    needles = spark.createDataFrame([(1, "\u00a0NEEDLE\u3000"), (2, "absent needle"), (3, "")], "item_id long, needle string")
    got = text.passages(docs, needles, 15, budget=None, mark="\n").collect()
    assert [(r.item_id, r.doc_id, r.windows, r.passage) for r in got] == [(1, 1, 1, f"--- corpus lines 1-4 ---\n{body}\na needle\x0bhere\n{body}".strip())]


@pytest.mark.parametrize("seed", range(3))
def test_candidates_miss_no_span(spark, seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choices("abÄ \U0001f600", k=rng.randint(0, 60))) for _ in range(60)] + [None]
    spans = [(i, "".join(rng.choices("abä \U0001f600", k=k))) for i, k in enumerate([1, 2, 3, 3, 4, 5, 7, 9, 0])] + [(20 + i, texts[i].lower()[3:50]) for i in range(8)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.item_id, r.doc_id) for r in text.places.candidates(df, spark.createDataFrame(spans, "item_id long, span string")).collect()}
    expect = {(i, d) for i, s in spans for d, t in enumerate(texts) if s and t and s in t.lower()}
    assert expect <= got and len(got) < len(texts) * len(spans)


@pytest.mark.parametrize("plan", [regions.single_paragraphs, regions.regions, regions.regions_with_news])
def test_words_of_texts_stay_in_their_task(spark, plan):
    """Queries that tag go by the places of keywords: no plan gives a row for each word of a text."""
    found = plan(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert found.count("MapInArrow") == 1 and "AS word#" not in found and "posexplode(split(lower" not in found
