"""Repeated passages, the divergence audit and hard negatives, each against a plain version."""

import hashlib
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import divergence_audit, hard_negatives, substring_dedup

# ---- repeated passages


def plain_removal(rows, width):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    seen = Counter(tuple(w[k : k + width]) for _, w in words for k in range(len(w) - width + 1))
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if seen[tuple(w[k : k + width])] > 1:
                gone[k : k + width] = [True] * width
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(out, key=repr)


def passages(seed, n, width):
    rng = random.Random(seed)
    words = [f"w{i}é" if i % 9 == 0 else f"W{i}" for i in range(300)]
    shared = [rng.choices(words, k=rng.randint(width - 1, 3 * width)) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [rng.choices(words, k=rng.randint(0, 2 * width)) for _ in range(3)]
        for _ in range(rng.choice([0, 0, 1, 2])):
            parts.insert(rng.randrange(len(parts)), rng.choice(shared))
        text = rng.choice([" ", "\n", "\t ", "\x0b"]).join(" ".join(p) for p in parts)
        rows.append((i if rng.random() < 0.95 else None, text))
    # a third of the rows is one text
    return rows + [(n + i, rows[0][1]) for i in range(n // 2)] + [(-1, None), (-1, None), (-2, ""), (-3, " \n"), (-4, "one two " * 80), (-5, "solo word")]


@pytest.mark.parametrize(("seed", "width", "gram"), [(1, 6, 3), (2, 5, 5), (3, 4, 1), (4, 35, 16)])
def test_removal_matches_brute_force(spark, seed, width, gram):
    rows = passages(seed, 60, width)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("block", F.lit("clash")).withColumn("keys", F.lit(1)).repartition(5)
    got = substring_dedup.remove_repeats(docs, width, gram, block_bytes=4_000).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.text) for r in got), key=repr) == plain_removal(rows, width)
    for r in got:
        assert sum(s.end - s.first for s in r.spans) == r.n_removed


@pytest.mark.parametrize("options", [{"segment": 64, "spread": 0}, {"segment": 64}, {"group_windows": 20, "block_bytes": 1}])
def test_sizes_change_no_result(spark, options):
    """A sketch with far too few cells, where every gram seems to repeat and the exact pass alone decides; one of many
    segments; many groups and a block for each text."""
    rows = passages(5, 40, 6)
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 6, 3, **options).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.text) for r in got), key=repr) == plain_removal(rows, 6)


def test_the_sketch_never_counts_too_little(spark):
    """Equal windows have equal least grams, and a gram is counted once for each of its places."""
    rng = np.random.default_rng(0)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 4, 400)).encode() for _ in range(5)]
    found = substring_dedup.Words(texts, 8)
    at, grams = found.grams(3)
    windows = found.hashes(found.windows, 1)
    chosen, times = np.unique(grams[np.unique(at)], return_counts=True)
    estimate = dict(zip(chosen.tolist(), times.tolist(), strict=True))
    for window, n in zip(*np.unique(windows, return_counts=True), strict=True):
        assert all(estimate[g] >= n for g in grams[at[windows == window]].tolist())


def test_hashes_do_not_hang_on_pieces(monkeypatch):
    texts = [b"a bb ccc", b"", b"q" * 3_000 + b" a bb ccc d" * 500, "é ü\t日本".encode()]
    whole = substring_dedup.Words(texts, 3)
    monkeypatch.setattr(substring_dedup, "PIECE", 1 << 10)
    monkeypatch.setattr(substring_dedup, "SLICE", 100)
    parts = substring_dedup.Words(texts, 3)
    assert (whole.hash == parts.hash).all() and len(whole.hash) == sum(len(t.split()) for t in texts)
    assert all((a == b).all() for a, b in zip(whole.grams(2), parts.grams(2), strict=True))
    words = [w for t in texts for w in t.split()]
    assert len(set(words)) == len(set(whole.hash.tolist())) == len(set(zip(words, whole.hash.tolist(), strict=True)))


def test_very_long_words_and_texts(spark):
    long = " ".join(f"x{i % 5000}" for i in range(20_000))
    rows = [(1, long), (2, "y" * 5_000 + " " + "z " * 50), (3, "y" * 5_000), (4, "a b c")]
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.text) for r in got), key=repr) == plain_removal(rows, 35)


def test_no_documents(spark):
    assert substring_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_registered_removal(spark, tmp_path):
    rows = passages(7, 30, 35)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in substring_dedup.op11_substring_dedup(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted(((i, n, m, hashlib.sha256(t.encode()).hexdigest()) for i, n, m, t in plain_removal(rows, 35)), key=repr)


# ---- divergence audit


def plain_audit(rows, least, top):
    docs = [(lang or "", source or "", [t.translate({c: c + 32 for c in range(65, 91)}) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for d in own for t in set(d[2]))
        kept = sorted(t for t, n in df.items() if n >= least)
        whole = Counter(t for d in own for t in d[2])
        groups = {s: Counter(t for d in own if d[1] == s for t in d[2]) for s in {d[1] for d in own}}

        def share(counts, t):
            return 1 + 1_000_000_000 * (counts[t] + 2) // (sum(counts[k] for k in kept) + 2 * len(kept))

        def far(p, q):
            return Fraction((p - q) ** 2, p + q).__floor__()

        shares = {s: {t: share(c, t) for t in kept} for s, c in groups.items()}
        base = {t: share(whole, t) for t in kept}
        for s in groups:
            parts = {
                "pair": [(sum(far(shares[s][t], shares[o][t]) for t in kept), o) for o in groups if o != s],
                "term": [(far(shares[s][t], base[t]), t) for t in kept if groups[s][t] and shares[s][t] > base[t]]}
            for part, items in parts.items():
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(items) if part == "pair" or i < top]
    return sorted(out)


def corpus(seed, n=90):
    rng = random.Random(seed)
    words = ["Apple", "apple", "café", "Éclair", "日本", "x9y", "don't", "z"] + [f"t{c}" for c in "abcdefgh"]
    rows = [(rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "s3", "S1", "é", None]), " ".join(rng.choices(words, k=rng.randint(0, 30)))) for _ in range(n)]
    # one source holds a third; a language without kept terms, one with one source; rows without terms
    return rows + [("en", "hot", "apple ta tb")] * (n // 2) + [("rare", f"s{i}", f"only{i}x") for i in range(4)] + [("lone", "s", "a b")] + [("en", "none", None), ("en", "none2", "123 !")]


@pytest.mark.parametrize(("seed", "options"), [(1, {}), (2, {"group_block": 2, "chunk": 3, "chunks_a_tile": 2}), (3, {"group_block": 1, "chunk": 1, "chunks_a_tile": 1})])
def test_audit_matches_brute_force(spark, seed, options):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "lang string, source string, text string").withColumn("block", F.lit(1)).withColumn("term", F.lit("clash")).repartition(4)
    got = sorted(tuple(r) for r in divergence_audit.audit(docs, least_documents=4, top=3, **options).collect())
    assert got == plain_audit(rows, 4, 3)


def test_audit_counts_in_small_portions(spark, monkeypatch):
    monkeypatch.setattr(divergence_audit, "ENTRIES", 5)
    rows = corpus(4)
    got = sorted(tuple(r) for r in divergence_audit.audit(spark.createDataFrame(rows, "lang string, source string, text string"), 4, 3).collect())
    assert got == plain_audit(rows, 4, 3)


def test_audit_of_nothing(spark):
    empty = spark.createDataFrame([], "lang string, source string, text string")
    assert divergence_audit.audit(empty).count() == 0
    bare = spark.createDataFrame([("en", "a", None), ("en", "b", "")], "lang string, source string, text string")
    assert sorted(tuple(r) for r in divergence_audit.audit(bare).collect()) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_shares_are_exact(spark):
    rng = random.Random(0)
    rows = [(n := rng.randrange(10**rng.randint(1, 15)), n + rng.randrange(10**14), rng.randint(1, 10**9)) for _ in range(200)]
    exact = [1 + 10**9 * (n + 2) // (total + 2 * v) for n, total, v in rows]
    n, total, v = (np.array(c, np.int64) for c in zip(*rows, strict=True))
    assert divergence_audit._share(n, total, v).tolist() == exact
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, n long, total long, v long")
    got = df.select("i", divergence_audit.share(F.col("n"), F.col("total"), F.col("v")).alias("p")).orderBy("i").collect()
    assert [r.p for r in got] == exact


# ---- hard negatives


def plain_negatives(rows, every, positives, negatives):
    clean = {}
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(c is not None and np.isfinite(c) for c in v):
            own = ((label + 1) % 10 if i % 7 == 0 else label, [int(np.floor(256 * float(np.float32(c)))) for c in v])
            clean[i] = min(clean.get(i, own), own)
    size = Counter(len(v) for _, v in clean.values()).most_common(1)
    clean = {i: r for i, r in clean.items() if size and len(r[1]) == size[0][0]}
    out = []
    for a, (label, x) in clean.items():
        if a % every:
            continue
        score = {i: sum(p * q for p, q in zip(x, y, strict=True)) for i, (_, y) in clean.items() if i != a}
        for p in sorted((i for i in score if clean[i][0] == label), key=lambda i: (-score[i], i))[:positives]:
            fit = sorted((i for i in score if clean[i][0] != label and 30 * score[p] <= 100 * score[i] <= 90 * score[p]), key=lambda i: (-score[i], i))
            out += [(a, p, rank, i, score[p], score[i]) for rank, i in enumerate(fit[:negatives], 1)]
    return sorted(out)


def vectors(seed, n=240):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(c) for c in rng.standard_normal(6).astype(np.float32)], int(rng.integers(0, 4))) for i in range(-20, n)]
    # a third is one vector, with ties at every rank
    rows += [(n + i, rows[40][1], i % 5) for i in range(n // 2)]
    bad = [(1000, None, 1), (1001, [1.0] * 6, None), (1002, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (1003, [float("nan")] * 6, 1), (1004, [float("inf")] * 6, 1),
           (None, [1.0] * 6, 1), (1005, [1.0] * 5, 1), (1006, [], 2), (1007, [0.0] * 6, 1), (10, [2.0] * 6, 9), (10, [2.0] * 6, 9)]
    return rows + bad


@pytest.mark.parametrize(("seed", "options"), [(1, {}), (2, {"digit": 1, "rows_a_block": 50, "anchors_a_block": 3}), (3, {"digit": 30}), (4, {"negatives": 1, "digit": 4})])
def test_negatives_match_brute_force(spark, seed, options):
    rows = vectors(seed)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("block", F.lit("x")).withColumn("low", F.lit(1)).repartition(3)
    got = sorted(tuple(r) for r in hard_negatives.mine(df, every=10, **options).collect())
    assert got == plain_negatives(rows, 10, 5, options.get("negatives", 10)) and got


def test_scores_beyond_doubles_are_exact(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(c) for c in (rng.random(3) * 4e5).astype(np.float32)], i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert sorted(tuple(r) for r in hard_negatives.mine(df, every=10).collect()) == plain_negatives(rows, 10, 5, 10)


def test_nothing_to_mine(spark):
    schema = "vec_id long, embedding array<float>, label int"
    for rows in ([], [(1, [1.0], 1)], [(100, [1.0], 1)], [(100, None, None)], [(0, [1.0, 0.0], 1), (1, [-1.0, 0.0], 2), (2, [-1.0, 0.0], 1)]):
        assert hard_negatives.mine(spark.createDataFrame(rows, schema)).count() == 0
