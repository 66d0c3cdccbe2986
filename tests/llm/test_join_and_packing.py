import itertools
import json
import random
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomgraph.llm import common, ngram_join, packing
from loomgraph.llm.components import components
from loomgraph.llm.ngram_join import Rule


def brute_components(rows, rule):
    def shingles(text):
        w = [bytes(x).lower() for x in (text or "").encode().split()]
        return frozenset(b" ".join(w[i : i + rule.k]) for i in range(max(1, len(w) - rule.k + 1))) if w else frozenset()

    sets = {i: shingles(t) for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= rule.percent * len(x | y):
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_copies(seed, n=120):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    common_part = rng.choices(words, k=30)
    rows = []
    for i in range(n):
        kind = rng.random()
        if rows and kind < 0.55:
            base = (rng.choice(rows)[1] or "a").split()
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                base[rng.randrange(len(base))] = rng.choice(words)
            rows.append((i, " ".join(base)))
        elif kind < 0.6:
            rows.append((i, rng.choice([None, "", "  ", "One", "one two THREE"])))
        else:
            rows.append((i, " ".join(rng.choices(words, k=rng.randint(5, 120)) + common_part * (rng.random() < 0.5))))
    return rows


@pytest.mark.parametrize(("seed", "rule"), [(1, Rule(4, 85)), (2, Rule(5, 80)), (3, Rule(3, 50))])
def test_components_match_brute_force(spark, seed, rule):
    rows = near_copies(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component", F.lit("clash"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs, rule).collect()}
    assert got == brute_components(rows, rule)


def test_a_posting_list_is_never_split(spark, monkeypatch):
    # x's prefix is [V, T] and y's is [T, U]: T alone is of a small list, and all tie in the global order
    rule = ngram_join.Rule(1, 50)
    words = [f"w{i}" for i in range(200)]
    order = sorted(words, key=lambda w: int(next(ngram_join.sets_of([w], 1, common.WordHash()))[0]))
    v, t, u, rest = order[0], order[1], order[2], order[3:5]
    sketch = np.full(1 << ngram_join.SKETCH_BITS, 5000, np.int32)
    slot = next(ngram_join.sets_of([t], 1, common.WordHash()))[0] >> np.uint64(64 - ngram_join.SKETCH_BITS)
    sketch[int(slot)] = 100
    monkeypatch.setattr(ngram_join, "frequency_sketch", lambda *a: sketch)
    monkeypatch.setattr(ngram_join, "choose_matches", lambda *a: 1)
    docs = spark.createDataFrame([(1, " ".join([v, t, rest[0]])), (2, " ".join([t, u, rest[0]]))], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(docs, rule).collect()}
    assert got == {1: 1, 2: 1}


def test_null_ids_repeats_and_empty_input(spark):
    rows = [(None, "a b c d e"), (5, "a b c d e"), (5, "a b c d e"), (7, "A B C D E"), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in ngram_join.near_duplicates(docs).collect()), key=str)
    assert got == [(5, 5), (5, 5), (7, 5), (9, 9), (None, None)]
    assert ngram_join.near_duplicates(docs.limit(0)).count() == 0


def test_an_id_with_several_texts_keeps_each(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(1, a), (5, a), (5, b), (5, ""), (7, b), (9, b + " end"), (11, "other words"), (11, ""), (13, a), (13, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(docs).collect()}
    assert got == {1: 1, 5: 1, 7: 1, 9: 1, 11: 11, 13: 1}


def test_more_matches_lose_no_link():
    rng = random.Random(4)
    rule = Rule(1, 70)
    for _ in range(3000):
        x = set(rng.sample(range(60), rng.randint(1, 25)))
        y = {v for v in x if rng.random() < 0.9} | set(rng.sample(range(60), rng.randint(0, 3)))
        if not y or 100 * len(x & y) < rule.percent * len(x | y):
            continue
        lx, ly = rng.randint(1, min(4, rule.need(len(x)))), rng.randint(1, min(4, rule.need(len(y))))
        px = set(sorted(x)[: len(x) - rule.need(len(x)) + lx])
        py = set(sorted(y)[: len(y) - rule.need(len(y)) + ly])
        assert len(px & py) >= min(lx, ly)


def test_costly_prefixes_ask_for_more_matches():
    assert ngram_join.choose_matches(np.zeros(20), 100, 85) == 1
    assert ngram_join.choose_matches(np.full(20, 500), 100, 85) > 1


def test_component_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (7, 7)], "a long, b long")
    got = {r.vertex: r.component for r in components(edges).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in (100, 101, 102)} == {100}
    assert components(edges.limit(0)).count() == 0


TEXTS = ["", "Hello, world's  BEST\tday 123!", "<|endoftext|> x", "ÉÉ é ß 日本語 🎉", "word " * 9000, None, "a" * 30000]


def test_chunked_ids_equal_whole_texts():
    path = public_tokenizers.path(packing.TOKENIZER)
    texts = [t or "" for t in TEXTS] + [" \x0b\x0c\x1c\x85\u2003Wide spaces\u00a0here ", "a\x01b \x01 \x01\x01 c\x02", "\x01", "\u200b \u2003 \u00ad x"]
    # every letter of the Latin blocks, in capitals and with marks
    texts += [f"{chr(c)}{chr(c)}a, x{chr(c)}!? {chr(c)}" for c in range(0x41, 0x250)]
    tokenizer = packing.ChunkTokenizer(path)
    whole = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):
        ids, size = tokenizer.batch(pa.array(texts))
        assert [x.tolist() for x in np.split(ids, np.cumsum(size)[:-1])] == whole
    assert [len(x) for x in tokenizer.batch(pa.array([], pa.string()))] == [0, 0]


def ids_of(tokenizer, texts):
    ids, size = tokenizer.batch(pa.array(texts))
    return [x.tolist() for x in np.split(ids, np.cumsum(size)[:-1])]


def test_common_chunks_outlive_a_full_cache(monkeypatch):
    monkeypatch.setattr(packing, "CACHED", 150)
    path = public_tokenizers.path(packing.TOKENIZER)
    tokenizer, plain, seen = packing.ChunkTokenizer(path), Tokenizer.from_file(path), []
    encode = tokenizer._encode
    monkeypatch.setattr(tokenizer, "_encode", lambda words, *more: seen.extend(words) or encode(words, *more))
    for i in range(20):
        rare = "".join(f" {chr(97 + i)}{chr(97 + k // 26)}{chr(97 + k % 26)}q" for k in range(50))
        texts = [f"common Words, 42 ***{rare}", "Common words! <|endoftext|>"]
        assert ids_of(tokenizer, texts) == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
        assert len(tokenizer.index) < 300
    # before, a full cache was emptied, and they were tokenised again and again
    assert [seen.count(w) for w in ("common", "words", "42", "***", ",")] == [1] * 5


def test_words_are_put_together_only_for_the_known_tokenizer(tmp_path):
    config = json.loads(Path(public_tokenizers.path(packing.TOKENIZER)).read_text())
    config["normalizer"] = {"type": "NFC"}
    (tmp_path / "cased.json").write_text(json.dumps(config))
    texts = ["Cased words, CASED wOrds.", "cased 12 É! é", ""]
    whole = [e.ids for e in Tokenizer.from_file(f"{tmp_path}/cased.json").encode_batch(texts, add_special_tokens=False)]
    assert whole != [e.ids for e in Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER)).encode_batch(texts, add_special_tokens=False)]
    assert ids_of(packing.ChunkTokenizer(f"{tmp_path}/cased.json"), texts) == whole


def test_batches_are_put_together_within_bounds():
    sizes = [(3, 1), (0, 1), (4, 2), (5, 1), (1, 900), (2, 1), (20, 1), (1, 1)]
    batches = [pa.record_batch([pa.array(["x" * size] * rows, pa.string())], ["text"]) for rows, size in sizes]
    made = list(packing.put_together(iter(batches), 8, 500))
    assert [len(b) for b in made] == [7, 5, 1, 2, 20, 1]
    assert [t for b in made for t in b["text"].to_pylist()] == [t for b in batches for t in b["text"].to_pylist()]
    assert list(packing.put_together(iter([]), 8, 500)) == []


def test_counts_by_shuffle_give_the_same_places(spark, monkeypatch):
    docs = spark.range(300).selectExpr("id AS doc_id", "repeat('some words here ', cast(id % 70 AS int) * 40) AS text").repartition(7)
    docs = common.materialize(docs, "docs")
    one = {(r.doc_id, r.piece): r for r in packing.pack(docs).collect()}
    monkeypatch.setattr(packing, "BROADCAST_TASKS", 0)
    assert {(r.doc_id, r.piece): r for r in packing.pack(docs).collect()} == one


def test_packing_is_lossless_and_gapless(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)) + [(None, "x"), (1, "again")], "doc_id long, text string").withColumn("task", F.lit("clash"))
    rows = packing.pack(docs).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    for i, text in [(0, TEXTS[0]), (3, TEXTS[3]), (4, TEXTS[4]), (5, TEXTS[5])]:
        mine = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        ids = np.concatenate([np.frombuffer(r.token_ids, "<u4") for r in mine]).tolist()
        assert ids == [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        assert all(r.length == packing.CAPACITY for r in mine[:-1]) and [r.start for r in mine] == [k * packing.CAPACITY for k in range(len(mine))]
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert packing.pack(docs.limit(0)).count() == 0


def brute_bins(lengths, capacity):
    """First-fit decreasing, piece by piece, for comparison of the number of bins."""
    bins = []
    for x in sorted(lengths, reverse=True):
        for i, left in enumerate(bins):
            if left >= x:
                bins[i] -= x
                break
        else:
            bins.append(capacity - x)
    return len(bins)


def test_plan_places_every_piece_once_and_packs_well():
    rng = np.random.default_rng(3)
    for n in (1, 7, 60, 900):
        length = np.minimum(rng.geometric(0.03, n), 100)
        counts = np.bincount(length, minlength=101)
        plan = packing.best_two_fit(counts, 100)
        rank = np.array([int((length[:i] == x).sum()) for i, x in enumerate(length)])
        seq, offset = packing.place(length, rank, plan)
        spots = sorted(zip(seq.tolist(), offset.tolist(), length.tolist(), strict=True))
        for (s, o, l), (s2, o2, _) in itertools.pairwise(spots):
            assert (s2, o2) == (s, o + l) or (s2 > s and o2 == 0)
        assert np.bincount(seq, length).max() <= 100
        assert len(set(seq.tolist())) <= brute_bins(length, 100)


def test_two_pieces_replace_the_smallest():
    counts = np.zeros(101, int)
    counts[[60, 25, 22, 17]] = 1
    plan = packing.best_two_fit(counts, 100)  # greedy takes 60, 25; then 25 gives way to 22 and 17, a tighter fit
    assert {tuple(r[[0, 3]]) for r in plan} == {(60, 0), (22, 0), (17, 0), (25, 1)}


def test_query_digest(spark, tmp_path):
    spark.createDataFrame([(1, "hello there")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    row = packing.op6_packing(spark, str(tmp_path)).first()
    ids = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER)).encode("hello there", add_special_tokens=False).ids
    assert row.ids_crc32 == zlib.crc32(np.array([*ids, 1], "<u4").tobytes())


def test_bitmaps_never_rule_out_a_link():
    rng = np.random.default_rng(5)
    for rule in (Rule(4, 85), Rule(4, 60)):
        for _ in range(400):
            x = np.unique(rng.integers(0, 2**63, rng.integers(1, 1200)).astype(np.uint64))
            y = np.unique(np.concatenate([x[rng.random(len(x)) < 0.93], rng.integers(0, 2**63, rng.integers(0, 60)).astype(np.uint64)]))
            both = len(np.intersect1d(x, y))
            differ = ngram_join.differing_bits(ngram_join.parity_bitmap(x), ngram_join.parity_bitmap(y))
            assert differ <= len(x) + len(y) - 2 * both
            if len(y) and rule.met(len(x), len(y), both):
                assert differ <= ngram_join.unlike_bits_allowed(rule, np.int64(len(x)), np.int64(len(y)))


def test_long_lists_and_large_hubs_are_dealt_out(spark, monkeypatch):
    rows = near_copies(6)
    plain = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    monkeypatch.setattr(ngram_join, "HUB_GROUP", 2)
    monkeypatch.setattr(ngram_join, "PAIR_GROUP", 3)
    monkeypatch.setattr(ngram_join, "SMALL_LIST", 2)
    monkeypatch.setattr(common, "HOT_LEAST", 2)
    monkeypatch.setattr(common, "HOT_KEYS", 20)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    dealt = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert dealt == plain == {i: c for i, (_, c) in brute_components(rows, Rule()).items()}
