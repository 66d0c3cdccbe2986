"""Walks over hierarchies, each against a plain walk, on rows where one key holds a third of all."""

import random

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import dml
from loomgraph.operators import hierarchy as H


def plain_ancestors(start, parents, cap):
    up = {}
    for i, p in parents:
        if i is not None and p is not None and i != p:
            up.setdefault(i, set()).add(p)
    found, level, seen = [], {start}, {start}
    distance = 0
    while level and distance < cap:
        distance += 1
        level = {p for i in level for p in up.get(i, ())} - seen
        seen |= level
        found += [(distance, a) for a in sorted(level)]
    return sorted(found)[:cap]


@pytest.mark.parametrize(("seed", "cap"), [(1, 5), (2, 1), (3, 8)])
def test_ancestors(spark, seed, cap):
    rng = random.Random(seed)
    # one root above a third of all, rings, ids with several parents, chains
    parents = [(i, 0) for i in range(1, 40)] + [(i, rng.randrange(120)) for i in range(120) for _ in range(rng.choice([0, 1, 1, 2]))]
    parents += [(7, 7), (None, 3), (3, None), (200, 201), (201, 200)] + [(i, i + 1) for i in range(300, 312)]
    asked = list(range(0, 130)) + [200, 300, 999, 5, 5, None]
    got = H.ancestors(spark.createDataFrame([(i,) for i in asked], "id long"), spark.createDataFrame(parents, "id long, parent long"), cap)
    expect = sorted((i, a, d) for i in set(asked) - {None} for d, a in plain_ancestors(i, parents, cap))
    assert sorted(tuple(r) for r in got.collect()) == expect


def test_no_ancestors(spark):
    none = spark.createDataFrame([], "id long, parent long")
    assert H.ancestors(spark.createDataFrame([(1,)], "id long"), none).count() == 0
    assert H.ancestors(none, none).count() == 0


def test_related_classes_keep_the_first_place(spark):
    hits = spark.createDataFrame([("x", 1, 10), ("x", 2, 11), ("x", 3, 1), ("y", 1, 1)], "asked string, nth int, id long")
    parents = spark.createDataFrame([(10, 1), (11, 1), (11, 2), (1, 0)], "id long, parent long")
    got = sorted((r.asked, r.position, r.id, r.distance) for r in H.related_classes(hits, parents).collect())
    assert got == [("x", 1, 10, 0), ("x", 2, 1, 1), ("x", 3, 0, 2), ("x", 4, 11, 0), ("x", 5, 2, 1), ("y", 1, 1, 0), ("y", 2, 0, 1)]


def test_cross_references(spark):
    rows = [(["MESH:D1", "MESH:D2", "ICD10CM:B53:x", "bad", ":x", "E:", None, "SCTID:7"],), ([],), (None,)]
    got = [r.m for r in spark.createDataFrame(rows, "x array<string>").select(H.cross_references(F.col("x")).alias("m")).collect()]
    assert got == [{"MESH": "D1", "ICD10CM": "B53:x", "SCTID": "7"}, {}, {}]


def plain_chains(merged):
    to = {o: k for o, k in merged if o is not None and k is not None and o != k}
    out = []
    for o in to:
        way, x = [o], o
        while x in to and (x := to[x]) not in way:
            way.append(x)
        last = min(way[way.index(x):]) if x in to else x
        if last != o:
            out.append((o, last))
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_chains_end_at_their_last_keeper(spark, seed):
    rng = random.Random(seed)
    ids = rng.sample(range(1000), 150)
    merged = [(i, rng.choice(ids + [5000 + i, ids[0]])) for i in ids]  # some end, some go round
    merged += [(2000 + i, 2001 + i) for i in range(70)] + [(3000, 3001), (3001, 3002), (3002, 3000), (4000, None), (4001, 4001)]
    merged += [(6000 + i, 3000) for i in range(100)]  # many into one ring
    got = sorted(tuple(r) for r in H.last_of_chains(spark.createDataFrame(merged, "old long, keeper long")).collect())
    assert got == plain_chains(merged)


def test_no_chains(spark):
    assert H.last_of_chains(spark.createDataFrame([], "old long, keeper long")).count() == 0


def test_edges_and_aliases_follow_whole_chains(spark):
    merged = H.last_of_chains(spark.createDataFrame([(1, 2), (2, 3)], "old long, keeper long"))
    edges = spark.createDataFrame([(1, "m", 0.9), (2, "m", 0.4), (3, "n", None)], "src long, dst string, confidence double")
    assert sorted(tuple(r) for r in dml.retarget(edges, merged).collect()) == [(3, "m", 0.9, 1), (3, "n", None, None)]
    nodes = spark.createDataFrame([(1, "one", ["uno", "three"]), (2, "two", None), (3, "three", ["tre"])], "source_id long, name string, aliases array<string>")
    assert [tuple(r) for r in dml.united_aliases(nodes, merged).collect()] == [(3, "three", ["one", "tre", "two", "uno"], 2)]


def test_families(spark):
    rows = spark.createDataFrame([(1, None), (2, 1), (3, 1), (5, 4), (2, 1), (None, 1)], "id long, parent long")
    assert {r.parent: r.family for r in H.families(rows).collect()} == {1: [1, 2, 3], 4: [4, 5]}


def plain_upgrade(candidates, known):
    index = {(k, i): n for k, i, n in reversed(known)}
    borne = {(k, n) for k, _, n in known}
    out = []
    for nth, keys, name in sorted(candidates):
        hit = next(((index[tuple(k)], "id", k[0]) for k in keys if tuple(k) in index), None)
        if hit is None and name is not None:
            hit = (name, "name", None)
            for k, i in keys:
                if (k, name) not in borne:
                    index[k, i] = name
                    borne.add((k, name))
        out.append((nth, *(hit or (None, "none", None))))
    return out


@pytest.mark.parametrize("seed", range(5))
def test_index_upgrade_is_the_walk(spark, seed):
    rng = random.Random(seed)
    names = [f"n{i}" for i in range(8)]
    known = [("mesh", f"D{i}", f"n{i}") for i in range(3)]
    rows = []
    for nth in rng.sample(range(1000), 160):
        keys = []
        if rng.random() < 0.5:
            keys.append(("mesh", f"D{rng.randrange(12)}"))
        if rng.random() < 0.9:
            kind = rng.choice(["efo", "doid"])
            keys.append((kind, f"{0 if rng.random() < 0.3 else rng.randrange(15)}"))
        rows.append((nth, keys, rng.choice([*names, None, None, "n0", "n0"])))
    got, index = H.upgraded_index(
        spark.createDataFrame(rows, "nth long, keys array<struct<kind:string,id:string>>, name string"), spark.createDataFrame(known, "kind string, id string, name string"))
    assert sorted(tuple(r) for r in got.collect()) == plain_upgrade(rows, known)
    assert index.groupBy("kind", "name").count().where("count > 1").count() == 0


def test_a_long_chain_of_upgrades(spark):
    """Each id is first met by a name that another id wants too: as many rounds as there are links, and the walk's result."""
    rows = [(2 * i + j, [("efo", str(i + j)), ("mesh", str(100 - i))], f"n{i}") for i in range(12) for j in (0, 1)]
    schema = "nth long, keys array<struct<kind:string,id:string>>, name string"
    got, _ = H.upgraded_index(spark.createDataFrame(rows, schema), spark.createDataFrame([], "kind string, id string, name string"))
    assert sorted(tuple(r) for r in got.collect()) == plain_upgrade(rows, [])
    assert H.upgraded_index(spark.createDataFrame([], schema), spark.createDataFrame([], "kind string, id string, name string"))[0].count() == 0
