"""What is kept between runs: streams that are restarted, results that are resumed, answers, versions, constraints."""

import random

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import constraints
from loomgraph.sources import resume
from loomgraph.sources.cache import AnswerCache
from loomgraph.sources.versions import Broken, Versions
from loomgraph.streaming import status

OUTCOMES = "key string, seq long, outcome string, edges array<string>"


def plain_states(rows):
    state = {}
    for key, seq, outcome, edges in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: (r[1], r[2])):
        old = state.get(key, (None, None, None, []))
        if outcome == "transient":
            state[key] = (seq, "error", old[2], old[3])
        else:
            found = (edges or []) if outcome == "ok" else []
            state[key] = (seq, "linked" if found else "no_targets_found", seq, found)
    return state


def some_outcomes(seed, n=200):
    rng = random.Random(seed)
    rows = []
    for seq in range(n):
        outcome = rng.choice(["ok", "ok", "miss", "transient", "transient"])
        key = "hot" if rng.random() < 0.35 else f"k{rng.randrange(12)}"
        rows.append((key, seq, outcome, [f"e{rng.randrange(5)}" for _ in range(rng.randrange(3))] if outcome == "ok" else None))
    return rows + [(None, 5, "ok", ["x"]), ("k1", None, "ok", ["x"]), ("new", 1, "transient", None)]


def states_of(df):
    return {r.key: (r.seq, r.status, r.edge_seq, list(r.edges)) for r in df.collect()}


@pytest.mark.parametrize("seed", range(3))
def test_settled_is_the_walk_whatever_the_order(spark, seed):
    rows = some_outcomes(seed)
    again = rows + random.Random(seed).sample(rows, 60)
    random.Random(seed).shuffle(again)
    assert states_of(status.settled(spark.createDataFrame(again, OUTCOMES))) == plain_states(rows)


def test_a_failure_deletes_nothing_and_a_miss_does(spark):
    rows = [("a", 1, "ok", ["x"]), ("a", 2, "transient", None), ("b", 1, "ok", ["x"]), ("b", 2, "miss", None), ("c", 1, "transient", None)]
    assert states_of(status.settled(spark.createDataFrame(rows, OUTCOMES))) == {"a": (2, "error", 1, ["x"]), "b": (2, "no_targets_found", 2, []), "c": (1, "error", None, [])}


def test_a_stream_that_is_restarted(spark, tmp_path):
    rows = some_outcomes(7)
    come, log, checkpoint = str(tmp_path / "come"), str(tmp_path / "log"), str(tmp_path / "checkpoint")

    def arrive(part):
        spark.createDataFrame(part, OUTCOMES).coalesce(1).write.mode("append").parquet(come)

    def run():
        stream = spark.readStream.schema(OUTCOMES).option("maxFilesPerTrigger", 1).parquet(come)
        query = status.follow(stream, log, checkpoint)
        query.awaitTermination()

    arrive(rows[120:])  # later ones come first
    arrive(rows[:40])
    run()
    assert states_of(status.current(spark, log)) == plain_states(rows[120:] + rows[:40])
    before = states_of(status.current(spark, log))
    run()  # nothing new
    assert states_of(status.current(spark, log)) == before
    arrive(rows[40:120])
    arrive(rows[:80])  # delivered again
    run()
    assert states_of(status.current(spark, log)) == plain_states(rows)
    # a batch that is run again, as after a crash between its write and the checkpoint, changes nothing
    parts = sorted(int(r.batch) for r in spark.read.parquet(log).select("batch").distinct().collect())
    rows_of_last = spark.read.parquet(log).where(F.col("batch") == parts[-1]).drop("batch")
    part = spark.createDataFrame(rows_of_last.collect(), rows_of_last.schema)
    n = spark.read.parquet(log).count()
    status.write_batch(part, log, parts[-1])
    assert spark.read.parquet(log).count() == n and states_of(status.current(spark, log)) == plain_states(rows)
    status.compact(spark, log, str(tmp_path / "small"))
    small = spark.read.parquet(str(tmp_path / "small"))
    assert small.count() == len(plain_states(rows)) and states_of(status.current(spark, str(tmp_path / "small"))) == plain_states(rows)


def test_what_the_next_run_asks_for(spark):
    state = spark.createDataFrame([("a", "linked"), ("b", "error"), ("c", "no_targets_found")], "key string, status string")
    wanted = spark.createDataFrame([(k,) for k in "abcdd"], "key string")
    asked = lambda **how: sorted(r.key for r in status.unfinished(wanted, state, **how).collect())
    assert asked() == ["d"] and asked(retry=("error",)) == ["b", "d"] and asked(force=True) == ["a", "b", "c", "d"]


CASES = "case_id string, output_hash string, model string, n int"


def test_parts_are_resumed_after_a_kill(spark, tmp_path):
    wanted = spark.createDataFrame([(f"c{i}", f"h{i % 7}", "m", i) for i in range(200)], CASES)
    made = []

    def make(rows, dies_at=None):
        made.append(rows.count())
        if len(made) == dies_at:
            raise KeyboardInterrupt
        return rows.withColumn("score", F.col("n") * 2)

    path = str(tmp_path / "results")
    with pytest.raises(KeyboardInterrupt):
        resume.make_in_parts(wanted, lambda r: make(r, 3), path, every=30)
    assert resume.finished_parts(spark, path) == [0, 1]
    # a part that was half written when it was lost has no marker
    wanted.limit(3).withColumn("score", F.lit(-1)).write.parquet(f"{path}/part=2")
    half = len(made)
    got = resume.make_in_parts(wanted, make, path, every=30)
    whole = sorted((r.case_id, r.score) for r in got.collect())
    assert whole == sorted((f"c{i}", 2 * i) for i in range(200))
    parts = len(resume.finished_parts(spark, path))
    assert parts == 7 and len(made) - half == parts - 2
    again = resume.make_in_parts(wanted, make, path, every=1)
    assert sorted((r.case_id, r.score) for r in again.collect()) == whole and len(made) - half == parts - 2 + 1  # once for the columns, on no rows
    assert made[-1] == 0


def test_results_hold_for_the_same_case_payload_and_model(spark):
    wanted = spark.createDataFrame([("a", "1", "m", 0), ("b", "1", "m", 0), ("c", None, "m", 0), ("d", "1", "m", 0)], CASES)
    results = spark.createDataFrame([("a", "1", "m", 5), ("a", "1", "m", 6), ("b", "2", "m", 7), ("c", None, "m", 8), ("d", "1", "x", 9), ("z", "1", "m", 1)], CASES)
    held, left = resume.split_by_results(wanted, results)
    assert sorted((r.case_id, r.n) for r in held.collect()) == [("a", 5), ("c", 8)]
    assert sorted(r.case_id for r in left.collect()) == ["b", "d"]


def test_answers_are_kept_and_asked_once(spark, tmp_path):
    root = str(tmp_path / "cache")
    cache = AnswerCache(spark, "kept_answers", root, buckets=4)
    asked = spark.createDataFrame([("a", 2, "late"), ("a", 1, "first"), ("b", 3, "b"), (None, 4, "none")], "key string, nth int, name string")
    found, missing = cache.look_up(asked)
    assert not found.where("known").count() and sorted((r.key, r.name) for r in missing.collect()) == [("a", "first"), ("b", "b")]
    assert cache.write_back(spark.createDataFrame([("a", "A"), ("b", None)], "key string, value string")) == 1
    found, missing = cache.look_up(asked)
    assert sorted((r.key or "", r.known, r.value) for r in found.collect()) == [("", False, None), ("a", True, "A"), ("a", True, "A"), ("b", True, None)]
    assert missing.count() == 0
    # another session knows nothing but the folder
    spark.sql("DROP TABLE kept_answers_v1")
    cache = AnswerCache(spark, "kept_answers", root, buckets=4)
    for version, fresh in ((2, [("b", "B"), ("b", None), ("c", None)]), (3, [("a", None)]), (4, [])):
        assert cache.write_back(spark.createDataFrame(fresh, "key string, value string")) == version
    assert sorted(tuple(r) for r in cache.answers().collect()) == [("a", None), ("b", "B"), ("c", None)]
    assert sorted(p.name for p in (tmp_path / "cache").glob("v=*")) == ["v=3", "v=4"]


def test_the_cache_is_not_shuffled(spark, tmp_path):
    cache = AnswerCache(spark, "wide_answers", str(tmp_path / "cache"), buckets=4)
    cache.write_back(spark.range(1000).select(F.col("id").cast("string").alias("key"), F.lit("v").alias("value")))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found, _ = cache.look_up(spark.range(100).select(F.col("id").cast("string").alias("key"), F.col("id").alias("nth")))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
        assert found.where("known").count() == 100
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_versions_share_folders_and_wipes_spare_them(spark, tmp_path):
    store = Versions(spark, str(tmp_path / "graph"))
    one, two = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string"), spark.createDataFrame([(1, 0.5)], "src long, sure double")
    assert store.last() == 0 and store.commit({"nodes": one, "edges": two}) == 1
    assert store.clone("trial") == 1 and store.folders("trial") == store.folders()
    assert store.commit({"nodes": store.read("nodes", "trial").where("id = 1")}, "trial") == 2
    assert store.read("nodes").count() == 2 and store.read("nodes", "trial").count() == 1 and store.folders("trial")["edges"] == store.folders()["edges"]
    assert store.read("nodes", "trial", 1).count() == 2
    folders = lambda: {p.name for p in (tmp_path / "graph" / "data").iterdir()}
    assert len(folders()) == 3
    store.wipe("trial")
    assert store.branches() == ["main"] and folders() == set(store.folders().values())
    assert store.commit({"edges": None}, note="batch 7") == 2 and store.tables() == ["nodes"] and store.read("edges", version=1).count() == 1
    assert store.commit({"nodes": one.limit(0)}, note="batch 7") == 2 and store.read("nodes").count() == 2  # the same batch again
    with pytest.raises(ValueError):
        store.clone("main")


def test_broken_rows_are_not_committed(spark, tmp_path):
    store = Versions(spark, str(tmp_path / "graph"))
    rows = spark.createDataFrame([(1, 0.5), (2, 1.5), (None, 0.1), (3, None)], "id long, sure double")
    rules = {"t": {"key": F.col("id").isNotNull(), "sure": F.col("sure").between(0, 1)}}
    with pytest.raises(Broken, match=r"t: key \(1 rows\), t: sure \(1 rows\)"):
        store.commit({"t": rows}, rules=rules)
    assert store.last() == 0 and not list((tmp_path / "graph" / "data").iterdir())
    assert store.commit({"t": rows.where("id = 1")}, rules=rules) == 1


def test_two_commits_of_one_version(spark, tmp_path):
    store = Versions(spark, str(tmp_path / "graph"))
    store.commit({"t": spark.range(3)})
    with pytest.raises(RuntimeError):
        store._put("main", 1, {"tables": {}, "note": None})
    assert store.read("t").count() == 3


def test_constraint_reports(spark):
    nodes = spark.createDataFrame([(1,), (1,), (2,), (None,), (None,)], "id long")
    assert {r.rule: r.n for r in constraints.key_report(nodes, "n", ["id"]).collect()} == {"without_key": 2, "repeated_key": 1}
    edges = spark.createDataFrame([(1, 2), (1, 9), (8, 9), (None, 2)], "src long, dst long")
    got = {r.rule: r.n for r in constraints.end_report(edges, "e", {"src": (nodes, "id"), "dst": (nodes, "id")}).collect()}
    assert got == {"lost_src": 2, "lost_dst": 2}
    assert {r.n for r in constraints.key_report(nodes.limit(0), "n", ["id"]).collect()} == {0}
