"""Ledger semantics: upsert, insert-or-ignore, update application, resume set."""
import datetime as dt

from pathweave.operators import ledger as L
from pathweave.operators import manifest as M


def test_upsert_replaces_whole_row(spark):
    old = spark.createDataFrame([("a", "t1", 3), ("b", "t1", 4)], "scenario_id string, type string, n int")
    new = spark.createDataFrame([("b", "t2", 5), ("c", "t3", 3)], "scenario_id string, type string, n int")
    got = sorted(map(tuple, L.upsert(old, new).collect()))
    assert got == [("a", "t1", 3), ("b", "t2", 5), ("c", "t3", 3)]


def test_insert_or_ignore(spark):
    old = spark.createDataFrame([("r1", 1), ("r2", 2)], "run_id string, v int")
    new = spark.createDataFrame([("r2", 9), ("r3", 3), ("r3", 3)], "run_id string, v int")
    assert sorted(map(tuple, L.insert_or_ignore(old, new, "run_id").collect())) == [("r3", 3)]


def test_updates_replace_outcomes_and_resume(spark):
    man = spark.createDataFrame([("r1", "pending"), ("r2", "pending"), ("r3", "pending")],
                                "run_id string, status string")
    t0 = dt.datetime(2024, 1, 1)
    ups = spark.createDataFrame(
        [("r1", t0, "running", None, None), ("r1", t0 + dt.timedelta(1), "complete", 1, 120),
         ("r2", t0, "complete", 0, 80), ("r2", t0 + dt.timedelta(2), "failed", None, None)],
        "run_id string, ts timestamp, status string, verdict int, total_tokens int")
    cur = {r.run_id: (r.status, r.verdict, r.total_tokens) for r in L.current_state(man, ups).collect()}
    assert cur == {"r1": ("complete", 1, 120), "r2": ("failed", None, None), "r3": ("pending", None, None)}
    resume = sorted(r.run_id for r in M.resume_set(man, L.current_state(man, ups)).collect())
    assert resume == ["r2", "r3"]
    counts = {r.status: r.n for r in L.count_by_status(L.current_state(man, ups)).collect()}
    assert counts == {"complete": 1, "failed": 1, "pending": 1}


def test_replicates_guard_and_manifest_ids(spark):
    paths = spark.createDataFrame([("s", "direct", "[F]", "p0")],
                                  "scenario_id string, path_type string, path_signature string, perm_id string")
    words = spark.createDataFrame([("s", "W1"), ("s", "W2")], "scenario_id string, wording_id string")
    assert M.build_manifest(paths, words, 0).count() == 0
    m = M.build_manifest(paths, words, 3).collect()
    assert len(m) == 6 and len({r.run_id for r in m}) == 6 and all(r.status == "pending" for r in m)
    again = M.build_manifest(paths, words, 3).collect()
    assert sorted(r.run_id for r in m) == sorted(r.run_id for r in again)
    assert all(0 <= r.seed < 2 ** 28 for r in m)


def test_updates_without_outcome_columns_clear_them(spark):
    man = spark.createDataFrame([("r1", "complete", 1, "m1"), ("r2", "complete", 1, "m1")],
                                "run_id string, status string, verdict int, model_version string")
    ups = spark.createDataFrame([("r1", 5, "failed")], "run_id string, ts long, status string")
    got = {r.run_id: (r.status, r.verdict, r.model_version) for r in L.current_state(man, ups).collect()}
    assert got == {"r1": ("failed", None, None), "r2": ("complete", 1, "m1")}


def test_updates_of_one_time_go_by_the_tie_column(spark):
    man = spark.createDataFrame([("r1", "pending")], "run_id string, status string")
    ups = spark.createDataFrame([("r1", 5, i, f"s{i}") for i in (2, 9, 4)], "run_id string, ts long, event_id long, status string")
    assert L.current_state(man, ups, tie_col="event_id").first().status == "s9"


def test_first_write_wins(spark):
    from pathweave.operators import transcripts as T

    old = spark.createDataFrame([("k0", "old")], "cache_key string, content string")
    new = spark.createDataFrame([("k1", "late", 7), ("k1", "first", 2), ("k0", "new", 1), ("k1", "mid", 5)],
                                "cache_key string, content string, batch long").repartition(4)
    got = {r.cache_key: r.content for r in T.store_responses(old, new, ordinal="batch").collect()}
    assert got == {"k0": "old", "k1": "first"}
    rows = L.insert_or_ignore(old, new, "cache_key", ordinal="batch").collect()
    assert [tuple(r) for r in rows] == [("k1", "first")]


def test_insert_or_ignore_within_partitions_shuffles_no_row(spark):
    schema = "scenario_id string, run_id string, path_type string"
    old = [("s", "a", "x"), ("t", "b", "x"), (None, "c", "x"), ("s", None, "x"), ("s", "a", "x")]
    new = [("s", "a", "y"), ("s", "d", "y"), ("s", "d", "y"), ("t", "e", None), (None, "c", "y"), (None, "f", "y"), ("s", None, "y"), ("t", "b", "y")]
    existing, incoming = (spark.createDataFrame(rows, schema).localCheckpoint().repartition(3, "scenario_id") for rows in (old, new))
    rows = lambda df: sorted(map(str, df.collect()))
    got = L.insert_or_ignore(existing, incoming, "run_id", within=["scenario_id"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2 and "Join" not in plan  # the two that deal the tables out
    assert got.columns == existing.columns
    assert rows(got) == rows(L.insert_or_ignore(existing, incoming, "run_id"))
    batch = spark.createDataFrame([("s", "d", "late", 2), ("s", "d", "early", 1)], schema + ", pos int")
    assert [r.path_type for r in L.insert_or_ignore(existing, batch, "run_id", "pos", within=["scenario_id"]).collect()] == ["early"]
