"""Manifests without a shuffle of paths, exact distinct counts and the dispatch order over packed ids."""

import hashlib

from pyspark.sql import functions as F

from pathweave.operators import aggregates as G
from pathweave.operators import manifest as M
from pathweave.operators import paths as P

SCHEMA = "scenario_id string, cid string, text string, deps array<string>"


def _paths(spark, words, most=2):
    rows = [(s, f"C{i}", f"text {i}", []) for s in "abcd" for i in (1, 2, 3)]
    graphs = P.carry_wordings(P.gather_graphs(spark.createDataFrame(rows, SCHEMA)), words, most=most)
    return P.generate_paths(graphs, materialise=False)


def _words(spark):
    rows = [("a", "W1"), ("a", "W2"), ("b", "W1"), ("b", "W1"), ("c", "W1"), ("c", "W2"), ("c", "W3"), ("e", "W1"), (None, "W1"), ("a", None)]
    return spark.createDataFrame(rows[:-1], "scenario_id string, wording_id string"), spark.createDataFrame(
        [*rows[2:4], ("b", None)], "scenario_id string, wording_id string")


def _rows(df):
    return sorted(map(str, df.collect()))


def test_carried_wordings_give_the_joined_manifest(spark):
    words, with_null = _words(spark)
    for w, most in ((words, 2), (words, 64), (with_null, 64)):
        paths = _paths(spark, w, most)
        joined = M.build_manifest(paths.drop(P.CARRIED), w, 2)
        assert _rows(M.build_manifest(paths, w, 2)) == _rows(joined)


def test_carried_paths_are_not_joined(spark):
    paths = _paths(spark, _words(spark)[0], 64)
    counts = M.build_manifest(paths.localCheckpoint(), None, 2).groupBy("path_type").count()
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_conditions_sum_up_their_runs(spark):
    words, _ = _words(spark)
    for most in (2, 64):
        paths = _paths(spark, words, most)
        keys = ["scenario_id", "path_type", "perm_id", "terminal_wording_id"]
        nested = M.build_conditions(paths, words, 3)
        assert nested.count() == nested.select(*keys).distinct().count()
        flat = nested.select(*keys, F.inline("runs")).select(*keys, "run_id", "seed", "replicate_idx")
        assert _rows(flat) == _rows(M.build_manifest(paths, words, 3).select(*keys, "run_id", "seed", "replicate_idx"))
    assert M.build_conditions(paths, words, 0).count() == 0


def test_distinct_counts_are_exact(spark):
    rows = [("a", "x"), ("a", "x"), ("a", "y"), ("b", None), ("b", "x"), (None, "z"), (None, "z"), ("c", None)]
    df = spark.createDataFrame(rows, "k string, v string")
    got = {r.k: r.n for r in G.distinct_counts(df, "k", "v", "n").collect()}
    assert got == {"a": 2, "b": 1, None: 1}
    lone = {r.k: r.n for r in G.distinct_counts(df.filter("k = 'a'").distinct(), "k", "v", "n").collect()}
    assert lone == {"a": 2}


def test_dispatch_order_of_any_run_id(spark, monkeypatch):
    ids = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(200)] + ["odd", "A" * 64, "a" * 63, "", "a" * 64 + "\n"]
    df = spark.createDataFrame([(r, i % 7 if i % 5 else None) for i, r in enumerate(ids)], "run_id string, seed int")
    written = []
    cut = G.cut_lineage
    monkeypatch.setattr(G, "cut_lineage", lambda d, name="x": written.append(d) or cut(d, name))
    got = M.dispatch_order(df, 8).orderBy("position").collect()
    key = lambda r: hashlib.sha256("\x1f".join([r.run_id, *([str(r.seed)] if r.seed is not None else [])]).encode()).hexdigest()
    expected = sorted(df.collect(), key=lambda r: (key(r), r.run_id))
    assert [(r.run_id, r.seed) for r in got] == [tuple(r) for r in expected]
    assert [r.dispatch_key for r in got] == [key(r) for r in got] and [r.position for r in got] == list(range(1, len(ids) + 1))
    assert "dispatch_key" not in written[0].columns and "run_id" not in written[0].columns


def test_resolving_a_design_shuffles_no_run(spark):
    words, with_null = _words(spark)
    now = spark.createDataFrame([("a", "W1", "x"), ("a", "W1", "y"), ("b", "W1", "z"), ("c", "W3", None)], "scenario_id string, wording_id string, wording string")
    scen = spark.createDataFrame([("a",), ("a",), ("c",), ("d",), (None,)], "scenario_id string")
    reasons = set()
    for w, most in ((words, 2), (words, 64), (with_null, 64)):
        paths = _paths(spark, w, most).localCheckpoint()
        kept = paths.filter("path_type <> 'skipped'")
        want = M.resolve_manifest(M.build_manifest(paths, w.join(paths.filter("wording_ids IS NULL"), "scenario_id", "left_semi"), 3), scen, kept, now)
        got = M.resolve_design(paths, w.join(paths.filter("wording_ids IS NULL"), "scenario_id", "left_semi"), scen, kept, now, 3)
        assert sorted(got.columns) == sorted(want.columns)
        assert _rows(got.select(*want.columns)) == _rows(want)
        reasons |= {r.resolve_error for r in want.select("resolve_error").distinct().collect()}
    assert reasons == {None, "unknown scenario", "unknown path", "unknown wording"}
    plan = got.groupBy("resolve_error").count()._jdf.queryExecution().optimizedPlan().toString().splitlines()
    first = [next(i for i, line in enumerate(plan) if name in line) for name in ("Generate", "Join")]
    assert first[0] < first[1]  # the runs' generator is above the joins


def test_key_head_begins_the_same_key(spark):
    from pathweave.functions.identity import key_head, keyed_hash
    df = spark.createDataFrame([("a", "b", 1), (None, "b", 1), ("a", None, 2), (None, None, 3), ("", None, 4), ("", "", None)], "a string, b string, c int")
    same = df.select(keyed_hash(F.col("a"), F.col("b"), F.col("c")).alias("x"), keyed_hash(key_head(F.col("a"), F.col("b")), F.col("c")).alias("y"))
    assert all(r.x == r.y for r in same.collect())


def test_run_keys_begin_with_one_head_a_condition(spark):
    plan = M.build_manifest(_paths(spark, _words(spark)[0], 64).localCheckpoint(), None, 3)._jdf.queryExecution().optimizedPlan().toString()
    runs = plan.splitlines()[0]
    assert "_run_head" in runs and "scenario_id" not in runs.split("AS run_id")[0]


def test_first_orders_are_found_once_a_shape(spark):
    rows = [(s, f"C{i}", "t", []) for s in "abcd" for i in (1, 2, 3)]
    g = P.with_masks(P.gather_graphs(spark.createDataFrame(rows, SCHEMA))).localCheckpoint()
    plan = P.length_matched_paths(g)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [" not in plan  # shapes are read, so no filter of theirs can sink to the graphs
    assert P.length_matched_paths(g).count() == 4


def test_hash_positions_take_no_sample(spark):
    digest = F.sha2(F.col("id").cast("string"), 256)
    df = spark.range(500).union(spark.range(20)).toDF("id")
    got, total = G.hash_positions(df, digest, ["id"])
    plain, same = G.global_positions(df, [digest, F.col("id")])
    assert total == same == 520
    rows = lambda x: [tuple(r) for r in x.orderBy("position").select("id", "position").collect()]
    assert rows(got) == rows(plain)
    assert got.columns == ["id", "position"]


def test_dispatch_order_samples_no_range(spark, monkeypatch):
    written = []
    cut = G.cut_lineage
    monkeypatch.setattr(G, "cut_lineage", lambda d, name="x": written.append(d._jdf.queryExecution().optimizedPlan().toString()) or cut(d, name))
    M.dispatch_order(spark.createDataFrame([("a", 1), ("b", 2)], "run_id string, seed int"), 2).collect()
    assert "ASC" in written[0] and "RepartitionByExpression [" in written[0]
    assert "ASC" not in written[0].split("RepartitionByExpression [")[1].splitlines()[0]
