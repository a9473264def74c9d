"""Path expansion: golden values of the three fixture DAGs, brute force on random DAGs."""
import hashlib
import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from pathweave.functions.text import FILLER_TURN_PREFIX, FIRST_TURN_PREFIX, NEXT_TURN_PREFIX, FillerPlan
from pathweave.operators import paths as P

SCHEMA = "scenario_id string, cid string, text string, deps array<string>"
CHAIN = [("chain", "C1", "first", []), ("chain", "C2", "second", ["C1"]), ("chain", "C3", "third", ["C2"])]
INDEP = [("indep", "C1", "a", []), ("indep", "C2", "b", []), ("indep", "C3", "c", [])]
DIAMOND = [("diamond", "C1", "x", []), ("diamond", "C2", "y", ["C1"]), ("diamond", "C3", "z", ["C1"]),
           ("diamond", "C4", "w", ["C2", "C3"])]


def _paths(spark, rows, types=None):
    g = P.gather_graphs(spark.createDataFrame(rows, SCHEMA))
    return [r.asDict() for r in P.generate_paths(g, types).collect()]


def _py_id(sig, turns):
    return hashlib.sha256(json.dumps({"signature": sig, "turns": turns}, sort_keys=True).encode()).hexdigest()[:16]


@pytest.fixture(scope="module")
def fixture_paths(spark):
    return _paths(spark, CHAIN + INDEP + DIAMOND)


def _of(paths, scen, kind):
    return sorted((p for p in paths if p["scenario_id"] == scen and p["path_type"] == kind),
                  key=lambda p: p["path_signature"])


def test_ordering_counts(fixture_paths):
    assert len(_of(fixture_paths, "chain", "sequential")) == 1
    assert len(_of(fixture_paths, "indep", "sequential")) == 6
    assert len(_of(fixture_paths, "diamond", "sequential")) == 2


def test_chain_signature_and_turns(fixture_paths):
    (p,) = _of(fixture_paths, "chain", "sequential")
    assert p["path_signature"] == "[C1][C1,C2][C1,C2,C3][F]"
    assert p["turns"] == [FIRST_TURN_PREFIX + "first", NEXT_TURN_PREFIX + "second", NEXT_TURN_PREFIX + "third"]
    assert p["n_turns"] == 3 and p["components_used"] == ["C1", "C2", "C3"]


def test_skipped_and_alt_counts(fixture_paths):
    assert [p["path_signature"] for p in _of(fixture_paths, "chain", "skipped")] == ["[C1][F]"]
    assert len(_of(fixture_paths, "indep", "skipped")) == 3
    assert [p["path_signature"] for p in _of(fixture_paths, "chain", "alt_grouping")] == ["[C1,C2][F]"]
    assert len(_of(fixture_paths, "indep", "alt_grouping")) == 3
    assert sorted(p["path_signature"] for p in _of(fixture_paths, "diamond", "alt_grouping")) == [
        "[C1,C2,C3][F]", "[C1,C2][F]", "[C1,C3][F]"]


def test_direct_and_filler(fixture_paths):
    for scen in ("chain", "indep", "diamond"):
        (d,) = _of(fixture_paths, scen, "direct")
        assert d["path_signature"] == "[F]" and d["n_turns"] == 0 and d["turns"] == []
        (lm,) = _of(fixture_paths, scen, "length_matched")
        assert lm["path_signature"] == "[FILLER][F]" and lm["n_turns"] == 1
        assert lm["turns"][0].startswith(FILLER_TURN_PREFIX)
        seq = _of(fixture_paths, scen, "sequential")[0]
        seq_tok = sum(max(1, len(t) // 4) for t in seq["turns"])
        assert max(1, len(lm["turns"][0]) // 4) >= 0.9 * seq_tok


def test_path_ids_equal_python_json_hash(fixture_paths):
    for p in fixture_paths:
        assert len(p["perm_id"]) == 16 and all(c in "0123456789abcdef" for c in p["perm_id"])
        assert p["perm_id"] == _py_id(p["path_signature"], p["turns"])


def test_deterministic_and_order_free(spark):
    rows = CHAIN + INDEP + DIAMOND
    a = sorted((p["scenario_id"], p["path_type"], p["perm_id"]) for p in _paths(spark, rows))
    shuffled = rows[:]
    random.Random(7).shuffle(shuffled)
    b = sorted((p["scenario_id"], p["path_type"], p["perm_id"]) for p in _paths(spark, shuffled))
    assert a == b


def test_min_size_three_of_three_is_empty(spark):
    g = P.with_masks(P.gather_graphs(spark.createDataFrame(INDEP, SCHEMA)))
    assert P.closed_subsets(g, min_size=3).count() == 0


def _brute(nodes):
    ids = sorted(nodes)
    orders = [list(p) for p in itertools.permutations(ids)
              if all(all(p.index(d) < p.index(c) for d in nodes[c] if d in nodes) and
                     all(d in nodes for d in nodes[c]) for c in ids)]
    subsets = []
    for k in range(2, len(ids)):
        for combo in itertools.combinations(ids, k):
            s = set(combo)
            if all(d in s for c in combo for d in nodes[c]):
                subsets.append(",".join(sorted(combo)))
    return sorted(",".join(o) for o in orders), sorted(subsets)


def test_random_dags_against_brute_force(spark):
    rng = random.Random(11)
    rows, truth = [], {}
    for s in range(60):
        n = rng.randint(3, 5)
        ids = [f"C{i}" for i in range(1, n + 1)]
        nodes = {}
        for i, c in enumerate(ids):
            deps = [d for d in ids[:i] if rng.random() < 0.35]
            if rng.random() < 0.05:
                deps.append("C9")  # dangling: no ordering at all
            nodes[c] = deps
        sid = f"s{s}"
        truth[sid] = _brute(nodes)
        rows += [(sid, c, f"text {c}", d) for c, d in nodes.items()]
    g = P.gather_graphs(spark.createDataFrame(rows, SCHEMA))
    got_o = {}
    for r in g.select("scenario_id", F.explode(P.all_orderings(F.col("nodes"))).alias("o")).collect():
        got_o.setdefault(r.scenario_id, []).append(",".join(r.o))
    got_shape = {}
    for r in P.shape_orderings(P.with_masks(g)).select("scenario_id", P.ids_of(F.col("order")).alias("o")).collect():
        got_shape.setdefault(r.scenario_id, []).append(",".join(r.o))
    m = P.closed_subsets(P.with_masks(g))
    got_s = {}
    for r in m.select("scenario_id", "mask", "ids").collect():
        got_s.setdefault(r.scenario_id, []).append(",".join(c for i, c in enumerate(r.ids) if r.mask >> i & 1))
    for sid, (orders, subsets) in truth.items():
        assert sorted(got_o.get(sid, [])) == orders, sid
        assert sorted(got_shape.get(sid, [])) == orders, sid
        assert sorted(got_s.get(sid, [])) == subsets, sid


def test_filler_reaches_its_target_with_whole_sentences(spark):
    """The filler is a prefix of the repeated cycle, reaches the target, and one sentence fewer does not."""
    plan = FillerPlan()
    targets = [*range(0, 700), 1500, 3000, 12345]
    df = spark.createDataFrame([(t,) for t in targets], "t long")
    got = {r.t: r.f for r in df.select("t", plan.text(F.col("t")).alias("f")).collect()}
    tokens = [max(1, len(s) // 4) for s in plan.sentences]
    ends = [0]  # length of the text after each sentence of the repeated cycle, and its tokens
    total = [0]
    while total[-1] < max(targets):
        k = (len(ends) - 1) % len(tokens)
        ends.append(ends[-1] + len(plan.sentences[k]) + (1 if ends[-1] else 0))
        total.append(total[-1] + tokens[k])
    cycle = " ".join(plan.sentences * (len(ends) // len(tokens) + 1))
    for t in targets:
        n = ends.index(len(got[t]))  # a whole number of sentences
        assert cycle.startswith(got[t])
        assert total[n] >= t and (n == 0 or total[n - 1] < t)


def test_oversized_scenarios_are_not_gathered(spark):
    rows = [("big", f"C{i}", "t", []) for i in range(1, 8)] + CHAIN
    rows += [("twice", "C1", "a", []), ("twice", "C1", "b", []), ("twice", "C2", "c", ["C1"])]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(r.scenario_id for r in P.gather_graphs(df).collect()) == ["chain"]
    assert {(r.scenario_id, r.rule) for r in P.ungathered(df).collect()} == {("big", "too_many_components"), ("twice", "repeated_id")}


def test_wider_scenarios_keep_every_component(spark):
    rows = [("six", f"C{i}", f"text {i}", [f"C{i - 1}"] if i > 1 else []) for i in range(1, 7)]
    graphs = P.gather_graphs(spark.createDataFrame(rows, SCHEMA), max_components=6)
    for p in P.generate_paths(graphs, width=6, materialise=False).collect():
        if p.path_type == "sequential":
            assert p.n_turns == 6 and p.path_signature.endswith("[C1,C2,C3,C4,C5,C6][F]")
        if p.path_type == "alt_grouping":
            assert p.turns[0].count("text") == len(p.components_used)
        assert p.perm_id == _py_id(p.path_signature, p.turns)


def test_rejected_scenarios_are_not_expanded(spark):
    from pathweave.plans.generate import build_design

    rows = [("loop", "C1", "a", ["C2"]), ("loop", "C2", "b", ["C1"]), ("loop", "C3", "c", []), ("gone", "C1", "a", ["C9"]),
            ("gone", "C2", "b", []), ("gone", "C3", "c", [])] + CHAIN
    design = build_design(spark.createDataFrame(rows, SCHEMA), None, None, materialise=False)
    assert {r.scenario_id for r in design.paths.collect()} == {"chain"}


def test_path_ids_with_escapes_and_unicode(spark):
    rows = [("u", "C1", ' café "quoted" ', []), ("u", "C2", "back\\slash\nline", ["C1"]),
            ("u", "C3", "emoji 😀 ü", [])]
    for p in _paths(spark, rows):
        assert p["perm_id"] == _py_id(p["path_signature"], p["turns"]), p["path_type"]


def test_census_of_shapes_equals_the_paths(spark):
    rng = random.Random(4)
    rows = []
    for s in range(60):
        n = rng.randint(1, 5)
        for i in range(n):
            deps = [f"C{rng.randint(1, n)}" for _ in range(rng.randint(0, 2))] if rng.random() < 0.3 else [f"C{j + 1}" for j in range(i) if rng.random() < 0.4]
            rows.append((f"s{s}", f"C{i + 1}", f"text {i}", deps + (["C9"] if rng.random() < 0.05 else [])))
    graphs = P.gather_graphs(spark.createDataFrame(rows, "scenario_id string, cid string, text string, deps array<string>"))
    want = {(r.scenario_id, r.path_type): r.n_paths for r in P.path_census(P.generate_paths(graphs)).collect()}
    assert {(r.scenario_id, r.path_type): r.n_paths for r in P.census_of(graphs).collect()} == want


def test_gather_leaves_out_large_and_repeated(spark):
    rows = [("five", f"C{i}", "t", []) for i in range(5)] + [("six", f"C{i}", "t", []) for i in range(6)]
    rows += [("many", f"C{i:06d}", "t", []) for i in range(2_000)] + [("twice", "C1", "a", []), ("twice", "C1", "b", []), ("one", "C1", None, None)]
    df = spark.createDataFrame(rows, "scenario_id string, cid string, text string, deps array<string>")
    got = {r.scenario_id: len(r.nodes) for r in P.gather_graphs(df).collect()}
    assert got == {"five": 5, "one": 1}
    assert {r.scenario_id for r in P.ungathered(df).collect()} == {"six", "many", "twice"}


def test_dropped_turns_are_not_built(spark):
    """A plan that keeps the number of turns alone builds no turn."""
    paths = P.sequential_paths(P.gather_graphs(spark.createDataFrame(INDEP, SCHEMA)))
    assert "Here is" not in paths.select("scenario_id", "n_turns")._jdf.queryExecution().optimizedPlan().toString()
