"""Data-quality rules on negative fixtures, including the YAML loader."""
import os
import random
from collections import Counter

from pyspark.sql import functions as F

from pathweave.operators import quality as Q
from pathweave.sources import corpus as C

SCHEMA = "scenario_id string, cid string, text string, deps array<string>"


def _comps(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_dangling_and_cycles(spark):
    rows = [("dang", "C1", "a", []), ("dang", "C2", "b", ["C9"]), ("dang", "C3", "c", ["C1"]),
            ("self", "C1", "a", ["C1"]), ("self", "C2", "b", []), ("self", "C3", "c", []),
            ("two", "C1", "a", ["C2"]), ("two", "C2", "b", ["C1"]), ("two", "C3", "c", []),
            ("behind", "C1", "a", ["C2"]), ("behind", "C2", "b", ["C1"]), ("behind", "C3", "c", ["C2"]),
            ("ok", "C1", "a", []), ("ok", "C2", "b", ["C1"]), ("ok", "C3", "c", ["C1", "C2"])]
    c = _comps(spark, rows)
    dang = {(r.scenario_id, r.detail) for r in Q.dangling_dependencies(c).collect()}
    assert dang == {("dang", "C2 -> C9")}
    cyc = {r.scenario_id: r.detail for r in Q.cyclic_scenarios(c).collect()}
    assert cyc == {"self": "cycle through C1", "two": "cycle through C1,C2", "behind": "cycle through C1,C2,C3"}


def test_counts_enum_setup_wordings_duplicates(spark):
    docs = spark.createDataFrame(
        [("s1", "d1", "utilitarian_tradeoff", "partial", "setup"), ("s2", "d2", "x", "unknown", "  \n"),
         ("s3", "d1", "competing_obligations", None, None), ("s4", "d4", "x", "entangled", "ok")],
        "scenario_id string, doc_id string, type string, independence_class string, setup string")
    comps = _comps(spark, [("s1", "C1", "a", []), ("s1", "C2", "b", []), ("s1", "C3", "c", []),
                           ("s2", "C1", "a", []), ("s2", "C2", "b", []),
                           ("s4", "C1", "a", []), ("s4", "C2", "b", []), ("s4", "C3", "c", []),
                           ("s4", "C4", "a", []), ("s4", "C5", "b", []), ("s4", "C6", "c", [])])
    words = spark.createDataFrame([("s1", "W1"), ("s2", "W1")], "scenario_id string, wording_id string")
    rep = {(r.rule, r.scenario_id) for r in Q.violation_report(docs, comps, words).collect()}
    assert ("DQ1_enum", "s2") in rep and ("DQ1_enum", "s3") in rep and ("DQ1_enum", "s1") not in rep
    assert ("DQ2_setup_blank", "s2") in rep and ("DQ2_setup_blank", "s3") in rep
    assert ("DQ3_no_wording", "s3") in rep and ("DQ3_no_wording", "s4") in rep
    assert ("DQ6_component_count", "s2") in rep and ("DQ6_component_count", "s3") in rep
    assert ("DQ6_component_count", "s4") in rep and ("DQ6_component_count", "s1") not in rep
    assert ("DQ7_duplicate_id", "s3") in rep and ("DQ7_duplicate_id", "s1") not in rep
    assert ("DQ9_corpus_size", None) in rep  # 4 < 5 scenarios
    assert ("DQ10_required_types", None) not in rep and ("DQ11_class_diversity", None) not in rep


DOCS = {
    "a.yaml": """id: a
type: utilitarian_tradeoff
independence_class: partial
setup: >
  A setup text.
considerations:
  C1:
    text: "First."
    depends_on: []
  C2:
    text: Second.
    depends_on: [C1]
  C3:
    text: "Third, with \\u00e9."
terminal_wordings:
  W1: "Is it fine? Answer yes or no."
  W2: "Should it go ahead?"
""",
    "empty.yaml": "",
    "list.yaml": "id: b\ntype: t\nindependence_class: partial\nsetup: s\nconsiderations: [C1, C2]\n"
                 "terminal_wordings:\n  W1: q\n",
    "broken.yaml": "id: [unclosed\n",
    "notes.txt": "ignored",
}


def test_yaml_loader_keeps_going_and_flattens(spark, scratch):
    for name, text in DOCS.items():
        with open(os.path.join(scratch, name), "w", encoding="utf-8") as fh:
            fh.write(text)
    parsed = C.load_corpus(spark, scratch).cache()
    errors = {os.path.basename(r.file): r.error for r in C.load_errors(parsed).collect()}
    assert set(errors) == {"empty.yaml", "list.yaml", "broken.yaml"}
    assert errors["empty.yaml"] == "empty document"
    assert errors["list.yaml"] == "'considerations' must be a mapping"
    docs = C.valid_documents(parsed)
    comps = {r.cid: (r.pos, r.text, r.deps) for r in C.flatten_components(docs).collect()}
    assert comps == {"C1": (1, "First.", []), "C2": (2, "Second.", ["C1"]), "C3": (3, "Third, with é.", [])}
    words = [(r.wording_id, r.pos) for r in C.flatten_wordings(docs).orderBy("pos").collect()]
    assert words == [("W1", 1), ("W2", 2)]
    (row,) = C.scenarios_table(docs).collect()
    assert row.n_components == 3 and row.setup_text == "A setup text."
    # the writer produces text the loader reads back unchanged
    again = C.valid_documents(C.parse_documents(C.render_yaml(docs)))
    assert sorted(map(tuple, C.flatten_components(again).collect())) == sorted(
        map(tuple, C.flatten_components(docs).collect()))


def test_cycles_of_any_size(spark):
    from pathweave.operators import quality as Q

    rows = [("six", f"C{i}", [f"C{i % 6 + 1}"]) for i in range(1, 7)]
    rows += [("forty", f"C{i:02d}", [f"C{i % 40 + 1:02d}"]) for i in range(1, 41)]
    rows += [("chain", f"C{i:02d}", [f"C{i - 1:02d}"] if i > 1 else []) for i in range(1, 41)]
    df = spark.createDataFrame(rows, "scenario_id string, cid string, deps array<string>")
    got = {r.scenario_id: r.detail for r in Q.cyclic_scenarios(df).collect()}
    assert got == {"six": "cycle through C1,C2,C3,C4,C5,C6", "forty": "cycle through " + ",".join(f"C{i:02d}" for i in range(1, 41))}


def _stuck_by_peeling(deps):
    left = {v: {d for d in ds if d in deps} for v, ds in deps.items()}
    while True:
        placed = [v for v, ds in left.items() if not ds & left.keys()]
        if not placed:
            return sorted(left)
        for v in placed:
            del left[v]


def test_cycles_of_large_random_graphs(spark):
    rng = random.Random(12)
    graphs = {}
    for g in range(12):
        n = rng.randint(2, 90)
        deps = {f"N{i:03d}": [f"N{rng.randrange(i):03d}" for _ in range(rng.randint(0, 3)) if i] for i in range(n)}
        for _ in range(2 * (g % 3)):
            i, j = sorted((rng.randrange(n), rng.randrange(n)))
            deps[f"N{i:03d}"].append(f"N{j:03d}")  # against the order: often a cycle
        deps["N000"].append("undefined")
        graphs[f"g{g}"] = deps
    df = spark.createDataFrame([(g, v, ds) for g, deps in graphs.items() for v, ds in deps.items()], "scenario_id string, cid string, deps array<string>")
    want = {g: "cycle through " + ",".join(s) for g, deps in graphs.items() if (s := _stuck_by_peeling(deps))}
    assert len(want) >= 3
    for gather in (1, 32):  # as tables, and in the row where graphs are small
        assert {r.scenario_id: r.detail for r in Q.cyclic_scenarios(df, gather=gather).collect()} == want


def test_a_long_chain_takes_few_jobs(spark):
    n = 5_000
    rows = [("chain", f"C{i:05d}", [f"C{i + 1:05d}"] if i < n - 1 else [f"C{n - 2:05d}"]) for i in range(n)]  # a cycle at its end
    rows += [("clean", f"C{i:05d}", [f"C{i + 1:05d}"] if i < n - 1 else []) for i in range(n)]
    df = spark.createDataFrame(rows, "scenario_id string, cid string, deps array<string>").repartition(8)
    context = spark.sparkContext
    context.setJobGroup("chain", "chain")
    got = {r.scenario_id: r.detail for r in Q.cyclic_scenarios(df).collect()}
    jobs = len(context.statusTracker().getJobIdsForGroup("chain"))
    context.setLocalProperty("spark.jobGroup.id", None)
    assert got == {"chain": "cycle through " + ",".join(f"C{i:05d}" for i in range(n))}
    assert 0 < jobs < 40, jobs


def test_findings_in_the_row_equal_the_rules(spark):
    """Small, large, orphaned and repeated documents: one pass finds what each rule finds on its own."""
    rng = random.Random(21)
    rows, heads, words = [], [], []
    for s in range(80):
        n = rng.choice([0, 1, 2, 3, 4, 5, 6, 40])
        for i in range(n):
            deps = [f"C{rng.randint(1, max(n, 1) + 1)}" for _ in range(rng.randint(0, 2))]
            rows.append((f"s{s}", f"C{rng.randint(1, n) if rng.random() < 0.1 else i + 1}", "t", deps if rng.random() < 0.9 else None))
        if s % 9:
            heads.append((f"s{s}", f"d{s % 60}", "x", rng.choice(["partial", "entangled", "odd", None]), rng.choice(["setup", " ", None, "ok"])))
        words += [(f"s{s}", f"W{k}") for k in range(rng.randint(0, 2))]
    comps = _comps(spark, rows)
    docs = spark.createDataFrame(heads, "scenario_id string, doc_id string, type string, independence_class string, setup string")
    texts = spark.createDataFrame(words, "scenario_id string, wording_id string")
    parts = [Q.enum_membership(docs), Q.setup_present(docs), Q.wordings_present(docs, texts), Q.dangling_dependencies(comps),
             Q.cyclic_scenarios(comps), Q.component_count(docs, comps), Q.duplicate_ids(docs)]
    want = sorted((tuple(r) for p in parts for r in p.collect()), key=repr)
    for gather in (4, 32):
        got = sorted(map(tuple, Q.document_findings(docs, comps, texts, gather=gather, malformed=False).collect()), key=repr)
        assert got == want
    own = {r.scenario_id: r.rules for r in Q.rejected_documents(Q.document_findings(docs, comps, texts)).collect()}
    assert set(own) == {s for _, s, _ in want} | {h[0] for h in heads if h[0] not in {r[0] for r in rows} or h[0] not in {w[0] for w in words}}


def test_orphans_are_found_in_tasks_of_bounded_rows(spark, monkeypatch):
    monkeypatch.setattr(Q, "TASK_ROWS", 1 << 10, raising=False)
    parent = spark.range(10_000).select((F.col("id") * 2).alias("run_id"))
    child = spark.range(12_000).select(F.when(F.col("id") % 4 == 0, F.lit(7).cast("long")).when(F.col("id") % 1000 == 1, None)
                                       .otherwise(F.col("id")).alias("run_id"))  # 7 is a hot key without parent
    found = Q.orphans(child, parent.union(parent.limit(3)), "run_id", table="t")
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()
    want = Counter("7" if i % 4 == 0 else None if i % 1000 == 1 else str(i) for i in range(12_000))
    assert Counter(r["key"] for r in found.collect()) == Counter({k: n for k, n in want.items() if k is None or int(k) % 2})
    ints = child.select(F.col("run_id").cast("int").alias("run_id"))
    assert Counter(r["key"] for r in Q.orphans(ints, parent, "run_id").collect()) == Counter(r["key"] for r in found.collect())
    few = Q.orphans(child, parent.limit(5), "run_id", table="t")
    assert few.count() == child.join(parent.limit(5), "run_id", "left_anti").count()


def test_repeated_keys_are_counted_in_tasks_of_bounded_rows(spark, monkeypatch):
    monkeypatch.setattr(Q, "TASK_ROWS", 1 << 10, raising=False)
    rows = spark.range(9_000).select(F.when(F.col("id") % 4 == 0, 5).when(F.col("id") % 1000 == 1, None).otherwise(F.col("id") % 8_000).alias("a"),
                                     F.lit("x").alias("b"))  # 5 is a hot key
    found = Q.duplicate_keys(rows, ["a", "b"], "t")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "partial_count" in plan
    want = Counter("5|x" if i % 4 == 0 else "x" if i % 1000 == 1 else f"{i % 8_000}|x" for i in range(9_000))
    assert {(r["key"], r["n"]) for r in found.collect()} == {(k, n) for k, n in want.items() if n > 1}
