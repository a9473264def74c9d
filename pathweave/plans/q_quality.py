"""Registered data-quality (DQ) queries and the corpus round trip (IO1, IO2, IO5, IO7)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import paths as P
from ..operators import quality as Q
from ..session import cut_lineage, table_path
from ..sources import corpus as C
from ..sources import views as V
from ..sources.views import (COMPONENTS_V_SQL, DESIGN_SCENARIOS_V_SQL, LABELLED_V_SQL, RAW_COMPONENTS_V_SQL,
                             RAW_SCENARIOS_V_SQL, RUNS_V_SQL, SCENARIOS_V_SQL, TURNS_V_SQL, with_ctes)
from .registry import ORACLES, register, rounded
from .q_analysis import _EFFECT_SQL as EFFECT_SQL, A4_SQL
from .generate import build_design
from .q_design import ALL_PATH_CTES, with_recursive


def _raw(spark, d, cut=False):
    """Headers, components, wordings of the unclean corpus; ``cut`` writes the headers once, for queries that read them often."""
    docs = V.raw_scenarios_v(spark, d)
    docs = cut_lineage(docs, "raw_headers") if cut else docs
    comps = V.raw_components_v(spark, d)
    n = F.col("n_wordings")
    words = docs.select("scenario_id", F.explode(F.when(n > 0, F.sequence(F.lit(1), n))
                                                 .otherwise(F.array().cast("array<int>"))).alias("k"))
    words = words.select("scenario_id", F.concat(F.lit("W"), F.col("k").cast("string")).alias("wording_id"))
    return docs, comps, words


_R = [RAW_SCENARIOS_V_SQL, RAW_COMPONENTS_V_SQL]


@register("dq1_enum_membership", with_ctes(*_R, body="""
SELECT 'DQ1_enum' AS rule, scenario_id, 'independence_class=' || coalesce(independence_class, 'NULL') AS detail
FROM raw_scenarios_v WHERE independence_class IS NULL
  OR independence_class NOT IN ('commutative', 'partial', 'entangled')"""))
def dq1_enum_membership(spark, d):
    return Q.enum_membership(_raw(spark, d)[0])


@register("dq2_setup_blank", with_ctes(*_R, body=r"""
SELECT 'DQ2_setup_blank' AS rule, scenario_id, 'setup must be non-empty' AS detail FROM raw_scenarios_v
WHERE setup IS NULL OR regexp_replace(setup, '^\s+|\s+$', '', 'g') = ''"""))
def dq2_setup_blank(spark, d):
    return Q.setup_present(_raw(spark, d)[0])


@register("dq3_no_wording", with_ctes(*_R, body="""
SELECT 'DQ3_no_wording' AS rule, scenario_id, 'at least one terminal wording required' AS detail
FROM raw_scenarios_v WHERE n_wordings <= 0"""))
def dq3_no_wording(spark, d):
    docs, _, words = _raw(spark, d)
    return Q.wordings_present(docs, words)


@register("dq4_dangling_dependency", with_ctes(*_R, """e AS (SELECT scenario_id, cid, unnest(deps) AS dep
  FROM raw_components_v)""", body="""
SELECT 'DQ4_dangling_dep' AS rule, scenario_id, cid || ' -> ' || dep AS detail FROM e
WHERE NOT EXISTS (SELECT 1 FROM raw_components_v c WHERE c.scenario_id = e.scenario_id AND c.cid = e.dep)"""))
def dq4_dangling_dependency(spark, d):
    return Q.dangling_dependencies(_raw(spark, d)[1])


@register("dq5_dependency_cycles", with_recursive(*_R, """m AS (SELECT scenario_id, cid,
  list_distinct(flatten(list(deps))) AS deps FROM raw_components_v GROUP BY 1, 2)""",
  """sz AS (SELECT scenario_id, count(*) AS n FROM m GROUP BY 1)""",
  """e0 AS (SELECT m.scenario_id, m.cid, unnest(m.deps) AS dep FROM m)""",
  """e AS (SELECT e0.* FROM e0 JOIN m ON m.scenario_id = e0.scenario_id AND m.cid = e0.dep)""",
  """walk(scenario_id, start, cur, k) AS (
  SELECT m.scenario_id, m.cid, m.cid, 0 FROM m
  UNION
  SELECT w.scenario_id, w.start, e.dep, w.k + 1 FROM walk w JOIN e ON e.scenario_id = w.scenario_id AND e.cid = w.cur
  JOIN sz ON sz.scenario_id = w.scenario_id WHERE w.k < sz.n)""", body="""
SELECT 'DQ5_cycle' AS rule, scenario_id, 'cycle through ' || string_agg(start, ',' ORDER BY start) AS detail
FROM (SELECT DISTINCT w.scenario_id, w.start FROM walk w JOIN sz USING (scenario_id) WHERE k = n) s GROUP BY scenario_id"""))
def dq5_dependency_cycles(spark, d):
    return Q.cyclic_scenarios(_raw(spark, d)[1])


@register("dq6_component_count", with_ctes(*_R, """n AS (SELECT scenario_id, count(DISTINCT cid) AS n FROM raw_components_v
  GROUP BY 1)""", body="""
SELECT 'DQ6_component_count' AS rule, s.scenario_id, 'components=' || CAST(coalesce(n.n, 0) AS VARCHAR) AS detail
FROM raw_scenarios_v s LEFT JOIN n USING (scenario_id) WHERE coalesce(n.n, 0) NOT BETWEEN 3 AND 5"""))
def dq6_component_count(spark, d):
    docs, comps, _ = _raw(spark, d)
    return Q.component_count(docs, comps)


@register("dq7_duplicate_ids", with_ctes(*_R, """f AS (SELECT doc_id, min(scenario_id) AS first_file, count(*) AS n
  FROM raw_scenarios_v GROUP BY 1)""", body="""
SELECT 'DQ7_duplicate_id' AS rule, s.scenario_id, 'duplicate id ' || s.doc_id AS detail
FROM raw_scenarios_v s JOIN f USING (doc_id) WHERE f.n > 1 AND s.scenario_id <> f.first_file"""))
def dq7_duplicate_ids(spark, d):
    return Q.duplicate_ids(_raw(spark, d)[0])


@register("dq9_11_corpus_rules", with_recursive(COMPONENTS_V_SQL, DESIGN_SCENARIOS_V_SQL, """c AS (
  SELECT count(DISTINCT scenario_id) AS n, count(DISTINCT independence_class) AS k, list(DISTINCT type) AS types
  FROM design_scenarios_v)""", """c2 AS (SELECT n, k, list_sort(list_filter(['utilitarian_tradeoff',
  'competing_obligations'], lambda t: NOT list_contains(types, t))) AS missing FROM c)""", body="""
SELECT 'DQ9_corpus_size' AS rule, CAST(NULL AS VARCHAR) AS scenario_id,
  'at least 5 scenarios; found ' || CAST(n AS VARCHAR) AS detail FROM c2 WHERE n < 5
UNION ALL SELECT 'DQ10_required_types', NULL, 'missing types: ' || array_to_string(missing, ',') FROM c2
  WHERE len(missing) > 0
UNION ALL SELECT 'DQ11_class_diversity', NULL, 'distinct classes: ' || CAST(k AS VARCHAR) FROM c2 WHERE k < 2"""))
def dq9_11_corpus_rules(spark, d):
    return Q.corpus_rules(V.design_scenarios_v(spark, d))


_LOAD_ERRORS = """
SELECT scenario_id || '.yaml' AS file,
  CASE WHEN scenario_id NOT IN (SELECT scenario_id FROM raw_components_v) THEN '''considerations'' must be a mapping'
    ELSE '''terminal_wordings'' must be a mapping' END AS error
FROM raw_scenarios_v
WHERE scenario_id NOT IN (SELECT scenario_id FROM raw_components_v) OR n_wordings <= 0"""
_DQ8_SQL = with_ctes(*_R, body=f"""
SELECT 'DQ8_malformed' AS rule, file AS scenario_id, error AS detail FROM ({_LOAD_ERRORS}) t""")


def _dq12_sql(body):
    """``body`` over ``f``, the findings of all rules.  The corpus-level rules (DQ9-DQ11) hold on this corpus."""
    rules = ["dq1_enum_membership", "dq2_setup_blank", "dq3_no_wording", "dq4_dangling_dependency",
             "dq5_dependency_cycles", "dq6_component_count", "dq7_duplicate_ids"]
    every = [*(ORACLES[n] for n in rules), _DQ8_SQL]
    return "WITH f AS (" + "\nUNION ALL\n".join(f"SELECT rule, scenario_id, detail FROM ({sql}) q{i}" for i, sql in enumerate(every)) + ")\n" + body


@register("dq12_violation_report", _dq12_sql("SELECT rule, scenario_id, detail FROM f"))
def dq12_violation_report(spark, d):
    docs, comps, words = _raw(spark, d, cut=True)
    return Q.violation_report(docs, comps, words, malformed=True)


@register("dq12_violation_counts", _dq12_sql("SELECT rule, count(*) AS n FROM f GROUP BY rule"))
def dq12_violation_counts(spark, d):
    docs, comps, words = _raw(spark, d, cut=True)
    return Q.violation_report(docs, comps, words, malformed=True).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


_REJECTS = """r AS (SELECT replace(scenario_id, '.yaml', '') AS scenario_id, string_agg(DISTINCT rule, ',' ORDER BY rule) AS rules,
  count(*) AS n_findings FROM f GROUP BY 1)"""


@register("p13_gated_census", _dq12_sql("").rstrip() + ",\n" + _REJECTS + ",\n" + ",\n".join(_R) + """,
again AS (SELECT DISTINCT scenario_id FROM (SELECT scenario_id, cid FROM raw_components_v GROUP BY 1, 2 HAVING count(*) > 1) t)
SELECT s.scenario_id, CASE WHEN rules IS NULL AND again.scenario_id IS NOT NULL THEN 'repeated_id' ELSE rules END AS rules,
  CASE WHEN rules IS NULL AND again.scenario_id IS NOT NULL THEN 1 ELSE n_findings END AS n_findings,
  CASE WHEN rules IS NULL AND again.scenario_id IS NULL THEN 1 ELSE 0 END AS n_direct, rules IS NULL AND again.scenario_id IS NULL AS has_paths
FROM raw_scenarios_v s LEFT JOIN r USING (scenario_id) LEFT JOIN again USING (scenario_id)""")
def p13_gated_census(spark, d):
    """The gate on the unclean corpus: a document that breaks any rule has its rules and no path, any other one has paths."""
    docs, comps, words = _raw(spark, d, cut=True)
    design = build_design(comps, words, docs, materialise=False, id_col="doc_id", carry=False)
    paths = design.paths.groupBy("scenario_id").agg(F.count(F.when(F.col("path_type") == "direct", 1)).alias("n_direct"),
                                                    F.count(F.lit(1)).alias("_n"))
    every = docs.select("scenario_id").join(design.rejects, "scenario_id", "left").join(paths, "scenario_id", "left")
    return every.select("scenario_id", "rules", "n_findings", F.coalesce("n_direct", F.lit(0)).alias("n_direct"),
                        F.col("_n").isNotNull().alias("has_paths"))


@register("dq13_duplicate_keys", with_ctes(*_R, RUNS_V_SQL, TURNS_V_SQL, body="""
SELECT 'components' AS "table", scenario_id || '|' || cid AS key, count(*) AS n FROM raw_components_v
GROUP BY scenario_id, cid HAVING count(*) > 1
UNION ALL SELECT 'scenarios', doc_id, count(*) FROM raw_scenarios_v GROUP BY doc_id HAVING count(*) > 1
UNION ALL SELECT 'runs', CAST(run_id AS VARCHAR), count(*) FROM runs_v GROUP BY run_id HAVING count(*) > 1
UNION ALL SELECT 'turns', run_id || '|' || turn_index, count(*) FROM turns_v GROUP BY run_id, turn_index HAVING count(*) > 1"""))
def dq13_duplicate_keys(spark, d):
    docs, comps, _ = _raw(spark, d)
    return (Q.duplicate_keys(comps, ["scenario_id", "cid"], "components").unionByName(Q.duplicate_keys(docs, ["doc_id"], "scenarios"))
            .unionByName(Q.duplicate_keys(V.runs_v(spark, d), ["run_id"], "runs"))
            .unionByName(Q.duplicate_keys(V.turns_v(spark, d), ["run_id", "turn_index"], "turns")))


@register("dq14_orphans", with_ctes(*_R, RUNS_V_SQL, SCENARIOS_V_SQL, TURNS_V_SQL, body="""
SELECT 'components' AS "table", scenario_id AS key FROM raw_components_v
WHERE scenario_id NOT IN (SELECT scenario_id FROM raw_scenarios_v)
UNION ALL SELECT 'runs', scenario_id FROM runs_v WHERE scenario_id NOT IN (SELECT scenario_id FROM scenarios_v)
UNION ALL SELECT 'turns', CAST(run_id AS VARCHAR) FROM turns_v WHERE run_id NOT IN (SELECT run_id FROM runs_v)"""))
def dq14_orphans(spark, d):
    docs, comps, _ = _raw(spark, d)
    runs = V.runs_v(spark, d)
    return (Q.orphans(comps, docs, "scenario_id", table="components")
            .unionByName(Q.orphans(runs, V.scenarios_v(spark, d), "scenario_id", table="runs"))
            .unionByName(Q.orphans(V.turns_v(spark, d), runs, "run_id", table="turns")))


_REQUIRED = ["run_id", "scenario_id", "path_type", "terminal_wording_id", "provider_requested", "status", "verdict",
             "provider_used"]


@register("dq15_null_counts", with_ctes(RUNS_V_SQL, body="\nUNION ALL\n".join(
    f"SELECT 'runs' AS \"table\", '{c}' AS \"column\", CAST(count(*) - count({c}) AS BIGINT) AS n_null FROM runs_v"
    for c in _REQUIRED)))
def dq15_null_counts(spark, d):
    return Q.null_counts(V.runs_v(spark, d), _REQUIRED, "runs")


@register("dq16_degenerate_conditions", with_ctes(LABELLED_V_SQL, body="""
SELECT stratum, arm, count(outcome) AS n, round(avg(outcome), 6) AS p_yes,
  CASE WHEN avg(outcome) = 1 THEN 'all_yes' ELSE 'all_no' END AS kind
FROM labelled_v WHERE outcome IS NOT NULL GROUP BY 1, 2 HAVING avg(outcome) IN (0, 1)"""))
def dq16_degenerate_conditions(spark, d):
    return rounded(Q.degenerate_conditions(V.labelled_v(spark, d), ["stratum", "arm"], "outcome"))


@register("dq17_provider_pinning", with_ctes(RUNS_V_SQL, """g AS (SELECT provider_requested, provider_used,
  count(*) AS n FROM runs_v GROUP BY 1, 2)""", """t AS (SELECT provider_requested, count(*) AS t FROM runs_v GROUP BY 1)""",
  body="""
SELECT g.provider_requested, g.provider_used, g.n, g.provider_requested IS NOT DISTINCT FROM g.provider_used AS matches,
  g.provider_used IS NOT NULL AS used_known, round(g.n / t.t, 6) AS share FROM g JOIN t USING (provider_requested)"""))
def dq17_provider_pinning(spark, d):
    return rounded(Q.provider_pinning(V.runs_v(spark, d)))


@register("dq18_path_sample", with_recursive(*ALL_PATH_CTES, r"""r AS (SELECT scenario_id, path_type, path_signature,
  turns, row_number() OVER (PARTITION BY scenario_id, path_type ORDER BY path_signature) AS rank FROM allp)""", body=r"""
SELECT scenario_id, path_type, rank, path_signature, CAST(u.i AS INTEGER) AS turn_no,
  regexp_replace(left(turns[u.i], 80), '^\s+|\s+$', '', 'g') AS turn_head
FROM r, LATERAL (SELECT unnest(range(1, len(turns) + 1)) AS i) u WHERE rank <= 3
UNION ALL
SELECT scenario_id, path_type, rank, path_signature, NULL, NULL FROM r WHERE rank <= 3 AND len(turns) = 0"""))
def dq18_path_sample(spark, d):
    paths = P.generate_paths(P.gather_graphs(V.components_v(spark, d), keys=V.COMPONENT_KEYS))
    return Q.path_sample(paths).withColumn("rank", F.col("rank").cast("long"))


# --- corpus round trip -------------------------------------------------------------------------------

def _docs(spark, d):
    comps = V.components_v(spark, d)
    return C.nest_documents(V.design_scenarios_v(spark, d, comps), comps, V.wordings_v(spark, d, comps))


@register("io1_yaml_round_trip", with_ctes(COMPONENTS_V_SQL, body="""
SELECT scenario_id || '.yaml' AS file, scenario_id, CAST(rn AS INTEGER) AS pos, cid, text,
  array_to_string(deps, ',') AS deps FROM components_v"""))
def io1_yaml_round_trip(spark, d):
    parsed = C.parse_documents(C.render_yaml(_docs(spark, d)))
    flat = C.flatten_components(C.valid_documents(parsed))
    files = parsed.select("file", F.col("id").alias("scenario_id"))
    return flat.join(files, "scenario_id").select("file", "scenario_id", "pos", "cid", "text",
                                                  F.array_join("deps", ",").alias("deps"))


def _parsed_raw(spark, d):
    docs, comps, words = _raw(spark, d)
    headers = docs.select("scenario_id", "type", "independence_class", "setup")
    return C.parse_documents(C.render_yaml(C.nest_documents(headers, comps, words.withColumn("wording", F.col("wording_id")))))


@register("io2_load_errors", with_ctes(*_R, body=_LOAD_ERRORS))
def io2_load_errors(spark, d):
    return C.load_errors(_parsed_raw(spark, d))


@register("dq8_malformed_documents", _DQ8_SQL)
def dq8_malformed_documents(spark, d):
    return Q.malformed_documents(_parsed_raw(spark, d))


@register("io5_runs_table", with_ctes(RUNS_V_SQL, body="""
SELECT CAST(run_id AS VARCHAR) AS run_id, scenario_id, path_type, CAST(NULL AS VARCHAR) AS path_signature,
  CAST(NULL AS VARCHAR) AS perm_id, terminal_wording_id, CAST(NULL AS VARCHAR) AS model,
  CAST(NULL AS VARCHAR) AS model_version, provider_requested, provider_used, CAST(NULL AS DOUBLE) AS temperature,
  CAST(NULL AS INTEGER) AS seed, CAST(NULL AS INTEGER) AS replicate_idx, CAST(verdict AS INTEGER) AS verdict,
  coalesce(status, 'pending') AS status, CAST(NULL AS INTEGER) AS n_turns, CAST(total_tokens AS INTEGER) AS total_tokens,
  CAST(NULL AS INTEGER) AS latency_ms, CAST(NULL AS TIMESTAMP) AS "timestamp" FROM runs_v"""))
def io5_runs_table(spark, d):
    return C.conform(V.runs_v(spark, d).withColumn("run_id", F.col("run_id").cast("string")), C.RUNS_SCHEMA)


@register("io7_export_csv")
def io7_export_csv(spark, d):
    from ..operators import aggregates as G
    from ..operators import frames as A
    frame = A.completed_frame(V.runs_v(spark, d), V.scenarios_v(spark, d))
    path = table_path(spark, f"exports/{uuid.uuid4().hex}")
    C.export_csv(G.condition_summary(frame), path)
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


@register("io7_export_effects", with_ctes(RUNS_V_SQL, SCENARIOS_V_SQL, A4_SQL, EFFECT_SQL, body="""
SELECT scenario_id, independence_class, round(effect, 4) AS effect FROM eff"""))
def io7_export_effects(spark, d):
    """Effects by scenario, written as CSV with four digits and read back."""
    from .q_analysis import _effects
    path = C.export_csv(_effects(spark, d), table_path(spark, f"exports/{uuid.uuid4().hex}"))
    return spark.read.option("header", True).schema("scenario_id string, effect double, independence_class string").csv(path)
