"""Registered transcript (T) and ledger (L) queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.identity import sql_json_quote
from ..functions.text import sql_str
from ..operators import ledger as L
from ..operators import manifest as M
from ..operators import transcripts as T
from ..sources import corpus as C
from ..sources import views as V
from ..sources.views import RESPONSES_V_SQL, RUNS_V_SQL, STATUS_LOG_V_SQL, TURNS_V_SQL, with_ctes
from .generate import manifest_for
from .registry import register, rounded
from .q_design import (COMPONENTS_V_SQL, DESIGN_SCENARIOS_V_SQL, MODEL, PROVIDER, TEMPERATURE, _id_sum, _manifest_sql,
                       with_recursive)

RUN_OF_INTEREST = 3
_VERDICT_SQL = r"""CASE WHEN lower(regexp_replace(content, '^\s+|\s+$', '', 'g')) LIKE 'yes%' THEN 1
  WHEN lower(regexp_replace(content, '^\s+|\s+$', '', 'g')) LIKE 'no%' THEN 0 END"""
_STRICT_SQL = r"""CASE regexp_replace(regexp_extract(lower(regexp_replace(content, '^\s+|\s+$', '', 'g')), '^(\S+)', 1),
  '[.,;:]+$', '') WHEN 'yes' THEN 1 WHEN 'no' THEN 0 END"""


# --- T1: prompts from the resolved design ------------------------------------------------

def _resolved(spark, d):
    from .q_design import _design
    comps, design = _design(spark, d, materialise=True)
    scen = V.design_scenarios_v(spark, d, comps)
    setups = scen.select("scenario_id", "setup").hint("merge")
    return M.resolve_design(design.paths.join(setups, "scenario_id"), design.uncarried, scen, design.paths, design.wordings,
                            1, MODEL, PROVIDER, TEMPERATURE, keep=["setup"])


_T1_CTES = [DESIGN_SCENARIOS_V_SQL, f"""msg AS (
  SELECT 'system' AS role, false AS is_terminal,
    regexp_replace(ds.setup, '^\\s+|\\s+$', '', 'g') || {sql_str(T.SYSTEM_INSTRUCTION)} AS content
  FROM man JOIN design_scenarios_v ds USING (scenario_id)
  UNION ALL
  SELECT 'user', false, unnest(a.turns) FROM man JOIN allp a USING (scenario_id, path_type, path_signature)
  UNION ALL
  SELECT 'user', true, w.wording
  FROM man JOIN wordings_v w ON man.scenario_id = w.scenario_id AND man.terminal_wording_id = w.wording_id)"""]


@register("t1_prompt_messages", _manifest_sql(1, extra_ctes=_T1_CTES, body="""
SELECT role, is_terminal, count(*) AS n, CAST(sum(length(content)) AS BIGINT) AS chars,
  CAST(sum(CAST('0x' || left(sha256(content), 7) AS BIGINT)) AS BIGINT) AS content_sum FROM msg GROUP BY 1, 2"""))
def t1_prompt_messages(spark, d):
    """Per role, with a digest that changes with any message's text."""
    digest = F.conv(F.substring(F.sha2("content", 256), 1, 7), 16, 10).cast("long")
    msgs = T.prompt_messages(_resolved(spark, d))
    return msgs.groupBy("role", "is_terminal").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("content")).cast("long").alias("chars"),
                                                   F.sum(digest).alias("content_sum"))


# --- T2-T4 over the conversations table ------------------------------------------------------

def _conv_parts(spark, d):
    t = V.turns_v(spark, d)
    w = Window.partitionBy("run_id", "role").orderBy("turn_index")
    t = t.withColumn("step", (F.row_number().over(w) - 1).cast("int"))
    system = t.filter(F.col("role") == "system").select("run_id", "content")
    users = t.filter(F.col("role") == "user").select("run_id", "step", "content")
    replies = t.filter(F.col("role") == "assistant").select("run_id", "step", "content")
    return system, users, replies


_PARTS_SQL = [TURNS_V_SQL, """tt AS (SELECT *, CAST(row_number() OVER (PARTITION BY run_id, role ORDER BY turn_index) - 1
  AS INTEGER) AS step FROM turns_v)""", """lst AS (SELECT run_id, max(step) AS l FROM tt WHERE role = 'user' GROUP BY 1)"""]


@register("t2_interleave_turns", with_ctes(*_PARTS_SQL, body="""
SELECT CAST(run_id AS VARCHAR) || '_t' || CAST(ti AS VARCHAR) AS turn_id, run_id, CAST(ti AS INTEGER) AS turn_index,
  role, content, CAST(term AS INTEGER) AS is_terminal
FROM (SELECT run_id, 0 AS ti, role, content, 0 AS term FROM tt WHERE role = 'system'
      UNION ALL
      SELECT tt.run_id, 2 * step + CASE WHEN role = 'user' THEN 1 ELSE 2 END, role, content,
        CASE WHEN step = lst.l THEN 1 ELSE 0 END
      FROM tt JOIN lst USING (run_id) WHERE role IN ('user', 'assistant')) u"""))
def t2_interleave_turns(spark, d):
    return T.interleave(*_conv_parts(spark, d))


_JS = "'{\"content\": ' || " + sql_json_quote("content") + " || ', \"role\": ' || " + sql_json_quote("role") + " || '}'"


@register("t3_message_history", with_ctes(TURNS_V_SQL, body=f"""
SELECT run_id, turn_index, count(*) OVER w AS n_messages, CAST(sum(length(content)) OVER w AS BIGINT) AS history_chars,
  sha256('[' || array_to_string(list({_JS}) OVER w, ', ') || ']') AS history_digest FROM turns_v
WINDOW w AS (PARTITION BY run_id ORDER BY turn_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""))
def t3_message_history(spark, d):
    return T.message_history(V.turns_v(spark, d))


def _keys_sql(seed_expr: str) -> list[str]:
    return [TURNS_V_SQL, f"""km AS (SELECT run_id, turn_index, role, content, {_JS} AS js,
  list({_JS}) OVER (PARTITION BY run_id ORDER BY turn_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hist
  FROM turns_v)""", f"""req AS (SELECT run_id, turn_index, CAST(floor((turn_index - 1) / 2) AS INTEGER) AS step,
  CAST({seed_expr} + floor((turn_index - 1) / 2) AS BIGINT) AS step_seed, hist FROM km WHERE role = 'assistant')""",
            f"""keys AS (SELECT run_id, turn_index, step, step_seed,
  sha256('{{"messages": [' || coalesce(array_to_string(hist, ', '), '') || '], "model": "{MODEL}", "provider": "{PROVIDER}", "seed": '
    || CAST(step_seed AS VARCHAR) || ', "temperature": {TEMPERATURE}}}') AS cache_key FROM req)"""]


def _requests(spark, d, seed_col):
    t = V.turns_v(spark, d).withColumn("seed", seed_col)
    return T.request_keys(t, MODEL, PROVIDER, TEMPERATURE)


@register("t4_cache_keys", with_ctes(*_keys_sql("run_id"), body="SELECT * FROM keys"))
def t4_cache_keys(spark, d):
    return _requests(spark, d, F.col("run_id"))


def _store(spark, d):
    keys = _requests(spark, d, F.col("run_id"))
    rep = V.responses_v(spark, d)
    return keys.join(rep, ["run_id", "turn_index"]).select("cache_key", "content", "latency_ms", "total_tokens",
                                                           "provider_used", "model_version")


def _second_pass(spark, d):
    return _requests(spark, d, F.col("run_id") + F.col("run_id") % 2)


_STORE_SQL = _keys_sql("run_id")
_SECOND_SQL = [c.replace("km AS", "km2 AS").replace("FROM km ", "FROM km2 ").replace("req AS", "req2 AS")
               .replace("FROM req)", "FROM req2)").replace("keys AS", "keys2 AS")
               for c in _keys_sql("(run_id + run_id % 2)")[1:]]
_STORE_CTE = f"""store AS (SELECT k.cache_key, r.content FROM keys k JOIN ({RESPONSES_V_SQL.split(' AS (', 1)[1][:-1]}) r
  USING (run_id, turn_index))"""


@register("t5_cache_hits", with_ctes(*_STORE_SQL, *_SECOND_SQL, _STORE_CTE, body="""
SELECT k.run_id, k.turn_index, k.cache_key, s.content FROM keys2 k JOIN store s USING (cache_key)"""))
def t5_cache_hits(spark, d):
    hits, _ = T.cache_lookup(_second_pass(spark, d), _store(spark, d))
    return hits.select("run_id", "turn_index", "cache_key", "content")


@register("t5_cache_misses", with_ctes(*_STORE_SQL, *_SECOND_SQL, _STORE_CTE, body="""
SELECT count(*) AS n_missing_keys, count(DISTINCT run_id) AS n_runs FROM keys2
WHERE cache_key NOT IN (SELECT cache_key FROM store)"""))
def t5_cache_misses(spark, d):
    _, misses = T.cache_lookup(_second_pass(spark, d), _store(spark, d))
    return misses.agg(F.count(F.lit(1)).alias("n_missing_keys"), F.countDistinct("run_id").alias("n_runs"))


@register("t6_store_responses", with_ctes(*_STORE_SQL, *_SECOND_SQL, _STORE_CTE, body="""
SELECT count(*) AS n_rows, count(DISTINCT cache_key) AS n_keys FROM (
  SELECT cache_key FROM store UNION ALL
  SELECT DISTINCT cache_key FROM keys2 WHERE cache_key NOT IN (SELECT cache_key FROM store)) u"""))
def t6_store_responses(spark, d):
    store = _store(spark, d)
    _, misses = T.cache_lookup(_second_pass(spark, d), store)
    new = misses.join(V.responses_v(spark, d), ["run_id", "turn_index"]).select(*store.columns)
    out = T.store_responses(store, new)
    return out.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("cache_key").alias("n_keys"))


# --- T8-T14 over recorded replies ---------------------------------------------------------------

@register("t8_verdicts", with_ctes(RESPONSES_V_SQL, body=f"""
SELECT run_id, turn_index, {_VERDICT_SQL} AS verdict FROM responses_v"""))
def t8_verdicts(spark, d):
    return T.with_verdict(V.responses_v(spark, d)).select("run_id", "turn_index", "verdict")


@register("t8_verdicts_strict", with_ctes(RESPONSES_V_SQL, body=f"""
SELECT run_id, turn_index, {_STRICT_SQL} AS verdict FROM responses_v"""))
def t8_verdicts_strict(spark, d):
    return T.with_verdict(V.responses_v(spark, d), strict=True).select("run_id", "turn_index", "verdict")


@register("t9_unparseable", with_ctes(RESPONSES_V_SQL, body=f"""
SELECT run_id, turn_index, left(content, 120) AS content_head FROM responses_v WHERE ({_VERDICT_SQL}) IS NULL"""))
def t9_unparseable(spark, d):
    return T.unparseable(V.responses_v(spark, d))


_OUTCOME_SQL = with_ctes(RESPONSES_V_SQL, """g AS (SELECT run_id, max_by(content, turn_index) AS content,
  CAST(sum(total_tokens) AS BIGINT) AS total_tokens, CAST(sum(latency_ms) AS BIGINT) AS latency_ms,
  max_by(provider_used, turn_index) AS provider_used, max_by(model_version, turn_index) AS model_version,
  count(*) AS n_calls FROM responses_v GROUP BY 1)""", body=f"""
SELECT run_id, total_tokens, latency_ms, provider_used, model_version, n_calls, {_VERDICT_SQL} AS verdict,
  CASE WHEN ({_VERDICT_SQL}) IS NULL THEN 'refused' ELSE 'complete' END AS status FROM g""")


@register("t10_run_outcomes", _OUTCOME_SQL)
def t10_run_outcomes(spark, d):
    return T.run_outcomes(V.responses_v(spark, d))


@register("t13_call_metrics", with_ctes(RESPONSES_V_SQL, body="""
SELECT provider_used, model_version, count(*) AS n_calls, round(avg(total_tokens), 6) AS mean_tokens,
  round(avg(latency_ms), 6) AS mean_latency_ms, quantile_disc(latency_ms, 0.5) AS median_latency_ms
FROM responses_v GROUP BY 1, 2"""))
def t13_call_metrics(spark, d):
    return rounded(T.call_metrics(V.responses_v(spark, d)))


@register("t14_turns_of_run", with_ctes(TURNS_V_SQL, body=f"""
SELECT run_id, turn_index, role, content FROM turns_v WHERE run_id = {RUN_OF_INTEREST}"""))
def t14_turns_of_run(spark, d):
    return T.turns_of_run(V.turns_v(spark, d), RUN_OF_INTEREST)


# --- L: ledger ----------------------------------------------------------------------------------------

def _scenario_rows(spark, d):
    comps = V.components_v(spark, d)
    docs = C.nest_documents(V.design_scenarios_v(spark, d, comps), comps, V.wordings_v(spark, d, comps))
    return C.scenarios_table(docs), V.read(spark, d, "orders")


_L1_SQL = with_recursive(COMPONENTS_V_SQL, DESIGN_SCENARIOS_V_SQL, r"""st AS (SELECT scenario_id, type,
  independence_class, n_components, regexp_replace(setup, '^\s+|\s+$', '', 'g') AS setup_text FROM design_scenarios_v)""",
  body="""
SELECT st.scenario_id, st.type, st.independence_class, st.n_components,
  CASE WHEN o.o_orderstatus = 'F' THEN st.setup_text || ' (revised)' ELSE st.setup_text END AS setup_text
FROM st JOIN orders o ON split_part(st.scenario_id, '-', 1) = CAST(o.o_orderkey AS VARCHAR)""")


@register("l1_upsert_scenarios", _L1_SQL)
def l1_upsert_scenarios(spark, d):
    st, orders = _scenario_rows(spark, d)
    st = st.drop("raw_yaml")
    final = orders.filter(F.col("o_orderstatus") == "F").select(F.col("o_orderkey").cast("string").alias("order_id"))
    incoming = st.join(final, F.substring_index("scenario_id", "-", 1) == F.col("order_id"), "left_semi").withColumn(
        "setup_text", F.concat(F.col("setup_text"), F.lit(" (revised)")))
    return L.upsert(st, incoming)


@register("l2_insert_or_ignore_manifest", _manifest_sql(2, body="""
SELECT path_type, count(*) AS n_new, CAST(sum(CAST('0x' || left(run_id, 7) AS BIGINT)) AS BIGINT) AS id_sum FROM man
WHERE replicate_idx = 1 GROUP BY 1"""))
def l2_insert_or_ignore_manifest(spark, d):
    from .q_design import _design
    _, design = _design(spark, d, deal=2000)
    existing = manifest_for(design, 1, MODEL, PROVIDER, TEMPERATURE)
    incoming = manifest_for(design, 2, MODEL, PROVIDER, TEMPERATURE)
    few = ["scenario_id", "run_id", "path_type"]
    new = L.insert_or_ignore(existing.select(*few), incoming.select(*few), "run_id", within=["scenario_id"])
    return new.groupBy("path_type").agg(F.count(F.lit(1)).alias("n_new"), _id_sum())


@register("l3_insert_or_ignore_turns", with_ctes(*_PARTS_SQL, body="""
SELECT CAST(run_id AS VARCHAR) || '_t' || CAST(ti AS VARCHAR) AS turn_id
FROM (SELECT run_id, 0 AS ti FROM tt WHERE role = 'system'
      UNION ALL SELECT run_id, 2 * step + CASE WHEN role = 'user' THEN 1 ELSE 2 END FROM tt
      WHERE role IN ('user', 'assistant')) u WHERE run_id % 2 = 1"""))
def l3_insert_or_ignore_turns(spark, d):
    turns = T.interleave(*_conv_parts(spark, d))
    existing = turns.filter(F.col("run_id") % 2 == 0)
    return L.insert_or_ignore(existing, turns, "turn_id").select("turn_id")


def _ledger(spark, d):
    log = V.status_log_v(spark, d)
    man = log.select("run_id").distinct().withColumn("status", F.lit("pending"))
    return L.current_state(man, log)


_L4_SQL = [STATUS_LOG_V_SQL, """cur0 AS (SELECT run_id, max_by(struct_pack(s := status, v := verdict, t := total_tokens), ts)
  AS u, max(ts) AS ts FROM status_log_v GROUP BY 1)""",
           """cur AS (SELECT run_id, u.s AS status, u.v AS verdict, u.t AS total_tokens, ts FROM cur0)"""]


@register("l4_apply_updates", with_ctes(*_L4_SQL, body="SELECT run_id, status, verdict, total_tokens, ts AS timestamp FROM cur"))
def l4_apply_updates(spark, d):
    return _ledger(spark, d).select("run_id", "status", "verdict", "total_tokens", "timestamp")


@register("l5_count_by_status", with_ctes(*_L4_SQL, body="SELECT status, count(*) AS n FROM cur GROUP BY 1"))
def l5_count_by_status(spark, d):
    return L.count_by_status(_ledger(spark, d))


@register("l6_status_share", with_ctes(*_L4_SQL, body="""
SELECT status, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM cur GROUP BY 1"""))
def l6_status_share(spark, d):
    return rounded(L.status_share(_ledger(spark, d)))


@register("l7_all_runs_ordered", with_ctes(RUNS_V_SQL, body="SELECT run_id, status FROM runs_v ORDER BY run_id"))
def l7_all_runs_ordered(spark, d):
    return L.all_runs_ordered(V.runs_v(spark, d)).select("run_id", "status")


@register("m6_resume_set", with_ctes(*_L4_SQL, body="""
SELECT run_id, status FROM cur WHERE status IN ('pending', 'running', 'failed')"""))
def m6_resume_set(spark, d):
    log = V.status_log_v(spark, d)
    man = log.select("run_id").distinct().withColumn("status", F.lit("pending"))
    return M.resume_set(man, L.current_state(man, log)).join(
        L.current_state(man, log).select("run_id", F.col("status").alias("current")), "run_id").select(
        "run_id", F.col("current").alias("status"))
