"""Registered analysis queries: frames (A), aggregates (G), tests and power (S), raw effects."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.normal import sql_norm_cdf, sql_power_at_n, sql_required_n, sql_two_sided_p
from ..operators import aggregates as G
from ..operators import frames as A
from ..operators import inference as S
from ..operators.models import raw_stratum_effects
from ..sources import views as V
from ..sources.views import (LABELLED_V_SQL, RUNS_V_SQL, SCENARIOS_V_SQL, with_ctes)
from .registry import register, rounded

WORDINGS = ["W1", "W2", "W3"]
LANGS = ["en", "de", "fr", "es"]

A1_SQL = """a1 AS (SELECT r.run_id, r.scenario_id, r.path_type, r.terminal_wording_id, r.verdict, r.status,
    r.total_tokens, s.independence_class
  FROM runs_v r JOIN scenarios_v s USING (scenario_id)
  WHERE r.status = 'complete' AND r.verdict IS NOT NULL)"""
A2_SQL = """a2 AS (SELECT r.run_id, r.scenario_id, r.path_type, r.terminal_wording_id, r.verdict, r.status,
    r.total_tokens, s.independence_class
  FROM runs_v r JOIN scenarios_v s USING (scenario_id) WHERE r.status IN ('complete', 'refused'))"""
A3_SQL = """a3 AS (SELECT * FROM runs_v WHERE status IN ('complete', 'refused'))"""
A4_SQL = """a4 AS (SELECT r.run_id, r.scenario_id, r.path_type, r.terminal_wording_id, r.verdict, r.status,
    s.independence_class
  FROM runs_v r LEFT JOIN scenarios_v s USING (scenario_id) WHERE r.status IN ('complete', 'refused'))"""
LEVELS_SQL = """lv AS (SELECT * FROM (VALUES ('direct', 0), ('sequential', 1), ('skipped', 2),
  ('alt_grouping', 3), ('length_matched', 4)) t(path_type, level))"""
BASE = [RUNS_V_SQL, SCENARIOS_V_SQL]

_FRAME_COLS = ["run_id", "scenario_id", "path_type", "terminal_wording_id", "verdict", "status", "independence_class"]


def _runs(spark, d):
    return V.runs_v(spark, d), V.scenarios_v(spark, d)


def _a1(spark, d):
    r, s = _runs(spark, d)
    return A.completed_frame(r, s)


def _a2(spark, d):
    r, s = _runs(spark, d)
    return A.complete_or_refused_frame(r, s)


def _a3(spark, d, scenario=None):
    return A.pilot_frame(V.runs_v(spark, d), scenario)


def _a4(spark, d):
    r, s = _runs(spark, d)
    return A.complete_or_refused_frame(r, s, how="left")


# --- frames -------------------------------------------------------------------

@register("a1_completed_frame", with_ctes(*BASE, A1_SQL, body="""
SELECT run_id, scenario_id, path_type, terminal_wording_id, verdict, status, independence_class FROM a1"""))
def a1_completed_frame(spark, d):
    return _a1(spark, d).select(*_FRAME_COLS)


@register("a2_finished_frame", with_ctes(*BASE, A2_SQL, body="""
SELECT run_id, scenario_id, path_type, terminal_wording_id, verdict, status, total_tokens, independence_class
FROM a2"""))
def a2_finished_frame(spark, d):
    return _a2(spark, d).select(*_FRAME_COLS, "total_tokens")


@register("a3_pilot_frame", with_ctes(*BASE, A3_SQL, body="""
SELECT run_id, scenario_id, path_type, terminal_wording_id, verdict, status FROM a3
WHERE scenario_id = 'NATION_7'"""))
def a3_pilot_frame(spark, d):
    return _a3(spark, d, "NATION_7").select(*_FRAME_COLS[:-1])


@register("a4_mixed_model_frame", with_ctes(*BASE, A4_SQL, body="SELECT * FROM a4"))
def a4_mixed_model_frame(spark, d):
    return _a4(spark, d).select(*_FRAME_COLS)


@register("a5_factor_levels", with_ctes(*BASE, A1_SQL, LEVELS_SQL, body="""
SELECT a1.run_id, a1.path_type, lv.level AS path_type_level FROM a1 LEFT JOIN lv USING (path_type)"""))
def a5_factor_levels(spark, d):
    return A.with_levels(_a1(spark, d), "path_type").select("run_id", "path_type", "path_type_level")


@register("a6_refused_as_zero", with_ctes(*BASE, A4_SQL, body="""
SELECT run_id, scenario_id, path_type, CAST(coalesce(verdict, 0) AS INTEGER) AS verdict_numeric,
  CAST(path_type = 'sequential' AS INTEGER) AS is_sequential FROM a4"""))
def a6_refused_as_zero(spark, d):
    return A.refused_as_zero(_a4(spark, d)).select("run_id", "scenario_id", "path_type", "verdict_numeric",
                                                   "is_sequential")


_A7_KEEP = """keep AS (SELECT scenario_id FROM a1 WHERE path_type = 'direct' GROUP BY scenario_id
  HAVING avg(verdict) BETWEEN 0.2 AND 0.8)"""


@register("a7_ambiguous_strata", with_ctes(*BASE, A1_SQL, _A7_KEEP, body="""
SELECT run_id, scenario_id, path_type, verdict FROM a1 WHERE scenario_id IN (SELECT scenario_id FROM keep)"""))
def a7_ambiguous_strata(spark, d):
    return A.ambiguous_strata(_a1(spark, d)).select("run_id", "scenario_id", "path_type", "verdict")


_A8_KEEP = """keep AS (SELECT scenario_id FROM a1 WHERE path_type = 'direct' GROUP BY scenario_id
  HAVING avg(verdict) BETWEEN 0.5 AND 0.53)"""


@register("a8_filter_audit", with_ctes(*BASE, A1_SQL, _A8_KEEP, body="""
SELECT b.sb AS strata_before, f.sa AS strata_after, b.sb - f.sa AS strata_removed, b.rb AS rows_before,
  f.ra AS rows_after
FROM (SELECT count(DISTINCT scenario_id) sb, count(*) rb FROM a1) b,
     (SELECT count(DISTINCT scenario_id) sa, count(*) ra FROM a1 WHERE scenario_id IN (SELECT scenario_id FROM keep)) f"""))
def a8_filter_audit(spark, d):
    a1 = _a1(spark, d)
    return A.filter_audit(a1, A.ambiguous_strata(a1, lo=0.5, hi=0.53))


# --- aggregates -----------------------------------------------------------------

@register("g1_condition_summary", with_ctes(*BASE, A1_SQL, LEVELS_SQL, """g AS (SELECT path_type, count(verdict) AS n,
  avg(verdict) AS p_yes, stddev_samp(verdict) AS sd FROM a1 GROUP BY path_type)""", body="""
SELECT lv.path_type, lv.level, coalesce(g.n, 0) AS n, round(g.p_yes, 6) AS p_yes, round(g.sd, 6) AS sd,
  round(g.p_yes - 1.96 * g.sd / sqrt(g.n), 6) AS ci_lo, round(g.p_yes + 1.96 * g.sd / sqrt(g.n), 6) AS ci_hi
FROM lv LEFT JOIN g USING (path_type)"""))
def g1_condition_summary(spark, d):
    return rounded(G.condition_summary(_a1(spark, d)))


_LANG_LEVELS_SQL = """lv AS (SELECT * FROM (VALUES ('en', 0), ('de', 1), ('fr', 2), ('es', 3)) t(arm, level))"""


@register("g1_labelled_summary", with_ctes(LABELLED_V_SQL, _LANG_LEVELS_SQL, """g AS (SELECT arm, count(outcome) AS n,
  avg(outcome) AS p_yes, stddev_samp(outcome) AS sd FROM labelled_v
  WHERE status = 'complete' AND outcome IS NOT NULL GROUP BY arm)""", body="""
SELECT lv.arm, lv.level, coalesce(g.n, 0) AS n, round(g.p_yes, 6) AS p_yes, round(g.sd, 6) AS sd,
  round(g.p_yes - 1.96 * g.sd / sqrt(g.n), 6) AS ci_lo, round(g.p_yes + 1.96 * g.sd / sqrt(g.n), 6) AS ci_hi
FROM lv LEFT JOIN g USING (arm)"""))
def g1_labelled_summary(spark, d):
    lab = V.labelled_v(spark, d).filter((F.col("status") == "complete") & F.col("outcome").isNotNull())
    return rounded(G.condition_summary(lab, arm_col="arm", outcome_col="outcome", levels=LANGS))


@register("g2_two_factor", with_ctes(*BASE, A1_SQL, LEVELS_SQL, """g AS (SELECT path_type, terminal_wording_id,
  count(verdict) AS n, avg(verdict) AS p_yes FROM a1 GROUP BY 1, 2)""", """grid AS (SELECT lv.path_type, lv.level,
  w.terminal_wording_id FROM lv, (SELECT DISTINCT terminal_wording_id FROM a1) w)""", body="""
SELECT grid.path_type, grid.terminal_wording_id, grid.level, coalesce(g.n, 0) AS n, round(g.p_yes, 6) AS p_yes
FROM grid LEFT JOIN g USING (path_type, terminal_wording_id)"""))
def g2_two_factor(spark, d):
    return rounded(G.two_factor_proportions(_a1(spark, d)))


@register("g3_per_wording", with_ctes(*BASE, A1_SQL, LEVELS_SQL, """g AS (SELECT path_type, terminal_wording_id,
  count(verdict) AS n, avg(verdict) AS p_yes FROM a1 GROUP BY 1, 2)""", """t AS (SELECT terminal_wording_id,
  count(DISTINCT scenario_id) AS n_strata, count(*) AS n_obs FROM a1 GROUP BY 1)""",
  """grid AS (SELECT lv.path_type, lv.level, w.terminal_wording_id FROM lv,
  (SELECT DISTINCT terminal_wording_id FROM a1) w)""", body="""
SELECT grid.terminal_wording_id, grid.path_type, grid.level, coalesce(g.n, 0) AS n, round(g.p_yes, 6) AS p_yes,
  t.n_strata, t.n_obs
FROM grid LEFT JOIN g USING (path_type, terminal_wording_id) JOIN t USING (terminal_wording_id)"""))
def g3_per_wording(spark, d):
    return rounded(G.per_factor_proportions(_a1(spark, d)))


_CELLS_SQL = """cells AS (SELECT scenario_id, path_type, terminal_wording_id, count(verdict) AS n,
  CAST(sum(verdict) AS BIGINT) AS k, avg(verdict) AS p_yes FROM a3 WHERE verdict IS NOT NULL GROUP BY 1, 2, 3)"""
CELL_KEYS = ["scenario_id", "path_type", "terminal_wording_id"]


@register("g4_cell_variance", with_ctes(*BASE, A3_SQL, _CELLS_SQL, body="""
SELECT scenario_id, path_type, terminal_wording_id, n, k, round(p_yes, 6) AS p_yes,
  round(p_yes * (1 - p_yes), 6) AS variance, round(sqrt(p_yes * (1 - p_yes) / n), 6) AS std_err FROM cells"""))
def g4_cell_variance(spark, d):
    return rounded(G.cell_proportions(_a3(spark, d), CELL_KEYS))


@register("g5_effect_range_by_class", with_ctes(*BASE, A2_SQL, """c AS (SELECT independence_class,
  terminal_wording_id, path_type, avg(verdict) AS p FROM a2 WHERE verdict IS NOT NULL GROUP BY 1, 2, 3)""", body="""
SELECT independence_class, terminal_wording_id, round(max(p) - min(p), 6) AS p_yes_range,
  count(*) AS n_path_types FROM c GROUP BY 1, 2"""))
def g5_effect_range_by_class(spark, d):
    return rounded(G.effect_range(_a2(spark, d), ["independence_class", "terminal_wording_id"]))


@register("g6_refusal_by_path_wording", with_ctes(*BASE, A2_SQL, body="""
SELECT path_type, terminal_wording_id, count(*) AS n,
  round(avg(CASE WHEN status = 'refused' THEN 1.0 ELSE 0.0 END), 6) AS refusal_rate FROM a2 GROUP BY 1, 2"""))
def g6_refusal_by_path_wording(spark, d):
    return rounded(G.refusal_rates(_a2(spark, d), ["path_type", "terminal_wording_id"]))


@register("g7_refusal_by_path", with_ctes(*BASE, A3_SQL, body="""
SELECT path_type, count(*) AS n,
  round(avg(CASE WHEN status = 'refused' THEN 1.0 ELSE 0.0 END), 6) AS refusal_rate FROM a3 GROUP BY 1"""))
def g7_refusal_by_path(spark, d):
    return rounded(G.refusal_rates(_a3(spark, d), ["path_type"]))


_WCELLS_SQL = """wc AS (SELECT scenario_id, path_type, terminal_wording_id, avg(verdict) AS p FROM a2
  WHERE verdict IS NOT NULL GROUP BY 1, 2, 3)"""


@register("g8_cross_wording_stability", with_ctes(*BASE, A2_SQL, _WCELLS_SQL, body="""
SELECT scenario_id, path_type, count(*) AS n_wordings, round(avg(p), 6) AS p_yes_mean,
  round(stddev_samp(p), 6) AS p_yes_std_across_wordings FROM wc GROUP BY 1, 2 HAVING count(*) >= 2"""))
def g8_cross_wording_stability(spark, d):
    return rounded(G.cross_factor_stability(_a2(spark, d), ["scenario_id", "path_type"]))


def _corr_sql():
    pairs = [(a, b) for i, a in enumerate(WORDINGS) for b in WORDINGS[i + 1:]]
    wide = ("wide AS (SELECT scenario_id, path_type, " + ", ".join(
        f"max(CASE WHEN terminal_wording_id = '{w}' THEN p END) AS \"{w}\"" for w in WORDINGS)
        + " FROM wc GROUP BY 1, 2)")
    body = "\nUNION ALL\n".join(
        f"SELECT '{a}' AS wording_a, '{b}' AS wording_b, "
        f"CAST(sum(CASE WHEN \"{a}\" IS NOT NULL AND \"{b}\" IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_units, "
        f"round(corr(\"{a}\", \"{b}\"), 6) AS corr FROM wide" for a, b in pairs)
    return with_ctes(*BASE, A2_SQL, _WCELLS_SQL, wide, body=body)


@register("g9_cross_wording_corr", _corr_sql())
def g9_cross_wording_corr(spark, d):
    return rounded(G.cross_factor_correlation(_a2(spark, d), ["scenario_id", "path_type"], values=WORDINGS))


@register("g10_token_comparison", with_ctes(*BASE, A2_SQL, body="""
SELECT scenario_id, path_type, count(total_tokens) AS n, round(avg(total_tokens), 6) AS mean_tokens,
  round(stddev_samp(total_tokens), 6) AS std_tokens FROM a2
WHERE path_type IN ('sequential', 'length_matched') GROUP BY 1, 2"""))
def g10_token_comparison(spark, d):
    return rounded(G.token_comparison(_a2(spark, d)))


@register("g11_token_distribution", with_ctes(*BASE, A2_SQL, body="""
SELECT path_type, count(total_tokens) AS n, min(total_tokens) AS min_tokens, max(total_tokens) AS max_tokens,
  quantile_disc(total_tokens, 0.25) AS q25, quantile_disc(total_tokens, 0.5) AS q50,
  quantile_disc(total_tokens, 0.75) AS q75 FROM a2 GROUP BY 1"""))
def g11_token_distribution(spark, d):
    return G.token_distribution(_a2(spark, d))


@register("g12_path_wording_matrix", with_ctes(*BASE, A1_SQL, body="SELECT path_type, " + ", ".join(
    f"round(avg(CASE WHEN terminal_wording_id = '{w}' THEN verdict END), 6) AS \"{w}\"" for w in WORDINGS)
    + " FROM a1 GROUP BY 1"))
def g12_path_wording_matrix(spark, d):
    return rounded(G.pivot_means(_a1(spark, d), values=WORDINGS))


@register("g13_first_class", with_ctes(*BASE, A4_SQL, body="""
SELECT scenario_id, min(independence_class) AS independence_class FROM a4 GROUP BY 1"""))
def g13_first_class(spark, d):
    return G.first_per_group(_a4(spark, d))


_EFFECT_SQL = """eff AS (SELECT a4.scenario_id, min(a4.independence_class) AS independence_class,
  avg(CASE WHEN path_type = 'sequential' THEN coalesce(verdict, 0) END)
  - avg(CASE WHEN path_type = 'direct' THEN coalesce(verdict, 0) END) AS effect
  FROM a4 GROUP BY 1)"""


def _effects(spark, d):
    a6 = A.refused_as_zero(_a4(spark, d))
    return raw_stratum_effects(a6, outcome_col="verdict_numeric", dims=("independence_class",))


@register("r8_raw_stratum_effect", with_ctes(*BASE, A4_SQL, _EFFECT_SQL, body="""
SELECT scenario_id, independence_class, round(effect, 6) AS effect FROM eff"""))
def r8_raw_stratum_effect(spark, d):
    return rounded(_effects(spark, d))


@register("g14_effect_by_class", with_ctes(*BASE, A4_SQL, _EFFECT_SQL, body="""
SELECT independence_class, round(avg(effect), 6) AS mean, round(stddev_samp(effect), 6) AS std,
  round(min(effect), 6) AS min, round(max(effect), 6) AS max, count(effect) AS count FROM eff GROUP BY 1"""))
def g14_effect_by_class(spark, d):
    return rounded(G.effect_summary(_effects(spark, d)))


@register("g15_effects_ranked", with_ctes(*BASE, A4_SQL, _EFFECT_SQL, body="""
SELECT scenario_id, round(effect, 6) AS effect, rank() OVER (ORDER BY effect) AS rank FROM eff"""))
def g15_effects_ranked(spark, d):
    return rounded(G.global_rank(_effects(spark, d).select("scenario_id", "effect"), "effect"))


@register("g15_documents_ranked", """
SELECT doc_id, n_chars, rank() OVER (ORDER BY n_chars) AS rank FROM documents""")
def g15_documents_ranked(spark, d):
    return G.global_rank(V.read(spark, d, "documents").select("doc_id", "n_chars"), "n_chars")


@register("g16_verdict_distribution", with_ctes(*BASE, A2_SQL, body="""
SELECT scenario_id, path_type, terminal_wording_id,
  CAST(sum(CASE WHEN verdict = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_yes,
  CAST(sum(CASE WHEN verdict = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_no,
  CAST(sum(CASE WHEN status = 'refused' THEN 1 ELSE 0 END) AS BIGINT) AS n_refused, count(*) AS n
FROM a2 GROUP BY 1, 2, 3"""))
def g16_verdict_distribution(spark, d):
    return G.outcome_distribution(_a2(spark, d), CELL_KEYS)


# --- tests and power ------------------------------------------------------------------

def _s1_sql(frame_cte, frame, strata, arm, outcome, a, b):
    g = (f"g AS (SELECT {strata}, "
         f"CAST(sum(CASE WHEN {arm} = '{a}' THEN 1 ELSE 0 END) AS BIGINT) AS n1, "
         f"CAST(sum(CASE WHEN {arm} = '{a}' THEN {outcome} ELSE 0 END) AS BIGINT) AS k1, "
         f"CAST(sum(CASE WHEN {arm} = '{b}' THEN 1 ELSE 0 END) AS BIGINT) AS n2, "
         f"CAST(sum(CASE WHEN {arm} = '{b}' THEN {outcome} ELSE 0 END) AS BIGINT) AS k2 "
         f"FROM {frame} WHERE {outcome} IS NOT NULL AND {arm} IN ('{a}', '{b}') GROUP BY {strata})")
    z = ("z AS (SELECT *, k1 / n1 AS p1, k2 / n2 AS p2, "
         "CASE WHEN k1 + k2 = 0 OR k1 + k2 = n1 + n2 THEN NULL ELSE "
         "(k1 / n1 - k2 / n2) / sqrt(((k1 + k2) / (n1 + n2)) * (1 - (k1 + k2) / (n1 + n2)) "
         "* (1.0 / n1 + 1.0 / n2)) END AS zs FROM g WHERE n1 > 0 AND n2 > 0)")
    p = sql_two_sided_p("zs")
    body = (f"SELECT {strata}, n1 AS n_{a}, n2 AS n_{b}, round(p1, 6) AS p_yes_{a}, round(p2, 6) AS p_yes_{b}, "
            f"round(zs, 6) AS z_stat, round({p}, 6) AS p_value, "
            f"CASE WHEN zs IS NULL THEN NULL ELSE {p} < 0.05 END AS significant_005 FROM z")
    return frame_cte, g, z, body


def _s1_oracle():
    *ctes, body = _s1_sql(A1_SQL, "a1", "scenario_id, terminal_wording_id", "path_type", "verdict",
                          "direct", "length_matched")
    return with_ctes(*BASE, *ctes, body=body)


def _s1(spark, d):
    return S.two_proportion_tests(_a1(spark, d), ["scenario_id", "terminal_wording_id"])


@register("s1_two_proportion_z", _s1_oracle())
def s1_two_proportion_z(spark, d):
    return rounded(_s1(spark, d))


def _s1_labelled_oracle():
    frame = "lab AS (SELECT * FROM labelled_v WHERE status = 'complete')"
    *ctes, body = _s1_sql(frame, "lab", "stratum", "arm", "outcome", "en", "de")
    return with_ctes(LABELLED_V_SQL, *ctes, body=body)


@register("s1_labelled_two_proportion", _s1_labelled_oracle())
def s1_labelled_two_proportion(spark, d):
    lab = V.labelled_v(spark, d).filter(F.col("status") == "complete")
    return rounded(S.two_proportion_tests(lab, ["stratum"], arm_col="arm", outcome_col="outcome",
                                          arm_a="en", arm_b="de"))


def _s3_oracle():
    *ctes, body = _s1_sql(A1_SQL, "a1", "scenario_id, terminal_wording_id", "path_type", "verdict",
                          "direct", "length_matched")
    p = sql_two_sided_p("zs")
    return with_ctes(*BASE, *ctes, body=f"""
SELECT CAST(sum(CASE WHEN {p} < 0.05 THEN 1 ELSE 0 END) AS BIGINT) AS n_significant, count(*) AS n_strata FROM z""")


@register("s3_significance_tally", _s3_oracle())
def s3_significance_tally(spark, d):
    return S.significance_tally(_s1(spark, d))




def _s7_core():
    h = "abs(2 * asin(sqrt(a.p_yes)) - 2 * asin(sqrt(b.p_yes)))"
    return f"""pw AS (SELECT a.scenario_id, a.terminal_wording_id, a.path_type AS path_type_A, b.path_type AS path_type_B,
  a.p_yes AS p_yes_A, b.p_yes AS p_yes_B, {h} AS h
  FROM cells a JOIN cells b ON a.scenario_id = b.scenario_id AND a.terminal_wording_id = b.terminal_wording_id
   AND a.path_type < b.path_type
  WHERE a.k * b.n <> b.k * a.n)"""


@register("s7_pairwise_power", with_ctes(*BASE, A3_SQL, _CELLS_SQL, _s7_core(), body=f"""
SELECT scenario_id, terminal_wording_id, path_type_A, path_type_B, round(p_yes_A, 6) AS p_yes_A,
  round(p_yes_B, 6) AS p_yes_B, round(h, 6) AS effect_size_h, round({sql_power_at_n('h', 30)}, 6) AS power_at_n,
  {sql_required_n('h')} AS required_n_80pct FROM pw"""))
def s7_pairwise_power(spark, d):
    cells = G.cell_proportions(_a3(spark, d), CELL_KEYS)
    return rounded(S.pairwise_power(cells, ["scenario_id", "terminal_wording_id"]))


@register("s8_sample_size_recommendation", with_ctes(*BASE, A3_SQL, _CELLS_SQL, _s7_core(), body=f"""
SELECT round(min({sql_power_at_n('h', 30)}), 6) AS min_power, max({sql_required_n('h')}) AS max_required_n,
  count(*) AS n_pairs, min({sql_power_at_n('h', 30)}) >= 0.8 AS adequate FROM pw"""))
def s8_sample_size_recommendation(spark, d):
    cells = G.cell_proportions(_a3(spark, d), CELL_KEYS)
    return rounded(S.sample_size_recommendation(S.pairwise_power(cells, ["scenario_id", "terminal_wording_id"])))


@register("s2_normal_tail", """
SELECT doc_id, round(z, 6) AS z, round(""" + sql_two_sided_p("z") + """, 6) AS p_two_sided,
  round(""" + sql_norm_cdf("z") + """, 6) AS cdf
FROM (SELECT doc_id, (n_chars - 5000.0) / 2500.0 AS z FROM documents) t""")
def s2_normal_tail(spark, d):
    from ..functions.normal import norm_cdf, two_sided_p
    z = (F.col("n_chars") - 5000.0) / 2500.0
    doc = V.read(spark, d, "documents").select("doc_id", z.alias("z"))
    return rounded(doc.select("doc_id", "z", two_sided_p(F.col("z")).alias("p_two_sided"),
                              norm_cdf(F.col("z")).alias("cdf")))
