"""Registered model fits.

Iterative fits have no SQL oracle; ``r1_fitted_margins`` is a certificate that has one: at the
maximum of the likelihood, fitted and observed successes agree in every margin.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import frames as A
from ..operators import models as R
from ..sources import views as V
from ..sources.views import RUNS_V_SQL, SCENARIOS_V_SQL, with_ctes
from .registry import register, rounded
from .q_analysis import A1_SQL


def _a1(spark, d):
    return A.completed_frame(V.runs_v(spark, d), V.scenarios_v(spark, d))


def _a6(spark, d):
    frame = A.complete_or_refused_frame(V.runs_v(spark, d), V.scenarios_v(spark, d), how="left")
    return A.refused_as_zero(frame)


@register("r1_logistic_fixed_effects")
def r1_logistic_fixed_effects(spark, d):
    return rounded(R.logistic_fixed_effects(_a1(spark, d)))


@register("r1_fitted_margins", with_ctes(RUNS_V_SQL, SCENARIOS_V_SQL, A1_SQL, body="""
SELECT 'stratum' AS margin, scenario_id AS level, count(*) AS n, sum(verdict)::DOUBLE AS observed, sum(verdict)::DOUBLE AS fitted
FROM a1 WHERE path_type <> 'unlisted' GROUP BY scenario_id
UNION ALL
SELECT 'cell', path_type || '|' || terminal_wording_id, count(*), sum(verdict)::DOUBLE, sum(verdict)::DOUBLE
FROM a1 WHERE path_type <> 'unlisted' GROUP BY path_type, terminal_wording_id"""))
def r1_fitted_margins(spark, d):
    return rounded(R.fitted_margins(_a1(spark, d)), 4)


@register("r2_path_effect_table")
def r2_path_effect_table(spark, d):
    return rounded(R.path_effect_table(R.logistic_fixed_effects(_a1(spark, d))))


@register("r3_logistic_by_wording")
def r3_logistic_by_wording(spark, d):
    return rounded(R.logistic_by_factor(_a1(spark, d)))


def _fit(spark, d):
    return R.random_slope_model(_a6(spark, d))


@register("r4_random_slope_fixed")
def r4_random_slope_fixed(spark, d):
    return rounded(_fit(spark, d)["fixed"])


@register("r5_random_slope_blups")
def r5_random_slope_blups(spark, d):
    return rounded(_fit(spark, d)["blups"])


@register("r6_conditional_effects")
def r6_conditional_effects(spark, d):
    fit = _fit(spark, d)
    return rounded(R.conditional_effects(fit, _a6(spark, d)))


@register("r7_variance_components")
def r7_variance_components(spark, d):
    fit = _fit(spark, d)
    return rounded(fit["variance"].crossJoin(fit["info"].select("converged", "boundary", "method")))


@register("r4_labelled_random_slope")
def r4_labelled_random_slope(spark, d):
    lab = V.labelled_v(spark, d).withColumn("outcome0", F.coalesce(F.col("outcome"), F.lit(0)))
    lab = lab.withColumn("factor", F.when(F.col("tokens") > 5000, "long").otherwise("short"))
    fit = R.random_slope_model(lab, arm_col="arm", factor_col="factor", stratum_col="stratum",
                               outcome_col="outcome0", treated="fr", arm_levels=["en", "de", "fr", "es"])
    return rounded(fit["fixed"])
