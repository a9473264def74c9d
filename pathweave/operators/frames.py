"""Analysis frames (A1-A8): projections, filters and dimension joins over a run ledger.

Every function takes the column names it uses, so the same code runs on any
outcome table.  Dimension joins are left to Catalyst: the dimension (scenario
metadata) is read from files, so its estimated size is known and the planner
broadcasts it only under ``spark.sql.autoBroadcastJoinThreshold``; AQE re-checks
the real size at run time.  ``bounded_broadcast`` is the explicit form for a
side whose row count we verify ourselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .paths import PATH_LEVELS


def bounded_broadcast(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """Broadcast hint only after proving ``df`` has at most ``max_rows`` rows.

    The proof is a ``limit(max_rows + 1).count()`` job (stops early); beyond
    the bound the DataFrame is returned unchanged and the planner shuffles.
    """
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df


def completed_frame(runs: DataFrame, scenarios: DataFrame, key: str = "scenario_id",
                    status_col: str = "status", outcome_col: str = "verdict",
                    dims: tuple[str, ...] = ("independence_class",)) -> DataFrame:
    """A1: complete runs with a non-null outcome, inner-joined to scenario metadata."""
    r = runs.filter((F.col(status_col) == "complete") & F.col(outcome_col).isNotNull())
    return r.join(scenarios.select(key, *dims), key)


def complete_or_refused_frame(runs: DataFrame, scenarios: DataFrame, key: str = "scenario_id",
                              status_col: str = "status",
                              dims: tuple[str, ...] = ("independence_class",),
                              how: str = "inner") -> DataFrame:
    """A2 (inner) / A4 (``how='left'``): runs that finished, complete or refused."""
    r = runs.filter(F.col(status_col).isin("complete", "refused"))
    return r.join(scenarios.select(key, *dims), key, how)


def pilot_frame(runs: DataFrame, scenario: str | None = None, key: str = "scenario_id",
                status_col: str = "status") -> DataFrame:
    """A3: finished runs, optionally one scenario (a pushed-down equality filter)."""
    r = runs.filter(F.col(status_col).isin("complete", "refused"))
    if scenario is not None:
        r = r.filter(F.col(key) == scenario)
    return r


def level_table(spark, name: str, levels: list[str]) -> DataFrame:
    """A5: a factor's levels with their position (0 = reference level)."""
    return spark.createDataFrame([(v, i) for i, v in enumerate(levels)], f"{name} string, {name}_level int")


def with_levels(df: DataFrame, col: str, levels: list[str] | None = None) -> DataFrame:
    """A5: attach the level index of ``col``; values outside the levels get NULL.

    The level table is a literal of a handful of rows, so a CASE expression
    does the lookup in place (no join, no shuffle).
    """
    lv = levels or PATH_LEVELS
    expr = None
    for i, v in enumerate(lv):
        expr = F.when(F.col(col) == v, i) if expr is None else expr.when(F.col(col) == v, i)
    return df.withColumn(f"{col}_level", expr.otherwise(F.lit(None).cast("int")))


def refused_as_zero(df: DataFrame, outcome_col: str = "verdict", arm_col: str = "path_type",
                    treated: str = "sequential") -> DataFrame:
    """``verdict_numeric = coalesce(verdict, 0)`` and the treated-arm indicator."""
    return (df.withColumn("verdict_numeric", F.coalesce(F.col(outcome_col).cast("int"), F.lit(0)))
            .withColumn("is_sequential", (F.col(arm_col) == treated).cast("int")))


def baseline_means(df: DataFrame, stratum_col: str = "scenario_id", arm_col: str = "path_type",
                   outcome_col: str = "verdict", baseline: str = "direct") -> DataFrame:
    return (df.filter(F.col(arm_col) == baseline).groupBy(stratum_col)
            .agg(F.avg(F.col(outcome_col).cast("double")).alias("baseline_p")))


def ambiguous_strata(df: DataFrame, stratum_col: str = "scenario_id", arm_col: str = "path_type",
                     outcome_col: str = "verdict", baseline: str = "direct",
                     lo: float = 0.2, hi: float = 0.8) -> DataFrame:
    """Keep strata whose baseline-arm mean lies in [lo, hi] (no baseline rows: dropped)."""
    keep = (baseline_means(df, stratum_col, arm_col, outcome_col, baseline)
            .filter(F.col("baseline_p").between(lo, hi)).select(stratum_col))
    return df.join(keep, stratum_col, "left_semi")


def filter_audit(before: DataFrame, after: DataFrame, stratum_col: str = "scenario_id") -> DataFrame:
    """Strata and rows before and after a filter, as one row.

    Two single-row aggregates side by side; ``crossJoin`` of 1x1 rows is the
    row concatenation, not a pair expansion.
    """
    b = before.agg(F.countDistinct(stratum_col).alias("strata_before"), F.count(F.lit(1)).alias("rows_before"))
    a = after.agg(F.countDistinct(stratum_col).alias("strata_after"), F.count(F.lit(1)).alias("rows_after"))
    return b.crossJoin(a).select(
        "strata_before", "strata_after", (F.col("strata_before") - F.col("strata_after")).alias("strata_removed"),
        "rows_before", "rows_after")
