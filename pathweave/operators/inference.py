"""Closed-form tests and power (S1-S8), computed from per-cell counts.

Each stratum needs only (n, k) per arm, so one partial/final aggregation
reduces any number of runs to a few numbers per stratum; the statistics are
then column arithmetic (see ``functions.normal``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.normal import cohens_h, power_at_n, required_n, two_sided_p
from .aggregates import factor_values


def _nan_to_null(c):
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def two_proportion_tests(df: DataFrame, stratum_cols: list[str], arm_col: str = "path_type",
                         outcome_col: str = "verdict", arm_a: str = "direct",
                         arm_b: str = "length_matched", alpha: float = 0.05) -> DataFrame:
    """S1 + S2: pooled two-proportion z test of ``arm_a`` vs ``arm_b`` per stratum.

    Strata missing an arm are skipped; a pooled p of 0 or 1 gives NULL z, p and
    significance.  Refusals (NULL outcome) are excluded (rule K1).
    """
    d = df.filter(F.col(outcome_col).isNotNull() & F.col(arm_col).isin(arm_a, arm_b))
    y = F.col(outcome_col).cast("long")
    g = d.groupBy(*stratum_cols).agg(
        F.sum(F.when(F.col(arm_col) == arm_a, 1).otherwise(0)).alias("n1"),
        F.sum(F.when(F.col(arm_col) == arm_a, y).otherwise(0)).alias("k1"),
        F.sum(F.when(F.col(arm_col) == arm_b, 1).otherwise(0)).alias("n2"),
        F.sum(F.when(F.col(arm_col) == arm_b, y).otherwise(0)).alias("k2"),
    ).filter((F.col("n1") > 0) & (F.col("n2") > 0))
    p1 = F.col("k1") / F.col("n1")
    p2 = F.col("k2") / F.col("n2")
    pool = (F.col("k1") + F.col("k2")) / (F.col("n1") + F.col("n2"))
    se = F.sqrt(pool * (1 - pool) * (1.0 / F.col("n1") + 1.0 / F.col("n2")))
    degenerate = (F.col("k1") + F.col("k2") == 0) | (F.col("k1") + F.col("k2") == F.col("n1") + F.col("n2"))
    z = F.when(degenerate | (se <= 0), F.lit(None).cast("double")).otherwise((p1 - p2) / se)
    out = g.select(*stratum_cols, F.col("n1").alias(f"n_{arm_a}"), F.col("n2").alias(f"n_{arm_b}"),
                   p1.alias(f"p_yes_{arm_a}"), p2.alias(f"p_yes_{arm_b}"), z.alias("z_stat"))
    p = two_sided_p(F.col("z_stat"))
    return out.withColumn("p_value", p).withColumn(
        "significant_005", F.when(F.col("p_value").isNull(), F.lit(None).cast("boolean"))
        .otherwise(F.col("p_value") < alpha))


def significance_tally(tests: DataFrame, p_col: str = "p_value", alpha: float = 0.05) -> DataFrame:
    """S3: strata significant at ``alpha`` out of all tested strata."""
    return tests.agg(F.sum(F.when(F.col(p_col) < alpha, 1).otherwise(0)).cast("long").alias("n_significant"),
                     F.count(F.lit(1)).alias("n_strata"))


def pairwise_power(cells: DataFrame, stratum_cols: list[str], arms: list[str] | None = None, arm_col: str = "path_type",
                   n_col: str = "n", k_col: str = "k", p_col: str = "p_yes", n_replicates: int = 30,
                   alpha: float = 0.05, power: float = 0.8) -> DataFrame:
    """Every arm pair (A before B alphabetically) inside each stratum.

    ``cells`` has one row per (stratum, arm) with n, k, p (G4).  Pairs come from
    ``arms``, by default all arms that occur (a bounded factor): each cell is sent to the pairs it belongs to and
    one aggregation per (stratum, pair) assembles both sides, so the work is
    cells x levels, never rows x rows.  Equal proportions (k_A n_B = k_B n_A)
    are skipped.
    """
    lv = sorted(arms if arms is not None else factor_values(cells, arm_col))
    pairs = [(a, b) for i, a in enumerate(lv) for b in lv[i + 1:]]
    arr = F.array(*[F.struct(F.lit(a).alias("path_type_A"), F.lit(b).alias("path_type_B")) for a, b in pairs])
    mine = F.filter(arr, lambda s: (s["path_type_A"] == F.col(arm_col)) | (s["path_type_B"] == F.col(arm_col)))
    x = cells.select(*stratum_cols, arm_col, n_col, k_col, p_col, F.explode(mine).alias("pr"))
    side_a = F.col(arm_col) == F.col("pr.path_type_A")
    g = x.groupBy(*stratum_cols, F.col("pr.path_type_A").alias("path_type_A"),
                  F.col("pr.path_type_B").alias("path_type_B")).agg(
        F.max(F.when(side_a, F.col(p_col))).alias("p_yes_A"), F.max(F.when(~side_a, F.col(p_col))).alias("p_yes_B"),
        F.max(F.when(side_a, F.col(n_col))).alias("n_A"), F.max(F.when(~side_a, F.col(n_col))).alias("n_B"),
        F.max(F.when(side_a, F.col(k_col))).alias("k_A"), F.max(F.when(~side_a, F.col(k_col))).alias("k_B"))
    g = g.filter(F.col("p_yes_A").isNotNull() & F.col("p_yes_B").isNotNull()
                 & (F.col("k_A") * F.col("n_B") != F.col("k_B") * F.col("n_A")))
    h = cohens_h(F.col("p_yes_A"), F.col("p_yes_B"))
    return g.select(*stratum_cols, "path_type_A", "path_type_B", "p_yes_A", "p_yes_B",
                    h.alias("effect_size_h"),
                    power_at_n(h, n_replicates, alpha).alias("power_at_n"),
                    required_n(h, alpha, power).alias("required_n_80pct"))


def sample_size_recommendation(power_table: DataFrame, target_power: float = 0.8) -> DataFrame:
    """Weakest power, largest required n, and whether the plan is adequate."""
    g = power_table.agg(F.min("power_at_n").alias("min_power"), F.max("required_n_80pct").alias("max_required_n"),
                        F.count(F.lit(1)).alias("n_pairs"))
    return g.withColumn("adequate", F.col("min_power") >= target_power)
