"""Aggregations over outcome frames.

All statistics are built-in aggregates (partial + final HashAggregate, so a hot
group is pre-combined map-side and never gathered into one task).  Factor
levels are small, explicit lists; "every level appears" (rule K3) is done by
exploding the level list next to the observed keys, never by a cross join.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .paths import PATH_LEVELS

Z95 = 1.96


def _d(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def _levels_frame(df: DataFrame, arm_col: str, levels: list[str], by: list[str]) -> DataFrame:
    """Every (by..., level) combination: observed ``by`` keys x the literal levels."""
    arr = F.array(*[F.struct(F.lit(v).alias(arm_col), F.lit(i).alias("level")) for i, v in enumerate(levels)])
    base = df.select(*by).distinct() if by else df.sparkSession.range(1).select()
    return base.select(*by, F.inline(arr))


def condition_summary(df: DataFrame, arm_col: str = "path_type", outcome_col: str = "verdict",
                      levels: list[str] | None = None, z: float = Z95) -> DataFrame:
    """G1: n, mean, sample sd and normal CI per arm; every level listed (n = 0 if empty)."""
    lv = levels or PATH_LEVELS
    agg = df.groupBy(arm_col).agg(F.count(outcome_col).alias("n"), F.avg(_d(outcome_col)).alias("p_yes"),
                                  F.stddev_samp(_d(outcome_col)).alias("sd"))
    out = _levels_frame(df, arm_col, lv, []).join(agg, arm_col, "left")
    half = z * F.col("sd") / F.sqrt(F.col("n"))
    return out.select(arm_col, "level", F.coalesce("n", F.lit(0)).alias("n"), "p_yes", "sd",
                      (F.col("p_yes") - half).alias("ci_lo"), (F.col("p_yes") + half).alias("ci_hi"))


def two_factor_proportions(df: DataFrame, arm_col: str = "path_type", factor_col: str = "terminal_wording_id",
                           outcome_col: str = "verdict", levels: list[str] | None = None) -> DataFrame:
    """N and mean for the full grid of arm levels x observed factor values."""
    lv = levels or PATH_LEVELS
    agg = df.groupBy(arm_col, factor_col).agg(F.count(outcome_col).alias("n"),
                                             F.avg(_d(outcome_col)).alias("p_yes"))
    grid = _levels_frame(df, arm_col, lv, [factor_col])
    return grid.join(agg, [arm_col, factor_col], "left").select(
        arm_col, factor_col, "level", F.coalesce("n", F.lit(0)).alias("n"), "p_yes")


def per_factor_proportions(df: DataFrame, arm_col: str = "path_type", factor_col: str = "terminal_wording_id",
                           stratum_col: str = "scenario_id", outcome_col: str = "verdict",
                           levels: list[str] | None = None) -> DataFrame:
    """Inside each factor value, n and p_yes per arm plus strata and row counts."""
    lv = levels or PATH_LEVELS
    cells = df.groupBy(factor_col, arm_col).agg(F.count(outcome_col).alias("n"),
                                               F.avg(_d(outcome_col)).alias("p_yes"))
    totals = df.groupBy(factor_col).agg(F.countDistinct(stratum_col).alias("n_strata"),
                                        F.count(F.lit(1)).alias("n_obs"))
    grid = _levels_frame(df, arm_col, lv, [factor_col])
    return (grid.join(cells, [factor_col, arm_col], "left").join(totals, factor_col)
            .select(factor_col, arm_col, "level", F.coalesce("n", F.lit(0)).alias("n"), "p_yes",
                    "n_strata", "n_obs"))


def cell_proportions(df: DataFrame, cell_cols: list[str], outcome_col: str = "verdict") -> DataFrame:
    """Per cell n, p, p(1-p) and its standard error sqrt(p(1-p)/n) (rule K5)."""
    g = (df.filter(F.col(outcome_col).isNotNull()).groupBy(*cell_cols)
         .agg(F.count(outcome_col).alias("n"), F.sum(F.col(outcome_col).cast("long")).alias("k"),
              F.avg(_d(outcome_col)).alias("p_yes")))
    var = F.col("p_yes") * (1 - F.col("p_yes"))
    return g.select(*cell_cols, "n", "k", "p_yes", var.alias("variance"),
                    F.sqrt(var / F.col("n")).alias("std_err"))


def effect_range(df: DataFrame, group_cols: list[str], arm_col: str = "path_type",
                 outcome_col: str = "verdict") -> DataFrame:
    """Per group, max - min of the arm means and the number of arms seen."""
    cells = (df.filter(F.col(outcome_col).isNotNull()).groupBy(*group_cols, arm_col)
             .agg(F.avg(_d(outcome_col)).alias("p_yes")))
    return cells.groupBy(*group_cols).agg((F.max("p_yes") - F.min("p_yes")).alias("p_yes_range"),
                                          F.count(F.lit(1)).alias("n_path_types"))


def refusal_rates(df: DataFrame, group_cols: list[str], status_col: str = "status") -> DataFrame:
    """N and share refused among finished runs (rule K2 denominators)."""
    fin = df.filter(F.col(status_col).isin("complete", "refused"))
    return fin.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.when(F.col(status_col) == "refused", 1.0).otherwise(0.0)).alias("refusal_rate"))


def cross_factor_stability(df: DataFrame, unit_cols: list[str], factor_col: str = "terminal_wording_id",
                           outcome_col: str = "verdict", min_values: int = 2) -> DataFrame:
    """Per unit, how the cell mean varies across factor values (>= ``min_values``)."""
    cells = (df.filter(F.col(outcome_col).isNotNull()).groupBy(*unit_cols, factor_col)
             .agg(F.avg(_d(outcome_col)).alias("p_yes")))
    return (cells.groupBy(*unit_cols).agg(F.count(F.lit(1)).alias("n_wordings"),
                                          F.avg("p_yes").alias("p_yes_mean"),
                                          F.stddev_samp("p_yes").alias("p_yes_std_across_wordings"))
            .filter(F.col("n_wordings") >= min_values))


def factor_values(df: DataFrame, col: str, max_values: int = 1000) -> list[str]:
    """Sorted distinct values of a factor column, refusing unbounded factors."""
    vals = [r[0] for r in df.select(col).distinct().limit(max_values + 1).collect()]
    if len(vals) > max_values:
        raise ValueError(f"{col} has more than {max_values} levels; not a factor")
    return sorted(v for v in vals if v is not None)


CORRELATED_VALUES = 2500  # at six doubles a pair, 300 MB in a task


def cross_factor_correlation(df: DataFrame, unit_cols: list[str], factor_col: str = "terminal_wording_id",
                             outcome_col: str = "verdict", values: list[str] | None = None) -> DataFrame:
    """Pearson correlation of cell means between every pair of factor values.

    A task lays its units out as rows of a matrix with one column per factor value and adds up co-moments over
    the cells both values have; they are summed by pair, so no row pairs and no expression per pair are made.
    A task holds six sums per pair of at most ``CORRELATED_VALUES`` values.  Long output: (wording_a, wording_b,
    n_units, corr); ``corr`` is null where a value doesn't vary over the common units, or they are fewer than two.
    """
    vals = values or factor_values(df, factor_col, CORRELATED_VALUES)
    spark = df.sparkSession
    place = {v: i for i, v in enumerate(vals)}
    cells = (df.filter(F.col(outcome_col).isNotNull() & F.col(factor_col).isNotNull()).groupBy(*unit_cols, factor_col).agg(F.avg(_d(outcome_col)).alias("_p")))
    units = (cells.filter(F.col("_p").isNotNull()).groupBy(*unit_cols)
             .agg(F.collect_list(factor_col).alias("_vals"), F.collect_list("_p").alias("_means")).select("_vals", "_means"))

    def moments(batches):
        total = None
        for pdf in batches:
            for lo in range(0, len(pdf), 500):
                x = np.zeros((min(500, len(pdf) - lo), len(vals)))
                has = np.zeros_like(x)
                for row, (names, means) in enumerate(zip(pdf["_vals"][lo:lo + 500], pdf["_means"][lo:lo + 500])):
                    for name, mean in zip(names, means):
                        if name in place:
                            x[row, place[name]], has[row, place[name]] = mean - 0.5, 1.0  # centred: proportions
                part = np.stack([has.T @ has, x.T @ has, has.T @ x, (x * x).T @ has, has.T @ (x * x), x.T @ x])
                total = part if total is None else total + part
        if total is not None:
            a, b = np.nonzero(np.triu(total[0], 1))
            for lo in range(0, len(a), 100_000):
                i, j = a[lo:lo + 100_000], b[lo:lo + 100_000]
                yield pd.DataFrame({"a": i, "b": j, **{c: m[i, j] for c, m in zip(("n", "x", "y", "xx", "yy", "xy"), total)}})

    sums = (units.mapInPandas(moments, "a int, b int, n double, x double, y double, xx double, yy double, xy double")
            .groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")]))
    spread = [F.expr(f"if({q}{q} - {q} * {q} / n > 1e-12D * n, {q}{q} - {q} * {q} / n, NULL)") for q in "xy"]
    corr = (F.col("xy") - F.col("x") * F.col("y") / F.col("n")) / F.sqrt(spread[0] * spread[1])
    names = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, v string")
    first = names.select(F.col("v").alias("wording_a"), F.col("i").alias("a"))
    pairs = (first.select("wording_a", "a", F.explode(F.when(F.col("a") < len(vals) - 1, F.sequence(F.col("a") + 1, F.lit(len(vals) - 1)))).alias("b"))
             .join(names.select(F.col("v").alias("wording_b"), F.col("i").alias("b")), "b"))
    return pairs.join(sums, ["a", "b"], "left").select("wording_a", "wording_b", F.coalesce(F.col("n"), F.lit(0.0)).cast("long").alias("n_units"),
                                                       F.when(corr.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), corr))).alias("corr"))


def token_comparison(df: DataFrame, stratum_col: str = "scenario_id", arm_col: str = "path_type",
                     tokens_col: str = "total_tokens",
                     arms: tuple[str, ...] = ("sequential", "length_matched")) -> DataFrame:
    """N, mean and sd of tokens per stratum for the compared arms."""
    return (df.filter(F.col(arm_col).isin(*arms)).groupBy(stratum_col, arm_col)
            .agg(F.count(tokens_col).alias("n"), F.avg(_d(tokens_col)).alias("mean_tokens"),
                 F.stddev_samp(_d(tokens_col)).alias("std_tokens")))


def running_counts(values: DataFrame, by: list[str], col: str, count_col: str = "_c") -> DataFrame:
    """Distinct values with counts, plus ``_cum`` (rows of the group up to the value) and ``_n`` (all of them); nulls count nothing.

    Values are range-partitioned by (group, value), so a group of many distinct values
    is spread over tasks; the counts of the partitions before, one row for each group and
    partition, shift the running counts within a partition.  Range bounds are sampled,
    so the partitioned values are written once and both passes read them.
    """
    c = F.when(F.col(col).isNotNull(), F.col(count_col)).otherwise(F.lit(0))
    ranged = cut_lineage(values.repartitionByRange(*by, col).withColumn("_part", F.spark_partition_id()), "ranged_values")
    sizes = ranged.groupBy(*by, "_part").agg(F.sum(c).alias("_s"))
    parts = Window.partitionBy(*by)  # over partitions, not values
    sizes = (sizes.withColumn("_n", F.sum("_s").over(parts))
             .withColumn("_before", F.sum("_s").over(parts.orderBy("_part")) - F.col("_s")).drop("_s"))
    within = Window.partitionBy(*by, "_part").orderBy(col).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in [*by, "_part"]]
    local = ranged.withColumn("_cum", F.sum(c).over(within))
    joined = local.alias("r").join(sizes.alias("s"), same)
    return joined.select(*(F.col(f"r.{k}") for k in values.columns), "_n", (F.col("_before") + F.col("_cum")).alias("_cum"))


def quantile_of(col: str, q: float) -> Column:
    """Over ``running_counts``: the smallest value whose share of rows reaches ``q`` (combined in the map tasks: one value a group and partition)."""
    return F.min(F.when(F.col(col).isNotNull() & (F.col("_cum") >= F.lit(q) * F.col("_n")), F.col(col)))


def token_distribution(df: DataFrame, arm_col: str = "path_type", tokens_col: str = "total_tokens",
                       quantiles: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Spread of tokens per arm, with exact quantiles.

    Rows are collapsed to distinct values with counts (combined map-side), and
    ``running_counts`` gives the smallest observed value whose CDF reaches q; a hot
    arm's values are spread over all tasks.
    """
    values = df.groupBy(arm_col, tokens_col).agg(F.count(F.lit(1)).alias("_c"))
    return running_counts(values, [arm_col], tokens_col).groupBy(arm_col).agg(
        F.max("_n").alias("n"), F.min(tokens_col).alias("min_tokens"), F.max(tokens_col).alias("max_tokens"),
        *[quantile_of(tokens_col, q).alias(f"q{int(round(q * 100)):02d}") for q in quantiles])


def pivot_means(df: DataFrame, row_col: str = "path_type", col_col: str = "terminal_wording_id",
                outcome_col: str = "verdict", values: list[str] | None = None) -> DataFrame:
    """Means pivoted to one column per ``col_col`` value (explicit values)."""
    vals = values or factor_values(df, col_col)
    return df.groupBy(row_col).pivot(col_col, vals).agg(F.avg(_d(outcome_col)))


def first_per_group(df: DataFrame, key: str = "scenario_id", col: str = "independence_class") -> DataFrame:
    """The (functionally dependent) attribute per key, order-free via ``min``."""
    return df.groupBy(key).agg(F.min(col).alias(col))


def effect_summary(df: DataFrame, group_col: str = "independence_class", effect_col: str = "effect") -> DataFrame:
    """Mean, sample sd, min, max and count of per-stratum effects by group."""
    e = _d(effect_col)
    return df.groupBy(group_col).agg(F.avg(e).alias("mean"), F.stddev_samp(e).alias("std"),
                                     F.min(e).alias("min"), F.max(e).alias("max"),
                                     F.count(effect_col).alias("count"))


def global_rank(df: DataFrame, col: str, rank_col: str = "rank", partitions: int | None = None) -> DataFrame:
    """SQL ``rank()`` over the whole table, ascending, nulls last, without a one-task window.

    Rows are first collapsed to distinct values with counts (partial
    aggregation absorbs hot values), distinct values are range-partitioned,
    each partition ranks its own slice, and partition offsets (one number per
    partition, collected) shift the local ranks.  A join on the value brings
    the rank back to every row (AQE splits a hot value's side).  Range bounds are
    sampled, so the partitioned values are written once and both passes read
    them; the input is written once too.  Rows with a null value share the rank
    after the last value and take no part in the join.
    """
    df = cut_lineage(df, "ranked")
    spark = df.sparkSession
    n_part = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    vals = (df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("_c"))
            .repartitionByRange(n_part, col).withColumn("_p", F.spark_partition_id()))
    vals = cut_lineage(vals, "ranked_values")
    w = Window.partitionBy("_p").orderBy(col).rowsBetween(Window.unboundedPreceding, -1)
    local = vals.withColumn("_before", F.coalesce(F.sum("_c").over(w), F.lit(0)))
    sizes = {r["_p"]: r["s"] for r in vals.groupBy("_p").agg(F.sum("_c").alias("s")).collect()}
    offsets, run = {}, 0
    for p in sorted(sizes):
        offsets[p] = run
        run += sizes[p]
    off_map = F.create_map(*[x for p, o in offsets.items() for x in (F.lit(p), F.lit(o))]) if offsets else None
    off = F.coalesce(F.element_at(off_map, F.col("_p")), F.lit(0)) if off_map is not None else F.lit(0)
    ranks = local.select(col, (off + F.col("_before") + 1).cast("long").alias(rank_col))
    ranked = df.filter(F.col(col).isNotNull()).join(ranks, col)
    return ranked.unionByName(df.filter(F.col(col).isNull()).withColumn(rank_col, F.lit(run + 1).cast("long")))


def global_positions(df: DataFrame, order: list[str | Column], position_col: str = "position") -> tuple[DataFrame, int]:
    """(rows numbered from 1 in the order of ``order``, columns or expressions, their number), without a one-task window.

    Rows are range-partitioned, sorted and numbered within their range, and written once,
    since range bounds are sampled; the ranges before shift the numbers.  Expressions are not
    written.  Rows that agree in all of ``order`` are numbered in an arbitrary order.
    """
    return _numbered(df.repartitionByRange(*order).sortWithinPartitions(*order), position_col)


def _numbered(sorted_ranges: DataFrame, position_col: str) -> tuple[DataFrame, int]:
    within = (1 << 33) - 1  # of ``monotonically_increasing_id``: the row within its partition
    ranged = cut_lineage(sorted_ranges.withColumn("_at", F.monotonically_increasing_id()), "positions")
    part = F.shiftright("_at", 33).cast("int")
    sizes = {r["p"]: r["n"] for r in ranged.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a range
    before, run = [], 0
    for p in range(max(sizes, default=0) + 1):
        before.append(run)
        run += sizes.get(p, 0)
    offset = F.element_at(F.array(*map(F.lit, before)), part + 1)
    at = F.col("_at").bitwiseAND(F.lit(within)) + 1
    return ranged.withColumn(position_col, (offset + at).cast("long")).drop("_at"), run


def hash_positions(df: DataFrame, digest: Column, order: list[str | Column], position_col: str = "position") -> tuple[DataFrame, int]:
    """``global_positions`` in the order of a cryptographic ``digest`` (hex, never null) and then of ``order``, without a sample of the rows.

    Such digests are spread evenly, so equal ranges of their first 28 bits are the partitions; rows of one digest meet in one.
    Neither the digest nor ``lead``, by which most rows are told apart, is shuffled.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lead = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
    dealt = df.repartitionById(partitions, F.shiftright(F.shiftright(lead, 32) * partitions, 28).cast("int"))
    return _numbered(dealt.sortWithinPartitions(lead, digest, *order), position_col)


def distinct_counts(df: DataFrame, by: str, col: str, name: str) -> DataFrame:
    """(``by``, ``name``): exact number of distinct non-null values of ``col`` by group, of which only 64-bit hashes are shuffled.

    A hash that one row has stands for one value; values whose hash several rows
    have (repeats, or a collision) are compared themselves.
    """
    hashed = df.filter(F.col(col).isNotNull()).withColumn("_h", F.xxhash64(col))
    met = hashed.select(by, "_h").repartition(by, "_h").groupBy(by, "_h").agg(F.count(F.lit(1)).alias("_c"))
    shared = F.sum((F.col("_c") > 1).cast("long"))
    lone = cut_lineage(met.groupBy(by).agg(F.sum((F.col("_c") == 1).cast("long")).alias("_n"), shared.alias("_s")), "distinct")
    out = lone.select(by, "_n")
    if not lone.filter("_s > 0").isEmpty():
        again = cut_lineage(met.filter("_c > 1").select(F.col(by).alias("_by"), F.col("_h").alias("_hash")), "repeated")
        same = F.col(by).eqNullSafe(F.col("_by")) & (F.col("_h") == F.col("_hash"))
        out = out.unionByName(hashed.join(again.hint("merge"), same, "left_semi").select(by, col).distinct().groupBy(by).agg(F.count(F.lit(1)).alias("_n")))
    return out.groupBy(by).agg(F.sum("_n").alias(name))


def equal_tiles(position: Column, total: int, tiles: int) -> Column:
    """``ntile(tiles)`` of a position among ``total`` rows, as arithmetic: tiles from 1, sizes at most one apart, larger ones first."""
    small, larger = divmod(total, tiles)
    head = larger * (small + 1)
    at = position - 1
    return (F.when(at < head, F.floor(at / (small + 1)) + 1)
            .otherwise(F.floor((at - head) / max(small, 1)) + larger + 1).cast("int"))


def outcome_distribution(df: DataFrame, unit_cols: list[str], outcome_col: str = "verdict",
                         status_col: str = "status") -> DataFrame:
    """Counts of yes / no / refused per experimental unit."""
    o = F.col(outcome_col)
    return df.groupBy(*unit_cols).agg(
        F.sum(F.when(o == 1, 1).otherwise(0)).cast("long").alias("n_yes"),
        F.sum(F.when(o == 0, 1).otherwise(0)).cast("long").alias("n_no"),
        F.sum(F.when(F.col(status_col) == "refused", 1).otherwise(0)).cast("long").alias("n_refused"),
        F.count(F.lit(1)).alias("n"))
