"""Aggregates and the distributed rank against pandas."""
import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from pathweave.operators import aggregates as G
from pathweave.operators import inference as S


def test_global_rank_with_ties_and_a_hot_value(spark):
    rng = random.Random(3)
    vals = [rng.randint(0, 50) for _ in range(3000)] + [17] * 2000 + [None] * 5
    pdf = pd.DataFrame({"k": range(len(vals)), "v": vals})
    df = spark.createDataFrame(pdf.astype({"v": "float64"}))
    got = {r.k: r.rank for r in G.global_rank(df, "v", partitions=7).collect()}
    want = pdf["v"].rank(method="min", na_option="bottom")  # SQL rank(): nulls share the last rank
    assert got == dict(zip(pdf["k"], want.astype(int)))


def test_condition_summary_lists_empty_levels(spark):
    df = spark.createDataFrame([("direct", 1), ("direct", 0), ("sequential", 1)], "path_type string, verdict int")
    rows = {r.path_type: r for r in G.condition_summary(df).collect()}
    assert set(rows) == {"direct", "sequential", "skipped", "alt_grouping", "length_matched"}
    assert rows["skipped"].n == 0 and rows["skipped"].p_yes is None
    assert rows["sequential"].n == 1 and rows["sequential"].sd is None  # sample sd of one value
    assert abs(rows["direct"].p_yes - 0.5) < 1e-12


def test_two_proportion_degenerate_and_missing_arm(spark):
    df = spark.createDataFrame(
        [("a", "direct", 1), ("a", "length_matched", 1), ("b", "direct", 1), ("b", "direct", 0),
         ("b", "length_matched", 0), ("b", "length_matched", 0), ("c", "direct", 1)],
        "scenario_id string, path_type string, verdict int")
    rows = {r.scenario_id: r for r in S.two_proportion_tests(df, ["scenario_id"]).collect()}
    assert set(rows) == {"a", "b"}
    assert rows["a"].z_stat is None and rows["a"].p_value is None and rows["a"].significant_005 is None
    assert rows["b"].z_stat > 0 and 0 < rows["b"].p_value < 1


def test_cross_wording_correlation(spark):
    rows = []
    for s in range(8):
        for w, shift in (("W1", 0), ("W2", 1), ("W3", 2)):
            for y in range(s % 4 + shift % 2 + 1):
                rows.append((f"s{s}", "direct", w, 1))
            rows.append((f"s{s}", "direct", w, 0))
    df = spark.createDataFrame(rows, "scenario_id string, path_type string, terminal_wording_id string, verdict int")
    got = {(r.wording_a, r.wording_b): r.corr for r in
           G.cross_factor_correlation(df, ["scenario_id", "path_type"]).collect()}
    pdf = pd.DataFrame(rows, columns=["s", "p", "w", "v"]).groupby(["s", "p", "w"])["v"].mean().unstack()
    for (a, b), c in got.items():
        assert abs(c - pdf[a].corr(pdf[b])) < 1e-9


def test_global_rank_of_many_distinct_values(spark):
    """1.5 million distinct values and a hot one: ranks are exact whatever bounds the range partitioning sampled."""
    from pyspark.sql import functions as F

    from pathweave.operators import aggregates as G

    n = 1_500_000
    df = spark.range(n).select((F.col("id") * 7919 % n).cast("double").alias("v"))
    df = df.union(spark.range(50_000).select(F.lit(10.0).alias("v")))
    got = G.global_rank(df, "v", partitions=12)
    want = F.when(F.col("v") <= 10, F.col("v") + 1).otherwise(F.col("v") + 50_001)
    assert got.filter(F.col("rank") != want).count() == 0 and got.count() == n + 50_000


def test_quantiles_are_exact_beyond_a_sketch(spark):
    """4 million distinct values in one arm, and an arm of nulls."""
    from pyspark.sql import functions as F

    n = 4_000_000
    df = spark.range(n).select(F.lit("direct").alias("path_type"), (F.col("id") * 7919 % n).alias("total_tokens"))
    df = df.union(spark.range(3).select(F.lit("skipped"), F.lit(None).cast("long")))
    got = {r.path_type: tuple(r)[1:] for r in G.token_distribution(df).collect()}
    assert got == {"direct": (n, 0, n - 1, n // 4 - 1, n // 2 - 1, 3 * n // 4 - 1), "skipped": (0, None, None, None, None, None)}


def test_global_rank_puts_nulls_last(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", None), ("d", 2.0), ("e", None)], "k string, v double")
    got = {r.k: r.rank for r in G.global_rank(df, "v").collect()}
    assert got == {"a": 1, "b": 2, "d": 2, "c": 4, "e": 4}
    only = spark.createDataFrame([("a", None)], "k string, v double")
    assert [r.rank for r in G.global_rank(only, "v").collect()] == [1]


def test_quantiles_of_a_hot_arm_are_exact_and_spread(spark):
    """One arm with 2 million distinct values, small ones beside it, a null arm and null values."""
    n = 2_000_000
    hot = spark.range(n).select(F.lit("hot").alias("path_type"), ((F.col("id") * 7_919) % n).alias("total_tokens"))
    small = spark.createDataFrame([("a", 5), ("a", 5), ("a", 9), ("b", None), (None, 3), (None, 1), ("hot", None)], "path_type string, total_tokens long")
    df = hot.unionByName(small)
    got = {r.path_type: r for r in G.token_distribution(df).collect()}
    assert (got["hot"].n, got["hot"].q25, got["hot"].q50, got["hot"].q75) == (n, n // 4 - 1, n // 2 - 1, 3 * n // 4 - 1)
    assert (got["a"].n, got["a"].q25, got["a"].q50, got["a"].q75) == (3, 5, 5, 9)
    assert (got["b"].n, got["b"].q50) == (0, None) and (got[None].n, got[None].q50) == (2, 1)
    values = df.groupBy("path_type", "total_tokens").agg(F.count(F.lit(1)).alias("_c"))
    counted = G.running_counts(values, ["path_type"], "total_tokens")
    files = counted.inputFiles()  # one a range
    per_file = [spark.read.parquet(f).count() for f in files]
    assert len(per_file) >= 8 and max(per_file) < 0.3 * n


def test_positions_and_tiles_equal_sql(spark):
    rng = random.Random(6)
    rows = [(rng.randint(0, 200), f"k{i}") for i in range(3_001)]
    df = spark.createDataFrame(rows, "a int, b string").repartition(7)
    placed, total = G.global_positions(df, ["a", "b"])
    got = [(r.a, r.b) for r in placed.orderBy("position").collect()]
    assert total == 3_001 and got == sorted(rows)
    assert [r.position for r in placed.orderBy("position").select("position").collect()] == list(range(1, 3_002))
    for n, tiles in ((3_001, 8), (5, 8), (8, 8), (0, 3), (10, 3)):
        spark.range(1, n + 1).createOrReplaceTempView("p")
        want = [r.t for r in spark.sql(f"SELECT ntile({tiles}) OVER (ORDER BY id) AS t FROM p ORDER BY id").collect()]
        got = [r.t for r in spark.table("p").select("id", G.equal_tiles(F.col("id"), n, tiles).alias("t")).orderBy("id").collect()]
        assert got == want
    empty, none = G.global_positions(df.limit(0), ["a"])
    assert none == 0 and empty.count() == 0


def test_cross_factor_correlation_of_many_values(spark):
    """2,000 values with cells missing: counts and correlations as numpy has them."""
    n_units, n_values = 12, 2000
    rows = spark.range(n_units * n_values).select(
        F.expr(f"id div {n_values}").alias("unit"), F.expr(f"concat('v', lpad(cast(id % {n_values} AS string), 4, '0'))").alias("value"),
        F.expr("pmod(xxhash64(id), 1000) / 1000").alias("y"), F.expr("pmod(xxhash64(id, 1), 5) > 0").alias("kept")).where("kept")
    got = G.cross_factor_correlation(rows, ["unit"], "value", "y")
    assert got.count() == n_values * (n_values - 1) // 2
    by_cell = {(r.unit, r.value): r.y for r in rows.where("value < 'v0008'").collect()}
    for r in got.where("wording_b < 'v0008'").collect():
        both = [(by_cell[u, r.wording_a], by_cell[u, r.wording_b]) for u in range(n_units) if (u, r.wording_a) in by_cell and (u, r.wording_b) in by_cell]
        assert r.n_units == len(both)
        assert abs(r["corr"] - np.corrcoef(np.array(both).T)[0, 1]) < 1e-9
