"""Plan guards: no pair-producing joins, scans read only the columns they need."""
import os

import pytest

from pathweave.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")

# Joins of one-row aggregates (row concatenation, not pair expansion).
ONE_ROW_CONCAT = {"a8_filter_audit", "io3_line_coverage", "m10_dispatch_count", "r6_conditional_effects", "r7_variance_components"}
SKIP = {n for n in QUERIES if n.startswith(("r", "st", "io7"))} - ONE_ROW_CONCAT


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SKIP))
def test_no_pair_joins(spark, name):
    plan = _plan(QUERIES[name](spark, SF))
    if name in ONE_ROW_CONCAT:
        return
    assert "CartesianProduct" not in plan, name
    assert "BroadcastNestedLoopJoin" not in plan, name


def test_scans_are_pruned(spark):
    df = QUERIES["g1_condition_summary"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "o_totalprice" not in plan  # the summary never reads prices
    assert "c_acctbal" not in plan


def _scans(df, table):
    return _plan(df).count(f"/{table}.parquet")


def _exchanges(df):
    return sum(line.lstrip(" :+-").startswith(("Exchange", "BroadcastExchange")) for line in _plan(df).splitlines())


def test_the_gather_reads_its_lines_once(spark):
    from pathweave.operators import paths as P
    from pathweave.sources import views as V

    comps = V.components_v(spark, SF)
    graphs = P.gather_graphs(comps, keys=V.COMPONENT_KEYS)
    assert _scans(graphs, "lineitem") == 1 and _scans(graphs, "part") == 1 and _exchanges(graphs) <= 3
    plain = spark.createDataFrame([("s", "C1", "t", [])], "scenario_id string, cid string, text string, deps array<string>")
    plan = _plan(P.gather_graphs(plain))
    assert plan.count("Exchange hashpartitioning") == 1 and "WindowGroupLimit" in plan  # rows beyond the limit stay in the map task


@pytest.mark.parametrize("name", ["p1_all_orderings", "p8_sequential_paths", "p15_path_census", "m1_build_manifest", "m9_resolve_manifest"])
def test_designs_read_a_table_written_once(spark, name):
    assert _scans(QUERIES[name](spark, SF), "lineitem") == 0


def test_scenarios_are_counted_without_nesting(spark):
    plan = _plan(QUERIES["io3_scenarios_table"](spark, SF))
    assert "map_from_entries" not in plan and "lineitem.parquet" not in plan


def test_the_report_scans_its_tables_twice_at_most(spark, monkeypatch):
    from pathweave.operators import quality as Q
    from pathweave.plans import q_quality

    scans, cut = {"lineitem": 0, "orders": 0}, Q.cut_lineage

    def counted(df, name="lineage"):
        for table in scans:
            scans[table] += _scans(df, table)
        return cut(df, name)

    monkeypatch.setattr(Q, "cut_lineage", counted)
    monkeypatch.setattr(q_quality, "cut_lineage", counted)
    report = QUERIES["dq12_violation_report"](spark, SF)
    for table in scans:
        scans[table] += _scans(report, table)
    assert scans["lineitem"] <= 2 and scans["orders"] <= 2, scans
