"""Set-based data-quality rules (DQ1-DQ18).

Each rule returns one row per violation as ``(rule, scenario_id, detail)``;
``violation_report`` unions them all, so nothing short-circuits.  Rules are
joins and aggregations: a hot key is pre-aggregated before any shuffle and no
rule gathers an unbounded group.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.text import py_strip
from ..session import cut_lineage
from .paths import gather_graphs

INDEPENDENCE_CLASSES = ["commutative", "partial", "entangled"]
REQUIRED_TYPES = ["utilitarian_tradeoff", "competing_obligations"]
MIN_SCENARIOS = 5
MIN_COMPONENTS, MAX_COMPONENTS = 3, 5

TASK_ROWS = 1 << 19  # keys that a task compares at a time
SLOTS = 4096  # into which keys are hashed to find those that are too many

REPORT_SCHEMA = "rule string, scenario_id string, detail string"


def _v(df: DataFrame, rule: str, key: Column | str, detail: Column) -> DataFrame:
    k = F.col(key) if isinstance(key, str) else key
    return df.select(F.lit(rule).alias("rule"), k.cast("string").alias("scenario_id"),
                     detail.cast("string").alias("detail"))


def enum_membership(docs: DataFrame, col: str = "independence_class",
                    allowed: list[str] | None = None, key: str = "scenario_id") -> DataFrame:
    """DQ1: value outside the allowed set (NULL included)."""
    ok = allowed or INDEPENDENCE_CLASSES
    bad = docs.filter(F.col(col).isNull() | ~F.col(col).isin(*ok))
    return _v(bad, "DQ1_enum", key, F.concat(F.lit(f"{col}="), F.coalesce(F.col(col), F.lit("NULL"))))


def setup_present(docs: DataFrame, col: str = "setup", key: str = "scenario_id") -> DataFrame:
    """DQ2: setup NULL or blank after stripping."""
    bad = docs.filter(F.col(col).isNull() | (py_strip(F.col(col)) == ""))
    return _v(bad, "DQ2_setup_blank", key, F.lit("setup must be non-empty"))


def wordings_present(docs: DataFrame, wordings: DataFrame, key: str = "scenario_id") -> DataFrame:
    """DQ3: a scenario with no terminal wording."""
    bad = docs.join(wordings.select(key), key, "left_anti")
    return _v(bad, "DQ3_no_wording", key, F.lit("at least one terminal wording required"))


def edges(components: DataFrame, key: str = "scenario_id") -> DataFrame:
    """IO4 edge list: (scenario, component, dependency)."""
    return components.select(key, "cid", F.explode("deps").alias("dep"))


def dangling_dependencies(components: DataFrame, key: str = "scenario_id") -> DataFrame:
    """DQ4: a dependency that names no component of the same scenario."""
    ids = components.select(key, F.col("cid").alias("dep")).distinct()
    bad = edges(components, key).join(ids, [key, "dep"], "left_anti")
    return _v(bad, "DQ4_dangling_dep", key, F.concat(F.col("cid"), F.lit(" -> "), F.col("dep")))


def _counted(df: DataFrame, name: str, **also: Column) -> tuple[DataFrame, dict]:
    """``df`` written as a table, and its number of rows (and what ``also`` asks), observed while it is written."""
    seen = Observation()
    return cut_lineage(df.observe(seen, F.count(F.lit(1)).alias("rows"), *(c.alias(k) for k, c in also.items())), name), seen.get


def _stuck_nodes(nodes: DataFrame, count: int, most: int, key: str) -> DataFrame:
    """Nodes (key, cid) on or behind a cycle, for scenarios of any size, in rounds logarithmic in ``most``, the size of the largest.

    A node is stuck if a walk along dependencies can go on from it for as many steps as
    the scenario has nodes.  The table of (node, node exactly s steps on) is raised to
    longer steps until they are as many; on a graph without cycles it runs empty on
    the way.  A narrow table, of few rows a node, goes to 6 s in a round, a wide one to 2 s.
    """
    ids = nodes.select(key, F.col("cid").alias("dep"))
    walks, seen = _counted(nodes.select(key, "cid", F.explode("deps").alias("dep")).join(ids, [key, "dep"], "left_semi")
                           .select(key, F.col("cid").alias("a"), F.col("dep").alias("b")), "walks")
    steps = 1
    while steps < most and seen["rows"]:
        on = walks.select(key, F.col("a").alias("b"), F.col("b").alias("c"))
        hops = 5 if seen["rows"] <= 2 * count else 1
        farther = walks
        for _ in range(hops):
            farther = farther.join(on, [key, "b"]).select(key, "a", F.col("c").alias("b"))
        walks, seen = _counted(farther.distinct(), "walks")
        steps *= hops + 1
    return walks.select(key, F.col("a").alias("cid")).distinct()


def cyclic_scenarios(components: DataFrame, key: str = "scenario_id", gather: int = 32) -> DataFrame:
    """DQ5: dependency cycles (self-loops included), by Kahn peeling inside the row.

    Repeated ids in one scenario are merged first (their dependencies united).

    Each round places every node whose in-scenario dependencies are placed;
    after n rounds the unplaced nodes lie on or behind a cycle.  Undefined
    dependencies are ignored here (DQ4 reports them).  Scenarios of more than
    ``gather`` ids are not gathered into a row but walked as tables; the stuck ids,
    which are the finding itself, are listed alike.
    """
    merged = components.groupBy(key, "cid").agg(
        F.array_distinct(F.flatten(F.collect_set(F.coalesce("deps", F.array().cast("array<string>"))))).alias("deps"))
    g = gather_graphs(merged.withColumn("text", F.lit("")), key, max_components=gather)
    ids = F.transform("nodes", lambda x: x["cid"])
    nodes = F.transform("nodes", lambda x: F.struct(
        x["cid"].alias("cid"), F.filter(x["deps"], lambda d: F.array_contains(ids, d)).alias("deps")))
    placed = F.aggregate(
        F.sequence(F.lit(1), F.size("nodes")), F.array().cast("array<string>"),
        lambda p, _i: F.array_union(p, F.transform(
            F.filter(nodes, lambda x: F.forall(x["deps"], lambda d: F.array_contains(p, d))),
            lambda x: x["cid"])))
    left = F.array_sort(F.array_except(ids, placed))
    bad = g.select("scenario_id", left.alias("stuck")).filter(F.size("stuck") > 0)
    out = _v(bad, "DQ5_cycle", "scenario_id", F.concat(F.lit("cycle through "), F.array_join("stuck", ",")))
    sizes = merged.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > gather)
    large, seen = _counted(sizes, "large", most=F.max("_n"), nodes=F.sum("_n"))
    if not seen["rows"]:
        return out
    nodes = cut_lineage(merged.join(large, key, "left_semi"), "large_nodes")
    stuck = (_stuck_nodes(nodes, seen["nodes"], seen["most"], key).groupBy(key)
             .agg(F.array_sort(F.collect_list("cid")).alias("stuck")))
    return out.unionByName(_v(stuck, "DQ5_cycle", key, F.concat(F.lit("cycle through "), F.array_join("stuck", ","))))


def component_count(docs: DataFrame, components: DataFrame, key: str = "scenario_id",
                    lo: int = MIN_COMPONENTS, hi: int = MAX_COMPONENTS) -> DataFrame:
    """DQ6: number of distinct component ids outside [lo, hi] (documents without any count as 0)."""
    sizes = components.select(key, "cid").distinct().groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    j = docs.select(key).join(sizes, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    bad = j.filter(~F.col("n").between(lo, hi))
    return _v(bad, "DQ6_component_count", key, F.concat(F.lit("components="), F.col("n").cast("string")))


def duplicate_ids(docs: DataFrame, id_col: str = "doc_id", file_col: str = "scenario_id") -> DataFrame:
    """DQ7: every document after the first (by file name) that declares an id.

    The first file per id comes from a partial aggregation (hot ids collapse
    map-side) and is joined back; no window over an id's rows.
    """
    first = docs.groupBy(id_col).agg(F.min(file_col).alias("_first"), F.count(F.lit(1)).alias("_n"))
    dup = docs.join(first.filter(F.col("_n") > 1), id_col).filter(F.col(file_col) != F.col("_first"))
    return _v(dup, "DQ7_duplicate_id", file_col, F.concat(F.lit("duplicate id "), F.col(id_col)))


def corpus_rules(docs: DataFrame, id_col: str = "scenario_id", type_col: str = "type",
                 class_col: str = "independence_class", min_scenarios: int = MIN_SCENARIOS,
                 required_types: list[str] | None = None) -> DataFrame:
    """DQ9 + DQ10 + DQ11: corpus size, required types, class diversity (one small aggregate)."""
    req = required_types or REQUIRED_TYPES
    present = F.collect_set(F.when(F.col(type_col).isin(*req), F.col(type_col)))
    g = docs.agg(F.countDistinct(id_col).alias("n"), present.alias("types"),
                 F.countDistinct(class_col).alias("n_classes"))
    missing = F.array_sort(F.array_except(F.array(*[F.lit(t) for t in req]), F.col("types")))
    rows = F.array(
        F.struct(F.lit("DQ9_corpus_size").alias("rule"),
                 F.when(F.col("n") < min_scenarios,
                        F.concat(F.lit(f"at least {min_scenarios} scenarios; found "), F.col("n").cast("string")))
                 .alias("detail")),
        F.struct(F.lit("DQ10_required_types").alias("rule"),
                 F.when(F.size(missing) > 0, F.concat(F.lit("missing types: "), F.array_join(missing, ",")))
                 .alias("detail")),
        F.struct(F.lit("DQ11_class_diversity").alias("rule"),
                 F.when(F.col("n_classes") < 2,
                        F.concat(F.lit("distinct classes: "), F.col("n_classes").cast("string"))).alias("detail")),
    )
    return (g.select(F.inline(rows)).filter(F.col("detail").isNotNull())
            .select("rule", F.lit(None).cast("string").alias("scenario_id"), "detail"))


def malformed_documents(loaded: DataFrame, key: str = "file") -> DataFrame:
    """DQ8: documents the loader could not turn into a scenario (error column set)."""
    bad = loaded.filter(F.col("error").isNotNull())
    return _v(bad, "DQ8_malformed", key, F.col("error"))


def _row_findings(allowed: list[str], lo: int, hi: int) -> Column:
    """Findings of DQ1-DQ6 and DQ8 on one row: header, its components (``nodes``) and its number of wordings (``words``)."""
    def found(rule: str, broken: Column, detail: Column) -> Column:
        return F.when(broken, F.array(F.struct(F.lit(rule).alias("rule"), F.col("key").alias("scenario_id"), detail.alias("detail"))))

    nodes = F.coalesce("nodes", F.array().cast("array<struct<cid:string,deps:array<string>>>"))
    ids = F.array_distinct(F.transform(nodes, lambda x: x["cid"]))
    missing = F.flatten(F.transform(nodes, lambda x: F.transform(
        F.filter(x["deps"], lambda d: ~F.array_contains(ids, d)), lambda d: F.struct(
            F.lit("DQ4_dangling_dep").alias("rule"), F.col("key").alias("scenario_id"), F.concat(x["cid"], F.lit(" -> "), d).alias("detail")))))
    # An id is placed once all its rows have their dependencies placed, those that name no component aside.
    placed = F.aggregate(ids, F.array().cast("array<string>"), lambda p, _: F.filter(ids, lambda c: F.forall(
        nodes, lambda y: (y["cid"] != c) | F.forall(y["deps"], lambda d: ~F.array_contains(ids, d) | F.array_contains(p, d)))))
    stuck = F.array_sort(F.array_except(ids, placed))
    header, n = F.col("known"), F.size(ids)
    file = F.concat(F.col("key"), F.lit(".yaml"))
    bad = F.when(F.col("nodes").isNull(), "'considerations' must be a mapping").when(F.col("words").isNull(), "'terminal_wordings' must be a mapping")
    malformed = F.when(header & bad.isNotNull(), F.array(F.struct(F.lit("DQ8_malformed").alias("rule"), file.alias("scenario_id"), bad.alias("detail"))))
    class_ok = F.coalesce(F.col("class").isin(*allowed), F.lit(False))
    few = ~F.col("large")
    none = F.array().cast("array<struct<rule:string,scenario_id:string,detail:string>>")
    return F.concat(*[F.coalesce(x, none) for x in (
        found("DQ1_enum", header & ~class_ok, F.concat(F.lit("independence_class="), F.coalesce("class", F.lit("NULL")))),
        found("DQ2_setup_blank", header & F.coalesce(py_strip(F.col("setup")) == "", F.lit(True)), F.lit("setup must be non-empty")),
        found("DQ3_no_wording", header & F.col("words").isNull(), F.lit("at least one terminal wording required")),
        F.when(few, missing),
        found("DQ5_cycle", few & (F.size(stuck) > 0), F.concat(F.lit("cycle through "), F.array_join(stuck, ","))),
        found("DQ6_component_count", header & few & ~n.between(lo, hi), F.concat(F.lit("components="), n.cast("string"))),
        malformed)])


def document_findings(docs: DataFrame, components: DataFrame, wordings: DataFrame, key: str = "scenario_id", id_col: str = "doc_id",
                      gather: int = 32, malformed: bool = True, allowed: list[str] | None = None,
                      lo: int = MIN_COMPONENTS, hi: int = MAX_COMPONENTS) -> DataFrame:
    """DQ1-DQ8: every finding about a document, from one pass over headers, components and wordings.

    Each document's header meets its components (at most ``gather`` rows of them, see
    ``paths.gather_graphs``) and its number of wordings in one row; that row's findings
    are an array, which is inlined.  Joins and aggregates of their own are left to
    documents of more rows (DQ4-DQ6) and to DQ7.  ``key`` names one document.
    """
    docs = cut_lineage(docs.select(F.col(key).alias("key"), F.col(id_col).alias("id"), F.col("independence_class").alias("class"), "setup"), "headers")
    few = F.row_number().over(Window.partitionBy(key).orderBy("cid")) <= gather + 1
    deps = F.coalesce("deps", F.array().cast("array<string>"))
    nodes = (components.select(F.col(key), "cid", deps.alias("deps"), few.alias("few")).filter("few")
             .groupBy(F.col(key).alias("key")).agg(F.collect_list(F.struct("cid", "deps")).alias("nodes")))
    words = wordings.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("words"))
    base = (docs.withColumn("known", F.lit(True)).join(nodes, "key", "full").join(words, "key", "left")
            .withColumn("known", F.coalesce("known", F.lit(False))).withColumn("large", F.coalesce(F.size("nodes") > gather, F.lit(False))))
    base = cut_lineage(base.select("key", "large", _row_findings(allowed or INDEPENDENCE_CLASSES, lo, hi).alias("found"), "known"), "findings")
    out = base.select(F.inline("found")).unionByName(duplicate_ids(docs, "id", "key"))
    if not malformed:
        out = out.filter(F.col("rule") != "DQ8_malformed")
    large = base.filter("large").select(F.col("key").alias(key), "known")
    if large.isEmpty():
        return out.select("rule", "scenario_id", "detail")
    rest = components.join(large.select(key), key, "left_semi")
    for part in (dangling_dependencies(rest, key), cyclic_scenarios(rest, key, gather),
                 component_count(large.filter("known").select(key), rest, key, lo, hi)):
        out = out.unionByName(part)
    return out.select("rule", "scenario_id", "detail")


def violation_report(docs: DataFrame, components: DataFrame, wordings: DataFrame,
                     key: str = "scenario_id", id_col: str = "doc_id", loaded: DataFrame | None = None,
                     malformed: bool = False) -> DataFrame:
    """DQ12: every rule's violations in one table.

    DQ8 comes from a loader's error column (``loaded``), or from the flat tables themselves (``malformed``).
    """
    out = document_findings(docs, components, wordings, key, id_col, malformed=malformed).unionByName(corpus_rules(docs, key))
    return out if loaded is None else out.unionByName(malformed_documents(loaded))


def rejected_documents(findings: DataFrame) -> DataFrame:
    """One row for each document that any rule rejects: (scenario_id, rules, n_findings); such a document is not expanded.

    A malformed document is named by its file, and belongs to the document of that name.
    """
    own = findings.filter(F.col("scenario_id").isNotNull()).withColumn("scenario_id", F.regexp_replace("scenario_id", r"\.yaml$", ""))
    return own.groupBy("scenario_id").agg(F.array_join(F.array_sort(F.collect_set("rule")), ",").alias("rules"), F.count(F.lit(1)).alias("n_findings"))


# --- ledger-level rules ------------------------------------------------------

def _slot(keys: list[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(SLOTS))


def _slot_rows(df: DataFrame, keys: list[str]) -> Counter:
    """Rows of ``df`` in each slot of its keys' hashes (at most ``SLOTS`` counts, combined in the map tasks)."""
    return Counter({r["slot"]: r["n"] for r in df.groupBy(_slot(keys).alias("slot")).agg(F.count(F.lit(1)).alias("n")).collect()})


def _hot(rows: Counter, keys: list[str]) -> Column | None:
    """Does a row lie in a slot that is too much for a task, which takes a hot key?  None if there is no such slot."""
    most = max(TASK_ROWS, 4 * rows.total() // SLOTS)
    hot = [slot for slot, n in rows.items() if n > most]
    return _slot(keys).isin(hot) if hot else None


def _tasks(rows: Counter) -> int:
    return -(-rows.total() // TASK_ROWS)


def duplicate_keys(df: DataFrame, pk: list[str], table: str) -> DataFrame:
    """DQ13: primary-key values that occur more than once.

    Keys are nearly all distinct, so combining them in the map tasks saves nothing: they
    are dealt to tasks of about ``TASK_ROWS`` rows, whatever the size of the table.  Keys in a slot
    of too many rows are combined before they are shuffled.
    """
    counted = lambda rows: rows.groupBy(*pk).agg(F.count(F.lit(1)).alias("n"))
    rows = _slot_rows(df, pk)
    if rows.total() <= TASK_ROWS:
        g = counted(df)
    else:
        hot = _hot(rows, pk)
        g = counted((df if hot is None else df.filter(~hot)).repartition(_tasks(rows), *pk))
        g = g if hot is None else g.unionByName(counted(df.filter(hot)))
    return g.filter(F.col("n") > 1).select(F.lit(table).alias("table"), F.concat_ws("|", *[F.col(c).cast("string") for c in pk]).alias("key"), "n")


def orphans(child: DataFrame, parent: DataFrame, fk: str, pk: str | None = None, table: str = "") -> DataFrame:
    """DQ14: child rows whose foreign key has no parent.

    Both sides are dealt to tasks of about ``TASK_ROWS`` rows together and merged, unless the parent is small. Keys in
    a slot of too many rows are joined apart: parents combined in the map tasks, children left to AQE's skew splitting.
    """
    child, p = child.select(fk), parent.select(F.col(pk or fk).alias(fk))
    out = lambda bad: bad.select(F.lit(table).alias("table"), F.col(fk).cast("string").alias("key"))
    parents = _slot_rows(p, [fk])
    if parents.total() <= TASK_ROWS or child.schema[fk].dataType != p.schema[fk].dataType:  # other types hash to other slots
        return out(child.join(p.distinct(), fk, "left_anti"))
    rows = parents + _slot_rows(child, [fk])
    hot, n = _hot(rows, [fk]), _tasks(rows)
    few = lambda df: (df if hot is None else df.filter(~hot)).repartition(n, fk)
    bad = few(child).join(few(p).hint("merge"), fk, "left_anti")
    if hot is not None:
        bad = bad.unionByName(child.filter(hot).join(p.filter(hot).distinct(), fk, "left_anti"))
    return out(bad)


def null_counts(df: DataFrame, required: list[str], table: str) -> DataFrame:
    """DQ15: NULLs per required column, one pass, long form."""
    g = df.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in required])
    arr = F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c), F.lit(0)).alias("n_null"))
                    for c in required])
    return g.select(F.inline(arr)).select(F.lit(table).alias("table"), "column", "n_null")


def degenerate_conditions(df: DataFrame, unit_cols: list[str], outcome_col: str = "verdict") -> DataFrame:
    """DQ16: units whose outcomes are all yes or all no."""
    g = (df.filter(F.col(outcome_col).isNotNull()).groupBy(*unit_cols)
         .agg(F.count(outcome_col).alias("n"), F.avg(F.col(outcome_col).cast("double")).alias("p_yes")))
    return g.filter((F.col("p_yes") == 0) | (F.col("p_yes") == 1)).withColumn(
        "kind", F.when(F.col("p_yes") == 1, "all_yes").otherwise("all_no"))


def provider_pinning(runs: DataFrame, requested: str = "provider_requested", used: str = "provider_used") -> DataFrame:
    """DQ17: runs per (requested, used) pair with a null-safe mismatch flag and share."""
    g = runs.groupBy(requested, used).agg(F.count(F.lit(1)).alias("n"))
    total = runs.groupBy(requested).agg(F.count(F.lit(1)).alias("_t"))
    return (g.join(total, requested)
            .withColumn("matches", F.col(requested).eqNullSafe(F.col(used)))
            .withColumn("used_known", F.col(used).isNotNull())
            .withColumn("share", F.col("n") / F.col("_t")).drop("_t"))


def path_sample(paths: DataFrame, per_type: int = 3, clip: int = 80) -> DataFrame:
    """DQ18: first ``per_type`` paths per (scenario, type) by signature, turns clipped.

    The window partitions by (scenario, type), groups bounded by the number of
    orderings of a <= 5-node graph.  Turns are clipped before they are shuffled.
    """
    paths = paths.select("scenario_id", "path_type", "path_signature", F.transform("turns", lambda t: F.substring(t, 1, clip)).alias("turns"))
    w = Window.partitionBy("scenario_id", "path_type").orderBy("path_signature")
    top = paths.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= per_type)
    t = top.select("scenario_id", "path_type", "rank", "path_signature", F.posexplode_outer("turns").alias("turn_no", "turn"))
    return t.select("scenario_id", "path_type", "rank", "path_signature",
                    (F.col("turn_no") + 1).alias("turn_no"), py_strip("turn").alias("turn_head"))
