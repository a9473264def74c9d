"""Path expansion: per-scenario dependency DAG -> experiment paths.

The input is a long ``components`` table (scenario, component id, text,
dependency list).  After one aggregation that gathers each scenario's nodes
into a row (bounded: scenarios above ``max_components`` are excluded *before*
the gather by a partial count, so no unbounded group is ever collected), every
path type is a narrow, per-row expansion with array higher-order functions:
no further shuffle, no Python.

Orderings are pruned while placing (a node is only appended once all its
dependencies are placed), so the work is the number of valid orderings, never
all n! permutations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import json_escape, json_quote, path_id, py_json_escape
from ..session import cut_lineage
from ..functions.text import (FILLER_TURN_PREFIX, FIRST_TURN_PREFIX, GROUP_TURN_PREFIX,
                              NEXT_TURN_PREFIX, FillerPlan, approx_tokens, py_strip)

# Declaration order of path types (manifest order).
PATH_TYPES = ["sequential", "skipped", "alt_grouping", "direct", "length_matched"]
# Analysis factor levels: the control ``direct`` first (reference level).
PATH_LEVELS = ["direct", "sequential", "skipped", "alt_grouping", "length_matched"]

PATH_COLUMNS = ["scenario_id", "path_type", "path_signature", "perm_id", "n_turns",
                "components_used", "turns"]

_MISSING_BIT = 1 << 30  # dependency outside the scenario: never satisfiable

CARRIED = "wording_ids"  # a scenario's wordings on its graph and paths (see ``carry_wordings``)


def _sizes(components: DataFrame, scenario_col: str, id_col: str) -> DataFrame:
    # Distinct ids by two plain counts (map-side combined), not by a set per scenario.
    return (components.groupBy(scenario_col, id_col).agg(F.count(F.lit(1)).alias("_c"))
            .groupBy(scenario_col).agg(F.sum("_c").alias("_n"), F.count(F.lit(1)).alias("_d")))


def ungathered(components: DataFrame, scenario_col: str = "scenario_id", id_col: str = "cid",
               max_components: int = 5) -> DataFrame:
    """Scenarios that ``gather_graphs`` leaves out: (rule, scenario_id, detail)."""
    return (_sizes(components, scenario_col, id_col).filter(f"_n > {max_components} OR _n <> _d")
            .select(F.expr("CASE WHEN _n <> _d THEN 'repeated_id' ELSE 'too_many_components' END").alias("rule"),
                    F.col(scenario_col).alias("scenario_id"), F.concat(F.lit("components="), F.col("_n").cast("string")).alias("detail")))


def gather_graphs(components: DataFrame, scenario_col: str = "scenario_id", id_col: str = "cid",
                  text_col: str = "text", deps_col: str = "deps", max_components: int = 5, keys: list[str] | None = None) -> DataFrame:
    """One row per scenario with ``nodes``: array<struct<cid, text, deps>> sorted by id.

    Texts are stripped once here.  Scenarios with more than ``max_components``
    nodes, or with a repeated id, can't be expanded and are left out; ``ungathered``
    returns them.  Of any scenario at most ``max_components`` + 1 rows are gathered: the
    filter on ``row_number`` becomes a group limit, taken before the shuffle too, so a
    scenario of any size costs one shuffle and no more than its first rows.  ``keys`` may
    name columns that the scenario determines and by which the input is partitioned
    already; then there is no shuffle at all.
    """
    by = [*(keys or []), scenario_col]
    first = F.row_number().over(Window.partitionBy(*by).orderBy(id_col)) <= max_components + 1
    few = components.select(*by, F.col(id_col).alias("_cid"), F.col(text_col).alias("_text"), F.col(deps_col).alias("_deps"),
                            first.alias("_few")).filter("_few")
    node = F.struct(F.col("_cid").alias("cid"), py_strip(F.col("_text")).alias("text"),
                    F.coalesce(F.col("_deps"), F.array().cast("array<string>")).alias("deps"))
    found = few.groupBy(*by).agg(F.array_sort(F.collect_list(node)).alias("nodes"))
    whole = (F.size("nodes") <= max_components) & (F.size(F.array_distinct(F.transform("nodes", lambda x: x["cid"]))) == F.size("nodes"))
    return found.filter(whole).select(F.col(scenario_col).alias("scenario_id"), "nodes")


def carry_wordings(graphs: DataFrame, wordings: DataFrame, scenario_col: str = "scenario_id", id_col: str = "wording_id",
                   most: int = 64) -> DataFrame:
    """``graphs`` with each scenario's wording ids (repeats and nulls kept), so its paths needn't be joined with them one by one.

    Of any scenario at most ``most`` + 1 wordings are gathered; a scenario of more has a
    null list and is left to a join.  One without wordings has an empty list.
    """
    few = F.row_number().over(Window.partitionBy(scenario_col).orderBy(id_col)) <= most + 1
    found = (wordings.select(scenario_col, F.struct(F.col(id_col).cast("string").alias("id")).alias("_w"), few.alias("_few")).filter("_few")
             .groupBy(F.col(scenario_col).alias("scenario_id")).agg(F.collect_list("_w").alias(CARRIED)))
    empty = F.array().cast("array<struct<id:string>>")
    listed = F.when(F.col(CARRIED).isNull(), empty).when(F.size(CARRIED) <= most, F.col(CARRIED))
    return graphs.join(found.hint("merge"), "scenario_id", "left").withColumn(CARRIED, listed)


def _carried(df: DataFrame) -> list[str]:
    return [CARRIED] if CARRIED in df.columns else []


def _placeable(nodes: Column, placed: Column) -> Column:
    """Ids of nodes not yet placed whose dependencies are all placed (sorted)."""
    ready = F.filter(nodes, lambda x: ~F.array_contains(placed, x["cid"])
                     & F.forall(x["deps"], lambda d: F.array_contains(placed, d)))
    return F.transform(ready, lambda x: x["cid"])


def all_orderings(nodes: Column) -> Column:
    """P1 as one array expression (lambda form, used for small inputs and tests)."""
    start = F.array(F.array().cast("array<string>"))
    return F.aggregate(
        F.sequence(F.lit(1), F.size(nodes)), start,
        lambda acc, _i: F.flatten(F.transform(
            acc, lambda p: F.transform(_placeable(nodes, p), lambda c: F.concat(p, F.array(c))))))


def _text_map(nodes: Column) -> Column:
    return F.map_from_arrays(F.transform(nodes, lambda x: x["cid"]), F.transform(nodes, lambda x: x["text"]))


def turn_texts(placed: Column, text_map: Column) -> Column:
    """One user turn per component, first/next prefixes."""
    return F.transform(placed, lambda c, i: F.concat(
        F.when(i == 0, F.lit(FIRST_TURN_PREFIX)).otherwise(F.lit(NEXT_TURN_PREFIX)),
        F.element_at(text_map, c)))


def group_turn(placed: Column, text_map: Column) -> Column:
    """One grouped turn, texts joined by a space."""
    return F.concat(F.lit(GROUP_TURN_PREFIX),
                    F.array_join(F.transform(placed, lambda c: F.element_at(text_map, c)), " "))


# --- bitmask form: per-scenario masks, then unrolled, lambda-free expansions ----------------
#
# Node i (0-based, in sorted id order) has dependency mask dm[i] (bit j = depends on
# node j; a dependency outside the scenario sets bit 30, never satisfiable).  With at
# most ``width`` nodes every per-node test below is written out once per position, so
# the expansions are plain expressions that whole-stage codegen compiles.

def _bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))


def _has_bit(mask: Column, i) -> Column:
    sh = F.shiftright(mask, i) if isinstance(i, int) else F.call_function("shiftright", mask, i.cast("int"))
    return sh.bitwiseAND(F.lit(1).cast("long"))


def with_masks(graphs: DataFrame) -> DataFrame:
    """What the expansions read, once per scenario, by node in id order: ``ids``, ``tx``
    (stripped texts), ``qx`` (their JSON escapes), ``dm`` (dependency masks); ``n`` nodes,
    and ``plain`` if all ids are their own JSON escapes.  Graphs that have them are unchanged."""
    if "dm" in graphs.columns:
        return graphs
    ids = F.transform("nodes", lambda x: x["cid"])
    dm = F.transform("nodes", lambda x: F.aggregate(
        x["deps"], F.lit(0).cast("long"),
        lambda m, d: m.bitwiseOR(F.when(F.array_contains(ids, d), _bit(F.array_position(ids, d) - 1))
                                 .otherwise(F.lit(_MISSING_BIT).cast("long")))))
    return graphs.select("scenario_id", ids.alias("ids"), F.transform("nodes", lambda x: x["text"]).alias("tx"),
                         F.transform("nodes", lambda x: json_escape(x["text"])).alias("qx"), dm.alias("dm"),
                         F.size("nodes").alias("n"), F.forall(ids, lambda c: c == json_escape(c)).alias("plain"), *_carried(graphs))


def _ready(i: int, mask: Column, allowed: Column | None = None) -> Column:
    """Node i is unplaced, allowed, and all its dependencies are in ``mask``."""
    dep = F.get(F.col("dm"), i)
    cond = (F.lit(i) < F.col("n")) & (_has_bit(mask, i) == 0) & (dep.bitwiseAND(F.bitwise_not(mask)) == 0)
    if allowed is not None:
        cond = cond & (_has_bit(allowed, i) == 1)
    return cond


def first_ordering(nodes: Column) -> Column:
    """Lexicographically first ordering (smallest placeable node each step); short if stuck."""
    return F.aggregate(
        F.sequence(F.lit(1), F.size(nodes)), F.array().cast("array<string>"),
        lambda p, _i: F.concat(p, F.slice(_placeable(nodes, p), 1, 1)))


def _shape_nodes() -> Column:
    """The nodes of a shape ``(n, dm)``, named by their index."""
    return F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.struct(
        i.cast("string").alias("cid"),
        F.transform(F.filter(F.sequence(F.lit(0), F.lit(30)), lambda j: _has_bit(F.get(F.col("dm"), i), j) == 1),
                    lambda j: j.cast("string")).alias("deps")))


def shapes_of(g: DataFrame) -> DataFrame:
    """The distinct DAG shapes ``(n, dm)``, written once: a filter on what is made of a shape would else be run on every graph, before they are made distinct."""
    return cut_lineage(g.select("n", "dm").distinct(), "shapes")


def shape_orderings(g: DataFrame, max_rows: int = 500_000, shapes: DataFrame | None = None) -> DataFrame:
    """P1 once per distinct DAG shape, joined back to every scenario of that shape.

    An ordering depends only on the shape ``(n, dm)`` (node count and
    dependency masks over sorted ids), and there are at most 29,281 labelled
    DAGs on five nodes, so the expansion runs once per shape actually present,
    not once per scenario.  The (shape, ordering) table is broadcast only after
    its row count is proven at most ``max_rows`` (a hot shape then costs
    nothing); otherwise it is a shuffle join.  Output: ``g`` columns + ``order``
    (node indices).  ``shapes`` may hand in ``shapes_of(g)``.
    """
    from .frames import bounded_broadcast
    table = (shapes_of(g) if shapes is None else shapes).select("n", "dm", F.explode(all_orderings(_shape_nodes())).alias("o")).select(
        "n", "dm", F.transform("o", lambda x: x.cast("int")).alias("order"))
    return g.join(bounded_broadcast(table, max_rows), ["n", "dm"])


def ids_of(order: Column) -> Column:
    """Node indices -> component ids."""
    return F.transform(order, lambda i: F.get(F.col("ids"), i))


def closed_subsets(g: DataFrame, min_size: int = 2, width: int = 5) -> DataFrame:
    """One row per dependency-closed proper subset (``mask``) of at least ``min_size`` nodes."""
    full = _bit(F.col("n")) - 1
    x = g.withColumn("mask", F.explode(F.sequence(F.lit(1).cast("long"), full - 1)))
    m = F.col("mask")
    closed = F.lit(True)
    for i in range(width):
        dep = F.get(F.col("dm"), i)
        closed = closed & ((F.lit(i) >= F.col("n")) | (_has_bit(m, i) == 0)
                           | (dep.bitwiseAND(F.bitwise_not(m)) == 0))
    return x.filter((F.bit_count(m) >= min_size) & closed)


def closed_subset_masks(nodes: Column, min_size: int = 2) -> Column:
    """P2 as one array expression (lambda form)."""
    ids = F.transform(nodes, lambda x: x["cid"])
    dep_masks = F.transform(nodes, lambda x: F.aggregate(
        x["deps"], F.lit(0).cast("long"),
        lambda m, d: m.bitwiseOR(F.when(F.array_contains(ids, d), _bit(F.array_position(ids, d) - 1))
                                 .otherwise(F.lit(_MISSING_BIT).cast("long")))))
    n = F.size(nodes)
    candidates = F.sequence(F.lit(1).cast("long"), _bit(n) - 2)
    return F.filter(candidates, lambda m: (F.bit_count(m) >= min_size) & F.forall(
        F.sequence(F.lit(0), n - 1),
        lambda i: (_has_bit(m, i) == 0) | (F.element_at(dep_masks, i + 1).bitwiseAND(F.bitwise_not(m)) == 0)))


def _subset_shapes(g: DataFrame, min_size: int, width: int, max_rows: int = 500_000, shapes: DataFrame | None = None) -> DataFrame:
    """P2 with each subset's first valid order, once per distinct DAG shape (see ``shape_orderings``): ``g`` columns + ``order``.

    A subset that has no order (a cycle inside) is left out.
    """
    from .frames import bounded_broadcast
    x = closed_subsets(shapes_of(g) if shapes is None else shapes, min_size, width)
    members = F.filter(_shape_nodes(), lambda x: _has_bit(F.col("mask"), x["cid"]) == 1)
    table = x.select("n", "dm", "mask", members.alias("members")).select("n", "dm", "mask", first_ordering(F.col("members")).alias("o"))
    table = table.filter(F.size("o") == F.bit_count("mask")).select("n", "dm", F.transform("o", lambda c: c.cast("int")).alias("order"))
    return g.join(bounded_broadcast(table, max_rows), ["n", "dm"])


def _whole_orders(g: DataFrame, max_rows: int = 500_000, shapes: DataFrame | None = None) -> DataFrame:
    """Each graph with its first valid order (``order``), once per distinct DAG shape; a graph without one is left out."""
    from .frames import bounded_broadcast
    table = (shapes_of(g) if shapes is None else shapes).select("n", "dm", first_ordering(_shape_nodes()).alias("o")).filter(F.size("o") == F.col("n"))
    return g.join(bounded_broadcast(table.select("n", "dm", F.transform("o", lambda c: c.cast("int")).alias("order")), max_rows), ["n", "dm"])


def _finish(df: DataFrame, path_type: str, signature: Column, turns: Column, used: Column,
            quoted_turns: Column, n_turns: Column, plain: Column | None = None) -> DataFrame:
    """Common path columns.  ``quoted_turns`` is the JSON text of the turn list without
    brackets, ``n_turns`` its length, so a plan that drops ``turns`` builds none; ``plain``
    says that the signature is its own JSON escape."""
    out = df.select("scenario_id", F.lit(path_type).alias("path_type"), signature.alias("path_signature"),
                    n_turns.cast("int").alias("n_turns"), turns.alias("turns"), used.alias("components_used"),
                    quoted_turns.alias("_qt"), (F.lit(False) if plain is None else plain).alias("_plain"), *_carried(df))
    pid = path_id(F.col("path_signature"), F.col("turns"), F.col("_qt"), F.col("_plain"))
    return out.select("scenario_id", "path_type", "path_signature", pid.alias("perm_id"), "n_turns", "components_used", "turns", *_carried(df))


def _at(col: str, i: int) -> Column:
    """Element of a per-node array at the ``i``-th node of ``order``."""
    return F.get(F.col(col), F.get(F.col("order"), i))


def _placed(width: int) -> Column:
    return F.slice(F.array(*[_at("ids", i) for i in range(width)]), 1, F.size("order"))


def sequential_paths(graphs: DataFrame, width: int = 5, shapes: DataFrame | None = None) -> DataFrame:
    """One path per ordering; cumulative signature, turns add one component each."""
    g = shape_orderings(with_masks(graphs), shapes=shapes)
    n = F.size("order")
    prefix = lambda i: FIRST_TURN_PREFIX if i == 0 else NEXT_TURN_PREFIX
    turn = [F.concat(F.lit(prefix(i)), _at("tx", i)) for i in range(width)]
    quoted = [F.when(n > i, F.concat(F.lit('"' + py_json_escape(prefix(i))), _at("qx", i), F.lit('"'))) for i in range(width)]
    heads, head = [], None
    for i in range(width):
        head = _at("ids", i) if head is None else F.concat(head, F.lit(","), _at("ids", i))
        heads.append(F.when(n > i, F.concat(F.lit("["), head, F.lit("]"))))
    signature = F.concat(F.concat_ws("", *heads), F.lit("[F]"))
    return _finish(g, "sequential", signature, F.slice(F.array(*turn), 1, n), _placed(width), F.concat_ws(", ", *quoted), n, F.col("plain"))


def skipped_paths(graphs: DataFrame, width: int = 5) -> DataFrame:
    """P9 (with P3 roots): ``[Ci][F]`` for each component without dependencies."""
    g = with_masks(graphs)
    roots = F.filter(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.get(F.col("dm"), i) == 0)
    g = g.select("scenario_id", "plain", F.explode(roots).alias("i"), "ids", "tx", "qx", *_carried(g)).select(
        "scenario_id", "plain", *_carried(g), *[F.get(F.col(c), F.col("i")).alias(c) for c in ("ids", "tx", "qx")])
    quoted = F.concat(F.lit('"' + py_json_escape(FIRST_TURN_PREFIX)), F.col("qx"), F.lit('"'))
    return _finish(g, "skipped", F.concat(F.lit("["), F.col("ids"), F.lit("][F]")),
                   F.array(F.concat(F.lit(FIRST_TURN_PREFIX), F.col("tx"))), F.array("ids"), quoted, F.lit(1), F.col("plain"))


def alt_grouping_paths(graphs: DataFrame, min_size: int = 2, width: int = 5, shapes: DataFrame | None = None) -> DataFrame:
    """P10: one grouped turn per closed subset, members in their first valid order."""
    g = _subset_shapes(with_masks(graphs), min_size, width, shapes=shapes)
    sig = F.concat(F.lit("["), F.concat_ws(",", *[_at("ids", i) for i in range(width)]), F.lit("][F]"))
    turn = F.concat(F.lit(GROUP_TURN_PREFIX), F.concat_ws(" ", *[_at("tx", i) for i in range(width)]))
    quoted = F.concat(F.lit('"' + py_json_escape(GROUP_TURN_PREFIX)), F.concat_ws(" ", *[_at("qx", i) for i in range(width)]), F.lit('"'))
    return _finish(g, "alt_grouping", sig, F.array(turn), _placed(width), quoted, F.lit(1), F.col("plain"))


def direct_paths(graphs: DataFrame, width: int = 5) -> DataFrame:
    """The control with no context turns."""
    empty = F.array().cast("array<string>")
    return _finish(graphs, "direct", F.lit("[F]"), empty, empty, F.lit(""), F.lit(0))


def length_matched_paths(graphs: DataFrame, filler: FillerPlan | None = None, width: int = 5, shapes: DataFrame | None = None) -> DataFrame:
    """One filler turn sized to the token total of the first ordering.

    Only scenarios that have an ordering get one (the greedy order must place all).
    """
    plan = filler or FillerPlan()
    g = _whole_orders(with_masks(graphs), shapes=shapes)
    # The target is its own column: the filler expressions read it several times.
    tokens = [F.when(F.size("order") > i, approx_tokens(F.concat(F.lit(FIRST_TURN_PREFIX if i == 0 else NEXT_TURN_PREFIX), _at("tx", i)))
                     .cast("long")).otherwise(F.lit(0)) for i in range(width)]
    target = sum(tokens[1:], tokens[0])
    g = g.withColumn("target", target)
    turn = F.concat(F.lit(FILLER_TURN_PREFIX), plan.text(F.col("target")))
    quoted = F.concat(F.lit('"' + py_json_escape(FILLER_TURN_PREFIX)), plan.text(F.col("target"), escaped=True),
                      F.lit('"'))
    return _finish(g, "length_matched", F.lit("[FILLER][F]"), F.array(turn), F.array().cast("array<string>"),
                   quoted, F.lit(1))


_BUILDERS = {
    "sequential": sequential_paths,
    "skipped": skipped_paths,
    "alt_grouping": alt_grouping_paths,
    "direct": direct_paths,
    "length_matched": length_matched_paths,
}
_SHAPED = {"sequential", "alt_grouping", "length_matched"}  # expanded by shape
GRAPH_ROWS = 10_000  # graphs in a file: a graph has up to 120 orderings, so few bytes of them are many paths


def generate_paths(graphs: DataFrame, path_types: list[str] | None = None, sort: bool = False,
                   materialise: bool = True, width: int = 5) -> DataFrame:
    """All requested path types as one DataFrame (union of narrow expansions).

    ``width`` is the ``max_components`` the graphs were gathered with.
    """
    types = path_types or PATH_TYPES
    unknown = set(types) - set(_BUILDERS)
    if unknown:
        raise ValueError(f"unknown path types: {sorted(unknown)}")
    if len(types) > 1 and materialise:
        # Every path type reads the gathered graphs; each branch prunes different
        # columns, so Spark cannot reuse one exchange for all of them.  Cut the
        # lineage once (reliable checkpoint in the shared folder) instead of
        # re-reading and re-shuffling the components per path type.
        graphs = cut_lineage(with_masks(graphs), rows_per_file=GRAPH_ROWS)
    if _SHAPED & set(types):
        graphs = with_masks(graphs)
        shapes = shapes_of(graphs)
    out = None
    for t in types:
        part = _BUILDERS[t](graphs, width=width, **({"shapes": shapes} if t in _SHAPED else {}))
        out = part if out is None else out.unionByName(part)
    if sort:
        out = out.orderBy("scenario_id", "path_type", "path_signature")
    return out


def path_census(paths: DataFrame) -> DataFrame:
    """Number of paths per (scenario, path type) of a path table."""
    return paths.groupBy("scenario_id", "path_type").agg(F.count(F.lit(1)).alias("n_paths"))


def census_of(graphs: DataFrame, max_rows: int = 500_000) -> DataFrame:
    """P15 without the paths: they depend on a graph's shape alone, so each shape is expanded once and its counts are looked up."""
    from .frames import bounded_broadcast
    g = with_masks(graphs).select("scenario_id", "n", "dm")
    pseudo = g.select("n", "dm").distinct().select("n", "dm", F.to_json(F.struct("n", "dm")).alias("scenario_id"), F.transform(
        F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.struct(
            i.cast("string").alias("cid"), F.lit("").alias("text"),
            F.transform(F.filter(F.sequence(F.lit(0), F.lit(30)), lambda j: _has_bit(F.get(F.col("dm"), i), j) == 1),
                        lambda j: j.cast("string")).alias("deps"))).alias("nodes"))
    pseudo = cut_lineage(pseudo, "shapes")
    counts = path_census(generate_paths(pseudo.select("scenario_id", "nodes"), materialise=False)).withColumnRenamed("scenario_id", "_shape")
    shapes = pseudo.select("n", "dm", F.col("scenario_id").alias("_shape"))
    table = cut_lineage(shapes.join(counts, "_shape").drop("_shape"), "shape_counts")
    return g.join(bounded_broadcast(table, max_rows), ["n", "dm"]).select("scenario_id", "path_type", "n_paths")
