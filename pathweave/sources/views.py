"""Adapter views: experiment tables derived from the driver's TPC-H-like parquet.

Each view exists twice, built from one definition of its rules: a Spark
DataFrame builder (used by the registered queries) and a SQL text (inlined as
a CTE by the DuckDB oracles).  Nothing outside this module knows a driver
column name; every operator takes column names as parameters.

* ``runs_v``       orders x customer x nation -> one run per order (ledger shape)
* ``scenarios_v``  nation x region -> one scenario row per stratum of ``runs_v``
* ``components_v`` lines are components; every order's lines make scenarios of 3-5 components
* ``design_rejects_v`` the lines of orders that are too small for a scenario
* ``raw_components_v`` every order, unfiltered, for the data-quality rules
* ``wordings_v``   three terminal wordings per design scenario
* ``design_scenarios_v`` one nested-document header per design scenario
* ``turns_v`` / ``responses_v`` conversations as transcripts and recorded replies
* ``labelled_v``   documents left join labels: a second binary-outcome table
* ``events_v``     events as a run-completion stream
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def with_ctes(*ctes: str, body: str) -> str:
    """Compose ``WITH a AS (...), b AS (...) body`` from ``name AS (...)`` parts."""
    return "WITH " + ",\n".join(ctes) + "\n" + body


# ---------------------------------------------------------------------------
# runs_v / scenarios_v
# ---------------------------------------------------------------------------

# Order priority -> path type (arm).  Fixed mapping of the adapter.
_PRIORITY_TO_PATH = [
    ("1-URGENT", "direct"),
    ("2-HIGH", "sequential"),
    ("3-MEDIUM", "skipped"),
    ("4-NOT SPECIFIED", "alt_grouping"),
]


# Runs that the frames have to leave out: some statuses that aren't outcomes, an unlisted arm, an unmatched scenario.
UNFINISHED = ("pending", "running", "failed")  # by o_orderkey % 97 = 0, 1, 2
UNKNOWN_PATH, UNKNOWN_SCENARIO = "unlisted", "NOWHERE"


def _case(col: Column, pairs, default) -> Column:
    expr = None
    for key, value in pairs:
        expr = (F.when(col == key, value) if expr is None else expr.when(col == key, value))
    return expr.otherwise(default)


def runs_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"
    )
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    requested = F.concat(F.lit("prov-"), F.lower("c_mktsegment"))
    unfinished = F.col("o_orderkey") % 97 < len(UNFINISHED)
    return j.select(
        F.col("o_orderkey").alias("run_id"),
        F.when(F.col("o_orderkey") % 83 == 0, F.lit(UNKNOWN_SCENARIO)).otherwise(F.col("n_name")).alias("scenario_id"),
        F.when(F.col("o_orderkey") % 89 == 0, F.lit(UNKNOWN_PATH))
        .otherwise(_case(F.col("o_orderpriority"), _PRIORITY_TO_PATH, "length_matched")).alias("path_type"),
        F.concat(F.lit("W"), (F.col("o_orderkey") % 3 + 1).cast("string")).alias("terminal_wording_id"),
        F.when(unfinished, F.lit(None).cast("int")).when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 0)
        .otherwise(F.lit(None).cast("int")).alias("verdict"),
        F.when(unfinished, F.element_at(F.array(*map(F.lit, UNFINISHED)), (F.col("o_orderkey") % 97 + 1).cast("int")))
        .when(F.col("o_orderstatus") == "P", "refused").otherwise("complete").alias("status"),
        F.floor("o_totalprice").cast("bigint").alias("total_tokens"),
        F.col("o_orderdate").alias("ts"),
        requested.alias("provider_requested"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.lit(None).cast("string"))
        .when(F.col("o_orderstatus") == "P", F.lit("prov-fallback"))
        .otherwise(requested).alias("provider_used"),
    )


RUNS_V_SQL = """runs_v AS (
  SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 83 = 0 THEN 'NOWHERE' ELSE n_name END AS scenario_id,
    CASE WHEN o_orderkey % 89 = 0 THEN 'unlisted' ELSE CASE o_orderpriority WHEN '1-URGENT' THEN 'direct'
      WHEN '2-HIGH' THEN 'sequential' WHEN '3-MEDIUM' THEN 'skipped' WHEN '4-NOT SPECIFIED' THEN 'alt_grouping'
      ELSE 'length_matched' END END AS path_type,
    'W' || CAST(o_orderkey % 3 + 1 AS VARCHAR) AS terminal_wording_id,
    CASE WHEN o_orderkey % 97 < 3 THEN NULL WHEN o_orderstatus = 'F' THEN 1 WHEN o_orderstatus = 'O' THEN 0 END AS verdict,
    CASE o_orderkey % 97 WHEN 0 THEN 'pending' WHEN 1 THEN 'running' WHEN 2 THEN 'failed'
      ELSE CASE WHEN o_orderstatus = 'P' THEN 'refused' ELSE 'complete' END END AS status,
    CAST(floor(o_totalprice) AS BIGINT) AS total_tokens, o_orderdate AS ts,
    'prov-' || lower(c_mktsegment) AS provider_requested,
    CASE WHEN o_orderpriority = '5-LOW' THEN NULL WHEN o_orderstatus = 'P' THEN 'prov-fallback'
      ELSE 'prov-' || lower(c_mktsegment) END AS provider_used
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def scenarios_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = read(spark, sf_dir, "region").select("r_regionkey", "r_name")
    j = n.join(r, n.n_regionkey == r.r_regionkey)
    return j.select(
        F.col("n_name").alias("scenario_id"),
        F.lower("r_name").alias("type"),
        F.when(F.col("n_regionkey") % 3 == 0, "commutative")
        .when(F.col("n_regionkey") % 3 == 1, "partial").otherwise("entangled").alias("independence_class"),
        (F.col("n_nationkey") % 3 + 3).cast("int").alias("n_components"),
        F.concat(F.lit("Deliberation in "), F.lower("n_name"), F.lit(".")).alias("setup_text"),
        F.lit(None).cast("string").alias("raw_yaml"),
    )


SCENARIOS_V_SQL = """scenarios_v AS (
  SELECT n_name AS scenario_id, lower(r_name) AS type,
    CASE n_regionkey % 3 WHEN 0 THEN 'commutative' WHEN 1 THEN 'partial' ELSE 'entangled' END
      AS independence_class,
    CAST(n_nationkey % 3 + 3 AS INTEGER) AS n_components,
    'Deliberation in ' || lower(n_name) || '.' AS setup_text,
    CAST(NULL AS VARCHAR) AS raw_yaml
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""


# ---------------------------------------------------------------------------
# components_v (design DAGs) and friends
# ---------------------------------------------------------------------------

_LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
               "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


BLOCK_LINES = 500  # line numbers of an order that make a block
COMPONENT_KEYS = ["l_orderkey", "block", "piece"]  # what names a scenario of ``components_v``, by which its rows are partitioned


def _order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines with their place ``at`` in their block and the number ``m`` of its lines.

    A block is BLOCK_LINES line numbers of an order, so an order of very many lines is
    cut in line order, like any other, and no window sees it whole.
    """
    li = read(spark, sf_dir, "lineitem").select(*(["l_orderkey"] + _LINE_ORDER))
    part = read(spark, sf_dir, "part").select("p_partkey", "p_name")
    lines = li.join(part, li.l_partkey == part.p_partkey).withColumn("block", F.expr(f"(l_linenumber - 1) div {BLOCK_LINES}"))
    w = Window.partitionBy("l_orderkey", "block")
    return lines.withColumn("at", F.row_number().over(w.orderBy(*_LINE_ORDER)) - 1).withColumn("m", F.count(F.lit(1)).over(w))


def components_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Design scenarios of 3 to 5 components from the lines of every order.

    A block of m >= 3 lines is cut, in line order, into ceil(m / 5) scenarios of
    nearly equal size (6 lines: 3 + 3; 7: 4 + 3), numbered if there are several;
    ``design_rejects_v`` has the lines of smaller blocks.
    """
    lines = _order_lines(spark, sf_dir).filter("m >= 3")
    lines = (lines.withColumn("k", F.expr("cast(ceil(m / 5) AS bigint)")).withColumn("c", F.expr("(at * k) div m"))
             .withColumn("piece", F.col("c")).withColumn("lo", F.expr("(c * m + k - 1) div k")).withColumn("hi", F.expr("((c + 1) * m + k - 1) div k")))
    lines = lines.withColumn("rn", F.expr("cast(at - lo + 1 AS int)"))
    name = F.expr("concat(cast(l_orderkey AS string), CASE WHEN block > 0 OR k > 1 THEN concat('-', cast(block AS string), '-', "
                  "cast(c + 1 AS string)) ELSE '' END)")
    rn = F.col("rn")
    deps = (F.when((rn == 1) | (F.col("l_returnflag") == "N"), F.array().cast("array<string>"))
            .when(F.col("l_returnflag") == "A", F.array(F.lit("C1")))
            .otherwise(F.array(F.concat(F.lit("C"), (rn - 1).cast("string")))))
    return lines.select(
        name.alias("scenario_id"),
        F.concat(F.lit("C"), rn.cast("string")).alias("cid"),
        F.col("p_name").alias("text"),
        deps.alias("deps"),
        rn.alias("rn"),
        F.expr("cast(hi - lo AS int)").alias("n"),
        *COMPONENT_KEYS,
    )


def design_rejects_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders (blocks) with too few lines for a scenario: (scenario_id, rule, detail, n_lines)."""
    small = _order_lines(spark, sf_dir).filter("m < 3").groupBy("l_orderkey", "block").agg(F.count(F.lit(1)).alias("n_lines"))
    return small.select(F.expr("concat(cast(l_orderkey AS string), CASE WHEN block > 0 THEN concat('-', cast(block AS string)) ELSE '' END)")
                        .alias("scenario_id"), F.lit("too_few_components").alias("rule"),
                        F.concat(F.lit("components="), F.col("n_lines").cast("string")).alias("detail"), "n_lines")


ORDER_LINES_SQL = f"""order_lines AS (
  SELECT *, count(*) OVER (PARTITION BY l_orderkey, block) AS m,
    row_number() OVER (PARTITION BY l_orderkey, block ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity,
      l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS place
  FROM (SELECT l.*, p_name, (l_linenumber - 1) // {BLOCK_LINES} AS block FROM lineitem l JOIN part ON l_partkey = p_partkey) t)"""

COMPONENTS_V_SQL = ORDER_LINES_SQL + """,
pieces AS (SELECT *, (place * k) // m AS c FROM (SELECT *, CAST(ceil(m / 5) AS BIGINT) AS k FROM order_lines WHERE m >= 3) t),
numbered AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey, block, c) AS n,
    row_number() OVER (PARTITION BY l_orderkey, block, c ORDER BY place) AS rn FROM pieces),
components_v AS (
  SELECT CAST(l_orderkey AS VARCHAR) || CASE WHEN block > 0 OR k > 1 THEN '-' || block || '-' || (c + 1) ELSE '' END AS scenario_id,
    'C' || CAST(rn AS VARCHAR) AS cid, p_name AS text,
    CASE WHEN rn = 1 OR l_returnflag = 'N' THEN CAST([] AS VARCHAR[])
      WHEN l_returnflag = 'A' THEN ['C1'] ELSE ['C' || CAST(rn - 1 AS VARCHAR)] END AS deps,
    CAST(rn AS INTEGER) AS rn, CAST(n AS INTEGER) AS n
  FROM numbered)"""

DESIGN_REJECTS_V_SQL = """design_rejects_v AS (
  SELECT CAST(l_orderkey AS VARCHAR) || CASE WHEN block > 0 THEN '-' || block ELSE '' END AS scenario_id,
    'too_few_components' AS rule, 'components=' || count(*) AS detail, count(*) AS n_lines
  FROM order_lines WHERE m < 3 GROUP BY l_orderkey, block)"""


def raw_components_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every order as a component, with no cleaning at all.

    ``cid`` is the raw line number, so ids may repeat inside a scenario, and the
    dependency rule has no guard for the first line: flag ``A`` on line 1 is a
    self-loop and flag ``R`` on line 1 points at the undefined ``C0``.
    No window is needed, so a hot order costs nothing special.
    """
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag")
    part = read(spark, sf_dir, "part").select("p_partkey", "p_name")
    ln = F.col("l_linenumber")
    deps = (F.when(F.col("l_returnflag") == "N", F.array().cast("array<string>"))
            .when(F.col("l_returnflag") == "A", F.array(F.lit("C1")))
            .otherwise(F.array(F.concat(F.lit("C"), (ln - 1).cast("string")))))
    return li.join(part, li.l_partkey == part.p_partkey).select(
        F.col("l_orderkey").cast("string").alias("scenario_id"),
        F.concat(F.lit("C"), ln.cast("string")).alias("cid"),
        F.col("p_name").alias("text"),
        deps.alias("deps"),
    )


RAW_COMPONENTS_V_SQL = """raw_components_v AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS scenario_id, 'C' || CAST(l_linenumber AS VARCHAR) AS cid,
    p_name AS text,
    CASE WHEN l_returnflag = 'N' THEN CAST([] AS VARCHAR[]) WHEN l_returnflag = 'A' THEN ['C1']
      ELSE ['C' || CAST(l_linenumber - 1 AS VARCHAR)] END AS deps
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def wordings_v(spark: SparkSession, sf_dir: str, components: DataFrame | None = None) -> DataFrame:
    """Three terminal wordings per design scenario."""
    comps = components if components is not None else components_v(spark, sf_dir)
    scen = comps.filter(F.col("rn") == 1).select("scenario_id")
    k = F.explode(F.sequence(F.lit(1), F.lit(3))).alias("k")
    return scen.select("scenario_id", k).select(
        "scenario_id",
        F.concat(F.lit("W"), F.col("k").cast("string")).alias("wording_id"),
        F.concat(F.lit("Should plan "), F.col("scenario_id"), F.lit(" go ahead (form "),
                 F.col("k").cast("string"), F.lit(")? Answer yes or no.")).alias("wording"),
    )


WORDINGS_V_SQL = """wordings_v AS (
  SELECT scenario_id, 'W' || CAST(k AS VARCHAR) AS wording_id,
    'Should plan ' || scenario_id || ' go ahead (form ' || CAST(k AS VARCHAR) || ')? Answer yes or no.'
      AS wording
  FROM components_v, (SELECT unnest([1, 2, 3]) AS k) ks WHERE rn = 1)"""


def design_scenarios_v(spark: SparkSession, sf_dir: str, components: DataFrame | None = None) -> DataFrame:
    """Header fields of each design scenario (the nested document's scalars)."""
    comps = components if components is not None else components_v(spark, sf_dir)
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    heads = comps.filter(F.col("rn") == 1).select("scenario_id", "n")
    j = heads.join(o, F.substring_index(heads.scenario_id, "-", 1) == o.o_orderkey.cast("string"))
    return j.select(
        "scenario_id",
        F.lower(F.regexp_replace(F.substring("o_orderpriority", 3, 100), " ", "_")).alias("type"),
        F.when(F.col("o_orderstatus") == "F", "commutative").when(F.col("o_orderstatus") == "O", "partial")
        .otherwise("entangled").alias("independence_class"),
        F.concat(F.lit("  Plan "), F.col("scenario_id"), F.lit(" for client "),
                 F.col("o_custkey").cast("string"), F.lit(" is under review.\n")).alias("setup"),
        F.col("n").alias("n_components"),
    )


DESIGN_SCENARIOS_V_SQL = """design_scenarios_v AS (
  SELECT scenario_id,
    lower(replace(substr(o_orderpriority, 3, 100), ' ', '_')) AS type,
    CASE o_orderstatus WHEN 'F' THEN 'commutative' WHEN 'O' THEN 'partial' ELSE 'entangled' END
      AS independence_class,
    '  Plan ' || scenario_id || ' for client ' || CAST(o_custkey AS VARCHAR) || ' is under review.' || chr(10)
      AS setup,
    n AS n_components
  FROM components_v JOIN orders ON split_part(scenario_id, '-', 1) = CAST(o_orderkey AS VARCHAR) WHERE rn = 1)"""


def raw_scenarios_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header fields for every order (the unclean corpus checked by the DQ rules).

    The class comes from the priority and is outside the allowed set for
    ``5-LOW``; setup is blank for pending low-priority orders; the number of
    wordings is ``o_orderkey % 4`` (zero means none); the id is the customer and
    order date, so two orders of one customer on one day collide.
    """
    o = read(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate")
    return o.select(
        F.col("o_orderkey").cast("string").alias("scenario_id"),
        F.concat(F.lit("c"), F.col("o_custkey").cast("string"), F.lit("-"),
                 F.date_format("o_orderdate", "yyyyMMdd")).alias("doc_id"),
        F.when(F.col("o_orderstatus") == "F", "utilitarian_tradeoff")
        .when(F.col("o_orderstatus") == "O", "competing_obligations").otherwise("rights_conflict").alias("type"),
        _case(F.col("o_orderpriority"), [("1-URGENT", "commutative"), ("2-HIGH", "partial"),
                                         ("3-MEDIUM", "entangled"), ("4-NOT SPECIFIED", "partial")],
              "mixed").alias("independence_class"),
        F.when((F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "5-LOW"), F.lit(" \t\n "))
        .otherwise(F.concat(F.lit(" Plan "), F.col("o_orderkey").cast("string"), F.lit(" "))).alias("setup"),
        (F.col("o_orderkey") % 4).cast("int").alias("n_wordings"),
    )


RAW_SCENARIOS_V_SQL = """raw_scenarios_v AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS scenario_id,
    'c' || CAST(o_custkey AS VARCHAR) || '-' || strftime(o_orderdate, '%Y%m%d') AS doc_id,
    CASE o_orderstatus WHEN 'F' THEN 'utilitarian_tradeoff' WHEN 'O' THEN 'competing_obligations'
      ELSE 'rights_conflict' END AS type,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'commutative' WHEN '2-HIGH' THEN 'partial'
      WHEN '3-MEDIUM' THEN 'entangled' WHEN '4-NOT SPECIFIED' THEN 'partial' ELSE 'mixed' END
      AS independence_class,
    CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW' THEN ' ' || chr(9) || chr(10) || ' '
      ELSE ' Plan ' || CAST(o_orderkey AS VARCHAR) || ' ' END AS setup,
    CAST(o_orderkey % 4 AS INTEGER) AS n_wordings
  FROM orders)"""


# ---------------------------------------------------------------------------
# transcripts, responses, labelled outcomes, events
# ---------------------------------------------------------------------------

def turns_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("run_id"), F.col("turn").alias("turn_index"),
                    "role", F.col("text").alias("content"))


TURNS_V_SQL = """turns_v AS (
  SELECT conv_id AS run_id, turn AS turn_index, role, text AS content FROM conversations)"""

# Reply prefixes that exercise every verdict branch (fixed values of the adapter).
RESPONSE_PREFIXES = ["Yes. ", "\n no, ", "Nope: ", '"yes" ', "NO!", ""]


def responses_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns as recorded replies, with call metadata derived from the row."""
    c = read(spark, sf_dir, "conversations").filter(F.col("role") == "assistant")
    prefix = F.element_at(F.array(*[F.lit(p) for p in RESPONSE_PREFIXES]), (F.col("conv_id") % 6 + 1).cast("int"))
    return c.select(
        F.col("conv_id").alias("run_id"), F.col("turn").alias("turn_index"),
        F.concat(prefix, F.col("text")).alias("content"),
        F.greatest(F.lit(1), F.floor(F.length("text") / 4)).cast("int").alias("total_tokens"),
        (F.length("text") + 20).cast("int").alias("latency_ms"),
        F.when(F.col("conv_id") % 3 == 0, "prov-a").when(F.col("conv_id") % 3 == 1, "prov-b")
        .otherwise(F.lit(None).cast("string")).alias("provider_used"),
        F.concat(F.lit("model-a-"), (F.col("turn") % 2).cast("string")).alias("model_version"),
    )


RESPONSES_V_SQL = """responses_v AS (
  SELECT conv_id AS run_id, turn AS turn_index,
    ['Yes. ', chr(10) || ' no, ', 'Nope: ', '"yes" ', 'NO!', ''][CAST(conv_id % 6 + 1 AS INTEGER)] || text
      AS content,
    CAST(greatest(1, floor(length(text) / 4)) AS INTEGER) AS total_tokens,
    CAST(length(text) + 20 AS INTEGER) AS latency_ms,
    CASE conv_id % 3 WHEN 0 THEN 'prov-a' WHEN 1 THEN 'prov-b' ELSE NULL END AS provider_used,
    'model-a-' || CAST(turn % 2 AS VARCHAR) AS model_version
  FROM conversations WHERE role = 'assistant')"""


def status_log_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as an append-only run-status log (one update per event)."""
    e = read(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("run_id"), F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("event_type") == "purchase", "complete").when(F.col("event_type") == "error", "failed")
        .when(F.col("event_type") == "signup", "refused").otherwise("running").alias("status"),
        F.when(F.col("event_type") == "purchase", (F.col("value") >= 50).cast("int")).alias("verdict"),
        F.floor(F.col("value") * 10).cast("int").alias("total_tokens"),
    )


STATUS_LOG_V_SQL = """status_log_v AS (
  SELECT user_id AS run_id, ts,
    CASE event_type WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'refused'
      ELSE 'running' END AS status,
    CASE WHEN event_type = 'purchase' THEN CAST(value >= 50 AS INTEGER) END AS verdict,
    CAST(floor(value * 10) AS INTEGER) AS total_tokens
  FROM events)"""


def labelled_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    lab = read(spark, sf_dir, "labels").select("doc_id", "quality")
    j = d.join(lab, "doc_id", "left")
    return j.select(
        "doc_id", F.col("lang").alias("arm"), F.col("source").alias("stratum"),
        F.col("quality").alias("outcome"),
        F.when(F.col("quality").isNull(), "refused").otherwise("complete").alias("status"),
        F.col("n_chars").alias("tokens"),
    )


LABELLED_V_SQL = """labelled_v AS (
  SELECT doc_id, lang AS arm, source AS stratum, quality AS outcome,
    CASE WHEN quality IS NULL THEN 'refused' ELSE 'complete' END AS status, n_chars AS tokens
  FROM documents LEFT JOIN labels USING (doc_id))"""


def events_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("run_id"),
                    F.col("event_type").alias("status"), "value")


EVENTS_V_SQL = """events_v AS (
  SELECT event_id, ts, user_id AS run_id, event_type AS status, value FROM events)"""
