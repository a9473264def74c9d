"""Design expansion into a run manifest.

The manifest is paths x wordings x replicates.  Paths that carry their
scenario's wordings (``paths.carry_wordings``) are expanded in place: no path is
shuffled.  Other paths are joined with the wordings.  Replicates are a
generator, never a join.  Identities are content hashes, so generating twice
gives the same rows and insert-or-ignore (L2) makes ``generate`` idempotent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.identity import condition_seed, key_head, keyed_hash, run_id
from .aggregates import equal_tiles, hash_positions
from .paths import CARRIED

RUN_STATUSES = ["pending", "running", "complete", "failed", "refused"]
TERMINAL_STATUSES = ["complete", "refused"]

OUTCOME_COLUMNS = {
    "verdict": "int", "model_version": "string", "provider_used": "string", "n_turns": "int",
    "total_tokens": "int", "latency_ms": "int", "timestamp": "timestamp",
}


def expand_replicates(df: DataFrame, replicates: int, col: str = "replicate_idx") -> DataFrame:
    """M2: one row per replicate 0..r-1; r <= 0 yields no rows (``sequence`` would count down)."""
    if replicates <= 0:
        return df.withColumn(col, F.lit(None).cast("int")).limit(0)
    return df.withColumn(col, F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))


_PATH = ["scenario_id", "path_type", "path_signature", "perm_id"]


_CONDITION_KEY = ["scenario_id", "path_type", "perm_id", "terminal_wording_id"]


def _heads() -> list:
    """What the keys of all runs of a condition begin with, made once a condition."""
    return [key_head(*map(F.col, _CONDITION_KEY)).alias("_run_head"),
            key_head(*[F.col(c) for c in _CONDITION_KEY if c != "path_type"]).alias("_seed_head")]


def _run_id(replicate, model: str):
    return run_id(F.col("_run_head"), replicate, F.lit(model))


def _seed(replicate):
    return condition_seed(F.col("_seed_head"), replicate)


def _joined(paths: DataFrame, wordings: DataFrame, wording_id_col: str, keep: list[str]) -> DataFrame:
    return paths.select(*_PATH, *keep).join(wordings.select("scenario_id", F.col(wording_id_col).alias("terminal_wording_id")).hint("merge"), "scenario_id")


def plan_conditions(paths: DataFrame, wordings: DataFrame | None, wording_id_col: str = "wording_id", keep: list[str] | None = None) -> DataFrame:
    """One row for each path and wording: the list a path carries, and ``wordings`` for paths without a list.  ``keep`` names more columns of ``paths``."""
    keep = keep or []
    if CARRIED not in paths.columns:
        return _joined(paths, wordings, wording_id_col, keep)
    out = paths.select(*_PATH, *keep, F.explode(CARRIED).alias("_w")).select(*_PATH, *keep, F.col("_w.id").alias("terminal_wording_id"))
    return out if wordings is None else out.unionByName(_joined(paths.filter(F.col(CARRIED).isNull()), wordings, wording_id_col, keep))


def build_manifest(paths: DataFrame, wordings: DataFrame | None, replicates: int = 5, model: str = "model-a",
                   provider: str = "provider-a", temperature: float = 0.7,
                   wording_id_col: str = "wording_id") -> DataFrame:
    """M1 + M3 + M4: scenario x path x wording x replicate, all pending.

    ``wordings`` may be None if every path carries its own.
    """
    return expand_runs(plan_conditions(paths, wordings, wording_id_col), replicates, model, provider, temperature)


def expand_runs(conditions: DataFrame, replicates: int = 5, model: str = "model-a", provider: str = "provider-a",
                temperature: float = 0.7) -> DataFrame:
    """M2 + M3 + M4: the runs of each condition, pending unless the condition has a status; its other columns are kept, at the end."""
    j = expand_replicates(conditions.select("*", *_heads()), replicates)
    status = F.col("status") if "status" in conditions.columns else F.lit("pending")
    return j.select(
        _run_id(F.col("replicate_idx"), model).alias("run_id"),
        *_PATH, "terminal_wording_id",
        F.lit(model).alias("model"), F.lit(provider).alias("provider_requested"),
        F.lit(float(temperature)).alias("temperature"), _seed(F.col("replicate_idx")).alias("seed"),
        F.col("replicate_idx").cast("int").alias("replicate_idx"), status.alias("status"),
        *[F.lit(None).cast(typ).alias(name) for name, typ in OUTCOME_COLUMNS.items()],
        *[c for c in conditions.columns if c not in (*_PATH, "terminal_wording_id", "status")],
    )


def build_conditions(paths: DataFrame, wordings: DataFrame | None, replicates: int = 5, model: str = "model-a", provider: str = "provider-a",
                     temperature: float = 0.7, wording_id_col: str = "wording_id") -> DataFrame:
    """M1 + M3 + M4 by condition: the rows of ``build_manifest``, with a condition's runs as ``runs``: array<struct<run_id, seed, replicate_idx>>.

    Each path must be there once, as ``generate_paths`` makes them.  A wording that
    repeats is one condition whose runs repeat, so no condition is gathered by a shuffle.
    """
    if CARRIED in paths.columns:
        times = F.size(CARRIED) - F.size(F.array_remove(CARRIED, F.col("_w")))
        c = paths.select(*_PATH, CARRIED, F.array_distinct(CARRIED).alias("_each")).select(*_PATH, CARRIED, "_each", F.explode("_each").alias("_w")).select(
            *_PATH, F.col("_w.id").alias("terminal_wording_id"), F.when(F.size("_each") == F.size(CARRIED), 1).otherwise(times).alias("_times"))
        paths = paths.filter(F.col(CARRIED).isNull())
    else:
        c = None
    if wordings is not None:
        w = wordings.groupBy("scenario_id", wording_id_col).agg(F.count(F.lit(1)).cast("int").alias("_times"))
        rest = paths.select(*_PATH).join(w.withColumnRenamed(wording_id_col, "terminal_wording_id").hint("merge"), "scenario_id")
        c = rest.select(*_PATH, "terminal_wording_id", "_times") if c is None else c.unionByName(rest.select(*_PATH, "terminal_wording_id", "_times"))
    one = F.array(*[F.struct(_run_id(F.lit(r), model).alias("run_id"), _seed(F.lit(r)).alias("seed"), F.lit(r).alias("replicate_idx"))
                    for r in range(replicates)]) if replicates > 0 else F.array().cast("array<struct<run_id:string,seed:int,replicate_idx:int>>")
    runs = c.select("*", *_heads()).select(*_PATH, "terminal_wording_id", "_times", one.alias("_runs"))
    return runs.filter(F.lit(replicates > 0)).select(
        *_PATH, "terminal_wording_id", F.lit(model).alias("model"), F.lit(provider).alias("provider_requested"),
        F.lit(float(temperature)).alias("temperature"), F.lit("pending").alias("status"),
        F.when(F.col("_times") == 1, F.col("_runs")).otherwise(F.flatten(F.array_repeat("_runs", F.col("_times")))).alias("runs"))


def pending(manifest: DataFrame, status_col: str = "status") -> DataFrame:
    """M5: rows still pending."""
    return manifest.filter(F.col(status_col) == "pending")


def resume_set(manifest: DataFrame, current: DataFrame | None = None,
               retry_statuses: tuple[str, ...] = ("pending", "running", "failed")) -> DataFrame:
    """M6: runs to (re)dispatch: every run whose current status is retryable.

    ``current`` is the ledger's current state (L4); runs it does not know are
    taken from the manifest's own status.
    """
    if current is None:
        return manifest.filter(F.col("status").isin(*retry_statuses))
    cur = current.select("run_id", F.col("status").alias("_cur"))
    j = manifest.join(cur, "run_id", "left")
    return j.filter(F.coalesce("_cur", "status").isin(*retry_statuses)).drop("_cur")


def dispatch_order(manifest: DataFrame, n_batches: int = 8) -> DataFrame:
    """M7: reproducible shuffled order (``position`` from 1) and batches of equal size (``batch`` from 1).

    The order key is a hash of (run id, seed) - uncorrelated with scenario or
    arm, so drift during the run window is spread across conditions.  The order is
    total (ties by run id) and exact at any size: equal ranges of the hash and offsets, no
    global window, and no sample, for which the manifest would be built once more.
    """
    # A run id that is a hex digest travels as its 32 bytes, and the key, which it determines, not at all.
    digest = F.col("run_id").rlike(r"\A[0-9a-f]{64}\z")
    rest = [c for c in manifest.columns if c not in ("run_id", "seed")]
    packed = manifest.select(*rest, "seed", F.when(digest, F.unhex("run_id")).alias("_digest"),
                             F.when(F.coalesce(digest, F.lit(False)), None).otherwise(F.col("run_id")).alias("_name"))
    name = F.coalesce(F.lower(F.hex("_digest")), F.col("_name"))
    key = keyed_hash(name, F.col("seed"))
    placed, total = hash_positions(packed, key, [name])
    named = placed.select(*[name.alias("run_id") if c == "run_id" else F.col(c) for c in manifest.columns],
                          key.alias("dispatch_key"), "position")
    return named.withColumn("batch", equal_tiles(F.col("position"), total, n_batches))


def pilot_design(paths: DataFrame, wordings: DataFrame, scenario: str,
                 path_type: str | None = None) -> tuple[DataFrame, DataFrame]:
    """M8: restrict the design to one scenario (and optionally one path type) before M1."""
    p = paths.filter(F.col("scenario_id") == scenario)
    if path_type is not None:
        p = p.filter(F.col("path_type") == path_type)
    return p, wordings.filter(F.col("scenario_id") == scenario)


def resolve_paths(manifest: DataFrame, scenarios: DataFrame, paths: DataFrame) -> DataFrame:
    """M9, scenario and path (by perm id): ``turns``, and a null ``_s`` or ``_p`` where there is none.  Rows may be runs, conditions or paths."""
    s = scenarios.select("scenario_id", F.lit(True).alias("_s"))
    p = paths.select("scenario_id", "path_type", "perm_id", "turns", F.lit(True).alias("_p"))
    # All sides grow with the design: none is broadcast, however small its compressed files are.
    return (manifest.join(s.hint("merge"), "scenario_id", "left")
            .join(p.hint("merge"), ["scenario_id", "path_type", "perm_id"], "left"))


def resolve_wordings(found: DataFrame, wordings: DataFrame, wording_id_col: str = "wording_id") -> DataFrame:
    """M9, wording: ``wording_text`` for the runs or conditions of ``resolve_paths``, then ``resolve_error`` and ``status``."""
    w = wordings.select("scenario_id", F.col(wording_id_col).alias("terminal_wording_id"),
                        F.col("wording").alias("wording_text"), F.lit(True).alias("_w"))
    j = found.join(w.hint("merge"), ["scenario_id", "terminal_wording_id"], "left")
    reason = (F.when(F.col("_s").isNull(), "unknown scenario").when(F.col("_p").isNull(), "unknown path")
              .when(F.col("_w").isNull(), "unknown wording"))
    return (j.withColumn("resolve_error", reason)
            .withColumn("status", F.when(F.col("resolve_error").isNotNull(), "failed").otherwise(F.col("status")))
            .drop("_s", "_p", "_w"))


def resolve_manifest(manifest: DataFrame, scenarios: DataFrame, paths: DataFrame, wordings: DataFrame,
                     wording_id_col: str = "wording_id") -> DataFrame:
    """M9: look up scenario, path (by perm id) and wording for each run.

    Unresolved rows become ``failed`` with a reason; resolved rows carry the
    path turns and the wording text needed to build the prompt.
    """
    return resolve_wordings(resolve_paths(manifest, scenarios, paths), wordings, wording_id_col)


def resolve_design(planned: DataFrame, uncarried: DataFrame | None, scenarios: DataFrame, paths: DataFrame, wordings: DataFrame,
                   replicates: int = 5, model: str = "model-a", provider: str = "provider-a", temperature: float = 0.7,
                   wording_id_col: str = "wording_id", keep: list[str] | None = None) -> DataFrame:
    """M1 + M9: ``resolve_manifest`` of ``build_manifest(planned, uncarried, ...)``, the same rows.  ``keep`` names more columns of ``planned``.

    Runs of one condition share what they look up, so scenario and path are looked up once
    a path, the wording once a condition, and runs are expanded last: none is shuffled.
    """
    keep = keep or []
    keys = planned.select(*_PATH, *[c for c in (CARRIED,) if c in planned.columns], *keep, F.lit("pending").alias("status"))
    found = resolve_paths(keys, scenarios, paths)
    conditions = plan_conditions(found, uncarried, wording_id_col, ["status", "turns", "_s", "_p", *keep])
    return expand_runs(resolve_wordings(conditions, wordings, wording_id_col), replicates, model, provider, temperature)


def dispatch_count(manifest: DataFrame) -> DataFrame:
    """Dry-run count of pending rows."""
    return pending(manifest).agg(F.count(F.lit(1)).alias("n_pending"))


def planned_count(census: DataFrame, wordings: DataFrame, replicates: int) -> DataFrame:
    """M10 before there is a manifest: runs that ``build_manifest`` would make, from the path census (P15) and the wordings; no row is built."""
    words = wordings.groupBy("scenario_id").agg(F.count(F.lit(1)).alias("_w"))
    paths = census.groupBy("scenario_id").agg(F.sum("n_paths").alias("_p"))
    return paths.join(words, "scenario_id").agg((F.coalesce(F.sum(F.col("_p") * F.col("_w")), F.lit(0)) * max(replicates, 0)).alias("n_pending"))


def manifest_totals(manifest: DataFrame, status_col: str = "status") -> DataFrame:
    """Count per status plus the grand total (``status`` NULL on the total row)."""
    return manifest.rollup(status_col).agg(F.count(F.lit(1)).alias("n"))
