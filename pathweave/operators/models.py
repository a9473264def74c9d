"""Models fitted on Spark from cell-level sufficient statistics.

All predictors are categorical, so runs collapse to cells (stratum x arm x
factor) with counts before any fitting: exact for a grouped binomial GLM and
for a linear mixed model with group-constant designs.  The driver only ever
sees coefficient vectors and p x p sums, never rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.normal import two_sided_p
from ..session import cut_lineage
from .aggregates import factor_values
from .paths import PATH_LEVELS

Z975 = 1.959963984540054
SATURATED = 40.0  # logit at which a stratum of only successes or failures is held
SCALES = (0.0, 0.03, 0.1, 0.3, 1.0, 3.0, 10.0, 30.0, 100.0)  # relative standard deviations the search starts from


# --- R8 -------------------------------------------------------------------------

def raw_stratum_effects(df: DataFrame, stratum_col: str = "scenario_id", arm_col: str = "path_type",
                        outcome_col: str = "verdict_numeric", treated: str = "sequential",
                        baseline: str = "direct", dims: tuple[str, ...] = ()) -> DataFrame:
    """p(treated) - p(baseline) per stratum (unshrunken), one conditional aggregation."""
    y = F.col(outcome_col).cast("double")
    aggs = [(F.avg(F.when(F.col(arm_col) == treated, y)) - F.avg(F.when(F.col(arm_col) == baseline, y)))
            .alias("effect")]
    aggs += [F.min(c).alias(c) for c in dims]
    return df.groupBy(stratum_col).agg(*aggs)


# --- design matrices ----------------------------------------------------------------

def _dummies(col: str, levels: list[str], prefix: str) -> list[tuple[str, object]]:
    """Treatment coding: one 0/1 column per non-reference level."""
    return [(f"{prefix}[T.{v}]", (F.col(col) == v).cast("double")) for v in levels[1:]]


def _stratum_cells(df: DataFrame, stratum_col: str, arm_col: str, factor_col: str, outcome_col: str,
                   arms: list[str], factors: list[str]) -> DataFrame:
    """One row per stratum with its cells as arrays (at most arms x factor values long).

    ``a`` and ``f`` number the levels (0: the reference), ``n`` are trials, ``k``
    successes.  A run whose arm or factor value isn't listed is missing data.
    """
    def number(col, levels):
        return F.array_position(F.array(*[F.lit(v) for v in levels]), F.col(col)) - 1

    d = df.filter(F.col(outcome_col).isNotNull() & F.col(stratum_col).isNotNull() & F.col(arm_col).isin(*arms)
                  & F.col(factor_col).isin(*factors))
    cells = d.groupBy(F.col(stratum_col).cast("string").alias("stratum"), number(arm_col, arms).alias("a"),
                      number(factor_col, factors).alias("f")).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.col(outcome_col).cast("double")).alias("k"))
    return (cells.groupBy("stratum").agg(F.array_sort(F.collect_list(F.struct("a", "f", "n", "k"))).alias("c"))
            .select("stratum", "c.a", "c.f", "c.n", "c.k"))


def _profile(pdf: pd.DataFrame, terms: list[tuple[int, int]], beta: np.ndarray):
    """The strata effects that maximise the likelihood for given ``beta``, and what the Newton step needs.

    A term is (arm number, factor number), 0 for "any".  A stratum's effect has an
    equation of its own, so it is solved right here and never becomes a column.
    """
    size = pdf["n"].str.len().to_numpy()
    g = np.repeat(np.arange(len(pdf)), size)
    a, f, n, k = (np.concatenate(pdf[c].to_numpy()).astype(float) for c in ("a", "f", "n", "k"))
    X = np.stack([((a == i) | (i == 0)) & ((f == j) | (j == 0)) for i, j in terms], axis=1).astype(float)
    total = lambda v: np.bincount(g, v, len(pdf))
    N, K = total(n), total(k)
    offset = X @ beta
    fixed = np.where(K == 0, -SATURATED, np.where(K == N, SATURATED, np.nan))  # all failures or all successes
    alpha = np.where(np.isnan(fixed), np.log((K + 0.5) / (N - K + 0.5)) - total(n * offset) / N, fixed)
    for _ in range(100):
        mu = 1 / (1 + np.exp(-np.clip(alpha[g] + offset, -700, 700)))
        w = n * mu * (1 - mu)
        R, W = total(k - n * mu), np.maximum(total(w), 1e-300)
        if np.abs(np.where(np.isnan(fixed), R, 0)).max(initial=0) < 1e-11 * max(1.0, N.max(initial=1)):
            break
        alpha = np.where(np.isnan(fixed), alpha + np.clip(R / W, -4, 4), fixed)
    wx = np.stack([total(w * X[:, i]) for i in range(len(terms))], axis=1)
    return {"X": X, "g": g, "n": n, "k": k, "mu": mu, "w": w, "alpha": alpha, "W": W, "v": wx / W[:, None], "wx": wx, "a": a, "f": f}


def _summed(rows: DataFrame, body, width: int) -> np.ndarray:
    """Sum of the vectors that ``body`` makes of each batch, added up on the executors."""
    def run(batches):
        total = np.zeros(width)
        for pdf in batches:
            if len(pdf):
                total += body(pdf)
        yield pd.DataFrame({"at": np.arange(width), "v": total})

    sums = rows.mapInPandas(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(width)
    for r in sums:
        out[r["at"]] = r["v"]
    return out


def _fit_strata_logit(rows: DataFrame, terms: list[tuple[int, int]], max_rounds: int = 50):
    """Profile Newton: (beta, covariance of beta).  The driver only sees p x p sums."""
    p = len(terms)

    def sums(beta):
        def body(pdf):
            s = _profile(pdf, terms, beta)
            X, w = s["X"], s["w"]
            score = X.T @ (s["k"] - s["n"] * s["mu"])
            schur = X.T @ (X * w[:, None]) - s["wx"].T @ s["v"]
            eta = s["alpha"][s["g"]] + X @ beta
            likelihood = (s["k"] * eta - s["n"] * np.logaddexp(0, eta)).sum()
            return np.concatenate([schur.ravel(), score, [likelihood]])
        v = _summed(rows, body, p * p + p + 1)
        return v[:p * p].reshape(p, p), v[p * p:-1], v[-1]

    beta = np.zeros(p)
    schur, score, likelihood = sums(beta)
    for _ in range(max_rounds):
        step = np.linalg.pinv(schur) @ score
        if score @ step < 1e-16 * max(1.0, abs(likelihood)):
            break
        for _ in range(30):
            after = sums(beta + step)
            if after[2] >= likelihood - 1e-10 * abs(likelihood):
                break
            step = step / 2
        beta = beta + step
        schur, score, likelihood = after
        if np.abs(beta).max() > SATURATED:
            break
    return beta, np.linalg.pinv(schur)


_COEF_SCHEMA = "term string, estimate double, std_err double"


def _coefficients(df: DataFrame) -> DataFrame:
    """Add z, p, interval and the separation flag to (term, estimate, std_err)."""
    z = F.col("estimate") / F.col("std_err")
    return df.select("term", "estimate", "std_err", z.alias("z_value"), two_sided_p(z).alias("p_value"),
                     (F.col("estimate") - Z975 * F.col("std_err")).alias("ci_lo"),
                     (F.col("estimate") + Z975 * F.col("std_err")).alias("ci_hi"),
                     ((F.abs("estimate") > 15) | (F.col("std_err") > 1e3)).alias("separated"))


def _fit_cells(rows: DataFrame, terms: list[tuple[str, int, int]], stratum_col: str) -> DataFrame:
    """Coefficients of the terms that occur, the intercept (first stratum) and every other stratum against it."""
    spark = rows.sparkSession
    seen = {(r["a"], r["f"]) for r in rows.select(F.explode(F.arrays_zip("a", "f")).alias("x")).select("x.*").distinct().collect()}
    terms = [t for t in terms if any((t[1] in (0, a)) and (t[2] in (0, f)) for a, f in seen)]  # an absent level has no effect
    keys = [(i, j) for _, i, j in terms]
    beta, cov = _fit_strata_logit(rows, keys)

    def effects(batches):
        for pdf in batches:
            if len(pdf):
                s = _profile(pdf, keys, beta)
                yield pd.DataFrame({"stratum": pdf["stratum"], "alpha": s["alpha"], "W": s["W"], "v": list(s["v"])})

    strata = rows.mapInPandas(effects, "stratum string, alpha double, W double, v array<double>")
    first = strata.orderBy("stratum").first()
    v0 = np.array(first["v"])

    def against_first(batches):
        for pdf in batches:
            if len(pdf):
                d = np.stack(pdf["v"].to_numpy()) - v0
                var = 1 / pdf["W"].to_numpy() + 1 / first["W"] + np.einsum("gi,ij,gj->g", d, cov, d)
                yield pd.DataFrame({"term": [f"{stratum_col}[T.{s}]" for s in pdf["stratum"]], "estimate": pdf["alpha"] - first["alpha"],
                                    "std_err": np.sqrt(var)})

    others = strata.filter(F.col("stratum") != first["stratum"]).mapInPandas(against_first, _COEF_SCHEMA)
    se = np.sqrt(np.diag(cov))
    named = [(name, float(b), float(e)) for (name, _, _), b, e in zip(terms, beta, se)]
    named.append(("Intercept", float(first["alpha"]), float(np.sqrt(1 / first["W"] + v0 @ cov @ v0))))
    return _coefficients(spark.createDataFrame(named, _COEF_SCHEMA).unionByName(others))


def _terms(arm_col: str, arms: list[str], factor_col: str, factors: list[str], interaction: bool) -> list[tuple[str, int, int]]:
    """(name, arm number, factor number) in treatment coding; 0 stands for any level."""
    a_terms = [(f"{arm_col}[T.{v}]", i, 0) for i, v in enumerate(arms) if i]
    f_terms = [(f"{factor_col}[T.{v}]", 0, j) for j, v in enumerate(factors) if j]
    both = [(f"{an}:{fn}", i, j) for an, i, _ in a_terms for fn, _, j in f_terms] if interaction else []
    return a_terms + f_terms + both


def logistic_fixed_effects(df: DataFrame, arm_col: str = "path_type", factor_col: str = "terminal_wording_id",
                           stratum_col: str = "scenario_id", outcome_col: str = "verdict",
                           arm_levels: list[str] | None = None, interaction: bool = True) -> DataFrame:
    """``outcome ~ arm * factor + stratum`` (treatment coding, first level reference).

    Runs are collapsed to cells first, so the fit sees (strata x arms x factor
    values) rows whatever the run count.  Strata effects are eliminated stratum by
    stratum, so their number is not limited.
    """
    arms = arm_levels or PATH_LEVELS
    factors = factor_values(df.filter(F.col(outcome_col).isNotNull()), factor_col)
    rows = cut_lineage(_stratum_cells(df, stratum_col, arm_col, factor_col, outcome_col, arms, factors), "cells")
    return _fit_cells(rows, _terms(arm_col, arms, factor_col, factors, interaction), stratum_col)


def fitted_margins(df: DataFrame, arm_col: str = "path_type", factor_col: str = "terminal_wording_id",
                   stratum_col: str = "scenario_id", outcome_col: str = "verdict", arm_levels: list[str] | None = None) -> DataFrame:
    """Certificate of R1: (margin, level, n, observed, fitted) successes by stratum and by arm x factor value.

    At the maximum of the likelihood, fitted and observed successes agree in every margin.
    """
    arms = arm_levels or PATH_LEVELS
    factors = factor_values(df.filter(F.col(outcome_col).isNotNull()), factor_col)
    rows = cut_lineage(_stratum_cells(df, stratum_col, arm_col, factor_col, outcome_col, arms, factors), "cells")
    keys = [(i, j) for _, i, j in _terms(arm_col, arms, factor_col, factors, True)]
    beta, _ = _fit_strata_logit(rows, keys)

    def cells(batches):
        for pdf in batches:
            if len(pdf):
                s = _profile(pdf, keys, beta)
                yield pd.DataFrame({"stratum": pdf["stratum"].to_numpy()[s["g"]], "cell": [f"{arms[int(a)]}|{factors[int(f)]}" for a, f in zip(s["a"], s["f"])],
                                    "n": s["n"], "observed": s["k"], "fitted": s["n"] * s["mu"]})

    c = rows.mapInPandas(cells, "stratum string, cell string, n double, observed double, fitted double")
    level = F.explode(F.array(F.struct(F.lit("stratum").alias("margin"), F.col("stratum").alias("level")),
                              F.struct(F.lit("cell").alias("margin"), F.col("cell").alias("level")))).alias("m")
    return (c.select(level, "n", "observed", "fitted").groupBy("m.margin", "m.level")
            .agg(F.sum("n").cast("long").alias("n"), F.sum("observed").alias("observed"), F.sum("fitted").alias("fitted")))


def _stars(p):
    return (F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise(""))


def path_effect_table(coefs: DataFrame, arm_col: str = "path_type") -> DataFrame:
    """R2: arm terms with significance stars, sorted by name."""
    return (coefs.filter(F.col("term").contains(arm_col))
            .select("term", "estimate", "ci_lo", "ci_hi", "p_value", _stars(F.col("p_value")).alias("stars"))
            .orderBy("term"))


def logistic_by_factor(df: DataFrame, arm_col: str = "path_type", factor_col: str = "terminal_wording_id",
                       stratum_col: str = "scenario_id", outcome_col: str = "verdict",
                       arm_levels: list[str] | None = None, min_strata: int = 3) -> DataFrame:
    """``outcome ~ arm + stratum`` inside each factor value.

    Factor values are a handful of levels, each with a fit of its own.  A value with fewer than ``min_strata`` strata is skipped and a failed
    fit is reported, both through the ``status`` column.
    """
    arms = arm_levels or PATH_LEVELS
    spark = df.sparkSession
    known = df.filter(F.col(outcome_col).isNotNull())
    schema = ("wording string, status string, n_strata long, term string, estimate double, std_err double, "
              "z_value double, p_value double, ci_lo double, ci_hi double, separated boolean")
    out = spark.createDataFrame([], schema)
    for w in factor_values(known, factor_col):
        rows = cut_lineage(_stratum_cells(known.filter(F.col(factor_col) == w), stratum_col, arm_col, factor_col, outcome_col, arms, [w]), "cells")
        strata = rows.count()
        if strata < min_strata:
            part = spark.createDataFrame([(w, "skipped: too few strata", strata) + (None,) * 8], schema)
        else:
            try:
                coefs = _fit_cells(rows, _terms(arm_col, arms, factor_col, [w], False), stratum_col)
                part = coefs.select(F.lit(w).alias("wording"), F.lit("ok").alias("status"), F.lit(strata).cast("long").alias("n_strata"), "*")
            except np.linalg.LinAlgError as exc:  # reported, the other values go on
                part = spark.createDataFrame([(w, f"failed: {exc}", strata) + (None,) * 8], schema)
        out = out.unionByName(part)
    return out


# --- R4-R7: random intercept + random slope linear mixed model -------------------------

def _lmm_design(df: DataFrame, arm_col: str, factor_col: str, stratum_col: str, outcome_col: str,
                arm_levels: list[str], treated: str):
    cells = df.filter(F.col(arm_col).isin(*arm_levels)).groupBy(stratum_col, arm_col, factor_col).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.col(outcome_col).cast("double")).alias("sy"),
        F.sum(F.col(outcome_col).cast("double") ** 2).alias("syy"))
    factors = factor_values(cells, factor_col)
    x_terms = [("Intercept", F.lit(1.0))] + _dummies(arm_col, arm_levels, arm_col) + _dummies(factor_col, factors, factor_col)
    z = [F.lit(1.0), (F.col(arm_col) == treated).cast("double")]
    xs = [c for _, c in x_terms]
    p = len(xs)
    n, sy = F.col("n"), F.col("sy")
    aggs = [F.sum(n).alias("N"), F.sum("syy").alias("Syy")]
    aggs += [F.sum(n * xs[i] * xs[j]).alias(f"xx_{i}_{j}") for i in range(p) for j in range(p)]
    aggs += [F.sum(n * xs[i] * z[j]).alias(f"xz_{i}_{j}") for i in range(p) for j in range(2)]
    aggs += [F.sum(n * z[i] * z[j]).alias(f"zz_{i}_{j}") for i in range(2) for j in range(2)]
    aggs += [F.sum(sy * xs[i]).alias(f"xy_{i}") for i in range(p)]
    aggs += [F.sum(sy * z[i]).alias(f"zy_{i}") for i in range(2)]
    stats = cells.groupBy(F.col(stratum_col).alias("group")).agg(*aggs)
    return stats, [name for name, _ in x_terms], p


def _unpack(pdf: pd.DataFrame, p: int):
    g = len(pdf)
    xx = np.stack([pdf[f"xx_{i}_{j}"].to_numpy() for i in range(p) for j in range(p)], 1).reshape(g, p, p)
    xz = np.stack([pdf[f"xz_{i}_{j}"].to_numpy() for i in range(p) for j in range(2)], 1).reshape(g, p, 2)
    zz = np.stack([pdf[f"zz_{i}_{j}"].to_numpy() for i in range(2) for j in range(2)], 1).reshape(g, 2, 2)
    xy = np.stack([pdf[f"xy_{i}"].to_numpy() for i in range(p)], 1)
    zy = np.stack([pdf[f"zy_{i}"].to_numpy() for i in range(2)], 1)
    return xx, xz, zz, xy, zy, pdf["Syy"].to_numpy(), pdf["N"].to_numpy()


def _lower(theta):
    l11, l21, l22 = theta
    return np.array([[l11, 0.0], [l21, l22]])


def _group_terms(stats, theta):
    """Per-group Woodbury pieces for relative covariance Psi = L L' (sigma^2 = 1 scale)."""
    xx, xz, zz, xy, zy, syy, _ = stats
    L = _lower(theta)
    K = np.eye(2)[None] + np.einsum("ji,gjk,kl->gil", L, zz, L)
    Kinv = np.linalg.inv(K)
    M = np.einsum("ij,gjk,kl->gil", L, Kinv, L.T)  # L K^-1 L'
    xzM = np.einsum("gij,gjk->gik", xz, M)
    A = xx - np.einsum("gik,gjk->gij", xzM, xz)
    c = xy - np.einsum("gik,gk->gi", xzM, zy)
    s = syy - np.einsum("gi,gij,gj->g", zy, M, zy)
    ld = np.log(np.linalg.det(K))
    return A, c, s, ld, M


def _log_likelihoods(stats_df: DataFrame, p: int, points, reml: bool = True) -> list:
    """(REML or ML log-likelihood, (beta, sigma2, inverse of A)) at every point, one distributed pass."""
    width = p * p + p + 3

    def body(pdf):
        stats, out = _unpack(pdf, p), []
        for theta in points:
            A, c, s, ld, _ = _group_terms(stats, theta)
            out.append(np.concatenate([A.sum(0).ravel(), c.sum(0), [s.sum(), ld.sum(), stats[6].sum()]]))
        return np.concatenate(out)

    results = []
    for v in _summed(stats_df, body, width * len(points)).reshape(len(points), width):
        A, c, (s, ld, N) = v[:p * p].reshape(p, p), v[p * p:p * p + p], v[p * p + p:]
        sign, logdet = np.linalg.slogdet(A)
        if sign <= 0 or not np.isfinite(v).all():
            results.append((-np.inf, None))
            continue
        inverse = np.linalg.inv(A)
        beta = inverse @ c
        dof = N - p if reml else N
        sigma2 = max((s - c @ beta) / dof, 1e-300)
        results.append((-0.5 * (dof * math.log(sigma2) + ld + (logdet if reml else 0.0)), (beta, sigma2, inverse)))
    return results


def _score(stats_df: DataFrame, p: int, theta, beta, sigma2, inverse, reml: bool):
    """Gradient in (l11, l21, l22) and Fisher information, from 2 x 2 sums over the strata."""
    def body(pdf):
        xx, xz, zz, xy, zy, _, _ = stats = _unpack(pdf, p)
        M = _group_terms(stats, theta)[4]
        zzM = zz @ M
        Wz = zz - zzM @ zz                                   # Z'V^-1 Z
        r = zy - np.einsum("gik,i->gk", xz, beta)
        q = r - np.einsum("gij,gj->gi", zzM, r)              # Z'V^-1 (y - X beta)
        U = xz - xz @ M @ zz                                 # X'V^-1 Z
        UAU = np.einsum("gik,ij,gjl->gkl", U, inverse, U)
        return np.concatenate([Wz.sum(0).ravel(), np.einsum("gi,gj->ij", q, q).ravel(), UAU.sum(0).ravel(),
                               np.einsum("gab,gcd->abcd", Wz, Wz).ravel()])

    v = _summed(stats_df, body, 28)
    G = 0.5 * (v[4:8].reshape(2, 2) / sigma2 - v[:4].reshape(2, 2) + (v[8:12].reshape(2, 2) if reml else 0))
    WW = v[12:].reshape(2, 2, 2, 2)
    L = _lower(theta)
    places = ((0, 0), (1, 0), (1, 1))
    S = []
    for i, j in places:
        E = np.zeros((2, 2))
        E[i, j] = 1
        S.append(E @ L.T + L @ E.T)  # derivative of L L'
    gradient = np.array([np.sum(G * s) for s in S])
    information = np.array([[0.5 * np.einsum("abcd,bc,da", WW, s, t) for t in S] for s in S])
    return gradient, information, G


def _maximise(stats_df: DataFrame, p: int, reml: bool, tol: float, max_rounds: int):
    """Fisher scoring with a line search; theta is not bounded.

    A round is two jobs: the score, and the likelihood at a set of damped and scaled
    steps (and with each variance set to zero or freed again).  It has converged when the
    gradient, scaled by the parameters, is below ``tol`` and no variance that
    sits at zero wants to grow.
    """
    grid = [(a, 0.0, b) for a in SCALES for b in SCALES]
    found = _log_likelihoods(stats_df, p, grid, reml)
    at = max(range(len(grid)), key=lambda k: found[k][0])
    theta, (best, fit) = np.array(grid[at]), found[at]
    scaled = np.inf
    for rounds in range(1, max_rounds + 1):
        gradient, information, G = _score(stats_df, p, theta, *fit, reml)
        wants = [G[1, 1] > tol and theta[2] == 0, G[0, 0] > tol and theta[0] == 0 and theta[1] == 0]
        scaled = float(np.max(np.abs(gradient) * np.maximum(np.abs(theta), 1e-3)))
        if scaled < tol and not any(wants):
            return theta, best, fit, rounds, scaled, True
        points = []
        for damping in (1e-12, 1e-3, 1e-1, 10.0):
            step = np.linalg.solve(information + damping * (np.diag(np.diag(information)) + 1e-9 * np.eye(3)), gradient)
            points += [theta + t * step for t in (4.0, 2.0, 1.0, 0.5, 0.25, 0.06, 0.015, 0.002)]
        for k in (0, 2):
            for v in (0.0, 0.01, 0.1, theta[k] / 2, theta[k] / 10):
                other = theta.copy()
                other[k] = v
                points.append(other)
        found = _log_likelihoods(stats_df, p, [tuple(x) for x in points], reml)
        k = max(range(len(points)), key=lambda i: found[i][0])
        if found[k][0] <= best:  # nothing better within rounding: converged only if the gradient says so
            return theta, best, fit, rounds, scaled, scaled < 100 * tol and not any(wants)
        theta, (best, fit) = points[k], found[k]
    return theta, best, fit, max_rounds, scaled, False


def random_slope_model(df: DataFrame, arm_col: str = "path_type", factor_col: str = "terminal_wording_id",
                       stratum_col: str = "scenario_id", outcome_col: str = "verdict_numeric",
                       treated: str = "sequential", arm_levels: list[str] | None = None, reml: bool = True,
                       tol: float = 1e-5, max_rounds: int = 60):
    """``y ~ arm + factor + (1 + treated | stratum)``, linear, REML by default.

    Per-stratum sufficient statistics are one aggregation; the variance
    parameters (relative Cholesky factor of D) are found by Fisher scoring on
    them (``_maximise``).  Returns a dict of DataFrames: ``fixed``, ``variance``,
    ``blups`` and the fit ``info``.
    """
    arms = arm_levels or PATH_LEVELS
    spark = df.sparkSession
    stats, names, p = _lmm_design(df, arm_col, factor_col, stratum_col, outcome_col, arms, treated)
    stats = cut_lineage(stats, "strata")  # one row of sums per stratum, read in every round
    best, best_ll, fit, rounds, scaled, converged = _maximise(stats, p, reml, tol, max_rounds)
    beta, sigma2, Ainv = fit
    L = _lower(best)
    D = sigma2 * (L @ L.T)
    se = np.sqrt(np.diag(sigma2 * Ainv))
    z = beta / se
    fixed = spark.createDataFrame(
        [(n, float(b), float(e), float(zz)) for n, b, e, zz in zip(names, beta, se, z)],
        "term string, estimate double, std_err double, z_value double")
    fixed = (fixed.withColumn("p_value", two_sided_p(F.col("z_value")))
             .withColumn("ci_lo", F.col("estimate") - Z975 * F.col("std_err"))
             .withColumn("ci_hi", F.col("estimate") + Z975 * F.col("std_err")))
    variance = spark.createDataFrame([(float(D[0, 0]), float(D[1, 1]), float(D[0, 1]), float(sigma2))],
                                     "intercept_var double, slope_var double, covariance double, residual_var double")
    blups = _blups(stats, p, best, beta)
    info = spark.createDataFrame([(int(rounds), scaled, converged, float(best_ll),
                                   bool(min(D[0, 0], D[1, 1]) < 1e-8), "REML" if reml else "ML")],
                                 "rounds int, gradient double, converged boolean, loglik double, "
                                 "boundary boolean, method string")
    return {"fixed": fixed, "variance": variance, "blups": blups, "info": info,
            "treated_term": f"{arm_col}[T.{treated}]", "stats": stats}


def _blups(stats: DataFrame, p: int, theta, beta) -> DataFrame:
    """Posterior means of each stratum's intercept and slope deviations."""
    th = tuple(float(t) for t in theta)
    b = np.asarray(beta, dtype=float)

    def run(it):
        for pdf in it:
            if pdf.empty:
                continue
            st = _unpack(pdf, p)
            _, _, _, _, M = _group_terms(st, th)
            xz, zy = st[1], st[4]
            r = zy - np.einsum("gik,i->gk", xz, b)
            u = np.einsum("gij,gj->gi", M, r)
            yield pd.DataFrame({"scenario_id": pdf["group"].astype(str), "random_intercept": u[:, 0],
                                "random_slope_sequential": u[:, 1]})
    return stats.mapInPandas(run, "scenario_id string, random_intercept double, random_slope_sequential double")


def conditional_effects(fit: dict, classes: DataFrame, key: str = "scenario_id",
                        class_col: str = "independence_class") -> DataFrame:
    """Fixed treated effect + each stratum's random slope, class attached (left join)."""
    fixed = fit["fixed"].filter(F.col("term") == fit["treated_term"]).select(
        F.col("estimate").alias("fixed_sequential_effect"))
    blups = fit["blups"].crossJoin(F.broadcast(fixed))  # one-row side: row concatenation
    cls = classes.groupBy(key).agg(F.min(class_col).alias(class_col))
    return (blups.withColumn("conditional_sequential_effect",
                             F.col("fixed_sequential_effect") + F.col("random_slope_sequential"))
            .join(cls, key, "left"))
