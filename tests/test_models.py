"""Models against small dense numpy fits."""
import numpy as np
import pandas as pd

from pathweave.operators import models as R

ARMS = ["direct", "sequential", "skipped"]


def _sim(seed=5, strata=12, per_cell=20):
    rng = np.random.default_rng(seed)
    rows = []
    for s in range(strata):
        b0, b1 = rng.normal(0, 0.15), rng.normal(0, 0.1)
        for a_i, a in enumerate(ARMS):
            for w in ("W1", "W2"):
                p = 0.45 + 0.05 * a_i + (0.03 if w == "W2" else 0) + b0 + (b1 if a == "sequential" else 0)
                for _ in range(per_cell):
                    rows.append((f"s{s:02d}", a, w, int(rng.random() < min(max(p, 0.02), 0.98))))
    return pd.DataFrame(rows, columns=["scenario_id", "path_type", "terminal_wording_id", "y"])


def _design(pdf, with_strata=True, interaction=False):
    cols = {"Intercept": np.ones(len(pdf))}
    for a in ARMS[1:]:
        cols[f"path_type[T.{a}]"] = (pdf.path_type == a).astype(float).to_numpy()
    cols["terminal_wording_id[T.W2]"] = (pdf.terminal_wording_id == "W2").astype(float).to_numpy()
    if interaction:
        for a in ARMS[1:]:
            cols[f"path_type[T.{a}]:terminal_wording_id[T.W2]"] = cols[f"path_type[T.{a}]"] * cols[
                "terminal_wording_id[T.W2]"]
    if with_strata:
        for s in sorted(pdf.scenario_id.unique())[1:]:
            cols[f"scenario_id[T.{s}]"] = (pdf.scenario_id == s).astype(float).to_numpy()
    return pd.DataFrame(cols)


def _irls(X, y, iters=50):
    b = np.zeros(X.shape[1])
    for _ in range(iters):
        mu = 1 / (1 + np.exp(-X @ b))
        W = mu * (1 - mu)
        b = np.linalg.solve(X.T @ (X * W[:, None]), X.T @ (W * (X @ b) + (y - mu)))  # IRLS step
    mu = 1 / (1 + np.exp(-X @ b))
    cov = np.linalg.inv(X.T @ (X * (mu * (1 - mu))[:, None]))
    return b, np.sqrt(np.diag(cov))


def test_grouped_logistic_equals_row_level_fit(spark):
    pdf = _sim()
    df = spark.createDataFrame(pdf.rename(columns={"y": "verdict"}))
    coefs = {r.term: r for r in R.logistic_fixed_effects(df, arm_levels=ARMS).collect()}
    X = _design(pdf, interaction=True)
    b, se = _irls(X.to_numpy(), pdf.y.to_numpy().astype(float))
    for name, bi, si in zip(X.columns, b, se):
        assert abs(coefs[name].estimate - bi) < 1e-6, name
        assert abs(coefs[name].std_err - si) < 1e-5, name


def _reml_dense(pdf, theta):
    """Profiled REML at relative Cholesky factor ``theta`` from explicit V matrices."""
    X = _design(pdf, with_strata=False).to_numpy()
    y = pdf.y.to_numpy().astype(float)
    L = np.array([[theta[0], 0], [theta[1], theta[2]]])
    A = np.zeros((X.shape[1], X.shape[1]))
    c = np.zeros(X.shape[1])
    s = 0.0
    ld = 0.0
    for _, idx in pdf.groupby("scenario_id").indices.items():
        Xg, yg = X[idx], y[idx]
        Zg = np.column_stack([np.ones(len(idx)), (pdf.path_type.to_numpy()[idx] == "sequential").astype(float)])
        Vg = np.eye(len(idx)) + Zg @ L @ L.T @ Zg.T
        Vi = np.linalg.inv(Vg)
        A += Xg.T @ Vi @ Xg
        c += Xg.T @ Vi @ yg
        s += yg @ Vi @ yg
        ld += np.linalg.slogdet(Vg)[1]
    beta = np.linalg.solve(A, c)
    dof = len(y) - X.shape[1]
    sigma2 = (s - c @ beta) / dof
    return -0.5 * (dof * np.log(sigma2) + ld + np.linalg.slogdet(A)[1]), beta, sigma2


def test_random_slope_reml_optimum_and_gls(spark):
    pdf = _sim(seed=9, strata=10, per_cell=8)
    df = spark.createDataFrame(pdf)
    fit = R.random_slope_model(df, outcome_col="y", arm_levels=ARMS)
    info = fit["info"].first()
    assert info.converged
    var = fit["variance"].first()
    sigma2 = var.residual_var
    D = np.array([[var.intercept_var, var.covariance], [var.covariance, var.slope_var]]) / sigma2
    # recover the Cholesky factor and check the objective is maximal nearby
    l11 = np.sqrt(max(D[0, 0], 0))
    l21 = D[0, 1] / l11 if l11 > 0 else 0.0
    l22 = np.sqrt(max(D[1, 1] - l21 ** 2, 0))
    theta = np.array([l11, l21, l22])
    best, beta, s2 = _reml_dense(pdf, theta)
    assert abs(s2 - sigma2) < 1e-8
    fixed = {r.term: r.estimate for r in fit["fixed"].collect()}
    names = list(_design(pdf, with_strata=False).columns)
    for n, b in zip(names, beta):
        assert abs(fixed[n] - b) < 1e-8, n
    for delta in np.eye(3) * 1e-3:
        for sign in (1, -1):
            assert _reml_dense(pdf, theta + sign * delta)[0] <= best + 1e-9
    blups = fit["blups"].count()
    assert blups == 10


def _blocks(means, per_arm, noise, seed):
    """One factor value, two arms; y = stratum mean + noise."""
    rng = np.random.default_rng(seed)
    rows = [(f"s{i:04d}", a, "W1", float(m + rng.normal(0, noise))) for i, m in enumerate(means) for a in ("direct", "sequential")
            for _ in range(per_arm)]
    return pd.DataFrame(rows, columns=["scenario_id", "path_type", "terminal_wording_id", "y"])


def test_random_slope_finds_a_large_variance_ratio(spark):
    means = np.random.default_rng(1).normal(0, 5, 300)
    fit = R.random_slope_model(spark.createDataFrame(_blocks(means, 6, 1.0, 2)), outcome_col="y", arm_levels=["direct", "sequential"])
    var, info = fit["variance"].first(), fit["info"].first()
    assert info.converged
    assert abs(var.intercept_var / means.var(ddof=1) - 1) < 0.1 and abs(var.residual_var - 1) < 0.1


def test_random_slope_of_strata_at_floor_and_ceiling(spark):
    rng = np.random.default_rng(3)
    rows = [(f"s{i:03d}", a, "W1", float(rng.random() < (0.005, 0.995)[i % 2])) for i in range(200) for a in ("direct", "sequential") for _ in range(30)]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["scenario_id", "path_type", "terminal_wording_id", "y"]))
    fit = R.random_slope_model(df, outcome_col="y", arm_levels=["direct", "sequential"])
    assert fit["info"].first().converged and abs(fit["variance"].first().intercept_var - 0.245) < 0.02


def test_an_unfinished_search_says_so(spark):
    means = np.random.default_rng(1).normal(0, 5, 50)
    fit = R.random_slope_model(spark.createDataFrame(_blocks(means, 4, 1.0, 2)), outcome_col="y", arm_levels=["direct", "sequential"], max_rounds=1)
    assert not fit["info"].first().converged


def test_gls_equations_hold_at_the_fixed_effects(spark):
    """Certificate of R4: X'V^-1 (y - X beta) = 0 with the fitted variances, from explicit V matrices."""
    pdf = _sim(seed=4, strata=15, per_cell=6)
    fit = R.random_slope_model(spark.createDataFrame(pdf), outcome_col="y", arm_levels=ARMS)
    var = fit["variance"].first()
    D = np.array([[var.intercept_var, var.covariance], [var.covariance, var.slope_var]])
    X = _design(pdf, with_strata=False)
    beta = np.array([{r.term: r.estimate for r in fit["fixed"].collect()}[c] for c in X.columns])
    total = np.zeros(X.shape[1])
    for idx in pdf.groupby("scenario_id").indices.values():
        Z = np.column_stack([np.ones(len(idx)), (pdf.path_type.to_numpy()[idx] == "sequential").astype(float)])
        V = Z @ D @ Z.T + var.residual_var * np.eye(len(idx))
        total += X.to_numpy()[idx].T @ np.linalg.solve(V, pdf.y.to_numpy()[idx] - X.to_numpy()[idx] @ beta)
    assert np.abs(total).max() < 1e-6


def test_logistic_with_many_strata_and_saturated_ones(spark):
    """50,000 strata; margins of fitted and observed successes agree, strata of one outcome included."""
    n = 50_000
    from pyspark.sql import functions as F
    df = (spark.range(n).select(F.col("id").cast("string").alias("scenario_id"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("i"))
          .withColumn("path_type", F.element_at(F.array(*map(F.lit, ARMS)), (F.col("i") % 3 + 1).cast("int")))
          .withColumn("terminal_wording_id", F.when(F.col("i") < 4, "W1").otherwise("W2"))
          .withColumn("verdict", (F.abs(F.xxhash64("scenario_id", "i")) % 100 < 30 + 10 * (F.col("i") % 3)).cast("int")))
    got = R.fitted_margins(df, arm_levels=ARMS)
    assert got.filter("margin = 'stratum'").count() == n
    assert got.filter("abs(observed - fitted) > 1e-5").count() == 0
