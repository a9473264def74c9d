"""Normal-distribution helpers as column expressions.

Spark has no ``erf``; the upper tail uses the Abramowitz-Stegun 7.1.26
rational approximation of ``erfc`` (absolute error below 1.5e-7), so the
p-values, powers and effect sizes below stay JVM-side and vectorised.
Quantiles are scalars and are computed once on the driver.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

# Abramowitz & Stegun 7.1.26 coefficients (published constants).
_P = 0.3275911
_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def _erfc_nonneg(x: Column) -> Column:
    t = 1.0 / (1.0 + _P * x)
    poly = t * (_A[0] + t * (_A[1] + t * (_A[2] + t * (_A[3] + t * _A[4]))))
    return poly * F.exp(-x * x)


def norm_sf(z: Column) -> Column:
    """Upper tail P(Z > z)."""
    x = F.abs(z) / math.sqrt(2.0)
    upper = 0.5 * _erfc_nonneg(x)
    return F.when(z >= 0, upper).otherwise(1.0 - upper)


def norm_cdf(z: Column) -> Column:
    return 1.0 - norm_sf(z)


def two_sided_p(z: Column) -> Column:
    """``2 * sf(|z|)``; NaN/NULL in, NULL out."""
    return F.when(F.isnan(z) | z.isNull(), F.lit(None).cast("double")).otherwise(
        _erfc_nonneg(F.abs(z) / math.sqrt(2.0)))


def cohens_h(p1: Column, p2: Column) -> Column:
    """Absolute Cohen's h: ``|2 asin sqrt p1 - 2 asin sqrt p2|``."""
    return F.abs(2.0 * F.asin(F.sqrt(p1)) - 2.0 * F.asin(F.sqrt(p2)))


def z_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def required_n(h: Column, alpha: float = 0.05, power: float = 0.8) -> Column:
    """Replicates per arm for a two-sided two-sample z test, ratio 1 (ceil)."""
    z = z_quantile(1 - alpha / 2) + z_quantile(power)
    return F.ceil(2.0 * F.pow(F.lit(z) / h, 2)).cast("long")


def power_at_n(h: Column, n: int | Column, alpha: float = 0.05) -> Column:
    """Achieved power of the two-sided test with ``n`` per arm."""
    z = z_quantile(1 - alpha / 2)
    nn = n if isinstance(n, Column) else F.lit(float(n))
    shift = h * F.sqrt(nn / 2.0)
    return norm_cdf(shift - z) + norm_cdf(-shift - z)


# DuckDB spellings for the oracles -------------------------------------------

def sql_erfc_nonneg(x: str) -> str:
    t = f"(1.0 / (1.0 + {_P} * ({x})))"
    poly = f"({t} * ({_A[0]} + {t} * ({_A[1]} + {t} * ({_A[2]} + {t} * ({_A[3]} + {t} * {_A[4]})))))"
    return f"({poly} * exp(-({x}) * ({x})))"


def sql_norm_cdf(z: str) -> str:
    x = f"(abs({z}) / sqrt(2.0))"
    upper = f"(0.5 * {sql_erfc_nonneg(x)})"
    return f"(CASE WHEN ({z}) >= 0 THEN 1.0 - {upper} ELSE {upper} END)"


def sql_two_sided_p(z: str) -> str:
    return sql_erfc_nonneg(f"(abs({z}) / sqrt(2.0))")


def sql_required_n(h: str, alpha: float = 0.05, power: float = 0.8) -> str:
    z = z_quantile(1 - alpha / 2) + z_quantile(power)
    return f"CAST(ceil(2.0 * pow({z!r} / ({h}), 2)) AS BIGINT)"


def sql_power_at_n(h: str, n: float, alpha: float = 0.05) -> str:
    z = z_quantile(1 - alpha / 2)
    shift = f"(({h}) * sqrt({float(n)!r} / 2.0))"
    return f"({sql_norm_cdf(f'{shift} - {z!r}')} + {sql_norm_cdf(f'-{shift} - {z!r}')})"
