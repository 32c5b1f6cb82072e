"""Statistics as column expressions."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: quantiles of the normal distribution by promised coverage, and the coefficients of its polynomial
INTERVAL_Z = {80: 1.2816, 90: 1.6449, 95: 1.96}
ERF = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
ERF_P = 0.3275911


def norm_cdf(x: Column) -> Column:
    """Normal distribution function by the five-term polynomial of the error function."""
    z = F.abs(x) / F.sqrt(F.lit(2.0))
    k = 1 / (1 + ERF_P * z)
    series = F.lit(0.0)
    for a in reversed(ERF):
        series = (series + a) * k
    return 0.5 * (1 + F.signum(x) * (1 - series * F.exp(-z * z)))


def norm_cdf_sql(x: str) -> str:
    """The same in SQL."""
    k = f"(1 / (1 + {ERF_P} * abs({x}) / sqrt(2.0)))"
    series = "0.0"
    for a in reversed(ERF):
        series = f"(({series} + {a}) * {k})"
    return f"(0.5 * (1 + sign({x}) * (1 - {series} * exp(-({x}) * ({x}) / 2.0))))"


def norm_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def box_cox(v: Column, lam: Column) -> Column:
    return F.when(F.abs(lam) < 1e-4, F.ln(v)).otherwise((F.pow(v, lam) - 1) / lam)


def inverse_box_cox(v: Column, lam: Column) -> Column:
    base = lam * v + 1
    return F.when(F.abs(lam) < 1e-4, F.exp(v)).when(base <= 0, 0.0).otherwise(F.pow(base, 1 / lam))


def decay_kernel(kind: str, at: Column, duration: Column) -> Column:
    """Weight of an event ``at`` steps after its start."""
    tau, mid = F.greatest(duration / 3, F.lit(0.5)), duration / 2
    inside = (at >= 0) & (at < duration)
    return {
        "box": F.when(inside, 1.0).otherwise(0.0),
        "exponential": F.when(at >= 0, F.exp(-at / tau)).otherwise(0.0),
        "triangular": F.when(~inside, 0.0).when(at < mid, at / F.greatest(mid, F.lit(0.5))).otherwise((duration - at) / F.greatest(at - mid, F.lit(0.5))),
        "gaussian": F.exp(-0.5 * F.pow((at - mid) / F.greatest(duration / 4, F.lit(0.5)), 2)),
        "step": F.when(at >= 0, 1 - F.exp(-at / tau)).otherwise(0.0),
    }[kind]
