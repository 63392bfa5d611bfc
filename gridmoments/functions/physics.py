"""Scalar relations between fields, means, variances and covariances, as column expressions in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import THRESHOLD

#: Temperatures at which condensate is all ice and all liquid.
ICE, LIQUID = 233.0, 273.15


def col(x: Column | str) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("double")


def liquid_share(t: Column | str) -> Column:
    return F.least(F.greatest((col(t) - ICE) / (LIQUID - ICE), F.lit(0.0)), F.lit(1.0))


def partition_condensate(q: Column | str, t: Column | str) -> tuple[Column, Column]:
    """Liquid and ice of a total condensate: a linear ramp between the two temperatures."""
    return liquid_share(t) * col(q), (1 - liquid_share(t)) * col(q)


def present(x: Column | str, threshold: float = THRESHOLD) -> Column:
    """Strictly above the threshold; NaN is not present."""
    return (col(x) > threshold) & ~F.isnan(col(x))


def cloudy(liquid: Column | str, ice: Column | str, threshold: float = THRESHOLD) -> Column:
    return present(liquid, threshold) | present(ice, threshold)


def finite(x: Column | str) -> Column:
    return col(x).isNotNull() & ~F.isnan(col(x)) & (F.abs(col(x)) < float("inf"))


def kinetic_energy(u: Column | str, v: Column | str, w: Column | str) -> Column:
    return 0.5 * (col(u) * col(u) + col(v) * col(v) + col(w) * col(w))


def tke(var_u: Column | str, var_v: Column | str, var_w: Column | str) -> Column:
    return 0.5 * (col(var_u) + col(var_v) + col(var_w))


def tke_at(u: Column | str, v: Column | str, w: Column | str, mu: Column | str, mv: Column | str, mw: Column | str) -> Column:
    """Of a point about given means."""
    return kinetic_energy(col(u) - col(mu), col(v) - col(mv), col(w) - col(mw))


def tke_total(u: str, v: str, w: str) -> Column:
    """Aggregate: the sum over all points about their own means."""
    return 0.5 * F.count(u) * (F.var_pop(col(u)) + F.var_pop(col(v)) + F.var_pop(col(w)))


def tke_from_m2(n: Column | str, m2u: Column | str, m2v: Column | str, m2w: Column | str) -> Column:
    return F.try_divide(0.5 * (col(m2u) + col(m2v) + col(m2w)), col(n))


def covariance_from_moments(mean_xy: Column | str, mean_x: Column | str, mean_y: Column | str) -> Column:
    return col(mean_xy) - col(mean_x) * col(mean_y)


def variance_from_moments(mean_xx: Column | str, mean_x: Column | str) -> Column:
    return covariance_from_moments(mean_xx, mean_x, mean_x)


def tke_from_moments(uu: Column | str, u: Column | str, vv: Column | str, v: Column | str, ww: Column | str, w: Column | str) -> Column:
    return tke(variance_from_moments(uu, u), variance_from_moments(vv, v), variance_from_moments(ww, w))


def correlation(cov: Column | str, var_a: Column | str, var_b: Column | str) -> Column:
    """cov / sqrt(var_a * var_b) within [-1, 1]; NaN where that is too small or anything is not finite."""
    scale = F.sqrt(F.greatest(col(var_a) * col(var_b), F.lit(0.0)))
    good = finite(scale) & (scale >= 1e-15) & finite(cov)
    return F.when(good, F.least(F.greatest(F.try_divide(col(cov), scale), F.lit(-1.0)), F.lit(1.0))).otherwise(F.lit(float("nan")))


def sigmoid(x: Column | str) -> Column:
    z = F.exp(-F.abs(col(x)))
    return F.when(col(x) >= 0, 1 / (1 + z)).otherwise(z / (1 + z))


def bce_with_logits(logit: Column | str, target: Column | str) -> Column:
    return F.greatest(col(logit), F.lit(0.0)) - col(logit) * col(target) + F.log1p(F.exp(-F.abs(col(logit))))
