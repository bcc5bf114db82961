"""Robust kernels as Column expressions: (ρ, ρ', ρ'') of a squared error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KERNELS = [
    "huber", "cauchy", "tukey", "fair", "dcs", "pseudo_huber", "welsch", "saturated",
    "geman_mcclure",
]


def robust_weight(chi2: Column, kernel: str, delta: float) -> tuple[Column, Column, Column]:
    """Robust cost and its first two derivatives with respect to ``chi2``."""
    e, d = chi2, float(delta)
    d2 = d * d
    zero, one = F.lit(0.0), F.lit(1.0)

    def split(cond: Column, inside: tuple, outside: tuple) -> tuple[Column, Column, Column]:
        return tuple(F.when(cond, i).otherwise(o) for i, o in zip(inside, outside))

    if kernel == "huber":
        root = F.sqrt(e)
        return split(e <= d2, (e, one, zero), (2.0 * d * root - d2, d / root, -0.5 * d / root / e))
    if kernel == "cauchy":
        a = 1.0 + e / d2
        return d2 * F.log(a), 1.0 / a, -1.0 / (d2 * a * a)
    if kernel == "tukey":
        u = 1.0 - e / d2
        return split(
            e <= d2,
            (d2 * (1.0 - u * u * u) / 3.0, u * u, -2.0 * u / d2),
            (F.lit(d2 / 3.0), zero, zero),
        )
    if kernel == "fair":
        root = F.sqrt(e)
        a = root / d
        second = F.when(e > 0, -1.0 / (2.0 * d * root * (1.0 + a) * (1.0 + a)))
        return 2.0 * d2 * (a - F.log1p(a)), 1.0 / (1.0 + a), second
    if kernel == "dcs":
        s = d + e
        return split(
            e <= d,
            (e, one, zero),
            (
                4.0 * d2 * e / (s * s),
                4.0 * d2 * (d - e) / (s * s * s),
                -8.0 * d2 * (2.0 * d - e) / (s * s * s * s),
            ),
        )
    if kernel == "pseudo_huber":
        a = 1.0 + e / d2
        root = F.sqrt(a)
        return 2.0 * d2 * (root - 1.0), 1.0 / root, -0.5 / (d2 * root * a)
    if kernel == "welsch":
        w = F.exp(-e / d2)
        return d2 * (1.0 - w), w, -w / d2
    if kernel == "saturated":
        return split(e <= d2, (e, one, zero), (F.lit(d2), zero, zero))
    if kernel == "geman_mcclure":
        s = d + e
        return d * e / s, d2 / (s * s), -2.0 * d2 / (s * s * s)
    raise ValueError(f"unknown kernel {kernel!r}; one of {KERNELS}")
