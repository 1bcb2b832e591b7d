"""Small pieces of SQL text shared by the check queries."""

from __future__ import annotations


def avg_half_up(x: str, digits: int = 2, scale: int = 10) -> str:
    """Average rounded once, half away from zero: the sum counts units of ``10 ** -scale`` in whole numbers."""
    total = f"sum(CAST(round(({x}) * {10**scale}) AS HUGEINT))"
    den = f"nullif({10**scale} * CAST(count({x}) AS HUGEINT), 0)"
    return (
        f"CAST(CASE WHEN {total} < 0 THEN -1 ELSE 1 END * "
        f"((2 * abs({total}) * {10**digits} + {den}) // (2 * {den})) AS DOUBLE) / {10**digits}"
    )


def percent_half_up(part: str, whole: str, digits: int = 2) -> str:
    """100 * part / whole of two counts, rounded half up, in whole numbers."""
    p, w = f"CAST({part} AS HUGEINT)", f"nullif(CAST({whole} AS HUGEINT), 0)"
    return f"CAST((2 * {p} * {100 * 10**digits} + {w}) // (2 * {w}) AS DOUBLE) / {10**digits}"


def student_two_sided(t: str, df: str, steps: int = 4000) -> str:
    """P(|T| > |t|) by Simpson's rule.

    With t = sqrt(df) * tan(a) the density turns into cos(a)^(df-1); the tail is one minus the
    integral between the two angles, over the closed-form total.
    """
    angle = f"atan(abs({t}) / sqrt({df}))"
    total = f"exp(lgamma(({df}) / 2.0) + lgamma(0.5) - lgamma((({df}) + 1) / 2.0))"
    area = (
        f"(SELECT sum((CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * "
        f"pow(cos({angle} * i / {steps}.0), ({df}) - 1)) * {angle} / {steps}.0 / 3.0 "
        f"FROM range(0, {steps + 1}) AS s(i))"
    )
    return f"(1.0 - 2.0 * {area} / {total})"


def normal_between(a: str, b: str, steps: int = 4000) -> str:
    """Integral of the standard normal density from a to b by Simpson's rule."""
    x = f"(({a}) + (({b}) - ({a})) * i / {steps}.0)"
    return (
        f"(SELECT sum((CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * "
        f"exp(-{x} * {x} / 2.0)) * (({b}) - ({a})) / {steps}.0 / 3.0 / sqrt(2.0 * pi()) "
        f"FROM range(0, {steps + 1}) AS s(i))"
    )


def normal_two_sided(z: str) -> str:
    return f"(1.0 - 2.0 * {normal_between('0.0', f'abs({z})')})"
