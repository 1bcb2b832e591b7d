"""Normal and Student-t tails as native Column expressions, meant for result rows."""

from __future__ import annotations

import math
from collections.abc import Callable
from statistics import NormalDist

from pyspark.sql import Column, functions as F

from .numeric import as_col

# Published rational approximation of the normal tail (Hart 1968, West 2005).
_TAIL_NUM = (
    0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
)
_TAIL_DEN = (
    0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
)
_TAIL_SWITCH = 7.07106781186547
_SQRT_2PI = 2.506628274631000502

ALTERNATIVES = ("two-sided", "greater", "less")


def _poly(x: Column, coefs: tuple[float, ...]) -> Column:
    out = F.lit(coefs[0])
    for c in coefs[1:]:
        out = out * x + F.lit(c)
    return out


def norm_sf(z: Column | str) -> Column:
    """P(Z > z) of the standard normal."""
    z = as_col(z).cast("double")
    x = F.abs(z)
    density = F.exp(-x * x / 2)
    near = density * _poly(x, _TAIL_NUM) / _poly(x, _TAIL_DEN)
    fraction = x + F.lit(0.65)
    for k in (4, 3, 2, 1):
        fraction = x + F.lit(float(k)) / fraction
    far = density / fraction / F.lit(_SQRT_2PI)
    tail = F.when(x < _TAIL_SWITCH, near).otherwise(far)
    return F.when(z.isNull(), F.lit(None).cast("double")).when(z >= 0, tail).otherwise(1 - tail)


def norm_cdf(z: Column | str) -> Column:
    return norm_sf(-as_col(z))


def norm_ppf(p: float) -> float:
    """Quantile of the standard normal; a plain number, computed once."""
    return NormalDist().inv_cdf(p)


# Stirling series of ln(gamma(x + 1/2) / gamma(x)) - ln(x) / 2 in odd powers of 1 / x.
_GAMMA_RATIO = (-1 / 8, 1 / 192, -1 / 640, 17 / 14336, -31 / 18432)
_GAMMA_SHIFT = 12
_PANELS = 24
_DEPTH = 80.0
# Gauss-Legendre nodes of eight points on [0, 1] with their weights.
_NODES = tuple(
    (0.5 + side * x / 2, w / 2)
    for x, w in (
        (0.1834346424956498, 0.3626837833783620), (0.5255324099163290, 0.3137066458778873),
        (0.7966664774136267, 0.2223810344533745), (0.9602898564975363, 0.1012285362903763),
    )
    for side in (-1, 1)
)


def _gamma_ratio(x: Column) -> Column:
    """gamma(x + 1/2) / gamma(x), by the series at ``x + 12`` and the recurrence back to ``x``."""
    big = x + F.lit(float(_GAMMA_SHIFT))
    series = F.lit(0.0)
    for k, c in enumerate(_GAMMA_RATIO):
        series = series + F.lit(c) / F.pow(big, F.lit(2.0 * k + 1))
    back = F.lit(1.0)
    for k in range(_GAMMA_SHIFT):
        back = back * (x + F.lit(float(k))) / (x + F.lit(k + 0.5))
    return F.sqrt(big) * F.exp(series) * back


def _integral(f: Callable[[Column], Column], width: Column) -> Column:
    """Integral of a smooth ``f`` from 0 to ``width`` by Gauss-Legendre nodes on equal panels."""
    h = width / F.lit(float(_PANELS))

    def add(total: Column, i: Column) -> Column:
        for node, weight in _NODES:
            total = total + F.lit(weight) * f((i.cast("double") + F.lit(node)) * h)
        return total

    return F.aggregate(F.sequence(F.lit(0), F.lit(_PANELS - 1)), F.lit(0.0), add) * h


def t_sf(t: Column | str, df: Column | str) -> Column:
    """P(T > t) of Student's t, for result rows (one per test).

    Up to 1 the density is integrated from the centre. Beyond, the tail itself is integrated over
    s = ln(1 + u^2 / df), in which it falls off exponentially for any number of degrees of freedom,
    so small probabilities keep their relative accuracy.
    """
    t, df = as_col(t).cast("double"), as_col(df).cast("double")
    size = F.abs(t)
    scale = _gamma_ratio(df / 2) / F.sqrt(df * F.lit(math.pi))
    power = (df + 1) / 2
    centre = scale * _integral(lambda u: F.exp(-power * F.log1p(u * u / df)), size)
    start = F.log1p(size * size / df)
    body = _integral(
        lambda d: F.exp(-d * (df - 1) / 2) / F.sqrt(df * F.expm1(start + d)), F.lit(_DEPTH) / df
    )
    tail = scale * F.exp(start - power * start) * df / 2 * body
    half = F.when(size <= 1, F.lit(0.5) - centre).otherwise(tail)
    known = t.isNotNull() & (df > 0)
    return F.when(known, F.when(t >= 0, half).otherwise(1 - half))


def bound(f: Callable[..., Column], *values: Column) -> Column:
    """f of the values, each computed once a row however often f names it, in loops too."""
    row = F.struct(*[v.alias(f"v{k}") for k, v in enumerate(values)])
    return F.element_at(F.transform(F.array(row), lambda s: f(*[s[f"v{k}"] for k in range(len(values))])), 1)


# Stirling series of ln gamma in odd powers of 1 / x.
_LN_GAMMA = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188)
_STEPS = 600
_TINY = 1e-300


def ln_gamma(x: Column) -> Column:
    """ln gamma(x) for x > 0, by the series at ``x + 12`` and the recurrence back to ``x``."""
    big = x + F.lit(float(_GAMMA_SHIFT))
    series = (big - 0.5) * F.ln(big) - big + F.lit(0.5 * math.log(2 * math.pi))
    for k, c in enumerate(_LN_GAMMA):
        series = series + F.lit(c) / F.pow(big, F.lit(2.0 * k + 1))
    back = x
    for k in range(1, _GAMMA_SHIFT):
        back = back * (x + F.lit(float(k)))
    return series - F.ln(back)


def gamma_sf(a: Column, x: Column) -> Column:
    """Upper regularised incomplete gamma function Q(a, x), for result rows.

    Below ``a + 1`` one minus the power series, beyond it the continued fraction (modified Lentz), so that
    small tails keep their relative accuracy. The number of steps is fixed; it serves ``a`` up to some thousands.
    """
    return bound(_gamma_sf, a.cast("double"), x.cast("double"))


def _gamma_sf(a: Column, x: Column) -> Column:
    steps = F.sequence(F.lit(1), F.lit(_STEPS))
    number = lambda i: i.cast("double")
    lead = F.exp(a * F.ln(x) - x - ln_gamma(a))

    def term(s: Column, i: Column) -> Column:
        t = s["t"] * x / (a + number(i))
        return F.struct((s["sum"] + t).alias("sum"), t.alias("t"))

    series = F.aggregate(steps, F.struct((1 / a).alias("sum"), (1 / a).alias("t")), term, lambda s: s["sum"])

    def nonzero(v: Column) -> Column:
        return F.when(F.abs(v) < _TINY, F.lit(_TINY)).otherwise(v)

    def fraction(s: Column, i: Column) -> Column:
        k = number(i)
        an, b = -k * (k - a), x + 1 - a + 2 * k
        d, c = 1 / nonzero(an * s["d"] + b), nonzero(b + an / s["c"])
        return F.struct((s["h"] * c * d).alias("h"), c.alias("c"), d.alias("d"))

    first = 1 / nonzero(x + 1 - a)
    start = F.struct(first.alias("h"), F.lit(1 / _TINY).alias("c"), first.alias("d"))
    far = lead * F.aggregate(steps, start, fraction, lambda s: s["h"])
    # 1 - P loses digits only where P is close to one, which it isn't below a + 1
    return F.when(x <= 0, F.lit(1.0)).when(x < a + 1, 1 - lead * series).otherwise(far)


def chi2_sf(x: Column | str, df: Column | str) -> Column:
    """P(X > x) of the chi-square distribution; NULL without a positive number of degrees of freedom."""
    x, df = as_col(x).cast("double"), as_col(df).cast("double")
    return F.when(x.isNotNull() & (df > 0), gamma_sf(df / 2, x / 2))


def norm_p(z: Column, alternative: str = "two-sided") -> Column:
    if alternative == "two-sided":
        return 2 * norm_sf(F.abs(z))
    return norm_sf(z if _check(alternative) == "greater" else -z)


def t_p(t: Column, df: Column, alternative: str = "two-sided") -> Column:
    if alternative == "two-sided":
        return 2 * t_sf(F.abs(t), df)
    return t_sf(t if _check(alternative) == "greater" else -t, df)


def _check(alternative: str) -> str:
    if alternative not in ALTERNATIVES:
        raise ValueError(f"alternative must be one of {ALTERNATIVES}")
    return alternative


def verdict(p: Column | str, alpha: float = 0.05) -> Column:
    """Accept H1 only when p is strictly below alpha; an unknown p cannot reject H0."""
    return F.when(as_col(p) < F.lit(alpha), "accept H1").otherwise("cannot reject H0")
