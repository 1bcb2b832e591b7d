"""A/B experiment checks and read-outs."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numeric import half_even, ratio
from ..functions.probability import bound, chi2_sf, norm_ppf, norm_sf, verdict
from .joins import align_groups, lookup_join
from .summarize import share_of_total


def enroll(
    fact: DataFrame, participants: DataFrame, unit: str = "user_id", test: str | None = None
) -> DataFrame:
    """Fact rows of the participants of one test, tagged with their group.

    A unit listed in both groups keeps both tags, as a join would give it.
    """
    chosen = participants if test is None else participants.filter(F.col("ab_test") == test)
    return lookup_join(fact, chosen.select(unit, "group").distinct(), unit)


def units_per_group(df: DataFrame, unit: str, group: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, group).agg(F.countDistinct(unit).alias("units"))


def group_balance(df: DataFrame, unit: str, group: str, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """Distinct units of both groups and the size gap in percent of group ``a``."""
    sizes = units_per_group(df, unit, group, by)
    pick = lambda label: F.coalesce(F.sum(F.when(F.col(group) == label, F.col("units"))), F.lit(0))
    both = sizes.groupBy(*by).agg(pick(a).alias("units_a"), pick(b).alias("units_b"))
    gap = ratio(F.abs(F.col("units_a") - F.col("units_b")) * 100, "units_a")
    return both.withColumn("gap_percent", half_even(gap, 2))


def ratio_test(df: DataFrame, unit: str, group: str, expected: Mapping[str, float], by: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """Sample ratio mismatch: chi-square test of the groups' distinct units against the expected shares.

    ``expected`` gives each group's weight; groups that aren't named do not count, named ones without units
    count as empty. One row (per ``by``): ``units``, ``statistic``, ``df``, ``p_value`` and ``verdict``, where
    accepting H1 means that the split is not the expected one.
    """
    if len(expected) < 2 or min(expected.values()) <= 0:
        raise ValueError("the ratio needs two groups or more with positive weights")
    total = float(sum(expected.values()))
    sizes = units_per_group(df.filter(F.col(group).isin(list(expected))), unit, group, by)
    seen = {label: F.coalesce(F.sum(F.when(F.col(group) == label, F.col("units"))), F.lit(0)) for label in expected}
    wide = sizes.groupBy(*by).agg(F.coalesce(F.sum("units"), F.lit(0)).alias("units"), *[c.alias(f"_seen_{k}") for k, c in enumerate(seen.values())])
    statistic = F.lit(0.0)
    for k, weight in enumerate(expected.values()):
        wanted = F.col("units").cast("double") * F.lit(weight / total)
        statistic = statistic + F.try_divide((F.col(f"_seen_{k}").cast("double") - wanted) * (F.col(f"_seen_{k}").cast("double") - wanted), wanted)
    out = wide.select(*by, "units", statistic.alias("statistic"), F.lit(len(expected) - 1).cast("long").alias("df"))
    out = out.withColumn("p_value", chi2_sf("statistic", "df"))
    return out.withColumn("verdict", verdict("p_value", alpha))


def contaminated_units(df: DataFrame, unit: str, group: str) -> DataFrame:
    """Units seen in more than one group (two mergeable extremes per unit, no distinct sets)."""
    spread = df.groupBy(unit).agg(F.min(group).alias("first_group"), F.max(group).alias("last_group"))
    return spread.filter(F.col("first_group") != F.col("last_group"))


def covariate_balance(df: DataFrame, unit: str, group: str, columns: Sequence[str], digits: int = 2) -> DataFrame:
    """Distinct units per category of several covariates and their share within the group."""
    long = df.select(unit, group, *[F.col(c).cast("string").alias(c) for c in columns]).unpivot(
        [unit, group], list(columns), "covariate", "category"
    )
    counts = (
        long.filter("category IS NOT NULL")
        .groupBy("covariate", group, "category")
        .agg(F.countDistinct(unit).alias("units"))
    )
    out = share_of_total(counts, "units", "share", ["covariate", group])
    return out.withColumn("share", half_even("share", digits))


def conversion(num: DataFrame, den: DataFrame, unit: str, group: str) -> DataFrame:
    """Distinct converted units over distinct registered units, for the union of group labels."""
    converted = num.groupBy(group).agg(F.countDistinct(unit).alias("converted"))
    registered = den.groupBy(group).agg(F.countDistinct(unit).alias("registered"))
    return align_groups(converted, registered, group).withColumn("conversion", ratio("converted", "registered"))


def group_share(df: DataFrame, group: str, success: str, unit: str) -> DataFrame:
    """Successes, distinct units and both readings of the success share per group."""
    return (
        df.groupBy(group)
        .agg(
            F.countDistinct(unit).alias("units"),
            F.count("*").alias("rows"),
            F.coalesce(F.sum(success), F.lit(0)).alias("successes"),
        )
        .withColumn("share_of_units", ratio("successes", "units"))
        .withColumn("share_of_rows", ratio("successes", "rows"))
    )


def share_gap(df: DataFrame, group: str, success: str, a: str, b: str) -> DataFrame:
    """Success shares of two groups and their distance in percentage points (half-even, 2 digits)."""
    side = lambda label: F.avg(F.when(F.col(group) == label, F.col(success).cast("double")))
    both = df.agg(side(a).alias("share_a"), side(b).alias("share_b"))
    return both.withColumn("gap_points", half_even(F.abs(F.col("share_a") - F.col("share_b")) * 100, 2))


def arm_size(effect: Column | float, alpha: float = 0.05, power: float = 0.8) -> Column:
    """Units per arm for a two-sided test of a standardised effect, two equal arms."""
    z = norm_ppf(1 - alpha / 2) + norm_ppf(power)
    e = effect if isinstance(effect, Column) else F.lit(float(effect))
    return F.try_divide(F.lit(2 * z * z), e * e)


_HALVINGS = 100


def _root(f: Callable[[Column], Column], top: Column) -> Column:
    """Where a growing function of a number in (0, top] reaches zero, by halving a bracket; for result rows."""

    def halve(s: Column, _: Column) -> Column:
        middle = (s["lo"] + s["hi"]) / 2
        above = f(middle) >= 0
        return F.struct(F.when(above, s["lo"]).otherwise(middle).alias("lo"), F.when(above, middle).otherwise(s["hi"]).alias("hi"))

    start = F.struct(F.lit(0.0).alias("lo"), top.cast("double").alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(_HALVINGS)), start, halve, lambda s: s["hi"])


def two_tailed_power(effect: Column, n_a: Column, alpha: float = 0.05, ratio_b: float = 1.0) -> Column:
    """Power of a two-sided z-test of a standardised effect, with ``n_a`` and ``ratio_b * n_a`` units; both tails count."""
    crit = norm_ppf(1 - alpha / 2)
    shift = F.abs(effect) * F.sqrt(n_a * F.lit(ratio_b / (1 + ratio_b)))
    return bound(lambda shift: norm_sf(F.lit(crit) - shift) + norm_sf(F.lit(crit) + shift), shift)


def solve_arm_size(effect: Column | float, alpha: float = 0.05, power: float = 0.8, ratio_b: float = 1.0) -> Column:
    """Units of the first arm at which the two-tailed power is reached; the second has ``ratio_b`` times as many.

    A real number; NULL for no effect. Needs ``alpha < power``. The closed form of one tail bounds it from above.
    """
    _check_power(alpha, power, ratio_b)
    e = effect if isinstance(effect, Column) else F.lit(float(effect))
    z = norm_ppf(1 - alpha / 2) + norm_ppf(power)
    top = F.try_divide(F.lit(z * z * (1 + 1 / ratio_b)), e * e)
    solved = bound(lambda e, top: _root(lambda n: two_tailed_power(e, n, alpha, ratio_b) - F.lit(power), top), e, top)
    return F.when(top.isNotNull(), solved)


def detectable_effect(n_a: Column, alpha: float = 0.05, power: float = 0.8, ratio_b: float = 1.0) -> Column:
    """Smallest standardised effect that ``n_a`` and ``ratio_b * n_a`` units show with the given power; NULL without units."""
    _check_power(alpha, power, ratio_b)
    z = norm_ppf(1 - alpha / 2) + norm_ppf(power)
    top = F.sqrt(F.try_divide(F.lit(z * z * (1 + 1 / ratio_b)), n_a.cast("double")))
    solved = bound(lambda n, top: _root(lambda e: two_tailed_power(e, n, alpha, ratio_b) - F.lit(power), top), n_a.cast("double"), top)
    return F.when(n_a > 0, solved)


def _check_power(alpha: float, power: float, ratio_b: float) -> None:
    if not 0 < alpha < power < 1 or ratio_b <= 0:
        raise ValueError("needs 0 < alpha < power < 1 and a positive ratio")


def cohen_h(base: Column, lift: float) -> Column:
    """Standardised distance between a baseline share and the share ``lift`` above it."""
    angle = lambda p: 2 * F.asin(F.sqrt(p))
    return F.abs(angle(F.least(base + F.lit(lift), F.lit(1.0))) - angle(base))


def sample_size(
    history: DataFrame, success: str, mde: float, alpha: float = 0.05, power: float = 0.8,
    effect: str = "standardised", by: Sequence[str] = (),
) -> DataFrame:
    """Baseline share per segment and the units each arm needs.

    ``effect="standardised"`` takes ``mde`` as the effect itself; ``"cohen_h"`` derives it from the
    baseline and an absolute lift of ``mde``.
    """
    if effect not in ("standardised", "cohen_h"):
        raise ValueError(f"unknown effect {effect!r}")
    base = history.groupBy(*by).agg(
        F.count("*").alias("rows"), F.avg(F.col(success).cast("double")).alias("baseline")
    )
    size = F.lit(float(mde)) if effect == "standardised" else cohen_h(F.col("baseline"), mde)
    base = base.withColumn("effect", size)
    return base.withColumn("n_per_arm", F.floor(arm_size(F.col("effect"), alpha, power)).cast("long"))


def test_duration(
    history: DataFrame, unit: str, ts: str, effect: float, alpha: float = 0.05, power: float = 0.8, by: Sequence[str] = ()
) -> DataFrame:
    """Days needed to fill both arms at the history's rounded mean of daily distinct units."""
    daily = history.groupBy(*by, F.to_date(ts).alias("date")).agg(F.countDistinct(unit).alias("units"))
    traffic = daily.groupBy(*by).agg(half_even(F.avg("units")).cast("long").alias("daily_units"))
    days = F.ceil(F.try_divide(arm_size(effect, alpha, power) * 2, F.col("daily_units").cast("double")))
    return traffic.withColumn("days", days.cast("long"))


test_duration.__test__ = False
