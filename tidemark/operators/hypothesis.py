"""Two-sample and one-sample tests from mergeable moments.

Every test is one aggregation over the rows, with one result row per test (and segment). The
probability functions see result rows only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numeric import ratio
from ..functions.probability import norm_cdf, norm_p, norm_ppf, t_p, verdict


def two_group_moments(
    df: DataFrame, group: str, value: str, a: object, b: object, by: Sequence[str] = ()
) -> DataFrame:
    """n, mean and sample variance of both groups side by side; missing values are left out."""
    v = F.col(value).cast("double")
    aggs = []
    for side, label in (("a", a), ("b", b)):
        mine = F.when(F.col(group) == F.lit(label), v)
        aggs += [
            F.count(mine).alias(f"n_{side}"),
            F.avg(mine).alias(f"mean_{side}"),
            F.var_samp(mine).alias(f"var_{side}"),
        ]
    return df.groupBy(*by).agg(*aggs)


def _finish(df: DataFrame, alpha: float) -> DataFrame:
    return df.withColumn("verdict", verdict("p_value", alpha))


def ttest_welch(
    df: DataFrame, group: str, value: str, a: object, b: object,
    alternative: str = "two-sided", by: Sequence[str] = (), alpha: float = 0.05,
) -> DataFrame:
    """Difference of means without assuming equal variances."""
    m = two_group_moments(df, group, value, a, b, by)
    se_a, se_b = ratio("var_a", "n_a"), ratio("var_b", "n_b")
    m = m.withColumns({"t": F.try_divide(F.col("mean_a") - F.col("mean_b"), F.sqrt(se_a + se_b))})
    spread = F.try_divide(se_a * se_a, F.col("n_a") - 1.0) + F.try_divide(se_b * se_b, F.col("n_b") - 1.0)
    m = m.withColumn("df", F.try_divide((se_a + se_b) * (se_a + se_b), spread))
    return _finish(m.withColumn("p_value", t_p(F.col("t"), F.col("df"), alternative)), alpha)


def ttest_pooled(
    df: DataFrame, group: str, value: str, a: object, b: object,
    alternative: str = "two-sided", by: Sequence[str] = (), alpha: float = 0.05,
) -> DataFrame:
    """Difference of means with one common variance."""
    m = two_group_moments(df, group, value, a, b, by)
    m = m.withColumn("df", (F.col("n_a") + F.col("n_b") - 2).cast("double"))
    squares = F.col("var_a") * (F.col("n_a") - 1) + F.col("var_b") * (F.col("n_b") - 1)
    pooled = F.try_divide(squares, F.col("df"))
    se = F.sqrt(pooled * (ratio(F.lit(1), "n_a") + ratio(F.lit(1), "n_b")))
    m = m.withColumn("t", F.try_divide(F.col("mean_a") - F.col("mean_b"), se))
    return _finish(m.withColumn("p_value", t_p(F.col("t"), F.col("df"), alternative)), alpha)


def ttest_one_sample(
    df: DataFrame, value: str, mu: float, alternative: str = "two-sided", by: Sequence[str] = (), alpha: float = 0.05
) -> DataFrame:
    """Mean against a fixed value."""
    v = F.col(value).cast("double")
    m = df.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"))
    se = F.try_divide(F.col("std"), F.sqrt(F.col("n").cast("double")))
    m = m.withColumns(
        {"t": F.try_divide(F.col("mean") - F.lit(float(mu)), se), "df": (F.col("n") - 1).cast("double")}
    )
    return _finish(m.withColumn("p_value", t_p(F.col("t"), F.col("df"), alternative)), alpha)


def ztest_counts(
    df: DataFrame, x_a: Column | str, n_a: Column | str, x_b: Column | str, n_b: Column | str,
    alternative: str = "two-sided", alpha: float = 0.05,
) -> DataFrame:
    """Two-proportion test with a pooled variance on a result that holds successes and sizes."""
    as_double = [F.col(c).cast("double") if isinstance(c, str) else c.cast("double") for c in (x_a, n_a, x_b, n_b)]
    xa, na, xb, nb = as_double
    pool = F.try_divide(xa + xb, na + nb)
    se = F.sqrt(pool * (1 - pool) * (F.try_divide(F.lit(1.0), na) + F.try_divide(F.lit(1.0), nb)))
    out = df.withColumn("z", F.try_divide(F.try_divide(xa, na) - F.try_divide(xb, nb), se))
    return _finish(out.withColumn("p_value", norm_p(F.col("z"), alternative)), alpha)


def ztest_proportions(
    df: DataFrame, group: str, success: str, a: object, b: object,
    alternative: str = "two-sided", by: Sequence[str] = (), alpha: float = 0.05,
) -> DataFrame:
    """Two-proportion test over rows carrying a 0/1 ``success``; one shuffle for all segments."""
    aggs = []
    for side, label in (("a", a), ("b", b)):
        mine = F.col(group) == F.lit(label)
        aggs += [
            F.count_if(mine).alias(f"n_{side}"),
            F.count_if(mine & (F.col(success) == 1)).alias(f"x_{side}"),
        ]
    return ztest_counts(df.groupBy(*by).agg(*aggs), "x_a", "n_a", "x_b", "n_b", alternative, alpha)


def normal_fit(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean and sample deviation of a metric, the parameters of its normal model."""
    v = F.col(value).cast("double")
    return df.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mu"), F.stddev_samp(v).alias("sigma"))


def normal_prob(
    df: DataFrame, value: str, lo: float | None = None, hi: float | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Modelled probability that the metric falls between ``lo`` and ``hi`` (open ends allowed)."""
    fit = normal_fit(df, value, by)
    score = lambda x: F.try_divide(F.lit(float(x)) - F.col("mu"), F.col("sigma"))
    upper = F.lit(1.0) if hi is None else norm_cdf(score(hi))
    lower = F.lit(0.0) if lo is None else norm_cdf(score(lo))
    return fit.withColumn("probability", upper - lower)


def normal_quantile(df: DataFrame, value: str, p: float, by: Sequence[str] = ()) -> DataFrame:
    """Modelled value that the metric stays below with probability ``p``."""
    fit = normal_fit(df, value, by)
    return fit.withColumn("critical", F.col("mu") + F.lit(norm_ppf(p)) * F.col("sigma"))
