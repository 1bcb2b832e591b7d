"""Rounding, dates, labels and probabilities on hand-made values."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import dates as D, labels as L, numeric as N, probability as P


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()], F.lit(0).alias("_"))
    return df.select(column.alias("out")).first()["out"]


def col_values(df, column):
    return [r[0] for r in df.select(column).collect()]


def test_rounding_rules_differ_on_halves(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-2.5,)], "x double")
    assert col_values(df, F.round("x")) == [1.0, 2.0, 3.0, -3.0]
    assert col_values(df, N.half_even("x")) == [0.0, 2.0, 2.0, -2.0]


def test_division_by_zero_and_null_is_null(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, None), (1.0, 4.0)], "a double, b double")
    assert col_values(df, N.ratio("a", "b")) == [None, None, 0.25]
    assert col_values(df, N.percent("a", "b")) == [None, None, 25.0]


@pytest.mark.parametrize("part,whole,want", [(4950, 22903, 21.61), (429, 3299, 13.0), (751, 1157, 64.91), (296, 1157, 25.58), (105, 1157, 9.08), (5, 1157, 0.43)])
def test_published_percentages(spark, part, whole, want):
    assert one(spark, N.percent(F.lit(part), F.lit(whole))) == want


def test_exact_average_rounds_half_away_from_zero(spark):
    df = spark.createDataFrame([(0.01,), (0.02,)], "x double")
    assert df.agg(N.exact_avg("x")).first()[0] == 0.02
    df = spark.createDataFrame([(-0.01,), (-0.02,)], "x double")
    assert df.agg(N.exact_avg("x")).first()[0] == -0.02
    df = spark.createDataFrame([(0.005,), (0.004,), (None,)], "x double")
    assert df.agg(N.exact_avg("x")).first()[0] == 0.0  # 0.0045, rounded once
    df = spark.createDataFrame([(1e16,), (3e16,)], "x double")
    assert df.agg(N.exact_avg("x")).first()[0] == 2e16
    df = spark.createDataFrame([(1e300,), (1e300,)], "x double")
    assert df.agg(N.exact_avg("x")).first()[0] == 1e300
    assert spark.createDataFrame([], "x double").agg(N.exact_avg("x")).first()[0] is None


def test_flag_counts_unknown_as_zero(spark):
    df = spark.createDataFrame([(4,), (3,), (None,)], "x int")
    assert col_values(df, N.at_least("x", 4)) == [1, 0, 0]


@pytest.mark.parametrize(
    "as_of,start,want",
    [("2023-02-28", "2020-02-29", 2), ("2023-03-01", "2020-02-29", 3), ("2023-05-05", "2020-05-05", 3), ("2023-05-04", "2020-05-05", 2)],
)
def test_whole_years(spark, as_of, start, want):
    column = D.years_between(F.lit(dt.date.fromisoformat(as_of)), F.lit(dt.date.fromisoformat(start)))
    assert one(spark, column) == want


def test_add_days_rounds_half_to_even_and_keeps_null(spark):
    df = spark.createDataFrame([(2.5,), (3.5,), (2.7,), (None,)], "d double")
    start = F.lit(dt.date(2020, 1, 1))
    assert col_values(df, D.add_days(start, "d")) == [dt.date(2020, 1, 3), dt.date(2020, 1, 5), dt.date(2020, 1, 4), None]


def test_minutes_cross_midnight_whatever_the_zone(spark):
    df = spark.createDataFrame([("2024-03-30 23:58:30", "2024-03-31 03:01:00")], "s string, e string")
    df = df.select(F.col("s").cast("timestamp_ntz").alias("s"), F.col("e").cast("timestamp_ntz").alias("e"))
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        assert df.select(D.minutes_between("e", "s")).first()[0] == 182
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_day_ranges_keep_the_whole_last_day(spark):
    df = spark.createDataFrame([("2023-12-31 23:59:59",), ("2024-01-01 00:00:00",), ("2022-01-01 00:00:00",)], "s string")
    df = df.select(F.col("s").cast("timestamp_ntz").alias("t"), F.to_date("s").alias("d"))
    for c in ("t", "d"):
        assert col_values(df, D.in_years(c, 2022, 2023)) == [True, False, True]


def test_calendar_names(spark):
    assert one(spark, D.weekday_name(F.lit(dt.date(2024, 1, 1)))) == "Monday"
    assert one(spark, D.month_name(F.lit(5))) == "Май"
    assert one(spark, D.month_start(F.lit(dt.date(2024, 1, 31)))) == dt.date(2024, 1, 1)


def test_segment_edges_and_gaps(spark):
    days = [None, 0.0, 1.0, 30.0, 30.5, 31.0, 90.0, 91.0, 180.0, 181.0]
    df = spark.createDataFrame([(d,) for d in days], "d double")
    label = L.segment("d", [(1, 30, "a"), (31, 90, "b"), (91, 180, "c"), (181, None, "d")], "other")
    assert col_values(df, label) == ["other", "other", "a", "a", "other", "b", "b", "c", "c", "d"]


def test_segment_without_other_gives_null(spark):
    df = spark.createDataFrame([(7,)], "d int")
    assert col_values(df, L.segment("d", [(1, 3, "a")])) == [None]


def test_cut_is_right_closed_and_leaves_the_lowest_edge_out(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 10.0, 10.5, 11.0, 70.0, 71.0, None)], "x double")
    edges = [0, 10, 70]
    assert col_values(df, L.cut("x", edges)) == [None, "(0, 10]", "(10, 70]", "(10, 70]", "(10, 70]", None, None]
    assert col_values(df, L.cut("x", edges, include_lowest=True))[0] == "(0, 10]"


def test_upper_bands_put_missing_last_unless_named(spark):
    df = spark.createDataFrame([(18,), (19,), (46,), (None,)], "a int")
    bands = [(18, "to 18"), (45, "19-45")]
    assert col_values(df, L.upper_bands("a", bands, "45+")) == ["to 18", "19-45", "45+", "45+"]
    assert col_values(df, L.upper_bands("a", bands, "45+", "unknown"))[-1] == "unknown"


def test_first_true_passes_over_null(spark):
    df = spark.createDataFrame([(None, True), (True, True), (False, None)], "a boolean, b boolean")
    assert col_values(df, L.first_true([("a", "A"), ("b", "B")], "none")) == ["B", "A", "none"]


def test_matches_any_is_case_sensitive_and_null_safe_in_filters(spark):
    df = spark.createDataFrame([("Data analyst",), ("data analyst",), (None,)], "t string")
    assert df.filter(L.matches_any("t", ["data", "xyz"])).count() == 1


@pytest.mark.parametrize("t,df,want", [(2.0, 10.0, 0.0733880348), (1.96, 10000.0, 0.0500235202), (0.1, 57.3, 0.9206933854), (12.7062047362, 1.0, 0.05), (1.959963984540054, 1e12, 0.05)])
def test_student_two_sided(spark, t, df, want):
    assert one(spark, 2 * P.t_sf(F.lit(t), F.lit(df))) == pytest.approx(want, abs=2e-10)


def test_tails_are_symmetric(spark):
    both = one(spark, P.t_sf(F.lit(1.7), F.lit(8.0)) + P.t_sf(F.lit(-1.7), F.lit(8.0)))
    assert both == pytest.approx(1.0, abs=1e-12)
    assert one(spark, P.norm_sf(F.lit(1.959963984540054))) == pytest.approx(0.025, abs=1e-14)
    assert one(spark, P.norm_cdf(F.lit(-8.0))) == pytest.approx(6.22096057427e-16, rel=1e-6)
    assert one(spark, P.t_sf(F.lit(None).cast("double"), F.lit(8.0))) is None


def test_verdict_is_strict_and_unknown_cannot_reject(spark):
    df = spark.createDataFrame([(0.0001,), (0.05,), (0.1,), (None,)], "p double")
    no = "cannot reject H0"
    assert col_values(df, P.verdict("p")) == ["accept H1", no, no, no]


def test_alternative_is_checked():
    with pytest.raises(ValueError):
        P.norm_p(F.lit(1.0), "larger")


def test_gamma_tail_matches_reference_values(spark):
    """Against sums in exact fractions: for whole a, Q(a, x) = exp(-x) * sum of x^k / k! below a."""
    from fractions import Fraction

    from tidemark.functions.probability import chi2_sf, norm_sf

    cases = [(a, x) for a in (1, 2, 5, 30, 400) for x in (0.25, 1.0, 3.5, 8.0, 29.0, 31.5, 60.0, 380.0, 470.0, 700.0)]
    df = spark.createDataFrame([(2.0 * a, 2.0 * x) for a, x in cases], "k double, x double")
    for (a, x), row in zip(cases, df.select(chi2_sf("x", "k").alias("p")).collect()):
        total, term = Fraction(0), Fraction(1)
        for k in range(a):
            total += term
            term = term * Fraction(x) / (k + 1)
        want = math.exp(math.log(total.numerator) - math.log(total.denominator) - x)
        assert row.p == pytest.approx(want, rel=1e-9), (a, x)
    odd = spark.createDataFrame([(0.3,), (1.0,), (4.0,), (25.0,), (100.0,), (400.0,)], "x double")
    for row in odd.select(chi2_sf("x", F.lit(1)).alias("p"), (2 * norm_sf(F.sqrt("x"))).alias("q")).collect():
        assert row.p == pytest.approx(row.q, rel=1e-9)
    edge = spark.createDataFrame([(0.0, 3.0), (None, 3.0), (1.0, 0.0), (-1.0, 2.0)], "x double, k double")
    assert [r.p for r in edge.select(chi2_sf("x", "k").alias("p")).collect()] == [1.0, None, None, 1.0]


def test_solved_sizes_have_the_wanted_power(spark):
    from tidemark.operators.experiment import detectable_effect, solve_arm_size, two_tailed_power

    one = spark.range(1)
    assert one.select(F.round(solve_arm_size(0.03), 2).alias("n")).first().n == 17441.91
    for effect, alpha, power, ratio_b in ((0.03, 0.05, 0.8, 1.0), (0.5, 0.3, 0.35, 1.0), (-0.2, 0.01, 0.95, 3.0), (1.5, 0.05, 0.06, 0.5)):
        n = F.lit(one.select(solve_arm_size(effect, alpha, power, ratio_b).alias("n")).first().n)
        row = one.select(two_tailed_power(F.lit(effect), n, alpha, ratio_b).alias("p"), detectable_effect(n, alpha, power, ratio_b).alias("e")).first()
        assert row.p == pytest.approx(power, abs=1e-10) and row.e == pytest.approx(abs(effect), rel=1e-9)
    assert one.select(solve_arm_size(F.lit(0.0)).alias("n"), detectable_effect(F.lit(0)).alias("e")).first().n is None
    with pytest.raises(ValueError):
        solve_arm_size(0.1, 0.5, 0.4)
