import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from armlift.functions.numeric import finite, ratio, root, significant
from armlift.functions.student import t_two_sided
from armlift.functions.tails import chi2_tail, erfc, normal_cdf, normal_two_sided, two_sided_z
from armlift.functions.units import add_unit_id, unit_uniform


def test_erfc_matches_the_standard_library(spark):
    xs = [0.0, 1e-9, 0.1, 0.46875, 0.5, 1.0, 3.99, 4.0, 4.1, 9.0, 15.0, 26.0, -0.2, -1.0, -5.0]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").selectExpr("x", f"{erfc('x')} as e").collect()
    for r in rows:
        assert r.e == pytest.approx(math.erfc(r.x), rel=1e-14)


def test_normal_tails(spark):
    row = spark.sql(f"select {normal_cdf('z')} a, {normal_two_sided('z')} b from values (-1.5D) as t(z)").first()
    assert row.a == pytest.approx(0.0668072012688581, rel=1e-12)
    assert row.b == pytest.approx(2 * 0.0668072012688581, rel=1e-12)
    assert two_sided_z(0.95) == pytest.approx(1.959963984540054)


@pytest.mark.parametrize(
    "x, df, p",
    [
        (3.841458820694124, 1, 0.05),
        (5.991464547107979, 2, 0.05),
        (7.814727903251179, 3, 0.05),
        (9.487729036781154, 4, 0.05),
        (18.307038053275146, 10, 0.05),
        (0.0, 1, 1.0),
        (0.0, 4, 1.0),
        (5000.0, 4, 0.0),
        (1.0, 0, 1.0),
    ],
)
def test_chi2_tail(spark, x, df, p):
    found = spark.createDataFrame([(x, df)], "x double, df int").selectExpr(f"{chi2_tail('x', 'df')} as p").first().p
    assert found == pytest.approx(p, rel=1e-9, abs=1e-300)


def test_student_tail():
    t = np.array([2.0, 0.0, 2.228138851964939, 0.5, np.nan])
    df = np.array([10.0, 10.0, 10.0, 4.0, 3.0])
    expected = [0.0733880347707404, 1.0, 0.05, 0.6433299631818633]
    found = t_two_sided(t, df)
    assert found[:4] == pytest.approx(expected, rel=1e-9)
    assert np.isnan(found[4])
    # far tail of a published balance check: about -33.7 standard errors on 3 million degrees of freedom
    assert t_two_sided(np.array([33.6851211501617]), np.array([3154360.2339059804]))[0] == pytest.approx(
        1.0574712724e-248, rel=1e-6
    )


def test_student_tail_against_integration():
    for t, df in ((0.3, 2.5), (1.7, 7.0), (3.1, 60.0), (2.2, 3000.0)):
        u = np.linspace(0, t, 200_001)
        density = np.exp(
            math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - (df + 1) / 2 * np.log1p(u * u / df)
        ) / math.sqrt(df * math.pi)
        expected = 1 - 2 * np.trapezoid(density, u)
        assert t_two_sided(np.array([t]), np.array([df]))[0] == pytest.approx(expected, rel=1e-7)


def test_null_safe_arithmetic(spark):
    row = spark.sql(
        f"""select {ratio('1', '0')} a, {ratio('1', '4')} b, {root('-1e-18D')} c, {finite("double('nan')")} d,
        {finite("double('-inf')")} e, {significant('123456789.123D')} f, {significant('0.000123456789D')} g,
        {significant("double('nan')")} h"""
    ).first()
    assert (row.a, row.b, row.c, row.d, row.e, row.h) == (None, 0.25, None, None, None, None)
    assert row.f == 123457000.0 and row.g == 0.000123457


def test_unit_hash_is_stable_and_even(spark):
    ids = spark.range(40_000).withColumnRenamed("id", "unit_id")
    hashed = lambda df: df.selectExpr("unit_id", f"{unit_uniform('unit_id', 's')} as u")
    a = {r.unit_id: r.u for r in hashed(ids.repartition(1)).collect()}
    b = {r.unit_id: r.u for r in hashed(ids.repartition(13)).collect()}
    assert a == b
    counts = np.histogram(list(a.values()), bins=20, range=(0, 1))[0]
    assert counts.sum() == 40_000 and abs(counts - 2000).max() < 5 * math.sqrt(2000)


def test_added_unit_ids_are_unique_and_independent_of_partitioning(spark, monkeypatch):
    monkeypatch.setattr("armlift.functions.units.COPIES_PER_CHUNK", 7)
    rows = [(1.0, 1)] * 50 + [(2.0, 0)] * 3 + [(None, 1)] * 2
    df = spark.createDataFrame(rows, "x double, t int")
    keys = lambda d: sorted((r.unit_id, r.x or -1, r.t) for r in add_unit_id(d).collect())
    first = keys(df.repartition(1))
    assert first == keys(df.repartition(13))
    assert len({k[0] for k in first}) == len(rows)
    assert add_unit_id(df).filter(F.col("x") == 1.0).count() == 50


def test_significant_digits_round_like_decimal_formatting(spark):
    xs = [0.09765625, 0.0976562500001, 123456789.123, -123456.5, 5.128658e-39, 3e-310, 1.0, 0.001, 999999.5, 1e22, -2.5e-7]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").selectExpr("x", f"{significant('x')} as s").collect()
    for r in rows:
        assert r.s == float(f"{r.x:.6g}"), r


def test_student_tail_at_very_many_degrees_of_freedom():
    from math import erfc, sqrt

    from armlift.functions.student import log_beta_half, t_two_sided

    import math

    for a in (50.0, 80.0, 1000.0):
        direct = math.lgamma(a) + math.lgamma(0.5) - math.lgamma(a + 0.5)
        assert abs(log_beta_half(a) - direct) < 1e-12 * max(1, math.lgamma(a))
    for df in (1e9, 1e12):
        for t in (0.5, 1.96, 6.0):
            # normal tail and the first term of its expansion in 1 / df
            wider = 2 * math.exp(-t * t / 2) / sqrt(2 * math.pi) * t * (t * t + 1) / (4 * df)
            assert abs(t_two_sided([t], [df])[0] / (erfc(t / sqrt(2)) + wider) - 1) < 1e-9
