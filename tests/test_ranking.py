import hashlib

import numpy as np
import pandas as pd
import pytest

from armlift.functions.digests import Digests
from armlift.operators import capture_interval, ranking
from tests.conftest import by

SCHEMA = "metric string, unit_id long, score double, t int, y int"


def scored(spark, n, n_scores, seed=0, effect=0.4):
    rng = np.random.default_rng(seed)
    score = rng.integers(0, n_scores, n) / n_scores
    t = rng.integers(0, 2, n)
    y = (rng.random(n) < 0.1 + effect * t * score).astype(int)
    pdf = pd.DataFrame({"metric": "visit", "unit_id": rng.permutation(n), "score": score, "t": t, "y": y})
    return pdf, spark.createDataFrame(pdf, SCHEMA)


def brute_force_curve(pdf, points=101):
    """Incremental outcomes of the first units, counted anew at every position."""
    order = pdf.sort_values(["score", "unit_id"], ascending=[False, True]).reset_index(drop=True)
    n = len(order)
    curve = [(0.0, 0.0)]
    for place in sorted({int(k * (n - 1) / (points - 1)) for k in range(points)}):
        top = order.iloc[: place + 1]
        treated, control = top[top.t == 1], top[top.t == 0]
        scaled = control.y.sum() * len(treated) / len(control) if len(control) else None
        curve.append(((place + 1) / n, treated.y.sum() - scaled if scaled is not None else 0.0))
    return curve


@pytest.mark.parametrize("n, n_scores", [(997, 997), (1234, 3), (500, 1), (101, 50), (60, 60), (2, 2), (1, 1)])
def test_curve_matches_brute_force(spark, n, n_scores):
    pdf, df = scored(spark, n, n_scores)
    found = [(r.phi, r.q) for r in ranking.qini_curve(ranking.ranked(df)).orderBy("point").collect()]
    expected = brute_force_curve(pdf)
    assert len(found) == len(expected)
    assert np.allclose(found, expected, rtol=1e-12, atol=1e-9)


def test_ranks_are_global_per_metric_and_independent_of_partitioning(spark):
    pdf, _ = scored(spark, 700, 5)
    both = pd.concat([pdf, pdf.assign(metric="conversion", score=-pdf.score)])
    df = spark.createDataFrame(both, SCHEMA)
    ranks = lambda d: {(r.metric, r.unit_id): (r["rank"], r.n) for r in ranking.ranked(d).collect()}
    one, many = ranks(df.repartition(1)), ranks(df.repartition(13))
    assert one == many
    for metric, ascending in (("visit", False), ("conversion", True)):
        order = pdf.sort_values(["score", "unit_id"], ascending=[ascending, True])
        assert [one[metric, u][0] for u in order.unit_id] == list(range(1, 701))


def test_summary_and_capture(spark):
    pdf, df = scored(spark, 3000, 400)
    curve = ranking.qini_curve(ranking.ranked(df))
    phi, q = np.array(brute_force_curve(pdf)).T
    row = ranking.qini_coefficient(curve).first()
    assert row.total_incremental == pytest.approx(q[-1])
    assert row.qini == pytest.approx((np.trapezoid(q, phi) - q[-1] / 2) / abs(q[-1]))
    captures = by(ranking.capture(curve, (0.1, 0.3, 0.5, 1.0)).collect(), "share")
    for share in (0.1, 0.3, 0.5):
        assert captures[share]["capture"] == pytest.approx(np.interp(share, phi, q) / q[-1])
    assert captures[1.0]["capture"] == pytest.approx(1.0)
    shares = ranking.normalized_curve(curve).orderBy("point").collect()
    assert shares[0].q_share == 0 and shares[-1].q_share == pytest.approx(1.0)


def test_no_incremental_outcomes(spark):
    rows = [("visit", i, float(i), i % 2, 0) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    ranks = ranking.ranked(df)
    curve = ranking.qini_curve(ranks)
    assert ranking.qini_coefficient(curve).first().qini == 0
    assert {r.capture for r in ranking.capture(curve).collect()} == {None}
    assert capture_interval.capture_bootstrap(ranks, n_boot=5).count() == 0


@pytest.mark.parametrize("n", [1000, 1003, 57, 10])
def test_deciles_follow_quantile_cuts(spark, n):
    pdf, df = scored(spark, n, n)
    place = pdf.sort_values(["score", "unit_id"], ascending=[False, True]).reset_index(drop=True)
    place["decile"] = pd.qcut(pd.Series(range(1, n + 1)), 10, labels=False) + 1
    found = by(ranking.deciles(ranking.ranked(df)).collect(), "decile")
    assert sum(r["n"] for r in found.values()) == n
    for d, part in place.groupby("decile"):
        treated, control = part[part.t == 1].y, part[part.t == 0].y
        assert found[d]["n"] == len(part)
        assert found[d]["predicted_uplift"] == pytest.approx(part.score.mean())
        if len(treated) > 1 and len(control) > 1:
            lift = treated.mean() - control.mean()
            se = np.sqrt(treated.var(ddof=1) / len(treated) + control.var(ddof=1) / len(control))
            assert found[d]["observed_uplift"] == pytest.approx(lift)
            assert found[d]["ci_hi"] == pytest.approx(lift + 1.959963984540054 * se)


def test_capture_bootstrap_agrees_with_resampling_units(spark):
    pdf, df = scored(spark, 4000, 4000, seed=3)
    ranks = ranking.ranked(df)
    found = by(capture_interval.capture_bootstrap(ranks, n_boot=200).collect(), "share")
    again = by(capture_interval.capture_bootstrap(ranks.repartition(5), n_boot=200).collect(), "share")
    assert found == again
    rng = np.random.default_rng(1)
    draws = []
    for _ in range(200):
        phi, q = np.array(brute_force_curve(pdf.iloc[rng.integers(0, len(pdf), len(pdf))], 51)).T
        draws.append(np.interp([0.1, 0.3, 0.5], phi, q) / q[-1])
    for i, share in enumerate((0.1, 0.3, 0.5)):
        lo, hi = np.percentile(np.array(draws)[:, i], [2.5, 97.5])
        assert found[share]["n_boot"] == 200
        assert abs(found[share]["boot_capture_lo"] - lo) < 0.3 * (hi - lo)
        assert abs(found[share]["boot_capture_hi"] - hi) < 0.3 * (hi - lo)


def test_digests_of_many_texts_are_md5():
    beginnings = [f"capture6:{i * 7919}".encode() + b"x" * (i % 70) for i in range(300)] + [b"", b"a" * 200]
    digests = Digests(beginnings)
    for ending in (b"", b":0", b":1234"):
        found = digests.of(ending)
        for i, text in enumerate(beginnings):
            assert found[:, i].astype(">u4").tobytes() == hashlib.md5(text + ending).digest()


def test_slice_sums_weigh_every_unit_where_it_lies(spark):
    rows = [("a", i, i % 3 % 2, i % 2, i + 1, 40) for i in range(40)] + [("b", i, 1, None, i + 1, 5) for i in range(5)]
    ranks = spark.createDataFrame(rows, "metric string, unit_id bigint, t int, y int, rank bigint, n bigint")
    ranks = ranks.selectExpr("metric", "unit_id", "0D as score", "t", "y", "rank", "n")
    sums = capture_interval.slice_sums(ranks, 6, "salt", n_slices=4)
    # one row a unit and hash would grow with the units
    assert "explode" not in sums._jdf.queryExecution().toString()

    expected, limits = {}, capture_interval.poisson_limits()
    for metric, unit, t, y, rank, n in rows:
        for replicate in range(6):
            digest = hashlib.md5(f"salt:{unit}:{replicate // 4}".encode()).hexdigest()
            drawn = int(digest[replicate % 4 * 8 :][:8], 16)
            weight = sum(drawn >= limit for limit in limits)
            cell = expected.setdefault((metric, replicate, (rank - 1) * 4 // n), [0, 0, None, None])
            cell[0], cell[1] = cell[0] + weight * t, cell[1] + weight * (1 - t)
            if y is not None:
                cell[2], cell[3] = (cell[2] or 0) + weight * t * y, (cell[3] or 0) + weight * (1 - t) * y
    assert {tuple(r)[:3]: list(r)[3:] for r in sums.collect()} == expected
    assert dict(sums.dtypes)["n_t"] == "bigint"
