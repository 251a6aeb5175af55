"""Published sufficient statistics of a 14-million-unit experiment, and the published results."""

import pytest

from armlift.operators import compliance, lift, power, validity
from tests.conftest import by


@pytest.fixture(scope="module")
def counts(spark):
    return spark.createDataFrame(
        [("visit", 11882655, 576824, 2096937, 80105), ("conversion", 11882655, 36711, 2096937, 4063)],
        "metric string, n_t long, x_t long, n_c long, x_c long",
    )


@pytest.fixture(scope="module")
def cells(spark):
    return spark.createDataFrame(
        [
            ("visit", 11055129, 399314, 250702, 177510, 2096937, 80105, 0),
            ("conversion", 11440763, 13680, 405181, 23031, 2096937, 4063, 0),
        ],
        "metric string, t_e0_y0 long, t_e0_y1 long, t_e1_y0 long, t_e1_y1 long, c_n long, c_y1 long, c_exposed long",
    )


def test_sample_ratio(spark):
    sizes = spark.createDataFrame([(1, 11882655), (0, 2096937)], "treatment int, n long")
    row = validity.sample_ratio(sizes).first()
    assert row.observed_share == pytest.approx(0.8500001287591226, rel=1e-12)
    assert (row.ci_lo, row.ci_hi) == pytest.approx((0.849812946897621, 0.8501873106206241), rel=1e-12)
    assert row.chi2 == pytest.approx(1.817775848947767e-06, rel=1e-6)
    assert row.p_value == pytest.approx(0.9989242531217909, rel=1e-9)
    assert not row.srm_detected
    skewed = spark.createDataFrame([(1, 8600), (0, 1400)], "treatment int, n long")
    assert not validity.sample_ratio(skewed).first().srm_detected
    assert validity.sample_ratio(skewed, design_share=0.5).first().srm_detected


def test_lift(counts):
    rows = by(lift.lift(counts).collect(), "metric")
    v, c = rows["visit"], rows["conversion"]
    assert v["abs_lift"] == pytest.approx(0.010342403129198284, rel=1e-12)
    assert (v["abs_lo"], v["abs_hi"]) == pytest.approx((0.010055628213713731, 0.010629178044682837), rel=1e-9)
    assert v["rel_lift"] == pytest.approx(0.27073675539019604, rel=1e-12)
    assert (v["rel_lo"], v["rel_hi"]) == pytest.approx((0.26156617437512963, 0.2799739992231647), rel=1e-9)
    assert v["z"] == pytest.approx(65.24742956249247, rel=1e-9) and v["p_value"] == 0.0
    assert (c["rel_lo"], c["rel_hi"]) == pytest.approx((0.5436975782271103, 0.6469497610321502), rel=1e-9)
    assert c["z"] == pytest.approx(28.516529408977203, rel=1e-9)
    assert c["p_value"] == pytest.approx(7.308263285838683e-179, rel=1e-9)


def test_power_grid(counts):
    rows = by(power.power_grid(counts).collect(), "metric", "fraction")
    full = rows["visit", 1.0]
    assert full["n_total"] == 13979592 and full["mde_rel"] == pytest.approx(0.01052947455638931, rel=1e-9)
    assert rows["conversion", 1.0]["mde_abs"] == pytest.approx(9.228077217163973e-05, rel=1e-9)
    expected = {
        ("visit", 0.005): 0.9979791515439866,
        ("visit", 0.001): 0.5445763633841969,
        ("conversion", 0.01): 0.8526580512853041,
        ("conversion", 0.001): 0.1072135672901121,
    }
    for key, value in expected.items():
        assert rows[key]["power"] == pytest.approx(value, rel=1e-9)
    smallest = by(power.smallest_traffic(power.power_grid(counts)).collect(), "metric")
    assert smallest["visit"]["min_fraction"] == 0.002 and smallest["conversion"]["min_fraction"] == 0.01
    assert by(power.smallest_traffic(power.power_grid(counts), 2.0).collect(), "metric")["visit"]["min_fraction"] is None


def test_units_needed(counts):
    rows = by(power.units_needed(counts).collect(), "metric")
    assert rows["visit"]["n_actual"] == pytest.approx(24596.102927128366, rel=1e-9)
    assert rows["visit"]["n_even"] == pytest.approx(12175.691444307478, rel=1e-9)
    assert rows["conversion"]["n_actual"] == pytest.approx(123115.6651657234, rel=1e-9)
    assert rows["conversion"]["n_even"] == pytest.approx(59323.97617179786, rel=1e-9)


def test_compliance(cells):
    rows = by(compliance.effects(cells).collect(), "metric")
    v = rows["visit"]
    assert v["compliance"] == pytest.approx(0.036036727482199896, rel=1e-12)
    assert v["cace"] == pytest.approx(0.28699618005843747, rel=1e-9)
    assert v["rate_without_exposure"] == pytest.approx(0.1275414788581739, rel=1e-9)
    assert v["cace_rel"] == pytest.approx(2.2502183809361123, rel=1e-9)
    assert v["naive_vs_control"] == pytest.approx(0.37633670199706637, rel=1e-9)
    assert v["naive_vs_unexposed"] == pytest.approx(0.3796766010720702, rel=1e-9)
    assert v["cace"] * v["compliance"] == pytest.approx(v["itt"], rel=1e-12)
    ci = by(compliance.effect_intervals(cells).collect(), "metric")
    assert (ci["visit"]["cace_lo"], ci["visit"]["cace_hi"]) == pytest.approx(
        (0.2791123306876229, 0.294880029429252), rel=1e-9
    )
    assert (ci["conversion"]["itt_lo"], ci["conversion"]["itt_hi"]) == pytest.approx(
        (0.0010845057902364738, 0.001219240314026782), rel=1e-9
    )
    assert {r.verdict for r in compliance.naive_bias(compliance.effects(cells)).collect()} == {"overstates"}


def test_two_sided_compliance_subtracts_control_exposure(spark):
    cells = spark.createDataFrame(
        [("visit", 60, 10, 20, 10, 100, 5, 10)],
        "metric string, t_e0_y0 long, t_e0_y1 long, t_e1_y0 long, t_e1_y1 long, c_n long, c_y1 long, c_exposed long",
    )
    assert compliance.effects(cells).first().compliance == pytest.approx(0.3)
    assert compliance.effects(cells, two_sided=True).first().compliance == pytest.approx(0.2)
