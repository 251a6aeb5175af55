"""Inputs at the edge: results are null or neutral, never an exception."""

import math

import pytest

from armlift.operators import arms, bootstrap, compliance, lift, power, profile, segments, validity
from armlift.schema import Roles
from tests.conftest import by

ROLES = Roles(features=("a", "b"))
SCHEMA = "unit_id long, a double, b double, treatment int, conversion int, visit int, exposure int"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(
        [
            (1, 1.0, 5.0, 1, 0, 1, 1),
            (2, math.nan, 5.0, 1, 1, 0, 0),
            (3, None, 5.0, 0, 0, 0, 1),
            (4, 2.0, 5.0, 0, 0, 2, 0),
            (5, 2.0, 5.0, None, 0, 0, 0),
            (6, 2.0, 5.0, 0, 0, 2, 0),
        ],
        SCHEMA,
    )


@pytest.fixture(scope="module")
def treated_only(spark):
    rows = [(i, float(i % 3), 5.0, 1, 0, i % 2, i % 2) for i in range(20)]
    return spark.createDataFrame(rows, SCHEMA)


def test_missing_values_and_domains(odd):
    missing = by(profile.missing_counts(odd, ROLES).collect(), "column")
    assert (missing["a"]["n_null"], missing["a"]["n_nan"]) == (1, 1)
    assert missing["treatment"]["n_null"] == 1
    rows = profile.row_accounting(odd, ROLES).first()
    assert (rows.rows_read, rows.rows_written, rows.rows_dropped) == (6, 3, 3)
    assert profile.drop_missing(odd, ROLES).count() == 3
    domains = by(profile.binary_domains(odd, ROLES).collect(), "column")
    assert domains["exposure"]["is_binary"] and not domains["visit"]["is_binary"]
    values = {(r.column, r.value): r.n for r in profile.binary_values(odd, ROLES).collect()}
    assert values["visit", 2] == 2 and ("treatment", None) not in values
    checks = by(profile.consistency(odd, ROLES).collect(), "check")
    assert checks["control_exposed"]["n_violations"] == 1
    assert checks["conversion_without_visit"]["n_violations"] == 1
    share = profile.treatment_share(odd, ROLES).first()
    assert share.treatment_share == pytest.approx(2 / 6)


def test_duplicates_count_null_and_nan_as_values(odd):
    found = profile.duplicates(odd, ROLES).first()
    # units 4 and 6 agree in full; unit 5 shares their features
    assert (found.n, found.duplicate_rows, found.duplicate_vectors) == (6, 1, 2)


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert profile.duplicates(empty, ROLES).first().n == 0
    assert profile.row_accounting(empty, ROLES).first().rows_read == 0
    assert profile.treatment_share(empty, ROLES).first().treatment_share is None
    assert [r.rel_lift for r in lift.lift(arms.experiment_counts(empty, ROLES)).collect()] == [None, None]
    assert validity.sample_ratio(profile.arm_sizes(empty, ROLES)).first().p_value is None


def test_missing_control_arm(treated_only):
    counts = arms.experiment_counts(treated_only, ROLES)
    for row in lift.lift(counts).collect():
        assert row.n_c == 0 and row.rate_control is None and row.p_value is None and row.rel_lo is None
    assert all(r.mde_abs is None for r in power.power_grid(counts).collect())
    assert all(r.n_actual is None for r in power.units_needed(counts).collect())
    assert bootstrap.lift_bootstrap(counts, n_boot=10).count() == 0
    cc = compliance.compliance_counts(compliance.compliance_cells(treated_only, ROLES), ROLES)
    assert all(r.cace is None for r in compliance.effects(cc).collect())
    assert bootstrap.compliance_bootstrap(cc, n_boot=10).count() == 0
    balance = by(validity.balance(treated_only, ROLES).collect(), "feature")
    assert balance["a"]["smd"] is None and balance["a"]["welch_p"] is None


def test_no_successes(spark):
    counts = spark.createDataFrame(
        [("visit", 100, 5, 50, 0)], "metric string, n_t long, x_t long, n_c long, x_c long"
    )
    row = lift.lift(counts).first()
    assert row.rel_lift is None and row.rel_lo is None and row.p_value is not None


def test_constant_feature(spark):
    rows = [(i, float(i), 5.0, i % 2, 0, 0, 0) for i in range(40)]
    balance = by(validity.balance(spark.createDataFrame(rows, SCHEMA), ROLES).collect(), "feature")["b"]
    assert balance["smd"] == 0 and balance["variance_ratio"] is None and balance["welch_p"] is None
    assert balance["balanced"]


def test_segment_in_one_arm_only_and_without_variance(spark):
    rows = [(i, 0.0 if i < 10 else 1.0, 5.0, 1 if i < 10 else i % 2, 0, i % 3 == 0, 0) for i in range(60)]
    df = spark.createDataFrame([(*r[:5], int(r[5]), r[6]) for r in rows], SCHEMA)
    edges = {"a": [0.0], "b": []}
    table = segments.segment_lift(segments.segment_sums(df, edges, ROLES), edges, ROLES)
    cells = by(table.collect(), "feature", "bucket", "metric")
    assert cells["a", 0, "visit"]["n_c"] == 0 and cells["a", 0, "visit"]["lift"] is None
    assert cells["b", 0, "visit"]["range"] == "(-inf, +inf]"
    # nobody converts: no variance, so the test says 1
    assert cells["a", 1, "conversion"]["p_value"] == 1.0 and cells["a", 1, "conversion"]["se"] == 0
    adjusted = by(segments.adjust_false_discovery(table).collect(), "feature", "bucket", "metric")
    assert adjusted["a", 0, "visit"]["p_bh"] is None and adjusted["a", 1, "visit"]["family_size"] == 2
    tests = by(segments.heterogeneity(table).collect(), "feature", "metric")
    assert tests["a", "visit"]["n_without_se"] == 1 and tests["a", "visit"]["p_value"] == 1.0
    assert tests["a", "conversion"]["q"] == 0 and tests["b", "visit"]["n_tests"] == 4


def test_missing_values_form_their_own_bucket(spark):
    df = spark.createDataFrame([(1, math.nan, 5.0, 1, 0, 0, 0), (2, None, 5.0, 0, 0, 0, 0), (3, 9.0, 5.0, 1, 0, 0, 0)], SCHEMA)
    sums = segments.segment_sums(df, {"a": [1.0, 2.0]}, ROLES).collect()
    assert sorted(((r.bucket, r.n_t + r.n_c) for r in sums), key=str) == [(2, 1), (None, 2)]
