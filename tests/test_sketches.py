"""Sketches of parts against the whole table."""

import numpy as np
import pytest

from armlift.operators import sketches
from armlift.schema import Roles
from tests.conftest import by

ROLES = Roles(features=("a", "b", "c"))


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(8)
    rows = [(i, 1e6 + float(x), float(i % 7), None) for i, x in enumerate(rng.standard_normal(6000))]
    rows += [(6000, float("nan"), None, None), (6001, None, 3.0, None)]
    return spark.createDataFrame(rows, "unit_id bigint, a double, b double, c double").repartition(6)


def test_merged_parts_equal_the_whole(table):
    parts = [sketches.part_sketches(table.where(f"unit_id % 4 = {i}"), ROLES) for i in range(4)]
    nested = sketches.merged_sketches(sketches.merged_sketches(*parts[:3]), parts[3])
    values = {f: np.array([r[f] for r in table.collect() if r[f] is not None and not np.isnan(r[f])]) for f in "ab"}
    for merged in (sketches.merged_sketches(*parts), nested, sketches.part_sketches(table, ROLES)):
        found = by(sketches.sketched_summary(merged).collect(), "feature")
        assert found["c"] == {"feature": "c", "n": 0, "n_missing": 6002, "approx_distinct": 0,
                              **{c: None for c in ("mean", "stddev", "min", "p25", "p50", "p75", "max")}}
        for f, x in values.items():
            r = found[f]
            assert (r["n"], r["n_missing"], r["min"], r["max"]) == (len(x), 6002 - len(x), x.min(), x.max())
            assert r["mean"] == pytest.approx(x.mean(), rel=1e-14) and r["stddev"] == pytest.approx(x.std(ddof=1), rel=1e-9)
            for q in (25, 50, 75):
                assert (x < r[f"p{q}"]).mean() <= q / 100 + 0.004 and (x <= r[f"p{q}"]).mean() >= q / 100 - 0.004
            assert abs(r["approx_distinct"] - len(set(x))) <= 0.03 * len(set(x))


def test_edges_come_from_sketches_alone(table):
    edges = sketches.sketched_edges(sketches.part_sketches(table, ROLES), 5)
    assert edges["b"] == [1.0, 2.0, 4.0, 5.0] and edges["c"] == [] and len(edges["a"]) == 4
    near = by(sketches.rank_bounds(table, sketches.part_sketches(table, ROLES), ROLES, (0.2, 0.4, 0.6, 0.8), 0.004).collect(), "feature")
    assert set(near) == {"a", "b"} and all(r["is_near"] for r in near.values())


def test_empty_parts_change_nothing(table):
    whole, none = (sketches.part_sketches(df, ROLES) for df in (table, table.limit(0)))
    merged = by(sketches.sketched_summary(sketches.merged_sketches(none, whole, none)).collect(), "feature")
    for f, r in by(sketches.sketched_summary(whole).collect(), "feature").items():
        assert {c: merged[f][c] for c in ("n", "n_missing", "min", "max", "p50")} == {c: r[c] for c in ("n", "n_missing", "min", "max", "p50")}
        for c in ("mean", "stddev", "approx_distinct"):  # merging rounds once more, and takes the estimate of a union
            assert merged[f][c] == (None if r[c] is None else pytest.approx(r[c], rel=0.01 if c == "approx_distinct" else 1e-12))
    assert all(r.n == 0 and r.mean is None and r.p50 is None for r in sketches.sketched_summary(none).collect())
