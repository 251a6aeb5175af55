import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from armlift.__main__ import main as command_line
from armlift.operators import arms, bootstrap, compliance, lift, power, profile, quantiles, segments, uplift, validity
from armlift.plans import publish, steps
from armlift.schema import Roles
from armlift.sources import experiment_table, results
from tests.conftest import SMALL, by

ROLES = Roles()


@pytest.fixture(scope="module")
def csv_folder(raw, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("csv") / "raw")
    raw.select(*ROLES.columns).coalesce(1).write.option("header", True).option("compression", "gzip").csv(path)
    return path


@pytest.fixture(scope="module")
def ingested(spark, csv_folder, tmp_path_factory):
    target = str(tmp_path_factory.mktemp("table") / "experiment")
    return steps.ingest(spark, csv_folder, target, partitions=4), experiment_table.read_experiment(spark, target)


def test_ingest_keeps_complete_rows_and_profiles_all(raw, ingested):
    tables, table = ingested
    rows = tables["rows"].first()
    assert (rows.rows_read, rows.rows_written) == (15000, 14743) and table.count() == 14743
    assert table.select("unit_id").distinct().count() == 14743
    for name, build in {
        "missing": profile.missing_counts,
        "binary_domain": profile.binary_domains,
        "consistency": profile.consistency,
        "feature_summary": profile.feature_summary,
    }.items():
        # quantile sketches depend on the order in which they are merged
        sketches = ("p25", "p50", "p75")
        assert sorted(tables[name].drop(*sketches).collect()) == sorted(build(raw).drop(*sketches).collect())
    assert tables["duplicates"].first().duplicate_rows == 0


def test_content_keys_do_not_change_between_ingests(spark, csv_folder, tmp_path):
    keys = []
    for partitions in (2, 5):
        target = str(tmp_path / f"table{partitions}")
        steps.ingest(spark, csv_folder, target, partitions=partitions, key="content")
        keys.append({r.unit_id for r in spark.read.parquet(target).select("unit_id").collect()})
    assert keys[0] == keys[1] and len(keys[0]) == 14743


def test_csv_values_that_do_not_parse_become_null_and_headers_are_checked(spark, tmp_path):
    header = ",".join(ROLES.columns)
    row = ",".join(["1.5"] * 11 + ["abc"] + ["1", "0", "1", "1"])
    (tmp_path / "good.csv").write_text(f"{header}\n{row}\n")
    found = experiment_table.read_raw_csv(spark, str(tmp_path / "good.csv")).first()
    assert found.f0 == 1.5 and found.f11 is None and found.treatment == 1
    swapped = ",".join(["f1", "f0", *ROLES.columns[2:]])
    (tmp_path / "swapped.csv").write_text(f"{swapped}\n{row}\n")
    with pytest.raises(Exception):
        experiment_table.read_raw_csv(spark, str(tmp_path / "swapped.csv")).collect()
    by_position = experiment_table.read_raw_csv(spark, str(tmp_path / "swapped.csv"), check_header=False)
    assert by_position.first().f0 == 1.5


def test_rejected_lines_are_kept_with_reason_and_file(spark, tmp_path):
    header = ",".join(ROLES.columns)
    good = ["1.5"] * 12 + ["1", "0", "1", "1"]
    lines = {
        "a.csv": [good, good[:-1], [*good, "7"], ["x", *good[1:]]],
        "b.csv": [[*good[:15], "2.5"], ["", *good[1:]], ["1e3", *good[1:]]],
    }
    for file, rows in lines.items():
        (tmp_path / file).write_text("\n".join([header, *[",".join(r) for r in rows]]) + "\n")
    rows = experiment_table.read_with_rejects(spark, str(tmp_path)).cache()
    found = experiment_table.rejects(rows).collect()
    assert sorted((r.source_file[-5:], r.reason, r.rejected_line) for r in found) == sorted([
        ("a.csv", "number of fields", ",".join(good[:-1])), ("a.csv", "number of fields", ",".join([*good, "7"])),
        ("a.csv", "value of f0", ",".join(["x", *good[1:]])), ("b.csv", "value of exposure", ",".join([*good[:15], "2.5"])),
    ])
    assert {(r.source_file[-5:], r.reason): r.n for r in experiment_table.reject_counts(experiment_table.rejects(rows)).collect()} == {
        ("a.csv", "number of fields"): 2, ("a.csv", "value of f0"): 1, ("b.csv", "value of exposure"): 1,
    }
    assert rows.count() == 7 and rows.where("rejected_line is null").count() == 3


def test_digests_tell_nulls_apart(spark):
    roles = Roles(features=("a", "b"), metrics=("visit", "conversion"))
    values = [(None, 1.0), (1.0, None), (None, None), (0.0, 1.0), (-0.0, 1.0), (float("nan"), 1.0), (float("nan"), 1.0), (1.0, 1.0)]
    df = spark.createDataFrame([(*v, 1, 0, 0, i // 7) for i, v in enumerate(values)], "a double, b double, treatment int, visit int, conversion int, exposure int")
    found = profile.duplicates(df.union(df.limit(1)), roles).first()
    assert (found.n, found.duplicate_rows, found.duplicate_vectors) == (9, 3, 3)


def test_counts_do_not_depend_on_partitioning(units):
    whole = arms.experiment_counts(units).collect()
    for n in (1, 13):
        spread = units.repartition(n)
        assert arms.experiment_counts(spread).collect() == whole
        assert sorted(power.bucket_arm_sums(spread).collect()) == sorted(power.bucket_arm_sums(units).collect())
    assert sum(r.n for r in profile.arm_sizes(units).collect()) == units.count()


def test_buckets_nest_and_cover_all_units(units):
    sums = power.bucket_arm_sums(units, bucket_counts=(4, 6))
    totals = sums.filter("metric = 'visit'").groupBy("k").agg(F.sum(F.col("n_t") + F.col("n_c")).alias("n"), F.count("*").alias("b"))
    assert {(r.k, r.n, r.b) for r in totals.collect()} == {(4, 14743, 4), (6, 14743, 6)}
    # counts without a common split of any use
    sums = power.bucket_arm_sums(units, bucket_counts=(997, 1009)).filter("metric = 'visit'")
    found = sums.groupBy("k").agg(F.sum(F.col("n_t") + F.col("n_c")).alias("n"), F.max("bucket").alias("b"))
    assert {(r.k, r.n, r.b) for r in found.collect()} == {(997, 14743, 996), (1009, 14743, 1008)}


def test_empirical_power_is_near_the_analytic_power(units):
    tables = steps.measure_power(units)
    for r in tables["empirical_power"].filter("k = 10").collect():
        assert abs(r.empirical_power - r.analytic_power) < 3 * np.sqrt(0.25 / r.n_buckets)


def test_bootstrap_agrees_with_the_analytic_interval_and_is_reproducible(spark):
    counts = spark.createDataFrame(
        [("visit", 1188265, 57682, 209693, 8010)], "metric string, n_t long, x_t long, n_c long, x_c long"
    )
    boot = bootstrap.lift_bootstrap(counts, n_boot=4000)
    row = boot.first()
    assert row.n_boot == 4000 and row.share_not_positive == 0
    assert lift.interval_agreement(lift.lift(counts), boot).first().all_agree
    assert bootstrap.lift_bootstrap(counts.repartition(7), n_boot=4000).first() == row
    assert bootstrap.lift_bootstrap(counts, n_boot=4000, seed=8).first() != row
    odd = bootstrap.lift_replicates(counts, n_boot=1203)
    assert odd.count() == 1203 and odd.select("replicate").distinct().count() == 1203


def test_compliance_bootstrap_agrees_with_the_delta_method(units):
    counts = compliance.compliance_counts(compliance.compliance_cells(units))
    boot = by(bootstrap.compliance_bootstrap(counts).collect(), "metric")
    exact = by(compliance.effect_intervals(counts).collect(), "metric")
    for m in ROLES.metrics:
        width = exact[m]["cace_hi"] - exact[m]["cace_lo"]
        assert abs(boot[m]["boot_cace_lo"] - exact[m]["cace_lo"]) < 0.1 * width
        assert abs(boot[m]["boot_cace_hi"] - exact[m]["cace_hi"]) < 0.1 * width
    top = validity.rank_by_imbalance(compliance.exposure_selection(units), top=5).orderBy("place").collect()
    assert len(top) == 5 and top[0].feature == "f0"


def test_exact_edges_and_segments(spark, units):
    edges = quantiles.bucket_edges(units, ROLES.features, 5, error=0)
    assert edges["f0"] == [101222.87, 201498.11, 300832.61, 399707.11]
    assert edges["f4"] == [2.0, 3.0, 4.0] and edges["f11"] == [1.0]
    assert quantiles.bucket_edges(units.repartition(13), ROLES.features, 5, error=0) == edges
    close = quantiles.bucket_edges(units, ROLES.features, 5)
    for f in ("f0", "f2"):
        values = np.sort([r[0] for r in units.select(f).collect()])
        for i, e in enumerate(close[f]):
            assert abs(np.searchsorted(values, e) / len(values) - (i + 1) / 5) < 0.003
    sums = segments.segment_sums(units, edges)
    totals = sums.groupBy("feature").agg(F.sum(F.col("n_t") + F.col("n_c")).alias("n")).collect()
    assert len(totals) == 12 and {r.n for r in totals} == {14743}
    table = segments.adjust_false_discovery(segments.segment_lift(sums, edges)).toPandas()
    for _, family in table.groupby("metric"):
        p = family.sort_values("p_value")
        expected = [min(1.0, (p.p_value.values[i:] * len(p) / np.arange(i + 1, len(p) + 1)).min()) for i in range(len(p))]
        assert np.allclose(p.p_bh, expected) and (p.p_bh >= p.p_value - 1e-15).all()
    tests = by(segments.heterogeneity(segments.segment_lift(sums, edges)).collect(), "feature", "metric")
    assert tests["f11", "visit"]["p_value"] == 1.0 and tests["f0", "visit"]["n_tests"] == 24
    assert tests["f0", "visit"]["p_bonferroni"] < 0.05 and tests["f2", "visit"]["p_bonferroni"] < 0.05


def test_exact_quantiles_of_a_column_dominated_by_one_value(spark):
    values = [7.0] * 900 + [float(i) for i in range(100)]
    df = spark.createDataFrame([(v,) for v in values], "a double").repartition(9)
    found = {r.probability: r.value for r in quantiles.exact_quantiles(df, ("a",), [0.001, 0.005, 0.5, 0.99, 1.0]).collect()}
    ordered = sorted(values)
    assert found == {0.001: ordered[0], 0.005: ordered[4], 0.5: 7.0, 0.99: ordered[989], 1.0: 99.0}


def test_even_edges_are_the_exact_quantiles(units):
    for n in (2, 5, 40):
        assert quantiles.even_edges(units, ROLES.features, n) == quantiles.bucket_edges(units, ROLES.features, n, error=0)


def test_sample_and_split(units):
    sample = uplift.sample_units(units, 5000)
    assert abs(sample.count() - 5000) < 4 * np.sqrt(5000)
    assert uplift.sample_units(units.repartition(3), 5000).agg(F.sum("unit_id")).first() == sample.agg(F.sum("unit_id")).first()
    assert uplift.sample_units(units, 10**6).count() == units.count()
    sizes = by(uplift.split_units(units, exact=True).groupBy("treatment", "is_test").count().collect(), "treatment", "is_test")
    for arm, n in ((0, 2192), (1, 12551)):
        assert sizes[arm, True]["count"] == -(-n // 2) and sizes[arm, False]["count"] == n // 2


def test_whole_analysis_and_document(spark, ingested, tmp_path):
    tables, df = ingested
    tables = {
        **tables,
        **steps.check_validity(df),
        **steps.measure_lift(df, n_boot=500),
        **steps.measure_power(df),
        **steps.measure_compliance(df, n_boot=200),
        **steps.compare_segments(df),
        **steps.model_uplift(df, n_boot=20, settings=uplift.TreeSettings(n_trees=3, step=0.3, min_leaf=20)),
    }
    for r in tables["calibration"].collect():
        assert abs(r.observed - r.predicted) < 4 * np.sqrt(r.observed * (1 - r.observed) / r.n) + 0.01
    assert by(tables["qini"].collect(), "metric")["visit"]["qini"] > 0
    results.write_results(tables, str(tmp_path))
    text = publish.publish_folder(spark, str(tmp_path)).first()[0]
    assert set(results.read_results(spark, str(tmp_path), ["lift", "absent"])) == {"lift"}
    found = json.loads(text)
    assert set(found) == set(publish.CONTENTS)
    assert found["profile_rows"] == [{"n": 14743, "read": 15000}]
    rel = found["ab"]["visit"][0]
    exact = by(tables["lift"].collect(), "metric")["visit"]
    assert rel["rel"] == float(f"{exact['rel_lift']:.6g}") and rel["rel_ci"][0] == float(f"{exact['rel_lo']:.6g}")
    assert len(found["segments"]) == 12 and len(found["uplift_curve"]["visit"]) == 102


def test_command_line(spark, csv_folder, tmp_path):
    table, out = str(tmp_path / "table"), str(tmp_path / "out")
    common = ["--table", table, "--results", out]
    command_line(["ingest", "--input", csv_folder, "--partitions", "3", *common])
    command_line(["lift", "--n-boot", "100", *common])
    command_line(["validity", "--design-share", "0.5", *common])
    command_line(["publish", "--results", out])
    text = spark.read.text(f"{out}/document").first()[0]
    found = json.loads(text)
    assert found["srm"][0]["srm_detected"] and found["ab"]["visit"][0]["rel"] > 1


def test_sample_size_reaches_the_target_power(spark):
    row = "'m' as metric, 700000L as n_t, 36000L as x_t, 300000L as n_c, 15000L as x_c"
    counts = spark.sql(f"select {row}")
    for target in (0.06, 0.1, 0.5, 0.8, 0.99):
        n = power.units_needed(counts, power=target).first().n_even
        sized = power.with_rates(counts).selectExpr("*", f"{n} / 2 as size_t", f"{n} / 2 as size_c")
        assert abs(power.with_power(sized, 0.05, "p").first().p - target) < 1e-9
    assert power.units_needed(counts, power=0.04).first().n_even is None


def test_incremental_outcomes_of_very_large_arms_do_not_overflow(spark):
    row = {"y_t": "2000000000000L", "n_t": "6000000000000L", "n_c": "4000000000L", "y_c": "3000000000L"}
    curve_rows = spark.sql("select " + ", ".join(f"{v} as {c}" for c, v in row.items()))
    from armlift.functions.numeric import ratio

    value = curve_rows.selectExpr(f"y_t - y_c * {ratio('n_t', 'n_c')} as q").first().q
    assert value == 2e12 - 3e9 * (6e12 / 4e9)


def test_compressed_input_is_spread_by_default(spark, units, tmp_path):
    units.select(*Roles().columns).coalesce(1).write.option("header", True).option("compression", "gzip").csv(str(tmp_path / "gz"))
    units.select(*Roles().columns).coalesce(1).write.option("header", True).csv(str(tmp_path / "plain"))
    count = lambda path, **options: experiment_table.read_raw_csv(spark, str(tmp_path / path), **options).rdd.getNumPartitions()
    assert count("gz") == spark.sparkContext.defaultParallelism
    assert count("gz", partitions=0) == 1 and count("gz", partitions=3) == 3
    assert count("plain", partitions=0) == count("plain")


def test_the_document_derives_its_units_once(spark, monkeypatch):
    from armlift.plans import registry

    derived = []
    build = registry.order_experiment
    monkeypatch.setattr(registry, "order_experiment", lambda *place: derived.append(1) or build(*place))
    # the rest of the document is left out: only what is read matters
    monkeypatch.setattr(registry, "exact_edges", lambda units: (_ for _ in ()).throw(InterruptedError))
    with pytest.raises(InterruptedError):
        registry.QUERIES["results_paths"](spark, SMALL)
    assert len(derived) == 1
