"""The steps of an analysis, each from the experiment table to its result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from armlift.functions.numeric import group, literal
from armlift.functions.units import add_unit_id
from armlift.operators import (
    arms,
    bootstrap,
    capture_interval,
    compliance,
    lift,
    power,
    profile,
    quantiles,
    ranking,
    segments,
    uplift,
    validity,
)
from armlift.operators.moments import group_moments
from armlift.schema import Roles
from armlift.session import stored, stored_result
from armlift.sources.experiment_table import FILE, REJECTED, number_rows, read_with_rejects, reject_counts, rejects, write_experiment
from armlift.sources.results import Tables


def ingest(
    spark: SparkSession,
    source: str,
    target: str,
    roles: Roles = Roles(),
    partitions: int | None = None,
    key: str = "position",
) -> Tables:
    """Read the raw CSV once, write the complete rows as Parquet, profile all rows.

    The parsed rows go to the shared folder first, so the profile passes read pruned
    columns instead of parsing text again. Lines that do not parse in full are counted by file
    and reason. ``key="content"`` derives unit ids from the
    row contents (the same after every ingest, at the price of a shuffle); by default
    rows are numbered as they are written.
    """
    read = read_with_rejects(spark, source, roles, partitions)
    if key == "content":
        parsed = stored(read)
        raw = stored(add_unit_id(parsed.drop(REJECTED, FILE), roles.unit_id))
    else:
        parsed = stored(number_rows(read, roles.unit_id))
        raw = parsed.drop(REJECTED, FILE)
    write_experiment(profile.drop_missing(raw, roles), target)
    measures = profile.all_measures(raw, roles)
    return {
        **measures,
        "missing_total": group(measures["missing"], [], {"n_null": "sum(n_null)"}),
        "binary_values": profile.binary_values(raw, roles),
        "duplicates": profile.duplicates(raw, roles),
        "arm_sizes": profile.arm_sizes(raw, roles),
        "rejects": reject_counts(rejects(parsed, roles)),
    }


def check_validity(df: DataFrame, roles: Roles = Roles(), design_share: float = 0.85) -> Tables:
    """Arm sizes and feature moments come from the same pass."""
    moments = stored_result(group_moments(df, roles.treatment, roles))
    sizes = moments.filter(f"feature = {literal(roles.features[0])}").selectExpr("`group` as treatment", "`rows` as n")
    balance = stored_result(validity.balance_of(moments))
    return {
        "srm": validity.sample_ratio(sizes, design_share),
        "balance": balance,
        "balance_summary": validity.balance_summary(balance),
        "balance_ranking": validity.rank_by_imbalance(balance),
    }


def measure_lift(df: DataFrame, roles: Roles = Roles(), n_boot: int = 10_000, seed: int = 7) -> Tables:
    counts = stored_result(arms.experiment_counts(df, roles))
    lifts = lift.lift(counts)
    boot = stored_result(bootstrap.lift_bootstrap(counts, n_boot, seed))
    return {
        "counts": counts,
        "lift": lifts,
        "lift_bootstrap": boot,
        "incremental": lift.incremental(lifts),
        "signal_to_noise": lift.signal_to_noise(lifts, *roles.metrics[:2]),
        "interval_agreement": lift.interval_agreement(lifts, boot),
    }


def measure_power(
    df: DataFrame, roles: Roles = Roles(), alpha: float = 0.05, target: float = 0.8, salt: str = "power"
) -> Tables:
    """Counts come from the bucket sums, so one pass over the units serves all tables."""
    sums = stored_result(power.bucket_arm_sums(df, roles=roles, salt=salt))
    coarse = sums.filter(f"k = {min(power.BUCKET_COUNTS)}")
    counts = group(coarse, ["metric"], {c: f"sum({c})" for c in ("n_t", "x_t", "n_c", "x_c")})
    grid = power.power_grid(counts, alpha=alpha, power=target)
    settings = df.sparkSession.range(1).selectExpr(f"{literal(alpha)} as alpha", f"{literal(target)} as target")
    return {
        "power_settings": settings,
        "power_grid": grid,
        "smallest_traffic": power.smallest_traffic(grid, target),
        "empirical_power": power.empirical_power(power.bucket_tests(sums), counts, alpha),
        "units_needed": power.units_needed(counts, alpha=alpha, power=target),
    }


def measure_compliance(df: DataFrame, roles: Roles = Roles(), n_boot: int = 2000, seed: int = 5) -> Tables:
    cells = stored_result(compliance.compliance_cells(df, roles))
    counts = compliance.compliance_counts(cells, roles)
    effects = compliance.effects(counts)
    selection = stored_result(compliance.exposure_selection(df, roles))
    return {
        "compliance_cells": cells,
        "compliance_counts": counts,
        "effects": effects,
        "effect_intervals": compliance.effect_intervals(counts),
        "effect_bootstrap": bootstrap.compliance_bootstrap(counts, n_boot, seed),
        "exposure_selection": selection,
        "selection_ranking": validity.rank_by_imbalance(selection, top=5),
        "imbalance_count": compliance.imbalance_count(selection),
        "naive_bias": compliance.naive_bias(effects),
    }


def compare_segments(
    df: DataFrame, roles: Roles = Roles(), n_buckets: int = 5, error: float = 0.001
) -> Tables:
    edges = quantiles.bucket_edges(df, roles.features, n_buckets, error)
    sums = stored_result(segments.segment_sums(df, edges, roles))
    table = segments.adjust_false_discovery(segments.segment_lift(sums, edges, roles))
    tests = segments.heterogeneity(table)
    listed = [(feature, i, edge) for feature, cuts in edges.items() for i, edge in enumerate(cuts, 1)]
    return {
        "segment_edges": df.sparkSession.createDataFrame(listed, "feature string, position int, edge double"),
        "segments": table,
        "heterogeneity": tests,
        "most_heterogeneous": segments.most_heterogeneous(tests, roles.metrics[0]),
        "heterogeneous_features": segments.heterogeneous_features(tests),
        "segment_tallies": segments.segment_tallies(table),
    }


def model_uplift(
    df: DataFrame,
    roles: Roles = Roles(),
    sample_rows: int = 2_000_000,
    n_boot: int = 200,
    seed: int = 6,
    settings: uplift.TreeSettings = uplift.TreeSettings(),
) -> Tables:
    """Split all units, fit on a sample of one half, rank and evaluate the whole other half.

    ``sample_rows`` bounds the units that the model is fitted on; nothing else is sampled.
    """
    needed = [roles.unit_id, *roles.features, roles.treatment, *roles.metrics]
    units = stored(uplift.split_units(df.select(*needed), roles=roles, salt=f"split{seed}"))
    train = stored(uplift.sample_units(units.filter("not is_test"), sample_rows, roles, salt=f"sample{seed}"))
    model = uplift.fit_t_learner(train, settings, seed, roles)
    scored = stored(model.score(units.filter("is_test")))
    scores = {m: f"uplift_{m}" for m in roles.metrics}
    ranks = ranking.ranked(ranking.scored_long(scored, scores, roles))
    curve = stored_result(ranking.qini_curve(ranks))
    return {
        "sample_sizes": group(train.select("is_test").unionByName(scored.select("is_test")), ["is_test"], {"n": "count(1)"}),
        "calibration": uplift.calibration(scored, roles),
        "qini_curve": ranking.normalized_curve(curve),
        "qini": ranking.qini_coefficient(curve),
        "capture": ranking.capture(curve),
        "capture_bootstrap": capture_interval.capture_bootstrap(ranks, n_boot=n_boot, seed=seed),
        "deciles": ranking.deciles(ranks),
    }
