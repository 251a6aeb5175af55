"""Registered queries: every operator on the experiment derived from the retail tables.

``DIGITS`` gives the decimal places to which results are rounded, so that engines
which sum doubles in another order still return equal values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from armlift.functions.numeric import group
from armlift.functions.units import unit_uniform
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
    sketches,
    uplift,
    validity,
)
from armlift.plans import publish, steps
from armlift.schema import Roles
from armlift.session import new_folder, stored, stored_result
from armlift.sources import experiment_table, results
from armlift.sources.order_experiment import order_experiment

Query = Callable[[SparkSession, str], DataFrame]

ROLES = Roles()
COARSE_VECTOR = ("f1", "f3", "f4", "f5", "f11")
# leaves of 200 units, the default, would leave no tree on a few thousand
QUERY_TREES = uplift.TreeSettings(min_leaf=20)
# a small fit that SQL can repeat: stumps on given bins, all rows and features in every round
STUMPS = uplift.TreeSettings(n_trees=3, at_once=1, step=0.3, leaves=2, min_leaf=50, row_share=1.0, feature_share=1.0)
STUMP_EDGES = {
    **{f: [] for f in ROLES.features},
    "f0": [100_000.0, 200_000.0, 250_000.0, 300_000.0, 400_000.0],
    "f2": [0.0, 2500.0, 5000.0, 7500.0],
    "f4": [1.0, 2.0, 3.0, 4.0],
    "f9": [40_000.0, 60_000.0, 80_000.0],
}

QUERIES: dict[str, Query] = {}
DIGITS: dict[str, dict[int, tuple[str, ...]]] = {}


def raw_units(spark: SparkSession, folder: str) -> DataFrame:
    return order_experiment(spark, folder)


def clean_units(spark: SparkSession, folder: str) -> DataFrame:
    return profile.drop_missing(order_experiment(spark, folder), ROLES)


def rounded(df: DataFrame, digits: dict[int, tuple[str, ...]]) -> DataFrame:
    places = {c: n for n, columns in digits.items() for c in columns}
    if not places:
        return df
    return df.selectExpr(*[f"round(`{c}`, {places[c]}) as `{c}`" if c in places else f"`{c}`" for c in df.columns])


def query(name: str, digits: dict[int, tuple[str, ...]] | None = None) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        DIGITS[name] = digits or {}
        QUERIES[name] = lambda spark, folder: rounded(build(spark, folder), DIGITS[name])
        return build

    return register


# --- profile of the raw log


@query("profile_missing")
def _(spark, folder):
    return profile.missing_counts(raw_units(spark, folder))


@query("ingest_rejects")
def _(spark, folder):
    """Rejected lines by reason of a raw CSV with planted faults, which is written and read again."""
    faulty = {
        "f2": "case when unit_id % 97 = 0 then 'n/a' else cast(f2 as string) end",
        "f5": "case when unit_id % 101 = 0 then '1,5' when unit_id % 103 = 0 then 'five' else cast(f5 as string) end",
        "exposure": "case when unit_id % 89 = 0 then '2.5' else cast(exposure as string) end",
    }
    lines = raw_units(spark, folder).selectExpr(*[f"{faulty.get(c, c)} as {c}" for c in ROLES.columns])
    path = new_folder(spark)
    # written without quotes, a comma inside a field is one field too many
    quotes = {"header": True, "quote": "\0", "emptyValue": ""}
    lines.write.options(**quotes).csv(path)
    rows = stored(experiment_table.read_with_rejects(spark, path, ROLES))
    counted = experiment_table.reject_counts(experiment_table.rejects(rows, ROLES))
    return counted.groupBy("reason").agg(F.sum("n").alias("n"))


@query("profile_rows")
def _(spark, folder):
    return profile.row_accounting(raw_units(spark, folder))


@query("profile_binary_values")
def _(spark, folder):
    return profile.binary_values(raw_units(spark, folder))


@query("profile_binary_domain")
def _(spark, folder):
    return profile.binary_domains(raw_units(spark, folder))


@query("profile_consistency")
def _(spark, folder):
    return profile.consistency(raw_units(spark, folder))


@query("profile_duplicates")
def _(spark, folder):
    return profile.duplicates(raw_units(spark, folder))


@query("profile_duplicates_coarse")
def _(spark, folder):
    return profile.duplicates(raw_units(spark, folder), vector=COARSE_VECTOR)


@query("profile_arm_counts")
def _(spark, folder):
    return profile.arm_sizes(raw_units(spark, folder))


@query("profile_treatment_share", {9: ("treatment_share",)})
def _(spark, folder):
    return profile.treatment_share(raw_units(spark, folder))


@query("profile_binary_means", {9: ("mean",)})
def _(spark, folder):
    return profile.binary_means(raw_units(spark, folder))


@query("profile_feature_moments", {4: ("mean", "stddev", "min", "max")})
def _(spark, folder):
    return profile.feature_moments(raw_units(spark, folder))


@query("profile_feature_quartiles", {6: ("value",)})
def _(spark, folder):
    return quantiles.exact_quantiles(raw_units(spark, folder), ROLES.features, list(profile.QUARTILES))


@query("profile_feature_summary")
def _(spark, folder):
    return profile.feature_summary(raw_units(spark, folder))


@query("profile_distinct_verdict")
def _(spark, folder):
    """Exact distinct counts, and whether the sketch comes near them."""
    units = stored(raw_units(spark, folder).select(*ROLES.features))
    exact = ", ".join(f"'{f}', count(distinct {f})" for f in ROLES.features)
    counts = group(units, [], {"counts": f"map({exact})"}).selectExpr("explode(counts) as (feature, n_distinct)")
    sketched = profile.feature_summary(raw_units(spark, folder)).select("feature", "approx_distinct")
    within = "abs(approx_distinct - n_distinct) <= 0.15D * n_distinct as is_near"
    return counts.join(sketched, "feature").selectExpr("feature", "n_distinct", within)


def sketched_in_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Sketches of three parts of the raw log, each made by itself, merged in two steps."""
    units = stored(raw_units(spark, folder).select(ROLES.unit_id, *ROLES.features))
    parts = [stored(sketches.part_sketches(units.where(f"unit_id % 3 = {i}"))) for i in range(3)]
    return stored_result(sketches.merged_sketches(sketches.merged_sketches(parts[0], parts[1]), parts[2]))


@query("profile_merged_summary", {4: ("mean", "stddev", "min", "max")})
def _(spark, folder):
    """Counts and moments of merged parts; they equal those of the whole table."""
    return sketches.sketched_summary(sketched_in_parts(spark, folder)).select(
        "feature", "n", "n_missing", "mean", "stddev", "min", "max"
    )


@query("profile_merged_distinct")
def _(spark, folder):
    """Exact distinct counts, and whether the merged sketches come within 3 %."""
    merged = sketches.sketched_summary(sketched_in_parts(spark, folder)).select("feature", "approx_distinct")
    exact = ", ".join(f"'{f}', count(distinct {f})" for f in ROLES.features)
    counts = group(raw_units(spark, folder), [], {"counts": f"map({exact})"}).selectExpr("explode(counts) as (feature, n_distinct)")
    near = "abs(approx_distinct - n_distinct) <= 0.03D * n_distinct as is_near"
    return counts.join(merged, "feature").selectExpr("feature", "n_distinct", near)


@query("segment_merged_edges")
def _(spark, folder):
    """Whether the edges of merged sketches have ranks within half a per cent in the whole table."""
    shares = tuple(quantiles.bucket_probabilities(5))
    return sketches.rank_bounds(raw_units(spark, folder), sketched_in_parts(spark, folder), ROLES, shares, 0.005)


# --- validity of the randomization


@query("validity_srm", {9: ("observed_share", "ci_lo", "ci_hi", "chi2", "p_value")})
def _(spark, folder):
    return validity.sample_ratio(profile.arm_sizes(clean_units(spark, folder)))


@query(
    "validity_balance",
    {4: ("mean_treatment", "mean_control", "welch_df"), 6: ("smd", "variance_ratio", "welch_t", "welch_p")},
)
def _(spark, folder):
    return validity.balance(clean_units(spark, folder))


@query("validity_balance_summary", {6: ("max_abs_smd",)})
def _(spark, folder):
    return validity.balance_summary(validity.balance(clean_units(spark, folder)))


@query("validity_smd_ranking", {6: ("smd", "abs_smd")})
def _(spark, folder):
    return validity.rank_by_imbalance(validity.balance(clean_units(spark, folder)))


# --- difference between the arms


def counts_of(spark: SparkSession, folder: str) -> DataFrame:
    return arms.experiment_counts(clean_units(spark, folder))


LIFT_DIGITS = {
    9: (
        "rate_treatment",
        "rate_control",
        "abs_lift",
        "abs_lo",
        "abs_hi",
        "rel_lift",
        "rel_lo",
        "rel_hi",
        "z",
        "p_value",
    )
}


@query("ab_arm_counts")
def _(spark, folder):
    return arms.arm_counts(clean_units(spark, folder))


@query("ab_lift", LIFT_DIGITS)
def ab_lift(spark, folder):
    return lift.lift(counts_of(spark, folder))


@query("ab_incremental", {9: ("abs_lift",), 6: ("incremental",)})
def _(spark, folder):
    return lift.incremental(ab_lift(spark, folder))


@query("ab_signal_noise", {9: ("base_rate_ratio", "ci_width_ratio", "width_common", "width_rare")})
def _(spark, folder):
    return lift.signal_to_noise(ab_lift(spark, folder))


BOOT_DIGITS = {9: ("boot_abs_lo", "boot_abs_hi", "boot_rel_lo", "boot_rel_hi", "share_not_positive")}


@query("ab_bootstrap", BOOT_DIGITS)
def ab_bootstrap(spark, folder):
    return bootstrap.lift_bootstrap(counts_of(spark, folder))


@query("ab_interval_agreement", {9: ("rel_lift", "max_gap")})
def _(spark, folder):
    counts = stored_result(counts_of(spark, folder))
    return lift.interval_agreement(lift.lift(counts), bootstrap.lift_bootstrap(counts))


def near_ends(low: str, high: str, boot_low: str, boot_high: str) -> str:
    """SQL: both ends of two intervals differ by under a tenth of the first one's width."""
    return f"greatest(abs({boot_low} - {low}), abs({boot_high} - {high})) < 0.1D * ({high} - {low})"


@query("ab_bootstrap_verdict", {9: ("rel_lift", "abs_lo", "abs_hi")})
def _(spark, folder):
    """Whether the resampled intervals come near the analytic ones."""
    counts = stored_result(counts_of(spark, folder))
    lifts, boot = lift.lift(counts), bootstrap.lift_bootstrap(counts)
    agreed = lift.interval_agreement(lifts, boot).select("metric", "agree")
    joined = lifts.join(boot, "metric").join(agreed, "metric")
    near = near_ends("abs_lo", "abs_hi", "boot_abs_lo", "boot_abs_hi")
    return joined.selectExpr("metric", "rel_lift", "abs_lo", "abs_hi", f"{near} as abs_agree", "agree as rel_agree")


# --- power


@query(
    "power_mde_grid",
    {6: ("n_total", "lift_over_mde"), 9: ("rate_control", "rel_lift", "mde_abs", "mde_rel", "power")},
)
def power_mde_grid(spark, folder):
    return power.power_grid(counts_of(spark, folder))


@query("power_min_traffic")
def _(spark, folder):
    return power.smallest_traffic(power_mde_grid(spark, folder))


@query("power_bucket_sums")
def power_bucket_sums(spark, folder):
    return power.bucket_arm_sums(clean_units(spark, folder))


@query("power_bucket_tests", {6: ("z", "p_value")})
def _(spark, folder):
    tests = power.bucket_tests(power_bucket_sums(spark, folder))
    return tests.select("k", "bucket", "metric", "z", "p_value")


@query("power_empirical", {9: ("fraction", "empirical_power", "analytic_power")})
def _(spark, folder):
    # all three inputs of the report come from one stored table of bucket sums
    sums = stored_result(power_bucket_sums(spark, folder))
    coarsest = sums.filter(F.col("k") == min(power.BUCKET_COUNTS)).groupBy("metric")
    counts = coarsest.agg(*[F.sum(c).alias(c) for c in ("n_t", "x_t", "n_c", "x_c")])
    return power.empirical_power(power.bucket_tests(sums), counts)


@query("power_sample_size", {9: ("share_t", "cost_ratio"), 4: ("n_actual", "n_even")})
def _(spark, folder):
    return power.units_needed(counts_of(spark, folder))


# --- assignment and exposure


def compliance_of(spark: SparkSession, folder: str) -> DataFrame:
    return compliance.compliance_counts(compliance.compliance_cells(clean_units(spark, folder)))


@query("compliance_cells")
def _(spark, folder):
    return compliance.compliance_cells(clean_units(spark, folder))


@query("compliance_counts")
def _(spark, folder):
    return compliance_of(spark, folder)


@query("compliance_effects", {9: compliance.EFFECTS})
def compliance_effects(spark, folder):
    return compliance.effects(compliance_of(spark, folder))


@query("compliance_effects_two_sided", {9: compliance.EFFECTS})
def _(spark, folder):
    # a twentieth of the control units get the treatment all the same
    crossed = f"{unit_uniform(ROLES.unit_id, 'cross')} < 0.05D and treatment = 0"
    units = clean_units(spark, folder).withColumn("exposure", F.expr(f"if({crossed}, 1, exposure)"))
    counts = compliance.compliance_counts(compliance.compliance_cells(units))
    return compliance.effects(counts, two_sided=True)


@query("compliance_cace_ci", {9: ("itt", "itt_lo", "itt_hi", "cace", "cace_lo", "cace_hi")})
def _(spark, folder):
    return compliance.effect_intervals(compliance_of(spark, folder))


@query("compliance_selection_smd", {4: ("mean_exposed", "mean_unexposed"), 6: ("smd",)})
def selection(spark, folder):
    return compliance.exposure_selection(clean_units(spark, folder))


@query("compliance_selection_top", {6: ("smd", "abs_smd")})
def _(spark, folder):
    return validity.rank_by_imbalance(selection(spark, folder), top=5)


@query("compliance_imbalance_count")
def _(spark, folder):
    return compliance.imbalance_count(selection(spark, folder))


@query("compliance_naive_bias", {9: ("naive_vs_control", "cace", "bias_ratio")})
def _(spark, folder):
    return compliance.naive_bias(compliance_effects(spark, folder))


@query("cace_bootstrap")
def _(spark, folder):
    return bootstrap.compliance_bootstrap(compliance_of(spark, folder))


@query("cace_bootstrap_verdict", {9: ("itt_lo", "itt_hi", "cace_lo", "cace_hi")})
def _(spark, folder):
    """Whether the resampled intervals come near those of the delta method."""
    counts = stored_result(compliance_of(spark, folder))
    both = compliance.effect_intervals(counts).join(bootstrap.compliance_bootstrap(counts), "metric")
    near = {v: near_ends(f"{v}_lo", f"{v}_hi", f"boot_{v}_lo", f"boot_{v}_hi") for v in ("itt", "cace")}
    return both.selectExpr(
        "metric", "itt_lo", "itt_hi", "cace_lo", "cace_hi", *[f"{text} as {v}_agree" for v, text in near.items()]
    )


# --- segments


def exact_edges(units: DataFrame) -> segments.Edges:
    return quantiles.bucket_edges(units, ROLES.features, n_buckets=5, error=0)


def segment_inputs(spark: SparkSession, folder: str) -> tuple[DataFrame, segments.Edges]:
    # edges and sums read the units twice, so the columns they need are stored once
    units = stored(clean_units(spark, folder).select(*ROLES.features, ROLES.treatment, *ROLES.metrics))
    edges = exact_edges(units)
    return segments.segment_sums(units, edges), edges


def segment_table(spark: SparkSession, folder: str) -> DataFrame:
    sums, edges = segment_inputs(spark, folder)
    return segments.segment_lift(sums, edges)


@query("segment_edges", {6: ("edge",)})
def _(spark, folder):
    cuts = quantiles.exact_quantiles(
        clean_units(spark, folder), ROLES.features, quantiles.bucket_probabilities(5)
    )
    return cuts.select("feature", F.col("value").alias("edge")).distinct()


@query("segment_edges_approximate", {6: ("edge",)})
def _(spark, folder):
    edges = quantiles.bucket_edges(clean_units(spark, folder), ROLES.features)
    rows = [(f, e) for f, cuts in edges.items() for e in cuts]
    return spark.createDataFrame(rows, "feature string, edge double")


@query("segment_edges_verdict")
def _(spark, folder):
    """Whether every approximate edge has a rank within the error that was asked for."""
    units, error = stored(clean_units(spark, folder).select(*ROLES.features)), 0.001
    shares = quantiles.bucket_probabilities(5)
    edges = quantiles.approximate_quantiles(units, ROLES.features, shares, error)
    inside = {
        f: " and ".join(
            f"count_if({f} < {edge!r}D) <= {p + error!r}D * count(1) and count_if({f} <= {edge!r}D) >= {p - error!r}D * count(1)"
            for p, edge in zip(shares, cuts)
        )
        for f, cuts in edges.items()
    }
    listed = ", ".join(f"'{f}', {text}" for f, text in inside.items())
    table = group(units, [], {"n": "count(1)", "verdicts": f"map({listed})"})
    return table.selectExpr("n", "explode(verdicts) as (feature, is_near)")


@query("segment_sums")
def _(spark, folder):
    return segment_inputs(spark, folder)[0]


@query(
    "segment_lift", {9: ("rate_control", "rate_treatment", "lift", "se", "rel_lift", "p_value")}
)
def _(spark, folder):
    return segment_table(spark, folder)


@query("segment_bh", {9: ("p_value", "p_bh")})
def _(spark, folder):
    adjusted = segments.adjust_false_discovery(segment_table(spark, folder))
    return adjusted.select("feature", "bucket", "metric", "p_value", "family_size", "p_bh")


@query("segment_tallies")
def _(spark, folder):
    return segments.segment_tallies(segments.adjust_false_discovery(segment_table(spark, folder)))


@query("segment_cochran_q", {6: ("q",), 9: ("p_value", "lift_range", "p_bonferroni")})
def segment_cochran_q(spark, folder):
    return segments.heterogeneity(segment_table(spark, folder))


@query("segment_most_heterogeneous", {6: ("q",), 9: ("lift_range",)})
def _(spark, folder):
    return segments.most_heterogeneous(segment_cochran_q(spark, folder))


@query("segment_heterogeneous_features")
def _(spark, folder):
    return segments.heterogeneous_features(segment_cochran_q(spark, folder))


# --- targeting: the ranking operators on a score any engine can compute


def ranks_by_balance(spark: SparkSession, folder: str) -> DataFrame:
    """All clean units ranked by f2, which drives the planted effect."""
    return ranking.ranked(ranking.scored_long(clean_units(spark, folder), {m: "f2" for m in ROLES.metrics}))


def ranks_by_month(spark: SparkSession, folder: str) -> DataFrame:
    """All clean units ranked by f1, which has twelve values: ranks inside ties follow the unit id."""
    return ranking.ranked(ranking.scored_long(clean_units(spark, folder), {m: "f1" for m in ROLES.metrics}))


@query("uplift_qini_curve", {9: ("phi",), 6: ("q",)})
def qini_curve(spark, folder):
    return ranking.qini_curve(ranks_by_balance(spark, folder))


@query("uplift_qini_curve_tied", {9: ("phi",), 6: ("q",)})
def _(spark, folder):
    return ranking.qini_curve(ranks_by_month(spark, folder))


@query("uplift_qini", {6: ("total_incremental",), 9: ("qini",)})
def _(spark, folder):
    return ranking.qini_coefficient(qini_curve(spark, folder))


@query("uplift_capture", {9: ("capture",)})
def _(spark, folder):
    return ranking.capture(qini_curve(spark, folder))


@query("uplift_curve_normalized", {9: ("phi", "q_share")})
def _(spark, folder):
    return ranking.normalized_curve(qini_curve(spark, folder))


@query("uplift_deciles", {4: ("predicted_uplift",), 9: ("observed_uplift", "ci_lo", "ci_hi")})
def _(spark, folder):
    return ranking.deciles(ranks_by_balance(spark, folder))


@query("uplift_capture_ci", {9: ("boot_capture_lo", "boot_capture_hi")})
def _(spark, folder):
    return capture_interval.capture_bootstrap(ranks_by_balance(spark, folder))


# --- publishing


def document_values(documents: DataFrame, titles: tuple[str, ...]) -> DataFrame:
    """(section, key, field, value) of the numbers in the keyed sections of published documents."""
    shape = "map<string, array<map<string, string>>>"
    parts = ", ".join(f"'{t}', from_json(get_json_object(document, '$.{t}'), '{shape}')" for t in titles)
    sections = documents.selectExpr(f"explode(map({parts})) as (section, lists)")
    records = sections.selectExpr("section", "explode(lists) as (key, items)").selectExpr(
        "section", "key", "explode(items) as item"
    )
    fields = records.selectExpr("section", "key", "explode(item) as (field, text)")
    return fields.selectExpr("section", "key", "field", "try_cast(text as double) as value").filter("value is not null")


@query("results_publish")
def _(spark, folder):
    units = stored(clean_units(spark, folder))
    cells = compliance.compliance_counts(compliance.compliance_cells(units))
    scored = ranking.scored_long(units, {m: "f2" for m in ROLES.metrics})
    tables = {
        "lift": lift.lift(arms.experiment_counts(units)),
        "effects": compliance.effects(cells),
        "qini": ranking.qini_coefficient(ranking.qini_curve(ranking.ranked(scored))),
    }
    return document_values(stored_result(publish.publish(tables)), ("ab", "cace", "uplift"))


@query("results_paths")
def _(spark, folder):
    """Every value of a document with all sections but the resampled compliance cells, which no engine repeats."""
    raw = stored(raw_units(spark, folder))
    units = profile.drop_missing(raw, ROLES)
    missing = stored_result(profile.missing_counts(raw))
    edges = exact_edges(units)
    ranks = ranking.ranked(ranking.scored_long(units, {m: "f2" for m in ROLES.metrics}))
    curve = stored_result(ranking.qini_curve(ranks))
    table = stored_result(segments.adjust_false_discovery(segments.segment_lift(segments.segment_sums(units, edges), edges)))
    listed = [(feature, i, edge) for feature, cuts in edges.items() for i, edge in enumerate(cuts, 1)]
    tables = {
        "rows": profile.row_accounting(raw),
        "arm_sizes": profile.arm_sizes(raw),
        "binary_means": profile.binary_means(raw),
        "missing": missing,
        "missing_total": group(missing, [], {"n_null": "sum(n_null)"}),
        "consistency": profile.consistency(raw),
        "duplicates": profile.duplicates(raw),
        **steps.check_validity(units),
        **steps.measure_lift(units),
        **steps.measure_power(units),
        **steps.measure_compliance(units),
        "segments": table,
        "segment_edges": spark.createDataFrame(listed, "feature string, position int, edge double"),
        "heterogeneity": segments.heterogeneity(table),
        "qini": ranking.qini_coefficient(curve),
        "capture": ranking.capture(curve),
        "capture_bootstrap": capture_interval.capture_bootstrap(ranks),
        "qini_curve": ranking.normalized_curve(curve),
        "deciles": ranking.deciles(ranks),
        "sample_sizes": uplift.split_units(units).groupBy("is_test").agg(F.count(F.lit(1)).alias("n")),
    }
    del tables["effect_bootstrap"]
    paths = publish.document_paths(stored_result(publish.publish(tables)))
    # what is left of sums that cancel differs between engines
    return paths.withColumn("number", F.expr("if(abs(number) < 1e-20D, 0D, number)"))


@query("results_significant_digits")
def _(spark, folder):
    table = results.cleaned(segment_table(spark, folder))
    values = ("rate_control", "rate_treatment", "lift", "se", "rel_lift", "p_value")
    return table.select("feature", "bucket", "metric", *values)


@query("results_document")
def _(spark, folder):
    units = stored(clean_units(spark, folder))
    return publish.publish(
        {
            **steps.check_validity(units),
            **steps.measure_lift(units),
            **steps.measure_power(units),
            **steps.measure_compliance(units),
            **steps.compare_segments(units),
        }
    )


# --- targeting: sample, split and model

# share of the units that the sampling query draws
SAMPLE_SHARE = 0.7


def split_sample(spark: SparkSession, folder: str) -> DataFrame:
    return uplift.split_units(uplift.sample_share(clean_units(spark, folder), SAMPLE_SHARE))


@query("uplift_sample_split")
def _(spark, folder):
    return (
        split_sample(spark, folder)
        .groupBy(ROLES.treatment, "is_test")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.expr("unit_id % 1000003")).alias("id_sum"))
    )


@query("uplift_exact_split")
def _(spark, folder):
    units = uplift.split_units(clean_units(spark, folder), exact=True)
    return units.groupBy(ROLES.treatment, "is_test").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.expr("unit_id % 1000003")).alias("id_sum")
    )


def scored_test_units(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of the test half by the model of the other half, beside the unit, its arm and its outcomes."""
    units = stored(uplift.split_units(clean_units(spark, folder)))
    model = uplift.fit_t_learner(units.filter(~F.col("is_test")), QUERY_TREES)
    return stored(model.score(units.filter("is_test"), (ROLES.unit_id, ROLES.treatment, *ROLES.metrics)))


@query("uplift_scores", {6: ("uplift_visit", "uplift_conversion")})
def _(spark, folder):
    columns = (ROLES.unit_id, ROLES.treatment, *ROLES.metrics, *[f"uplift_{m}" for m in ROLES.metrics])
    return scored_test_units(spark, folder).select(*columns)


@query("uplift_stump_scores", {9: ("uplift_visit", "uplift_conversion")})
def _(spark, folder):
    """Scores of a fit small enough to be repeated in SQL."""
    units = stored(uplift.split_units(clean_units(spark, folder)))
    model = uplift.fit_t_learner(units.filter(~F.col("is_test")), STUMPS, edges=STUMP_EDGES)
    return model.score(units.filter("is_test")).select("unit_id", "uplift_visit", "uplift_conversion")


@query("uplift_calibration", {6: ("observed", "predicted")})
def _(spark, folder):
    return uplift.calibration(scored_test_units(spark, folder))


@query("uplift_model_qini", {6: ("total_incremental", "qini")})
def _(spark, folder):
    scores = {m: f"uplift_{m}" for m in ROLES.metrics}
    ranks = ranking.ranked(ranking.scored_long(scored_test_units(spark, folder), scores))
    return ranking.qini_coefficient(ranking.qini_curve(ranks))
