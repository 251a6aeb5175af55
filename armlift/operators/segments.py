"""Does the effect differ between segments of the units?"""

from __future__ import annotations

from pyspark.sql import DataFrame

from armlift.functions.numeric import derive, group, literal, name, pick, ratio
from armlift.functions.tails import chi2_tail, normal_two_sided
from armlift.operators.arms import arm_sums, per_metric
from armlift.operators.lift import standard_errors, with_rates
from armlift.schema import Roles

Edges = dict[str, list[float]]


def bucket_of(column: str, edges: list[float]) -> str:
    """Number of edges below the value: 0 up to the first edge, null for a missing value."""
    x = name(column)
    below = " + ".join(["0", *[f"if({x} > {literal(e)}, 1, 0)" for e in edges]])
    return f"case when {x} is not null and not isnan({x}) then {below} end"


def range_labels(edges: list[float]) -> list[str]:
    """Half-open ranges of the buckets, edges to three significant digits."""
    marks = ["-inf", *(f"{e:.3g}" for e in edges), "+inf"]
    return [f"({lo}, {hi}]" for lo, hi in zip(marks, marks[1:])]


def segment_sums(df: DataFrame, edges: Edges, roles: Roles = Roles()) -> DataFrame:
    """(feature, bucket, n_t, n_c, one success sum per metric and arm), one job for all features.

    Each unit becomes one (feature number, bucket) pair per feature inside its task;
    partial aggregation leaves one row per segment and task for the shuffle.
    """
    buckets = ", ".join(bucket_of(f, e) for f, e in edges.items())
    columns = [name(c) for c in (roles.treatment, *roles.metrics)]
    pairs = df.selectExpr(*columns, f"posexplode(array({buckets})) as (feature_index, bucket)")
    sums = arm_sums(roles)
    names = ", ".join(literal(f) for f in edges)
    return group(pairs, ["feature_index", "bucket"], sums).selectExpr(
        "feature_index", f"array({names})[feature_index] as feature", "bucket", *[name(s) for s in sums]
    )


def segment_lift(sums: DataFrame, edges: Edges, roles: Roles = Roles()) -> DataFrame:
    """One row per feature, bucket and metric: rates, lift, standard error, p value."""
    labels = ", ".join(f"array({', '.join(literal(s) for s in range_labels(e))})" for e in edges.values())
    labelled = derive(sums, {"range": f"array({labels})[feature_index][bucket]"})
    long = per_metric(labelled, ("feature_index", "feature", "bucket", "range"), roles)
    tested = derive(standard_errors(with_rates(long)), {"z": ratio("difference", "se_pooled")})
    keys = ("feature_index", "feature", "bucket", "range", "metric")
    return pick(
        tested,
        {
            **{c: name(c) for c in keys},
            "n": "n_t + n_c",
            "n_t": "n_t",
            "n_c": "n_c",
            "rate_control": "rate_control",
            "rate_treatment": "rate_treatment",
            "lift": "difference",
            "se": "se",
            "rel_lift": f"{ratio('rate_treatment', 'rate_control')} - 1",
            "p_value": f"case when se_pooled = 0 then 1D else {normal_two_sided('z')} end",
        },
    )


def adjust_false_discovery(table: DataFrame, family: str = "metric") -> DataFrame:
    """Add Benjamini-Hochberg p values and the family size; the family is one metric's segments."""
    by = f"partition by {name(family)}"
    ranked = derive(
        derive(table, {"known": "p_value is not null", "family_size": f"count(p_value) over ({by})"}),
        {"place": f"row_number() over ({by}, known order by p_value, feature_index, bucket)"},
    )
    scaled = ratio("(p_value * family_size)", "place")
    stepped = f"min({scaled}) over ({by}, known order by place desc rows between unbounded preceding and current row)"
    return derive(ranked, {"p_bh": f"case when known then least({stepped}, 1D) end"}).drop("known", "place")


def heterogeneity(table: DataFrame) -> DataFrame:
    """Cochran's Q per feature and metric, with Bonferroni-adjusted p over all tests.

    A segment whose lift has no standard error would weigh infinitely much; it is
    left out of Q and counted in ``n_without_se``. Features with one bucket have
    p = 1 and still belong to the family of tests.
    """
    over = "over (partition by feature, metric)"
    weighed = derive(table, {"weight": f"case when se > 0 then {ratio('1', 'pow(se, 2)')} end"})
    centred = derive(weighed, {"centre": ratio(f"sum(weight * lift) {over}", f"sum(weight) {over}")})
    tests = group(
        centred,
        ["feature_index", "feature", "metric"],
        {
            "n_buckets": "count(1)",
            "n_without_se": "count(1) - count(weight)",
            "q": "coalesce(sum(weight * pow(lift - centre, 2)), 0D)",
            "lift_range": "max(lift) - min(lift)",
        },
    )
    judged = derive(
        tests, {"p_value": chi2_tail("q", "(n_buckets - n_without_se - 1)"), "n_tests": "count(1) over ()"}
    )
    return judged.selectExpr(
        "feature_index",
        "feature",
        "metric",
        "n_buckets",
        "n_without_se",
        "q",
        "p_value",
        "lift_range",
        "n_tests",
        "least(p_value * n_tests, 1D) as p_bonferroni",
    )


def most_heterogeneous(tests: DataFrame, metric: str = "visit", top: int = 3) -> DataFrame:
    """Features with the largest Q of one metric."""
    ranked = tests.filter(f"metric = {literal(metric)}").selectExpr(
        "row_number() over (partition by metric order by q desc, feature_index) as place",
        "feature",
        "metric",
        "q",
        "n_buckets",
        "lift_range",
    )
    return ranked.filter(f"place <= {top}")


def heterogeneous_features(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    return group(
        tests,
        ["metric"],
        {"n_significant": f"count_if(p_bonferroni < {literal(alpha)})", "n_features": "count(1)"},
    )


def segment_tallies(adjusted: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Segment tests run, significant before and after adjustment."""
    below = lambda p: f"count_if({p} < {literal(alpha)})"
    return group(adjusted, [], {"n_tests": "count(1)", "n_raw": below("p_value"), "n_adjusted": below("p_bh")})
