"""Did the randomization work? Sample ratio and covariate balance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armlift.functions.numeric import derive, group, literal, pick, ratio, root, sum_where
from armlift.functions.student import student_two_sided
from armlift.functions.tails import chi2_tail
from armlift.operators.lift import around
from armlift.operators.moments import group_moments, side_by_side, with_smd
from armlift.schema import Roles

# The strict alarm level of ratio checks, the customary balance limit,
# and the rounded normal quantile of the interval of the share.
SRM_ALPHA = 0.001
SMD_LIMIT = 0.10
SHARE_Z = 1.96


def sample_ratio(sizes: DataFrame, design_share: float = 0.85, alpha: float = SRM_ALPHA) -> DataFrame:
    """Chi-square test of the arm sizes against the designed treatment share."""
    counts = group(
        sizes,
        [],
        {"n_treatment": sum_where("treatment = 1", "n"), "n_control": sum_where("treatment = 0", "n")},
    )
    n = "(n_treatment + n_control)"
    expected = derive(
        counts, {"expected_t": f"{literal(design_share)} * {n}", "expected_c": f"{literal(1 - design_share)} * {n}"}
    )
    off = lambda seen, wished: ratio(f"pow({seen} - {wished}, 2)", wished)
    tested = derive(
        expected,
        {
            "observed_share": ratio("n_treatment", n),
            "chi2": f"{off('n_treatment', 'expected_t')} + {off('n_control', 'expected_c')}",
        },
    )
    tested = derive(
        tested, {"share_se": root(ratio("(observed_share * (1 - observed_share))", n)), "p_value": chi2_tail("chi2", "1")}
    )
    lo, hi = around("observed_share", "share_se", SHARE_Z)
    return pick(
        tested,
        {
            "n_treatment": "n_treatment",
            "n_control": "n_control",
            "design_share": literal(design_share),
            "observed_share": "observed_share",
            "ci_lo": lo,
            "ci_hi": hi,
            "chi2": "chi2",
            "p_value": "p_value",
            "alpha": literal(alpha),
            "srm_detected": f"p_value < {literal(alpha)}",
        },
    )


def welch(pairs: DataFrame) -> DataFrame:
    """Add Welch's t and its degrees of freedom (Satterthwaite) from group moments."""
    errors = derive(pairs, {f"error_{g}": ratio(f"var_{g}", f"n_{g}") for g in (1, 0)})
    own_df = " + ".join(ratio(f"pow(error_{g}, 2)", f"(n_{g} - 1)") for g in (1, 0))
    return derive(
        errors,
        {
            "t": ratio("(mean_1 - mean_0)", "sqrt(error_1 + error_0)"),
            "df": ratio("pow(error_1 + error_0, 2)", f"({own_df})"),
        },
    )


def balance(df: DataFrame, roles: Roles = Roles(), limit: float = SMD_LIMIT) -> DataFrame:
    """Per feature: means, standardized difference, variance ratio, Welch test, verdict."""
    return balance_of(group_moments(df, roles.treatment, roles), limit)


def balance_of(moments: DataFrame, limit: float = SMD_LIMIT) -> DataFrame:
    pairs = welch(with_smd(side_by_side(moments)))
    tested = pairs.withColumn("welch_p", student_two_sided("t", "df"))
    return pick(
        tested,
        {
            "feature": "feature",
            "mean_treatment": "mean_1",
            "mean_control": "mean_0",
            "smd": "smd",
            "variance_ratio": ratio("var_1", "var_0"),
            "welch_t": "t",
            "welch_df": "df",
            "welch_p": "welch_p",
            "balanced": f"abs(smd) < {literal(limit)}",
        },
    )


def balance_summary(table: DataFrame) -> DataFrame:
    return group(
        table,
        [],
        {
            "max_abs_smd": "max(abs(smd))",
            "n_balanced": "count_if(balanced)",
            "n_welch_below_05": "count_if(welch_p < 0.05D)",
            "n_features": "count(1)",
        },
    )


def rank_by_imbalance(table: DataFrame, top: int | None = None) -> DataFrame:
    """Features by size of the standardized difference, largest first."""
    ranked = table.selectExpr(
        "feature",
        "smd",
        "abs(smd) as abs_smd",
        "row_number() over (order by abs(smd) desc, feature) as place",
    )
    return ranked if top is None else ranked.filter(F.col("place") <= top)
