"""Difference between the arms: z-test, intervals and what they mean in outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame

from armlift.functions.numeric import derive, group, literal, pick, ratio, root
from armlift.functions.tails import normal_two_sided, two_sided_z


def share_variance(p: str, n: str) -> str:
    """Variance of a share observed on n units."""
    return ratio(f"({p} * (1 - {p}))", n)


def with_rates(counts: DataFrame) -> DataFrame:
    """Add the rate of each arm to (n_t, x_t, n_c, x_c) rows."""
    return derive(counts, {"rate_treatment": ratio("x_t", "n_t"), "rate_control": ratio("x_c", "n_c")})


def standard_errors(rates: DataFrame) -> DataFrame:
    """Add the pooled (equal rates) and unpooled standard error of the difference, and the difference."""
    pooled = derive(rates, {"rate_pooled": ratio("(x_t + x_c)", "(n_t + n_c)")})
    return derive(
        pooled,
        {
            "se_pooled": root(f"rate_pooled * (1 - rate_pooled) * ({ratio('1', 'n_t')} + {ratio('1', 'n_c')})"),
            "se": root(f"{share_variance('rate_treatment', 'n_t')} + {share_variance('rate_control', 'n_c')}"),
            "difference": "rate_treatment - rate_control",
        },
    )


def around(estimate: str, error: str, crit: float) -> tuple[str, str]:
    """Bounds of a symmetric interval."""
    return f"{estimate} - {literal(crit)} * {error}", f"{estimate} + {literal(crit)} * {error}"


def lift(counts: DataFrame, level: float = 0.95) -> DataFrame:
    """Rates, absolute and relative lift with intervals, z and two-sided p per metric.

    The test pools the variance under equal rates, the absolute interval does not,
    and the relative interval is symmetric on the log of the rate ratio.
    """
    crit = two_sided_z(level)
    missing = lambda p, n: ratio(f"(1 - {p})", f"({n} * {p})")
    effects = derive(
        standard_errors(with_rates(counts)),
        {
            "rate_ratio": ratio("rate_treatment", "rate_control"),
            "log_se": root(f"{missing('rate_treatment', 'n_t')} + {missing('rate_control', 'n_c')}"),
            "z": ratio("difference", "se_pooled"),
        },
    )
    abs_lo, abs_hi = around("difference", "se", crit)
    log_lo, log_hi = around("0D", "log_se", crit)
    return pick(
        effects,
        {
            **{c: c for c in ("metric", "n_t", "x_t", "n_c", "x_c", "rate_treatment", "rate_control")},
            "abs_lift": "difference",
            "abs_lo": abs_lo,
            "abs_hi": abs_hi,
            "rel_lift": "rate_ratio - 1",
            "rel_lo": f"rate_ratio * exp({log_lo}) - 1",
            "rel_hi": f"rate_ratio * exp({log_hi}) - 1",
            "z": "z",
            "p_value": normal_two_sided("z"),
        },
    )


def incremental(lifts: DataFrame) -> DataFrame:
    """Outcomes the treatment added among the treated units."""
    return lifts.selectExpr("metric", "n_t", "abs_lift", "abs_lift * n_t as incremental")


def signal_to_noise(lifts: DataFrame, common: str = "visit", rare: str = "conversion") -> DataFrame:
    """How much rarer the second metric is, and how much wider its relative interval."""
    of = lambda metric, value: f"max(case when metric = {literal(metric)} then {value} end)"
    one_row = group(
        lifts,
        [],
        {
            "rate_common": of(common, "rate_control"),
            "rate_rare": of(rare, "rate_control"),
            "width_common": of(common, "rel_hi - rel_lo"),
            "width_rare": of(rare, "rel_hi - rel_lo"),
        },
    )
    return pick(
        one_row,
        {
            "base_rate_ratio": ratio("rate_common", "rate_rare"),
            "ci_width_ratio": ratio("width_rare", "width_common"),
            "width_common": "width_common",
            "width_rare": "width_rare",
        },
    )


def interval_agreement(lifts: DataFrame, boot: DataFrame) -> DataFrame:
    """Largest endpoint gap between analytic and bootstrap relative intervals, per metric.

    A metric agrees when the gap is under 5 % of its relative lift plus half a
    point; ``all_agree`` is the verdict over all metrics.
    """
    both = lifts.select("metric", "rel_lift", "rel_lo", "rel_hi").join(
        boot.select("metric", "boot_rel_lo", "boot_rel_hi"), "metric"
    )
    gaps = derive(both, {"max_gap": "greatest(abs(rel_lo - boot_rel_lo), abs(rel_hi - boot_rel_hi))"})
    judged = derive(gaps, {"agree": "max_gap < 0.05D * abs(rel_lift) + 0.005D"})
    return judged.selectExpr("metric", "rel_lift", "max_gap", "agree", "bool_and(agree) over () as all_agree")
