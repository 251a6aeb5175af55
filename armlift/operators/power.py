"""How small an effect could the experiment have seen, and on how little traffic?"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

from armlift.functions.numeric import derive, group, literal, name, pick, ratio, root, with_each_value
from armlift.functions.tails import normal_cdf, normal_quantile, normal_two_sided
from armlift.functions.units import unit_uniform
from armlift.operators.arms import arm_sums, per_metric
from armlift.operators.lift import share_variance, standard_errors, with_rates
from armlift.schema import Roles

# The traffic shares and bucket counts of the standard report.
FRACTIONS = (1.0, 0.5, 0.2, 0.1, 0.05, 0.02, 0.01, 0.005, 0.002, 0.001)
BUCKET_COUNTS = (10, 100, 1000)
NEWTON_STEPS = 5
# parts of a split that serves several bucket counts
MOST_PARTS = 100_000


def with_power(df: DataFrame, alpha: float, column: str) -> DataFrame:
    """Add the power to find the observed difference with arm sizes ``size_t`` and ``size_c``.

    The critical value uses the pooled standard error, the difference has the
    unpooled one, and rejections in both directions count.
    """
    pooled = derive(df, {"pooled": ratio("(size_t * rate_treatment + size_c * rate_control)", "(size_t + size_c)")})
    errors = derive(
        pooled,
        {
            "limit": f"{literal(normal_quantile(1 - alpha / 2))} * "
            + root(f"pooled * (1 - pooled) * ({ratio('1', 'size_t')} + {ratio('1', 'size_c')})"),
            "se": root(f"{share_variance('rate_treatment', 'size_t')} + {share_variance('rate_control', 'size_c')}"),
            "gap": "abs(rate_treatment - rate_control)",
        },
    )
    tails = derive(errors, {"same": ratio("(gap - limit)", "se"), "opposite": ratio("(-gap - limit)", "se")})
    powered = derive(tails, {column: f"{normal_cdf('same')} + {normal_cdf('opposite')}"})
    return powered.drop("pooled", "limit", "se", "gap", "same", "opposite")


def power_grid(
    counts: DataFrame,
    fractions: tuple[float, ...] = FRACTIONS,
    alpha: float = 0.05,
    power: float = 0.8,
) -> DataFrame:
    """Detectable effect and power per metric and share of the traffic."""
    z = literal(normal_quantile(1 - alpha / 2) + normal_quantile(power))
    grid = derive(
        with_each_value(with_rates(counts), "fraction", fractions),
        {"size_t": "n_t * fraction", "size_c": "n_c * fraction"},
    )
    spread = root(f"rate_control * (1 - rate_control) * ({ratio('1', 'size_t')} + {ratio('1', 'size_c')})")
    sized = derive(grid, {"mde_abs": f"{z} * {spread}", "rel_lift": f"{ratio('rate_treatment', 'rate_control')} - 1"})
    sized = derive(sized, {"mde_rel": ratio("mde_abs", "rate_control")})
    return pick(
        with_power(sized, alpha, "power"),
        {
            "metric": "metric",
            "fraction": "fraction",
            "n_total": "(n_t + n_c) * fraction",
            "rate_control": "rate_control",
            "rel_lift": "rel_lift",
            "mde_abs": "mde_abs",
            "mde_rel": "mde_rel",
            "lift_over_mde": ratio("rel_lift", "mde_rel"),
            "power": "power",
        },
    )


def smallest_traffic(grid: DataFrame, target: float = 0.8) -> DataFrame:
    """Smallest tested share of traffic that reaches the target power; null if none."""
    reached = f"case when power >= {literal(target)} then fraction end"
    return group(grid, ["metric"], {"min_fraction": f"min({reached})"})


def bucket_arm_sums(
    df: DataFrame,
    bucket_counts: tuple[int, ...] = BUCKET_COUNTS,
    roles: Roles = Roles(),
    salt: str = "power",
) -> DataFrame:
    """(k, bucket, metric, n_t, x_t, n_c, x_c) for k disjoint random buckets, every k in one job.

    Every unit goes to one bucket of each split. Where the counts have a small common multiple,
    units are summed once in a split of that many and the buckets are sums of its parts; else
    each unit is summed once for each count. Sums are made where the units are read, so a task
    sends on at most as many rows as there are buckets or parts.
    """
    columns = [name(c) for c in (roles.treatment, *roles.metrics)]
    placed = df.selectExpr(*columns, f"{unit_uniform(roles.unit_id, salt)} as place")
    finest = math.lcm(*bucket_counts)
    if finest <= MOST_PARTS:
        sums = arm_sums(roles)
        parts = group(derive(placed, {"part": f"cast(floor(place * {finest}) as bigint)"}), ["part"], sums)
        split = derive(with_each_value(parts, "k", bucket_counts), {"bucket": f"cast(part div ({finest} div k) as int)"})
        totals = group(split, ["k", "bucket"], {c: f"sum({name(c)})" for c in sums})
        return per_metric(totals, ("k", "bucket"), roles)
    split = derive(with_each_value(placed, "k", bucket_counts), {"bucket": "cast(floor(place * k) as int)"})
    totals = group(split, ["k", "bucket"], arm_sums(roles))
    return per_metric(totals, ("k", "bucket"), roles)


def bucket_tests(sums: DataFrame) -> DataFrame:
    """Pooled z-test per bucket; z is 0 where the bucket has no variance."""
    z = f"case when se_pooled > 0 then {ratio('difference', 'se_pooled')} when se_pooled = 0 then 0D end"
    tested = derive(standard_errors(with_rates(sums)), {"z": z})
    return derive(tested, {"p_value": normal_two_sided("z")})


def empirical_power(tests: DataFrame, counts: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Share of buckets with a significant positive lift, beside the analytic power.

    Only wins of the treatment count here, while the analytic power adds both tails.
    """
    win = f"p_value < {literal(alpha)} and rate_treatment > rate_control"
    shares = group(
        tests, ["k", "metric"], {"n_buckets": "count(1)", "empirical_power": f"avg(if({win}, 1D, 0D))"}
    )
    sized = derive(shares.join(with_rates(counts), "metric"), {"size_t": "n_t / k", "size_c": "n_c / k"})
    return with_power(sized, alpha, "analytic_power").selectExpr(
        "k", "1 / k as fraction", "metric", "n_buckets", "empirical_power", "analytic_power"
    )


def units_needed(
    counts: DataFrame, even_share: float = 0.5, alpha: float = 0.05, power: float = 0.8
) -> DataFrame:
    """Units for the target power at the actual and at an even split, and their ratio.

    With s0 and s1 the standard errors of one unit under equal and under observed rates and
    d the gap, n units find it with probability Phi((d x - z s0) / s1) + Phi((-d x - z s0) / s1)
    for x = sqrt(n) and the critical value z. Newton steps solve that for the target, from the
    solution that leaves out rejections in the wrong direction. A target that no units at all
    reach already has no solution: null.
    """
    z_alpha, z_power = normal_quantile(1 - alpha / 2), normal_quantile(power)
    z_alpha, z_power = literal(z_alpha), literal(z_power)
    shares = {"actual": "share_t", "even": literal(even_share)}

    def errors(s: str) -> tuple[str, str]:
        pooled = f"({s} * rate_treatment + (1 - {s}) * rate_control)"
        return (
            root(f"{pooled} * (1 - {pooled}) * ({ratio('1', s)} + {ratio('1', f'(1 - {s})')})"),
            root(f"{share_variance('rate_treatment', s)} + {share_variance('rate_control', f'(1 - {s})')}"),
        )

    sized = derive(with_rates(counts), {"share_t": ratio("n_t", "(n_t + n_c)")})
    sized = derive(sized, {f"s{i}_{split}": e for split, s in shares.items() for i, e in enumerate(errors(s))})
    rows = derive(sized, {"gap": "abs(rate_treatment - rate_control)"})

    def solved(x: str) -> str:
        """Newton steps as one fold, so that a few rows do not cost a plan of many layers."""
        start = ratio(f"({z_alpha} * s0_{x} + {z_power} * s1_{x})", "gap")
        side = lambda sign: ratio(f"({sign}gap * x - {z_alpha} * s0_{x})", f"s1_{x}")
        tails = f"named_struct('right', {side('')}, 'wrong', {side('-')})"
        over = f"({normal_cdf('t.right')} + {normal_cdf('t.wrong')} - {literal(power)})"
        density = f"(exp(-t.right * t.right / 2) - exp(-t.wrong * t.wrong / 2)) / {literal(math.sqrt(2 * math.pi))}"
        step = f"greatest(x - {ratio(over, f'(gap / s1_{x} * {density})')}, x / 4)"
        return f"aggregate(sequence(1, {NEWTON_STEPS}), {start}, (x, i) -> element_at(transform(array({tails}), t -> {step}), 1))"

    rows = derive(rows, {f"x_{x}": solved(x) for x in shares})
    none = {x: f"2 * {normal_cdf(ratio(f'(-{z_alpha} * s0_{x})', f's1_{x}'))} >= {literal(power)}" for x in shares}
    need = {f"n_{x}": f"if({none[x]}, null, x_{x} * x_{x})" for x in shares}
    return derive(rows, need).selectExpr(
        "metric", "share_t", "n_actual", "n_even", f"{ratio('n_actual', 'n_even')} as cost_ratio"
    )
