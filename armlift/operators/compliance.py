"""Effect of assignment and effect of exposure under one-sided non-compliance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armlift.functions.numeric import derive, each, group, literal, name, pick, ratio, root, sum_where
from armlift.functions.tails import two_sided_z
from armlift.operators.lift import around, share_variance
from armlift.operators.moments import group_moments, side_by_side, with_smd
from armlift.schema import Roles

CELLS = ("t_e0_y0", "t_e0_y1", "t_e1_y0", "t_e1_y1")


def compliance_cells(df: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """Units per (treatment, exposure, outcomes...) combination."""
    return group(df, [roles.treatment, roles.exposure, *roles.metrics], {"n": "count(1)"})


def compliance_counts(cells: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """Marginal totals per metric: treated by (exposure, outcome), control, exposed control."""
    t, e = name(roles.treatment), name(roles.exposure)
    wide = {"c_n": sum_where(f"{t} = 0", "n"), "c_exposed": sum_where(f"{t} = 0 and {e} = 1", "n")}
    for m in roles.metrics:
        wide[f"{m}__c_y1"] = sum_where(f"{t} = 0 and {name(m)} = 1", "n")
        for shown in (0, 1):
            for y in (0, 1):
                cell = f"{t} = 1 and {e} = {shown} and {name(m)} = {y}"
                wide[f"{m}__t_e{shown}_y{y}"] = sum_where(cell, "n")
    return each(
        group(cells, [], wide),
        [
            {
                "metric": literal(m),
                **{c: name(f"{m}__{c}") for c in CELLS},
                "c_n": "c_n",
                "c_y1": name(f"{m}__c_y1"),
                "c_exposed": "c_exposed",
            }
            for m in roles.metrics
        ],
    )


def estimates(counts: DataFrame, two_sided: bool = False) -> DataFrame:
    """Point estimates per row of counts; other columns are kept.

    ``two_sided`` also subtracts exposure in the control arm from the compliance
    rate; by default control units are taken as never exposed.
    """
    compliance = ratio("n_exposed", "n_t")
    if two_sided:
        compliance = f"{compliance} - {ratio('c_exposed', 'c_n')}"
    sized = derive(
        counts, {"n_exposed": "t_e1_y0 + t_e1_y1", "n_t": "t_e0_y0 + t_e0_y1 + t_e1_y0 + t_e1_y1"}
    )
    rated = derive(
        sized,
        {
            "rate_control": ratio("c_y1", "c_n"),
            "rate_treatment": ratio("(t_e0_y1 + t_e1_y1)", "n_t"),
            "rate_exposed": ratio("t_e1_y1", "n_exposed"),
            "rate_unexposed": ratio("t_e0_y1", "(n_t - n_exposed)"),
            "compliance": compliance,
        },
    )
    itt = derive(rated, {"itt": "rate_treatment - rate_control"})
    cace = derive(itt, {"itt_rel": ratio("itt", "rate_control"), "cace": ratio("itt", "compliance")})
    base = derive(cace, {"rate_without_exposure": "rate_exposed - cace"})
    return derive(
        base,
        {
            "cace_rel": f"case when rate_without_exposure > 0 then {ratio('cace', 'rate_without_exposure')} end",
            "naive_vs_control": "rate_exposed - rate_control",
            "naive_vs_unexposed": "rate_exposed - rate_unexposed",
        },
    )


EFFECTS = (
    "rate_control",
    "rate_treatment",
    "rate_exposed",
    "rate_unexposed",
    "compliance",
    "itt",
    "itt_rel",
    "cace",
    "rate_without_exposure",
    "cace_rel",
    "naive_vs_control",
    "naive_vs_unexposed",
)


def effects(counts: DataFrame, two_sided: bool = False) -> DataFrame:
    return estimates(counts, two_sided).select("metric", *EFFECTS)


def effect_intervals(counts: DataFrame, level: float = 0.95) -> DataFrame:
    """Delta-method intervals of ITT and CACE.

    Outcome and exposure are averaged over the same treated units, so their
    covariance enters the variance of the quotient.
    """
    spread = derive(
        estimates(counts),
        {
            "var_itt": f"{share_variance('rate_treatment', 'n_t')} + {share_variance('rate_control', 'c_n')}",
            "var_compliance": share_variance("compliance", "n_t"),
            "covariance": ratio(f"({ratio('t_e1_y1', 'n_t')} - rate_treatment * compliance)", "n_t"),
        },
    )
    var_cace = ratio(
        "(var_itt - 2 * cace * covariance + pow(cace, 2) * var_compliance)", "pow(compliance, 2)"
    )
    spread = derive(spread, {"se_itt": root("var_itt"), "se_cace": root(var_cace)})
    bounds = {"metric": "metric"}
    for e in ("itt", "cace"):
        bounds[e] = e
        bounds[f"{e}_lo"], bounds[f"{e}_hi"] = around(e, f"se_{e}", two_sided_z(level))
    return pick(spread, bounds)


def exposure_selection(df: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """Standardized difference of every feature, exposed against unexposed treated units."""
    treated = df.filter(F.col(roles.treatment) == 1)
    pairs = with_smd(side_by_side(group_moments(treated, roles.exposure, roles)))
    return pairs.selectExpr("feature", "mean_1 as mean_exposed", "mean_0 as mean_unexposed", "smd")


def imbalance_count(table: DataFrame, limit: float = 0.1) -> DataFrame:
    return group(table, [], {"n_imbalanced": f"count_if(abs(smd) >= {literal(limit)})", "n_features": "count(1)"})


def naive_bias(table: DataFrame) -> DataFrame:
    """How far the exposed-against-control contrast is from the causal effect.

    One verdict over all metrics: close when every ratio is within 0.1 of 1, else
    the side all ratios share, else distorted.
    """
    ratios = table.selectExpr(
        "metric", "naive_vs_control", "cace", f"{ratio('naive_vs_control', 'cace')} as bias_ratio"
    )
    verdict = (
        "case when max(abs(bias_ratio - 1)) over () < 0.1D then 'close' "
        "when min(bias_ratio) over () > 1 then 'overstates' "
        "when max(bias_ratio) over () < 1 then 'understates' else 'distorts' end"
    )
    return derive(ratios, {"verdict": verdict})
