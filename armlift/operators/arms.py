"""Sufficient statistics of the two arms, one pass over the units."""

from __future__ import annotations

from pyspark.sql import DataFrame

from armlift.functions.numeric import each, group, literal, name, sum_where
from armlift.schema import Roles


def arm_counts(df: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """(treatment, n, one success count per metric)."""
    sums = {m: f"cast(sum({name(m)}) as bigint)" for m in roles.metrics}
    return group(df, [roles.treatment], {"n": "count(1)", **sums})


def arm_sums(roles: Roles) -> dict[str, str]:
    """n_t, n_c and the successes <metric>_t, <metric>_c of a group of units."""
    t = name(roles.treatment)
    sums = {"n_t": f"sum({t})", "n_c": f"sum(1 - {t})"}
    for m in roles.metrics:
        sums[f"{m}_t"], sums[f"{m}_c"] = f"sum({name(m)} * {t})", f"sum({name(m)} * (1 - {t}))"
    return sums


def per_metric(df: DataFrame, keep: tuple[str, ...], roles: Roles) -> DataFrame:
    """(keep..., metric, n_t, x_t, n_c, x_c) from rows of arm sums."""
    return each(
        df,
        [
            {
                **{c: name(c) for c in keep},
                "metric": literal(m),
                "n_t": "n_t",
                "x_t": name(f"{m}_t"),
                "n_c": "n_c",
                "x_c": name(f"{m}_c"),
            }
            for m in roles.metrics
        ],
    )


def metric_counts(arms: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """(metric, n_t, x_t, n_c, x_c), one row per metric, from the arm counts.

    An arm that is missing counts 0, so every rate that needs it becomes null.
    """
    t = name(roles.treatment)
    sums = {"n_t": sum_where(f"{t} = 1", "n"), "n_c": sum_where(f"{t} = 0", "n")}
    for m in roles.metrics:
        sums[f"{m}_t"], sums[f"{m}_c"] = sum_where(f"{t} = 1", name(m)), sum_where(f"{t} = 0", name(m))
    return per_metric(group(arms, [], sums), (), roles)


def experiment_counts(df: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """The same counts straight from the units: one row leaves each task."""
    t = name(roles.treatment)
    sums = {"n_t": f"count_if({t} = 1)", "n_c": f"count_if({t} = 0)"}
    for m in roles.metrics:
        sums[f"{m}_t"], sums[f"{m}_c"] = sum_where(f"{t} = 1", name(m)), sum_where(f"{t} = 0", name(m))
    return per_metric(group(df, [], sums), (), roles)
