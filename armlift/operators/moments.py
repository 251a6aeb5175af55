"""Mean and variance of every feature per group, one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame

from armlift.functions.numeric import derive, each, group, literal, name, ratio
from armlift.schema import Roles

STATS = {"n": "count", "mean": "avg", "var": "var_samp"}


def group_moments(df: DataFrame, key: str, roles: Roles = Roles()) -> DataFrame:
    """(group, rows, feature, n, mean, var) with the sample variance; n counts values, rows all rows."""
    wide = {"rows": "count(1)"} | {f"{f}__{s}": f"{fn}({name(f)})" for f in roles.features for s, fn in STATS.items()}
    rows = [
        {"group": name(key), "rows": "`rows`", "feature": literal(f), **{s: name(f"{f}__{s}") for s in STATS}} for f in roles.features
    ]
    return each(group(df, [key], wide), rows)


def side_by_side(moments: DataFrame) -> DataFrame:
    """(feature, n_1, mean_1, var_1, n_0, mean_0, var_0) from the moments of groups 1 and 0."""
    of = lambda g, s: f"max(case when `group` = {g} then {s} end)"
    return group(moments, ["feature"], {f"{s}_{g}": of(g, s) for g in (1, 0) for s in STATS})


def with_smd(pairs: DataFrame) -> DataFrame:
    """Add the standardized mean difference; 0 where neither group varies."""
    spread = derive(pairs, {"spread": "sqrt((var_1 + var_0) / 2)"})
    smd = f"case when spread = 0 then 0D else {ratio('(mean_1 - mean_0)', 'spread')} end"
    return derive(spread, {"smd": smd}).drop("spread")
