"""Is the raw table complete, consistent and free of surprises?"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from armlift.functions.numeric import each, group, literal, name, pick, ratio
from armlift.schema import Roles
from armlift.session import stored_result

QUARTILES = (0.25, 0.5, 0.75)


def float_columns(df: DataFrame) -> set[str]:
    return {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}


def present(df: DataFrame, columns: tuple[str, ...]) -> str:
    """True where no listed column is null or NaN.

    Written column by column, so checks on columns that cannot be null fold away
    and the others reach the scan.
    """
    floats = float_columns(df)
    checks = [f"{name(c)} is not null" for c in columns]
    checks += [f"not isnan({name(c)})" for c in columns if c in floats]
    return " and ".join(checks)


def drop_missing(df: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """Rows with a value in every column; duplicates stay, each row is a unit."""
    return df.filter(present(df, roles.columns))


@dataclass(frozen=True)
class Measure:
    """Aggregates over all rows, and the table their single row unfolds into."""

    aggregates: dict[str, str]
    rows: list[dict[str, str]]

    def of(self, df: DataFrame) -> DataFrame:
        return each(group(df, [], self.aggregates), self.rows)


def per_column(columns: tuple[str, ...], key: str, stats: dict[str, str]) -> Measure:
    """Every statistic of every column; ``{c}`` in a statistic stands for the column."""
    aggregates = {f"{c}__{s}": text.replace("{c}", name(c)) for c in columns for s, text in stats.items()}
    return Measure(aggregates, [{key: literal(c), **{s: name(f"{c}__{s}") for s in stats}} for c in columns])


def missing_measure(df: DataFrame, roles: Roles) -> Measure:
    floats = float_columns(df)
    aggregates = {f"{c}__null": f"count_if({name(c)} is null)" for c in roles.columns}
    aggregates |= {f"{c}__nan": f"count_if(isnan({name(c)}))" for c in roles.columns if c in floats}
    rows = [
        {
            "column": literal(c),
            "n_null": name(f"{c}__null"),
            "n_nan": name(f"{c}__nan") if c in floats else "0L",
            "n": "n",
        }
        for c in roles.columns
    ]
    return Measure({**aggregates, "n": "count(1)"}, rows)


def rows_measure(df: DataFrame, roles: Roles) -> Measure:
    aggregates = {"n": "count(1)", "rows_written": f"count_if({present(df, roles.columns)})"}
    row = {"rows_read": "n", "rows_written": "rows_written", "rows_dropped": "n - rows_written"}
    return Measure(aggregates, [row])


def domain_measure(roles: Roles) -> Measure:
    stats = {
        "n_zero": "count_if({c} = 0)",
        "n_one": "count_if({c} = 1)",
        "n_other": "count_if({c} not in (0, 1))",
        "min_value": "min({c})",
        "max_value": "max({c})",
    }
    measure = per_column(roles.binary, "column", stats)
    for row in measure.rows:
        row["is_binary"] = f"{row['n_zero']} > 0 and {row['n_one']} > 0 and {row['n_other']} = 0"
    return measure


def consistency_measure(roles: Roles) -> Measure:
    checks = {"control_exposed": f"{name(roles.treatment)} = 0 and {name(roles.exposure)} = 1"}
    for outcome, needed in roles.implications:
        checks[f"{outcome}_without_{needed}"] = f"{name(outcome)} = 1 and {name(needed)} = 0"
    rows = [{"check": literal(check), "n_violations": name(check)} for check in checks]
    return Measure({check: f"count_if({p})" for check, p in checks.items()}, rows)


def share_measure(roles: Roles) -> Measure:
    row = {"n": "n", "n_treatment": "n_treatment", "treatment_share": ratio("n_treatment", "n")}
    return Measure({"n": "count(1)", "n_treatment": f"count_if({name(roles.treatment)} = 1)"}, [row])


MOMENTS = {"mean": "avg({c})", "stddev": "stddev_samp({c})", "min": "min({c})", "max": "max({c})"}


def moments_measure(roles: Roles) -> Measure:
    return per_column(roles.features, "feature", MOMENTS)


def quartile_measure(roles: Roles, accuracy: int) -> Measure:
    shares = ", ".join(literal(q) for q in QUARTILES)
    return per_column(
        roles.features, "feature", {"quartiles": f"percentile_approx({{c}}, array({shares}), {accuracy})"}
    )


def distinct_measure(roles: Roles) -> Measure:
    return per_column(roles.features, "feature", {"approx_distinct": "approx_count_distinct({c})"})


def summary_of(df: DataFrame, moments: DataFrame, roles: Roles, accuracy: int) -> DataFrame:
    """One row per feature, values to four decimals.

    Quantile and distinct-count sketches have a fixed size, whatever the number of
    rows. Each kind takes a pass of its own: next to them the other aggregates leave
    generated code, and the joint pass costs more than the single ones.
    """
    quartiles, distinct = quartile_measure(roles, accuracy).of(df), distinct_measure(roles).of(df)
    return moments.join(quartiles, "feature").join(distinct, "feature").selectExpr(
        "feature",
        *[f"round({s}, 4) as {s}" for s in ("mean", "stddev", "min")],
        *[f"round(quartiles[{i}], 4) as p{round(100 * q)}" for i, q in enumerate(QUARTILES)],
        "round(max, 4) as max",
        "approx_distinct",
    )


def missing_counts(df: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """(column, n_null, n_nan, n) for every column."""
    return missing_measure(df, roles).of(df)


def row_accounting(df: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """Rows read, kept and dropped for a missing value."""
    return rows_measure(df, roles).of(df)


def binary_domains(df: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """Does each 0/1 column hold exactly the values 0 and 1 (nulls aside)?"""
    return domain_measure(roles).of(df)


def consistency(df: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """(check, n_violations): exposed controls, and outcomes without their prerequisite."""
    return consistency_measure(roles).of(df)


def treatment_share(df: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """Treated rows over all rows read, those with a missing arm included."""
    return share_measure(roles).of(df)


def binary_means(df: DataFrame, roles: Roles = Roles()) -> DataFrame:
    return per_column(roles.binary, "column", {"mean": "avg({c})"}).of(df)


def feature_moments(df: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """(feature, mean, stddev, min, max)."""
    return moments_measure(roles).of(df)


def feature_summary(df: DataFrame, roles: Roles = Roles(), accuracy: int = 10_000) -> DataFrame:
    """Moments, approximate quartiles and approximate distinct count per feature."""
    return summary_of(df, feature_moments(df, roles), roles, accuracy)


def all_measures(df: DataFrame, roles: Roles = Roles(), accuracy: int = 10_000) -> dict[str, DataFrame]:
    """Every table above from few passes.

    Counts of all kinds share one pass and moments another; each leaves one stored
    row that unfolds into its tables. Aggregates beyond that size no longer fit
    compiled code, so merging further makes the pass slower, not faster.
    """
    passes = [
        {
            "rows": rows_measure(df, roles),
            "missing": missing_measure(df, roles),
            "consistency": consistency_measure(roles),
            "treatment_share": share_measure(roles),
            "binary_domain": domain_measure(roles),
            "binary_means": per_column(roles.binary, "column", {"mean": "avg({c})"}),
        },
        {"feature_moments": moments_measure(roles)},
    ]
    tables = {}
    for measures in passes:
        merged: dict[str, str] = {}
        for measure in measures.values():
            merged |= measure.aggregates
        row = stored_result(group(df, [], merged))
        tables |= {table: each(row, measure.rows) for table, measure in measures.items()}
    tables["feature_summary"] = summary_of(df, tables["feature_moments"], roles, accuracy)
    return tables


def binary_values(df: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """(column, value, n): the distinct non-null values of every 0/1 column, one job."""
    long = each(df, [{"column": literal(c), "value": name(c)} for c in roles.binary])
    return group(long.filter("value is not null"), ["column", "value"], {"n": "count(1)"})


def digest(columns: tuple[str, ...] | list[str], salts: tuple[int, int]) -> list[str]:
    """Two 64-bit hashes of some columns. Hashes pass over nulls, so the places of nulls are hashed too."""
    nulls = " + ".join(f"if({name(c)} is null, {2**i}L, 0L)" for i, c in enumerate(columns))
    return [f"xxhash64({salt}, {nulls}, {', '.join(map(name, columns))})" for salt in salts]


def duplicates(df: DataFrame, roles: Roles = Roles(), vector: tuple[str, ...] | None = None) -> DataFrame:
    """Rows that repeat another row in full, and rows that repeat a feature vector.

    Rows are compared by 128-bit digests, so a shuffle moves four numbers of a row and not all
    of its columns; two different rows among 10^12 share a digest with probability below 10^-14. Both
    counts come from one scan: the distinct rows are grouped again by the feature vector.
    Partial aggregation removes copies before each shuffle, so a row copied very often never
    gathers in one task.
    """
    vector = vector or roles.features
    full = list(dict.fromkeys((*vector, *roles.binary)))
    keys = dict(zip(("v1", "v2", "r1", "r2"), digest(vector, (1, 2)) + digest(full, (3, 4))))
    rows = group(pick(df, keys), keys, {"copies": "count(1)"})
    vectors = group(rows, ["v1", "v2"], {"copies": "sum(copies)", "distinct_rows": "count(1)"})
    totals = group(
        vectors,
        [],
        {"n": "coalesce(sum(copies), 0L)", "n_rows": "coalesce(sum(distinct_rows), 0L)", "n_vectors": "count(1)"},
    )
    return totals.selectExpr("n", "n - n_rows as duplicate_rows", "n - n_vectors as duplicate_vectors")


def arm_sizes(df: DataFrame, roles: Roles = Roles()) -> DataFrame:
    return group(df.selectExpr(f"{name(roles.treatment)} as treatment"), ["treatment"], {"n": "count(1)"})
