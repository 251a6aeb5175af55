"""Cut points of the features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armlift.functions.numeric import derive, group, literal, name, with_each_value
from armlift.session import stored


def bucket_probabilities(n_buckets: int) -> list[float]:
    return [i / n_buckets for i in range(1, n_buckets)]


def approximate_quantiles(
    df: DataFrame, columns: tuple[str, ...], probabilities: list[float], error: float = 0.001
) -> dict[str, list[float]]:
    """Quantiles within ``error`` of the asked rank: one pass, sketches of fixed size."""
    shares = ", ".join(literal(p) for p in probabilities)
    sketch = group(
        df, [], {c: f"percentile_approx({name(c)}, array({shares}), {round(1 / error)})" for c in columns}
    ).first()
    return {c: [float(v) for v in sketch[c] or []] for c in columns}


def counted_parts(df: DataFrame, columns: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(feature, part, value, n) and (feature, part, part_n, before, total): values counted by range partition.

    ``feature`` is the place in ``columns``. Values are counted first, so a value held by very
    many rows is one row from then on; ``before`` counts the values of the partitions before.
    """
    pairs = ", ".join(f"cast({name(c)} as double)" for c in columns)
    values = df.selectExpr(f"posexplode(array({pairs})) as (feature, value)")
    counts = group(values.filter("value is not null and not isnan(value)"), ["feature", "value"], {"n": "count(1)"})
    parts = stored(
        counts.repartitionByRange("feature", "value").withColumn("part", F.spark_partition_id())
    )
    earlier = "over (partition by feature order by part rows between unbounded preceding and 1 preceding)"
    totals = derive(
        group(parts, ["feature", "part"], {"part_n": "sum(n)"}),
        {"before": f"coalesce(sum(part_n) {earlier}, 0L)", "total": "sum(part_n) over (partition by feature)"},
    )
    return parts, totals


def even_edges(df: DataFrame, columns: tuple[str, ...], n_buckets: int) -> dict[str, list[float]]:
    """Exact edges of many buckets: the distinct values whose rank covers a multiple of 1 / ``n_buckets``.

    The multiples that a value covers follow from the counts before it and up to it, so the
    work does not grow with the number of buckets.
    """
    inside = "over (partition by feature, part order by value rows between unbounded preceding and current row)"
    parts, totals = counted_parts(df, columns)
    # totals has one row per feature and range partition
    upto = derive(parts.join(F.broadcast(totals), ["feature", "part"]), {"upto": f"before + sum(n) {inside}"})
    covered = lambda rank: f"least(({rank}) * {n_buckets} div total, {n_buckets - 1})"
    rows = upto.filter(f"{covered('upto')} > {covered('upto - n')}").select("feature", "value").collect()
    found: dict[str, list[float]] = {c: [] for c in columns}
    for row in rows:
        found[columns[row["feature"]]].append(row["value"])
    return {c: sorted(v) for c, v in found.items()}


def exact_quantiles(df: DataFrame, columns: tuple[str, ...], probabilities: list[float]) -> DataFrame:
    """(feature, probability, value): smallest value whose rank covers the probability.

    The distinct values are range-partitioned, the partition that holds each cut follows
    from the partition totals, and only those partitions are ranked: no task sees a whole column.
    """
    parts, totals = counted_parts(df, columns)
    # the rank is n - floor(n - p n), at least 1: rounding up without the error of p n
    rank = "greatest(1L, total - cast(floor(total - probability * total) as bigint))"
    cuts = (
        derive(with_each_value(totals, "probability", probabilities), {"rank": rank})
        .filter("before < rank and rank <= before + part_n")
        .selectExpr("feature", "part", "probability", "rank - before as local_rank")
    )
    # cuts has one row per feature and probability
    hits = parts.join(F.broadcast(cuts), ["feature", "part"])
    upto = "over (partition by feature, probability order by value rows between unbounded preceding and current row)"
    names = ", ".join(literal(c) for c in columns)
    return (
        derive(hits, {"upto": f"sum(n) {upto}"})
        .filter("upto - n < local_rank and local_rank <= upto")
        .selectExpr(f"array({names})[feature] as feature", "probability", "value")
    )


def edges_of(quantiles: DataFrame, columns: tuple[str, ...]) -> dict[str, list[float]]:
    """Bring the cut points (features x probabilities values) to the driver."""
    found: dict[str, list[float]] = {c: [] for c in columns}
    for row in quantiles.collect():
        found[row["feature"]].append(row["value"])
    return found


def unique_edges(quantiles: dict[str, list[float]]) -> dict[str, list[float]]:
    """Sorted cut points without repeats: a feature with few values gets fewer buckets."""
    return {c: sorted(set(v)) for c, v in quantiles.items()}


def bucket_edges(
    df: DataFrame, columns: tuple[str, ...], n_buckets: int = 5, error: float = 0.001
) -> dict[str, list[float]]:
    """Edges of quantile buckets; ``error=0`` gives exact quantiles."""
    probabilities = bucket_probabilities(n_buckets)
    if error > 0:
        return unique_edges(approximate_quantiles(df, columns, probabilities, error))
    return unique_edges(edges_of(exact_quantiles(df, columns, probabilities), columns))
