"""Positions and running totals over a whole table, without a task that sees all of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armlift.session import stored

# monotonically_increasing_id holds the partition above 33 bits of row number
ROW_BITS = 33


def with_position(df: DataFrame, order: list[str], value: str = "0L", within: str = "0") -> DataFrame:
    """Add ``_p_position`` (0, 1, ...) and ``_p_total``, both counted inside each ``within`` value.

    ``_p_total`` is the sum of ``value`` over the earlier rows. Rows are sorted by
    ``within`` and ``order``, nulls first; rows that tie are cut at any place, so no
    repeated row fills a partition. They are numbered inside their range partition and
    shifted by the sizes of the partitions before, a table of one row per partition and
    ``within`` value. Column names that start with ``_p_`` are reserved.
    """
    keys = [F.expr(k) for k in ("_p_within", *order, "_p_tie")]
    rows = df.selectExpr("*", f"{within} as _p_within", f"{value} as _p_value", "monotonically_increasing_id() as _p_tie")
    laid = stored(
        rows.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .drop("_p_tie")
        .withColumn("_p_place", F.monotonically_increasing_id())
    ).selectExpr("*", f"shiftright(_p_place, {ROW_BITS}) as _p_part")
    parts = laid.groupBy("_p_within", "_p_part").agg(
        F.min("_p_place").alias("_p_first"), F.count(F.lit(1)).alias("_p_rows"), F.sum("_p_value").alias("_p_sum")
    )
    earlier = "over (partition by _p_within order by _p_part rows between unbounded preceding and 1 preceding)"
    offsets = parts.selectExpr(
        "_p_within as _p_w",
        "_p_part as _p_p",
        "_p_first",
        f"coalesce(sum(_p_rows) {earlier}, 0L) as _p_rows_before",
        f"coalesce(sum(_p_sum) {earlier}, 0L) as _p_sum_before",
    )
    joined = laid.join(offsets, F.expr("_p_within <=> _p_w and _p_part = _p_p"))
    inside = (
        "over (partition by _p_part, _p_within order by _p_place rows between unbounded preceding and 1 preceding)"
    )
    placed = joined.selectExpr(
        *[f"`{c}`" for c in df.columns],
        "_p_rows_before + _p_place - _p_first as _p_position",
        *(["0L as _p_total"] if value == "0L" else [f"_p_sum_before + coalesce(sum(_p_value) {inside}, 0L) as _p_total"]),
    )
    return placed
