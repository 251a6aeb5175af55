"""Building blocks of SQL expressions: null-safe arithmetic, unpivots, windows.

Formulas are kept as SQL text. A formula is then one call to the JVM however long
it is, and reads like the arithmetic it stands for.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame


def name(column: str) -> str:
    """Quoted column name."""
    return f"`{column}`"


def literal(value: str | int | float) -> str:
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"{value!r}D" if isinstance(value, float) else repr(value)


def ratio(numerator: str, denominator: str) -> str:
    """Double quotient; null instead of an error when the denominator is 0."""
    return f"try_divide(cast({numerator} as double), cast({denominator} as double))"


def root(x: str) -> str:
    """Square root; null for the negative values that rounding can leave behind."""
    return f"nanvl(sqrt({x}), cast(null as double))"


def finite(x: str) -> str:
    """The value, or null for NaN and the infinities."""
    return f"(case when not isnan({x}) and abs({x}) != double('inf') then {x} end)"


def significant(x: str, digits: int = 6) -> str:
    """Finite doubles rounded to ``digits`` significant digits, ties to even, else null."""
    # the digits as a whole number times a power of ten; the text form keeps the result exact
    power = f"({digits - 1} - cast(floor(log10(abs({x}))) as int))"
    whole = f"cast(rint({x} * pow(10D, {power})) as bigint)"
    # below that the power of ten would overflow
    tiny = f"try_cast(format_string('%.{digits - 1}e', {x}) as double)"
    return (
        f"(case when {finite(x)} is null then null when {x} = 0 then 0D when abs({x}) < 1e-290D then {tiny} "
        f"else try_cast(concat({whole}, 'e', -{power}) as double) end)"
    )


def sum_where(predicate: str, value: str) -> str:
    """Sum of whole numbers over matching rows, 0 when none match."""
    return f"coalesce(sum(case when {predicate} then {value} end), 0L)"


def derive(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Add columns; they may use the columns already there, not each other."""
    return df.selectExpr("*", *[f"{value} as {name(column)}" for column, value in columns.items()])


def pick(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Keep only these columns, given as name -> expression."""
    return df.selectExpr(*[f"{value} as {name(column)}" for column, value in columns.items()])


def group(df: DataFrame, keys: Iterable[str], columns: Mapping[str, str]) -> DataFrame:
    """Aggregate name -> expression by the key columns."""
    keys = [name(k) for k in keys]
    selected = [*keys, *[f"{value} as {name(column)}" for column, value in columns.items()]]
    by = f" group by {', '.join(keys)}" if keys else ""
    return df.sparkSession.sql(f"select {', '.join(selected)} from {{rows}}{by}", rows=df)


def each(df: DataFrame, records: Iterable[Mapping[str, str]]) -> DataFrame:
    """Replace every row by one row per record (an unpivot without a join)."""
    structs = [
        "named_struct(" + ", ".join(f"{literal(column)}, {value}" for column, value in r.items()) + ")" for r in records
    ]
    return df.selectExpr(f"inline(array({', '.join(structs)}))")


def with_each_value(df: DataFrame, column: str, values: Iterable[str | int | float]) -> DataFrame:
    """Repeat every row once per literal value, in a new column."""
    return df.selectExpr("*", f"explode(array({', '.join(literal(v) for v in values)})) as {name(column)}")
