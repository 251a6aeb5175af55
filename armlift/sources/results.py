"""Result tables: writing them, reading them back and publishing them as one document."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from armlift.functions.numeric import group, literal, name, significant
from armlift.sources.replacing import replace_table, restored

Tables = dict[str, DataFrame]


def write_results(tables: Mapping[str, DataFrame], folder: str) -> None:
    """One JSON table per result, for readers, and one Parquet table, which keeps the types.

    Results are a few rows, hence one file each.
    """
    for table, df in tables.items():
        replace_table(df.repartition(1), f"{folder}/{table}/parquet")
        # the stored table is read again, as the plan behind it may be long or draw samples
        written = df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{table}/parquet")
        replace_table(written.coalesce(1), f"{folder}/{table}/json", "json")


def read_results(spark: SparkSession, folder: str, names: Iterable[str]) -> Tables:
    """The named result tables of a folder, as far as they are there."""
    found = {}
    for table in names:
        try:
            restored(spark, f"{folder}/{table}/parquet")
            found[table] = spark.read.parquet(f"{folder}/{table}/parquet").coalesce(1)
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
    return found


def cleaned(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles, also within lists, to significant digits; NaN and infinities to null."""
    rules = {
        T.DoubleType(): lambda c: significant(c, digits),
        T.ArrayType(T.DoubleType()): lambda c: f"transform({c}, x -> {significant('x', digits)})",
        T.ArrayType(T.DoubleType(), False): lambda c: f"transform({c}, x -> {significant('x', digits)})",
    }
    kept = [f"{rules.get(f.dataType, str)(name(f.name))} as {name(f.name)}" for f in df.schema]
    return df.selectExpr(*kept)


def section(title: str, df: DataFrame, by: str | None = None) -> DataFrame:
    """(section, payload): the rows of a result table as a JSON list, or as lists keyed by ``by``.

    For result tables only: all rows of the table become one value.
    """
    record = f"struct({', '.join(name(c) for c in df.columns if c != by)})"
    if by is None:
        payload = f"to_json(array_sort(collect_list({record})))"
        return cleaned(df).selectExpr(f"{literal(title)} as section", f"{payload} as payload")
    lists = group(cleaned(df), [by], {"items": f"array_sort(collect_list({record}))"})
    keyed = lists.selectExpr(f"cast({name(by)} as string) as key", "items")
    payload = "to_json(map_from_entries(array_sort(collect_list(struct(key, items)))))"
    return keyed.selectExpr(f"{literal(title)} as section", f"{payload} as payload")


def document(sections: list[DataFrame]) -> DataFrame:
    """One row, one column: the JSON object of all sections."""
    rows = reduce(DataFrame.unionByName, sections)
    members = "transform(array_sort(collect_list(struct(section, payload))), s -> concat('\"', s.section, '\":', s.payload))"
    return rows.selectExpr(f"concat('{{', array_join({members}, ','), '}}') as document")
