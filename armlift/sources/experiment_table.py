"""Reading and writing the experiment log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from armlift.schema import Roles, raw_schema
from armlift.sources.replacing import replace_table, restored


# Endings of files that cannot be split.
COMPRESSED = (".gz", ".deflate", ".snappy", ".zst", ".lz4", ".xz")


def read_raw_csv(
    spark: SparkSession,
    path: str,
    roles: Roles = Roles(),
    partitions: int | None = None,
    check_header: bool = True,
) -> DataFrame:
    """CSV with a header, plain or compressed; values that do not parse become null.

    Columns are taken by position. ``check_header`` refuses a file whose header names
    another order instead of reading it wrongly. ``partitions`` spreads the rows once.
    By default that is done for compressed files only, which one task has to read alone, and
    to as many partitions as Spark runs tasks; 0 leaves the rows where they are read.
    """
    df = (
        spark.read.schema(raw_schema(roles))
        .option("header", True)
        .option("mode", "PERMISSIVE")
        .option("enforceSchema", not check_header)
        .csv(path)
    )
    return spread(df, partitions)


REJECTED, FILE = "rejected_line", "source_file"


def read_with_rejects(
    spark: SparkSession, path: str, roles: Roles = Roles(), partitions: int | None = None, check_header: bool = True
) -> DataFrame:
    """As ``read_raw_csv``, with the text of a line that does not parse in full, and its file, beside the columns.

    Fields of such a line that do parse keep their values, the others are null.
    """
    schema = raw_schema(roles).add(REJECTED, "string")
    df = (
        spark.read.schema(schema)
        .option("header", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", REJECTED)
        .option("enforceSchema", not check_header)
        .csv(path)
        .selectExpr("*", f"_metadata.file_path as {FILE}")
    )
    return spread(df, partitions)


def rejects(rows: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """(source_file, reason, rejected_line) of the lines that did not parse, from stored rows of ``read_with_rejects``.

    The reason is a number of fields that is not the header's, or the first column whose field
    is no number of its type.
    """
    parts = f"split({REJECTED}, ',', -1)"
    kinds = {"double": "double", "integer": "int"}
    fails = [
        f"when try_cast(trim(fields[{i}]) as {kinds[f.dataType.typeName()]}) is null and trim(fields[{i}]) <> '' then 'value of {f.name}'"
        for i, f in enumerate(raw_schema(roles))
    ]
    width = len(raw_schema(roles))
    reason = f"case when size(fields) <> {width} then 'number of fields' {' '.join(fails)} else 'other' end"
    found = rows.where(f"{REJECTED} is not null").selectExpr(FILE, REJECTED, f"{parts} as fields")
    return found.selectExpr(FILE, f"{reason} as reason", REJECTED)


def reject_counts(rejected: DataFrame) -> DataFrame:
    """(source_file, reason, n)."""
    return rejected.groupBy(FILE, "reason").agg(F.count(F.lit(1)).alias("n"))


def spread(df: DataFrame, partitions: int | None) -> DataFrame:
    """Rows dealt once to this many partitions; by default as many as Spark runs tasks where files cannot be split, else none."""
    if partitions is None:
        packed = any(file.endswith(COMPRESSED) for file in df.inputFiles())
        partitions = df.sparkSession.sparkContext.defaultParallelism if packed else 0
    return df.repartition(partitions) if partitions else df


def read_experiment(spark: SparkSession, path: str) -> DataFrame:
    restored(spark, path)
    return spark.read.parquet(path)


def write_experiment(df: DataFrame, path: str) -> None:
    replace_table(df, path)


def number_rows(df: DataFrame, unit_id: str = "unit_id") -> DataFrame:
    """Key by position, for a table that is written right after and read from there on."""
    return df.select(F.monotonically_increasing_id().alias(unit_id), "*")
