"""Reading the input tables, and what every operator means by a word."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

# a word is a run of anything but ASCII white space
WORD = r"[^\\x20\\x09-\\x0D]+"
SPACE = r"[\\x20\\x09-\\x0D]+"


# texts are long: what a Python worker and its executor hold of them is bounded by bytes and rows
BATCH_SETTINGS = {
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
}


def map_batches(rows: DataFrame, function: Callable, schema: str | StructType) -> DataFrame:
    """``mapInArrow`` in small batches; the settings of the session stay at these values."""
    for setting, value in BATCH_SETTINGS.items():
        rows.sparkSession.conf.set(setting, value)
    return rows.mapInArrow(function, schema)


def byte_texts(batch: pa.RecordBatch, column: str = "text") -> Iterator[bytes]:
    """UTF-8 bytes of the texts of a batch, one at a time; null is empty."""
    return (value.as_py() or b"" for value in batch.column(column).cast(pa.binary()))


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def lower_ascii(column: str) -> str:
    """SQL text that lower-cases A-Z only."""
    return f"translate({column}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
