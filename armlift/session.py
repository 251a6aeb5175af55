"""Session factory and the shared folder for intermediate tables."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"
# folders of the tables that the scope around owns
OWNED: ContextVar[list[str] | None] = ContextVar("owned", default=None)


def get_session(
    app_name: str = "armlift", shuffle_partitions: int | None = None, work: str | None = None
) -> SparkSession:
    """Session with UTC time and adaptive execution.

    Master and driver memory come from ``SPARK_MASTER`` and ``SPARK_DRIVER_MEMORY``
    where set, so ``spark-submit`` settings are left alone on a cluster. ``work`` is the
    folder for intermediate tables; all executors must reach it.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
        # local sockets without the delays of TCP: jobs of a few milliseconds take half the time
        .config("spark.python.unix.domain.socket.enabled", "true")
    )
    if "SPARK_MASTER" in os.environ:
        builder = builder.master(os.environ["SPARK_MASTER"])
    if "SPARK_DRIVER_MEMORY" in os.environ:
        builder = builder.config("spark.driver.memory", os.environ["SPARK_DRIVER_MEMORY"])
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if work:
        builder = builder.config(CHECKPOINT_SETTING, work)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Where the setting is missing, a folder inside the warehouse. A warehouse in a local folder is
    shared with the executors of a local master only; on a cluster it is refused.
    """
    folder = spark.conf.get(CHECKPOINT_SETTING, None)
    if folder:
        return folder.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if urlparse(warehouse).scheme in ("", "file") and not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError(f"name a folder that all executors reach in {CHECKPOINT_SETTING}: {warehouse} is local")
    return warehouse + "/armlift-work"


def new_folder(spark: SparkSession) -> str:
    """Name of a folder in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/armlift-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written table.

    Cuts the lineage durably: later passes prune columns of the stored table, and
    a lost executor costs a re-read instead of a re-sort. The table stays until
    ``release`` is called with it, or the owner of the shared folder clears it.
    """
    path = new_folder(df.sparkSession)
    if (owned := OWNED.get()) is not None:
        owned.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Delete the files of ``stored`` tables that are no longer needed."""
    for table in tables:
        context = table.sparkSession.sparkContext
        for folder in {file.rpartition("/")[0] for file in table.inputFiles()}:
            if "/armlift-" not in folder:
                raise ValueError(f"not a stored table: {folder}")
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def released_after(spark: SparkSession) -> Iterator[None]:
    """Own the tables stored inside, and delete them at the end, also after an error.

    For a job that has written its results by then. A scope inside another one owns its own tables.
    """
    owned: list[str] = []
    token = OWNED.set(owned)
    try:
        yield
    finally:
        OWNED.reset(token)
        for folder in owned:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stored_result(df: DataFrame) -> DataFrame:
    """``stored`` for a result table of a few thousand rows that several others use.

    The table is computed with the usual parallelism and read back as one partition,
    so windows and groupings on it need no further shuffle.
    """
    return stored(df).coalesce(1)
