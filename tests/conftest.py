import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        # no debugging context per column expression: plans are built several times faster
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def raw(spark):
    from armlift.session import stored
    from armlift.sources.order_experiment import order_experiment

    return stored(order_experiment(spark, MEDIUM))


@pytest.fixture(scope="session")
def units(raw):
    from armlift.operators.profile import drop_missing

    return drop_missing(raw)


def by(rows, *keys):
    """Collected rows as dicts, keyed by one or more columns."""
    pick = lambda r: r[keys[0]] if len(keys) == 1 else tuple(r[k] for k in keys)
    return {pick(r): r.asDict() for r in rows}
