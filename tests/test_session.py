"""Intermediate tables in a session without a checkpoint folder, and their release."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

from armlift.session import new_folder, release, released_after, shared_folder, stored

ROOT = Path(__file__).resolve().parents[1]
SCRIPT = """
import sys
from pyspark.sql import SparkSession
from armlift.operators.profile import drop_missing
from armlift.plans import steps
from armlift.session import get_session, shared_folder
from armlift.sources.order_experiment import order_experiment
spark = get_session("plain", shuffle_partitions=4)
assert spark.conf.get("spark.checkpoint.dir", None) is None
assert shared_folder(spark).startswith(spark.conf.get("spark.sql.warehouse.dir"))
print("rows", steps.compare_segments(drop_missing(order_experiment(spark, sys.argv[1])))["segments"].count())
"""


def test_steps_run_without_a_checkpoint_folder(tmp_path):
    conf = tmp_path / "conf"
    conf.mkdir()
    env = os.environ | {"SPARK_CONF_DIR": str(conf), "SPARK_MASTER": "local[2]", "PYTHONPATH": str(ROOT)}
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT, "/root/testdata/sf0.001"],
        cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300,
    )
    assert "rows" in done.stdout, done.stderr[-2000:]


def test_stored_tables_can_be_released(spark):
    table = stored(spark.range(10))
    folder = table.inputFiles()[0].removeprefix("file:").replace("///", "/").rpartition("/")[0]
    assert os.path.isdir(folder)
    release(table)
    assert not os.path.exists(folder)


def test_only_stored_tables_are_released(spark):
    with pytest.raises(ValueError):
        release(spark.read.parquet("/root/testdata/sf0.001/orders.parquet"))


def test_a_scope_releases_what_was_stored_in_it(spark):
    kept = stored(spark.range(3))
    with released_after(spark):
        outer = stored(spark.range(4))
        with pytest.raises(RuntimeError), released_after(spark):
            inner = stored(spark.range(5))
            raise RuntimeError
        assert outer.count() == 4
        with pytest.raises(Exception):
            inner.count()
    assert kept.count() == 3
    with pytest.raises(Exception):
        outer.count()


def test_a_step_of_the_command_line_leaves_no_work_behind(spark, tmp_path):
    from armlift.__main__ import main
    from armlift.operators.profile import drop_missing
    from armlift.sources.order_experiment import order_experiment

    drop_missing(order_experiment(spark, "/root/testdata/sf0.001")).write.parquet(str(tmp_path / "table"))
    folder = shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    main(["lift", "--table", str(tmp_path / "table"), "--results", str(tmp_path / "out"), "--n-boot", "50"])
    assert set(os.listdir(folder)) == before and os.path.isdir(tmp_path / "out" / "lift" / "json")


def test_a_local_warehouse_is_refused_on_a_cluster():
    class Remote:
        """The settings of a session on a cluster without a shared folder."""

        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: {"spark.sql.warehouse.dir": "file:/somewhere/warehouse", "spark.master": "yarn", "spark.checkpoint.dir": None}[key])

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        new_folder(Remote)
