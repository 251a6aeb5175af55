"""Time the analysis steps on the experiment repeated to about 14 million units.

usage: python bench_scale.py [sf_dir] [copies] [trees]

Every copy of the orders gets unit ids, arm and outcomes of its own. The raw log is
written once as Parquet and as gzip CSV files (not timed).
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from armlift.functions.numeric import derive
from armlift.operators import profile
from armlift.operators.uplift import TreeSettings
from armlift.plans import steps
from armlift.schema import Roles
from armlift.sources.experiment_table import read_experiment
from armlift.sources.order_experiment import COLUMNS, order_experiment, planted


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    copies = int(sys.argv[2]) if len(sys.argv) > 2 else 93
    trees = int(sys.argv[3]) if len(sys.argv) > 3 else 400
    folder = tempfile.mkdtemp(prefix="armlift-scale-")
    spark = (
        SparkSession.builder.master(f"local[{os.environ.get('BENCH_CPUS', '8')}]")
        .config("spark.sql.shuffle.partitions", "32")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "16g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        # local sockets without the delays of TCP: jobs of a few milliseconds take half the time
        .config("spark.python.unix.domain.socket.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.checkpoint.dir", f"{folder}/shared")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    roles = Roles()
    features = order_experiment(spark, sf_dir).select("unit_id", *roles.features)
    repeated = features.repartition(32).selectExpr(
        "*", f"explode(sequence(0, {copies - 1})) as copy"
    )
    units = repeated.selectExpr(f"unit_id * {copies} + copy as unit_id", *roles.features)
    units = derive(units, {"expensive": "if(f0 > 250000, 1D, 0D)", "rich": "if(f2 > 5000, 1D, 0D)"})
    raw = planted(units).select(*COLUMNS)
    times = {}

    def timed(name, run):
        start = time.perf_counter()
        tables = run() or {}
        for table in tables.values():
            table.collect()
        times[name] = round(time.perf_counter() - start, 2)
        print(name, times[name], flush=True)

    timed("write_raw_parquet", lambda: raw.write.parquet(f"{folder}/raw"))
    stored_raw = spark.read.parquet(f"{folder}/raw")
    timed(
        "write_raw_csv",
        lambda: stored_raw.select(*roles.columns)
        .write.option("header", True)
        .option("compression", "gzip")
        .csv(f"{folder}/csv"),
    )
    timed("ingest", lambda: steps.ingest(spark, f"{folder}/csv", f"{folder}/ingested", roles))
    profile.drop_missing(stored_raw, roles).write.parquet(f"{folder}/experiment")
    table = lambda: read_experiment(spark, f"{folder}/experiment")
    timed("validity", lambda: steps.check_validity(table(), roles))
    timed("lift", lambda: steps.measure_lift(table(), roles))
    timed("power", lambda: steps.measure_power(table(), roles))
    timed("compliance", lambda: steps.measure_compliance(table(), roles))
    timed("segments", lambda: steps.compare_segments(table(), roles))
    timed("uplift", lambda: steps.model_uplift(table(), roles, settings=TreeSettings(n_trees=trees)))
    print(json.dumps({"units": stored_raw.count(), "trees": trees, "seconds": times}))
    spark.stop()


if __name__ == "__main__":
    main()
