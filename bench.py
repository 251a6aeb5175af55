"""Time the analysis steps and the registered queries; prints one JSON line.

The raw log of the experiment is written as gzip CSV first (not timed). Then every
step runs from files to collected result tables, in the order of an analysis:
ingest, validity, lift, power, compliance, segments and uplift. Registered queries
run from the retail tables. Each entry runs once untimed, to warm the JVM, then timed; the
uplift step warms up with three trees.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from armlift.operators.uplift import TreeSettings
from armlift.plans import steps
from armlift.plans.registry import QUERIES
from armlift.schema import Roles
from armlift.sources.experiment_table import read_experiment
from armlift.sources.order_experiment import order_experiment

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
TREES = TreeSettings(n_trees=int(os.environ.get("BENCH_TREES", "400")))
WARM_TREES = TreeSettings(n_trees=3)
HEADLINE = (
    "profile_missing",
    "profile_duplicates",
    "validity_balance",
    "ab_lift",
    "power_bucket_tests",
    "compliance_cace_ci",
    "segment_cochran_q",
    "uplift_qini",
    "uplift_deciles",
)


def main() -> None:
    folder = tempfile.mkdtemp(prefix="armlift-bench-")
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("armlift-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "12g"))
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
    source, target = f"{folder}/raw", f"{folder}/experiment"
    raw = order_experiment(spark, FOLDER).select(*roles.columns).coalesce(1)
    raw.write.option("header", True).option("compression", "gzip").csv(source)

    def finish(tables):
        for table in tables.values():
            table.collect()

    def ingest():
        finish(steps.ingest(spark, source, target, roles, partitions=int(CPUS)))

    def on_table(step, **options):
        return lambda: finish(step(read_experiment(spark, target), roles, **options))

    runs = {
        "step_ingest_profile": ingest,
        "step_validity": on_table(steps.check_validity),
        "step_lift_10000_bootstrap": on_table(steps.measure_lift, n_boot=10_000),
        "step_power": on_table(steps.measure_power),
        "step_compliance_2000_bootstrap": on_table(steps.measure_compliance, n_boot=2000),
        "step_segments": on_table(steps.compare_segments),
        "step_uplift_200_bootstrap": on_table(steps.model_uplift, n_boot=200, settings=TREES),
        **{name: (lambda name=name: QUERIES[name](spark, FOLDER).collect()) for name in HEADLINE},
    }
    warm = {"step_uplift_200_bootstrap": on_table(steps.model_uplift, n_boot=200, settings=WARM_TREES)}
    for name, run in runs.items():
        warm.get(name, run)()
    times = {}
    for name, run in runs.items():
        start = time.perf_counter()
        run()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "analysis_steps_and_headline_queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"),
                "cpus": int(CPUS),
                "trees": TREES.n_trees,
            }
        )
    )


if __name__ == "__main__":
    main()
