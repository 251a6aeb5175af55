"""Run the steps of an analysis from the command line.

    python -m armlift ingest --input raw.csv.gz --table experiment.parquet --results out
    python -m armlift validity --table experiment.parquet --results out
    python -m armlift publish --results out
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from armlift.operators.uplift import TreeSettings
from armlift.plans import publish, steps
from armlift.session import get_session, released_after
from armlift.sources.experiment_table import read_experiment
from armlift.sources.results import Tables, write_results


def options() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="armlift", description=__doc__.splitlines()[0])
    step = top.add_subparsers(dest="step", required=True)

    def add(title: str, **extra: object) -> None:
        sub = step.add_parser(title)
        sub.add_argument("--table", required=title != "publish", help="experiment table (Parquet)")
        sub.add_argument("--results", required=True, help="folder of result tables")
        sub.add_argument("--work", help="folder for intermediate tables that all executors reach")
        for option, default in extra.items():
            kind = type(default) if default is not None else str
            sub.add_argument("--" + option.replace("_", "-"), type=kind, default=default)

    add("ingest", input=None, partitions=-1, key="position")
    add("validity", design_share=0.85)
    add("lift", n_boot=10_000, seed=7)
    add("power", alpha=0.05, power=0.80, seed=11)
    add("compliance", n_boot=2000, seed=5)
    add("segments", n_buckets=5, error=0.001)
    add("uplift", sample_rows=2_000_000, n_boot=200, seed=6, trees=400, step_size=0.05)
    add("publish")
    return top


def run(spark: SparkSession, args: argparse.Namespace) -> Tables:
    """Result tables of the chosen step."""
    if args.step == "ingest":
        return steps.ingest(spark, args.input, args.table, partitions=None if args.partitions < 0 else args.partitions, key=args.key)
    df = read_experiment(spark, args.table)
    if args.step == "validity":
        return steps.check_validity(df, design_share=args.design_share)
    if args.step == "lift":
        return steps.measure_lift(df, n_boot=args.n_boot, seed=args.seed)
    if args.step == "power":
        return steps.measure_power(df, alpha=args.alpha, target=args.power, salt=f"power{args.seed}")
    if args.step == "compliance":
        return steps.measure_compliance(df, n_boot=args.n_boot, seed=args.seed)
    if args.step == "segments":
        return steps.compare_segments(df, n_buckets=args.n_buckets, error=args.error)
    trees = TreeSettings(n_trees=args.trees, step=args.step_size)
    return steps.model_uplift(df, sample_rows=args.sample_rows, n_boot=args.n_boot, seed=args.seed, settings=trees)


def main(arguments: list[str] | None = None) -> None:
    args = options().parse_args(arguments)
    spark = get_session(f"armlift-{args.step}", work=args.work)
    if args.step == "publish":
        # every step leaves its tables in the folder; the document takes the sections that are there
        publish.publish_folder(spark, args.results).write.mode("overwrite").text(f"{args.results}/document")
    else:
        with released_after(spark):
            write_results(run(spark, args), args.results)


if __name__ == "__main__":
    main()
