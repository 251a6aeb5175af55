"""Groups of any size compared in blocks: every pair of blocks of a group is one run of rows in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armlift.session import stored

# rows a task should get; a task holds one run of them at a time
TASK_ROWS = 200_000


def block_pairs(
    rows: DataFrame, keys: list[str], member: list[str], block_rows: int, carried: tuple[str, ...] = ()
) -> tuple[DataFrame, int]:
    """Rows of groups of two or more as (``keys``, ``member``, ``carried``, _run, _side), and the partitions they need.

    A group is dealt in blocks of about ``block_rows`` by the hash of the member. A run is a
    pair of blocks: side 0 of it meets side 1, or itself where all rows are of side 0.
    """
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_members")).where("_members > 1")
    sizes = stored(counts.selectExpr(*keys, f"cast(ceil(_members / {block_rows}) as int) as _blocks", "_members"))
    total = sizes.agg(F.sum(F.expr("_members * _blocks"))).first()[0] or 0
    spark = rows.sparkSession
    wished = max(spark.sparkContext.defaultParallelism * 2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = rows.join(sizes.drop("_members"), keys).selectExpr(
        *keys, *member, *carried, f"cast(pmod(xxhash64({', '.join(member)}), _blocks) as int) as _block", "explode(sequence(0, _blocks - 1)) as _other"
    )
    run = f"xxhash64({', '.join(keys)}, least(_block, _other), greatest(_block, _other))"
    paired = placed.selectExpr(*keys, *member, *carried, f"{run} as _run", "cast(_block > _other as int) as _side")
    return paired, max(min(wished, total // 1000 + 1), total // TASK_ROWS)


def in_runs(rows: DataFrame, partitions: int) -> DataFrame:
    """The rows dealt by run, those of a run next to each other."""
    return rows.repartition(partitions, "_run").sortWithinPartitions("_run", "_side")


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one run at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        run = batch.column("_run").to_numpy()
        cuts = np.flatnonzero(run[1:] != run[:-1]) + 1
        if held and held[-1].column("_run")[0].as_py() != run[0]:
            yield pa.Table.from_batches(held)
            held = []
        edges = [0, *cuts.tolist(), batch.num_rows]
        for start, end in zip(edges[:-2], edges[1:-1]):
            yield pa.Table.from_batches([*held, batch.slice(start, end - start)])
            held = []
        held.append(batch.slice(edges[-2]))
    if held:
        yield pa.Table.from_batches(held)
