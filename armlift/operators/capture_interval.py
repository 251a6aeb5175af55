"""Bootstrap interval of the capture shares, from Poisson weights of the units.

Resampling n of n units with replacement gives every unit a count that is close to Poisson
with mean 1, and independent of the others. The weights follow from a hash of unit and
replicate, so every engine and every partitioning draws the same ones. Only sums per slice of
the ranking leave the tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import IntegralType

from armlift.functions.digests import Digests
from armlift.functions.numeric import derive, group, literal, ratio, with_each_value
from armlift.operators.bootstrap import interval
from armlift.operators.ranking import TARGET_SHARES
from armlift.operators.uplift import in_large_batches

N_SLICES = 1000
# replicates that one hash serves, with 32 bits each
PER_HASH = 4
# units and hashes of each that are drawn at a time, and sums that a task holds before it sends them on
ROWS_HELD = 16_384
HASHES_HELD = 50
SUMS_HELD = 1_000_000
# weights up to this one are counted for all units at once
COMMON = 4
# treated and control units, then the successes among each
SUMS = {"n_t": "t", "n_c": "1 - t", "y_t": "y * t", "y_c": "y * (1 - t)"}


def poisson_limits() -> list[int]:
    """Cumulative probabilities of Poisson(1), as whole numbers of 32 bits, up to the last that differs from 1."""
    limits, term, total = [], math.exp(-1), 0.0
    for k in range(1, 20):
        total += term
        term /= k
        limits.append(round(total * 2**32))
        if limits[-1] >= 2**32 - 1:
            break
    return limits


def poisson_weights(beginnings: list[bytes], batches: range) -> np.ndarray:
    """(replicate, unit): the weight of each unit in the four replicates of every batch."""
    digests, steps = Digests(beginnings), poisson_limits()
    weights = np.zeros((len(batches) * PER_HASH, len(beginnings)), np.uint8)
    for i, batch in enumerate(batches):
        drawn, some = digests.of(f":{batch}".encode()), weights[i * PER_HASH : (i + 1) * PER_HASH]
        for limit in steps[:COMMON]:
            some += drawn >= np.uint32(limit)
        rare = drawn >= np.uint32(steps[COMMON - 1])
        some[rare] = np.searchsorted(steps, drawn[rare].astype(np.int64), side="right")
    return weights


def weighted_sums(groups: np.ndarray, values: np.ndarray, beginnings: list[bytes], n_boot: int) -> tuple[np.ndarray, np.ndarray]:
    """(groups, sums): weighted sums of the values of each group, as (group, replicate, value)."""
    order = np.argsort(groups, kind="stable")
    found, firsts = np.unique(groups[order], return_index=True)
    ends, values = np.append(firsts[1:], len(order)), values[order]
    beginnings = [beginnings[i] for i in order.tolist()]
    sums = np.empty((len(found), n_boot, values.shape[1]))
    last = (n_boot - 1) // PER_HASH + 1
    for batch in range(0, last, HASHES_HELD):
        replicates = slice(batch * PER_HASH, min((batch + HASHES_HELD) * PER_HASH, n_boot))
        weights = poisson_weights(beginnings, range(batch, min(batch + HASHES_HELD, last)))[: replicates.stop - replicates.start]
        for i, (first, end) in enumerate(zip(firsts.tolist(), ends.tolist())):
            sums[i, replicates] = weights[:, first:end].astype(np.float64) @ values[first:end]
    return found, sums


def slice_sums(ranks: DataFrame, n_boot: int, salt: str, n_slices: int = N_SLICES) -> DataFrame:
    """(metric, replicate, slice, n_t, n_c, y_t, y_c): weighted sums per slice of equal rank width.

    A unit is hashed and weighted where its row of the ranking lies; a task sends on one row per
    metric, slice and replicate it meets, so what is shuffled does not grow with the units.
    """
    beginning = f"cast(concat_ws(':', {literal(salt)}, cast(unit_id as string)) as binary)"
    place = f"cast(floor((rank - 1) * {n_slices} / n) as int)"
    placed = ranks.selectExpr("metric", f"{place} as slice", f"{beginning} as beginning", *[f"{text} as {c}" for c, text in SUMS.items()])
    whole = {c for c in SUMS if isinstance(placed.schema[c].dataType, IntegralType)}
    rows = placed.selectExpr("metric", "slice", "beginning", *[f"cast({c} as double) as {c}" for c in SUMS])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # sums of (metric, slice), and whether any row had the value
        held: dict[tuple[str | None, int], list[np.ndarray]] = {}
        for batch in in_large_batches(batches, ROWS_HELD):
            for first in range(0, batch.num_rows, ROWS_HELD):
                part = batch.slice(first, ROWS_HELD)
                metrics = part.column("metric").dictionary_encode(null_encoding="encode")
                names, codes = metrics.dictionary.to_pylist(), metrics.indices.to_numpy()
                values = np.stack([part.column(c).to_numpy(zero_copy_only=False) for c in SUMS], axis=1)
                known = ~np.stack([part.column(c).is_null().to_numpy(zero_copy_only=False) for c in SUMS], axis=1)
                values[~known] = 0
                groups = codes.astype(np.int64) * n_slices + part.column("slice").to_numpy()
                found, sums = weighted_sums(groups, values, part.column("beginning").to_pylist(), n_boot)
                any_ = np.zeros((len(found), len(SUMS)), bool)
                np.logical_or.at(any_, np.searchsorted(found, groups), known)
                for i, number in enumerate(found.tolist()):
                    key = names[number // n_slices], number % n_slices
                    if key in held:
                        held[key][0] += sums[i]
                        held[key][1] |= any_[i]
                    else:
                        held[key] = [sums[i].copy(), any_[i].copy()]
                if len(held) * n_boot > SUMS_HELD:
                    yield from rows_of(held)
                    held = {}
        yield from rows_of(held)

    def rows_of(held: dict[tuple[str | None, int], list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for (metric, slice_), (sums, any_) in held.items():
            columns = [pa.array([metric] * n_boot, pa.string()), pa.array(np.arange(n_boot, dtype=np.int32)), pa.array(np.full(n_boot, slice_, np.int32))]
            columns += [pa.array(sums[:, j]) if any_[j] else pa.nulls(n_boot, pa.float64()) for j in range(len(SUMS))]
            yield pa.RecordBatch.from_arrays(columns, ["metric", "replicate", "slice", *SUMS])

    parts = rows.mapInArrow(summed, "metric string, replicate int, slice int, " + ", ".join(f"{c} double" for c in SUMS))
    total = {c: f"cast(sum({c}) as bigint)" if c in whole else f"sum({c})" for c in SUMS}
    return group(parts, ["metric", "replicate", "slice"], total)


def replicate_captures(sums: DataFrame, shares: tuple[float, ...] = TARGET_SHARES) -> DataFrame:
    """(metric, replicate, share, capture): interpolated on the curve of each replicate; none without a positive total."""
    within = "partition by metric, replicate"
    upto = f"over ({within} order by slice rows between unbounded preceding and current row)"
    running = sums.selectExpr(
        "metric", "replicate", "slice", *[f"sum({c}) {upto} as {c}" for c in SUMS], f"sum(n_t + n_c) over ({within}) as n"
    )
    q = f"if(n_c > 0, y_t - y_c * {ratio('n_t', 'n_c')}, 0D)"
    curve = running.selectExpr("metric", "replicate", "slice", f"{ratio('n_t + n_c', 'n')} as phi", f"{q} as q")
    whole = f"over ({within} order by slice rows between unbounded preceding and unbounded following)"
    steps = derive(
        curve,
        {
            "phi_0": f"coalesce(lag(phi) over ({within} order by slice), 0D)",
            "q_0": f"coalesce(lag(q) over ({within} order by slice), 0D)",
            "total": f"last_value(q) {whole}",
        },
    )
    at_share = f"(q_0 + {ratio('(q - q_0)', '(phi - phi_0)')} * (share - phi_0))"
    pieces = with_each_value(steps.filter("total > 0"), "share", shares).filter("phi_0 < share and share <= phi")
    return pieces.selectExpr("metric", "replicate", "share", f"{ratio(at_share, 'total')} as capture")


def capture_bootstrap(
    ranks: DataFrame,
    shares: tuple[float, ...] = TARGET_SHARES,
    n_boot: int = 200,
    seed: int = 6,
    level: float = 0.95,
) -> DataFrame:
    """Percentile interval of the capture per metric and share, over replicates of the ranked units."""
    captures = replicate_captures(slice_sums(ranks, n_boot, f"capture{seed}"), shares)
    return group(captures, ["metric", "share"], {"n_boot": "count(1)", **interval("capture", level)})
