"""Percentile intervals from resampled sufficient statistics.

Resampling n units with replacement changes an experiment only through its cell
counts, and those follow a multinomial law. So replicates are drawn from the counts.
Successes per arm are inverse binomial draws from keyed hashes, in the engine's own
expressions. Cells of compliance are drawn in blocks that run in parallel; every block seeds
its own generator, which makes the draws independent of how the blocks are spread over tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armlift.functions.numeric import derive, each, group, literal, name, ratio
from armlift.operators.compliance import CELLS, estimates

BLOCK = 500


def block_generator(seed: int, metric: str, block: int) -> np.random.Generator:
    return np.random.default_rng([seed, zlib.crc32(metric.encode()), block])


def in_blocks(df: DataFrame, n_boot: int, block: int = BLOCK) -> DataFrame:
    """Repeat each row once per block of replicates, with the size of the block, over tasks."""
    last = (n_boot - 1) // block
    blocks = df.selectExpr("*", f"explode(sequence(0, {last})) as block")
    sized = derive(blocks, {"size": f"least({block}, {n_boot} - block * {block})"})
    return sized.repartition(min(last + 1, 64), "metric", "block")


def interval(column: str, level: float) -> dict[str, str]:
    """Percentile bounds of a replicated value (nulls are ignored)."""
    tail = (1 - level) / 2
    return {
        f"boot_{column}_lo": f"percentile({column}, {literal(tail)})",
        f"boot_{column}_hi": f"percentile({column}, {literal(1 - tail)})",
    }


def binomial_steps(counts: DataFrame, width: float = 9.0) -> DataFrame:
    """(key columns, k, below): the law of a binomial count as steps, for rows (.., n, x) with chance x / n.

    ``below`` is P(count <= k). The ratios of neighbouring probabilities are summed over the
    counts within ``width`` standard deviations and ten of the mean, outside of which 1e-18 is left; their
    number grows with the root of n.
    """
    keys = [c for c in counts.columns if c not in ("n", "x")]
    spread = f"({literal(width)} * sqrt(x * (n - x) / cast(n as double)) + 10)"
    ends = counts.filter("n > 0").selectExpr(
        "*",
        f"if(x = 0 or x = n, x, greatest(0L, cast(floor(x - {spread}) as bigint))) as first",
        f"if(x = 0 or x = n, x, least(n, cast(ceil(x + {spread}) as bigint))) as last",
    )
    each_k = ends.selectExpr("*", "explode(sequence(first, last)) as k")
    ratio_to_one_less = "ln((n - k + 1) / cast(k as double) * (x / cast(n - x as double)))"
    within = f"partition by {', '.join(name(k) for k in keys)}"
    upto = f"over ({within} order by k rows between unbounded preceding and current row)"
    logs = each_k.selectExpr(*keys, "k", f"sum(if(k = first, 0D, {ratio_to_one_less})) {upto} as log_weight")
    weights = logs.selectExpr(*keys, "k", f"exp(log_weight - max(log_weight) over ({within})) as weight")
    return weights.selectExpr(*keys, "k", f"sum(weight) {upto} / sum(weight) over ({within}) as below")


def binomial_draws(counts: DataFrame, n_boot: int, salt: str) -> DataFrame:
    """(key columns, replicate, drawn): binomial counts by inversion, from a hash of the keys and the replicate.

    The draws and the steps of the law are laid in one line; a draw is the first count plus
    the number of steps below it. So it does not depend on the engine or the layout.
    """
    keys = [c for c in counts.columns if c not in ("n", "x")]
    steps = binomial_steps(counts)
    lowest = steps.groupBy(*keys).agg(F.min("k").alias("first"))
    hashed = f"md5(concat_ws(':', {literal(salt)}, {', '.join(f'cast({name(k)} as string)' for k in keys)}, cast(replicate as string)))"
    uniform = f"cast(conv(substring({hashed}, 1, 13), 16, 10) as bigint) / 4503599627370496D"
    asked = lowest.selectExpr("*", f"explode(sequence(0L, {n_boot - 1}L)) as replicate").selectExpr(
        *keys, "first", "replicate", f"{uniform} as place"
    )
    line = asked.unionByName(steps.selectExpr(*keys, "cast(null as bigint) as first", "cast(null as bigint) as replicate", "below as place"))
    before = (
        f"count_if(replicate is null) over (partition by {', '.join(name(k) for k in keys)} "
        "order by place, replicate is null rows between unbounded preceding and current row)"
    )
    return line.selectExpr(*keys, "replicate", f"first + {before} as drawn").filter("replicate is not null")


def lift_replicates(counts: DataFrame, n_boot: int = 10_000, seed: int = 7) -> DataFrame:
    """(metric, replicate, n_t, x_t, n_c, x_c) with binomial successes per arm; none without both arms."""
    known = counts.filter("n_t > 0 and n_c > 0")
    arms = each(known, [{"metric": "metric", "arm": literal(a), "n": f"n_{a}", "x": f"x_{a}"} for a in ("t", "c")])
    drawn = binomial_draws(arms, n_boot, f"lift{seed}")
    paired = group(
        drawn, ["metric", "replicate"], {f"x_{a}": f"max(case when arm = {literal(a)} then drawn end)" for a in ("t", "c")}
    )
    # counts has one row per metric
    return paired.join(F.broadcast(known.select("metric", "n_t", "n_c")), "metric").select(
        "metric", "replicate", "n_t", "x_t", "n_c", "x_c"
    )


def lift_bootstrap(
    counts: DataFrame, n_boot: int = 10_000, seed: int = 7, level: float = 0.95
) -> DataFrame:
    """Percentile intervals of the absolute and relative lift, and the share of lifts <= 0."""
    rates = derive(
        lift_replicates(counts, n_boot, seed), {"rate_t": ratio("x_t", "n_t"), "rate_c": ratio("x_c", "n_c")}
    )
    lifts = derive(rates, {"abs": "rate_t - rate_c", "rel": f"{ratio('rate_t', 'rate_c')} - 1"})
    return group(
        lifts,
        ["metric"],
        {
            "n_boot": "count(1)",
            **interval("abs", level),
            **interval("rel", level),
            "share_not_positive": "avg(if(abs <= 0, 1D, 0D))",
        },
    )


def compliance_replicates(counts: DataFrame, n_boot: int = 2000, seed: int = 5) -> DataFrame:
    """Replicates of the compliance counts: multinomial treated cells, binomial control."""

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                cells = np.array([getattr(row, c) for c in CELLS], dtype=float)
                if cells.sum() == 0 or row.c_n == 0:
                    continue
                rng = block_generator(seed, row.metric, row.block)
                drawn = rng.multinomial(int(cells.sum()), cells / cells.sum(), size=row.size)
                yield pd.DataFrame(
                    {
                        "metric": row.metric,
                        "replicate": row.block * BLOCK + np.arange(row.size),
                        **{c: drawn[:, i] for i, c in enumerate(CELLS)},
                        "c_n": row.c_n,
                        "c_y1": rng.binomial(row.c_n, row.c_y1 / row.c_n, row.size),
                        "c_exposed": row.c_exposed,
                    }
                )

    cells = ", ".join(f"{c} long" for c in CELLS)
    schema = f"metric string, replicate long, {cells}, c_n long, c_y1 long, c_exposed long"
    return in_blocks(counts, n_boot).mapInPandas(draw, schema)


def compliance_bootstrap(
    counts: DataFrame, n_boot: int = 2000, seed: int = 5, level: float = 0.95
) -> DataFrame:
    """Percentile intervals of ITT, CACE, relative CACE and the naive contrast.

    Replicates without a defined value (null) are ignored by the percentiles.
    """
    bounds = {}
    for value in ("itt", "cace", "cace_rel", "naive_vs_control"):
        bounds |= interval(value, level)
    return group(
        estimates(compliance_replicates(counts, n_boot, seed)), ["metric"], {"n_boot": "count(1)", **bounds}
    )
