"""Two-model uplift: one boosted-tree classifier per arm, scored by their difference."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, StructField, StructType

from armlift.functions.numeric import derive, each, group, literal, name, pick
from armlift.functions.units import unit_uniform
from armlift.operators.boosting import Forest, TreeSettings, fit_forest, in_large_batches
from armlift.operators.quantiles import edges_of, even_edges, exact_quantiles
from armlift.schema import Roles

# rows that are walked through the trees at a time
SCORED_ROWS = 50_000


def sample_units(df: DataFrame, rows: int, roles: Roles = Roles(), salt: str = "sample") -> DataFrame:
    """About ``rows`` units (all if there are fewer), chosen by the hash of the unit id."""
    return sample_share(df, min(1.0, rows / max(df.count(), 1)), roles, salt)


def sample_share(df: DataFrame, share: float, roles: Roles = Roles(), salt: str = "sample") -> DataFrame:
    """About this share of the units, chosen by the hash of the unit id."""
    return df if share >= 1 else df.filter(f"{unit_uniform(roles.unit_id, salt)} < {literal(share)}")


def split_units(
    df: DataFrame, test_share: float = 0.5, roles: Roles = Roles(), salt: str = "split", exact: bool = False
) -> DataFrame:
    """Add ``is_test``, drawn within each arm by the hash of the unit id.

    ``exact`` cuts each arm at the quantile of its hashes instead of at the share
    itself, so the sizes are right to the unit but for units that share the 52-bit hash at the cut.
    """
    place, t = unit_uniform(roles.unit_id, salt), name(roles.treatment)
    if not exact:
        return derive(df, {"is_test": f"{place} < {literal(test_share)}"})
    arms = {"place_0": 0, "place_1": 1}
    placed = pick(df, {c: f"case when {t} = {arm} then {place} end" for c, arm in arms.items()})
    cuts = edges_of(exact_quantiles(placed, tuple(arms), [test_share]), tuple(arms))
    inside = [f"({t} = {arm} and {place} <= {literal(cut)})" for c, arm in arms.items() for cut in cuts[c]]
    return derive(df, {"is_test": " or ".join(inside) or "false"})


@dataclass(frozen=True)
class TLearner:
    """One forest with a model for every (metric, arm)."""

    forest: Forest
    roles: Roles = field(default_factory=Roles)

    def score(self, df: DataFrame, kept: tuple[str, ...] | None = None) -> DataFrame:
        """Add ``uplift_<metric>`` = P(y = 1 | x, treated) - P(y = 1 | x, control), and both parts ``p1_``, ``p0_``.

        ``kept`` names the columns that are carried along, all by default.
        """
        forest, roles = self.forest, self.roles
        if kept is None:
            kept = tuple(df.columns)
        else:
            df = df.select(*[name(c) for c in dict.fromkeys((*kept, *forest.features))])
        places = [df.columns.index(f) for f in forest.features]
        parts = [f"p{arm}_{roles.metrics[metric]}" for metric, arm in forest.models]

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            walks = forest.walks()
            for held in in_large_batches(batches, SCORED_ROWS):
                columns = [held.column(i).cast(pa.float64()).fill_null(np.nan).to_numpy() for i in places]
                chances = 1 / (1 + np.exp(-forest.margins(columns, walks)))
                carried = held.columns[: len(kept)]
                yield pa.RecordBatch.from_arrays([*carried, *map(pa.array, chances)], [*kept, *parts])

        schema = StructType([*df.schema.fields[: len(kept)], *[StructField(p, DoubleType()) for p in parts]])
        return derive(df.mapInArrow(scored, schema), {f"uplift_{m}": f"{name(f'p1_{m}')} - {name(f'p0_{m}')}" for m in roles.metrics})


def feature_edges(train: DataFrame, bins: int, roles: Roles = Roles()) -> dict[str, list[float]]:
    """Cut points of up to ``bins`` bins per feature: exact quantiles of the training rows."""
    return even_edges(train, roles.features, bins)


def fit_t_learner(
    train: DataFrame,
    settings: TreeSettings = TreeSettings(),
    seed: int = 6,
    roles: Roles = Roles(),
    edges: dict[str, list[float]] | None = None,
) -> TLearner:
    """Fit the models of all metrics and arms together; ``edges`` are the bins of the features, quantiles by default."""
    edges = feature_edges(train, settings.bins, roles) if edges is None else edges
    return TLearner(
        fit_forest(train, roles.features, roles.treatment, roles.metrics, roles.unit_id, edges, settings, seed), roles
    )


def calibration(scored: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """(metric, arm, n, observed, predicted): mean outcome and mean prediction of each arm's model."""
    t, wide, rows = name(roles.treatment), {}, []
    for m in roles.metrics:
        for arm in (0, 1):
            stats = {
                "n": f"count_if({t} = {arm})",
                "observed": f"avg(case when {t} = {arm} then {name(m)} end)",
                "predicted": f"avg(case when {t} = {arm} then {name(f'p{arm}_{m}')} end)",
            }
            wide |= {f"{m}_{arm}_{s}": text for s, text in stats.items()}
            rows.append({"metric": literal(m), "arm": str(arm), **{s: name(f"{m}_{arm}_{s}") for s in stats}})
    return each(group(scored, [], wide), rows)
