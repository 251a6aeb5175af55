"""Which column of an experiment table plays which part."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T


@dataclass(frozen=True)
class Roles:
    """Column roles of a one-row-per-unit experiment log.

    ``implications`` lists (outcome, prerequisite) pairs: a unit with the first
    must also have the second, e.g. nobody converts without visiting.
    """

    features: tuple[str, ...] = tuple(f"f{i}" for i in range(12))
    treatment: str = "treatment"
    exposure: str = "exposure"
    metrics: tuple[str, ...] = ("visit", "conversion")
    unit_id: str = "unit_id"
    implications: tuple[tuple[str, str], ...] = field(default=(("conversion", "visit"),))

    @property
    def binary(self) -> tuple[str, ...]:
        """0/1 columns in file order: arm, outcomes from rare to common, exposure."""
        return (self.treatment, *reversed(self.metrics), self.exposure)

    @property
    def columns(self) -> tuple[str, ...]:
        """Columns of the raw file, in file order."""
        return (*self.features, *self.binary)


def raw_schema(roles: Roles = Roles()) -> T.StructType:
    """Explicit schema of the raw file: nullable doubles, then nullable 0/1 integers."""
    return T.StructType(
        [T.StructField(c, T.DoubleType()) for c in roles.features]
        + [T.StructField(c, T.IntegerType()) for c in roles.binary]
    )
