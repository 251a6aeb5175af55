"""Randomness that belongs to the unit, not to the partition a row happens to be in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armlift.functions.numeric import literal, name

COPIES_PER_CHUNK = 100_000


def unit_uniform(unit_id: str, salt: str) -> str:
    """Uniform number in [0, 1) from the md5 of salt and unit id.

    The same in every engine, after every repartition and on every retry. It has 52 bits, so
    units share a value from some 10^8 units on only, and then by ones.
    """
    digest = f"md5(concat({literal(salt)}, cast({name(unit_id)} as string)))"
    return f"(cast(conv(substring({digest}, 1, 13), 16, 10) as bigint) / 4503599627370496D)"


def add_unit_id(df: DataFrame, unit_id: str = "unit_id") -> DataFrame:
    """Give a key to a table that has none.

    The key hashes all columns and the number of the copy, so identical rows get
    different keys and the set of keys does not depend on partitioning. Copies are
    counted, not collected; a group with very many copies is re-expanded in chunks
    spread over tasks.
    """
    columns = [name(c) for c in df.columns]
    groups = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("__copies"))
    last = f"cast(floor((__copies - 1) / {COPIES_PER_CHUNK}) as bigint)"
    chunks = groups.selectExpr("*", f"explode(sequence(0L, {last})) as __chunk")
    spread = chunks.repartition(F.expr(f"xxhash64({', '.join(columns)}, __chunk)"))
    first = f"__chunk * {COPIES_PER_CHUNK}"
    copies = spread.selectExpr(
        *columns, f"explode(sequence({first}, least({first} + {COPIES_PER_CHUNK}, __copies) - 1)) as __copy"
    )
    # two 64-bit hashes: one alone repeats at some 10^9 rows
    halves = [f"lpad(lower(hex(xxhash64({salt}, {', '.join(columns)}, __copy))), 16, '0')" for salt in (0, 1)]
    return copies.selectExpr(f"concat({', '.join(halves)}) as {name(unit_id)}", *columns)
