"""Reproducible shuffle of a whole table into shards by a format-preserving permutation.

Rows are numbered 0 .. n-1 in the order of their key. A Feistel network permutes the
numbers of a rectangle a x b that holds n cells or a few more; a number that leaves
0 .. n-1 is permuted again until it is back (cycle walking). Shard and slot follow by
division from the permuted number, so both can be computed for any row without the rest.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession

from armlift.llm.ordering import with_position
from armlift.llm.tables import documents

# Prime modulus of the round function (2^31 - 1), and its multipliers and offsets per round.
PRIME = 2147483647
MULTIPLIERS = (1103515245, 1812433253, 1664525, 1566083941, 69069, 22695477, 1597334677, 741103597)
OFFSETS = (12345, 907633385, 1013904223, 1, 362437, 521288629, 88675123, 5783321)
# walks kept in the plan; see ``permuted``
WALKS = 64


def sides(n: int) -> tuple[int, int]:
    """Sides (a, b) of the smallest near-square rectangle with at least n cells."""
    b = math.isqrt(max(n, 1) - 1) + 1
    return -(-max(n, 1) // b), b


def round_value(half: str, i: int, seed: int) -> str:
    """Keyed value of one half, as integer SQL that stays below 2^62."""
    first = f"((({half} + {seed % PRIME}) % {PRIME}) * {MULTIPLIERS[i]}L + {OFFSETS[i]}) % {PRIME}"
    square = f"(({first}) * ({first}) + {OFFSETS[-1 - i]}) % {PRIME}"
    return f"(({square}) * {MULTIPLIERS[-1 - i]}L) % {PRIME}"


def network(x: str, n: int, seed: int) -> list[tuple[str, str]]:
    """Steps (name, expression) of the network; the last one is the permuted number."""
    a, b = sides(n)
    left, right = "_f_l0", "_f_r0"
    steps = [(left, f"({x}) div {b}L"), (right, f"({x}) % {b}L")]
    for i in range(len(MULTIPLIERS)):
        if i % 2 == 0:
            left, value = f"_f_l{i + 1}", f"({left} + {round_value(right, i, seed)}) % {a}L"
            steps.append((left, value))
        else:
            right, value = f"_f_r{i + 1}", f"({right} + {round_value(left, i, seed)}) % {b}L"
            steps.append((right, value))
    return [*steps, ("_f_y", f"{left} * {b}L + {right}")]


def once(x: str, n: int, seed: int) -> str:
    """The network as one expression; a one-element transform gives each step its name."""
    *steps, (_, body) = network(x, n, seed)
    for step, value in reversed(steps):
        body = f"element_at(transform(array({value}), {step} -> {body}), 1)"
    return body


def permuted(df: DataFrame, column: str, n: int, seed: int) -> DataFrame:
    """Add ``_f_permuted``: the place of ``column`` (0 .. n-1) in the shuffled order of n rows.

    A walk visits no number outside 0 .. n-1 twice, so it ends after as many steps as
    the rectangle has spare cells (fewer than its side). Up to 4,096 rows that is below
    WALKS; beyond, a spare cell follows another with probability under 1 / 64, and the
    chance of WALKS in a row is below 1e-115 - the plan then stops with an error.
    """
    a, b = sides(n)
    spare = a * b - n
    rows = df
    for step, value in network(column, n, seed):
        rows = rows.selectExpr("*", f"{value} as {step}")
    place = "_f_y"
    if spare:
        again = once("at", n, seed)
        walked = f"aggregate(sequence(1, {min(spare, WALKS)}), _f_y, (at, i) -> if(at < {n}L, at, {again}))"
        rows = rows.selectExpr("*", f"if(_f_y < {n}L, _f_y, {walked}) as _f_end")
        place = f"if(_f_end < {n}L, _f_end, cast(raise_error('cycle walk did not end') as bigint))"
    return rows.selectExpr(*[f"`{c}`" for c in df.columns], f"{place} as _f_permuted")


def shard(df: DataFrame, order: list[str], n_shards: int, seed: int = 1) -> DataFrame:
    """Add ``shard`` (0 .. n_shards-1) and ``slot`` (0, 1, ... inside the shard) to every row.

    ``order`` are the columns that number the rows; rows equal in all of them are
    interchangeable. Shard sizes differ by one row at most. Null keys come first; an
    empty table stays empty. Columns of the input stay, but for ``shard`` and ``slot``, which
    are replaced; names that start with ``_p_`` or ``_f_`` are reserved.
    """
    numbered = with_position(df, order)
    n = df.count()
    placed = permuted(numbered, "_p_position", n, seed)
    return placed.selectExpr(
        *[f"`{c}`" for c in df.columns if c not in ("shard", "slot")],
        f"cast(_f_permuted % {n_shards} as int) as shard",
        f"_f_permuted div {n_shards} as slot",
    )


def op1_shard_documents(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in 8 shards of equal row counts; size of a null text is 1, its crc32 null."""
    rows = documents(spark, folder).selectExpr(
        "doc_id", "coalesce(octet_length(text), 0) + 1L as size", "crc32(cast(text as binary)) as text_crc32"
    )
    return shard(rows, ["doc_id", "size", "text_crc32"], 8).selectExpr(
        "doc_id", "size", "text_crc32", "'rows' as law", "shard", "slot", "cast(null as int) as grown_shard"
    )
