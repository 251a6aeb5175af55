"""Near-duplicate vectors by spherical-cap filters.

A filter is a direction; a vector passes it when their inner product reaches a threshold, so
the filter holds a cap of the sphere. The directions are random product codes: a random
rotation, a cut into parts, and a short list of random directions for each part; every
combination of one direction per part is a filter. Which filters a vector passes is found by
list decoding: a direction of one part is followed only if the best of the other part could
still reach the threshold. Vectors that share a filter are compared in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from armlift.llm.components import components
from armlift.llm.tables import map_batches
from armlift.llm.tiles import block_pairs, in_runs, runs
from armlift.session import stored

# 16 codes, 4 filters passed of each on average: with 256 directions a part a random pair at
# cosine 0.93 shares 25 filters in the median and none with probability below 1 in 4,000; at 0.95
# and above none of 4,000 pairs was missed; an unrelated pair shares one with probability 0.004
CODES = 16
PASSED = 4
# directions of a part: filters grow with the rows so that unrelated rows stay apart; the upper
# end bounds the work of decoding
FEWEST, MOST = 256, 2048
ROWS_FACTOR = 16
# shorter vectors have one part
SPLIT_LENGTH = 8
BLOCK_ROWS = 1000
# products of vectors and directions held at a time
DECODED = 64_000


@dataclass(frozen=True)
class Code:
    """Filters of vectors of one length."""

    parts: list[list[np.ndarray]]
    threshold: float
    directions: int

    @classmethod
    def of(cls, length: int, least_cosine: float = 0.93, directions: int = FEWEST, seed: int = 12) -> Code:
        rng, parts = np.random.default_rng([seed, length]), []
        for _ in range(CODES):
            rotation = np.linalg.qr(rng.standard_normal((length, length)))[0]
            cuts = np.array_split(rotation, 2) if length >= SPLIT_LENGTH else [rotation]
            lists = []
            for cut in cuts:
                some = rng.standard_normal((directions, len(cut)))
                some /= np.linalg.norm(some, axis=1)[:, None] * np.sqrt(len(cuts))
                lists.append(some @ cut)
            parts.append(lists)
        # the threshold that random vectors reach PASSED times on average; in few dimensions a cap
        # must be wide enough for two vectors at the least cosine
        trial = rng.standard_normal((16, length))
        trial /= np.linalg.norm(trial, axis=1)[:, None]
        products = [trial @ p.T for p in parts[0]]
        sums = products[0] if len(products) == 1 else products[0][:, :, None] + products[1][:, None, :]
        reached = float(np.partition(sums.ravel(), -16 * PASSED)[-16 * PASSED])
        return cls(parts, min(reached, least_cosine), directions)

    def passed(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of all filters that unit vectors pass, the best of each code always among them."""
        rows, filters = [], []
        step = max(1, DECODED // self.directions)
        for start in range(0, len(units), step):
            some = units[start : start + step]
            for number, lists in enumerate(self.parts):
                first = some @ lists[0].T
                second = some @ lists[1].T if len(lists) > 1 else np.zeros((len(some), 1))
                reach = first.max(axis=1) + second.max(axis=1)
                limit = np.minimum(self.threshold, reach - 1e-9)
                # directions of the first part that some direction of the second can complete
                row, a = np.nonzero(first >= (limit - second.max(axis=1))[:, None])
                at, b = np.nonzero(second[row] >= (limit[row] - first[row, a])[:, None])
                rows.append(start + row[at])
                filters.append((number * self.directions + a[at]) * second.shape[1] + b)
        return np.concatenate(rows), np.concatenate(filters)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, v): rows with a label and a finite vector that is not zero."""
    finite = "forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    rows = vectors.selectExpr("cast(vec_id as bigint) as vec_id", "label", "cast(embedding as array<double>) as v")
    return rows.where(f"label is not null and v is not null and {finite} and exists(v, x -> x != 0)")


def unit_rows(column: pa.Array) -> np.ndarray:
    """Vectors of one length, scaled to length 1; by the largest component first, so squares stay finite."""
    rows = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    rows = rows / np.abs(rows).max(axis=1)[:, None]
    return rows / np.linalg.norm(rows, axis=1)[:, None]


def with_filters(classes: DataFrame, least_cosine: float) -> DataFrame:
    """(class, label, filter) of all filters that the vectors pass; filters of two lengths are never equal."""
    lengths = classes.groupBy(F.expr("size(v)").alias("length")).agg(F.count(F.lit(1)).alias("n")).collect()
    codes = {
        length: Code.of(length, least_cosine, min(MOST, max(FEWEST, 2 ** math.ceil(math.log2(ROWS_FACTOR * n) / 2))))
        for length, n in lengths
    }

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("v").value_lengths().to_numpy()
            for length in np.unique(sizes).tolist():
                mine = np.flatnonzero(sizes == length)
                some = batch.take(pa.array(mine))
                rows, filters = codes[length].passed(unit_rows(some.column("v")))
                named = some.column("class").take(pa.array(rows))
                number = pa.array(filters.astype(np.int64) + (length << 32))
                yield pa.RecordBatch.from_arrays([named, some.column("label").take(pa.array(rows)), number], ["class", "label", "filter"])

    kind = classes.schema["label"].dataType.simpleString()
    return map_batches(classes.select("class", "label", "v"), decoded, f"class bigint, label {kind}, filter bigint")


def shares_earlier(filters: list[np.ndarray], current: int, side: np.ndarray) -> np.ndarray:
    """Whether two rows of a run, one of each side, both have a filter below the current one."""
    counts = [len(f) for f in filters]
    row, flat = np.repeat(np.arange(len(filters)), counts), np.concatenate(filters)
    row, flat = row[flat < current], flat[flat < current]
    kinds, place, often = np.unique(flat, return_inverse=True, return_counts=True)
    common = often > 1
    number = np.cumsum(common) - 1
    has = np.zeros((len(filters), int(common.sum())), np.float32)
    has[row[common[place]], number[place[common[place]]]] = 1
    left = has[side == 0]
    return left @ (has[side == 1] if side.any() else left).T > 0


def rooted(linked: np.ndarray) -> np.ndarray:
    """Smallest row of the component of each row, for a symmetric matrix of links."""
    labels = np.arange(len(linked))
    while True:
        least = np.minimum(labels, np.where(linked, labels[None, :], len(labels)).min(axis=1))
        if (least == labels).all():
            return labels
        labels = least


def linked_in_runs(members: DataFrame, classes: DataFrame, least_cosine: float, partitions: int) -> DataFrame:
    """(class, links, root) for each run: vectors newly linked to those of the class, and a class of its component.

    A pair counts in the first filter that it shares, so no pair of vectors leaves a task.
    """

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches):
            side = run["_side"].to_numpy()
            if len(run) < 2:
                continue
            units = unit_rows(run["v"].combine_chunks())
            inside = not side.any()
            left = np.flatnonzero(side == 0)
            right = left if inside else np.flatnonzero(side == 1)
            near = units[left] @ units[right].T >= least_cosine
            if inside:
                np.fill_diagonal(near, False)
            if not near.any():
                continue
            lists = run["filters"].combine_chunks()
            edges = lists.offsets.to_numpy()
            flat = lists.values.to_numpy()
            filters = [flat[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
            near &= ~shares_earlier(filters, run["filter"][0].as_py(), side)
            whole = np.zeros((len(run), len(run)), bool)
            whole[np.ix_(left, right)] = near
            whole |= whole.T
            found = np.flatnonzero(whole.any(axis=1))
            if not len(found):
                continue
            names = run["class"].to_numpy()
            links = whole.astype(np.int64) @ run["copies"].to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array(names[found]), pa.array(links[found]), pa.array(names[rooted(whole)[found]])], ["class", "links", "root"]
            )

    lists = members.groupBy("class").agg(F.expr("sort_array(collect_set(filter)) as filters"))
    shown = members.join(classes.select("class", "copies", "v"), "class").join(lists, "class")
    return map_batches(in_runs(shown, partitions), compared, "class bigint, links bigint, root bigint")


def near_vectors(vectors: DataFrame, least_cosine: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding, label).

    Two rows link when their labels are equal and their cosine reaches ``least_cosine``.
    Rows with a null label, or a vector that is null, empty, zero or holds null or non-finite
    components link with nothing; so do vectors of different length. Rows that repeat,
    in vec_id or in vector, are vectors of their own and link. A null vec_id is never the
    smallest one; a component of nothing else has a null component_id and is kept. An empty
    table gives no rows. Further columns are not read.

    Equal vectors are one class with a count. A filter that very many classes pass is compared
    block by block; only counts and one link per class and run leave a task.
    """
    known = usable(vectors)
    classes = stored(
        known.groupBy("label", "v")
        .agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("first_id"))
        .withColumn("class", F.monotonically_increasing_id())
    )
    passed = stored(with_filters(classes, least_cosine))
    paired, partitions = block_pairs(passed, ["label", "filter"], ["class"], BLOCK_ROWS)
    found = stored(linked_in_runs(paired, classes, least_cosine, partitions))
    groups = components(found.selectExpr("class as a", "root as b"))
    counted = found.groupBy("class").agg(F.sum("links").alias("links"))
    placed = (
        classes.drop("v")
        .join(counted, "class", "left")
        .join(groups.withColumnRenamed("node", "class"), "class", "left")
        .selectExpr("class", "first_id", "copies - 1 + coalesce(links, 0L) as n_links", "coalesce(component, class) as group_no")
    )
    smallest = placed.groupBy("group_no").agg(F.min("first_id").alias("component_id"))
    results = placed.join(smallest, "group_no").join(classes.select("class", "label", "v"), "class")
    linked = known.join(results, ["label", "v"]).select("vec_id", "n_links", "component_id")
    valid = "cast(embedding as array<double>) as v"
    alone = vectors.selectExpr("cast(vec_id as bigint) as vec_id", "label", valid).where(
        "not coalesce(label is not null and v is not null and "
        "forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x != 0), false)"
    ).selectExpr("vec_id", "0L as n_links", "vec_id as component_id")
    return linked.unionByName(alone).selectExpr("*", "vec_id <=> component_id as kept")


def op12_link_near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Links and components of all vectors of one label with a cosine of 0.93 or more."""
    return near_vectors(spark.read.parquet(f"{folder}/embeddings.parquet"))
