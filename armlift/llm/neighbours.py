"""Nearest vectors by inner product through a hierarchical k-means tree.

Inner product becomes Euclidean nearness when every vector gets one more component that
lifts it to the largest norm. The tree is fitted on a bounded sample and sent with the job;
every row is filed under the leaf it descends to. A query walks the tree best bin first: a
priority queue holds the nodes seen so far by distance of their centre, and the leaves it
yields are searched exactly. How many leaves that takes is calibrated: queries of a sample
are answered exactly against all rows, and leaves are added until the recall is reached.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from armlift.session import stored

# bounds of what is fitted, sent with the job or held by a task
SAMPLE_ROWS = 20_000
CALIBRATION_QUERIES = 200
MAX_LEAVES = 1024
LEAF_ROWS = 256
BRANCHES = 16
BLOCK_ROWS = 20_000
BLOCK_QUERIES = 4_000
TARGET_RECALL = 0.98
PAIR_SCHEMA = "query_id bigint, vec_id bigint, score double"


@dataclass
class Tree:
    """Nodes by number: centres and numbers of the children, or the number of the leaf."""

    lift: float
    centres: list[np.ndarray] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    leaf: list[int] = field(default_factory=list)
    n_leaves: int = 0

    def grow(self, points: np.ndarray, leaf_rows: int, rng: np.random.Generator) -> int:
        """Add the node of these sample points and all below it; returns its number."""
        number = len(self.leaf)
        self.centres.append(np.empty((0, points.shape[1])))
        self.children.append([])
        self.leaf.append(-1)
        kinds = np.unique(points, axis=0) if len(points) <= leaf_rows * BRANCHES else points
        if len(points) > leaf_rows and len(kinds) > 1:
            centres = split(points, rng)
            nearest = distances(points, centres).argmin(axis=1)
            used = np.unique(nearest)
            if len(used) > 1:
                self.centres[number] = centres[used]
                self.children[number] = [self.grow(points[nearest == k], leaf_rows, rng) for k in used]
                return number
        self.leaf[number] = self.n_leaves
        self.n_leaves += 1
        return number

    def lifted(self, vectors: np.ndarray) -> np.ndarray:
        rest = np.maximum(self.lift**2 - (vectors**2).sum(axis=1), 0)
        return np.column_stack([vectors, np.sqrt(rest)])

    def leaves_of(self, vectors: np.ndarray) -> np.ndarray:
        """Leaf of each vector, by descent to the nearest child."""
        points, found = self.lifted(vectors), np.zeros(len(vectors), np.int32)
        waiting = [(0, np.arange(len(vectors)))]
        while waiting:
            node, rows = waiting.pop()
            if self.leaf[node] >= 0:
                found[rows] = self.leaf[node]
                continue
            nearest = distances(points[rows], self.centres[node]).argmin(axis=1)
            waiting += [(child, rows[nearest == k]) for k, child in enumerate(self.children[node]) if (nearest == k).any()]
        return found

    def best_bins(self, query: np.ndarray, visits: int) -> list[int]:
        """The first leaves of a best-bin-first walk."""
        point, found, heap = np.append(query, 0.0)[None], [], [(0.0, 0)]
        while heap and len(found) < visits:
            _, node = heapq.heappop(heap)
            if self.leaf[node] >= 0:
                found.append(self.leaf[node])
            else:
                for distance, child in zip(distances(point, self.centres[node])[0].tolist(), self.children[node]):
                    heapq.heappush(heap, (distance, child))
        return found


def distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances but for the norm of the point, which is the same for all centres."""
    return (centres**2).sum(axis=1) - 2 * points @ centres.T


def split(points: np.ndarray, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Centres of k-means with up to BRANCHES clusters."""
    chosen = np.unique(points[rng.choice(len(points), min(len(points), 4 * BRANCHES), replace=False)], axis=0)
    if len(chosen) == 1:
        chosen = np.vstack([chosen, points[(points != chosen[0]).any(axis=1)][:1]])
    centres = rng.permutation(chosen)[:BRANCHES]
    for _ in range(rounds):
        nearest = distances(points, centres).argmin(axis=1)
        counts = np.bincount(nearest, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, points)
        moved = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
        if np.allclose(moved, centres):
            break
        centres = moved
    return centres


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 1))


def nearest_rows(
    query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int
) -> pd.DataFrame:
    """Up to k nearest rows per query, its own row left out, ties to the smaller id.

    Products of a block name the candidates; their scores are summed again row by row, so
    equal vectors get equal scores wherever they lie in a block.
    """
    found = []
    for start in range(0, len(query_ids), 128):
        block = queries[start : start + 128]
        rough = block @ vectors.T
        for i, query in enumerate(block):
            own = ids == query_ids[start + i]
            line = np.where(own, -np.inf, rough[i])
            slack = 1e-9 * (1 + np.abs(rough[i]).max())
            edge = np.partition(line, -k)[-k] if len(line) > k else -np.inf
            near = np.flatnonzero((line >= edge - slack) & ~own)
            scores = (vectors[near] * query).sum(axis=1)
            best = np.lexsort([ids[near], -scores])[:k]
            found.append((np.full(len(best), query_ids[start + i]), ids[near][best], scores[best]))
    parts = [np.concatenate(x) for x in zip(*found)] if found else [np.empty(0, np.int64)] * 2 + [np.empty(0)]
    return pd.DataFrame({"query_id": parts[0], "vec_id": parts[1], "score": parts[2]})


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v): one row per vec_id with a finite, non-zero vector of the commonest length.

    Rows that share a vec_id count once, by the smallest vector.
    """
    finite = "forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    rows = embeddings.selectExpr("cast(vec_id as bigint) as vec_id", "cast(embedding as array<double>) as v").where(
        f"vec_id is not null and v is not null and {finite} and exists(v, x -> x != 0)"
    )
    once = stored(rows.groupBy("vec_id").agg(F.min("v").alias("v")))
    lengths = once.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return once.where(F.size("v") == (lengths["n"] if lengths else 0))


def fit_tree(vectors: DataFrame, sample_rows: int = SAMPLE_ROWS, seed: int = 1) -> Tree:
    """Tree of at most ``sample_rows`` vectors, chosen by hash of their id."""
    facts = vectors.agg(
        F.count(F.lit(1)).alias("n"), F.max(F.expr("aggregate(v, 0D, (s, x) -> s + x * x)")).alias("square")
    ).first()
    sample = vectors.orderBy(F.expr(f"xxhash64(vec_id, {seed}L)"), "vec_id").limit(sample_rows).toArrow()
    tree = Tree(float(np.sqrt(facts["square"] or 0.0)))
    points = tree.lifted(matrix(sample["v"].combine_chunks()))
    leaves = min(MAX_LEAVES, max(1, facts["n"] // LEAF_ROWS))
    tree.grow(points, max(8, len(points) // leaves), np.random.default_rng(seed))
    return tree


def with_leaf(vectors: DataFrame, tree: Tree) -> DataFrame:
    """Add the leaf of every row."""

    def filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves = pa.array(tree.leaves_of(matrix(batch.column("v"))), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, leaves], ["vec_id", "v", "leaf"])

    return vectors.select("vec_id", "v").mapInArrow(filed, "vec_id bigint, v array<double>, leaf int")


def exact_neighbours(vectors: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
    """(query_id, vec_id, leaf): the k nearest of all rows for a bounded set of queries sent with the job."""

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("vec_id").to_numpy()
            found = nearest_rows(ids, queries, rows, matrix(batch.column("v")), k)
            leaf = pd.Series(batch.column("leaf").to_numpy(), rows)
            found["leaf"] = leaf.loc[found["vec_id"]].to_numpy()
            yield pa.RecordBatch.from_pandas(found, preserve_index=False)

    found = vectors.mapInArrow(searched, f"{PAIR_SCHEMA}, leaf int")
    return top(found, k, "leaf")


def top(pairs: DataFrame, k: int, *more: str) -> DataFrame:
    """Nearest k per query with their rank."""
    rank = "row_number() over (partition by query_id order by score desc, vec_id)"
    return pairs.selectExpr("*", f"{rank} as rank").where(f"rank <= {k}").select(
        "query_id", "rank", "vec_id", "score", *more
    )


def calibrated_visits(filed: DataFrame, queries: DataFrame, tree: Tree, k: int, target: float, seed: int = 1) -> int:
    """Leaves a query must visit so that the sampled queries reach the target recall on all rows."""
    order = [F.expr(f"xxhash64(vec_id, {seed + 1}L)"), F.col("vec_id")]
    some = queries.orderBy(*order).limit(CALIBRATION_QUERIES).toArrow()
    ids, points = some["vec_id"].to_numpy(), matrix(some["v"].combine_chunks())
    if not len(ids):
        return 1
    # bounded: at most k rows per calibration query
    truth = exact_neighbours(filed, ids, points, k).toPandas()
    if truth.empty:
        return 1
    place = {i: {leaf: n for n, leaf in enumerate(tree.best_bins(q, tree.n_leaves))} for i, q in zip(ids, points)}
    needed = np.sort([place[q][leaf] for q, leaf in zip(truth["query_id"], truth["leaf"])])
    return int(needed[int(np.ceil(target * len(needed))) - 1]) + 1


def search(
    vectors: DataFrame, queries: DataFrame, k: int = 20, target_recall: float = TARGET_RECALL, seed: int = 1
) -> DataFrame:
    """(query_id, rank, vec_id, score): nearest k rows found for each query row (vec_id, v).

    Both tables are as ``usable`` returns them. A leaf with many rows or many queries is
    dealt in blocks of bounded size, so neither a common vector nor a popular leaf meets in
    one task. No vectors give an empty result; fewer than k candidates give all of them.
    """
    tree = fit_tree(vectors, seed=seed)
    filed = stored(with_leaf(vectors, tree))
    visits = calibrated_visits(filed, queries, tree, k, target_recall, seed)

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves = [tree.best_bins(q, visits) for q in matrix(batch.column("v"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("v"), pa.array(leaves, pa.list_(pa.int32()))], ["query_id", "q", "leaves"]
            )

    asked = stored(queries.select("vec_id", "v").mapInArrow(walked, "query_id bigint, q array<double>, leaves array<int>"))
    visit_rows = asked.select("query_id", "q", F.explode("leaves").alias("leaf"))
    # two small tables of one row per leaf, at most MAX_LEAVES
    sizes = filed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n_rows")).join(
        visit_rows.groupBy("leaf").agg(F.count(F.lit(1)).alias("n_queries")), "leaf"
    ).selectExpr(
        "leaf",
        f"cast(ceil(n_rows / {BLOCK_ROWS}) as int) as row_blocks",
        f"cast(ceil(n_queries / {BLOCK_QUERIES}) as int) as query_blocks",
    )
    sizes = F.broadcast(stored(sizes).coalesce(1))
    rows = filed.join(sizes, "leaf").selectExpr(
        "leaf", "vec_id", "v", "cast(pmod(xxhash64(vec_id), row_blocks) as int) as row_block",
        "explode(sequence(0, query_blocks - 1)) as query_block",
    )
    wishes = visit_rows.join(sizes, "leaf").selectExpr(
        "leaf", "query_id", "q", "explode(sequence(0, row_blocks - 1)) as row_block",
        "cast(pmod(xxhash64(query_id), query_blocks) as int) as query_block",
    )
    block = ["leaf", "row_block", "query_block"]

    def matched(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0)})
        return nearest_rows(
            right["query_id"].to_numpy(), np.vstack(right["q"]), left["vec_id"].to_numpy(), np.vstack(left["v"]), k
        )

    pairs = rows.groupBy(*block).cogroup(wishes.groupBy(*block)).applyInPandas(matched, PAIR_SCHEMA)
    return top(pairs, k)


def op6_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest rows of every row whose vec_id is divisible by 20."""
    vectors = usable(spark.read.parquet(f"{folder}/embeddings.parquet"))
    return search(vectors, vectors.where("vec_id % 20 = 0"))
