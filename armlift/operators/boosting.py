"""Boosted trees of several models at once, grown best first from histograms of binned features.

The training rows are binned once and dealt to tasks as blocks of small integers. One job per
round sums, for all models together, the gradients per (model, tree, node, feature, bin) of
the nodes that need it; of two children only the smaller one is summed, the other is the
difference to their parent. A few trees of a model grow side by side from the same gradients,
each on its own sample of rows and features, which divides the number of jobs. Only these sums reach the driver, which picks the splits. Row and
feature samples depend on the unit and the tree, and sums are sums of whole numbers, so the
fitted trees do not depend on how the rows are dealt.

A task goes through its blocks one by one and sends on one set of sums, so what is sent grows
with the tasks and not with the rows. A row is added once per column: gradient, hessian and row
are one complex number, features of few bins share a column, and the roots of trees of the same
gradients are summed together by the trees that drew the row.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, SparkSession

from armlift.functions.numeric import name
from armlift.session import release, stored

# gradients are whole multiples of this step; their sums are exact up to 2^29 rows
GRADIENT_STEP = 2.0**-24
LEAST_HESSIAN = 1e-3
LEAST_GAIN = 1e-9
# what the steps of trees grown from the same gradients may add up to; more overshoots
MOST_STEP = 0.25
# trees after which the rows are stored with their margins, which bounds the lineage
RENEWED = 50
# rows that are walked through a tree at a time; their codes stay in the cache of a core
WALKED_ROWS = 8192
# leaves of a tree that fit the bits of a number, and the multiplier that turns a single bit into its place
MOST_BITS = 64
BIT_FACTOR = 0x03F79D71B4CB0A89
# partitions whose sums are added on the driver; more are added by tasks first
ADDED_AT_ONCE = 16
# rows of a block, rows of it that are walked at a time, and rows that are summed before the sums are taken apart
BLOCK_ROWS = 480_000
PART_ROWS = 120_000
SUMMED_ROWS = 30_000
# what a row counts beside its hessian in one number: sums of both stay exact up to SUMMED_ROWS rows,
# as a hessian is at most 2^22 steps
ROW = 2.0**37
# weight of a row without an outcome, and the largest whole number below which single precision holds them all
UNKNOWN = -1j
SINGLE = 2**24
# bins of the features that share a column, at most, and trees whose roots are summed together
SHARED_BINS = 1024
ROOTS_TOGETHER = 4
OPEN_COST = "spark.sql.files.openCostInBytes"
FOREST_SCHEMA = "model int, tree int, node int, feature string, cut double, left int, right int, value double"


@dataclass(frozen=True)
class TreeSettings:
    """Boosting settings.

    Trees grow best first to ``leaves`` leaves; no leaf lies deeper than ``depth``, which bounds the
    jobs of a tree. Up to ``at_once`` trees share the gradients they are grown from, fewer where their
    steps would add up to over MOST_STEP. A task goes through at most ``task_rows`` training rows, block by
    block, and through fewer where cores are free, down to ``least_rows``.
    """

    n_trees: int = 400
    at_once: int = 4
    step: float = 0.05
    leaves: int = 31
    depth: int = 7
    min_leaf: int = 200
    row_share: float = 0.8
    feature_share: float = 0.8
    bins: int = 255
    task_rows: int = 4_000_000
    least_rows: int = 16_000

    @property
    def together(self) -> int:
        return max(1, min(self.at_once, int(MOST_STEP / self.step + 1e-9)))


@dataclass
class Tree:
    """Nodes by number, the root first; a leaf has feature -1 and a value. ``bin`` is the last bin that goes left."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])

    def parted(self, goes_left, n: int, ends: set[int] | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """(node, rows) of the leaves; ``ends`` names the nodes that are wanted instead."""
        wanted = self.above(ends) if ends is not None else None
        waiting = [(0, np.arange(n))]
        while waiting:
            node, rows = waiting.pop()
            if self.feature[node] < 0 if ends is None else node in ends:
                yield node, rows
            elif self.feature[node] >= 0:
                left = goes_left(self.feature[node], self.bin[node], rows)
                for child, some in ((self.left[node], rows[left]), (self.right[node], rows[~left])):
                    if wanted is None or child in wanted:
                        waiting.append((child, some))

    def above(self, ends: set[int]) -> set[int]:
        """The nodes that lie on the way to ``ends``, these included."""
        found = set(ends)
        for node in range(len(self.feature) - 1, -1, -1):
            if self.feature[node] >= 0 and (self.left[node] in found or self.right[node] in found):
                found.add(node)
        return found


class LeafValues:
    """Values of a tree by rows, found without branches.

    Every leaf is a bit, the leftmost the lowest. A split that a row passes on its right rules out the
    leaves on its left; what a feature rules out follows from the code alone, and the lowest
    bit that is left is the row's leaf.
    """

    def __init__(self, tree: Tree, sizes: list[int]) -> None:
        self.tree, leaves, below = tree, [], {}
        waiting = [(0, False)]
        while waiting:
            node, done = waiting.pop()
            if tree.feature[node] < 0:
                below[node] = 1 << len(leaves)
                leaves.append(node)
            elif done:
                below[node] = below[tree.left[node]] | below[tree.right[node]]
            else:
                waiting += [(node, True), (tree.right[node], False), (tree.left[node], False)]
        self.fits = len(leaves) <= MOST_BITS
        if not self.fits:
            return
        self.left: dict[int, np.ndarray] = {}
        for node, feature in enumerate(tree.feature):
            if feature >= 0:
                kept = self.left.setdefault(feature, np.full(sizes[feature], 2**MOST_BITS - 1, np.uint64))
                kept[tree.bin[node] + 1 :] &= np.uint64(~below[tree.left[node]] % 2**MOST_BITS)
        self.values = np.zeros(MOST_BITS)
        for i, node in enumerate(leaves):
            self.values[(BIT_FACTOR << i) % 2**64 >> 58] = tree.value[node]

    def by_column(self, columns: Columns) -> LeafValues:
        """The same, where the codes of the columns that several features share follow those of the features."""
        if self.fits:
            for place, mine in columns.shared():
                if len(used := [f for f in mine if f in self.left]) > 1:
                    kept = np.full(1, 2**MOST_BITS - 1, np.uint64)
                    for feature in mine:
                        ruled = self.left.pop(feature) if feature in used else np.full(columns.sizes[feature], 2**MOST_BITS - 1, np.uint64)
                        kept = np.bitwise_and.outer(kept, ruled).reshape(-1)
                    self.left[place] = kept
        return self

    def of(self, codes: list[np.ndarray]) -> np.ndarray:
        """The value of each row, for the codes of every feature."""
        n = len(codes[0])
        if not self.fits:
            found = np.zeros(n)
            for node, rows in self.tree.parted(lambda feature, last, rows: codes[feature][rows] <= last, n):
                found[rows] = self.tree.value[node]
            return found
        alive = None
        for feature, kept in self.left.items():
            mine = np.take(kept, codes[feature], mode="clip")
            alive = mine if alive is None else np.bitwise_and(alive, mine, out=alive)
        if alive is None:
            return np.full(n, self.tree.value[0])
        alive &= ~alive + np.uint64(1)
        alive *= np.uint64(BIT_FACTOR)
        alive >>= np.uint64(58)
        return np.take(self.values, alive.view(np.int64), mode="clip")


def add_values(margins: np.ndarray, codes: np.ndarray, walks: list[tuple[int, LeafValues]], columns: Columns) -> None:
    """Add the values of trees to the margins in place, each to its line."""
    for first in range(0, margins.shape[1], WALKED_ROWS):
        some = slice(first, first + WALKED_ROWS)
        near = [c[some].astype(np.intp) for c in codes]
        near += [columns.together(mine, near) for _, mine in columns.shared()]
        for line, walk in walks:
            margins[line, some] += walk.of(near)


@dataclass
class Block:
    """Rows of one arm: bin codes by feature, a hash of the unit, and outcome and margin by metric."""

    arm: int
    codes: np.ndarray
    units: np.ndarray
    outcomes: np.ndarray
    margins: np.ndarray

    def ready(self, numbers: Iterable[int], settings: TreeSettings, seed: int) -> Ready:
        """What the trees of these numbers are grown from."""
        weights = np.zeros(self.margins.shape, np.complex64)
        for metric, (margin, outcome) in enumerate(zip(self.margins, self.outcomes)):
            chance = np.exp(-margin)
            chance += 1
            np.divide(1, chance, out=chance)
            gradient, known = np.rint((chance - outcome) / GRADIENT_STEP), outcome >= 0
            if weights.dtype == np.complex64 and np.abs(gradient[known]).max(initial=0) > SINGLE:
                weights = weights.astype(np.complex128)
            weights[metric].real = gradient
            weights[metric].imag = np.rint(chance * (1 - chance) / GRADIENT_STEP)
            if not known.all():
                weights[metric, ~known] = UNKNOWN
        numbers = list(numbers)
        taken = np.zeros((-(-len(numbers) // 8), len(self.units)), np.uint8)
        for place, number in enumerate(numbers):
            drawn = sampled(self.units, settings.row_share, seed, number).view(np.uint8)
            taken[place // 8] |= drawn << (7 - place % 8)
        return Ready(self.arm, self.codes, taken, weights)


@dataclass
class Ready:
    """Rows of a block while some trees grow: codes, the trees that drew the row as bits, gradient and hessian by metric."""

    arm: int
    codes: np.ndarray
    taken: np.ndarray
    weights: np.ndarray

    def parts(self) -> Iterator[Ready]:
        """A few rows at a time, their weights as they are added up."""
        for first in range(0, self.codes.shape[1], PART_ROWS):
            some = slice(first, first + PART_ROWS)
            weights = self.weights[:, some].astype(np.complex128)
            unknown = weights.imag < 0
            weights.imag += ROW
            if unknown.any():
                weights[unknown] = 0
            yield Ready(self.arm, self.codes[:, some], self.taken[:, some], weights)

    def drawn(self, place: int) -> np.ndarray:
        """1 for the rows that the tree of this place drew, else 0."""
        return (self.taken[place // 8] >> (7 - place % 8)) & 1


def advanced(blocks: Iterable[Block], grown: list[list[Tree]], models: list[tuple[int, int]], columns: Columns) -> Iterator[Block]:
    """The blocks with the values of more trees in their margins."""
    walks = [(model, LeafValues(tree, columns.sizes).by_column(columns)) for trees in grown for model, tree in zip(models, trees)]
    for block in blocks:
        margins = block.margins.copy()
        add_values(margins, block.codes, [(metric, walk) for (metric, arm), walk in walks if arm == block.arm], columns)
        yield Block(block.arm, block.codes, block.units, block.outcomes, margins)


@dataclass(frozen=True)
class Plan:
    """What one round sums for one tree of every model: the wanted nodes, over the features of the tree."""

    features: np.ndarray
    trees: list[Tree]
    wanted: list[list[int]]


def sampled(units: np.ndarray, share: float, seed: int, number: int) -> np.ndarray:
    """Which units a tree draws."""
    if share >= 1:
        return np.ones(len(units), bool)
    return mixed_units(units, seed, number) < np.uint64(share * 2.0**64)


def mixed_units(units: np.ndarray, seed: int, number: int) -> np.ndarray:
    """A 64-bit hash of (unit, seed, tree)."""
    x = units ^ np.uint64(((seed + 1) * 0x9E3779B97F4A7C15 + (number + 1) * 0xD1B54A32D192ED03) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Columns:
    """Features by column: those of few bins share one, whose bins are all combinations of theirs."""

    def __init__(self, sizes: list[int]) -> None:
        self.sizes, self.features, self.spans = sizes, [], []
        for feature in sorted(range(len(sizes)), key=lambda f: sizes[f]):
            if self.spans and self.spans[-1] * sizes[feature] <= SHARED_BINS:
                self.features[-1].append(feature)
                self.spans[-1] *= sizes[feature]
            else:
                self.features.append([feature])
                self.spans.append(sizes[feature])

    def used(self, features: Iterable[int]) -> list[int]:
        """The columns of some features."""
        wanted = set(features)
        return [c for c, mine in enumerate(self.features) if wanted.intersection(mine)]

    def shared(self) -> list[tuple[int, list[int]]]:
        """Features by column of those that several share; the columns are numbered from the last feature on."""
        return list(enumerate((mine for mine in self.features if len(mine) > 1), len(self.sizes)))

    def together(self, features: list[int], codes) -> np.ndarray:
        """Bins of the column of some features by row."""
        found = codes[features[0]].copy()
        for feature in features[1:]:
            found *= self.sizes[feature]
            found += codes[feature]
        return found

    def codes(self, codes: np.ndarray) -> np.ndarray:
        """Bins by row and column."""
        found = np.empty((codes.shape[1], len(self.features)), np.min_scalar_type(max(self.spans)))
        for column, mine in enumerate(self.features):
            found[:, column] = self.together(mine, {f: codes[f].astype(found.dtype) for f in mine})
        return found


class Tally:
    """Gradients, hessians and rows by slot and bin of some columns."""

    def __init__(self, columns: Columns, used: list[int], slots: int) -> None:
        self.columns, self.slots, self.held = columns, slots, 0
        ends = np.cumsum([columns.spans[c] for c in used]).tolist()
        self.parts, self.width = {c: slice(end - columns.spans[c], end) for c, end in zip(used, ends)}, ends[-1]
        self.packed, self.sums = np.zeros(slots * self.width, np.complex128), np.zeros((3, slots * self.width))

    def add(self, codes: np.ndarray, slots: np.ndarray, weights: np.ndarray) -> None:
        """Add rows, given by their bins, to their slots."""
        for start in range(0, len(slots), SUMMED_ROWS):
            some = slice(start, start + SUMMED_ROWS)
            first = slots[some] * self.width
            if self.held + len(first) > SUMMED_ROWS:
                self.settle()
            self.held += len(first)
            for column, part in self.parts.items():
                np.add.at(self.packed[part.start :], first + codes[some, column], weights[some])

    def settle(self) -> None:
        """Take the packed sums apart before they are no longer exact."""
        rows = np.floor(self.packed.imag / ROW)
        self.sums[0] += self.packed.real
        self.sums[1] += self.packed.imag - rows * ROW
        self.sums[2] += rows
        self.packed[:], self.held = 0, 0

    def of(self, features: Iterable[int]) -> np.ndarray:
        """(gradient and hessian and rows, slot, bin of all the features)."""
        self.settle()
        sums, found = self.sums.reshape(3, self.slots, self.width), []
        for feature in features:
            column = self.columns.used([feature])[0]
            mine = self.columns.features[column]
            cells = sums[:, :, self.parts[column]].reshape(3, self.slots, *[self.columns.sizes[f] for f in mine])
            found.append(cells.sum(axis=tuple(i + 2 for i, f in enumerate(mine) if f != feature)))
        return np.concatenate(found, axis=2)


class Walk:
    """The way to the wanted nodes of a tree that grows."""

    def __init__(self, tree: Tree, wanted: list[int]) -> None:
        self.tree, self.above = tree, tree.above(set(wanted))
        self.place = {node: i for i, node in enumerate(wanted, 1)}
        self.kind = np.min_scalar_type(len(wanted))

    def places(self, codes: np.ndarray, drawn: np.ndarray) -> np.ndarray:
        """Place of the wanted node that a drawn row lies in, from 1; 0 for the other rows."""
        found, waiting = np.zeros(codes.shape[1], self.kind), [(0, drawn)]
        while waiting:
            node, inside = waiting.pop()
            if node in self.place:
                found |= np.multiply(inside, self.place[node], dtype=self.kind)
                continue
            left, right = self.tree.left[node], self.tree.right[node]
            mine, last = codes[self.tree.feature[node]], self.tree.bin[node]
            if left not in self.above:
                after = (mine > last).view(np.uint8)
                after &= inside
                waiting.append((right, after))
                continue
            upto = (mine <= last).view(np.uint8)
            upto &= inside
            waiting.append((left, upto))
            if right in self.above:
                waiting.append((right, inside ^ upto))
        return found


def root_sums(blocks: Iterable[Ready], plans: list[Plan], models: list[tuple[int, int]], columns: Columns) -> Iterator[tuple[int, np.ndarray]]:
    """((tree, model), sums of the root by gradient and hessian and rows, node, bin) over the blocks of a task.

    A row is added once for several trees, to the slot of those that drew it.
    """
    groups = [range(first, min(first + ROOTS_TOGETHER, len(plans))) for first in range(0, len(plans), ROOTS_TOGETHER)]
    used = [columns.used(f for place in group for f in plans[place].features.tolist()) for group in groups]
    tallies: dict[tuple[int, int], Tally] = {}
    for part in (part for block in blocks for part in block.parts()):
        codes = columns.codes(part.codes)
        for i, group in enumerate(groups):
            slots = np.zeros(part.codes.shape[1], np.intp)
            for bit, place in enumerate(group):
                slots += part.drawn(place) << bit
            for model, (metric, arm) in enumerate(models):
                if arm == part.arm:
                    if (i, model) not in tallies:
                        tallies[i, model] = Tally(columns, used[i], 2 ** len(group))
                    tallies[i, model].add(codes, slots, part.weights[metric])
    for (i, model), tally in tallies.items():
        for bit, place in enumerate(groups[i]):
            drew = [slot for slot in range(tally.slots) if slot >> bit & 1]
            yield place * len(models) + model, tally.of(plans[place].features.tolist())[:, drew].sum(axis=1, keepdims=True)


def node_sums(blocks: Iterable[Ready], plans: list[Plan], models: list[tuple[int, int]], columns: Columns) -> Iterator[tuple[int, np.ndarray]]:
    """((tree, model), sums of the wanted nodes by gradient and hessian and rows, node, bin) over the blocks of a task."""
    walks = {(p, m): Walk(plan.trees[m], wanted) for p, plan in enumerate(plans) for m, wanted in enumerate(plan.wanted) if wanted}
    used = [columns.used(plan.features.tolist()) for plan in plans]
    tallies: dict[tuple[int, int], Tally] = {}
    for part in (part for block in blocks for part in block.parts()):
        codes = columns.codes(part.codes)
        for p, m in walks:
            if models[m][1] != part.arm:
                continue
            places = walks[p, m].places(part.codes, part.drawn(p))
            rows = np.flatnonzero(places != 0)
            if not len(rows):
                continue
            if (p, m) not in tallies:
                tallies[p, m] = Tally(columns, used[p], len(plans[p].wanted[m]))
            slots = np.take(places, rows).astype(np.intp)
            slots -= 1
            tallies[p, m].add(np.take(codes, rows, axis=0), slots, np.take(part.weights[models[m][0]], rows))
    for (p, m), tally in tallies.items():
        yield p * len(models) + m, tally.of(plans[p].features.tolist())


class Growth:
    """One tree while it grows: sums and best split of every node made so far."""

    def __init__(self, settings: TreeSettings, features: np.ndarray, sizes: np.ndarray) -> None:
        self.settings, self.features = settings, features
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        self.tree, self.cells, self.totals, self.splits = Tree(), {}, {}, {}
        self.depth = {0: 0}
        self.pending: dict[int, int] = {}  # smaller child that is not summed yet -> its parent

    def wanted(self) -> list[int]:
        """Nodes to sum next: the root, then the smaller children of the nodes that best-first growth splits."""
        if not self.totals:
            return [0]
        for node in self.chosen():
            if self.tree.feature[node] < 0:
                self.part(node)
        return list(self.pending)

    def part(self, node: int) -> None:
        """Give a node its children, whose totals are known from the split."""
        _, feature, last, left = self.splits[node]
        tree, first = self.tree, len(self.tree.feature)
        tree.feature[node], tree.bin[node], tree.left[node], tree.right[node] = feature, last, first, first + 1
        for line, empty in ((tree.feature, -1), (tree.bin, 0), (tree.left, -1), (tree.right, -1), (tree.value, 0.0)):
            line += [empty, empty]
        self.totals[first], self.totals[first + 1] = left, self.totals[node] - left
        self.depth[first] = self.depth[first + 1] = self.depth[node] + 1
        large = max(self.totals[c][2] for c in (first, first + 1)) >= 2 * self.settings.min_leaf
        if large and self.depth[first] < self.settings.depth:
            self.pending[min((first, first + 1), key=lambda c: (self.totals[c][2], c))] = node

    def take(self, nodes: list[int], cells: np.ndarray) -> None:
        """Receive the sums of the wanted nodes; their siblings follow by difference."""
        fresh = []
        for node, mine in zip(nodes, cells):
            self.cells[node] = mine
            fresh.append(node)
            if node:
                parent = self.pending.pop(node)
                other = self.tree.left[parent] + self.tree.right[parent] - node
                self.cells[other] = self.cells.pop(parent) - mine
                fresh.append(other)
            else:
                self.totals[0] = mine[: self.starts[1]].sum(axis=0)
        self.splits |= zip(fresh, self.best_splits(fresh))

    def best_splits(self, nodes: list[int]) -> list[tuple | None]:
        """(gain, feature, last bin that goes left, totals of the left side) of each node; ties to the first feature and bin."""
        least, totals = self.settings.min_leaf, np.stack([self.totals[n] for n in nodes])
        running = np.cumsum(np.stack([self.cells[n] for n in nodes]), axis=1)
        before = np.concatenate([np.zeros((len(nodes), 1, 3)), running], axis=1)[:, self.starts[:-1]]
        left = running - np.repeat(before, np.diff(self.starts), axis=1)
        right = totals[:, None, :] - left
        gl, hl, gr, hr = (x[:, :, i] * GRADIENT_STEP for x in (left, right) for i in (0, 1))
        ok = (left[:, :, 2] >= least) & (right[:, :, 2] >= least) & (hl >= LEAST_HESSIAN) & (hr >= LEAST_HESSIAN)
        gain = np.full(ok.shape, -np.inf)
        gain[ok] = gl[ok] * gl[ok] / hl[ok] + gr[ok] * gr[ok] / hr[ok]
        found: list[tuple | None] = []
        for i, at in enumerate(gain.argmax(axis=1).tolist()):
            g, h = totals[i, 0] * GRADIENT_STEP, totals[i, 1] * GRADIENT_STEP
            if not ok[i, at] or gain[i, at] - g * g / h <= LEAST_GAIN:
                found.append(None)
                continue
            which = int(np.searchsorted(self.starts, at, side="right")) - 1
            found.append((float(gain[i, at] - g * g / h), int(self.features[which]), at - int(self.starts[which]), left[i, at]))
        return found

    def chosen(self) -> list[int]:
        """Nodes that best-first growth splits, as far as their gains are known."""
        heap, found = [(0.0, 0)] if self.splits[0] else [], []
        while heap and len(found) < self.settings.leaves - 1:
            _, node = heapq.heappop(heap)
            found.append(node)
            for child in (self.tree.left[node], self.tree.right[node]):
                if child >= 0 and self.splits.get(child):
                    heapq.heappush(heap, (-self.splits[child][0], child))
        return found

    def finished(self) -> Tree:
        """The grown tree: chosen splits only, leaves with their values."""
        chosen, tree, numbers = set(self.chosen()), Tree(), {0: 0}
        waiting = [0]
        while waiting:
            node = waiting.pop(0)
            at = numbers[node]
            if node in chosen:
                first = len(tree.feature)
                tree.feature[at], tree.bin[at] = self.tree.feature[node], self.tree.bin[node]
                tree.left[at], tree.right[at] = first, first + 1
                for line, empty in ((tree.feature, -1), (tree.bin, 0), (tree.left, -1), (tree.right, -1), (tree.value, 0.0)):
                    line += [empty, empty]
                numbers |= {self.tree.left[node]: first, self.tree.right[node]: first + 1}
                waiting += [self.tree.left[node], self.tree.right[node]]
            elif node in self.totals and self.totals[node][1] > 0:
                g, h, _ = self.totals[node]
                tree.value[at] = float(-g / h) * self.settings.step
        return tree


def binned_blocks(
    train: DataFrame, features: tuple[str, ...], arm: str, metrics: tuple[str, ...], unit_id: str,
    edges: dict[str, list[float]], settings: TreeSettings,
) -> tuple[RDD, int]:
    """Stored blocks of binned rows and the number of their partitions.

    Values up to an edge lie in its bin; null and NaN lie in the first bin. Rows without an
    arm are left out, a null outcome is left out of its metric.
    """
    cuts = [np.array(edges[f]) for f in features]
    values = [f"coalesce(cast({name(f)} as double), double('nan')) as f{i}" for i, f in enumerate(features)]
    outcomes = [f"coalesce(cast({name(m)} as double), -1D) as y{i}" for i, m in enumerate(metrics)]
    rows = train.where(f"{name(arm)} in (0, 1)").selectExpr(
        f"cast({name(arm)} as int) as arm", f"xxhash64({name(unit_id)}) as unit", *values, *outcomes
    )
    n_rows = rows.count()
    cores = train.sparkSession.sparkContext.defaultParallelism
    partitions = max(1, -(-n_rows // settings.task_rows), min(cores, n_rows // settings.least_rows))
    if partitions > cores:
        # every wave of tasks is full
        partitions = -(-partitions // cores) * cores
    kind = np.min_scalar_type(max((len(cut) for cut in cuts), default=0))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in in_large_batches(batches, BLOCK_ROWS):
            arms = held["arm"].to_numpy()
            for arm in (0, 1):
                mine = pa.array(np.flatnonzero(arms == arm))
                part = held.take(mine)
                codes = []
                for i, cut in enumerate(cuts):
                    x = part[f"f{i}"].to_numpy()
                    codes.append(np.where(np.isnan(x), 0, np.searchsorted(cut, x)).astype(kind))
                ys = [part[f"y{i}"].to_numpy() for i in range(len(metrics))]
                cells = [np.concatenate(codes).tobytes(), part["unit"].to_numpy().tobytes(), np.concatenate(ys).tobytes()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([arm], pa.int32()), *[pa.array([c], pa.binary()) for c in cells]], ["arm", "codes", "units", "outcomes"]
                )

    dealt = rows.repartition(partitions, "unit")
    blocks = stored(dealt.mapInArrow(packed_or_nothing(packed), "arm int, codes binary, units binary, outcomes binary"))

    def unpacked(row) -> Block:
        units = np.frombuffer(row.units, np.uint64)
        shape = (len(metrics), len(units))
        outcomes = narrow(np.frombuffer(row.outcomes).reshape(shape))
        return Block(row.arm, np.frombuffer(row.codes, kind).reshape(len(features), -1), units, outcomes, np.zeros(shape))

    return by_file(blocks).map(unpacked), partitions


def narrow(outcomes: np.ndarray) -> np.ndarray:
    """Outcomes in one byte each where these hold them."""
    with np.errstate(invalid="ignore"):
        small = outcomes.astype(np.int8)
    return small if np.array_equal(small, outcomes) else outcomes


def by_file(table: DataFrame) -> RDD:
    """The rows of a stored table in one partition per file, so that tasks stay as even as they were written."""
    conf = table.sparkSession.conf
    before = conf.get(OPEN_COST)
    conf.set(OPEN_COST, conf.get("spark.sql.files.maxPartitionBytes"))
    try:
        rdd = table.rdd
        rdd.getNumPartitions()
        return rdd
    finally:
        conf.set(OPEN_COST, before)


def stored_blocks(blocks: RDD, spark: SparkSession, n_features: int, n_metrics: int) -> tuple[RDD, DataFrame]:
    """The blocks written to the shared folder with their margins, and the table that holds them."""

    def packed(block: Block) -> tuple:
        arrays = (block.codes, block.units, block.outcomes, block.margins)
        kinds = f"{block.codes.dtype.str} {block.outcomes.dtype.str}"
        return (int(block.arm), kinds, *[bytearray(np.ascontiguousarray(a).tobytes()) for a in arrays])

    def unpacked(row) -> Block:
        units, (codes, outcomes) = np.frombuffer(row.units, np.uint64), row.kinds.split()
        shape = (n_metrics, len(units))
        return Block(
            row.arm, np.frombuffer(row.codes, codes).reshape(n_features, len(units)), units,
            np.frombuffer(row.outcomes, outcomes).reshape(shape), np.frombuffer(row.margins).reshape(shape),
        )

    schema = "arm int, kinds string, codes binary, units binary, outcomes binary, margins binary"
    table = stored(spark.createDataFrame(blocks.map(packed), schema))
    return by_file(table).map(unpacked), table


def in_large_batches(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches put together to about this many rows."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.concat_batches(held)
            held, n = [], 0
    if n:
        yield pa.concat_batches(held)


def packed_or_nothing(function):
    """A task without rows packs nothing."""

    def guarded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is not None:
            yield from function(iter([first, *batches]))

    return guarded


@dataclass(frozen=True)
class Forest:
    """Boosted trees by round and model; a model is a (metric, arm) pair by number."""

    features: tuple[str, ...]
    edges: dict[str, list[float]]
    models: list[tuple[int, int]]
    start: list[float]
    rounds: list[list[Tree]]

    def table(self, spark: SparkSession) -> DataFrame:
        """(model, tree, node, feature, cut, left, right, value): one row per node; tree -1 holds the start margin."""
        rows = [(m, -1, 0, None, None, None, None, s) for m, s in enumerate(self.start)]
        for number, trees in enumerate(self.rounds):
            for m, tree in enumerate(trees):
                for node, f in enumerate(tree.feature):
                    if f < 0:
                        rows.append((m, number, node, None, None, None, None, tree.value[node]))
                    else:
                        cut = self.edges[self.features[f]][tree.bin[node]]
                        rows.append((m, number, node, self.features[f], cut, tree.left[node], tree.right[node], None))
        return spark.createDataFrame(rows, FOREST_SCHEMA)

    def columns(self) -> Columns:
        return Columns([len(self.edges[f]) + 1 for f in self.features])

    def walks(self) -> list[tuple[int, LeafValues]]:
        """Every tree by its model, as rows are walked through it."""
        columns = self.columns()
        return [(m, LeafValues(tree, columns.sizes).by_column(columns)) for trees in self.rounds for m, tree in enumerate(trees)]

    def margins(self, columns: list[np.ndarray], walks: list[tuple[int, LeafValues]] | None = None) -> np.ndarray:
        """Margin of each model for rows given by feature; missing values go left."""
        cuts = [np.array(self.edges[f]) for f in self.features]
        codes = [np.where(np.isnan(x), 0, np.searchsorted(cut, x)) for cut, x in zip(cuts, columns)]
        found = np.repeat(np.array(self.start)[:, None], len(columns[0]), axis=1)
        add_values(found, codes, self.walks() if walks is None else walks, self.columns())
        return found


def fit_forest(
    train: DataFrame,
    features: tuple[str, ...],
    arm: str,
    metrics: tuple[str, ...],
    unit_id: str,
    edges: dict[str, list[float]],
    settings: TreeSettings,
    seed: int,
) -> Forest:
    """Fit a logistic boosting for every metric in every arm, round by round and all of them together.

    Every model starts at the log odds of its arm. A model without rows, or with a constant
    outcome, starts at the nearest odds its rows allow and grows no tree.
    """
    models = [(m, a) for m in range(len(metrics)) for a in (0, 1)]
    base, partitions = binned_blocks(train, features, arm, metrics, unit_id, edges, settings)

    def tallies(block: Block) -> np.ndarray:
        found = np.zeros((len(models), 2))
        for i, (metric, of_arm) in enumerate(models):
            if of_arm == block.arm:
                known = block.outcomes[metric][block.outcomes[metric] >= 0]
                found[i] = len(known), known.sum()
        return found

    counts = base.map(tallies).fold(np.zeros((len(models), 2)), lambda a, b: a + b)
    shares = [(y + 0.5) / (n + 1) if not 0 < y < n else y / n for n, y in counts.tolist()]
    start = [float(np.log(p / (1 - p))) for p in shares]
    sizes = np.array([len(edges[f]) + 1 for f in features])

    def started(block: Block) -> Block:
        margins = np.array([[start[models.index((m, block.arm))]] * len(block.units) for m in range(len(metrics))])
        return Block(block.arm, block.codes, block.units, block.outcomes, margins)

    level, rounds, columns = StorageLevel.MEMORY_AND_DISK_DESER, [], Columns(sizes.tolist())
    state, previous, held = base.map(started).persist(level), None, None
    for first in range(0, settings.n_trees, settings.together):
        numbers = range(first, min(first + settings.together, settings.n_trees))
        used = [used_features(number, len(features), settings, seed) for number in numbers]
        growths = [[Growth(settings, u, sizes[u]) for _ in models] for u in used]
        ready = state.map(lambda block, numbers=numbers: block.ready(numbers, settings, seed)).persist(level)
        sums = root_sums
        while True:
            wanted = [[g.wanted() for g in trees] for trees in growths]
            if not any(w for of_tree in wanted for w in of_tree):
                break
            plans = [Plan(u, [g.tree for g in trees], w) for u, trees, w in zip(used, growths, wanted)]
            summed = added_up(ready.mapPartitions(lambda blocks, plans=plans, sums=sums: sums(blocks, plans, models, columns)), partitions)
            flat = [(g, w) for trees, of_tree in zip(growths, wanted) for g, w in zip(trees, of_tree)]
            for place, (growth, nodes) in enumerate(flat):
                if nodes:
                    cells = summed.get(place, np.zeros((3, len(nodes), int(growth.starts[-1]))))
                    growth.take(nodes, np.ascontiguousarray(cells.transpose(1, 2, 0)))
            sums = node_sums
            # the first round of a tree has computed its margins from those of the trees before
            if previous is not None:
                previous = previous.unpersist() and None
        ready.unpersist()
        grown = [[g.finished() for g in trees] for trees in growths]
        rounds += grown
        following = state.mapPartitions(lambda blocks, grown=grown: advanced(blocks, grown, models, columns))
        if len(rounds) // RENEWED > (len(rounds) - len(grown)) // RENEWED and len(rounds) < settings.n_trees:
            following, table = stored_blocks(following, train.sparkSession, len(features), len(metrics))
            if held is not None:
                release(held)
            held = table
        state, previous = following.persist(level), state
    for rdd in (state, previous):
        if rdd is not None:
            rdd.unpersist()
    if held is not None:
        release(held)
    return Forest(features, edges, models, start, rounds)


def used_features(number: int, n_features: int, settings: TreeSettings, seed: int) -> np.ndarray:
    """Places of the features that a tree may use."""
    n_used = max(1, int(settings.feature_share * n_features))
    return np.sort(np.random.default_rng([seed, number]).choice(n_features, n_used, replace=False))


def added_up(parts: RDD, partitions: int) -> dict[int, np.ndarray]:
    """The sums of all tasks by key; those of many partitions are added by tasks first."""
    if partitions > ADDED_AT_ONCE:
        return parts.reduceByKey(np.add, min(partitions, parts.ctx.defaultParallelism), lambda key: key).collectAsMap()
    total: dict[int, np.ndarray] = {}
    for key, cells in parts.collect():
        total[key] = np.add(total[key], cells, out=total[key]) if key in total else cells
    return total
