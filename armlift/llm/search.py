"""Ranked lexical search by masks of matched terms.

Documents are reduced to the terms that some item asks for. A block of documents holds one
bitmap per term; the bitmaps of an item's terms, turned on their side, give every document
the mask of the terms it matches. Documents with the same mask have the same upper bound of
their score, the sum of the terms' highest gains in the block. The distinct masks are
evaluated in descending order of that bound, until no later mask can reach the ranks kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from armlift.llm.ordering import with_position
from armlift.llm.tables import byte_texts, documents, map_batches
from armlift.llm.words import WordHasher, chunks
from armlift.session import release, stored

# items are asked in blocks whose texts start within this many characters: what a job carries is bounded
BLOCK_CHARS = 4_000_000
# a block of documents, in documents and in (document, term) entries
BLOCK_DOCS = 16_384
BLOCK_ENTRIES = 2_000_000
# presence bits of one item that are laid out at a time
MASK_CELLS = 4_000_000
# documents evaluated before the bound is looked at again
STEP_DOCS = 256

# everything but ASCII letters, digits and non-ASCII characters separates terms
SEPARATED = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))

TERM_ROWS = "doc_id {kind}, n bigint, slots array<int>, tfs array<int>"


@dataclass(frozen=True)
class Items:
    """A block of items: sorted hashes of all their terms, and the terms of each item with their repeats."""

    numbers: np.ndarray
    vocabulary: np.ndarray
    starts: np.ndarray
    slots: np.ndarray
    times: np.ndarray


def term_hashes(hasher: WordHasher, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms in order, and the number of terms of each text."""
    return hasher.words([t.translate(SEPARATED) for t in texts])


def numbered_items(items: DataFrame) -> DataFrame:
    """(item, item_id, text, block) of the distinct items; a block starts within BLOCK_CHARS characters."""
    rows = items.selectExpr("cast(item_id as bigint) as item_id", "text").where("text is not null").distinct()
    placed = with_position(rows, ["item_id", "text"], value="cast(length(text) as bigint)")
    return stored(placed.selectExpr("_p_position as item", "item_id", "text", f"_p_total div {BLOCK_CHARS} as block"))


def block_of_items(items: DataFrame, block: int) -> Items:
    """The terms of one block of items, at most some BLOCK_CHARS and those of one more item."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            hashes, counts = term_hashes(hasher, list(byte_texts(batch)))
            owner = np.repeat(batch.column("item").to_numpy(), counts)
            yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(hashes.view(np.int64))], ["item", "term"])

    rows = map_batches(items.where(F.col("block") == block).select("item", "text"), listed, "item bigint, term bigint")
    found = rows.groupBy("item", "term").agg(F.count(F.lit(1)).alias("times")).orderBy("item", "term").toArrow()
    numbers, places = np.unique(found["item"].to_numpy(), return_inverse=True)
    vocabulary, slots = np.unique(found["term"].to_numpy().view(np.uint64), return_inverse=True)
    starts = np.searchsorted(places, np.arange(len(numbers) + 1))
    return Items(numbers, vocabulary, starts, slots.astype(np.int32), found["times"].to_numpy())


def item_terms_of(docs: DataFrame, items: Items) -> DataFrame:
    """(doc_id, n, slots, tfs) of every document with terms: their number, and the item terms among them."""
    vocabulary, size = items.vocabulary, len(items.vocabulary)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            sizes, limits, slots, tfs, total = [], [np.zeros(1, np.int64)], [], [], 0
            for some in chunks(byte_texts(batch)):
                hashes, counts = term_hashes(hasher, some)
                place = np.minimum(np.searchsorted(vocabulary, hashes), max(size - 1, 0))
                asked = vocabulary[place] == hashes if size else np.zeros(len(hashes), bool)
                owner = np.repeat(np.arange(len(some)), counts)[asked]
                keys, tf = np.unique(owner * max(size, 1) + place[asked], return_counts=True)
                limits.append(total + np.searchsorted(keys, np.arange(1, len(some) + 1) * max(size, 1)))
                total += len(keys)
                slots.append(keys % max(size, 1)), tfs.append(tf), sizes.append(counts)
            offsets = pa.array(np.concatenate(limits).astype(np.int32))
            lists = [
                pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.empty(0, np.int64), *v]).astype(np.int32)))
                for v in (slots, tfs)
            ]
            n = pa.array(np.concatenate([np.empty(0, np.int64), *sizes]).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n, *lists], ["doc_id", "n", "slots", "tfs"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), counted, TERM_ROWS.format(kind=kind)).where("n > 0")


class Best:
    """The highest scores of each item that a task has met, ties to the smaller key."""

    def __init__(self, k: int) -> None:
        self.k, self.kept = k, {}

    def floor(self, item: int) -> int:
        """A score below this one can no longer be among the best."""
        scores = self.kept[item][0] if item in self.kept else ()
        return int(scores[-1]) if len(scores) == self.k else 1

    def add(self, item: int, scores: np.ndarray, keys: np.ndarray) -> None:
        if item in self.kept:
            scores, keys = (np.concatenate(x) for x in zip(self.kept[item], (scores, keys)))
        order = np.lexsort([keys, -scores])[: self.k]
        self.kept[item] = scores[order], keys[order]


class Block:
    """Documents with their item terms, by document and by term."""

    def __init__(self, rows: pa.Table, weights: np.ndarray, n_docs: int, n_terms: int) -> None:
        # a null doc_id comes after all others
        self.keys = rows["doc_id"].cast(pa.int64()).fill_null(np.iinfo(np.int64).max).to_numpy()
        n = rows["n"].to_numpy()
        lists = rows["slots"].combine_chunks()
        self.slots, tf = (rows[c].combine_chunks().flatten().to_numpy().astype(np.int64) for c in ("slots", "tfs"))
        counts = lists.value_lengths().to_numpy().astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(counts)])
        owner = np.repeat(np.arange(len(counts)), counts)
        middle = (100 - 25 + 25 * n * n_docs // n_terms)[owner]
        self.gains = weights[self.slots] * (1_000_000_000 * tf // (1000 * tf + 12 * middle))
        order = np.argsort(self.slots, kind="stable")
        self.by_slot, self.owner, self.slot_gains = self.slots[order], owner[order], self.gains[order]

    def entries_of(self, slots: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ascending documents with a term and its gain in each."""
        lo, hi = np.searchsorted(self.by_slot, slots), np.searchsorted(self.by_slot, slots, side="right")
        return [(self.owner[a:b], self.slot_gains[a:b]) for a, b in zip(lo.tolist(), hi.tolist())]

    def scores(self, docs: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Whole scores of some documents, each with at least one entry; ``times`` by slot."""
        counts = self.starts[docs + 1] - self.starts[docs]
        first = np.cumsum(counts) - counts
        at = np.repeat(self.starts[docs] - first, counts) + np.arange(counts.sum())
        return np.add.reduceat(times[self.slots[at]] * self.gains[at], first)

    def search(self, item: int, slots: np.ndarray, repeats: np.ndarray, times: np.ndarray, best: Best) -> None:
        """Bring the best of this block into ``best``."""
        entries = [(d, g, r) for (d, g), r in zip(self.entries_of(slots), repeats.tolist()) if len(d)]
        if not entries:
            return
        highest = np.array([int(g.max()) * r for _, g, r in entries], np.int64)
        width = max(8, MASK_CELLS // len(entries) // 8 * 8)
        for start in range(0, len(self.keys), width):
            end = min(start + width, len(self.keys))
            bitmaps = np.zeros((len(entries), end - start), bool)
            for line, (docs, _, _) in zip(bitmaps, entries):
                lo, hi = np.searchsorted(docs, (start, end))
                line[docs[lo:hi] - start] = True
            # the column of a document is its mask, packed into 64-bit numbers
            packed = np.packbits(bitmaps, axis=0, bitorder="little")
            masks = np.zeros((end - start, -(-len(packed) // 8) * 8), np.uint8)
            masks[:, : len(packed)] = packed.T
            matched = np.flatnonzero(packed.any(axis=0))
            if len(matched):
                self.evaluate(item, masks[matched].view(np.uint64), matched + start, highest, times, best)

    def evaluate(
        self, item: int, masks: np.ndarray, docs: np.ndarray, highest: np.ndarray, times: np.ndarray, best: Best
    ) -> None:
        """Documents in groups of one mask, by descending bound, until the bound falls below the best found."""
        if masks.shape[1] == 1:
            kinds, kind = np.unique(masks[:, 0], return_inverse=True)
            kinds = kinds[:, None]
        else:
            kinds, kind = np.unique(masks, axis=0, return_inverse=True)
            kind = kind.ravel()
        bits = np.unpackbits(np.ascontiguousarray(kinds).view(np.uint8), axis=1, bitorder="little")[:, : len(highest)]
        bounds = bits.astype(np.int64) @ highest
        order = np.argsort(-bounds, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        ranks = rank[kind]
        line = np.argsort(ranks, kind="stable")
        docs, limits = docs[line], np.searchsorted(ranks[line], np.arange(len(order)), side="right")
        bounds, done, at = bounds[order], 0, 0
        while at < len(order) and bounds[at] >= best.floor(item):
            at = max(at + 1, int(np.searchsorted(limits, done + STEP_DOCS)))
            upto = int(limits[min(at, len(order)) - 1])
            some = docs[done:upto]
            scores = self.scores(some, times)
            found = scores >= best.floor(item)
            if found.any():
                best.add(item, scores[found], self.keys[some[found]])
            done = upto


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together to blocks of documents."""
    held, docs, entries = [], 0, 0
    for batch in batches:
        held.append(batch)
        docs, entries = docs + batch.num_rows, entries + len(batch.column("slots").flatten())
        if docs >= BLOCK_DOCS or entries >= BLOCK_ENTRIES:
            yield pa.Table.from_batches(held)
            held, docs, entries = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)


def best_of_tasks(terms: DataFrame, items: Items, weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item, doc_id, score): the k best documents that each task has for each item."""

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, times = Best(k), np.zeros(len(items.vocabulary), np.int64)
        for rows in blocks_of(batches):
            block = Block(rows, weights, n_docs, n_terms)
            for i, item in enumerate(items.numbers.tolist()):
                mine = slice(items.starts[i], items.starts[i + 1])
                slots, repeats = items.slots[mine], items.times[mine]
                times[slots] = repeats
                block.search(item, slots, repeats, times, best)
                times[slots] = 0
        for item, (scores, keys) in best.kept.items():
            ids = pa.array(keys, mask=keys == np.iinfo(np.int64).max)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(keys), item)), ids, pa.array(scores)], ["item", "doc_id", "score"]
            )

    return map_batches(terms, searched, "item bigint, doc_id bigint, score bigint")


def search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """(item_id, rank, doc_id, score): up to k documents (doc_id, text) with the highest scores for each item (item_id, text).

    Scores are whole numbers; equal scores are ranked by ascending doc_id, a null doc_id last.
    Every row of ``docs`` is a document of its own, rows that repeat included. Items that
    repeat in id and text count once; two texts under one id are ranked each by itself. Null,
    empty and term-free texts are found by nothing and find nothing; empty tables give no
    rows. Further columns are not read. Terms are compared by 64-bit hashes.
    """
    numbered = numbered_items(items)
    last, results = numbered.agg(F.max("block")).first()[0], []
    for block in range(0 if last is None else last + 1):
        some = block_of_items(numbered, block)
        if not len(some.numbers):
            continue
        terms = stored(item_terms_of(docs, some))
        n_docs, n_terms = terms.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_docs:
            continue
        # one row per term of the block of items
        holding = terms.selectExpr("explode(slots) as slot").groupBy("slot").count().toArrow()
        df = np.zeros(len(some.vocabulary), np.int64)
        df[holding["slot"].to_numpy()] = holding["count"].to_numpy()
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)
        results.append(stored(best_of_tasks(terms, some, weights, n_docs, n_terms, k)))
        release(terms)
    schema = "item bigint, doc_id bigint, score bigint"
    found = docs.sparkSession.createDataFrame([], schema) if not results else results[0]
    for more in results[1:]:
        found = found.unionByName(more)
    rank = "row_number() over (partition by item order by score desc, doc_id nulls last)"
    top = found.selectExpr("*", f"{rank} as rank").where(f"rank <= {k}")
    return top.join(numbered.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def op11_rank_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 best documents for every item of the benchmark."""
    return search(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))
