"""Byte-level BPE: encode whole texts by the ranks of a public vocabulary, and decode ids.

A piece of text is merged on a segment tree over its byte positions. A leaf holds the rank
of the pair that starts there (and the position, so ties go left), an inner node the
minimum below it. The root names the next merge; the merge changes the leaves of its two
halves and of the live neighbour before them, and each change climbs the tree in
logarithmic time. Pieces of similar length are merged together, one numpy lane each.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from armlift.llm.tables import documents, map_batches

NO_PAIR = np.int64(2**62)
POSITION_BITS = 32
# pieces longer than this are merged alone, on Python lists
LANE_BYTES = 256
# characters of text, and known pieces, that a worker holds at a time
TEXT_CHUNK = 1_000_000
KNOWN_PIECES = 500_000


class Codec:
    """Encoder and decoder for one rank file (lines of base64 bytes and rank) and split pattern."""

    def __init__(self, rank_file: bytes, pattern: str) -> None:
        self.split = regex.compile(pattern)
        lines = [line.split() for line in rank_file.splitlines() if line]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in lines}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.first = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.pairs: dict[int, int] = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left << POSITION_BITS | right] = rank
        self.pair_keys = np.array(sorted(self.pairs), np.int64)
        self.pair_ranks = np.array([self.pairs[k] for k in self.pair_keys.tolist()], np.int64)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NO_PAIR >> POSITION_BITS where it does not merge."""
        keys = left << POSITION_BITS | np.maximum(right, 0)
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        known = (self.pair_keys[at] == keys) & (right >= 0) & (left >= 0)
        return np.where(known, self.pair_ranks[at], NO_PAIR >> POSITION_BITS)

    def merge_lanes(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of pieces of at most LANE_BYTES bytes."""
        n, size = len(pieces), 2
        while size < max(map(len, pieces)):
            size *= 2
        lengths = np.array([len(p) for p in pieces])
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        # one column more than positions: the end, which merges with nothing
        ids = np.full((n, size + 1), -1, np.int64)
        ids[np.arange(size + 1) < lengths[:, None]] = self.first[flat]
        after = np.broadcast_to(np.arange(1, size + 2), (n, size + 1)).copy()
        before = np.broadcast_to(np.arange(-1, size), (n, size + 1)).copy()
        tree = np.full((n, 2 * size), NO_PAIR, np.int64)
        tree[:, size:] = self.rank_of(ids[:, :-1], ids[:, 1:]) << POSITION_BITS | np.arange(size)
        tree[:, size:][tree[:, size:] >= NO_PAIR] = NO_PAIR
        for node in range(size - 1, 0, -1):
            tree[:, node] = np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1])

        def put(lane: np.ndarray, position: np.ndarray, value: np.ndarray) -> None:
            node = position + size
            tree[lane, node] = value
            while node[0] > 1:
                node = node >> 1
                tree[lane, node] = np.minimum(tree[lane, 2 * node], tree[lane, 2 * node + 1])

        def pair(lane: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
            rank = self.rank_of(ids[lane, left], ids[lane, right])
            return np.where(rank < NO_PAIR >> POSITION_BITS, rank << POSITION_BITS | left, NO_PAIR)

        lane = np.flatnonzero(tree[:, 1] < NO_PAIR)
        while lane.size:
            top = tree[lane, 1]
            left = top & (2**POSITION_BITS - 1)
            right = after[lane, left]
            end = after[lane, right]
            ids[lane, left], ids[lane, right] = top >> POSITION_BITS, -1
            after[lane, left] = end
            inside = end < size
            before[lane[inside], end[inside]] = left[inside]
            put(lane, right, np.full(lane.size, NO_PAIR))
            put(lane, left, pair(lane, left, np.minimum(end, size)))
            has = np.flatnonzero(before[lane, left] >= 0)
            if has.size:
                previous = before[lane[has], left[has]]
                put(lane[has], previous, pair(lane[has], previous, left[has]))
            lane = lane[tree[lane, 1] < NO_PAIR]
        kept = ids[ids >= 0].tolist()
        ends = np.cumsum((ids >= 0).sum(axis=1)).tolist()
        return [kept[a:b] for a, b in zip([0, *ends[:-1]], ends)]

    def merge_one(self, piece: bytes) -> list[int]:
        """Ids of one piece of any length."""
        n, size, none = len(piece), 2, (2**31, 0)
        while size < n:
            size *= 2
        ids = [*(self.ranks[bytes([b])] for b in piece), -1]
        after, before = list(range(1, n + 2)), list(range(-1, n))
        pairs = self.pairs

        def pair(left: int, right: int) -> tuple[int, int]:
            rank = pairs.get(ids[left] << POSITION_BITS | ids[right]) if right < n else None
            return none if rank is None else (rank, left)

        tree = [none] * size + [pair(i, i + 1) for i in range(n)] + [none] * (size - n)
        for node in range(size - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(position: int, value: tuple[int, int]) -> None:
            node = position + size
            tree[node] = value
            while node > 1:
                node >>= 1
                tree[node] = min(tree[2 * node], tree[2 * node + 1])

        while tree[1] is not none:
            rank, left = tree[1]
            right = after[left]
            end = after[right]
            ids[left], ids[right], after[left] = rank, -1, end
            if end < n:
                before[end] = left
            put(right, none)
            put(left, pair(left, end))
            if before[left] >= 0:
                put(before[left], pair(before[left], left))
        return [i for i in ids if i >= 0]

    def merged(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece; a piece that is a token itself stays whole."""
        found: list[list[int]] = [[]] * len(pieces)
        classes: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            if piece in self.ranks:
                found[i] = [self.ranks[piece]]
            elif len(piece) > LANE_BYTES:
                found[i] = self.merge_one(piece)
            else:
                classes.setdefault((len(piece) - 1).bit_length(), []).append(i)
        for bits, members in classes.items():
            lanes = 2**20 >> bits
            for start in range(0, len(members), lanes):
                some = members[start : start + lanes]
                for i, ids in zip(some, self.merge_lanes([pieces[j] for j in some])):
                    found[i] = ids
        return found

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def pieces(self, text: str) -> Iterator[list[str]]:
        """Pieces of the text in order; a very long text comes in several lists."""
        if len(text) <= TEXT_CHUNK:
            yield self.split.findall(text)
            return
        matches = self.split.finditer(text)
        while some := [m.group() for m in islice(matches, TEXT_CHUNK // 8)]:
            yield some


class Known:
    """Pieces met so far in this worker with what a caller needs of them; emptied when full."""

    def __init__(self, codec: Codec, *views: object) -> None:
        self.codec, self.views = codec, views
        self.tables: list[dict[str, object]] = [{} for _ in views]

    def learn(self, lists: Iterable[list[str]]) -> None:
        wanted = set().union(*lists)
        if len(self.tables[0]) > KNOWN_PIECES:
            for table in self.tables:
                table.clear()
        new = [p for p in wanted if p not in self.tables[0]]
        for piece, ids in zip(new, self.codec.merged([p.encode() for p in new])):
            for table, view in zip(self.tables, self.views):
                table[piece] = view(ids)


def grouped(texts: Iterable[str]) -> Iterator[list[str]]:
    """Runs of texts of about TEXT_CHUNK characters."""
    some, size = [], 0
    for text in texts:
        some.append(text)
        size += len(text)
        if size >= TEXT_CHUNK:
            yield some
            some, size = [], 0
    if some:
        yield some


def text_of(batch: pa.RecordBatch, column: str) -> Iterator[str]:
    values = batch.column(column)
    return (values[i].as_py() or "" for i in range(len(values)))


def encode(docs: DataFrame, rank_file: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Replace the text column by ``ids`` (array<int>); other columns stay.

    Null and empty texts have no ids. The vocabulary is read once by the driver and sent
    with the job (its size does not depend on the data).
    """
    with open(rank_file, "rb") as file:
        ranks = file.read()
    kept = [c for c in docs.columns if c not in (text, ids)]
    rows = docs.select(*[f"`{c}`" for c in kept], f"`{text}`")
    fields = [docs.schema[c] for c in kept]

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(ranks, pattern)
        known = Known(codec, tuple)
        for batch in batches:
            arrays = []
            for texts in grouped(text_of(batch, text)):
                short = [next(codec.pieces(t)) if len(t) <= TEXT_CHUNK else None for t in texts]
                known.learn(p for p in short if p is not None)
                for one, pieces in zip(texts, short):
                    found: list[int] = []
                    for part in [pieces] if pieces is not None else codec.pieces(one):
                        if pieces is None:
                            known.learn([part])
                        found.extend(chain.from_iterable(map(known.tables[0].__getitem__, part)))
                    arrays.append(np.array(found, np.int32))
            offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
            column = pa.ListArray.from_arrays(offsets, np.concatenate([*arrays, np.empty(0, np.int32)]))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], column], [*kept, ids])

    return map_batches(rows, encoded, StructType([*fields, StructField(ids, ArrayType(IntegerType()))]))


def decode(encoded: DataFrame, rank_file: str, pattern: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """Replace the ids column by the decoded ``text``; bytes that are not UTF-8 are replaced."""
    with open(rank_file, "rb") as file:
        ranks = file.read()
    kept = [c for c in encoded.columns if c not in (text, ids)]
    rows = encoded.select(*[f"`{c}`" for c in kept], f"`{ids}`")

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(ranks, pattern)
        for batch in batches:
            texts = [codec.decode(v.as_py() or ()).decode(errors="replace") for v in batch.column(ids)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(texts, pa.string())], [*kept, text])

    return map_batches(rows, decoded, StructType([encoded.schema[c] for c in kept] + [StructField(text, StringType())]))


def digests(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of encoding and decoding every whole text.

    Ids are hashed as decimals joined by one space. Null texts count as empty; repeated
    rows give repeated results; other columns are dropped.
    """
    with open(rank_file, "rb") as file:
        ranks = file.read()
    rows = docs.select("doc_id", "text")

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(ranks, pattern)
        known = Known(codec, lambda found: " ".join(map(str, found)), codec.decode)
        decimals, decoded = known.tables
        for batch in batches:
            counts, id_sums, text_sums = [], [], []
            for texts in grouped(text_of(batch, "text")):
                short = [next(codec.pieces(t)) if len(t) <= TEXT_CHUNK else None for t in texts]
                known.learn(p for p in short if p is not None)
                for one, pieces in zip(texts, short):
                    count, id_sum, text_sum = 0, hashlib.sha256(), hashlib.sha256()
                    for part in [pieces] if pieces is not None else codec.pieces(one):
                        if pieces is None:
                            known.learn([part])
                        if part:
                            numbers = " ".join(map(decimals.__getitem__, part)).encode()
                            id_sum.update(b" " + numbers if count else numbers)
                            count += numbers.count(b" ") + 1
                            text_sum.update(b"".join(map(decoded.__getitem__, part)))
                    counts.append(count)
                    id_sums.append(id_sum.hexdigest())
                    text_sums.append(text_sum.hexdigest())
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(id_sums), pa.array(text_sums)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(rows, digested, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )


def op3_encode_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Token counts and digests of all documents under the 50k byte-level vocabulary."""
    import public_tokenizers

    return digests(documents(spark, folder), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
