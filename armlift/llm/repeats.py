"""Remove long byte strings that occur more than once, wherever they start.

A window of ``length`` bytes is anchored at its smallest k-gram hash (leftmost on ties), so
equal windows have equal anchors at equal distances. An anchor hash that occurs once in the
corpus clears the windows it anchors; counts are pre-aggregated, and only what remains is
sent on: runs of windows with a common anchor, dealt into buckets by its hash. In a bucket
the runs are cut into blocks aligned at the anchor, shards of them get Burrows-Wheeler
transforms, and the transforms are merged by interleave refinement. The common prefixes it
yields give the intervals of equal suffixes; a window is repeated when another one lies in
the same interval and has the same bytes before its first block.

Windows of an anchor that very many texts have are counted by a hash of the whole window
instead, so no bucket grows with a common passage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from armlift.llm.bwt import merge, transform
from armlift.llm.tables import byte_texts, documents, map_batches
from armlift.llm.words import INVERSE, MULTIPLIER, chunks, mixed
from armlift.session import stored

LENGTH = 400
GRAM = 32
BLOCK = 16
# runs of one anchor that a bucket takes; beyond, windows are counted one by one
MANY = 20_000
BUCKET_BYTES = 6_000_000
SHARD_SYMBOLS = 100_000
# Multiplier of the second window hash and its inverse modulo 2^64.
SECOND = 0xD1342543DE82EF95
SECOND_INVERSE = pow(SECOND, -1, 2**64)
LOW = np.uint64(28)


class Rolling:
    """Hashes of all substrings of one length."""

    def __init__(self, factor: int = MULTIPLIER, inverse: int = INVERSE) -> None:
        self.factors = (factor, inverse)
        self.powers = self.inverses = np.empty(0, np.uint64)

    def sums(self, flat: np.ndarray) -> np.ndarray:
        if len(self.powers) < len(flat) + 1:
            size = max(2 * len(self.powers), len(flat) + 1, 2**16)
            tables = []
            for factor in self.factors:
                steps = np.full(size, factor, np.uint64)
                steps[0] = 1
                tables.append(np.multiply.accumulate(steps))
            self.powers, self.inverses = tables
        sums = np.zeros(len(flat) + 1, np.uint64)
        np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * self.powers[: len(flat)], out=sums[1:])
        return sums

    def between(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((sums[end] - sums[start]) * self.inverses[start])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, from minima to both ends of fixed blocks."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    rows = padded.reshape(-1, width)
    forward = np.minimum.accumulate(rows, axis=1).ravel()
    backward = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[: n - width + 1], forward[width - 1 : n])


class Runs:
    """Runs of windows of one text that share an anchor; runs of equal hash that touch form one stretch."""

    def __init__(self, rolling: Rolling, text: bytes, length: int) -> None:
        flat = np.frombuffer(text, np.uint8)
        self.sums = rolling.sums(flat)
        at = np.arange(len(flat) - GRAM + 1)
        gram = rolling.between(self.sums, at, at + GRAM)
        # texts of 2^28 bytes or more order equal high bits by position modulo 2^28
        keyed = (gram >> LOW << LOW) | (at.astype(np.uint64) & ((np.uint64(1) << LOW) - np.uint64(1)))
        smallest = sliding_min(keyed, length - GRAM + 1)
        self.lo = np.flatnonzero(np.concatenate([[True], smallest[1:] != smallest[:-1]]))
        self.hi = np.append(self.lo[1:], len(smallest)) - 1
        low = (smallest[self.lo] & ((np.uint64(1) << LOW) - np.uint64(1))).astype(np.int64)
        self.anchor = self.lo + (low - self.lo) % (1 << 28)
        self.hash = gram[self.anchor]
        self.stretch = np.cumsum(np.concatenate([[True], self.hash[1:] != self.hash[:-1]])) - 1
        self.first = self.lo[np.concatenate([[True], self.hash[1:] != self.hash[:-1]])]


def anchor_rows(texts: DataFrame, length: int) -> DataFrame:
    """(anchor, k1, k2, lo, n) of every text: one row per anchor hash; n tells how often, lo where if once."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        for batch in batches:
            k1, k2 = batch.column("k1").to_numpy(), batch.column("k2").to_numpy()
            parts = []
            for i, text in enumerate(byte_texts(batch)):
                runs = Runs(rolling, text, length)
                anchor, at, n = np.unique(runs.hash, return_index=True, return_counts=True)
                parts.append((anchor, np.full(len(anchor), k1[i]), np.full(len(anchor), k2[i]), runs.lo[at], n))
            if parts:
                columns = [np.concatenate(x) for x in zip(*parts)]
                columns[0] = columns[0].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["anchor", "k1", "k2", "lo", "n"])

    return map_batches(texts.select("k1", "k2", "text"), found, "anchor bigint, k1 bigint, k2 bigint, lo bigint, n bigint")


CANDIDATES = (
    "kind int, a bigint, b bigint, n bigint, text_no bigint, lo bigint, hi bigint, size int, content binary, "
    "texts array<bigint>, los array<bigint>, k1 bigint, k2 bigint"
)
NAMES = [part.split()[0] for part in CANDIDATES.split(", ")]
TEXT, RUN, WINDOW, COMMON = range(4)


def rows_of(count: int, kind: int, **columns: object) -> pa.RecordBatch:
    """A batch of one kind of row; columns that are not given are null."""
    types = {"kind": pa.int32(), "size": pa.int32(), "content": pa.binary(), "texts": pa.list_(pa.int64()), "los": pa.list_(pa.int64())}
    columns = {"kind": np.full(count, kind, np.int32)} | columns
    arrays = [pa.array(columns[c], types.get(c, pa.int64())) if c in columns else pa.nulls(count, types.get(c, pa.int64())) for c in NAMES]
    return pa.RecordBatch.from_arrays(arrays, NAMES)


def candidates(texts: DataFrame, length: int) -> DataFrame:
    """What is left of every text (text_no, k1, k2, text, copies, once, many): runs with bytes, windows of common anchors.

    Texts without any such run are left out. Equal runs that a task meets are sent once,
    with all their places.
    """

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling, second = Rolling(), Rolling(SECOND, SECOND_INVERSE)
        for batch in batches:
            numbers, copies = batch.column("text_no").to_pylist(), batch.column("copies").to_pylist()
            once, many = batch.column("once").to_pylist(), batch.column("many").to_pylist()
            keys = [batch.column("k1").to_pylist(), batch.column("k2").to_pylist()]
            place = 0
            for some in chunks(byte_texts(batch)):
                runs_found: dict[tuple[int, int, int], list] = {}
                kept, windows, commons = [], [], []
                for text in some:
                    runs = Runs(rolling, text, length)
                    open_ = ~np.isin(runs.lo, np.array(once[place] or [], np.int64))
                    hot = np.isin(runs.hash, np.array(many[place] or [], np.int64).view(np.uint64)) & open_
                    if open_.any():
                        kept.append((numbers[place], keys[0][place], keys[1][place], copies[place], len(text)))
                    for i in np.flatnonzero(open_ & ~hot).tolist():
                        lo, end = int(runs.lo[i]), int(runs.hi[i]) + length
                        inside = int(runs.anchor[i]) - lo
                        whole = int(rolling.between(runs.sums, np.array([lo]), np.array([end]))[0])
                        entry = runs_found.setdefault((whole, inside, end - lo), [int(runs.hash[i].view(np.int64)), text[lo:end], [], []])
                        entry[2].append(numbers[place])
                        entry[3].append(lo)
                    if hot.any():
                        at = np.concatenate([np.arange(a, b + 1) for a, b in zip(runs.lo[hot], runs.hi[hot])])
                        one = rolling.between(runs.sums, at, at + length)
                        two = second.between(second.sums(np.frombuffer(text, np.uint8)), at, at + length)
                        windows.append((one.view(np.int64), two.view(np.int64), np.full(len(at), numbers[place]), at))
                        commons.append((np.full(hot.sum(), numbers[place]), runs.lo[hot], runs.hi[hot]))
                    place += 1
                if kept:
                    no, k1, k2, n, size = zip(*kept)
                    yield rows_of(len(kept), TEXT, text_no=no, k1=k1, k2=k2, n=n, hi=size)
                if runs_found:
                    anchors, contents, texts_, los = zip(*runs_found.values())
                    insides = [key[1] for key in runs_found]
                    yield rows_of(len(anchors), RUN, a=anchors, size=insides, content=contents, texts=texts_, los=los)
                if windows:
                    one, two, no, at = (np.concatenate(x) for x in zip(*windows))
                    order = np.lexsort([two, one])
                    first = np.flatnonzero(np.concatenate([[True], (np.diff(one[order]) != 0) | (np.diff(two[order]) != 0)]))
                    times, pick = np.diff(np.append(first, len(order))), order[first]
                    yield rows_of(len(pick), WINDOW, a=one[pick], b=two[pick], n=times, text_no=no[pick], lo=at[pick])
                    no, lo, hi = (np.concatenate(x) for x in zip(*commons))
                    yield rows_of(len(no), COMMON, text_no=no, lo=lo, hi=hi)

    return map_batches(texts.select("text_no", "k1", "k2", "text", "copies", "once", "many"), left, CANDIDATES)


def blocks(content: bytes, inside: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Blocks aligned at the anchor: their bytes as two big-endian numbers, their lengths, and where the first one starts."""
    start = inside % BLOCK
    body = content[start:]
    n = -(-len(body) // BLOCK)
    words = np.frombuffer(body.ljust(n * BLOCK, b"\0"), ">u8").reshape(n, 2).astype(np.uint64)
    sizes = np.full(n, BLOCK, np.int64)
    sizes[-1] = len(body) - (n - 1) * BLOCK
    return words[:, 0], words[:, 1], sizes, start


def repeated_windows(contents: list[bytes], insides: list[int], times: np.ndarray, length: int) -> list[np.ndarray]:
    """For each distinct run (bytes, place of the anchor, times met): which of its windows occur elsewhere too."""
    parsed = [blocks(c, i) for c, i in zip(contents, insides)]
    counts = np.array([len(p[0]) for p in parsed])
    high, low, sizes = (np.concatenate([p[k] for p in parsed]) for k in range(3))
    order = np.lexsort([sizes, low, high])
    change = np.zeros(len(order), bool)
    for column in (high, low, sizes):
        change[1:] |= column[order][1:] != column[order][:-1]
    code = np.empty(len(order), np.int64)
    code[order] = np.cumsum(change) + 1

    # strings of block codes, each closed by END
    starts = np.cumsum(np.append(0, counts[:-1] + 1))
    total = int(counts.sum() + len(counts))
    symbols = np.zeros(total, np.int64)
    string = np.repeat(np.arange(len(counts)), counts + 1)
    is_block = np.ones(total, bool)
    is_block[starts + counts] = False
    symbols[is_block] = code
    number = np.cumsum(is_block) - 1  # place of the block among all blocks

    # shards of whole strings, a transform for each, and their merge
    shard_of = starts // SHARD_SYMBOLS
    suffixes, befores = [], []
    for s in np.unique(shard_of):
        mine = np.flatnonzero(shard_of == s)
        a, b = starts[mine[0]], starts[mine[-1]] + counts[mine[-1]] + 1
        sorted_, before = transform(symbols[a:b], starts[mine] - a)
        suffixes.append(sorted_ + a)
        befores.append(before)
    depth = length // BLOCK + 2
    merged, common = merge(befores, depth)
    place = np.concatenate(suffixes)[merged]

    # bytes that neighbours share: whole blocks, then the equal bytes of the blocks that differ
    remaining = np.zeros(total, np.int64)
    lengths = np.array([len(c) for c in contents])
    first_byte = np.array([p[3] for p in parsed])
    offset = np.arange(total) - starts[string]
    remaining = np.maximum(lengths[string] - first_byte[string] - offset * BLOCK, 0)
    shared = common * BLOCK
    one, two = place[:-1] + common[1:], place[1:] + common[1:]
    same_string = (common[1:] < depth) & (one < total) & (two < total)
    one, two = np.minimum(one, total - 1), np.minimum(two, total - 1)
    both = same_string & is_block[one] & is_block[two]
    x, y = number[one[both]], number[two[both]]
    differ = np.where(high[x] != high[y], high[x] ^ high[y], low[x] ^ low[y])
    zero = np.zeros(len(differ), np.int64)
    for shift in range(8, 64, 8):
        zero += differ >> np.uint64(shift) == 0
    equal = np.where(high[x] != high[y], 0, 8) + np.where(differ == 0, BLOCK, zero)
    extra = np.zeros(total - 1, np.int64)
    extra[both] = equal
    shared[1:] = np.minimum(shared[1:] + extra, np.minimum(remaining[place[:-1]], remaining[place[1:]]))
    shared[:1] = 0

    # windows by the bytes r before their first block: the rest of the window is a prefix of that suffix
    found = [np.full(len(c) - length + 1, t >= 2) for c, t in zip(contents, times.tolist())]
    begins = np.cumsum(np.append(0, [len(f) for f in found]))
    flags = np.concatenate(found)
    block_start = first_byte[string] + offset * BLOCK  # in the bytes of its string
    padded = np.frombuffer(b"".join(contents), np.uint8)
    content_start = np.cumsum(np.append(0, lengths[:-1]))
    relative = (block_start - np.array(insides)[string]) // BLOCK
    tail = np.zeros(total, np.uint64)
    for r in range(BLOCK):
        if r:
            at = content_start[string] + block_start - r
            tail = mixed(tail * np.uint64(MULTIPLIER) + padded[np.clip(at, 0, len(padded) - 1)] + np.uint64(1))
        window = block_start - r
        valid = (window >= 0) & (window < (np.diff(begins))[string])
        interval = np.empty(total, np.int64)
        interval[place] = np.cumsum(shared < length - r)
        rows = np.flatnonzero(valid)
        order = rows[np.lexsort([tail[rows], relative[rows], interval[rows]])]
        if len(order) > 1:
            equal = (interval[order][1:] == interval[order][:-1]) & (relative[order][1:] == relative[order][:-1])
            equal &= tail[order][1:] == tail[order][:-1]
            twin = np.append(equal, False) | np.append(False, equal)
            hit = order[twin]
            flags[begins[string[hit]] + window[hit]] = True
    return [flags[a:b] for a, b in zip(begins[:-1], begins[1:])]


def spans_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of each run of true flags."""
    edges = np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1) - 1


def marks_of_runs(found: DataFrame, length: int) -> DataFrame:
    """(text_no, what, lo, hi): starts lo .. hi of repeated windows, from the merged transforms of each bucket."""
    runs = found.where(f"kind = {RUN}")
    size = runs.agg(F.sum(F.octet_length("content"))).first()[0] or 0
    n_buckets = max(1, -(-size // BUCKET_BYTES))

    def search(rows: pa.Table) -> pa.Table:
        whole: dict[tuple[int, int, bytes], list[int]] = {}
        anchors, insides = rows.column("a").to_pylist(), rows.column("size").to_pylist()
        contents = rows.column("content").to_pylist()
        for i, key in enumerate(zip(anchors, insides, contents)):
            whole.setdefault(key, []).append(i)
        texts, los = rows.column("texts").to_pylist(), rows.column("los").to_pylist()
        places = [[(t, lo) for i in members for t, lo in zip(texts[i], los[i])] for members in whole.values()]
        flags = repeated_windows(
            [k[2] for k in whole], [k[1] for k in whole], np.array([len(p) for p in places]), length
        )
        marks = []
        for flag, where in zip(flags, places):
            for first, last in zip(*(x.tolist() for x in spans_of(flag))):
                marks += [(text, lo + first, lo + last) for text, lo in where]
        text, lo, hi = zip(*marks) if marks else ((), (), ())
        return pa.table({"text_no": pa.array(text, pa.int64()), "what": pa.array([0] * len(text), pa.int32()),
                         "lo": pa.array(lo, pa.int64()), "hi": pa.array(hi, pa.int64())})

    dealt = runs.selectExpr("a", "size", "content", "texts", "los", f"pmod(xxhash64(a), {n_buckets}) as bucket")
    return dealt.groupBy("bucket").applyInArrow(search, "text_no bigint, what int, lo bigint, hi bigint")


def removed_spans(size: int, marks: list, length: int) -> list[dict[str, int]]:
    """The maximal removed runs, ends exclusive, of a text of ``size`` bytes by its marks."""
    covered = np.zeros(size + 1, np.int64)
    common = np.zeros(size + 1, np.int64)
    for mark in marks:
        if mark["what"] == 0:
            covered[mark["lo"]] += 1
            covered[min(mark["hi"] + length, size)] -= 1
        elif mark["what"] == 1:
            common[mark["lo"] : mark["hi"] + 1] = 1
    for mark in marks:
        if mark["what"] == 2:
            common[mark["lo"]] = 0
    for first, last in zip(*spans_of(common[:-1] > 0)):
        covered[first] += 1
        covered[min(last + length, size)] -= 1
    gone = np.cumsum(covered[:-1]) > 0
    return [{"start": first, "end": last + 1} for first, last in zip(*(x.tolist() for x in spans_of(gone)))]


SPANS = "array<struct<start: bigint, end: bigint>>"


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) for every row of ``docs`` (doc_id, text).

    ``spans`` are the removed runs of bytes in order, ends exclusive, ``kept`` the bytes that
    are left. A byte goes when a string of ``length`` bytes over it also starts anywhere else in the
    table, the same text included; strings are those of the input. Null texts count as
    empty, shorter texts keep all. Rows that repeat are copies of each other like any two
    equal texts. ``length`` must be at least 64.
    """
    rows = docs.selectExpr("doc_id", "cast(coalesce(text, '') as binary) as text").selectExpr(
        "doc_id", "xxhash64(text) as k1", "cast(hash(text) as bigint) as k2", "text"
    )
    long = rows.where(f"octet_length(text) >= {length}").select("k1", "k2", "text")
    # an anchor that one text has once (copies of the text aside) clears its windows there
    counted = anchor_rows(long, length)
    counts = stored(
        counted.groupBy("anchor").agg(
            F.min("k1").alias("k1"), F.max("k1").alias("k1_max"), F.max("k2").alias("k2"), F.max("lo").alias("lo"),
            F.max("n").alias("n"), F.count(F.lit(1)).alias("rows"),
        ).where(f"(k1 = k1_max and n = 1) or rows > {MANY}")
    )
    once = counts.where("k1 = k1_max and n = 1").select("k1", "k2", "lo", F.lit(None).cast("bigint").alias("anchor"))
    common = counts.where(f"not (k1 = k1_max and n = 1) and rows > {MANY}").select("anchor")
    if common.take(1):
        again = counted.join(common, "anchor").select("k1", "k2", F.lit(None).cast("bigint").alias("lo"), "anchor")
        once = once.unionByName(again.distinct())
    known = once.groupBy("k1", "k2").agg(F.collect_list("lo").alias("once"), F.collect_list("anchor").alias("many"))
    texts = long.groupBy("k1", "k2").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    whole = texts.join(known, ["k1", "k2"], "left").withColumn("text_no", F.monotonically_increasing_id())
    found = stored(candidates(whole, length))

    windows = found.where(f"kind = {WINDOW}").groupBy("a", "b").agg(
        F.sum("n").alias("n"), F.max("text_no").alias("text_no"), F.max("lo").alias("lo")
    )
    marks = (
        marks_of_runs(found, length)
        .unionByName(found.where(f"kind = {COMMON}").selectExpr("text_no", "1 as what", "lo", "hi"))
        .unionByName(windows.where("n = 1").selectExpr("text_no", "2 as what", "lo", "lo as hi"))
    )
    marked = marks.groupBy("text_no").agg(F.collect_list(F.struct("what", "lo", "hi")).alias("marks"))
    touched = found.where(f"kind = {TEXT} and n = 1").selectExpr("text_no", "k1", "k2", "hi as size").join(marked, "text_no")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            marks_of = zip(batch.column("size").to_pylist(), batch.column("marks").to_pylist())
            spans = [removed_spans(size, marks, length) for size, marks in marks_of]
            yield pa.RecordBatch.from_arrays(
                [batch.column("k1"), batch.column("k2"), pa.array(spans, spans_type)], ["k1", "k2", "spans"]
            )

    results = map_batches(touched.select("k1", "k2", "size", "marks"), cut, f"k1 bigint, k2 bigint, spans {SPANS}")
    # a text with copies goes whole
    copied = long.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("copies"), F.max(F.octet_length("text")).alias("size"))
    whole_copies = copied.where("copies > 1").selectExpr(
        "k1", "k2", f"cast(array(struct(0L, cast(size as bigint))) as {SPANS}) as spans"
    )
    # what lies between two removed runs, before the first and after the last
    pieces = (
        "transform(sequence(0, size(spans)), i -> substring(text, cast(if(i = 0, 0L, spans[i - 1].end) as int) + 1,"
        " cast(if(i = size(spans), n_bytes, spans[i].start) - if(i = 0, 0L, spans[i - 1].end) as int)))"
    )
    joined = rows.join(results.unionByName(whole_copies), ["k1", "k2"], "left").selectExpr(
        "doc_id", "text", "cast(octet_length(text) as bigint) as n_bytes", f"coalesce(spans, cast(array() as {SPANS})) as spans"
    )
    return joined.selectExpr(
        "doc_id",
        "n_bytes",
        "spans",
        f"if(size(spans) = 0, text, aggregate({pieces}, cast('' as binary), (kept, piece) -> concat(kept, piece))) as kept",
    )


DIGESTS = (
    "doc_id",
    "n_bytes",
    "n_bytes - octet_length(kept) as n_removed",
    "cast(size(spans) as bigint) as n_spans",
    "sha2(kept, 256) as kept_sha256",
)


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256): sums and digests of ``without_repeats``."""
    return without_repeats(docs, length).selectExpr(*DIGESTS)


def op10_remove_repeats(spark: SparkSession, folder: str) -> DataFrame:
    """All documents without strings of 400 bytes that occur elsewhere.

    ``text`` is what is kept; bytes of a character that a cut went through are U+FFFD there,
    while the digest is that of the bytes.
    """
    found = without_repeats(documents(spark, folder))
    return found.selectExpr(*DIGESTS, "make_valid_utf8(cast(kept as string)) as text")
