"""Near-duplicate groups by min-max hashing.

A text is its set of distinct word shingles. Every hash function is evaluated once per
shingle and gives two values of the signature, its minimum and its maximum; both agree
between two sets with probability equal to their Jaccard similarity, so half the
evaluations do. Bands of four values (two minima and two maxima of four functions) name
buckets. Equal sets are one class from the start; in a bucket, classes are linked to
leaders instead of to each other; classes that leaders leave apart are compared by longer
signatures inside the task that holds a block of the bucket, and only pairs that may be links
leave it. Every link is confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from armlift.llm.components import components
from armlift.llm.tables import byte_texts, documents, map_batches
from armlift.llm.tiles import block_pairs, in_runs, runs
from armlift.llm.words import WordHasher, chunks, joined_hash, mixed
from armlift.session import stored

# 64 functions give 128 values in 32 bands: a pair at the threshold of 0.8 shares no band
# with probability (1 - 0.8^4)^32, about 5 in 10^8
FUNCTIONS = 64
BANDS = 32
# four bits of every value are kept: a pair at the threshold differs in 24 of 128 places,
# with deviation 4.4; 49 or more are 5.6 deviations away
PLACES_APART = 49
# classes that no leader settles get a longer signature, two bits of each of 4096 values: a
# pair at the threshold differs in 614.4 places, with deviation 22.9; 729 is 5 deviations away
FINE_FUNCTIONS = 2048
FINE_PLACES_APART = 729
# members that are confirmed against one leader in one group, and bytes of their texts
BLOCK_ROWS = 500
BLOCK_BYTES = 16_000_000
# classes of a bucket that meet in one block
MET_ROWS = 400

RNG = np.random.default_rng(20)
FACTORS = RNG.integers(0, 2**63, FUNCTIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = RNG.integers(0, 2**63, FUNCTIONS, dtype=np.uint64)
FINE_FACTORS = RNG.integers(0, 2**63, FINE_FUNCTIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FINE_SHIFTS = RNG.integers(0, 2**63, FINE_FUNCTIONS, dtype=np.uint64)


def shingle_sets(hasher: WordHasher, texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer words than ``width`` make one shingle, none make none."""
    words, counts = hasher.words(texts)
    ends = np.cumsum(counts)
    rolled = words.copy()
    for step in range(1, width):
        upto = max(len(words) - step, 0)
        rolled[:upto] = joined_hash(rolled[:upto], words[step : step + upto])
    sets = []
    for end, count in zip(ends.tolist(), counts.tolist()):
        start = end - count
        if count >= width:
            sets.append(np.unique(rolled[start : end - width + 1]))
        elif count:
            whole = words[start : start + 1]
            for i in range(start + 1, end):
                whole = joined_hash(whole, words[i : i + 1])
            sets.append(whole.copy())
        else:
            sets.append(np.empty(0, np.uint64))
    return sets


def signature(
    shingles: np.ndarray, factors: np.ndarray = FACTORS, shifts: np.ndarray = SHIFTS
) -> tuple[np.ndarray, np.ndarray]:
    """Minimum and maximum of the shingles under every function."""
    low = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(len(factors), np.uint64)
    width = 2**18 // len(factors)
    for start in range(0, len(shingles), width):
        values = factors[:, None] * shingles[start : start + width] + shifts[:, None]
        low = np.minimum(low, values.min(axis=1))
        high = np.maximum(high, values.max(axis=1))
    return low, high


def packed(values: np.ndarray, bits: int) -> list[int]:
    """Some middle bits of each value, packed into 64-bit numbers; the lowest bits depend on few bits of a shingle."""
    each = 64 // bits
    places = (values >> np.uint64(40) & np.uint64(2**bits - 1)).reshape(-1, each)
    return np.bitwise_or.reduce(places << (np.arange(each, dtype=np.uint64) * np.uint64(bits)), axis=1).view(np.int64).tolist()


def banded(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """One key per band: the minima of two functions and the maxima of the next two."""
    first = np.arange(BANDS) * 2
    parts = (low[first], low[first + 1], high[(first + 2) % FUNCTIONS], high[(first + 3) % FUNCTIONS])
    keys = mixed(np.arange(BANDS, dtype=np.uint64))
    for part in parts:
        keys = joined_hash(keys, part)
    return keys


def signed_rows(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, text_key, bytes, n_shingles, set_key, bits, bands) of every row; no shingles give null keys."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            sizes, keys, bits, bands = [], [], [], []
            for some in chunks(byte_texts(batch)):
                for shingles in shingle_sets(hasher, some, width):
                    sizes.append(len(shingles))
                    if not len(shingles):
                        keys.append(None), bits.append(None), bands.append(None)
                        continue
                    sums = [mixed(shingles).sum(), mixed(shingles ^ np.uint64(0x9E3779B97F4A7C15)).sum()]
                    keys.append(np.array(sums, np.uint64).tobytes())
                    low, high = signature(shingles)
                    bits.append([*packed(low, 4), *packed(high, 4)])
                    bands.append(banded(low, high).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "text_key", "bytes")), pa.array(sizes, pa.int64()),
                 pa.array(keys, pa.binary()), pa.array(bits, pa.list_(pa.int64())), pa.array(bands, pa.list_(pa.int64()))],
                ["doc_id", "text_key", "bytes", "n_shingles", "set_key", "bits", "bands"],
            )

    keyed = docs.selectExpr("doc_id", "xxhash64(text) as text_key", "octet_length(text) as bytes", "text")
    return map_batches(keyed, signed,
        f"doc_id {kind}, text_key bigint, bytes int, n_shingles bigint, set_key binary, bits array<bigint>, bands array<bigint>",
    )


def alike(percent: int) -> str:
    """SQL for a pair that may reach the similarity: by set sizes and by the places where the signatures differ."""
    differ = [f"(bits_a[{i}] ^ bits_b[{i}])" for i in range(8)]
    low = 0x1111111111111111
    places = " + ".join(
        f"bit_count(({d} | shiftright({d}, 1) | shiftright({d}, 2) | shiftright({d}, 3)) & {low}L)" for d in differ
    )
    return f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b) and {places} < {PLACES_APART}"


def alike_in_runs(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b, bytes): classes of different groups that may be linked, each pair in the first bucket that both share.

    ``rows`` (band, place, class, component, bytes, n_shingles, bits, fine, bands) are those of open
    buckets; a bucket of any size is compared block by block, and no other pair leaves a task.
    """
    carried = ("place", "component", "bytes", "n_shingles", "bits", "fine", "bands")
    paired, partitions = block_pairs(rows, ["band"], ["class"], MET_ROWS, carried)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches):
            side = run["_side"].to_numpy()
            i = np.flatnonzero(side == 0)
            j = np.flatnonzero(side == 1) if side.any() else i
            group, size, name = (run[c].to_numpy() for c in ("component", "n_shingles", "class"))
            small, large = np.minimum(size[i][:, None], size[j]), np.maximum(size[i][:, None], size[j])
            near = (group[i][:, None] != group[j]) & (100 * small >= percent * large)
            if j is i:
                near = np.triu(near, 1)
            x, y = np.nonzero(near)
            a, b = i[x], j[y]
            if not len(a):
                continue
            bits, fine, bands = (stacked(run[c].combine_chunks()) for c in ("bits", "fine", "bands"))
            for values, each, most in ((bits, 4, PLACES_APART), (fine, 2, FINE_PLACES_APART)):
                kept = []
                for start in range(0, len(a), 8192):
                    some = slice(start, start + 8192)
                    kept.append(places_apart(values[a[some]] ^ values[b[some]], each) < most)
                kept = np.concatenate([np.empty(0, bool), *kept])
                a, b = a[kept], b[kept]
            first = (bands[a] == bands[b]).argmax(axis=1) == run["place"].to_numpy()[a]
            a, b = a[first], b[first]
            if len(a):
                columns = [name[a], name[b], run["bytes"].to_numpy()[b]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a", "b", "bytes"])

    return map_batches(in_runs(paired, partitions), compared, "a bigint, b bigint, bytes int")


def stacked(lists: pa.ListArray) -> np.ndarray:
    """Lists of one length as the rows of a matrix."""
    return lists.flatten().to_numpy().reshape(len(lists), -1)


def places_apart(differ: np.ndarray, each: int) -> np.ndarray:
    """Values of ``each`` bits that are not 0, by row of 64-bit numbers."""
    differ = differ.view(np.uint64)
    marked = differ.copy()
    for step in range(1, each):
        marked |= differ >> np.uint64(step)
    lowest = np.uint64(sum(1 << k for k in range(0, 64, each)))
    return np.bitwise_count(marked & lowest).sum(axis=1, dtype=np.int64)


def with_long_signatures(rows: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """Add ``fine``, the longer signature of the class."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            found = []
            for some in chunks(byte_texts(batch)):
                for shingles in shingle_sets(hasher, some, width):
                    low, high = signature(shingles, FINE_FACTORS, FINE_SHIFTS)
                    found.append([*packed(low, 2), *packed(high, 2)])
            yield pa.RecordBatch.from_arrays([batch.column("class"), pa.array(found, pa.list_(pa.int64()))], ["class", "fine"])

    wanted = texts.join(rows.select("class").distinct(), "class").select("class", "text")
    return rows.join(map_batches(wanted, signed, "class bigint, fine array<bigint>"), "class")


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b, bytes) of classes whose full sets reach the similarity; bytes is the size of the second text.

    Pairs are grouped by their first class, in blocks of bounded size; its text comes once
    per block, those of the others once per pair.
    """
    pairs = stored(pairs)
    counts = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    wished = f"cast(greatest(ceil(n / {BLOCK_ROWS}), ceil(bytes / {BLOCK_BYTES})) as int)"
    blocks = stored(counts.selectExpr("a as leader", f"{wished} as blocks"))
    members = (
        pairs.join(blocks, F.expr("a = leader"))
        .selectExpr("a as of_leader", "b as class", "cast(pmod(xxhash64(b), blocks) as int) as of_block")
        .join(texts, "class")
    )
    leaders = blocks.join(texts.selectExpr("class as leader", "text as leader_text"), "leader").selectExpr(
        "leader", "explode(sequence(0, blocks - 1)) as block", "leader_text"
    )

    hasher = WordHasher()  # one per task; its tables are made at first use

    def check(left: pa.Table, right: pa.Table) -> pa.Table:
        found_a, found_b = [], []
        if left.num_rows and right.num_rows:
            leader = shingle_sets(hasher, [left.column("leader_text")[0].as_py().encode()], width)[0]
            name, names = left.column("leader")[0].as_py(), right.column("class").to_pylist()
            at = 0
            for some in chunks(right.column("text").cast(pa.binary()).to_pylist()):
                for shingles in shingle_sets(hasher, some, width):
                    shared = len(np.intersect1d(leader, shingles, assume_unique=True))
                    if 100 * shared >= percent * (len(leader) + len(shingles) - shared):
                        found_a.append(name)
                        found_b.append(names[at])
                    at += 1
        return pa.table({"a": pa.array(found_a, pa.int64()), "b": pa.array(found_b, pa.int64())})

    return (
        leaders.groupBy("leader", "block")
        .cogroup(members.groupBy("of_leader", "of_block"))
        .applyInArrow(check, "a bigint, b bigint")
    )


def still_open(shared: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows of the buckets that hold classes of more than one group, with the group."""
    labelled = shared.join(groups.withColumnRenamed("node", "class"), "class", "left").selectExpr(
        "band", "place", "class", "coalesce(component, class) as component"
    )
    split = labelled.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    return labelled.join(split.where("lo < hi").select("band"), "band")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, text_key, group_no) for every row of ``docs`` (doc_id, text).

    Texts are linked when 100 * shared >= percent * all of their distinct ``width``-word
    shingles. ``component_id`` is the smallest doc_id of the linked group, ``kept`` marks
    it; ``text_key`` is a hash of the text, ``group_no`` a number of the group, null for a text
    without shingles. Null, empty and blank texts have no shingles and stand alone. Rows that repeat get
    the same result each; a null doc_id is never the smallest one, and a group of nothing
    else has a null component_id and is kept.
    """
    signed = stored(signed_rows(docs.select("doc_id", "text"), width))
    classes = stored(
        signed.where("set_key is not null")
        .groupBy("set_key")
        .agg(
            F.min("doc_id").alias("first_id"),
            F.min(F.struct("doc_id", "text_key")).alias("sample"),
            F.first("n_shingles").alias("n_shingles"),
            F.max("bytes").alias("bytes"),
            F.first("bits").alias("bits"),
            F.first("bands").alias("bands"),
        )
        .withColumn("class", F.monotonically_increasing_id())
    )
    rows = classes.selectExpr("class", "posexplode(bands) as (place, band)")
    facts = classes.select("class", "bytes", "n_shingles", "bits")
    sizes = rows.groupBy("band").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    shared = stored(rows.join(sizes, "band"))

    # texts of the classes that share a bucket, found by the row that stands for the class
    wanted = shared.select("class").distinct().join(classes.select("class", "sample"), "class")
    named = docs.selectExpr("doc_id as _doc", "xxhash64(text) as _key", "text")
    texts = stored(
        wanted.join(named, F.expr("sample.doc_id <=> _doc and sample.text_key = _key"))
        .groupBy("class")
        .agg(F.first("text").alias("text"))
    )

    # every class tries two leaders of its buckets: the class that meets most others in all of its own, and the smallest
    central = shared.groupBy("class").agg(F.sum("members").alias("meets"))
    rows = shared.join(central.join(facts, "class"), "class")
    leaders = rows.groupBy("band").agg(
        *[F.expr(f"min(named_struct('rank', {rank}, 'leader', class, 'n', n_shingles, 'bits', bits)) as {side}")
          for side, rank in (("central", "-meets"), ("smallest", "0L"))]
    )
    tried = (
        rows.join(leaders, "band")
        .selectExpr("class", "bytes", "n_shingles as n_a", "bits as bits_a", "posexplode(array(central, smallest)) as (turn, lead)")
        .selectExpr("*", "lead.n as n_b", "lead.bits as bits_b")
        .where(f"class <> lead.leader and {alike(percent)}")
        .groupBy("class", "turn")
        .agg(F.min(F.expr("struct(lead.rank, lead.leader)")).alias("best"), F.first("bytes").alias("bytes"))
        .selectExpr("best.leader as a", "class as b", "bytes")
        .distinct()
    )
    links = stored(confirmed(tried, texts, width, percent))
    groups = stored(components(links))
    open_rows = stored(still_open(shared, groups).join(facts, "class"))

    # what leaders did not join
    bands = classes.selectExpr("class", "transform(bands, b -> cast(b & 2147483647 as int)) as bands")
    long_rows = stored(with_long_signatures(open_rows, texts, width).join(bands, "class"))
    more = stored(confirmed(alike_in_runs(long_rows, percent), texts, width, percent))
    if more.take(1):
        groups = stored(components(links.unionByName(more)))

    # smallest doc_id of each group, and of classes that stand alone
    placed = classes.join(groups.withColumnRenamed("node", "class"), "class", "left").selectExpr(
        "set_key", "first_id", "coalesce(component, class) as group_no"
    )
    smallest = placed.groupBy("group_no").agg(F.min("first_id").alias("component_id"))
    known = placed.join(smallest, "group_no").select("set_key", "group_no", "component_id")
    full = signed.select("doc_id", "text_key", "n_shingles", "set_key").join(known, "set_key", "left")
    return full.selectExpr(
        "doc_id",
        "n_shingles",
        "if(set_key is null, doc_id, component_id) as component_id",
        "doc_id <=> if(set_key is null, doc_id, component_id) as kept",
        "text_key",
        "group_no",
    )


def op4_group_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of all documents that share four fifths of their two-word shingles."""
    return near_duplicates(documents(spark, folder), width=2).select("doc_id", "n_shingles", "component_id", "kept")
