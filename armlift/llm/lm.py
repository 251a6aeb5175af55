"""Interpolated modified Kneser-Ney scores of whole texts.

Pairs of neighbouring words are counted in Spark: tasks count what they read, deal the
counts into buckets of the first word (a first word that is very common is dealt by both),
and one task per bucket adds them up. The buckets are files of sorted 64-bit hashes beside
their counts in the shared folder; a second table holds, for every word, its count and the
numbers of distinct words around it. Workers map the files into memory and look words up by
binary search, so a worker needs no memory for the model.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from armlift.llm.tables import byte_texts, documents, map_batches
from armlift.llm.words import WordHasher, chunks, joined_hash, mixed
from armlift.session import new_folder, stored

# Hashes of the context before a text and of the token after it.
START, END = np.uint64(1), np.uint64(2)
BUCKET_BYTES = 8_000_000
TOKENS_HELD = 1_000_000
# buckets dealt in one round; more are dealt in two
ROUND_BUCKETS = 2048
# a first word of more than this share of the tokens, or than a bucket's share, is dealt over several buckets
ROUTING_SHARE = 1 / 500
# counts from here on are kept apart
LARGE = 255
PACKED = "bucket int, a binary, a_runs binary, b binary, n binary"


def tokens_of(hasher: WordHasher, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(previous, token, number of tokens per text); every text ends with END and begins after START."""
    words, counts = hasher.words(texts)
    lengths = counts + 1
    ends = np.cumsum(lengths) - 1
    token = np.empty(len(words) + len(texts), np.uint64)
    is_end = np.zeros(len(token), bool)
    is_end[ends] = True
    token[is_end], token[~is_end] = END, words
    previous = np.empty_like(token)
    previous[1:] = token[:-1]
    previous[np.concatenate([[0], ends[:-1] + 1])] = START
    return previous, token, lengths


def bucket_of(a: np.ndarray, b: np.ndarray, n_buckets: int, spread: np.ndarray) -> np.ndarray:
    """Bucket of each pair: by its first word, by both where the first is in ``spread``: sorted, a word once for each of its parts."""
    key = mixed(a ^ np.uint64(0x5851F42D4C957F2D))
    first = np.searchsorted(spread, a)
    parts = np.searchsorted(spread, a, "right") - first
    common = parts > 0
    key[common] ^= mixed(mixed(b[common]) % parts[common].astype(np.uint64))
    return (key % np.uint64(n_buckets)).astype(np.int64)


def summed(*columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows sorted and distinct in all columns but the last, a count, which is added up."""
    *keys, n = columns
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for i, key in enumerate(keys):
        keys[i] = key = key[order]
        new[1:] |= key[1:] != key[:-1]
    first = np.flatnonzero(new)
    return *(key[first] for key in keys), np.add.reduceat(n[order], first) if len(first) else n


def dealt(a: np.ndarray, b: np.ndarray, n: np.ndarray, n_buckets: int, spread: np.ndarray, width: int = 1) -> pa.RecordBatch:
    """One row per bucket (or run of ``width`` buckets) with its counted pairs; repeats of the first word are run lengths."""
    bucket, a, b, n = summed((bucket_of(a, b, n_buckets, spread) // width).astype(np.int32), a, b, n)
    cuts = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]])
    rows = []
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        if hi > lo:
            x = a[lo:hi]
            first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
            runs = np.diff(np.concatenate([first, [hi - lo]])).astype(np.uint32)
            rows.append((int(bucket[lo]), x[first].tobytes(), runs.tobytes(), b[lo:hi].tobytes(), n[lo:hi].tobytes()))
    names = ["bucket", "a", "a_runs", "b", "n"]
    columns = list(zip(*rows)) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], names
    )


def unpacked(rows: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    def column(name: str, kind: type) -> np.ndarray:
        return np.frombuffer(b"".join(rows.column(name).to_pylist()), kind)

    return np.repeat(column("a", np.uint64), column("a_runs", np.uint32)), column("b", np.uint64), column("n", np.int64)


def local_path(folder: str) -> str:
    """Path of the shared folder as tasks open it."""
    parsed = urlparse(folder)
    if parsed.scheme not in ("", "file"):
        raise ValueError(f"the model's files are mapped into memory: {folder} must be a mounted folder")
    return parsed.path


def save(path: str, array: np.ndarray) -> None:
    """Write under another name first: a task that is repeated or lost leaves no half file."""
    partial = f"{path}.{os.getpid()}-{os.urandom(4).hex()}"
    with open(partial, "wb") as file:
        file.write(array.tobytes())
    os.replace(partial, path)


def mapped(path: str, kind: type) -> np.ndarray:
    if not os.path.exists(path) or not os.path.getsize(path):
        return np.empty(0, kind)
    return np.memmap(path, kind, "r")


WORD_FIELDS = np.dtype([("count", "<i8"), ("after1", "<u4"), ("after2", "<u4"), ("after3", "<u4"), ("before", "<u4")])


@dataclass(frozen=True)
class LanguageModel:
    """Where the files are, and the few numbers that hold for all words."""

    folder: str
    n_buckets: int
    spread: np.ndarray
    tokens: int
    kinds: int
    pair_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    pair_kinds: int
    word_counts: tuple[int, int, int]


def discounts(n: list[int]) -> tuple[float, float, float]:
    """The three discounts from the numbers of things counted once, twice, three and four times.

    A number that is missing or gives a discount outside 0 .. k leaves half of k.
    """
    found = []
    y = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else None
    for k in (1, 2, 3):
        value = k - (k + 1) * y * n[k] / n[k - 1] if y is not None and n[k - 1] else None
        found.append(value if value is not None and 0 < value < k else k / 2)
    return tuple(found)


def discounted(n: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.maximum(n - np.array([0.0, *d])[np.minimum(n, 3)], 0)


def common_words(docs: DataFrame, n_buckets: int) -> np.ndarray:
    """Hashes of the first words that need spreading, sorted, each as often as it has parts.

    All texts are counted. A word is left out of a count of many tokens where it has under a
    quarter of the share that matters, so sums are short by less than that quarter: every word
    over the share is found.
    """
    limit = min(ROUTING_SHARE, 1 / n_buckets)

    def often(held: list) -> pa.RecordBatch:
        word, n = np.unique(np.concatenate(held), return_counts=True)
        total = int(n.sum())
        kept = n >= limit / 4 * total
        words = pa.array([*word[kept].view(np.int64).tolist(), None], pa.int64())
        return pa.RecordBatch.from_arrays([words, pa.array([*n[kept].tolist(), total], pa.int64())], ["word", "n"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held, size = WordHasher(), [], 0
        for batch in batches:
            for some in chunks(byte_texts(batch)):
                previous, _, _ = tokens_of(hasher, some)
                held.append(previous)
                size += len(previous)
                if size >= TOKENS_HELD:
                    yield often(held)
                    held, size = [], 0
        if held:
            yield often(held)

    counts = map_batches(docs.select("text"), hashed, "word bigint, n bigint")
    totals = stored(counts.groupBy("word").agg(F.sum("n").alias("n")))
    # the row without a word has the number of all tokens
    tokens = totals.where("word is null").agg(F.sum("n")).first()[0] or 0
    rows = totals.where(f"word is not null and n >= {0.75 * limit * tokens}").collect()
    parts = [max(2, int(np.ceil(r.n / (limit * tokens) + 0.25))) for r in rows]
    return np.sort(np.repeat(np.array([r.word for r in rows], np.int64).view(np.uint64), np.array(parts, np.int64)))


def count_pairs(docs: DataFrame, n_buckets: int, spread: np.ndarray) -> DataFrame:
    """Counted pairs of all texts, dealt into buckets (several rows per bucket)."""
    width = -(-n_buckets // ROUND_BUCKETS)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held, size = WordHasher(), [], 0
        for batch in batches:
            for some in chunks(byte_texts(batch)):
                previous, token, _ = tokens_of(hasher, some)
                held.append((previous, token))
                size += len(token)
                if size >= TOKENS_HELD:
                    yield packed(held, width)
                    held, size = [], 0
        if held:
            yield packed(held, width)

    def packed(held: list, width: int) -> pa.RecordBatch:
        a, b = (np.concatenate(x) for x in zip(*held))
        return dealt(a, b, np.ones(len(a), np.int64), n_buckets, spread, width)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield dealt(*unpacked(batch), n_buckets, spread)

    rows = map_batches(docs.select("text"), counted, PACKED)
    return rows if width == 1 else map_batches(rows.repartition("bucket"), again, PACKED)


def train(docs: DataFrame) -> LanguageModel:
    """Count all texts (null: empty) and write the model's files to the shared folder.

    The table of texts may be empty: the model then gives every word the same chance.
    """
    spark = docs.sparkSession
    folder = local_path(new_folder(spark))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_buckets = max(8, -(-size // BUCKET_BYTES))
    spread = common_words(docs, n_buckets)

    def merge(key: tuple, rows: pa.Table) -> pa.Table:
        """Write one bucket of pairs; pass on what its words need, dealt by word."""
        a, b, n = summed(*unpacked(rows))
        pair = joined_hash(a, b)
        order = np.argsort(pair)
        pair, times = pair[order], n[order]
        os.makedirs(folder, exist_ok=True)
        large = times >= LARGE
        bucket = key[0].as_py()
        save(f"{folder}/pairs-{bucket}", pair)
        save(f"{folder}/counts-{bucket}", np.minimum(times, LARGE).astype(np.uint8))
        save(f"{folder}/large-{bucket}", pair[large])
        save(f"{folder}/large-counts-{bucket}", times[large])
        words, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        first, second = at[: len(a)], at[len(a) :]
        fields = np.zeros(len(words), WORD_FIELDS)
        seen = lambda rows, weights=None: np.bincount(rows, weights, len(words))
        fields["count"] = seen(first, n)
        fields["count"][words == END] = seen(second, n)[words == END]
        for name, some in (("after1", n == 1), ("after2", n == 2), ("after3", n >= 3)):
            fields[name] = seen(first[some])
        fields["before"] = seen(second)
        part = (mixed(words) % np.uint64(n_buckets)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(n_buckets + 1))
        kept = [p for p in range(n_buckets) if cuts[p] < cuts[p + 1]]
        slices = [order[cuts[p] : cuts[p + 1]] for p in kept]
        once = [int((n == k).sum()) for k in (1, 2, 3, 4)]
        return pa.table(
            {
                "part": pa.array([*kept, -1], pa.int32()),
                "words": pa.array([*(words[s].tobytes() for s in slices), b""], pa.binary()),
                "fields": pa.array([*(b"".join(fields[s][f].tobytes() for f in WORD_FIELDS.names) for s in slices), b""], pa.binary()),
                "stats": pa.array([*([None] * len(kept)), [int(n.sum()), len(n), *once]], pa.list_(pa.int64())),
            }
        )

    dealt_pairs = count_pairs(docs, n_buckets, spread)
    passed = stored(
        dealt_pairs.groupBy("bucket").applyInArrow(merge, "part int, words binary, fields binary, stats array<bigint>")
    )
    # one row of six numbers per bucket
    pairs = passed.where("part = -1").selectExpr("posexplode(stats)").groupBy("pos").agg(F.sum("col")).collect()
    tokens, pair_kinds, *pair_once = [dict(pairs).get(i, 0) for i in range(6)]

    def merge_words(key: tuple, rows: pa.Table) -> pa.Table:
        """Write one bucket of the word table."""
        found, parts = [], []
        for words, fields in zip(rows.column("words").to_pylist(), rows.column("fields").to_pylist()):
            some = np.frombuffer(words, np.uint64)
            part, start = np.zeros(len(some), WORD_FIELDS), 0
            for name in WORD_FIELDS.names:
                part[name] = np.frombuffer(fields, WORD_FIELDS[name], len(some), start)
                start += WORD_FIELDS[name].itemsize * len(some)
            found.append(some)
            parts.append(part)
        words, at = np.unique(np.concatenate(found), return_inverse=True)
        every, fields = np.concatenate(parts), np.zeros(len(words), WORD_FIELDS)
        for name in WORD_FIELDS.names:
            fields[name] = np.rint(np.bincount(at, every[name], len(words)))
        os.makedirs(folder, exist_ok=True)
        save(f"{folder}/words-{key[0].as_py()}", words)
        save(f"{folder}/fields-{key[0].as_py()}", fields)
        before = fields["before"]
        once = [int((before == k).sum()) for k in (1, 2, 3, 4)] + [int((before >= 3).sum())]
        return pa.table({"stats": pa.array([[int((words != START).sum()), *once]], pa.list_(pa.int64()))})

    merged = passed.where("part >= 0").groupBy("part").applyInArrow(merge_words, "stats array<bigint>")
    words = stored(merged).selectExpr("posexplode(stats)").groupBy("pos").agg(F.sum("col")).collect()
    kinds, *once, thrice = [dict(words).get(i, 0) for i in range(6)]
    return LanguageModel(
        folder, n_buckets, spread, tokens, kinds, discounts(pair_once), discounts(once), pair_kinds, (once[0], once[1], thrice)
    )


class Reader:
    """A model's files, mapped into memory."""

    def __init__(self, model: LanguageModel) -> None:
        self.model = model
        numbers = range(model.n_buckets)
        path = f"{model.folder}/{{}}-{{}}".format
        self.pairs = [mapped(path("pairs", i), np.uint64) for i in numbers]
        self.counts = [mapped(path("counts", i), np.uint8) for i in numbers]
        self.large = [mapped(path("large", i), np.uint64) for i in numbers]
        self.large_counts = [mapped(path("large-counts", i), np.int64) for i in numbers]
        self.words = [mapped(path("words", i), np.uint64) for i in numbers]
        self.fields = [mapped(path("fields", i), WORD_FIELDS) for i in numbers]
        self.confirm()

    def confirm(self) -> None:
        """Stop where files are missing, cut short or from another model: scores would be wrong without a sign."""
        pairs, counts, words, fields, large, large_counts = (
            sum(map(len, arrays)) for arrays in (self.pairs, self.counts, self.words, self.fields, self.large, self.large_counts)
        )
        # the word table may hold the start of texts, which is no kind of token
        if not (pairs == counts == self.model.pair_kinds and words == fields and 0 <= words - self.model.kinds <= 1 and large == large_counts):
            self.refuse()

    def refuse(self) -> None:
        raise FileNotFoundError(f"the model's files in {self.model.folder} are not all there, or not whole, on this machine")

    @staticmethod
    def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the wanted keys in a sorted array, and whether they are there."""
        if not len(keys):
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return at, keys[at] == wanted

    def word_fields(self, words: np.ndarray) -> np.ndarray:
        found = np.zeros(len(words), WORD_FIELDS)
        bucket = (mixed(words) % np.uint64(self.model.n_buckets)).astype(np.int64)
        for i in np.unique(bucket):
            rows = np.flatnonzero(bucket == i)
            at, there = self.find(self.words[i], words[rows])
            found[rows[there]] = self.fields[i][at[there]]
        return found

    def pair_counts(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        found = np.zeros(len(a), np.int64)
        bucket, pair = bucket_of(a, b, self.model.n_buckets, self.model.spread), joined_hash(a, b)
        order = np.lexsort([pair, bucket])
        cuts = np.searchsorted(bucket[order], np.arange(self.model.n_buckets + 1))
        for i in range(self.model.n_buckets):
            rows = order[cuts[i] : cuts[i + 1]]
            if len(rows):
                at, there = self.find(self.pairs[i], pair[rows])
                times = np.where(there, self.counts[i][at].astype(np.int64) if len(self.counts[i]) else 0, 0)
                big = times == LARGE
                if big.any():
                    at, there = self.find(self.large[i], pair[rows[big]])
                    if not there.all():
                        self.refuse()
                    times[big] = self.large_counts[i][at]
                found[rows] = times
        return found

    def scores(self, hasher: WordHasher, texts: list[bytes]) -> dict[str, np.ndarray]:
        """Per text: n_tokens, n_known, base_score and score."""
        model = self.model
        previous, token, lengths = tokens_of(hasher, texts)
        kinds, at = np.unique(np.concatenate([previous, token]), return_inverse=True)
        fields = self.word_fields(kinds)
        context, word = fields[at[: len(token)]], fields[at[len(token) :]]
        d, e = model.pair_discounts, model.word_discounts
        left = sum(x * n for x, n in zip(e, model.word_counts)) / max(model.pair_kinds, 1) if model.pair_kinds else 1.0
        by_word = discounted(word["before"].astype(np.int64), e) / max(model.pair_kinds, 1) + left / (model.kinds + 1)
        seen = np.maximum(context["count"], 1)
        kept = d[0] * context["after1"] + d[1] * context["after2"] + d[2] * context["after3"]
        back = np.where(context["count"] > 0, kept / seen, 1.0)
        chance = discounted(self.pair_counts(previous, token), d) / seen + back * by_word
        times = word["count"]
        base = np.log10((times + 1) / (model.tokens + 1 * (model.kinds + 1)))
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        total = lambda values: np.add.reduceat(values, starts)
        return {
            "n_tokens": lengths.astype(np.int64),
            "n_known": total((times > 0).astype(np.int64)),
            "base_score": total(base),
            "score": total(np.log10(chance)),
        }


def with_scores(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Add n_tokens, n_known, train_tokens, base_score and score (log10) of the whole text to every row."""
    added = [
        StructField("n_tokens", LongType()), StructField("n_known", LongType()), StructField("train_tokens", LongType()),
        StructField("base_score", DoubleType()), StructField("score", DoubleType()),
    ]
    names = [f.name for f in added]
    kept = [c for c in docs.columns if c not in names]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, reader = WordHasher(), Reader(model)
        for batch in batches:
            found = [
                reader.scores(hasher, some)
                for some in chunks(byte_texts(batch))
            ]
            columns = {c: np.concatenate([f[c] for f in found]) for c in names if c != "train_tokens"}
            columns["train_tokens"] = np.full(len(batch), model.tokens)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(columns[c]) for c in names)], [*kept, *names])

    rows = docs.select(*[f"`{c}`" for c in kept])
    return map_batches(rows, scored, StructType([docs.schema[c] for c in kept] + added))


def held_out(column: str = "doc_id") -> str:
    return f"coalesce(crc32(cast(cast({column} as string) as binary)) % 7 = 2, false)"


def op2_score_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of all documents by a model of those that are not held out (about six sevenths)."""
    docs = documents(spark, folder).select("doc_id", "text")
    model = train(docs.where(f"not {held_out()}").select("text"))
    return with_scores(docs, model).selectExpr(
        "doc_id", f"{held_out()} as held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )
