"""Spelling variants of words: pairs one edit apart, and the common form of each word.

Two words differ by one inserted, deleted or replaced code point exactly when their common
prefix and common suffix together reach the longer length minus one. Then one of the two
covers half of the shorter word, so words meet in tiles: those of two neighbouring lengths
that share the first half, and those that share the last half. A tile is compared densely, in
pairs of blocks: words are rows of a padded matrix of code points, and the lengths of common
prefix and suffix of all pairs of two blocks are counted column by column.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from armlift.llm.tables import documents, map_batches
from armlift.llm.tiles import block_pairs, in_runs, runs
from armlift.session import release, stored

MIN_LENGTH = 7
MIN_COUNT = 2
# a form occurs this many times as often as its variant
TIMES = 10
# a code point is deleted from a run whose hash this number divides
DELETION = 31
BLOCK_ROWS = 512
# distinct words counted by a task before they are passed on
HELD_WORDS = 200_000

LETTERS = r"[A-Za-zÀ-ÿ]"
TO_LOWER = {c: c + 32 for c in range(65, 91)}


def counted_words(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """(word, n): runs of letters of all texts with at least ``min_length`` code points after the planted deletions."""
    # a maximal run: nothing shorter can be long enough
    long_run = re.compile(f"{LETTERS}{{{min_length},}}")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def passed_on() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"]
            )

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                prefix = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for run, n in Counter(long_run.findall(text.as_py() or "")).items():
                    word = run.translate(TO_LOWER)
                    code = zlib.crc32(word.encode(), prefix)
                    if not code % DELETION:
                        place = code % len(word)
                        word = word[:place] + word[place + 1 :]
                        if len(word) < min_length:
                            continue
                    counts[word] += n
                if len(counts) >= HELD_WORDS:
                    yield passed_on()
                    counts.clear()
        yield passed_on()

    parts = map_batches(docs.select("doc_id", "text"), counted, "word string, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def tiled(words: DataFrame) -> DataFrame:
    """(tile, short, word, n): every word in its four tiles, as one of the shorter or of the longer length.

    A tile is the shorter length, the end of the word that is compared, and half of the
    shorter length of code points at that end.
    """
    places = [
        f"named_struct('short', {short}, 'tile', concat_ws(' ', '{end}', length(word) - {less}, "
        f"{side}(word, cast((length(word) - {less}) div 2 as int))))"
        for less, short in ((0, "true"), (1, "false"))
        for end, side in (("first", "left"), ("last", "right"))
    ]
    return words.selectExpr("word", "n", f"inline(array({', '.join(places)}))")


def code_points(words: list[bytes]) -> np.ndarray:
    """One row of Latin-1 code points per word, padded with 0 at the end."""
    width = max(map(len, words), default=0)
    return np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width)


def from_end(words: list[bytes]) -> np.ndarray:
    return code_points([w[::-1] for w in words])


def common_lengths(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Common leading code points of all pairs of rows, the padding left out."""
    length = np.zeros((len(left), len(right)), np.uint16)
    alike = np.ones(length.shape, bool)
    for column in range(min(left.shape[1], right.shape[1])):
        alike &= left[:, column, None] == right[None, :, column]
        if not alike.any():
            break
        length += alike
    return length


def one_edit(left: list[bytes], right: list[bytes], first_half: bool) -> np.ndarray:
    """Pairs one edit apart, for words of one length on each side, the right ones as long or one longer.

    Pairs that share both halves meet in two tiles; they count in that of the first half.
    """
    prefix = common_lengths(code_points(left), code_points(right))
    suffix = common_lengths(from_end(left), from_end(right))
    near = prefix.astype(np.int32) + suffix >= len(right[0]) - 1
    if len(left[0]) == len(right[0]):
        near &= prefix < len(left[0])
    if not first_half:
        near &= prefix < len(left[0]) // 2
    return near


def near_in_runs(placed: DataFrame, partitions: int) -> DataFrame:
    """(word, n_near, best): near words found in each run, and the most frequent of them as (-n, word)."""

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches):
            side, short = run["_side"].to_numpy(), run["short"].to_numpy()
            words = [w.encode("latin-1") for w in run["word"].to_pylist()]
            n, first_half = run["n"].to_numpy(), run["tile"][0].as_py().startswith("first")
            inside = not side.any()
            found = []
            # words of the shorter length meet each other and those of the longer one
            for a, b in ((0, 0),) if inside else ((0, 1), (1, 0)):
                shorter = np.flatnonzero((side == a) & short)
                for long in (False, True):
                    other = np.flatnonzero((side == b) & (short != long))
                    # pairs of the shorter length lie in both orders: one is enough
                    if not len(shorter) or not len(other) or (not long and a > b):
                        continue
                    near = one_edit([words[i] for i in shorter], [words[i] for i in other], first_half)
                    if inside and not long:
                        near = np.triu(near, 1)
                    x, y = np.nonzero(near)
                    found += [(shorter[x], other[y]), (other[y], shorter[x])]
            if not found:
                continue
            mine, near = (np.concatenate(f) for f in zip(*found))
            if not len(mine):
                continue
            order = np.lexsort([np.array(words)[near], -n[near], mine])
            mine, near = mine[order], near[order]
            each, start, count = np.unique(mine, return_index=True, return_counts=True)
            best = near[start]
            column = run["word"].combine_chunks()
            yield pa.RecordBatch.from_arrays(
                [column.take(pa.array(each)), pa.array(count), pa.array(n[best]), column.take(pa.array(best))],
                ["word", "n_near", "near_n", "near_word"],
            )

    schema = "word string, n_near bigint, near_n bigint, near_word string"
    found = map_batches(in_runs(placed, partitions), compared, schema)
    return found.groupBy("word").agg(
        F.sum("n_near").alias("n_near"), F.min(F.expr("struct(-near_n as less, near_word as word)")).alias("best")
    )


def with_roots(forms: DataFrame) -> DataFrame:
    """Add ``root``: the last word reached from ``word`` through ``form``, the word itself without one.

    Every step is to a word at least TIMES as frequent, so the number of doubling rounds follows
    from the highest count.
    """
    highest = forms.agg(F.max("n")).first()[0] or 1
    steps, reached = 1, stored(forms.where("form is not null").selectExpr("word as at", "form as root"))
    while TIMES**steps <= highest:
        further = reached.selectExpr("at as root", "root as next")
        doubled = stored(reached.join(further, "root", "left").selectExpr("at", "coalesce(next, root) as root"))
        release(reached)
        steps, reached = 2 * steps, doubled
    return forms.join(reached.withColumnRenamed("at", "word"), "word", "left").selectExpr(
        "word", "n", "n_near", "form", "form_n", "coalesce(root, word) as root"
    )


def spelling_variants(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of the distinct words of all texts of ``docs`` (doc_id, text).

    Words are runs of Latin letters, A-Z lower-cased, with at least ``min_length`` code points
    and ``min_count`` occurrences; one in 31 runs of a document loses a code point, as its
    hash says. ``form`` is the most frequent near word (ties: smallest in code-point order)
    if it is TIMES as frequent, else null. Null and empty texts have no words; a null doc_id is
    spelled as an empty text in the hash; rows that repeat count each; no documents give no rows.
    Further columns are not read. ``min_length`` is 3 at least.
    """
    if min_length < 3:
        raise ValueError("halves of words of under three code points are empty")
    words = stored(counted_words(docs, min_length).where(F.col("n") >= min_count))
    placed, partitions = block_pairs(tiled(words), ["tile"], ["short", "word", "n"], BLOCK_ROWS)
    found = near_in_runs(placed, partitions)
    form = f"if(-best.less >= {TIMES} * n, best.word, null)"
    forms = words.join(found, "word", "left").selectExpr(
        "word", "n", "coalesce(n_near, 0L) as n_near", f"{form} as form", f"if(-best.less >= {TIMES} * n, -best.less, null) as form_n"
    )
    return with_roots(stored(forms))


def op13_group_spellings(spark: SparkSession, folder: str) -> DataFrame:
    """Spelling variants of the words of all documents."""
    return spelling_variants(documents(spark, folder)).select("word", "form", "root", "n", "n_near", "form_n")
