"""Words of many texts as arrays of 64-bit hashes, for work on whole batches in numpy."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

# Odd multiplier of the word hash and its inverse modulo 2^64.
MULTIPLIER = 0x9E3779B97F4A7C15
INVERSE = pow(MULTIPLIER, -1, 2**64)
CHUNK_BYTES = 500_000

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, *range(9, 14)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def joined_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of an ordered pair of hashes."""
    return mixed(left * np.uint64(MULTIPLIER) + mixed(right + np.uint64(0x632BE59BD9B4E019)))


class WordHasher:
    """Hashes of the words of texts, A-Z lower-cased."""

    def __init__(self) -> None:
        self.powers = self.inverses = np.empty(0, np.uint64)

    def prepare(self, size: int) -> None:
        if len(self.powers) < size:
            size = max(2 * len(self.powers), size, 2**16)
            for name, factor in (("powers", MULTIPLIER), ("inverses", INVERSE)):
                steps = np.full(size, factor, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words in order, and the number of words of each text."""
        flat = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        self.prepare(len(flat))
        space = IS_SPACE[flat]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if not space[0]:
            edge = np.concatenate([[0], edge])
        starts, ends = edge[::2], edge[1::2]
        sums = np.zeros(len(flat) + 1, np.uint64)
        np.cumsum((LOWER[flat].astype(np.uint64) + np.uint64(1)) * self.powers[: len(flat)], out=sums[1:])
        hashes = mixed((sums[ends] - sums[starts]) * self.inverses[starts])
        limits = np.cumsum([len(t) + 1 for t in texts])
        upto = np.searchsorted(starts, limits)
        return hashes, np.diff(np.concatenate([[0], upto]))


def chunks(texts: Iterable[bytes], size: int = CHUNK_BYTES) -> Iterator[list[bytes]]:
    """Runs of texts of about ``size`` bytes; a longer text is a run of its own."""
    some, total = [], 0
    for text in texts:
        if some and total + len(text) > size:
            yield some
            some, total = [], 0
        some.append(text)
        total += len(text)
    if some:
        yield some
