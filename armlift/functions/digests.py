"""MD5 of many short texts at once, one numpy lane per text."""

from __future__ import annotations

import hashlib

import numpy as np

# the longest text that fits one block of the digest
ONE_BLOCK = 55
SHIFTS = [[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]]
SINES = [np.uint32(int(abs(np.sin(i + 1)) * 2**32)) for i in range(64)]
START = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]


class Digests:
    """MD5 of texts that share their beginning: ``of(ending)`` gives the digests with one more piece."""

    def __init__(self, beginnings: list[bytes]) -> None:
        self.beginnings = beginnings
        self.lengths = np.array([len(b) for b in beginnings], np.intp)
        n = len(beginnings)
        flat = np.frombuffer(b"".join(b[:ONE_BLOCK].ljust(64, b"\0") for b in beginnings), np.uint8)
        # word by word, so a word of all texts is one run of memory
        self.words = np.ascontiguousarray(flat.reshape(n, 16, 4).transpose(1, 0, 2)).reshape(-1)
        self.scratch = [np.empty(n, np.uint32) for _ in range(6)]

    def of(self, ending: bytes) -> np.ndarray:
        """The first four bytes of each digest as a whole number, then the next four, and so on: (4, texts)."""
        n, sizes = len(self.beginnings), self.lengths + len(ending)
        if not n:
            return np.empty((4, 0), np.uint32)
        ends, rows = np.minimum(self.lengths, ONE_BLOCK - len(ending)), np.arange(n)
        # only the words that the ending reaches are changed
        first, last = int(ends.min()) // 4, (int(ends.max()) + len(ending)) // 4
        touched = self.words[first * 4 * n : (last + 1) * 4 * n].copy()
        for i, byte in enumerate(ending + b"\x80"):
            at = ends + (i - 4 * first)
            touched[(at // 4 * n + rows) * 4 + at % 4] = byte
        words: list[np.ndarray | None] = [None] * 16
        words[:first] = self.words[: first * 4 * n].view("<u4").reshape(-1, n)
        words[first : last + 1] = touched.view("<u4").reshape(-1, n)
        words[14] = (8 * sizes).astype(np.uint32)
        found = np.stack(self.rounds(words)).byteswap()
        for i in np.flatnonzero(sizes > ONE_BLOCK).tolist():
            found[:, i] = np.frombuffer(hashlib.md5(self.beginnings[i] + ending).digest(), ">u4")
        return found

    def rounds(self, words: list[np.ndarray | None]) -> list[np.ndarray]:
        """The four words of the digest state after one block; words that are None are zero."""
        a, b, c, d, f, g = self.scratch
        for line, value in zip((a, b, c, d), START):
            line.fill(value)
        for i in range(64):
            turn = i // 16
            if turn == 0:
                np.bitwise_xor(c, d, out=f)
                np.bitwise_and(f, b, out=f)
                np.bitwise_xor(f, d, out=f)
                which = i
            elif turn == 1:
                np.bitwise_xor(b, c, out=f)
                np.bitwise_and(f, d, out=f)
                np.bitwise_xor(f, c, out=f)
                which = (5 * i + 1) % 16
            elif turn == 2:
                np.bitwise_xor(b, c, out=f)
                np.bitwise_xor(f, d, out=f)
                which = (3 * i + 5) % 16
            else:
                np.bitwise_not(d, out=f)
                np.bitwise_or(f, b, out=f)
                np.bitwise_xor(f, c, out=f)
                which = 7 * i % 16
            np.add(f, a, out=f)
            np.add(f, SINES[i], out=f)
            if words[which] is not None:
                np.add(f, words[which], out=f)
            shift = SHIFTS[turn][i % 4]
            np.left_shift(f, np.uint32(shift), out=g)
            np.right_shift(f, np.uint32(32 - shift), out=f)
            np.bitwise_or(f, g, out=f)
            np.add(f, b, out=f)
            # the state moves on by one place; the old first word is free
            a, b, c, d, f = d, f, b, c, a
        return [line + value for line, value in zip((a, b, c, d), START)]
