"""MD5 of many short texts at once: the first words of the digests, for draws that any engine with MD5 repeats."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable

import numpy as np

# Fixed values of RFC 1321.
_K = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_SHIFTS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_MASK = 0xFFFFFFFF
#: Texts that are hashed together, so that all work stays in a core's cache.
CHUNK = 32_768


class Tails:
    """Texts that end in one of ``tails``; :meth:`digests` gives their digests behind any head."""

    def __init__(self, tails: Iterable[bytes]):
        self.tails = list(tails)
        self._laid: dict[int, list] = {}
        self._work: dict[int, list[np.ndarray]] = {}
        sizes = np.array([len(t) for t in self.tails], dtype=np.int64)
        self._groups = [(int(s), np.flatnonzero(sizes == s)) for s in np.unique(sizes)]

    def digests(self, head: bytes, words: int = 1) -> np.ndarray:
        """An array (``words``, number of tails): the first 32-bit words (one or two) of the MD5 of each text, as they stand in the hexadecimal form."""
        if len(head) not in self._laid:
            self._laid = {len(head): [x for size, at in self._groups for x in self._lay(len(head), size, at)]}
        out = np.empty((words, len(self.tails)), dtype=np.uint32)
        for at, laid in self._laid[len(head)]:
            if laid is None:
                rows = [hashlib.md5(head + self.tails[i]).digest() for i in at]
                out[:, at] = np.frombuffer(b"".join(rows), dtype=">u4").reshape(-1, 4)[:, :words].T
            else:
                out[:, at] = self._hash(head, laid, words)
        return out

    def _lay(self, start: int, size: int, at: np.ndarray):
        """Chunks of tails of one length as the 16 words of a block behind a head of ``start`` bytes: a number where all are alike, else an array."""
        if start + size > 55:  # more than one block
            yield at, None
            return
        for low in range(0, len(at), CHUNK):
            part = at[low : low + CHUNK]
            block = np.zeros((len(part), 64), dtype=np.uint8)
            block[:, start : start + size] = np.frombuffer(b"".join(self.tails[i] for i in part), dtype=np.uint8).reshape(len(part), size)
            block[:, start + size] = 0x80
            block[:, 56:64] = np.frombuffer((8 * (start + size)).to_bytes(8, "little"), dtype=np.uint8)
            columns = np.ascontiguousarray(block.view("<u4").T)
            where = slice(int(part[0]), int(part[-1]) + 1) if int(part[-1]) - int(part[0]) + 1 == len(part) else part
            yield where, [int(c[0]) if (c == c[0]).all() else c for c in columns]

    def _hash(self, head: bytes, laid: list, words: int) -> np.ndarray:
        first = np.frombuffer(head.ljust(64, b"\0"), dtype="<u4").tolist()
        m = [w | h if isinstance(w, int) else np.bitwise_or(w, np.uint32(h)) if h else w for w, h in zip(laid, first, strict=True)]
        n = next((len(w) for w in m if not isinstance(w, int)), 1)
        if n not in self._work:
            self._work[n] = [np.empty(n, dtype=np.uint32) for _ in range(5)]
        *registers, f = self._work[n]
        a, b, c, d = _START
        i = 0
        while i < 15 and isinstance(m[i], int):  # what all texts begin with is hashed once
            x = (a + ((b & c) | (~b & d)) + _K[i] + m[i]) & _MASK
            s = _SHIFTS[0][i % 4]
            a, d, c, b = d, c, b, (b + ((x << s) | (x >> (32 - s)))) & _MASK
            i += 1
        for register, value in zip(registers, (a, b, c, d), strict=True):
            register.fill(value)
        a, b, c, d = registers
        kept = {}
        for i in range(i, 64 if words > 1 else 61):  # the first word of the digest is ready after 61 steps
            if i < 16:
                np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
                g = i
            elif i < 32:
                np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
                g = (5 * i + 1) % 16
            elif i < 48:
                np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
                g = (3 * i + 5) % 16
            else:
                np.invert(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
                g = (7 * i) % 16
            np.add(a, f, out=a)
            if isinstance(m[g], int):
                np.add(a, np.uint32((_K[i] + m[g]) & _MASK), out=a)
            else:
                np.add(a, m[g], out=a), np.add(a, np.uint32(_K[i]), out=a)
            s = _SHIFTS[i // 16][i % 4]
            np.left_shift(a, np.uint32(s), out=f), np.right_shift(a, np.uint32(32 - s), out=a), np.bitwise_or(a, f, out=a), np.add(a, b, out=a)
            a, b, c, d = d, a, b, c
            kept[i] = b
        ends = [kept[60] + np.uint32(_START[0])]
        if words > 1:
            ends.append(kept[63] + np.uint32(_START[1]))
        return np.stack(ends).byteswap()
