"""Pieces of texts between white space, numbered in numpy.

Most pieces are short.  One of up to 16 bytes is two machine words, which identify
it, so that millions of them are looked up without a Python object for each.
Longer ones and those with zero bytes go through a dictionary.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Entries that a worker's memo of pieces holds before it starts anew.
#: It only saves time: results don't depend on it.
MEMO_ENTRIES = 600_000
#: So many bytes of long pieces end it too.
MEMO_BYTES = 12_000_000

_WHITE = np.zeros(256, dtype=bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
#: The bytes of a word that belong to a piece of 0..8 bytes.
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of every span, one span after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def mixed(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    x = (first ^ (second * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


class WordTable:
    """Numbers of pairs of machine words by open addressing; no pair is (0, 0)."""

    def __init__(self, bits: int = 12):
        self.bits, self.used = bits, 0
        self.first, self.second = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint64)
        self.number = np.full(1 << bits, -1, np.int64)

    def _slots(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        return (mixed(first, second) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Numbers of pairs, -1 where there is none."""
        slot = self._slots(first, second)
        out = self.number[slot]
        left = np.flatnonzero((out >= 0) & ((self.first[slot] != first) | (self.second[slot] != second)))
        slot = slot[left]
        while left.size:
            slot = (slot + 1) & ((1 << self.bits) - 1)
            number = self.number[slot]
            out[left] = number
            go = (number >= 0) & ((self.first[slot] != first[left]) | (self.second[slot] != second[left]))
            left, slot = left[go], slot[go]
        return out

    def add(self, first: np.ndarray, second: np.ndarray, number: np.ndarray) -> None:
        """Pairs that aren't here yet, none of them twice."""
        self.used += len(first)
        if 2 * self.used > 1 << self.bits:
            here = self.number >= 0
            first, second, number = (np.concatenate([a[here], b]) for a, b in ((self.first, first), (self.second, second), (self.number, number)))
            self.__init__(max(self.bits + 1, int(4 * len(first)).bit_length()))
            self.used = len(first)
        slot, left = self._slots(first, second), np.arange(len(first))
        while left.size:
            free = self.number[slot[left]] < 0
            _, at = np.unique(slot[left], return_index=True)
            put = np.zeros(len(left), dtype=bool)
            put[at] = True
            put &= free
            s, chosen = slot[left[put]], left[put]
            self.first[s], self.second[s], self.number[s] = first[chosen], second[chosen], number[chosen]
            left = left[~put]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)


class Pieces:
    """The pieces of some texts: their numbers in a memo, and where they lie."""

    def __init__(self, texts: list[str]):
        parts = [t.encode("utf-8", "surrogatepass") for t in texts]
        self.raw = b" ".join([*parts, b" " * 17])
        self.stops = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1)  # of each text, with the space after it
        white = _WHITE[np.frombuffer(self.raw, dtype=np.uint8)]
        edges = np.flatnonzero(white[1:] != white[:-1]) + 1
        if not white[0]:
            edges = np.concatenate([[0], edges])
        self.starts, self.ends = edges[::2], edges[1::2]
        self.upto = np.searchsorted(self.starts, self.stops)  # pieces up to the end of each text

    def text(self, k: int) -> str:
        return self.raw[self.starts[k] : self.ends[k]].decode("utf-8", "surrogatepass")

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which pieces are two machine words, and these."""
        sizes = self.ends - self.starts
        short = np.flatnonzero(sizes <= 16)
        view = np.ndarray((len(self.raw) - 7,), dtype="<u8", buffer=self.raw, strides=(1,))
        at, n = self.starts[short], sizes[short]
        first = view[at] & _KEEP[np.minimum(n, 8)]
        second = np.where(n > 8, view[np.minimum(at + 8, len(view) - 1)], np.uint64(0)) & _KEEP[np.maximum(n - 8, 0)]
        return short, first, second


class PieceMemo:
    """What has been worked out for pieces: a row of numbers for each, in one array.

    ``encode(pieces)`` gives the rows of new pieces, one after the other, and their lengths."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]):
        self.encode = encode
        self.clear()

    def clear(self) -> None:
        self.table, self.long, self.known, self.bytes = WordTable(), {}, 0, 0
        self.flat, self.starts, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def numbers(self, pieces: Pieces) -> np.ndarray:
        """The memo's numbers of all pieces; new ones are encoded."""
        if self.known > MEMO_ENTRIES or self.bytes > MEMO_BYTES:
            self.clear()
        out = np.full(len(pieces.starts), -1, dtype=np.int64)
        fresh: list[str] = []
        if b"\0" not in pieces.raw:
            short, first, second = pieces.words()
            found = self.table.look(first, second)
            miss = np.flatnonzero(found < 0)
            if miss.size:
                order = miss[np.lexsort((second[miss], first[miss]))]
                a, b = first[order], second[order]
                head = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
                found[order] = self.known + np.cumsum(head) - 1
                new = order[head]
                self.table.add(first[new], second[new], found[new])
                fresh += map(pieces.text, short[new].tolist())
            out[short] = found
        for k in np.flatnonzero(out < 0).tolist():
            piece = pieces.text(k)
            n = self.long.get(piece)
            if n is None:
                n = self.long[piece] = self.known + len(fresh)
                fresh.append(piece)
                self.bytes += len(piece)
            out[k] = n
        if fresh:
            rows, sizes = self.encode(fresh)
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.flat = np.concatenate([self.flat, rows.astype(np.uint32)])
            self.known += len(fresh)
        return out

    def rows(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The rows of all pieces of all texts one after the other, and each text's share of them."""
        pieces = Pieces(texts)
        found = self.numbers(pieces)
        sizes = self.sizes[found]
        stops = np.concatenate([[0], np.cumsum(sizes)])[pieces.upto]
        return self.flat[spans(self.starts[found], sizes)], np.diff(stops, prepend=0)
