"""Words and word runs of Arrow text columns as flat numpy arrays.

Texts of a batch lie in one byte array. A word is a maximal run of bytes of a class; it never
crosses a text. A word is hashed in lanes of eight bytes, each mixed with its place and all summed:
equal bytes give equal hashes everywhere, and callers that need certainty compare bytes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa

BLOCK_BYTES = 2 << 20
_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """Table of the bytes in the given closed ranges."""
    table = np.zeros(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Digits, letters (after lower-casing A-Z) and every byte of a non-ASCII character.
ALNUM = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
#: Everything but ASCII white space.
NON_SPACE = ~byte_class((0x20, 0x20), (0x09, 0x0D))


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that all bits depend on all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit values."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_ODD) + np.uint64((seed * _ODD) & _MASK))


#: Masks that keep the first 0 to 8 bytes of a little-endian lane.
_KEPT = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offset of each; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES):
    """Row ranges of at most ``limit`` bytes; a longer text is a range of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


class Words:
    """Words of some texts: byte positions, the text of each, and their hashes.

    ``kind`` tells the bytes of words; with several numbered kinds a word has bytes of one kind. It is a table of
    bytes, or a function that gives the kind of each byte of all texts. A-Z are lower-cased unless ``fold`` is false.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind, fold: bool = True):
        self.offsets = offsets - offsets[0]
        self.lower = LOWER[data] if fold else data
        group = kind(self.lower) if callable(kind) else kind[self.lower].view(np.uint8)
        inside = group != 0
        starts, stops = inside.copy(), inside.copy()
        starts[1:] &= group[1:] != group[:-1]
        stops[:-1] &= group[1:] != group[:-1]
        heads = self.offsets[:-1][self.offsets[:-1] < self.offsets[1:]]
        starts[heads] = inside[heads]
        tails = self.offsets[1:][self.offsets[:-1] < self.offsets[1:]] - 1
        stops[tails] = inside[tails]
        self.starts = np.flatnonzero(starts)
        self.ends = np.flatnonzero(stops) + 1
        self.kinds = group[self.starts]
        #: Index of each text's first word, and the number of all words at the end.
        self.first = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.first)

    def __len__(self):
        return len(self.starts)

    def rows(self) -> np.ndarray:
        """The text that each word lies in."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def lanes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of all words in lanes of eight (zeros after the end), the place of each lane in its word, and each word's first lane."""
        counts = (self.ends - self.starts + 7) >> 3
        first = np.cumsum(counts) - counts
        place = np.arange(int(counts.sum())) - np.repeat(first, counts)
        at = np.repeat(self.starts, counts) + 8 * place
        left = np.minimum(np.repeat(self.ends, counts) - at, 8)
        padded = np.concatenate((self.lower, np.zeros(8, np.uint8)))
        values = np.lib.stride_tricks.sliding_window_view(padded, 8)[at].view("<u8").reshape(-1)
        return values & _KEPT[left], place, first

    def hashes(self, seed: int = 1, lanes=None) -> np.ndarray:
        """64 bits for each word; another seed gives another, independent value."""
        if not len(self):
            return np.zeros(0, np.uint64)
        values, place, first = lanes or self.lanes()
        key = (place.astype(np.uint64) + np.uint64(seed << 48)) * np.uint64(_ODD)
        total = np.add.reduceat(mix(mix(key) ^ values) * np.uint64(_ODD), first)
        return mix(total ^ mix((self.ends - self.starts).astype(np.uint64) + np.uint64(seed)))

    def numbers(self) -> tuple[np.ndarray, np.ndarray]:
        """A number for each word, equal for equal bytes, and a word that has each number; words of equal hash are compared by bytes."""
        lanes = self.lanes()
        which, found = pd.factorize(self.hashes(lanes=lanes))
        first = np.empty(len(found), dtype=np.int64)
        first[which[::-1]] = np.arange(len(which) - 1, -1, -1)
        other = np.flatnonzero(~self._equals(lanes, first[which]))
        if len(other):
            known, more = {}, []
            for w in other.tolist():
                word = self.lower[self.starts[w] : self.ends[w]].tobytes()
                if word not in known:
                    known[word] = len(first) + len(more)
                    more.append(w)
                which[w] = known[word]
            first = np.concatenate((first, more))
        return which, first

    def distinct(self) -> tuple[list[bytes], np.ndarray]:
        """The different words, and which of them each word is."""
        which, first = self.numbers()
        return self.bytes_of(first), which

    def bytes_of(self, some: np.ndarray) -> list[bytes]:
        """The bytes of the words with the given indices."""
        data, starts, ends = self.lower.tobytes(), self.starts[some].tolist(), self.ends[some].tolist()
        return [data[a:b] for a, b in zip(starts, ends, strict=True)]

    def _equals(self, lanes, partner: np.ndarray) -> np.ndarray:
        """Whether each word has the bytes of its partner."""
        values, place, first = lanes
        if not len(values):
            return np.ones(0, dtype=bool)
        sizes = self.ends - self.starts
        same = sizes == sizes[partner]
        counts = (sizes + 7) >> 3
        there = np.minimum(np.repeat(first[partner], counts) + place, len(values) - 1)
        return same & np.logical_and.reduceat(values == values[there], first)

    def phrase(self, at: int, n: int) -> bytes:
        """Words ``at`` to ``at + n - 1``, joined by one space."""
        return b" ".join(self.lower[s:e].tobytes() for s, e in zip(self.starts[at : at + n], self.ends[at : at + n], strict=True))


def run_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each word on."""
    if len(hashes) < n:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(len(hashes) - n + 1, dtype=np.uint64)
    for j in range(n):
        total = total * np.uint64(_ODD) + hashes[j : j + len(total)]
    return mix(total + np.uint64(n))


def run_starts(words: Words, n: int) -> np.ndarray:
    """Words from which ``n`` words of the same text follow, the word itself included."""
    keep = np.ones(max(len(words) - n + 1, 0), dtype=bool)
    for j in range(1, n):
        cut = words.first[1:-1] - j
        keep[cut[(cut >= 0) & (cut < len(keep))]] = False
    return np.flatnonzero(keep)


def run_codes(which: np.ndarray, n: int) -> np.ndarray:
    """Numbers of the runs of ``n`` words from each word on: equal ones for equal words, given each word's number."""
    codes, later = which.astype(np.int64), which.astype(np.int64)
    for j in range(1, n):
        codes = pd.factorize((codes[:-1] << 32) | later[j:])[0] if len(codes) > 1 else codes[:0]
    return codes
