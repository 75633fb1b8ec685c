"""Words of whole Arrow batches as numpy arrays of 64-bit hashes, without a Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes handled at once, so that a task's memory does not follow the batch size; one longer text is still taken whole.
SLICE_BYTES = 1 << 20

_PRIME = np.uint64(0x9E3779B97F4A7C15)
_WHITE = np.ones(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = False
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Which bytes belong to words, after lower-casing A-Z.
WORD_BYTES = {"white": _WHITE, "alnum": _ALNUM}
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, SLICE_BYTES + 1)
        with np.errstate(over="ignore"):
            _powers["up"] = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size, _PRIME)]))
            _powers["down"] = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size, np.uint64(pow(int(_PRIME), -1, 1 << 64)))]))
    return _powers["up"], _powers["down"]


def text_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, row offsets into them) of runs of rows of about limit bytes; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        last = min(last, n)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def word_spans(data: np.ndarray, offsets: np.ndarray, kind: str = "white", lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(64-bit hash of each word, index of the first word of each row, and one past the last; first byte of each word, one past its last)."""
    low = _LOWER[data]
    inside = WORD_BYTES[kind][low]
    before = np.empty_like(inside)
    before[1:] = inside[:-1]
    before[:1] = False
    edges = offsets[:-1][offsets[:-1] < len(data)]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[:-1] = inside[1:]
    after[-1:] = False
    after[edges[edges > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    up, down = _power_tables(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(((low if lower else data).astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
        words = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    return words, np.searchsorted(starts, offsets), starts, ends


def word_hashes(data: np.ndarray, offsets: np.ndarray, kind: str = "white") -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each lower-cased word, index of the first word of each row, and one past the last)."""
    return word_spans(data, offsets, kind)[:2]


class RunHashes:
    """Hashes of runs words[a:b], any a and b, each in constant time."""

    def __init__(self, words: np.ndarray):
        up, self.down = _power_tables(len(words) + 1)
        self.total = np.zeros(len(words) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(words * up[: len(words)], out=self.total[1:])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.total[b] - self.total[a]) * self.down[a] + (b - a).astype(np.uint64) * np.uint64(0xD1342543DE82EF95))


def shingle_sets(words: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes, ascending within each row; offsets of the rows). A row of fewer words is one shingle."""
    found, bounds = [], np.zeros(len(rows), np.int64)
    with np.errstate(over="ignore"):
        rolled = np.zeros(len(words), np.uint64)
        for j in range(size):
            rolled[: len(words) - j] = mix(rolled[: len(words) - j] * _PRIME + words[j:] + np.uint64(j + 1))
        for i in range(len(rows) - 1):
            a, b = rows[i], rows[i + 1]
            if b - a >= size:
                s = np.sort(rolled[a : b - size + 1])
                s = s[np.concatenate([[True], s[1:] != s[:-1]])]
            elif b > a:
                s = np.zeros(1, np.uint64)
                for w in words[a:b]:
                    s = mix(s * _PRIME + w + np.uint64(size + b - a))
            else:
                s = words[:0]
            found.append(s)
            bounds[i + 1] = bounds[i] + len(s)
    return (np.concatenate(found) if found else words[:0]), bounds
