"""Packing documents into token windows by Karmarkar-Karp multiway differencing.

Each task tokenizes its documents, cuts full windows off the long ones, and
gathers the rest in groups. Within a group, partial partitions with opposing
imbalances are merged until one partition is left: near-equal windows. If a
window exceeds the capacity, the window count rises by one and the differencing
starts again; a small excess is cut off instead and moved to a window with
room, as documents may be cut freely. Nothing is shuffled, and a task holds one group at a time.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

CAPACITY = 4096
END_ID = 2
#: Windows of a group: enough for a good balance, few enough for a small heap.
GROUP_WINDOWS = 48
#: Share of the capacity by which a window may exceed it and be trimmed; beyond it a window is added.
TRIM = 0.125
CACHE_WORDS = 600_000
JOINED_WORDS = 2000


class WordEncoder:
    """Token ids of texts, as little-endian 32-bit words, from those of their white-space separated words.

    The tokenizer lower-cases, drops white space, and no token spans it or the
    border between a letter and a full stop or comma. So a text's ids are its
    words' ids in a row, and a word's are its stem's and its mark's. Ids of
    seen words are kept, up to CACHE_WORDS.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.ids = Tokenizer.from_file(path), {}
        self.marks = {m: np.array(self.tokenizer.encode(m.decode(), add_special_tokens=False).ids, "<u4").tobytes() for m in (b".", b",")}

    def _encode_words(self, words: list[bytes]) -> None:
        for i in range(0, len(words), JOINED_WORDS):
            some = [w.decode() for w in words[i : i + JOINED_WORDS]]
            e = self.tokenizer.encode("\n".join(some), add_special_tokens=False)
            ends = np.cumsum([len(w) + 1 for w in some])
            owner = np.searchsorted(ends, np.array([a for a, _ in e.offsets], np.int64), "right")
            cuts = (np.searchsorted(owner, np.arange(len(some) + 1)) * 4).tolist()
            raw = np.array(e.ids, "<u4").tobytes()
            self.ids.update(zip(words[i : i + JOINED_WORDS], (raw[a:b] for a, b in zip(cuts, cuts[1:]))))

    def _learn(self, words: set[bytes]) -> None:
        known, plain, marked = self.ids, set(), []
        for w in words:
            if w[-1:] in self.marks and w[-2:-1].isalpha():
                stem = w[:-1]
                marked.append((w, stem))
                if stem not in known:
                    plain.add(stem)
            else:
                plain.add(w)
        self._encode_words(list(plain))
        for w, stem in marked:
            known[w] = known[stem] + self.marks[w[-1:]]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        raw = [(t or "").encode() for t in texts]
        split = [(r if b"<|" in r else r.lower()).split() for r in raw]
        if len(self.ids) > CACHE_WORDS:
            self.ids.clear()
        new = set().union(*split).difference(self.ids)
        if new:
            self._learn(new)
        return [np.frombuffer(b"".join(map(self.ids.__getitem__, words)), "<u4") for words in split]


def karmarkar_karp(sizes: list[int], ways: int) -> list[list[int]]:
    """Indices of sizes (all above 0) in so many bins of nearly equal sums.

    The two partial partitions with the largest imbalance are merged, the
    fullest bins of one with the emptiest of the other.
    """
    heap = []
    for i, n in enumerate(sizes):
        heap.append((-n, i, [n], [[i]]))
    heapq.heapify(heap)
    tick = len(sizes)
    while len(heap) > 1:
        _, _, a, a_bins = heapq.heappop(heap)
        _, _, b, b_bins = heapq.heappop(heap)
        # sums are kept in descending order, without the zero bins at the end; the least sum of a full partition is taken off
        spare = ways - len(a) - len(b)
        if spare >= 0:
            sums, bins = a + b, a_bins + b_bins
        else:
            over = -spare
            keep = len(a) - over
            sums = a[:keep] + [x + y for x, y in zip(a[keep:], reversed(b[len(b) - over :]))] + b[: len(b) - over]
            bins = a_bins[:keep] + [x + y for x, y in zip(a_bins[keep:], reversed(b_bins[len(b) - over :]))] + b_bins[: len(b) - over]
        order = sorted(range(len(sums)), key=sums.__getitem__, reverse=True)
        sums, bins = [sums[i] for i in order], [bins[i] for i in order]
        low = sums[-1] if len(sums) == ways else 0
        if low:
            sums = [x - low for x in sums]
        heapq.heappush(heap, (-sums[0], tick, sums, bins))
        tick += 1
    bins = heap[0][3] if heap else []
    return bins + [[] for _ in range(ways - len(bins))]


class Packer:
    """Takes documents' ids, gives pieces (document, start, length, crc, total, sequence, offset, ids)."""

    def __init__(self, first: int, capacity: int, group: int):
        self.next, self.capacity, self.room, self.trim = first, capacity, group * capacity, int(capacity * TRIM)
        self.rest, self.size, self.out = [], 0, []

    def _place(self, key, ids: np.ndarray, start: int, stop: int, total: int, sequence: int, offset: int) -> None:
        part = ids[start:stop]
        self.out.append((key, start, stop - start, zlib.crc32(part.tobytes()), total, sequence, offset, part))

    def add(self, key, ids: np.ndarray) -> None:
        total, start = len(ids), 0
        while total - start >= self.capacity:
            self._place(key, ids, start, start + self.capacity, total, self.next, 0)
            start, self.next = start + self.capacity, self.next + 1
        while start < total:
            stop = min(total, start + self.room - self.size)
            self.rest.append((key, ids, start, stop, total))
            self.size, start = self.size + stop - start, stop
            if self.size == self.room:
                self.flush()

    def _balanced(self) -> list[list[tuple]]:
        """Windows of pieces. A window more than trim over the capacity makes the count rise; a smaller excess is cut off and goes where there is room."""
        sizes, ways = [stop - start for _, _, start, stop, _ in self.rest], max(1, -(-self.size // self.capacity))
        while True:
            bins = karmarkar_karp(sizes, ways)
            sums = [sum(sizes[i] for i in b) for b in bins]
            if max(sums) - self.capacity <= self.trim:
                break
            ways += 1
        windows, loose = [[self.rest[i] for i in sorted(b)] for b in bins], []
        for w, n in zip(windows, sums):
            if n > self.capacity:
                j = max(range(len(w)), key=lambda j: w[j][3] - w[j][2])
                key, ids, start, stop, total = w[j]
                cut = stop - (n - self.capacity)
                w[j] = (key, ids, start, cut, total)
                loose.append((key, ids, cut, stop, total))
        spare = iter(sorted(((self.capacity - n, i) for i, n in enumerate(sums) if n < self.capacity), reverse=True))
        room, at = 0, -1
        for key, ids, start, stop, total in loose:
            while start < stop:
                if not room:
                    room, at = next(spare)
                cut = min(stop, start + room)
                windows[at].append((key, ids, start, cut, total))
                room, start = room - (cut - start), cut
        return [w for w in windows if w]

    def flush(self) -> None:
        for window in self._balanced() if self.rest else ():
            offset = 0
            for key, ids, start, stop, total in window:
                self._place(key, ids, start, stop, total, self.next, offset)
                offset += stop - start
            self.next += 1
        self.rest, self.size = [], 0


def _packing(key: str, tokenizer: str, capacity: int, group: int, with_ids: bool, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(tokenizer)
        packer = Packer(TaskContext.get().partitionId() << 33, capacity, group)

        def ready() -> pa.RecordBatch:
            columns = list(zip(*packer.out))
            packer.out = []
            if with_ids:
                columns[7] = [ids.astype(np.int32) for ids in columns[7]]
            else:
                columns = columns[:7]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

        for batch in batches:
            keys = batch.column(key).to_pylist()
            for a in range(0, len(keys), 256):
                for k, ids in zip(keys[a : a + 256], encoder.encode(batch.column("text")[a : a + 256].to_pylist())):
                    packer.add(k, np.append(ids, np.uint32(END_ID)).astype("<u4", copy=False))
                if len(packer.out) > 5000:
                    yield ready()
        packer.flush()
        if packer.out:
            yield ready()

    return run


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", capacity: int = CAPACITY, group: int = GROUP_WINDOWS, with_ids: bool = True) -> DataFrame:
    """One row for each piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids (with_ids).

    A document is its token ids and the end id; a null or empty text is the end
    id alone. Repeated rows are packed each. tokenizer is the path of a file
    that every executor has. Padding is what sequences lack to the capacity.
    """
    kind = docs.schema[key].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    fields = [(key, to_arrow_type(kind))] + [(n, pa.int64()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")] + ([("ids", pa.list_(pa.int32()))] if with_ids else [])
    spark_schema = f"`{key}` {kind.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids array<int>" if with_ids else "")
    return docs.select(key, "text").mapInArrow(_packing(key, tokenizer, capacity, group, with_ids, pa.schema(fields)), spark_schema)
