"""Benchmark decontamination with suffix arrays over the training text.

Each slice of training documents is a shard: its words become integers, its
suffixes are sorted, and every suffix of every benchmark item is looked up by
binary search. That gives each suffix's longest verbatim match and where it
stands. Documents whose words are covered too far are removed.

The benchmark is written to the shared folder in blocks of about BLOCK_CHARS
characters. A task reads them one after the other for each batch of documents,
so a benchmark of any size goes the same way: more text takes more time, never
more memory, and nothing of it passes the driver.
"""

from __future__ import annotations

import hashlib
import pickle
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.shared import fresh_path
from parley.llm.text import text_slices, word_hashes

WINDOW = 13
BLOCK_CHARS = 8_000_000


@dataclass(frozen=True)
class Benchmark:
    """Items of one block as word numbers: item i has words[starts[i]:starts[i + 1]]; vocab[k - 1] is the hash of number k."""

    ids: list
    words: np.ndarray
    starts: np.ndarray
    vocab: np.ndarray
    order: np.ndarray
    firsts: np.ndarray

    def standing(self, words: np.ndarray) -> np.ndarray:
        """Where these words (places in vocab, ascending) stand in the items."""
        n = self.firsts[words + 1] - self.firsts[words]
        return self.order[np.arange(n.sum()) + np.repeat(self.firsts[words] - np.cumsum(n) + n, n)]


def encode_benchmark(ids: list, texts: list) -> Benchmark:
    found = [word_hashes(data, rows, "alnum") for _, _, data, rows in text_slices(pa.array(texts, pa.string()))]
    hashes = np.concatenate([w for w, _ in found]) if found else np.zeros(0, np.uint64)
    sizes = np.concatenate([np.diff(r) for _, r in found]) if found else np.zeros(0, np.int64)
    vocab, numbers = np.unique(hashes, return_inverse=True)
    order = np.argsort(numbers, kind="stable")
    return Benchmark(ids, numbers.astype(np.int64) + 1, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), vocab, order, np.searchsorted(numbers[order], np.arange(len(vocab) + 1)))


def suffix_array(numbers: np.ndarray, depth: int) -> np.ndarray:
    """Positions of numbers (all above 0) in the order of their suffixes, by prefix doubling to at least depth words."""
    n = len(numbers)
    rank = np.unique(numbers, return_inverse=True)[1].astype(np.int64) + 1
    order = np.argsort(rank, kind="stable")
    width = 1
    while width < depth and n:
        after = np.zeros(n, np.int64)
        after[: max(0, n - width)] = rank[width:]
        keys = rank * (n + 1) + after
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
        fresh = np.empty(n, np.int64)
        fresh[order] = np.cumsum(np.concatenate([[1], (ordered[1:] != ordered[:-1]).astype(np.int64)]))
        rank, width = fresh, width * 2
        if rank.max() == n:
            break
    return order


def _compare(shard: np.ndarray, at: np.ndarray, query: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each query suffix and shard suffix: the words they share, and whether the shard's is smaller at the first difference."""
    shared = np.zeros(len(at), np.int64)
    less = np.zeros(len(at), bool)
    open_ = np.flatnonzero(length > 0)
    while len(open_):
        k = shared[open_]
        a = np.where(at[open_] + k < len(shard), shard[np.minimum(at[open_] + k, len(shard) - 1)], -1)
        q = query[start[open_] + k]
        same = a == q
        less[open_[~same]] = a[~same] < q[~same]
        open_ = open_[same]
        shared[open_] += 1
        open_ = open_[shared[open_] < length[open_]]
    return shared, less


def search(shard: np.ndarray, order: np.ndarray, query: np.ndarray, start: np.ndarray, length: np.ndarray, upper: bool) -> np.ndarray:
    """First place in order whose suffix is not below (upper: is above) the first length words of each query suffix."""
    low, high = np.zeros(len(start), np.int64), np.full(len(start), len(order), np.int64)
    while (live := np.flatnonzero(low < high)).size:
        mid = (low[live] + high[live]) // 2
        shared, less = _compare(shard, order[mid], query, start[live], length[live])
        right = less | ((shared == length[live]) & upper)
        low[live[right]] = mid[right] + 1
        high[live[~right]] = mid[~right]
    return low


@dataclass
class ShardMatches:
    """Windows found in one shard: window w (item, start in the item, length) stands at each of places[firsts[w]:lasts[w]]."""

    item: np.ndarray
    start: np.ndarray
    length: np.ndarray
    longest: np.ndarray
    firsts: np.ndarray
    lasts: np.ndarray
    places: np.ndarray


def match_shard(words: np.ndarray, rows: np.ndarray, bench: Benchmark, window: int) -> ShardMatches | None:
    """Looks all suffixes of the items up in the suffix array of the shard.

    Words outside the benchmark's vocabulary end every match, so only runs of
    in-vocabulary words as long as the shortest window are sorted; a number of
    its own between two runs keeps matches from crossing.
    """
    sizes = np.diff(bench.starts)
    if not len(words) or not sizes.any():
        return None
    at = np.minimum(np.searchsorted(bench.vocab, words), len(bench.vocab) - 1)
    known = bench.vocab[at] == words
    first = np.zeros(len(words) + 1, bool)
    first[rows] = True
    new = known & ~np.concatenate([[False], known[:-1]]) | known & first[:-1]
    begins = np.flatnonzero(new)
    if not len(begins):
        return None
    stop = ~known | first[:-1]
    stops = np.flatnonzero(stop)
    ends = np.append(stops, len(words))[np.searchsorted(stops, begins, "right")]
    keep = ends - begins >= min(window, int(sizes[sizes > 0].min()))
    begins, ends = begins[keep], ends[keep]
    if not len(begins):
        return None
    spans = ends - begins
    slots = np.concatenate([[0], np.cumsum(spans + 1)])
    shard = np.full(slots[-1], len(bench.vocab) + 1, np.int64)
    origin = np.full(slots[-1], -1, np.int64)
    inside = np.repeat(slots[:-1] - np.concatenate([[0], np.cumsum(spans)])[:-1], spans) + np.arange(spans.sum())
    source = np.repeat(begins - np.concatenate([[0], np.cumsum(spans)])[:-1], spans) + np.arange(spans.sum())
    shard[inside] = at[source] + 1
    origin[inside] = source
    order = suffix_array(shard, int(sizes.max()))
    starts = bench.standing(np.unique(at[source]))
    item = np.searchsorted(bench.starts, starts, "right") - 1
    left = bench.starts[1:][item] - starts
    need = np.minimum(window, sizes[item])
    fits = left >= need
    starts, item, left, need = starts[fits], item[fits], left[fits], need[fits]
    present = np.zeros(len(bench.vocab) + 1, bool)
    present[at[source] + 1] = True
    for k in range(1, window):  # suffixes with a word that the shard lacks drop out before the search
        fits = (k >= need) | present[bench.words[np.minimum(starts + k, len(bench.words) - 1)]]
        starts, item, left, need = starts[fits], item[fits], left[fits], need[fits]
    firsts = search(shard, order, bench.words, starts, need, False)
    lasts = search(shard, order, bench.words, starts, need, True)
    hit = lasts > firsts
    starts, item, left, need, firsts, lasts = (x[hit] for x in (starts, item, left, need, firsts, lasts))
    if not len(starts):
        return None
    spot = search(shard, order, bench.words, starts, left, False)
    longest = np.zeros(len(starts), np.int64)
    for near in (spot - 1, spot):
        ok = (near >= 0) & (near < len(order))
        shared, _ = _compare(shard, order[np.clip(near, 0, len(order) - 1)], bench.words, starts, left)
        longest = np.maximum(longest, np.where(ok, shared, 0))
    return ShardMatches(item, starts - bench.starts[item], need, longest, firsts, lasts, origin[order])


def _expand(m: ShardMatches) -> tuple[np.ndarray, np.ndarray]:
    """(window, place) of every occurrence."""
    n = m.lasts - m.firsts
    w = np.repeat(np.arange(len(n)), n)
    return w, m.places[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + m.firsts[w]]


class Hits:
    """What the blocks find in one shard: the words inside occurrences, and the items of each document."""

    def __init__(self, rows: np.ndarray):
        self.rows, self.ahead = rows, np.zeros(int(rows[-1]) + 1, np.int64)
        self.items: list[set[str]] = [set() for _ in rows[1:]]

    def add(self, bench: Benchmark, m: ShardMatches | None) -> None:
        if m is None:
            return
        w, place = _expand(m)
        np.add.at(self.ahead, place, 1)
        np.add.at(self.ahead, place + m.length[w], -1)
        doc = np.searchsorted(self.rows, place, "right") - 1
        for d, i in np.unique(np.stack([doc, m.item[w]], 1), axis=0):
            self.items[d].add(bench.ids[i])

    def words(self) -> np.ndarray:
        """Words of each document inside occurrences."""
        covered = np.concatenate([[0], np.cumsum(np.cumsum(self.ahead[:-1]) > 0)])
        return covered[self.rows[1:]] - covered[self.rows[:-1]]

    def contaminated(self) -> np.ndarray:
        hits = self.words()
        return (hits > 0) & (20 * hits >= np.diff(self.rows))


@dataclass(frozen=True)
class Blocks:
    """Names of the written blocks of a benchmark."""

    root: str
    files: list[str]

    def reader(self):
        """Gives an iterator over the blocks again and again; holds no more than the last one."""
        fs, path = pafs.FileSystem.from_uri(self.root)
        last: dict[str, Benchmark] = {}

        def read() -> Iterator[Benchmark]:
            for file in self.files:
                if file not in last:
                    last.clear()
                    with fs.open_input_stream(f"{path}/{file}", compression=None) as stream:
                        last[file] = pickle.loads(stream.read())
                yield last[file]

        return read


def write_blocks(benchmark: DataFrame, item: str = "item_id", block_chars: int = BLOCK_CHARS) -> Blocks:
    """Writes the items with a text below the shared folder, dealt by hash into blocks of about block_chars characters; a longer item makes its block so much larger.

    Files of lost attempts are never named in the result.
    """
    root = fresh_path(benchmark.sparkSession, "benchmark")
    rows = benchmark.where(F.col("text").isNotNull()).select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("i"), "text")
    blocks = max(1, -(-int(rows.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(root)
        block, ids, texts = None, [], []

        def write() -> pa.RecordBatch:
            name = uuid.uuid4().hex
            fs.create_dir(path, recursive=True)
            with fs.open_output_stream(f"{path}/{name}", compression=None) as stream:
                stream.write(pickle.dumps(encode_benchmark(ids, texts), protocol=5))
            return pa.RecordBatch.from_arrays([pa.array([name])], ["file"])

        for batch in batches:
            for b, i, t in zip(*(batch.column(c).to_pylist() for c in ("block", "i", "text"))):
                if texts and b != block:
                    yield write()
                    ids, texts = [], []
                block = b
                ids.append(i)
                texts.append(t)
        if texts:
            yield write()

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("i", "text"), F.lit(blocks))).repartition(blocks, "block").sortWithinPartitions("block", "i", "text")
    return Blocks(root, [r["file"] for r in dealt.mapInArrow(run, "file string").collect()])


def _scan(blocks: Blocks, window: int, done):
    """Runs a batch of documents against all blocks, and then done(rows of a shard, its word bounds, its Hits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = blocks.reader()
        for batch in batches:
            shards = [(batch.slice(a, b - a), *word_hashes(data, rows, "alnum")) for a, b, data, rows in text_slices(batch.column("text"))]
            hits = [Hits(at) for _, _, at in shards]
            for bench in read():
                for (_, words, at), h in zip(shards, hits):
                    h.add(bench, match_shard(words, at, bench, window))
            for (part, _, at), h in zip(shards, hits):
                yield done(part, at, h)

    return run


def longest_matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", item: str = "item_id", window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(key, item_id, item_word, doc_word, length): each item window that stands in a document, where, and how far the longest match from its first word goes in the shard."""
    kind = docs.schema[key].dataType.simpleString()
    blocks = write_blocks(benchmark, item, block_chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = blocks.reader()
        for batch in batches:
            for bench in read():
                for a, b, data, rows in text_slices(batch.column("text")):
                    words, at = word_hashes(data, rows, "alnum")
                    if (m := match_shard(words, at, bench, window)) is not None:
                        w, place = _expand(m)
                        doc = np.searchsorted(at, place, "right") - 1
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(key)[a:b].take(pa.array(doc)), pa.array([bench.ids[i] for i in m.item[w]], pa.string()), pa.array(m.start[w]), pa.array(place - at[doc]), pa.array(m.longest[w])],
                            [key, "item_id", "item_word", "doc_word", "length"],
                        )

    return docs.select(key, "text").mapInArrow(run, f"`{key}` {kind}, item_id string, item_word long, doc_word long, length long")


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", item: str = "item_id", window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row for each row of docs: key, n_words, n_hit, n_items, items_sha256, contaminated.

    Null and empty texts have no words and no hits. Items without words, null
    or not, are never found; a repeated item_id counts once, and a null one
    counts as the empty id. Each row is judged by its own text alone, so equal
    and null keys make no difference; no rows give no rows. Other columns are
    ignored. Documents are not shuffled.
    """
    kind = docs.schema[key].dataType.simpleString()

    def done(part: pa.RecordBatch, rows: np.ndarray, h: Hits) -> pa.RecordBatch:
        digests = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in h.items]
        return pa.RecordBatch.from_arrays(
            [part.column(key), pa.array(np.diff(rows)), pa.array(h.words()), pa.array([len(x) for x in h.items], pa.int64()), pa.array(digests), pa.array(h.contaminated())],
            [key, "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        )

    schema = f"`{key}` {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    return docs.select(key, "text").mapInArrow(_scan(write_blocks(benchmark, item, block_chars), window, done), schema)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, item: str = "item_id", window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of docs, unchanged, whose own text is not contaminated. They never leave their task."""
    done = lambda part, rows, h: part.filter(pa.array(~h.contaminated()))
    return docs.mapInArrow(_scan(write_blocks(benchmark, item, block_chars), window, done), docs.schema)


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
b AS (SELECT DISTINCT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, k, array_to_string(ws[i:i + k - 1], ' ') AS g FROM (SELECT item_id, ws, least(13, len(ws)) AS k, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT r, k, i, array_to_string(ws[i:i + k - 1], ' ') AS g FROM (SELECT r, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, ks WHERE len(ws) >= k)),
hit AS (SELECT r, k, i, item_id FROM dw JOIN bw USING (k, g)),
cov AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT r, i, k FROM hit)) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT r, item_id::VARCHAR AS s FROM hit) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(s, '')) AS items_sha256,
       (coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws)) AS contaminated
FROM d LEFT JOIN cov USING (r) LEFT JOIN its USING (r)
"""
