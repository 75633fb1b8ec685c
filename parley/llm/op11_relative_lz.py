"""Substring deduplication by relative Lempel-Ziv parsing.

Each window of words chooses an anchor, the least hash among its shorter runs
of words, so equal windows choose equal anchors. The windows of one anchor in a
row form a segment of the document, and segments of equal anchors meet in one
reference block. Text whose anchor no other document has cannot hold a repeat
and stays where it is.

Equal segments become one, with the smallest key of their documents: all other
documents have the whole segment as a factor. What differs is parsed: the words
of a block are indexed by a suffix array, and each segment is factored greedily
against the segments of smaller documents. A factor as long as a window is a
duplicate span. A window that the block has, but no single factor covers, spans
exactly one boundary, because the factor that begins inside it reaches its end
at least; so the windows over each boundary are looked up too.

An anchor with more than MAX_SEGMENTS different segments would make its block
unbounded; its segments are dealt out once more by their whole windows, which
are equal within a block and so factors as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.op05_suffix_array import suffix_array
from parley.llm.shared import materialize, remove
from parley.llm.text import RunHashes, mix, text_slices, word_spans

WINDOW = 50
#: Words of an anchor: so many of a window's.
ANCHOR = 25
#: Words of a reference block, about; and segments of one anchor at most.
BLOCK_WORDS, MAX_SEGMENTS = 200_000, 2_000

_SEGMENT = "anchor long, seg long, doc long, mark long, start int, length int"


def segments(words: np.ndarray, rows: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word, one past the last word, anchor hash, segment hash) of all segments; every window lies in exactly one."""
    n = len(words) - window + 1
    start = np.arange(max(n, 0))
    ends = rows[np.searchsorted(rows, start, "right")] if n > 0 else start
    whole = np.flatnonzero(start + window <= ends)
    if not len(whole):
        none = np.zeros(0, np.int64)
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    runs = RunHashes(words)
    grams = mix(runs.of(np.arange(len(words) - anchor + 1), np.arange(anchor, len(words) + 1)))
    least = whole + np.lib.stride_tricks.sliding_window_view(grams, window - anchor + 1)[whole].argmin(axis=1)
    cut = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    first, last = whole[cut], whole[np.append(cut[1:], len(whole)) - 1] + window
    return np.searchsorted(rows, first, "right") - 1, first, last, grams[least[cut]], runs.of(first, last)


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _find_segments(window: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column("text")):
                words, rows, _, _ = word_spans(data, offsets, lower=False)
                row, first, last, gram, seg = segments(words, rows, window, anchor)
                at = pa.array(row + a)
                yield pa.RecordBatch.from_arrays(
                    [_long(gram), _long(seg), batch.column("doc").take(at), batch.column("mark").take(at), pa.array((first - rows[row]).astype(np.int32)), pa.array((last - first).astype(np.int32))],
                    ["anchor", "seg", "doc", "mark", "start", "length"],
                )

    return run


def _cut_out(window: int):
    """Rows of a document with its list of wanted segments: the words' hashes of each, or for hot anchors those of its windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column("text")):
                words, rows, _, _ = word_spans(data, offsets, lower=False)
                runs = RunHashes(words)
                out: dict[str, list] = {"anchor": [], "seg": [], "m": [], "hot": [], "words": []}
                for r, (doc, wanted) in enumerate(zip(batch.column("doc")[a:b].to_pylist(), batch.column("wanted")[a:b].to_pylist())):
                    for w in wanted:
                        first = rows[r] + w["start"]
                        if w["hot"]:
                            begins = np.arange(first, first + w["length"] - window + 1)
                            found = runs.of(begins, begins + window)
                        else:
                            found = words[first : first + w["length"]]
                        for name, x in zip(out, (w["anchor"], w["seg"], doc, w["hot"], found.tobytes())):
                            out[name].append(x)
                yield pa.RecordBatch.from_arrays([pa.array(out["anchor"], pa.int64()), pa.array(out["seg"], pa.int64()), pa.array(out["m"], pa.int64()), pa.array(out["hot"], pa.bool_()), pa.array(out["words"], pa.binary())], list(out))

    return run


def _smaller(keys: np.ndarray, step: int) -> np.ndarray:
    """For each place the next one on the left (step -1) or right (1) with a smaller key; -1 or len(keys) if there is none."""
    n = len(keys)
    ends = np.concatenate([keys, [np.iinfo(np.int64).min]])  # place n, and -1 as its other name
    at = np.arange(n) + step
    at[at == n] = -1
    jump = np.append(at, -1)
    live = np.flatnonzero(ends[at] >= keys)
    while len(live):
        # all between a place and its jump are no smaller than it, which stays so when jumps are followed
        jump[live] = jump[jump[live]]
        live = live[ends[jump[live]] >= keys[live]]
    return jump[:n]


def earlier_matches(numbers: np.ndarray, keys: np.ndarray, left: np.ndarray) -> np.ndarray:
    """For each word the longest run from it that also stands in a segment of a smaller key; left: words up to its segment's end."""
    order = suffix_array(numbers, int(left.max()))
    ranked = keys[order]
    best = np.zeros(len(numbers), np.int64)
    for step in (-1, 1):  # in suffix order the nearest of a smaller key on either side share most words
        near = _smaller(ranked, step)
        has = np.flatnonzero(near >= 0)
        a, b = order[has], order[near[has]]
        most = np.minimum(left[a], left[b])
        shared = np.zeros(len(a), np.int64)
        open_ = np.flatnonzero(most > 0)
        while len(open_):
            open_ = open_[numbers[a[open_] + shared[open_]] == numbers[b[open_] + shared[open_]]]
            shared[open_] += 1
            open_ = open_[shared[open_] < most[open_]]
        np.maximum.at(best, a, shared)
    return best


def parse(matches: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Greedy factors of all segments: (segment, first word, length); a word without a match is a factor of its own."""
    found = []
    live, at = np.arange(len(starts)), starts.copy()
    while len(live):
        size = np.maximum(matches[at], 1)
        found.append((live, at, size))
        at = at + size
        on = at < ends[live]
        live, at = live[on], at[on]
    seg, first, size = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(first, kind="stable")
    return seg[order], first[order], size[order]


def duplicate_windows(matches: np.ndarray, starts: np.ndarray, ends: np.ndarray, window: int) -> np.ndarray:
    """Which words begin a window that a smaller document has: inside long factors, and checked over each boundary of two."""
    seg, first, size = parse(matches, starts, ends)
    hit = np.zeros(len(matches) + 1, np.int64)
    whole = size >= window
    np.add.at(hit, first[whole], 1)
    np.add.at(hit, first[whole] + size[whole] - window + 1, -1)
    hit = np.cumsum(hit[:-1]) > 0
    pair = np.flatnonzero((seg[1:] == seg[:-1]) & (size[1:] + size[:-1] >= window))
    border = first[pair + 1]
    low = np.maximum(border - window + 1, first[pair])
    n = np.maximum(np.minimum(border - 1, border + size[pair + 1] - window) - low + 1, 0)
    over = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
    hit[over] |= matches[over] >= window
    return hit


def _factor(window: int, block_words: int):
    """Sorted rows (anchor, seg, m, words) in blocks of whole anchors: the spans of each segment that smaller documents have."""

    def factored(block: list[tuple]) -> pa.RecordBatch:
        sizes = np.array([len(x[3]) // 8 for x in block])
        ends = np.cumsum(sizes + 1) - 1
        starts = ends - sizes
        words = np.frombuffer(b"".join(x[3] + b"\0" * 8 for x in block), np.uint64)
        _, numbers = np.unique(words, return_inverse=True)
        numbers = numbers.astype(np.int64) + 1
        numbers[ends] = numbers.max() + 1 + np.arange(len(ends))  # no two ends are equal, so no run crosses one
        left = np.repeat(ends, sizes + 1) - np.arange(len(words))
        keys = np.repeat(np.array([x[2] for x in block], np.int64), sizes + 1)
        hit = duplicate_windows(earlier_matches(numbers, keys, left), starts, ends, window)
        edge = np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))
        a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        seg = np.searchsorted(starts, a, "right") - 1
        return pa.RecordBatch.from_arrays(
            [pa.array([block[i][0] for i in seg], pa.int64()), pa.array([block[i][1] for i in seg], pa.int64()), pa.array((a - starts[seg]).astype(np.int32)), pa.array((b - a + window - 1).astype(np.int32))],
            ["anchor", "seg", "offset", "size"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[tuple] = []
        held = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "seg", "m", "words"))):
                if held >= block_words and row[0] != block[-1][0]:
                    yield factored(block)
                    block, held = [], 0
                block.append(row)
                held += len(row[3]) // 8
        if block:
            yield factored(block)

    return run


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of segments of hot anchors, a row each."""
    for batch in batches:
        each = [np.frombuffer(x, np.int64) for x in batch.column("words").to_pylist()]
        n = np.array([len(x) for x in each], np.int64)
        at = pa.array(np.repeat(np.arange(len(n)), n))
        offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(each) if each else n), *(batch.column(c).take(at) for c in ("anchor", "seg", "m")), pa.array(offset.astype(np.int32))], ["window", "anchor", "seg", "m", "offset"])


def duplicate_spans(docs: DataFrame, key: str = "doc_id", window: int = WINDOW, anchor: int = ANCHOR, block_words: int = BLOCK_WORDS, max_segments: int = MAX_SEGMENTS) -> DataFrame:
    """(doc, mark, start, length): the words start to start + length - 1 of the rows with this key and xxhash64 of their text are covered by windows that documents of smaller keys have. Spans may overlap.

    Null and short texts have no windows; rows without a key have no order, so
    they neither lose words nor make others lose any. Rows of equal keys do
    not count against each other.
    """
    spark = docs.sparkSession
    texts = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc"), F.xxhash64("text").alias("mark"), "text")
    segs = materialize(texts.mapInArrow(_find_segments(window, min(anchor, window)), _SEGMENT), "segments")
    kinds = materialize(segs.groupBy("anchor", "seg").agg(F.min("doc").alias("m"), F.max("doc").alias("last")), "segment-kinds")
    anchors = kinds.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("m").alias("least"), F.max("last").alias("most")).where("least < most").select("anchor", "kinds", "least")
    met = materialize(kinds.join(anchors, "anchor").where("m < last or m > least").select("anchor", "seg", "m", (F.col("m") > F.col("least")).alias("open"), "kinds"), "segment-kinds")
    # of an anchor's segments only those of its smallest document need no parsing, but they are part of the reference
    shared = materialize(segs.join(met.select("anchor", "seg", "m", "open"), ["anchor", "seg"]).where("doc > m or open"), "segments")
    open_anchors = met.where("open").groupBy("anchor").agg(F.max("kinds").alias("kinds"))
    refs = kinds.join(open_anchors, "anchor").select("anchor", "seg", "m", (F.col("kinds") > max_segments).alias("hot"))
    one = segs.join(refs, ["anchor", "seg"]).where("doc = m").groupBy("anchor", "seg").agg(F.min(F.struct("doc", "mark", "start", "length")).alias("at"), F.first("hot").alias("hot"))
    wanted = one.groupBy("at.doc", "at.mark").agg(F.collect_list(F.struct("anchor", "seg", "hot", "at.start", "at.length")).alias("wanted"))
    words = materialize(texts.dropDuplicates(["doc", "mark"]).join(wanted, ["doc", "mark"]).select("doc", "text", "wanted").mapInArrow(_cut_out(window), "anchor long, seg long, m long, hot boolean, words binary"), "segment-words")
    parsed = words.where("not hot").repartition("anchor").sortWithinPartitions("anchor", "m", "seg").mapInArrow(_factor(window, block_words), "anchor long, seg long, offset int, size int")
    windows = materialize(words.where("hot").select("anchor", "seg", "m", "words").mapInArrow(_windows, "window long, anchor long, seg long, m long, offset int"), "segment-windows")
    least = windows.groupBy("window").agg(F.min("m").alias("least"))
    known = windows.join(least, "window").where("m > least").select("anchor", "seg", "offset", F.lit(window).alias("size"))
    part = materialize(parsed.unionByName(known), "segment-factors")
    inside = shared.where("doc = m").join(part, ["anchor", "seg"]).select("doc", "mark", (F.col("start") + F.col("offset")).alias("start"), F.col("size").alias("length"))
    out = materialize(shared.where("doc > m").select("doc", "mark", "start", "length").unionByName(inside), "spans")
    remove(spark, segs, kinds, met, shared, words, windows, part)
    return out


def _rewrite(key: str, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column("text")):
                _, rows, starts, ends = word_spans(data, offsets, lower=False)
                cover = np.zeros(len(starts) + 1, np.int64)
                spans = batch.column("spans")[a:b]
                owner = np.repeat(np.arange(b - a), spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                flat = spans.flatten()
                first = flat.field("start").to_numpy(zero_copy_only=False) + rows[owner]
                np.add.at(cover, first, 1)
                np.add.at(cover, first + flat.field("length").to_numpy(zero_copy_only=False), -1)
                keep = np.cumsum(cover[:-1]) == 0
                kept = np.concatenate([[0], np.cumsum(keep)])
                # the bytes of the kept words, each with a space behind it
                starts, sizes = starts[keep], (ends - starts)[keep] + 1
                stops = np.cumsum(sizes)
                source = np.repeat(starts - stops + sizes, sizes) + np.arange(stops[-1] if len(stops) else 0)
                line = data[np.minimum(source, len(data) - 1)] if len(source) else data[:0]
                line[stops - 1] = 0x20
                bounds = np.concatenate([[0], stops])[kept[rows]]
                texts = [line[x : max(x, y - 1)].tobytes() for x, y in zip(bounds[:-1], bounds[1:])]
                n = np.diff(rows)
                removed = n - (kept[rows[1:]] - kept[rows[:-1]])
                columns = [batch.column(key)[a:b], pa.array(n), pa.array(removed), pa.array([hashlib.sha256(t).hexdigest() for t in texts])]
                names = [key, "n_words", "n_removed", "kept_sha256"]
                if with_text:
                    columns.append(pa.array([t.decode() for t in texts], pa.string()))
                    names.append("kept")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def deduplicate(docs: DataFrame, key: str = "doc_id", window: int = WINDOW, with_text: bool = False, **options) -> DataFrame:
    """One row for each row of docs: key, n_words, n_removed, kept_sha256, and with with_text the kept words joined by spaces.

    Null and empty texts have no words. Repeated rows give repeated rows with
    equal results; rows of null keys keep all words. Windows are judged on the
    input. Other columns are ignored, whatever their names; no rows give no
    rows. The key has to be a whole number.
    """
    kind = docs.schema[key].dataType.simpleString()
    spans = duplicate_spans(docs, key, window, **options).groupBy("doc", "mark").agg(F.collect_list(F.struct("start", "length")).alias("spans"))
    rows = docs.select(F.col(key).alias("_key"), "text", F.col(key).cast("long").alias("doc"), F.xxhash64("text").alias("mark"))
    joined = rows.join(spans, ["doc", "mark"], "left").select(F.col("_key").alias(key), "text", "spans")
    return joined.mapInArrow(_rewrite(key, with_text), f"`{key}` {kind}, n_words long, n_removed long, kept_sha256 string" + (", kept string" if with_text else ""))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT r, doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS g FROM (SELECT r, doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM d WHERE len(ws) >= 50)),
m AS (SELECT g, min(doc_id) AS least FROM w GROUP BY g),
cov AS (SELECT DISTINCT r, unnest(range(i, i + 50)) AS p FROM w JOIN m USING (g) WHERE least < doc_id),
gone AS (SELECT r, list(p) AS ps, count(*) AS n FROM cov GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN n IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(ps, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN gone USING (r)
"""
