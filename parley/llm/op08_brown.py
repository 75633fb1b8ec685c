"""Language-model scoring by a Brown class-based bigram model.

Every training word gets a class by exchange clustering: a word goes to the
class that raises the likelihood of the class bigrams most. A text's
probability is the product of class transitions and word emissions. Absolute
discounting takes a little from every word's count; what a class gives up this
way is the probability of unknown words, which count as one more type, so that
all probabilities after a history add up to one.

Histories are the classes of the EXCHANGE_WORDS most frequent words, one for all
other words, and one for the start of a text. So a frequent word's class
matters for what stands before and after it, and its moves are judged over both
sides, in sweeps over a table of its neighbours that Spark deals to all tasks;
the moves of a sweep are made if the likelihood rises. Any other word's class
matters only for what stands before it: it goes to the class of largest
likelihood over the histories before it, one row a word, whatever their number.
A few very frequent words are exchanged one after the other first, as seeds.

All training tokens are counted. Words above a count that leaves at most
HEAD_WORDS of them are the head; its table goes to every task. Tokens of rarer
words are scored by a join with the table of all classes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.shared import materialize, remove
from parley.llm.text import text_slices, word_hashes

HEAD_WORDS = 300_000
EXCHANGE_WORDS = 50_000
SEED_WORDS = 1000
CLASSES = 48
SWEEPS = 4
#: Two sweeps, one for each half of the words, that raise the likelihood by less than this share each end the exchange.
LEAST_GAIN = 5e-4
BASE_ADD = 0.1
TRANSITION_ADD = 5.0
#: Distinct rows that a counting task holds before it passes them on.
HELD_ROWS = 300_000


def held_out(key: Column, parts: int = 10) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % parts == 0, F.lit(False))


def _merge(keys: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of keys, and the sums of their counts."""
    order = np.argsort(keys[0]) if len(keys) == 1 else np.lexsort(keys[::-1])
    keys, counts = [k[order] for k in keys], counts[order]
    first = np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([k[1:] != k[:-1] for k in keys])]))
    return [k[first] for k in keys], np.add.reduceat(counts, first)


def _counted(parts: Iterator[list[np.ndarray]], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Partial counts of the rows of parts, held up to HELD_ROWS."""
    held: list[tuple[list[np.ndarray], np.ndarray]] = []
    size = 0

    def merged():
        return _merge([np.concatenate(x) for x in zip(*(k for k, _ in held))], np.concatenate([c for _, c in held]))

    for keys in parts:
        if not len(keys[0]):
            continue
        held.append(_merge(keys, np.ones(len(keys[0]), np.int64)))
        size += len(held[-1][1])
        if size > 2 * HELD_ROWS:
            held = [merged()]
            size = len(held[0][1])
            if size > HELD_ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*held[0][0], held[0][1])], names)
                held, size = [], 0
    if held:
        keys, n = merged()
        for i in range(0, len(n), 200_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 200_000]) for x in (*keys, n)], names)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of the word hashes of a task's texts."""
    slices = (x for batch in batches for x in text_slices(batch.column("text")))
    yield from _counted(([word_hashes(data, rows)[0].view(np.int64)] for _, _, data, rows in slices), ["word", "n"])


def word_counts(docs: DataFrame) -> DataFrame:
    """(word hash, n) over all texts, without the ends of texts."""
    return docs.select("text").mapInArrow(_count_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Head:
    """The head words' hashes, in descending order of their counts. The first exchange of them have numbers of their own, all other words share the next one, and the ends of texts have the last."""

    words: np.ndarray
    counts: np.ndarray
    exchange: int

    @property
    def numbers(self) -> np.ndarray:
        return np.minimum(np.arange(len(self.words)), self.exchange)

    @property
    def rest(self) -> int:
        return self.exchange

    @property
    def end(self) -> int:
        return self.exchange + 1


def head_of(counts: DataFrame, limit: int = HEAD_WORDS, exchange: int = EXCHANGE_WORDS) -> tuple[Head, int]:
    """The head, and the least count of its words: the counts' histogram (in eighths of powers of two) shows where it can start."""
    step = F.floor(F.log2("n") * 8)
    bins = sorted(((r["b"], r["k"], r["low"]) for r in counts.groupBy(step.alias("b")).agg(F.count("*").alias("k"), F.min("n").alias("low")).collect()), reverse=True)
    least, total = None if bins else 1, 0
    for _, k, low in bins:
        if total + k > limit:
            break
        total, least = total + k, low
    if least is None:  # one eighth of a power alone holds too many words: none is sent
        return Head(np.zeros(0, np.int64), np.zeros(0, np.int64), 0), 1 << 62
    rows = counts.where(F.col("n") >= least).select("word", "n").toArrow()
    words, n = (rows.column(c).to_numpy().astype(np.int64) for c in ("word", "n"))
    order = np.lexsort([words, -n])
    return Head(words[order], n[order], min(exchange, len(words))), int(least)


def _numbered(words: np.ndarray, at: np.ndarray, index: pd.Index, head: Head) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(numbers of a slice's tokens with an end before the first text and after each, place in the head or -1, where each text's end stands)."""
    place = index.get_indexer(words.view(np.int64)) if len(index) and len(words) else np.full(len(words), -1)
    ends = at[1:] + np.arange(1, len(at))
    out = np.full(len(words) + len(at), head.end, np.int64)
    out[_slots(words, at)] = np.where((place < 0) | (place >= head.exchange), head.rest, place)
    return out, place, ends


def _slots(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where the words stand among the numbers of _numbered(); the number before a word is one place lower."""
    return np.arange(len(words)) + np.searchsorted(at[1:], np.arange(len(words)), "right") + 1


def _count_pairs(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head: Head = shared.value
        index = pd.Index(head.words)

        def pairs():
            for batch in batches:
                for _, _, data, rows in text_slices(batch.column("text")):
                    out, _, _ = _numbered(*word_hashes(data, rows), index, head)
                    yield [out[:-1] << 32 | out[1:]]  # one number is faster to sort than two

        for batch in _counted(pairs(), ["ab", "n"]):
            ab = batch.column("ab").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(ab >> 32), pa.array(ab & 0xFFFFFFFF), batch.column("n")], ["a", "b", "n"])

    return run


def _count_contexts(shared):
    """Partial counts of (word, history before it) for the words outside the exchange."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, classes = shared.value
        index = pd.Index(head.words)

        def contexts():
            for batch in batches:
                for _, _, data, rows in text_slices(batch.column("text")):
                    words, at = word_hashes(data, rows)
                    out, place, _ = _numbered(words, at, index, head)
                    other = (place < 0) | (place >= head.exchange)
                    yield [words[other].view(np.int64), classes[out[_slots(words, at)[other] - 1]]]

        yield from _counted(contexts(), ["word", "h", "n"])

    return run


def _entropy(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange_classes(a: np.ndarray, b: np.ndarray, n: np.ndarray, classes: np.ndarray, words: int, allowed: int, sweeps: int) -> np.ndarray:
    """Classes after exchange clustering of the numbers below words, over bigrams (a, b) seen n times.

    In turn each word goes to the class below allowed that makes the
    likelihood of the class bigrams largest, and the counts follow, until a
    sweep moves none.
    """
    classes, k = classes.copy(), int(classes.max()) + 1
    sides = []
    for x, y in ((a, b), (b, a)):
        order = np.lexsort([y, x])
        sides.append((y[order], n[order].astype(float), np.searchsorted(x[order], np.arange(words + 1))))
    m = np.zeros((k, k))
    np.add.at(m, (classes[a], classes[b]), n)
    rows, cols, d = m.sum(1), m.sum(0), np.arange(allowed)
    for _ in range(sweeps):
        moved = 0
        for w in range(words):
            own, found, itself = classes[w], [], 0.0
            for y, count, at in sides:
                near, seen = y[at[w] : at[w + 1]], count[at[w] : at[w + 1]]
                itself = float(seen[near == w].sum())
                found.append(np.bincount(classes[near], np.where(near == w, 0.0, seen), k))
            ahead, behind = found
            out, into = ahead.sum() + itself, behind.sum() + itself
            m[own] -= ahead
            m[:, own] -= behind
            m[own, own] -= itself
            rows -= behind
            cols -= ahead
            rows[own] -= out
            cols[own] -= into
            # what changes when w joins class d: its row, its column, the cell that is in both, and the margins
            gain = (_entropy(m[d] + ahead) - _entropy(m[d])).sum(1) + (_entropy(m[:, d] + behind[:, None]) - _entropy(m[:, d])).sum(0)
            cell = m[d, d]
            gain += _entropy(cell + ahead[d] + behind[d] + itself) - _entropy(cell + ahead[d]) - _entropy(cell + behind[d]) + _entropy(cell)
            gain -= _entropy(rows[d] + behind[d] + out) - _entropy(rows[d] + behind[d])
            gain -= _entropy(cols[d] + ahead[d] + into) - _entropy(cols[d] + ahead[d])
            best = int(np.argmax(np.where(d == own, gain + 1e-9, gain)))
            m[best] += ahead
            m[:, best] += behind
            m[best, best] += itself
            rows += behind
            cols += ahead
            rows[best] += out
            cols[best] += into
            moved += int(best != own)
            classes[w] = best
        if not moved:
            break
    return classes


def _gains(m: np.ndarray, ahead: np.ndarray, behind: np.ndarray, itself: float, own: int, allowed: int) -> np.ndarray:
    """What the likelihood of the class bigrams m gains when a word, taken out of its own class (-1: none yet), joins each class below allowed.

    ahead and behind hold the word's bigrams with each class, but for those with itself.
    """
    d = np.arange(allowed)
    if own >= 0:
        m = m.copy()
        m[own] -= ahead
        m[:, own] -= behind
        m[own, own] -= itself
    a, b = np.flatnonzero(ahead), np.flatnonzero(behind)
    out, into = ahead.sum() + itself, behind.sum() + itself
    rows, cols, cell, right, below = m.sum(1)[d], m.sum(0)[d], m[d, d], m[:allowed, a], m[b][:, d]
    gain = (_entropy(right + ahead[a]) - _entropy(right)).sum(1) + (_entropy(below + behind[b][:, None]) - _entropy(below)).sum(0)
    gain += _entropy(cell + ahead[d] + behind[d] + itself) - _entropy(cell + ahead[d]) - _entropy(cell + behind[d]) + _entropy(cell)
    gain -= _entropy(rows + behind[d] + out) - _entropy(rows + behind[d])
    return gain - _entropy(cols + ahead[d] + into) + _entropy(cols + ahead[d])


def _likelihood(m: np.ndarray) -> float:
    return float(_entropy(m).sum() - _entropy(m.sum(1)).sum() - _entropy(m.sum(0)).sum())


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in the order of w and side: one row for each (w, side) of a batch, its other numbers and their counts as bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        w, side, other, n = (batch.column(c).to_numpy() for c in ("w", "side", "other", "n"))
        first = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (side[1:] != side[:-1])]))
        at = np.append(first, len(w))
        blobs = [pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((at * x.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))]) for x in (other.astype(np.int32), n.astype(np.int64))]
        yield pa.RecordBatch.from_arrays([pa.array(w[first]), pa.array(side[first]), *blobs], ["w", "side", "others", "ns"])


def _values(blobs: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(all numbers of the blobs in a row, how many each has)."""
    _, offsets, data = blobs.buffers()
    at = np.frombuffer(offsets, np.int32)[blobs.offset : blobs.offset + len(blobs) + 1] // np.dtype(kind).itemsize
    return (np.frombuffer(data, kind)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, kind)), np.diff(at)


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(w, side, other, n) of each bigram in a batch of neighbours()."""
    other, lengths = _values(batch.column("others"), np.int32)
    return np.repeat(batch.column("w").to_numpy(), lengths), np.repeat(batch.column("side").to_numpy(), lengths), other, _values(batch.column("ns"), np.int64)[0]


def neighbours(pairs: DataFrame, head: Head) -> DataFrame:
    """(w, side, others, ns), the rows of a word together: the bigrams that each exchange word begins (side 0) and ends (side 1). Every sweep reads them, so they are packed."""
    row = lambda w, other, side: pairs.where(F.col(w) < head.exchange).select(F.col(w).cast("int").alias("w"), F.col(other).cast("int").alias("other"), F.lit(side).alias("side"), "n")
    # few rows that cost much: without the number Spark would put them into few tasks
    rows = row("a", "b", 0).unionByName(row("b", "a", 1)).repartition(1 + head.exchange // 250, "w").sortWithinPartitions("w", "side")
    return rows.mapInArrow(_packed, "w int, side int, others binary, ns binary")


def _turn(w: np.ndarray, classes: np.ndarray, sweep: int) -> np.ndarray:
    """Words without a class in sweep 0, then one half of all in turn with the other."""
    return classes[w] < 0 if sweep == 0 else (w * 2654435761 >> 7) % 2 == sweep % 2


def _proposals(shared):
    """(w, class): where each word whose turn it is would go, given the classes and class bigrams of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, m, allowed, sweep = shared.value
        k = len(m)
        held: tuple[int, np.ndarray] | None = None  # the word whose rows may go on in the next batch, and its counts so far

        def best(w: int, counts: np.ndarray) -> int:
            gain = _gains(m, counts[:k], counts[k : 2 * k], counts[2 * k], classes[w], allowed)
            if classes[w] >= 0:
                gain[classes[w]] += 1e-9
            return int(np.argmax(gain))

        for batch in batches:
            batch = batch.filter(pa.array(_turn(batch.column("w").to_numpy().astype(np.int64), classes, sweep)))
            if not batch.num_rows:
                continue
            w, side, other, n = _unpacked(batch)
            words, row = np.unique(w, return_inverse=True)
            own = other == w
            use = ~own & (classes[other] >= 0)
            # the class bigrams that a word begins, those that it ends, and those with itself
            at = row * (2 * k + 1) + np.where(own, 2 * k, side * k + classes[other])
            use |= own & (side == 0)
            counts = np.bincount(at[use], n[use], len(words) * (2 * k + 1)).reshape(-1, 2 * k + 1)
            done: list[tuple[int, int]] = []
            if held is not None:
                i = int(np.searchsorted(words, held[0]))
                if i < len(words) and words[i] == held[0]:
                    counts[i] += held[1]
                else:
                    done.append((held[0], best(*held)))
            last = int(np.searchsorted(words, w[-1]))
            held = int(w[-1]), counts[last]
            done += [(int(x), best(int(x), c)) for i, (x, c) in enumerate(zip(words, counts)) if i != last]
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], ["w", "class"])
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held[0]]), pa.array([best(*held)])], ["w", "class"])

    return run


def _class_matrix(rows: DataFrame, bigrams, classes: np.ndarray, k: int) -> np.ndarray:
    """Counts of class bigrams over what bigrams(batch) gives, (a, b, n); numbers without a class (-1) are left out."""
    shared = rows.sparkSession.sparkContext.broadcast(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * k)
        for batch in batches:
            a, b, n = bigrams(batch)
            a, b = shared.value[a], shared.value[b]
            use = (a >= 0) & (b >= 0)
            total += np.bincount(a[use] * k + b[use], n[use], k * k)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["at", "n"])

    found = rows.mapInArrow(run, "at long, n double").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(k * k)
    out[found.column("at").to_numpy()] = found.column("n").to_numpy()
    return out.reshape(k, k)


def class_pairs(pairs: DataFrame, classes: np.ndarray, k: int) -> np.ndarray:
    """Counts of class bigrams, from word bigrams (a, b, n); numbers without a class (-1) are left out."""
    return _class_matrix(pairs.select("a", "b", "n"), lambda batch: tuple(batch.column(c).to_numpy() for c in ("a", "b", "n")), classes, k)


def near_pairs(near: DataFrame, classes: np.ndarray, k: int) -> np.ndarray:
    """class_pairs() of all bigrams with an exchange word, from neighbours(): those that one begins, and those that one ends after another number."""
    exchange = len(classes) - 2

    def bigrams(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        w, side, other, n = _unpacked(batch)
        use = (side == 0) | (other >= exchange)
        w, side, other, n = w[use], side[use], other[use], n[use]
        return np.where(side == 0, w, other), np.where(side == 0, other, w), n

    return _class_matrix(near, bigrams, classes, k)


def exchange(pairs: DataFrame, head: Head, classes: int = CLASSES, sweeps: int = SWEEPS, seeds: int = SEED_WORDS) -> np.ndarray:
    """The class of each number; the rest and the ends keep classes of their own, classes and classes + 1.

    The seeds' bigrams, at most the square of their number, are one task. Then
    all exchange words take part: first those without a class find one, then
    each sweep lets one half of the words move after the other. Moves that do
    not raise the likelihood together are tried again by fewer words. It ends
    after sweeps that move none, or gain too little (LEAST_GAIN).
    """
    spark = pairs.sparkSession
    k, n, seeds = classes + 2, head.exchange, min(seeds, head.exchange)
    found = np.concatenate([np.full(n, -1), [classes, classes + 1]])

    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[x.column(c).to_numpy() for c in ("a", "b", "n")] for x in batches]
        if parts:
            a, b, count = (np.concatenate(x) for x in zip(*parts))
            a, b = (np.where(x >= n, x - n + seeds, x) for x in (a, b))
            first = np.concatenate([np.arange(seeds) % classes, [classes, classes + 1]])
            yield pa.RecordBatch.from_arrays([pa.array(exchange_classes(a, b, count, first, seeds, min(classes, max(1, seeds)), sweeps))], ["class"])

    inside = lambda c: (F.col(c) < seeds) | (F.col(c) >= n)
    first = pairs.where(inside("a") & inside("b")).repartition(1).mapInArrow(seed, "class long").toArrow().column("class").to_numpy()
    found[:seeds] = first[:seeds] if len(first) else 0
    near = materialize(neighbours(pairs, head), "neighbours")
    others = class_pairs(pairs.where((F.col("a") >= n) & (F.col("b") >= n)), found, k)  # these never move
    m = near_pairs(near, found, k) + others
    little = 0
    for sweep in range(2 * sweeps + 1 if n else 0):
        shared = spark.sparkContext.broadcast((found, m, min(classes, max(1, seeds)), sweep))
        new = near.mapInArrow(_proposals(shared), "w long, class long").toArrow()
        w, c = new.column("w").to_numpy(), new.column("class").to_numpy()
        moving = found[w] != c
        w, c, kept = w[moving], c[moving], False
        for _ in range(3):
            if not len(w):
                break
            moved = found.copy()
            moved[w] = c
            m1 = near_pairs(near, moved, k) + others
            was, now = _likelihood(m), _likelihood(m1)
            if sweep == 0 or now > was:
                little = little + 1 if sweep and now - was < LEAST_GAIN * abs(was) else 0
                found, m, kept = moved, m1, True
                break
            some = w % 4 == sweep % 4
            w, c = w[some], c[some]
        if little == 2 or not kept and sweep > 1:
            break
    remove(spark, near)
    found[:n] = np.maximum(found[:n], 0)
    return found


@dataclass
class BrownModel:
    """Logarithms (base 10) of the transitions from histories to classes, and of an unknown word after a history; each class's tokens; counts of all."""

    head: Head
    classes: np.ndarray
    transitions: np.ndarray
    unknown: np.ndarray
    owner: np.ndarray
    size: np.ndarray
    discount: float
    tokens: int
    types: int
    least: int

    @property
    def emissions(self) -> np.ndarray:
        """Those of the head words."""
        return np.log10((self.head.counts - self.discount) / self.size[self.owner]) if len(self.owner) else np.zeros(0)

    def base(self, counts):
        return np.log10((counts + BASE_ADD) / (self.tokens + BASE_ADD * (self.types + 1)))


def smoothed(matrix: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    """Transition probabilities from counts: each row with TRANSITION_ADD counts more, shared out as all rows are together; classes not allowed get none."""
    matrix = matrix * allowed
    every = (matrix.sum(0) + 1) * allowed
    return (matrix + TRANSITION_ADD * every / every.sum()) / (matrix.sum(1, keepdims=True) + TRANSITION_ADD)


def _log(x: np.ndarray) -> np.ndarray:
    return np.log10(np.maximum(x, 1e-300))


def other_classes(training: DataFrame, head: Head, classes: np.ndarray, pairs: np.ndarray) -> DataFrame:
    """(word, n, class, hs, ns) for each training word outside the exchange: its class is the one of largest likelihood over the histories before it.

    pairs: class bigrams of the exchange words. Words of equal likelihood go to the first class.
    """
    shared = training.sparkSession.sparkContext.broadcast((head, classes))
    k = len(pairs) - 2
    size = pairs[:, :k].sum(0)
    allowed = np.concatenate([size > 0, [False, False]]) if size.any() else np.arange(k + 2) == 0
    worth = (_log(smoothed(pairs, allowed)) - _log(np.append(np.maximum(size, 1), [1, 1])))[:, :k] + np.where(allowed[:k], 0, -1e6)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("hs").value_lengths().to_numpy()
            row = np.repeat(np.arange(len(lengths)), lengths)
            h, n = (batch.column(c).flatten().to_numpy() for c in ("hs", "ns"))
            seen = np.bincount(row * (k + 2) + h, n, len(lengths) * (k + 2)).reshape(-1, k + 2)
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(seen.sum(1).astype(np.int64)), pa.array(np.argmax(np.round(seen @ worth, 6), 1)), batch.column("hs"), batch.column("ns")], ["word", "n", "class", "hs", "ns"])

    rows = training.select("text").mapInArrow(_count_contexts(shared), "word long, h long, n long").repartition("word").groupBy("word", "h").agg(F.sum("n").alias("n"))
    rows = rows.groupBy("word").agg(F.collect_list(F.struct("h", "n")).alias("x")).select("word", F.col("x.h").alias("hs"), F.col("x.n").alias("ns"))
    return rows.mapInArrow(run, "word long, n long, class long, hs array<long>, ns array<long>")


def fit(counts: DataFrame, training: DataFrame, texts: int) -> tuple[BrownModel, DataFrame]:
    """The model, and (word, n, class) of the words outside the exchange. counts: word_counts() of training, which has so many texts. Holds the head and two small matrices on the driver."""
    spark = training.sparkSession
    head, least = head_of(counts)
    sums = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.count(F.when(F.col("n") == 1, 1)).alias("once"), F.count(F.when(F.col("n") == 2, 1)).alias("twice")).first()
    discount = min(0.9, max(0.1, sums["once"] / max(1, sums["once"] + 2 * sums["twice"])))
    shared = spark.sparkContext.broadcast(head)
    pairs = materialize(training.select("text").mapInArrow(_count_pairs(shared), "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n")), "bigrams")
    k = CLASSES
    classes = exchange(pairs, head, k)
    matrix = class_pairs(pairs, classes, k + 2)
    others = materialize(other_classes(training, head, classes, matrix), "word-classes")
    matrix[:, k] = 0
    size = np.bincount(classes[: head.exchange], head.counts[: head.exchange], k + 2).astype(float)
    types = np.bincount(classes[: head.exchange], minlength=k + 2).astype(float)
    for r in others.select("class", F.explode(F.arrays_zip("hs", "ns")).alias("x")).groupBy("class", F.col("x.hs").alias("h")).agg(F.sum("x.ns").alias("n")).collect():
        matrix[r["h"], r["class"]] += r["n"]
    for r in others.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        size[r["class"]] += r["n"]
        types[r["class"]] += r["v"]
    allowed = (size > 0) | (np.arange(k + 2) == k + 1)
    transitions = smoothed(matrix, allowed)
    unknown = _log(transitions @ (discount * types / np.maximum(size, 1)))
    owner = np.concatenate([classes[: head.exchange], np.zeros(len(head.words) - head.exchange, np.int64)])
    more = others.where(F.col("n") >= least).select("word", "class").toArrow()
    owner[pd.Index(head.words).get_indexer(more.column("word").to_numpy())] = more.column("class").to_numpy()
    remove(spark, pairs)
    model = BrownModel(head, classes, _log(transitions), unknown, owner, size, discount, int(sums["n"] or 0) + texts, int(sums["v"]) + int(texts > 0), least)
    return model, others.select("word", "n", "class")


def score(docs: DataFrame, model: BrownModel, others: DataFrame, training_texts: int, key: str = "doc_id") -> DataFrame:
    """One row for each row of docs: key, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null texts are empty: one token, the end. Head words are scored where the
    text is; only tokens of rarer words go through a join with their counts and
    classes. Every row is scored by its own text, repeated rows alike; other
    columns are ignored.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: BrownModel = shared.value
        index, end = pd.Index(m.head.words), m.classes[m.head.end]
        base, emissions, owner = m.base(np.append(m.head.counts, 0).astype(float)), np.append(m.emissions, 0.0), np.append(m.owner, 0)
        end_base = float(m.base(np.array([training_texts], float))[0])
        for batch in batches:
            for a, b, data, rows in text_slices(batch.column("text")):
                words, at = word_hashes(data, rows)
                out, place, ends = _numbered(words, at, index, m.head)
                history, known = m.classes[out], place >= 0
                before = history[_slots(words, at) - 1]
                steps = np.where(known, m.transitions[before, owner[place]] + emissions[place], 0)
                sums = [np.concatenate([[0], np.cumsum(x)]) for x in (np.where(known, base[place], 0), steps, known.astype(np.int64))]
                s_base, s_steps, s_known = (x[at[1:]] - x[at[:-1]] for x in sums)
                s_steps = s_steps + m.transitions[history[ends - 1], end]
                rare = np.concatenate([[0], np.cumsum(~known)])
                lists = [pa.LargeListArray.from_arrays(pa.array(rare[at]), pa.array(x)).cast(pa.list_(pa.int64())) for x in (words[~known].view(np.int64), before[~known])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(key)[a:b], batch.column("held_out")[a:b], batch.column("row")[a:b], pa.array(np.diff(at) + 1), pa.array(s_known + int(training_texts > 0)), pa.array(s_base + end_base), pa.array(s_steps), *lists],
                    [key, "held_out", "row", "n_tokens", "known", "base", "steps", "tail", "before"],
                )

    plain = docs.select(key, held_out(F.col(key)).alias("held_out"), F.monotonically_increasing_id().alias("row"), "text")
    partial = materialize(plain.mapInArrow(run, f"`{key}` {kind}, held_out boolean, row long, n_tokens long, known long, base double, steps double, tail array<long>, before array<long>"), "partial-scores")
    rare = partial.select("row", F.explode(F.arrays_zip("tail", "before")).alias("x")).groupBy("row", F.col("x.tail").alias("word"), F.col("x.before").alias("before")).agg(F.count("*").alias("k"))
    n = F.coalesce("n", F.lit(0))
    base = F.log10((n + BASE_ADD) / F.lit(model.tokens + BASE_ADD * (model.types + 1)))
    # one row for each history and class, and one for each history and no class
    small = [(h, c, float(model.transitions[h, c] - _log(np.maximum(model.size[c], 1)))) for h in range(len(model.transitions)) for c in range(len(model.size))] + [(h, -1, float(x)) for h, x in enumerate(model.unknown)]
    steps = F.broadcast(spark.createDataFrame(pd.DataFrame(small, columns=["before", "class", "step"])))
    found = rare.join(others.where(F.col("n") < model.least), "word", "left").withColumn("class", F.coalesce("class", F.lit(-1).cast("long"))).join(steps, ["before", "class"])
    emit = F.col("step") + F.when(n > 0, F.log10(n - model.discount)).otherwise(0)
    found = found.groupBy("row").agg(F.sum(F.when(n > 0, F.col("k")).otherwise(0)).alias("more"), F.sum(F.col("k") * base).alias("more_base"), F.sum(F.col("k") * emit).alias("more_steps"))
    out = partial.drop("tail", "before").join(found, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select(
        key, "held_out", "n_tokens", (F.col("known") + zero("more")).cast("long").alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + zero("more_base")).alias("base_score"), (F.col("steps") + zero("more_steps")).alias("score"),
    )


def brown_scores(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Learns from the rows that are not held out and scores all. Rows without a key are not held out. No rows give no rows."""
    training = docs.where(~held_out(F.col(key)))
    counts = materialize(word_counts(training), "words")
    texts = training.count()
    model, others = fit(counts, training, texts)
    remove(docs.sparkSession, counts)
    return score(docs, model, others, texts, key)
