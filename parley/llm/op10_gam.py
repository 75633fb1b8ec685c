"""Quality classifier: a generalised additive model with pairwise interactions.

Features are counts over a text's bytes and words. Boosting goes round the
features in turn and adds a shallow tree over one feature's bins each time; the
trees of a feature add up to one lookup table. Pairs of features with the
strongest interaction get tables of two dimensions the same way. A score is the
sum of the looked-up entries through a logistic function.

The model is fitted on the driver on at most MAX_TRAIN_ROWS labelled rows, taken
by the least hash of their key. Scoring runs over all rows, in their tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.shared import materialize
from parley.llm.text import text_slices, word_hashes

MAX_TRAIN_ROWS = 20_000
BINS = 48
ROUNDS = 120
PAIR_ROUNDS = 60
RATE = 0.1
PAIRS = 6
CUT = 0.3

FEATURES = [
    "log_words", "word_length", "symbols", "upper", "digits", "distinct_words", "same_as_before", "exclamations", "bars", "words_per_line", "stops", "other_bytes", "inner_marks", "distinct_nearby",
]


def _class(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


_SYMBOLS, _UPPER, _DIGITS = _class(b"#*$%&<>@^~{}[]\\/+="), _class(bytes(range(65, 91))), _class(b"0123456789")
_BANG, _BAR, _LINE, _STOP, _HIGH = _class(b"!"), _class(b"|"), _class(b"\n"), _class(b".,"), _class(bytes(range(128, 256)))


def _distinct_nearby(words: np.ndarray, at: np.ndarray, window: int = 100) -> np.ndarray:
    """Mean share of distinct words in the windows that each text is cut into; 0 without words."""
    n = np.diff(at)
    windows = -(-n // window)
    first = np.concatenate([[0], np.cumsum(windows)])
    owner = np.repeat(np.arange(len(n)), n)
    place = first[owner] + (np.arange(len(words)) - at[owner]) // window
    order = np.lexsort([words, place])
    w, p = words[order], place[order]
    new = np.ones(len(w), bool)
    new[1:] = (w[1:] != w[:-1]) | (p[1:] != p[:-1])
    total = first[-1]
    share = np.bincount(p, new, total) / np.maximum(np.bincount(p, minlength=total), 1)
    return np.bincount(np.repeat(np.arange(len(n)), windows), share, len(n)) / np.maximum(windows, 1)


def features(data: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text of a slice."""
    words, at = word_hashes(data, rows)
    n, size = np.diff(at).astype(float), np.diff(rows).astype(float)

    def share(table: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(table[data])])
        return (total[rows[1:]] - total[rows[:-1]]) / np.maximum(size, 1)

    same = np.concatenate([[0, 0], np.cumsum(words[1:] == words[:-1])])[: len(words) + 1] if len(words) else np.zeros(1)
    inside = np.maximum(at[:-1] + 1, 0)
    repeats = np.where(n > 1, same[at[1:]] - same[np.minimum(inside, at[1:])], 0)
    distinct = np.array([len(np.unique(words[a:b])) for a, b in zip(at, at[1:])], float)
    nearby = _distinct_nearby(words, at)
    lines = share(_LINE) * size + 1
    symbols = share(_SYMBOLS)
    return np.stack(
        [
            np.log1p(n), size / np.maximum(n, 1), symbols, share(_UPPER), share(_DIGITS), distinct / np.maximum(n, 1) * np.log1p(n),
            repeats / np.maximum(n, 1), share(_BANG), share(_BAR), np.log1p(n / lines), share(_STOP), share(_HIGH), symbols * size / np.maximum(n, 1), nearby,
        ],
        1,
    )


@dataclass
class Gam:
    """edges[f] cut feature f into bins; tables[f] holds a number for each bin, pair_tables[p] for each pair of bins."""

    edges: list[np.ndarray]
    intercept: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], "right") for f, e in enumerate(self.edges)], 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        total = np.full(len(x), self.intercept)
        for f, t in enumerate(self.tables):
            total += t[b[:, f]]
        for (f, g), t in zip(self.pairs, self.pair_tables):
            total += t[b[:, f], b[:, g]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _leaf(g, h):
    return g / (h + 1.0)


def _gain(g, h):
    return g * g / (h + 1.0)


def _split(g: np.ndarray, h: np.ndarray) -> tuple[int, float]:
    """The best cut of a row of bins, and what it gains."""
    cg, ch = np.cumsum(g), np.cumsum(h)
    if len(g) < 2:
        return 0, 0.0
    gain = _gain(cg[:-1], ch[:-1]) + _gain(cg[-1] - cg[:-1], ch[-1] - ch[:-1]) - _gain(cg[-1], ch[-1])
    gain = np.where((ch[:-1] < 1.0) | (ch[-1] - ch[:-1] < 1.0), 0, gain)
    i = int(np.argmax(gain))
    return i + 1, float(gain[i])


def shallow_tree(g: np.ndarray, h: np.ndarray, leaves: int = 4) -> np.ndarray:
    """A value for each bin: the tree with up to so many leaves that is grown best first."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        best = max(((*_split(g[a:b], h[a:b]), a, b) for a, b in parts), key=lambda x: x[1])
        if best[1] <= 1e-9:
            break
        at, _, a, b = best
        parts.remove((a, b))
        parts += [(a, a + at), (a + at, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = _leaf(g[a:b].sum(), h[a:b].sum())
    return out


def shallow_grid(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The same over two features: one cut of the first, then one of the second on each side."""
    at, gain = _split(g.sum(1), h.sum(1))
    at = at if gain > 0 else len(g)
    out = np.zeros_like(g)
    for side in (slice(0, at), slice(at, len(g))):
        if g[side].size:
            out[side] = shallow_tree(g[side].sum(0), h[side].sum(0), 2)
    return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, pair_rounds: int = PAIR_ROUNDS, rate: float = RATE, n_pairs: int = PAIRS) -> Gam:
    """Cyclic boosting on rows x with labels y in {0, 1}. No rows, or one label only, give the constant model."""
    n_features = x.shape[1]
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for f in range(n_features)]
    rate0 = (y.sum() + 0.5) / (len(y) + 1.0)
    model = Gam(edges, float(np.log(rate0 / (1 - rate0))), [np.zeros(len(e) + 1) for e in edges], [], [])
    if not len(x) or y.min() == y.max():
        return model
    b = model.bins(x)
    total = np.full(len(x), model.intercept)

    def residuals() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for f in range(n_features):
            r, w = residuals()
            k = len(model.tables[f])
            step = rate * shallow_tree(np.bincount(b[:, f], r, k), np.bincount(b[:, f], w, k))
            model.tables[f] += step
            total += step[b[:, f]]
    r, w = residuals()
    strength = []
    for f in range(n_features):
        for g in range(f + 1, n_features):
            shape = (len(model.tables[f]), len(model.tables[g]))
            flat = b[:, f] * shape[1] + b[:, g]
            gs, hs = np.bincount(flat, r, shape[0] * shape[1]).reshape(shape), np.bincount(flat, w, shape[0] * shape[1]).reshape(shape)
            strength.append((float((shallow_grid(gs, hs) * gs).sum()), f, g))
    for _, f, g in sorted(strength, reverse=True)[:n_pairs]:
        model.pairs.append((f, g))
        model.pair_tables.append(np.zeros((len(model.tables[f]), len(model.tables[g]))))
    for _ in range(pair_rounds):
        for k, (f, g) in enumerate(model.pairs):
            r, w = residuals()
            shape = model.pair_tables[k].shape
            flat = b[:, f] * shape[1] + b[:, g]
            step = rate * shallow_grid(np.bincount(flat, r, shape[0] * shape[1]).reshape(shape), np.bincount(flat, w, shape[0] * shape[1]).reshape(shape))
            model.pair_tables[k] += step
            total += step[b[:, f], b[:, g]]
    return model


def held_out(key: Column, parts: int = 5) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % parts == 0, F.lit(False))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, rows in text_slices(batch.column("text")):
            x = features(data, rows)
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column("label")[a:b]], ["x", "label"])


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", max_rows: int = MAX_TRAIN_ROWS) -> Gam:
    """Fits on labelled rows outside the held-out fifth, at most max_rows of them, those with the least hash of the key. Null keys and labels teach nothing."""
    usable = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(F.col(key))).select(F.col(key), F.col(label).cast("int").alias("label"))
    sample = materialize(usable.orderBy(F.xxhash64(key), "label").limit(max_rows), "labelled")
    rows = docs.select(key, "text").join(sample, key).select("text", "label").mapInArrow(_featured, "x array<double>, label int").toPandas()
    x = np.stack(rows["x"].to_list()) if len(rows) else np.zeros((0, len(FEATURES)))
    y = rows["label"].to_numpy().astype(float)
    order = np.lexsort([*x.T, y])
    return fit(x[order], y[order])


def score(docs: DataFrame, model: Gam, key: str = "doc_id", cut: float = CUT) -> DataFrame:
    """One row for each row of docs: key, held_out, score, predicted.

    Null and empty texts are scored as texts without words. A row's score
    follows from its text alone, so repeated rows and equal texts get equal
    scores; no rows give no rows. Other columns of docs are ignored.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, rows in text_slices(batch.column("text")):
                s = model.score(features(data, rows))
                yield pa.RecordBatch.from_arrays([batch.column(key)[a:b], batch.column("held_out")[a:b], pa.array(s), pa.array((s >= cut).astype(np.int32))], [key, "held_out", "score", "predicted"])

    return docs.select(key, held_out(F.col(key)).alias("held_out"), "text").mapInArrow(run, f"`{key}` {kind}, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    return score(docs, train(docs, labels, key), key)
