"""N-gram Jaccard join over count vectors held in R-trees.

A document is the set of its hashed word shingles. Hashing shingles into groups
and counting each group makes it a point: coordinate minima summed over two
points bound their overlap from above, and so do minima with the upper corner
of a box of points, which is what an R-tree prunes by.

A second grouping deals points to trees: two sets that differ in at most R
shingles agree wholly in one of R + 1 groups, so documents meet in the cell of
(size class, group, content of the group) and no link between cells is lost.
There are more groups than that, so that a set may leave its empty groups out:
if it has no more of them than there are groups to spare, it still agrees with
each partner in a group that is not empty.

1. A cell's members are compared with one of them, its pivot: the one that
   shares cells with most others, such as the original of a group of near
   copies. That joins large groups by as many comparisons as members.
2. Only members of cells that still hold several components go on. A shingle
   that no other of them has is lonely; a set with too many lonely ones links
   with nothing and leaves. The rest of its shingles is its reach.
3. Further pivots, each from those that the last one has not joined.
4. R-trees over what is left of each cell find the pairs that neither summed
   minima nor reach rule out; finer points, of about as many coordinates as a
   set has shingles, bound them once more.

Every surviving pair is verified on whole texts. Documents with equal sets form
one node from the start. Nodes are 64-bit sums of mixed shingle hashes; N
distinct sets collide with a chance of N^2 / 2^65.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.shared import KeyFilter, connected_components, materialize, remove
from parley.llm.text import mix, shingle_sets, text_slices, word_hashes

#: Coordinates of the points that pivots are compared by; those in the trees have more for larger sets.
COUNT_GROUPS = 64
#: Each size class ends at this multiple of its start.
CLASS_WIDTH = 1.4
#: Cells of more members, or of more coordinates in all, are compared block by block.
CELL_BLOCK, BLOCK_COORDINATES = 512, 1 << 21
LEAF = 16
#: Rounds of further pivots; later ones are left out when a round finds no link.
MORE_PIVOTS = 2
#: Lonely shingles are looked for among this part of all, then among all shingles of the sets that are left.
FIRST_PART = (3, 8)
#: Nodes that a task remembers to pass equal documents over.
SEEN_NODES = 200_000
#: Bits of a cell's key. The lower ones are zero, which a shuffle of the cells packs; two cells of one key only cost comparisons.
CELL_BITS = 48


class Threshold:
    """Jaccard similarity of at least num / den, in whole numbers: den * both >= num * (a + b - both)."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def overlap(self, a, b):
        """The least overlap that links sets of sizes a and b."""
        return -((-self.num * (a + b)) // (self.num + self.den))

    def classes(self, largest: int) -> np.ndarray:
        """Starts of the size classes up to largest."""
        starts = [1]
        while starts[-1] <= largest:
            starts.append(max(starts[-1] + 1, int(starts[-1] * CLASS_WIDTH)))
        return np.array(starts, np.int64)

    def difference(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """The most shingles in which two linked sets differ, if the smaller has start <= size < stop."""
        a = stop - 1
        return (a + a * self.den // self.num) * (self.den - self.num) // (self.den + self.num)

    def groups(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """One group more than the difference, and room for as many groups as are likely to be empty in a set of start shingles."""
        least = self.difference(start, stop) + 1
        n = least.astype(float)
        for _ in range(4):
            empty = n * np.exp(-start / n)
            n = least + np.where(least > 1, np.ceil(empty + 2 * np.sqrt(empty)), 0)
        return n.astype(np.int64)


def _u(x: int) -> np.uint64:
    return np.uint64(x & 0xFFFFFFFFFFFFFFFF)


def set_sums(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint for each set; 0 is that of the empty set."""
    with np.errstate(over="ignore"):
        total = np.concatenate([[_u(0)], np.cumsum(mix(sets ^ _u(0x5851F42D4C957F2D)), dtype=np.uint64)])
        return mix(total[bounds[1:]] - total[bounds[:-1]])


def count_vectors(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    rows = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    flat = np.bincount(rows * COUNT_GROUPS + (mix(sets ^ _u(0x2545F4914F6CDD1D)) % _u(COUNT_GROUPS)).astype(np.int64), minlength=(len(bounds) - 1) * COUNT_GROUPS)
    return flat.reshape(-1, COUNT_GROUPS).astype(np.int32)


def fine_points(sets: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """A point for each set, a byte a coordinate. There are as many coordinates as shingles, up to the next power of two, and more if a count passes 255."""
    out = []
    for a, b in zip(bounds, bounds[1:]):
        spread = mix(sets[a:b] ^ _u(0x2545F4914F6CDD1D))
        n = max(COUNT_GROUPS, 1 << int(b - a - 1).bit_length()) if b > a else COUNT_GROUPS
        while (counts := np.bincount((spread & _u(n - 1)).astype(np.int64), minlength=n)).max() > 255:
            n *= 2
        out.append(counts.astype(np.uint8).tobytes())
    return out


def folded(points: list[bytes], least: int | None = None) -> np.ndarray:
    """The points at the least number of coordinates among them, or a smaller power of two; a coordinate of the shorter sums those of the longer that are equal modulo its length."""
    least = least or min(map(len, points))
    return np.stack([np.frombuffer(p, np.uint8).reshape(-1, least).sum(0, dtype=np.uint32) for p in points])


def cell_keys(sets: np.ndarray, bounds: np.ndarray, limit: Threshold) -> tuple[np.ndarray, np.ndarray]:
    """(keys of the cells of each set, offsets). A set stands in the cells of its own size class and, if a smaller partner may be in the class below, of that too."""
    sizes = np.diff(bounds)
    starts = limit.classes(int(sizes.max(initial=1)) + 1)
    own = np.searchsorted(starts, sizes, "right") - 1
    smallest = np.maximum(1, -(-sizes * limit.num // limit.den))
    below = np.searchsorted(starts, smallest, "right") - 1
    full = sizes > 0
    # a class is no narrower than the ratio of two linked sizes, but for the least sizes where several may lie between
    doc, cls = [], []
    step = 0
    while (some := np.flatnonzero(full & (own - step >= below))).size:
        doc.append(some)
        cls.append(own[some] - step)
        step += 1
    if not doc:
        return np.zeros(0, np.int64), np.zeros(len(sizes) + 1, np.int64)
    doc, cls = np.concatenate(doc), np.concatenate(cls)
    order = np.argsort(doc, kind="stable")
    doc, cls = doc[order], cls[order]
    groups = limit.groups(starts[cls], starts[cls + 1])
    base = np.concatenate([[0], np.cumsum(groups)])
    n = sizes[doc]
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(bounds[doc], n)
    one = sets[at]
    slot = (mix(one ^ _u(0x9E6C63D0876A9A47)) % np.repeat(groups, n).astype(np.uint64)).astype(np.int64) + np.repeat(base[:-1], n)
    with np.errstate(over="ignore"):
        sums = np.zeros(base[-1], np.uint64)
        np.add.at(sums, slot, mix(one ^ _u(0xA0761D6478BD642F)))
        number = (np.arange(base[-1]) - np.repeat(base[:-1], groups)).astype(np.uint64)
        keys = mix(sums + mix(number + np.repeat(cls, groups).astype(np.uint64) * _u(0x100000001)))
    filled = np.zeros(base[-1], bool)
    filled[slot] = True
    spare = groups - limit.difference(starts[cls], starts[cls + 1]) - 1
    few = groups - np.add.reduceat(filled, base[:-1]) <= spare
    keep = filled | np.repeat(~few, groups)
    ends = np.concatenate([[0], np.cumsum(keep)])[base[np.searchsorted(doc, np.arange(len(sizes) + 1))]]
    return keys[keep].view(np.int64), ends


class RTree:
    """Points in nested boxes, packed by halving along the widest coordinate; a box is its upper corner, least size and furthest reach."""

    def __init__(self, points: np.ndarray, reach: np.ndarray | None = None):
        self.points, self.sizes = points, points.sum(1, dtype=np.int64)
        self.reach = self.sizes if reach is None else reach
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.order = self._pack(np.arange(len(points)))
        level = self.leaves = points[self.order], self.sizes[self.order], self.reach[self.order]
        while True:
            edges = np.arange(0, len(level[0]), LEAF)
            level = np.maximum.reduceat(level[0], edges), np.minimum.reduceat(level[1], edges), np.maximum.reduceat(level[2], edges)
            self.levels.append(level)
            if len(edges) == 1:
                break
        self.levels.reverse()

    def _pack(self, ids: np.ndarray) -> np.ndarray:
        done, todo = [], [ids]
        while todo:
            one = todo.pop()
            if len(one) <= LEAF:
                done.append(one)
                continue
            p = self.points[one]
            dim = int(np.argmax(p.max(0) - p.min(0)))
            half = max(LEAF, (len(one) // 2) // LEAF * LEAF)
            split = one[np.argsort(p[:, dim], kind="stable")]
            todo += [split[half:], split[:half]]
        return np.concatenate(done)

    def search(self, queries: np.ndarray, limit: Threshold, reach: np.ndarray | None = None, chunk: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, point) indices of the pairs whose bound reaches the overlap that their sizes need."""
        sizes = queries.sum(1, dtype=np.int64)
        reach = sizes if reach is None else reach
        stack = [(0, np.repeat(np.arange(len(queries)), len(self.levels[0][0])), np.tile(np.arange(len(self.levels[0][0])), len(queries)))]
        while stack:
            level, q, box = stack.pop()
            if len(q) * queries.shape[1] > chunk and len(q) > 1:
                half = len(q) // 2
                stack += [(level, q[half:], box[half:]), (level, q[:half], box[:half])]
                continue
            leaf = level == len(self.levels)
            high, small, far = self.leaves if leaf else self.levels[level]
            need = limit.overlap(sizes[q], small[box] if leaf else np.maximum(small[box], -(-sizes[q] * limit.num // limit.den)))
            ok = np.minimum(reach[q], far[box]) >= need
            q, box, need = q[ok], box[ok], need[ok]
            ok = np.minimum(queries[q], high[box]).sum(1, dtype=np.int64) >= need
            q, box = q[ok], box[ok]
            if leaf:
                yield q, self.order[box]
                continue
            if not len(q):
                continue
            below = len(self.levels[level + 1][0]) if level + 1 < len(self.levels) else len(self.points)
            first, last = box * LEAF, np.minimum((box + 1) * LEAF, below)
            n = last - first
            stack.append((level + 1, np.repeat(q, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)))


def _list(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), pa.array(values, kind)).cast(pa.list_(kind))


def fingerprints(docs: DataFrame, key: str, size: int) -> DataFrame:
    """(key, n, node, point) for each row."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, rows in text_slices(batch.column("text")):
                sets, bounds = shingle_sets(*word_hashes(data, rows), size)
                points = count_vectors(sets, bounds)
                lists = _list(points.ravel(), np.arange(b - a + 1) * COUNT_GROUPS, pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(key)[a:b], pa.array(np.diff(bounds)), pa.array(set_sums(sets, bounds).view(np.int64)), lists], [key, "n", "node", "point"])

    return docs.select(key, "text").mapInArrow(run, f"`{key}` {kind}, n long, node long, point array<int>")


def cell_rows(docs: DataFrame, size: int, limit: Threshold) -> DataFrame:
    """(cell, node) for the cells of each document. A task gives those of equal documents once, as far as it remembers them.

    The two lowest bits of a cell are not its own: they are 0 for the only node
    of a slice of texts in its cell, 1 for the first of several, 2 for the others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, _, data, rows in text_slices(batch.column("text")):
                if len(seen) > SEEN_NODES:
                    seen.clear()
                sets, bounds = shingle_sets(*word_hashes(data, rows), size)
                nodes = set_sums(sets, bounds).view(np.int64)
                new = np.array([not (x in seen or seen.add(x)) for x in nodes.tolist()], bool)
                n = np.diff(bounds)
                cells, ends = cell_keys(sets[np.repeat(new, n)], np.concatenate([[0], np.cumsum(np.where(new, n, 0))]), limit)
                cells = cells & (-1 << 64 - CELL_BITS)
                order = np.argsort(cells, kind="stable")
                cells, nodes = cells[order], np.repeat(nodes, np.diff(ends))[order]
                again = np.concatenate([[False], cells[1:] == cells[:-1]])[: len(cells)]
                followed = np.concatenate([again[1:], [False]])[: len(cells)]
                yield pa.RecordBatch.from_arrays([pa.array(cells + np.where(again, 2, followed)), pa.array(nodes)], ["cell", "node"])

    return docs.select("text").mapInArrow(run, "cell long, node long")


def _member_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (cell, node) in order: for a cell of just two nodes that stand in different slices, one row (null, node, other); for larger ones (cell, node, null) of each node. Holds no more than a batch."""
    cell = last = None
    waiting: list[int] = []  # the first nodes of the last cell, as long as they may be all of it

    def rows(cells, nodes, others=None):
        whole = others is None
        return pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(nodes, pa.int64()), pa.nulls(len(nodes), pa.int64()) if whole else pa.array(others, pa.int64())], ["cell", "node", "other"])

    def pair(two):
        return rows([None], [min(two)], [max(two)])

    for batch in batches:
        cells, nodes = batch.column("cell").to_numpy(), batch.column("node").to_numpy()
        kinds, cells = cells & 3, cells & ~3
        if (kinds == 2).any():
            yield rows(cells[kinds == 2], nodes[kinds == 2])
        cells, nodes, kinds = (x[kinds != 2] for x in (cells, nodes, kinds))
        if not len(cells):
            continue
        new = np.concatenate([[cell is None or cells[0] != cell], cells[1:] != cells[:-1]])
        same = np.concatenate([[not new[0] and nodes[0] == last], ~new[1:] & (nodes[1:] == nodes[:-1])])
        run = np.cumsum(new)
        held = len(waiting)  # of run 0, which is the last cell of the batch before
        distinct = np.bincount(run, ~same, run[-1] + 1).astype(np.int64)
        distinct[0] += held if cell is not None else 0
        large = (distinct > 2) | (np.bincount(run, kinds == 1, run[-1] + 1) > 0)
        if cell is not None and not held and not new[0]:
            large[0] = True  # its nodes are on their way already
        if held and large[0]:
            yield rows([cell] * held, waiting)
            waiting = []
        go = large[run] & ~same
        if go.any():
            yield rows(cells[go], nodes[go])
        if held and not large[0] and run[-1] > 0:
            two = [*waiting, *nodes[(run == 0) & ~same].tolist()]
            if len(two) == 2:
                yield pair(two)
            waiting = []
        closed = np.flatnonzero(~large & (distinct == 2) & (np.arange(len(large)) > 0) & (np.arange(len(large)) < run[-1]))
        if len(closed):
            at = np.flatnonzero(np.isin(run, closed) & ~same)
            first, second = nodes[at[::2]], nodes[at[1::2]]
            yield rows([None] * len(first), np.minimum(first, second), np.maximum(first, second))
        if run[-1] > 0 or not large[0]:
            waiting = (waiting if run[-1] == 0 else []) + ([] if large[-1] else nodes[(run == run[-1]) & ~same].tolist())
        cell, last = cells[-1], nodes[-1]
    if len(waiting) == 2:
        yield pair(waiting)


def cell_members(docs: DataFrame, size: int, limit: Threshold) -> DataFrame:
    """Distinct (cell, node, other): cells of three nodes or more with each node, and the pairs of all cells of two, which need no cell any more.

    Only the first node of each slice of texts goes to the task of its cell; the
    others are dealt out, as their first one brings the news that they are
    several. So a cell that is everywhere costs its task a row a slice.
    """
    own = F.shiftright("cell", 2)
    task = F.when(F.col("cell").bitwiseAND(F.lit(3)) < 2, own).otherwise(F.xxhash64("cell", "node"))
    return cell_rows(docs, size, limit).repartition(task).sortWithinPartitions(own, "node").mapInArrow(_member_rows, "cell long, node long, other long").distinct()


def central_pivots(members: DataFrame, tried: DataFrame | None = None, joined: DataFrame | None = None) -> DataFrame:
    """(cell, pivot): the most central member of each cell, the one whose cells have most members in all.

    Pivots tried (cell, node) before are left out. Members outside the component
    of the last pivot, joined (cell, last), come first.
    """
    sizes = members.groupBy("cell").agg(F.count("*").alias("size"))
    weights = members.join(sizes, "cell").groupBy("node").agg(F.sum("size").alias("weight"))
    free = members.withColumn("outside", F.lit(True)) if joined is None else members.join(joined, "cell", "left").withColumn("outside", F.coalesce(F.col("component") != F.col("last"), F.lit(True)))
    free = free if tried is None else free.join(tried, ["cell", "node"], "left_anti")
    # written first: else Spark gathers by cell on the join's partitions, without sums in each task before
    free = materialize(free.join(weights, "node").select("cell", F.struct("outside", "weight", "node").alias("x")), "candidates")
    return free.groupBy("cell").agg(F.max("x")["node"].alias("pivot"))


def _verify(size: int, limit: Threshold):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for name in ("text_a", "text_b"):
                found = []
                for _, _, data, rows in text_slices(batch.column(name)):
                    sets, bounds = shingle_sets(*word_hashes(data, rows), size)
                    found += [sets[a:b] for a, b in zip(bounds, bounds[1:])]
                sides.append(found)
            both = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(*sides)], np.int64)
            union = np.array([len(x) + len(y) for x, y in zip(*sides)], np.int64) - both
            ok = pa.array(limit.den * both >= limit.num * union)
            yield batch.select(["a", "b"]).filter(ok)

    return run


def verified(pairs: DataFrame, texts: DataFrame, size: int, limit: Threshold) -> DataFrame:
    """The pairs (a, b) of nodes that are linked. texts has one row (node, text) for each node."""
    a, b = (KeyFilter(pairs, x).rows(texts, "node").select(F.col("node").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
    joined = pairs.join(b.hint("merge"), "b").join(a.hint("merge"), "a")
    return joined.select("a", "b", "text_a", "text_b").mapInArrow(_verify(size, limit), "a long, b long")


def bounded(pairs: DataFrame, points: DataFrame, limit: Threshold) -> DataFrame:
    """The pairs whose summed coordinate minima reach the overlap that their sizes need."""
    a, b = (points.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("point").alias(f"p_{x}")) for x in "ab")
    minima = F.aggregate(F.zip_with("p_a", "p_b", lambda x, y: F.least(x, y)), F.lit(0).cast("long"), lambda s, x: s + x)
    joined = pairs.join(b, "b").join(a, "a")
    return joined.where((limit.num + limit.den) * minima >= limit.num * (F.col("n_a") + F.col("n_b"))).select("a", "b")


def ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()


def texts_of(docs: DataFrame, key: str, points: DataFrame, size: int) -> DataFrame:
    """(node, text): one text for each node of points. Texts of equal sets stand for each other; a key whose rows have different texts gives each node a text of its own.

    Only rows whose key is the least of a node, and the few that a filter takes for such, are sent.
    """

    least = KeyFilter(points, "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(least.holds(batch.column("at"))))
            for a, b, data, rows in text_slices(batch.column("text")):
                nodes = set_sums(*shingle_sets(*word_hashes(data, rows), size)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(nodes), batch.column("text")[a:b]], ["node", "text"])

    rows = docs.select("text", least.place(key).alias("at")).mapInArrow(run, "node long, text string")
    return rows.groupBy("node").agg(F.first("text").alias("text")).join(points.select("node").hint("merge"), "node", "left_semi")


def _shingle_rows(size: int, part: int, parts: int, some: KeyFilter):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(some.holds(batch.column("at"))))
            for a, b, data, rows in text_slices(batch.column("text")):
                sets, bounds = shingle_sets(*word_hashes(data, rows), size)
                nodes = np.repeat(batch.column("node").to_numpy()[a:b], np.diff(bounds))
                keep = mix(sets ^ _u(0x8CB92BA72F3D8DD7)) % _u(parts) < _u(part)
                yield pa.RecordBatch.from_arrays([pa.array(sets[keep].view(np.int64)), pa.array(nodes[keep])], ["shingle", "node"])

    return run


def reaches(nodes: DataFrame, texts: DataFrame, size: int, limit: Threshold) -> DataFrame:
    """(node, n, reach) of those nodes (node, n; a written table) that have few enough lonely shingles for a link with another one.

    reach bounds the overlap with any of the others. A shingle of many nodes is
    counted where it is before it is sent.
    """
    for part, parts in (FIRST_PART, (1, 1)):
        # a node too many, which the filter may let pass, makes no shingle lonely
        some = KeyFilter(nodes, "node")
        rows = texts.select("node", "text", some.place("node").alias("at")).mapInArrow(_shingle_rows(size, part, parts, some), "shingle long, node long")
        lonely = rows.groupBy("shingle").agg(F.count("*").alias("k"), F.min("node").alias("node")).where("k = 1").groupBy("node").agg(F.count("*").alias("lonely"))
        found = nodes.select("node", "n").join(lonely, "node", "left").select("node", "n", (F.col("n") - F.coalesce("lonely", F.lit(0))).alias("reach"))
        nodes = materialize(found.where(limit.den * F.col("reach") >= limit.num * F.col("n")), "reaches")
    return nodes


def open_members(members: DataFrame, nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """(cell, node, component) of those cells in which the nodes have several components so far."""
    named = nodes.select("node").join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    inside = members.select("cell", "node").join(named, "node")
    cells = inside.groupBy("cell").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("cell")
    return inside.join(cells, "cell")


def tree_points(nodes: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """(node, reach, point) for the trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, rows in text_slices(batch.column("text")):
                yield pa.RecordBatch.from_arrays([*(batch.column(c)[a:b] for c in ("node", "reach")), pa.array(fine_points(*shingle_sets(*word_hashes(data, rows), size)), pa.binary())], ["node", "reach", "point"])

    return texts.join(nodes.select("node", "reach"), "node").select("node", "reach", "text").mapInArrow(run, "node long, reach long, point binary")


def _tree_pairs(limit: Threshold):
    """From members of (cell, one, two) in order: the open pairs of the cell's blocks one and two."""

    def cell_pairs(node, component, block, reach, points, one, two):
        left, right = np.flatnonzero(block == one), np.flatnonzero(block == two)
        if not len(left) or not len(right):
            return
        coarse = folded(points, COUNT_GROUPS)
        tree = RTree(coarse[right], reach[right])
        fine, sizes = None, coarse.sum(1, dtype=np.int64)
        for q, p in tree.search(coarse[left], limit, reach[left]):
            x, y = left[q], right[p]
            ok = component[x] != component[y]
            if one == two:
                ok &= node[x] < node[y]
            x, y = x[ok], y[ok]
            if not len(x):
                continue
            fine = folded(points) if fine is None else fine
            step = max(1, (1 << 21) // fine.shape[1])
            ok = np.concatenate([np.minimum(fine[x[i : i + step]], fine[y[i : i + step]]).sum(1, dtype=np.int64) for i in range(0, len(x), step)]) >= limit.overlap(sizes[x], sizes[y])
            if ok.any():
                x, y = node[x[ok]], node[y[ok]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(rows: pa.Table):
            part = [rows.column(c).to_numpy() for c in ("cell", "one", "two", "node", "component", "block", "reach")]
            points = rows.column("point").to_pylist()
            key = np.stack(part[:3], 1)
            cuts = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1, [len(key)]])
            for a, b in zip(cuts, cuts[1:]):
                yield from cell_pairs(*(x[a:b] for x in part[3:]), points[a:b], part[1][a], part[2][a])

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([*held, batch])
            key = [table.column(c).to_numpy() for c in ("cell", "one", "two")]
            last = np.logical_and.reduce([k == k[-1] for k in key])
            cut = len(last) - int(np.argmin(last[::-1])) if not last.all() else 0
            if cut:
                yield from done(table.slice(0, cut))
            held = table.slice(cut).combine_chunks().to_batches()
        if held:
            yield from done(pa.Table.from_batches(held))

    return run


def open_pairs(inside: DataFrame, points: DataFrame, limit: Threshold) -> DataFrame:
    """(a, b): pairs of nodes of one cell of open_members(), in different components so far, that the R-tree does not rule out.

    Cells of the same members are searched once. Large cells are dealt out in
    blocks of at most about CELL_BLOCK members, each pair of blocks to its own
    tree.
    """
    # cells are weighed without their points, which only those that are kept get
    sizes = points.select("node", F.length("point").alias("width"))
    sums = inside.join(sizes, "node").groupBy("cell").agg(F.count("*").alias("members"), F.bit_xor(F.xxhash64("node")).alias("face"), F.max("node").alias("top"), F.min("node").alias("bottom"), F.sum("width").alias("width"))
    kept = sums.groupBy("face", "members", "top", "bottom").agg(F.min("cell").alias("cell"), F.first("width").alias("width"))
    blocks = F.ceil(F.greatest(F.col("members") / CELL_BLOCK, F.col("width") / BLOCK_COORDINATES)).cast("int")
    kept = materialize(kept.select("cell", blocks.alias("blocks")), "open-cells")
    inside = inside.join(kept, "cell").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    inside = inside.join(points.select("node", "reach", "point"), "node")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = inside.withColumn("other", other).select("cell", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "node", "component", "block", "reach", "point")
    return dealt.repartition("cell", "one", "two").sortWithinPartitions("cell", "one", "two").mapInArrow(_tree_pairs(limit), "a long, b long").distinct()


def jaccard_components(docs: DataFrame, key: str = "doc_id", size: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """One row for each row of docs: key, n_shingles, component_id (the least key reachable by links, its own included).

    Texts of fewer words than size are one shingle; null texts and texts
    without words are empty and linked with nothing. Rows of equal sets are
    linked, whatever their keys; rows without a key link with no other set and
    never give a component_id unless all keys of the component are null. Other
    columns are ignored; no rows give no rows.
    """
    limit = Threshold(num, den)
    docs = docs.select(key, "text")
    spark = docs.sparkSession
    prints = materialize(fingerprints(docs, key, size), "fingerprints")
    found = materialize(cell_members(docs, size, limit), "members")
    members, twos = found.where("cell is not null").select("cell", "node"), found.where("cell is null").select(F.col("node").alias("a"), F.col("other").alias("b"))
    in_cells = found.select("node").unionByName(twos.select(F.col("b").alias("node"))).distinct()
    points = materialize(prints.join(in_cells, "node", "left_semi").groupBy("node").agg(F.min(key).alias("rep"), F.first("n").alias("n"), F.first("point").alias("point")), "points")
    texts = materialize(texts_of(docs, key, points, size), "texts")

    def compare(pairs: DataFrame, before: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """The bounded pairs that were not compared before, and those of them that are links."""
        new = bounded(ordered(pairs), points, limit)
        new = materialize(new if before is None else new.join(before, ["a", "b"], "left_anti"), "pairs")
        return new, materialize(verified(new, texts, size, limit), "links")

    pivots = materialize(central_pivots(members), "pivots")
    stars = members.join(pivots, "cell").select(F.col("pivot").alias("a"), F.col("node").alias("b"))
    compared, links = compare(stars.unionByName(twos), None)
    labels = connected_components(links)
    used = [pivots]
    inside = materialize(open_members(members, points, labels), "open-members")
    nodes = reaches(materialize(points.join(inside.select("node").distinct(), "node", "left_semi").select("node", "n"), "open-nodes"), texts, size, limit)
    for _ in range(MORE_PIVOTS):
        inside = materialize(open_members(inside, nodes, labels), "open-members")
        tried = reduce(DataFrame.unionByName, used).select("cell", F.col("pivot").alias("node"))
        joined = pivots.join(labels.withColumnRenamed("node", "pivot"), "pivot", "left").select("cell", F.coalesce("component", "pivot").alias("last"))
        pivots = materialize(central_pivots(inside, tried, joined), "pivots")
        used.append(pivots)
        named = pivots.join(inside.select("cell", F.col("node").alias("pivot"), F.col("component").alias("other")), ["cell", "pivot"])
        stars = inside.join(named, "cell").where("component <> other").select(F.col("pivot").alias("a"), F.col("node").alias("b"))
        more, new = compare(stars, compared)
        compared = compared.unionByName(more)
        if not new.limit(1).count():
            break
        links = links.unionByName(new)
        labels = connected_components(links)
    inside = materialize(open_members(inside, nodes, labels), "open-members")
    nodes = materialize(nodes.join(inside.select("node").distinct(), "node", "left_semi"), "open-nodes")
    fine = materialize(tree_points(nodes, texts, size), "tree-points")
    rest = materialize(open_pairs(inside, fine, limit).join(compared, ["a", "b"], "left_anti"), "open-pairs")
    last = materialize(verified(rest, texts, size, limit), "links")
    if last.limit(1).count():
        labels = connected_components(links.unionByName(last))
    remove(spark, found, points, texts, compared, inside, fine, rest, *used)
    named = prints.select(key, "n", "node").join(labels, "node", "left").withColumn("node", F.coalesce("component", "node"))
    least = named.where("n > 0").groupBy("node").agg(F.min(key).alias("least"))
    out = named.join(least.withColumn("filled", F.lit(True)), (named["node"] == least["node"]) & (named["n"] > 0), "left")
    return out.select(key, F.col("n").alias("n_shingles"), F.coalesce("least", key).alias("component_id"))


def keep_one_of_each(docs: DataFrame, key: str = "doc_id", size: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """The rows of docs that are the least of their component, unchanged; of rows with one key, one stays. Rows without a key stay.

    Only rows whose key is repeated or not the least of its component, and the
    few that a filter takes for such, are joined with the verdicts.
    """
    verdicts = jaccard_components(docs, key, size, num, den).where(F.col(key).isNotNull())
    found = verdicts.groupBy(key).agg(F.count("*").alias("_rows"), F.max(F.col(key) == F.col("component_id")).alias("_stays"))
    found = materialize(found.where("_rows > 1 or not _stays").select(key, "_stays"), "not-plain")
    some = KeyFilter(found, key)
    stay = some.rows(docs, key).join(found, key, "left").where(F.coalesce("_stays", F.lit(True))).dropDuplicates([key])
    return some.rows(docs, key, inside=False).unionByName(stay.select(*docs.columns))
