"""Knowledge-base preparation: text, links, chunks and exact vector search."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import deque
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.window import Window

from parley.constants import CHUNK_OVERLAP, CHUNK_SIZE
from parley.functions.tables import fresh_path, materialize, sliced

BINARY_EXTENSIONS = [".pdf", ".jpg", ".png", ".docx", ".xlsx", ".pptx", ".zip", ".jpeg"]
SEPARATORS = ["\n\n", "\n", " ", ""]
#: Query vectors that are compared at once, chunks of a block at most, chunks that serve as pivots, and numbers of chunk vectors that a task holds.
QUERY_BLOCK, CHUNK_BLOCK, PIVOTS, HELD_NUMBERS = 1024, 1024, 256, 1 << 22
#: Signs of texts whose chunks a task holds at once.
CHUNKED_BYTES = 1 << 20


class _Page(HTMLParser):
    """Text nodes, link targets and the first title of a page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes: list[tuple[str, str | None]] = []
        self.links: list[str] = []
        self.title: str | None = None
        self.skip = 0
        self.href: str | None = None
        self.in_title = False

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
        elif tag == "title":
            self.in_title = self.title is None
        elif tag == "a":
            self.href = dict(attrs).get("href")
            if self.href:
                self.links.append(self.href)

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag == "title":
            self.in_title = False
        elif tag == "a":
            self.href = None

    def handle_data(self, data):
        if self.skip:
            return
        if self.in_title:
            self.title = (self.title or "") + data
        if data.strip():
            self.nodes.append((data.strip(), self.href))


def _read(html: str | None) -> _Page:
    page = _Page()
    page.feed(html or "")
    page.close()
    return page


def _text(url: str | None, html: str | None, web: bool) -> tuple[str | None, str]:
    page, lines = _read(html), []
    for text, href in page.nodes:
        if href is None:
            lines.append(text)
            continue
        target = _resolve(url or "", href)
        if not web or (target and target.startswith(url or "")):
            lines.append(f"{text} {target if web else href}")
    return page.title.strip() if page.title and page.title.strip() else url, "\n".join(lines)


def html_to_text(pages: DataFrame, web: bool = True) -> DataFrame:
    """pages (url, html, ...) with title and content: text nodes by lines, links as text and target.

    Links of web pages stay only if they lead below the page's own url; those
    of local files always do. Without a title the url is taken.
    """
    others = [c for c in pages.columns if c != "html"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches):
            found = [_text(u.as_py(), h.as_py(), web) for u, h in zip(part.column("url"), part.column("html"))]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in others), pa.array([t for t, _ in found], pa.string()), pa.array([c for _, c in found], pa.string())], [*others, "title", "content"])

    return pages.mapInArrow(run, StructType([*(pages.schema[c] for c in others), StructField("title", StringType()), StructField("content", StringType())]))


def _resolve(base: str, href: str) -> str | None:
    try:
        return urldefrag(urljoin(base, href))[0].rstrip("/")
    except ValueError:
        return None


def extract_links(pages: DataFrame) -> DataFrame:
    """Distinct (url, link): absolute targets below the page's url, other than itself, without binary files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches):
            pairs = []
            for u, h in zip(part.column("url").to_pylist(), part.column("html")):
                pairs += [(u, t) for t in sorted({_resolve(u or "", a) or "" for a in _read(h.as_py()).links} - {""})]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in pairs], pa.string()) for i in (0, 1)], ["url", "link"])

    links = pages.select("url", "html").mapInArrow(run, "url string, link string")
    binary = F.lit(False)
    for e in BINARY_EXTENSIONS:
        binary = binary | F.col("link").contains(e)
    return links.where(F.startswith("link", F.col("url")) & (F.col("link") != F.col("url")) & ~binary).distinct()


class _Measure:
    """Counts the units (tokens, by their first places) of stretches of a text, by bisection of places in order."""

    def __init__(self, starts: list[int]):
        self.starts = starts

    def count(self, a: int, b: int) -> int:
        return bisect_left(self.starts, b) - bisect_left(self.starts, a)

    def cuts(self, a: int, b: int, size: int) -> list[int]:
        """Places in (a, b) that part [a, b) into stretches of at most size units; a single sign of more units stays whole."""
        out, last = [], bisect_left(self.starts, b)
        while (i := bisect_left(self.starts, a) + size) < last:
            a = self.starts[i] if self.starts[i] > a else a + 1
            out.append(a)
        return out


class _Signs(_Measure):
    """Counts signs: a place is its own number."""

    def __init__(self) -> None:
        pass

    def count(self, a: int, b: int) -> int:
        return b - a

    def cuts(self, a: int, b: int, size: int) -> list[int]:
        return list(range(a + size, b, size))


def _split(text: str, a: int, b: int, size: int, separators: list[str], m: _Measure) -> list[tuple[int, int]]:
    """Stretches of [a, b) of at most size units, cut at the coarsest separator that the text holds."""
    if m.count(a, b) <= size:
        return [(a, b)] if b > a else []
    mark = next(s for s in separators if s == "" or text.find(s, a, b) >= 0)
    finer = separators[separators.index(mark) + 1 :]
    at, ends = a, []
    if mark:
        while (at := text.find(mark, at, b)) >= 0:
            at += len(mark)
            ends.append(at)
    else:
        ends = m.cuts(a, b, size)
    out: list[tuple[int, int]] = []
    for x, y in zip([a, *ends], [*ends, b]):
        out += _split(text, x, y, size, finer, m) if mark else [(x, y)] if y > x else []
    return out


def _merged(text: str, size: int, overlap: int, m: _Measure) -> list[str]:
    """Chunks of at most size units; each starts with pieces of at most overlap units from the end of the one before."""
    chunks, now, length = [], deque(), 0
    for a, b in _split(text, 0, len(text), size, SEPARATORS, m):
        n = m.count(a, b)
        if now and length + n > size:
            chunks.append(text[now[0][0] : now[-1][1]])
            while now and (length > overlap or length + n > size):
                length -= now.popleft()[2]
        now.append((a, b, n))
        length += n
    return [*chunks, text[now[0][0] : now[-1][1]]] if now else chunks


def chunk_text(text: str, size: int, overlap: int) -> list[str]:
    """Chunks of at most size signs."""
    return _merged(text, size, overlap, _Signs())


def word_starts(text: str) -> list[int]:
    """Where the words between white space begin."""
    return [w.start() for w in re.finditer(r"\S+", text)]


def chunk_documents(docs: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """docs (id, source, content, metadata, is_chunk, is_error) in chunks <id>_<i>; errors and empty ones go, chunks pass."""

    return _chunked(docs, lambda: lambda t: chunk_text(t, size, overlap))


def token_chunks(docs: DataFrame, tokenizer: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """chunk_documents() by tokens: windows of size tokens, each overlap tokens into the one before, as the stretch of text that they cover.

    tokenizer is a tokenizer file that all executors have. Only the last window
    may be shorter.
    """
    if overlap >= size:
        raise ValueError("chunks must be longer than their overlap")

    def cutter() -> Callable[[str], list[str]]:
        from tokenizers import Tokenizer

        encoder = Tokenizer.from_file(tokenizer)

        def chunks(text: str) -> list[str]:
            at = encoder.encode(text, add_special_tokens=False).offsets
            starts = range(0, max(1, len(at) - overlap), size - overlap)
            return [text[at[i][0] : at[min(i + size, len(at)) - 1][1]] for i in starts] if at else [text]

        return chunks

    return _chunked(docs, cutter)


def recursive_token_chunks(docs: DataFrame, tokenizer: str | None, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """chunk_documents() with lengths in tokens of a tokenizer file that all executors have, or in words between white space if there is none.

    A text is encoded once; the tokens of any stretch of it are those that
    begin there, so pieces are measured by two bisections and never encoded
    again. A piece without separators is cut between tokens.
    """
    if overlap >= size:
        raise ValueError("chunks must be longer than their overlap")

    def cutter() -> Callable[[str], list[str]]:
        starts = word_starts
        if tokenizer is not None:
            from tokenizers import Tokenizer

            encoder = Tokenizer.from_file(tokenizer)
            starts = lambda text: [a for a, _ in encoder.encode(text, add_special_tokens=False).offsets]
        # tokens of one sign that is cut into bytes share their first place, so places are in order but not distinct
        return lambda t: _merged(t, size, overlap, _Measure(starts(t)))

    return _chunked(docs, cutter)


def _chunked(docs: DataFrame, cutter: Callable[[], Callable[[str], list[str]]]) -> DataFrame:
    """docs with a row for each chunk, in one pass: a task makes a cutter once and holds the chunks of one text at a time."""
    rest = [c for c in docs.columns if c not in ("id", "content", "is_chunk")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = cutter()
        for part in sliced(batches):
            ids, row, out, size = [], [], [], 0
            for i, (name, text, whole) in enumerate(zip(part.column("id"), part.column("content"), part.column("is_chunk"))):
                name, text = name.as_py(), text.as_py()
                found = [text] if whole.as_py() else cut(text)
                ids += [name] if whole.as_py() else [None if name is None else f"{name}_{k}" for k in range(len(found))]
                row += [i] * len(found)
                out += found
                size += len(text)
                if size >= CHUNKED_BYTES or i + 1 == part.num_rows:
                    taken = pa.array(row, pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(out, pa.string()), *(part.column(c).take(taken) for c in rest), part.column("is_chunk").take(taken)], ["id", "content", *rest, "is_chunk"])
                    ids, row, out, size = [], [], [], 0

    usable = valid_docs(docs).where("is_chunk is not null").withColumn("id", F.col("id").cast("string")).select("id", "content", *rest, "is_chunk")
    return usable.mapInArrow(run, usable.schema).withColumn("is_chunk", F.lit(True))


def readable(files: DataFrame) -> DataFrame:
    """read_knowledge_files() with the text of pages in place of their markup; other files and errors as they are. One pass: files are read once."""
    kept = [c for c in files.columns if c != "is_page"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches):
            page = [p.as_py() and not e.as_py() for p, e in zip(part.column("is_page"), part.column("is_error"))]
            found = [_text(u.as_py(), c.as_py(), False) if p else (t.as_py(), c.as_py()) for p, u, t, c in zip(page, *(part.column(c) for c in ("source", "title", "content")))]
            new = {"title": pa.array([t for t, _ in found], pa.string()), "content": pa.array([c for _, c in found], pa.string())}
            yield pa.RecordBatch.from_arrays([new.get(c, part.column(c)) for c in kept], kept)

    rows = files.where("(is_page and not is_error) or not is_page or is_error")
    return rows.mapInArrow(run, rows.select(*kept).schema)


def valid_docs(docs: DataFrame) -> DataFrame:
    return docs.where("content is not null and content <> '' and not coalesce(is_error, false)")


def l2_normalize(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Unit vectors, in the JVM; zero vectors stay."""
    norm = F.sqrt(F.aggregate(F.transform(column, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x))
    return vectors.withColumn("_n", norm).withColumn(column, F.when(F.col("_n") > 0, F.transform(column, lambda x: x.cast("double") / F.col("_n"))).otherwise(F.col(column).cast("array<double>"))).drop("_n")


def valid_vectors(rows: DataFrame, dim: int, column: str = "embedding") -> DataFrame:
    """The rows whose vector has dim numbers, none of them null, NaN or infinite; column becomes array<double>."""
    v = F.col(column).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.coalesce((F.size(column) == dim) & ~bad, F.lit(False))).withColumn(column, v)


def dimension(rows: DataFrame, column: str = "embedding") -> int:
    """The most frequent length of the vectors, the greatest of several; 0 without vectors."""
    found = rows.where(F.size(column) > 0).groupBy(F.size(column).alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return found["n"] if found else 0


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _blocks(root: str, rows: int) -> Iterator[pa.RecordBatch]:
    fs, path = pafs.FileSystem.from_uri(root)
    for file in sorted(f.path for f in fs.get_file_info(pafs.FileSelector(path)) if f.path.endswith(".parquet")):
        with fs.open_input_file(file) as source:
            yield from (b for b in pq.ParquetFile(source).iter_batches(rows) if b.num_rows)


def _nearest(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest center of each row, and the distance to it."""
    square = (x * x).sum(1)[:, None] - 2 * x @ centers.T + (centers * centers).sum(1)
    near = square.argmin(1)
    return near.astype(np.int32), np.sqrt(np.maximum(square[np.arange(len(x)), near], 0))


def _pivots(root: str) -> np.ndarray:
    return np.concatenate([_matrix(b.column("embedding")) for b in _blocks(root, PIVOTS)] or [np.zeros((0, 0))])


def _near_pivots(pivots: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks with their nearest pivot and the distance to it."""
    centers = _pivots(pivots)
    for batch in batches:
        if batch.num_rows:
            near, far = _nearest(_matrix(batch.column("embedding")), centers)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near), pa.array(far)], [*batch.schema.names, "pivot", "far"])


def _floors(pivots: str, k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Queries with their nearest pivot, the distance to it, and a floor of their k-th best score: the k-th best among the pivots, which are chunks themselves."""
    centers = _pivots(pivots)
    for batch in batches:
        for at in range(0, batch.num_rows, QUERY_BLOCK):
            part = batch.slice(at, QUERY_BLOCK)
            q, floor = _matrix(part.column("embedding")), np.full(part.num_rows, -np.inf)
            near, far = _nearest(q, centers) if len(centers) else (np.full(len(q), -1, np.int32), np.zeros(len(q)))
            if len(centers) >= k:
                floor = np.partition(q @ centers.T, len(centers) - k, axis=1)[:, len(centers) - k]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(near), pa.array(far), pa.array(floor)], [*part.schema.names, "pivot", "far", "floor"])


class _Held:
    """Chunks in blocks of at most CHUNK_BLOCK neighbours, each of one pivot and in the order of their distances to it."""

    def __init__(self, batches: list[pa.RecordBatch], centers: np.ndarray):
        table = pa.Table.from_batches(batches)
        self.ids, self.vectors = table.column("chunk_id").combine_chunks(), _matrix(table.column("embedding"))
        self.rank = np.empty(len(self.ids), np.int64)
        self.rank[pc.sort_indices(self.ids).to_numpy()] = np.arange(len(self.ids))
        pivot, far = table.column("pivot").to_numpy(), table.column("far").to_numpy()
        runs = [0, *(np.flatnonzero((np.diff(pivot) != 0) | (np.diff(far) < 0)) + 1).tolist(), len(pivot)]
        self.cuts = [slice(at, min(at + CHUNK_BLOCK, b)) for a, b in zip(runs[:-1], runs[1:]) for at in range(a, b, CHUNK_BLOCK)]
        self.pivot, self.least, self.most = pivot[[c.start for c in self.cuts]], far[[c.start for c in self.cuts]], far[[c.stop - 1 for c in self.cuts]]
        parts = [self.vectors[c] for c in self.cuts]
        self.center = np.array([x.mean(0) for x in parts])
        self.radius = np.array([np.sqrt(((x - m) ** 2).sum(1).max()) for x, m in zip(parts, self.center)])
        self.norm = np.array([np.sqrt((x * x).sum(1).max()) for x in parts])
        self.post = centers[self.pivot]
        self.apart = np.sqrt(np.maximum(((centers[:, None] - self.post) ** 2).sum(2), 0))

    def bounds(self, q: np.ndarray, pivot: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query and block: what no score exceeds, and whether the query stands among the block's chunks by its pivot and the distance to it.

        A chunk x of the block is within radius of its center c, and between
        least and most from its pivot p. So q.x <= q.c + |q| radius, and |q - x|
        is at least |q - c| - radius, |q - p| - most and least - |q - p|, and,
        as x is no nearer to the query's pivot than to its own, the query's
        distance from the plane between the two. That bounds
        q.x = (|q|^2 + |x|^2 - |q - x|^2) / 2. slack is far more than what
        distances lose by rounding.
        """
        square = (q * q).sum(1)[:, None]
        size = np.sqrt(square)
        slack = 1e-6 * (size + self.norm + np.sqrt((self.post**2).sum(1)) + self.radius)
        along = q @ self.center.T
        to_center = np.sqrt(np.maximum(square - 2 * along + (self.center**2).sum(1), 0))
        to_pivot = np.sqrt(np.maximum(square - 2 * q @ self.post.T + (self.post**2).sum(1), 0))
        gap = np.maximum(np.maximum(to_center - self.radius, 0), np.maximum(to_pivot - self.most, self.least - to_pivot))
        apart = self.apart[pivot]
        plane = (to_pivot**2 - (far * far)[:, None]) / (2 * np.maximum(apart, slack))
        gap = np.maximum(np.maximum(gap, np.where(apart > slack, plane, 0)) - slack, 0)
        inside = (pivot[:, None] == self.pivot) & (far[:, None] >= self.least - slack) & (far[:, None] <= self.most + slack)
        return np.minimum(along + size * self.radius, (square + self.norm**2 - gap * gap) / 2) + 1e-10 * (size + self.norm) ** 2, inside

    def best(self, block: pa.RecordBatch, k: int, first: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(query, chunk, score) of the best k for each query, in the blocks where it stands (first) or in the others that its floor doesn't exclude; and how many pairs of a query and a block were excluded."""
        q, floor = _matrix(block.column("embedding")), block.column("floor").to_numpy()
        floor = floor - 1e-9 * (1 + np.abs(np.where(np.isfinite(floor), floor, 0)))
        bound, inside = self.bounds(q, block.column("pivot").to_numpy(), block.column("far").to_numpy())
        rows, cols, found, skipped = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)], 0
        wanted = inside if first else ~inside & (bound >= floor[:, None])
        skipped = 0 if first else int((~wanted & ~inside).sum())
        for j in np.flatnonzero(wanted.any(0)):
            live = np.flatnonzero(wanted[:, j] & (first | (bound[:, j] >= floor)))
            scores = q[live] @ self.vectors[self.cuts[j]].T
            near, least = np.round(scores, 10), floor[live]
            if scores.shape[1] >= k:
                kth = np.partition(near, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
                least = np.maximum(least, kth)
                floor[live] = np.maximum(floor[live], kth - 1e-9 * (1 + np.abs(kth)))
            row, col = np.nonzero(near >= least[:, None])
            rows.append(live[row])
            cols.append(col + self.cuts[j].start)
            found.append(scores[row, col])
        row, col, score = np.concatenate(rows), np.concatenate(cols), np.concatenate(found)
        order = np.lexsort((self.rank[col], -np.round(score, 10), row))
        row, col, score = row[order], col[order], score[order]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < k
        return row[keep], col[keep], score[keep], skipped


def _search(root: str, pivots: str, k: int, first: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Placed chunks as (query_id, row, chunk_id, score) of what they hold for the queries in root, and rows of counts (blocks, pairs, skipped)."""
    centers = _pivots(pivots)
    names = ["query_id", "row", "chunk_id", "score", "blocks", "pairs", "skipped"]

    def found(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, pairs, skipped, kind = _Held(held, centers), 0, 0, None
        for block in _blocks(root, QUERY_BLOCK):
            kind = block.column("query_id").type
            row, col, score, out = chunks.best(block, k, first)
            pairs, skipped = pairs + block.num_rows * len(chunks.cuts), skipped + out
            if len(row):
                at, none = pa.array(row), pa.nulls(len(row), pa.int64())
                yield pa.RecordBatch.from_arrays([block.column("query_id").take(at), block.column("row").take(at), chunks.ids.take(pa.array(col)), pa.array(score), none, none, none], names)
        if kind is not None and not first:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.nulls(1, pa.int64()), pa.nulls(1, chunks.ids.type), pa.nulls(1, pa.float64()), *(pa.array([n]) for n in (len(chunks.cuts), pairs, skipped))], names)

    held: list[pa.RecordBatch] = []
    for batch in batches:
        rows = max(CHUNK_BLOCK, HELD_NUMBERS // max(1, centers.shape[1]))
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            if held and sum(b.num_rows for b in held) + part.num_rows > rows:
                yield from found(held)
                held = []
            held.append(part)
    if held:
        yield from found(held)


def top_k_counted(queries: DataFrame, chunks: DataFrame, k: int = 4) -> tuple[DataFrame, DataFrame]:
    """(found, counts): found is (query_id, chunk_id, score, place), the k chunks of largest inner product for each query.

    Chunks (chunk_id, embedding) are sorted by their nearest of PIVOTS chunks
    and the distance to it, so that neighbours stand in blocks of at most
    CHUNK_BLOCK. A query (query_id, embedding) first meets the blocks among whose
    chunks it would stand itself; the k-th best score there, or among the pivots
    if that is more, is its floor. Then it meets the other blocks but those
    where no score can reach its floor, see _Held.bounds(), so nothing is lost.
    A task holds many blocks and reads the queries once for all of them; what it
    finds is its best k for each query, and Spark keeps the best k before the
    shuffle.

    Vectors that are null, of another length than most, or hold no finite
    numbers take no part. Ids are of any type that Spark can order; equal scores, to
    ten digits behind the point, go to the lesser chunk_id. No queries, or no chunks,
    give no rows. counts (one row): chunk_blocks, pairs of query blocks' queries
    and chunk blocks, skipped ones, invalid_queries, invalid_chunks.
    """
    spark = chunks.sparkSession
    kinds = {c: df.schema[c].dataType.simpleString() for df, c in ((queries, "query_id"), (chunks, "chunk_id"))}
    dim = dimension(chunks)
    good, asked = valid_vectors(chunks.select("chunk_id", "embedding"), dim), valid_vectors(queries.select("query_id", "embedding"), dim)
    good = materialize(good, "chunk-vectors")
    pivots, first_root, root = fresh_path(spark, "pivots"), fresh_path(spark, "queries"), fresh_path(spark, "queries")
    good.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(PIVOTS).write.parquet(pivots)
    placed = good.mapInArrow(lambda b: _near_pivots(pivots, b), f"chunk_id {kinds['chunk_id']}, embedding array<double>, pivot int, far double")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = materialize(placed.repartitionByRange(tasks, "pivot", "far", F.xxhash64("chunk_id")).sortWithinPartitions("pivot", "far"), "placed")
    schema = f"query_id {kinds['query_id']}, row long, chunk_id {kinds['chunk_id']}, score double, blocks long, pairs long, skipped long"

    numbered = asked.withColumn("row", F.monotonically_increasing_id())
    numbered.mapInArrow(lambda b: _floors(pivots, k, b), f"query_id {kinds['query_id']}, embedding array<double>, row long, pivot int, far double, floor double").write.parquet(first_root)
    near = materialize(placed.mapInArrow(lambda b: _search(first_root, pivots, k, True, b), schema), "near")
    kth = near.withColumn("place", F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score")))).where(F.col("place") == k).select("row", F.col("score").alias("kth"))
    raised = spark.read.parquet(first_root).join(kth, "row", "left").withColumn("floor", F.greatest("floor", "kth")).drop("kth")
    raised.sort("pivot", "far").write.parquet(root)
    found = near.unionByName(materialize(placed.mapInArrow(lambda b: _search(root, pivots, k, False, b), schema), "found"))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 10)), "chunk_id")
    rows = found.where("pairs is null").select("query_id", "chunk_id", "score").withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
    zero = lambda c: F.coalesce(c, F.lit(0)).alias
    counts = found.where("pairs is not null").agg(zero(F.sum("blocks"))("chunk_blocks"), zero(F.sum("pairs"))("pairs"), zero(F.sum("skipped"))("skipped"))
    counts = counts.crossJoin(queries.agg(F.count("*").alias("q"))).crossJoin(asked.agg(F.count("*").alias("gq"))).crossJoin(chunks.agg(F.count("*").alias("c"))).crossJoin(good.agg(F.count("*").alias("gc")))
    return rows, counts.select("chunk_blocks", "pairs", "skipped", (F.col("q") - F.col("gq")).alias("invalid_queries"), (F.col("c") - F.col("gc")).alias("invalid_chunks"))


def top_k(queries: DataFrame, chunks: DataFrame, k: int = 4) -> DataFrame:
    """(query_id, chunk_id, score, place), see top_k_counted()."""
    return top_k_counted(queries, chunks, k)[0]


def retrieve(queries: DataFrame, chunks: DataFrame, k: int = 4) -> DataFrame:
    """(query_id, place, chunk_id, content, title, source, confidence) of the k best chunks (chunk_id, embedding, content, title, source) for each query. Texts are joined to what was found, so the search reads vectors only."""
    found = top_k(queries, chunks.select("chunk_id", "embedding"), k).withColumnRenamed("score", "confidence")
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return found.join(chunks.select("chunk_id", text("content"), text("title"), text("source")), "chunk_id").select("query_id", "place", "chunk_id", "content", "title", "source", "confidence")
