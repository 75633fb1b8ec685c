"""Ranked lexical search by a pipeline over term owners.

Terms are partitioned among owners, the rarest to the first. Items travel in
bundles, one copy of a bundle for each shard of documents, and a bundle carries
the sparse accumulators of its items: the integer scores so far of the shard's
documents. At each owner, bundles and postings of a shard are cogrouped, the
owner's contributions are added, and the bundle goes on to the next owner. The
last one selects the best documents of the shard, of which the best of all
shards are the result.

A shard has about SHARD_DOCS documents and a bundle at most BUNDLE_ITEMS items,
so a group is bounded whatever the number of documents or items. What a bundle
carries is written in rows of SLICE_PAIRS terms or scores: Spark's readers and
writers hold thousands of rows at a time, whatever their size. A bundle drops
a document if all that the remaining owners can add leaves it below the shard's
k-th best already: it cannot be in the result. Ties stay.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parley.llm.shared import fresh_path, materialize, remove
from parley.llm.text import text_slices, word_hashes

OWNERS, BUNDLE_ITEMS, SHARD_DOCS = 4, 512, 2048
#: Terms, or scores, of a bundle in one row.
SLICE_PAIRS = 256
#: Words of the items in a file of weights, about; tasks hold one file at a time.
TERMS_PER_FILE = 1 << 20
#: A contribution is below this for each unit of weight.
_UNIT = 1_000_000
_NO_KEY = np.iinfo(np.int64).max

_PAIRS, _SCORES = ("terms", "places", "amounts", "owners"), ("acc_item", "acc_row", "acc_doc", "acc_score")
_BUNDLE = f"bundle int, {', '.join(f'{c} binary' for c in _PAIRS)}"
_STATE = f"shard long, {_BUNDLE}, {', '.join(f'{c} binary' for c in _SCORES)}"
_FOUND = "bundle int, place int, doc long, score long"


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def _rows(columns: list[np.ndarray]) -> list[list[bytes]]:
    """Columns of equal length, each in slices of SLICE_PAIRS values."""
    return [[x[at : at + SLICE_PAIRS].astype(np.int64).tobytes() for at in range(0, len(x), SLICE_PAIRS)] for x in columns]


def _joined(column: Iterable[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.int64)


def _bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bundle, text), sorted by bundle, as the distinct pairs of a term's hash and an item's place in its bundle, and how often the item repeats the term; in slices."""

    def packed(bundle: int, texts: list) -> pa.RecordBatch:
        places, terms = [], []
        for a, _, data, offsets in text_slices(pa.array(texts, pa.string())):
            words, rows = word_hashes(data, offsets, "alnum")
            places.append(np.repeat(np.arange(len(rows) - 1) + a, np.diff(rows)))
            terms.append(words)
        term, place = np.concatenate(terms).view(np.int64), np.concatenate(places).astype(np.int64)
        order = np.lexsort((place, term))
        term, place = term[order], place[order]
        cut = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (place[1:] != place[:-1])])[: len(term)])
        slices = _rows([term[cut], place[cut], np.diff(np.append(cut, len(term)))])
        return pa.RecordBatch.from_arrays([pa.array([bundle] * len(slices[0]), pa.int32()), *(pa.array(x, pa.binary()) for x in slices)], ["bundle", "terms", "places", "repeats"])

    now, texts = None, []
    for batch in batches:
        for b, t in zip(*(batch.column(c).to_pylist() for c in ("bundle", "text"))):
            if b != now and texts:
                yield packed(now, texts)
                texts = []
            now = b
            texts.append(t)
    if texts:
        yield packed(now, texts)


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(_joined(batch.column("terms").to_pylist())))], ["term"])


def _written(df: DataFrame, rows: int, name: str) -> str:
    """Writes df in files of about TERMS_PER_FILE rows, each sorted by term, and gives the folder."""
    root = fresh_path(df.sparkSession, name)
    df.repartitionByRange(max(1, -(-rows // TERMS_PER_FILE)), "term").sortWithinPartitions("term").write.parquet(root)
    return root


def _files(root: str, *columns: str) -> Iterator[list[np.ndarray]]:
    """The columns of a written table, file by file; the last file stays in memory, so that a single one is read once by a task."""
    fs, path = pafs.FileSystem.from_uri(root)
    for found in sorted(f.path for f in fs.get_file_info(pafs.FileSelector(path)) if f.path.endswith(".parquet")):
        if _last.get("path") != found:
            with fs.open_input_file(found) as stream:
                table = pq.read_table(stream)
            _last.clear()
            _last.update({c: table.column(c).to_numpy() for c in table.column_names}, path=found)
        if len(_last[columns[0]]):
            yield [_last[c] for c in columns]


def _places(table: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where terms stand in a sorted table, and whether they do."""
    at = np.minimum(np.searchsorted(table, terms), len(table) - 1)
    return at, table[at] == terms


_last: dict = {}


def _match(root: str):
    """For each document: its words, and the places, counts and hashes of those that items have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column("text")):
                words, rows = word_hashes(data, offsets, "alnum")
                kept: list[np.ndarray] = []
                words = words.view(np.int64)
                for (terms,) in _files(root, "term"):
                    kept.append(np.flatnonzero(_places(terms, words)[1]))
                at = np.concatenate(kept) if kept else np.zeros(0, np.int64)
                row = np.searchsorted(rows, at, "right") - 1
                order = np.lexsort((words[at], row))
                row, term = row[order], words[at][order]
                new = np.concatenate([[True], (row[1:] != row[:-1]) | (term[1:] != term[:-1])])[: len(row)]
                cut = np.flatnonzero(new)
                tf = np.diff(np.append(cut, len(row)))
                bounds = np.searchsorted(row[cut], np.arange(len(rows)))
                pick = [slice(x, y) for x, y in zip(bounds[:-1], bounds[1:])]
                term = term[cut]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc")[a:b], pa.array(np.diff(rows)), pa.array([term[s].tobytes() for s in pick], pa.binary()), pa.array([tf[s].tobytes() for s in pick], pa.binary())], ["doc", "n", "terms", "tfs"]
                )

    return run


def _holding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, df) of each batch."""
    for batch in batches:
        terms, n = np.unique(np.frombuffer(b"".join(batch.column("terms").to_pylist()), np.int64), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(n)], ["term", "df"])


def _postings(root: str, owner: int, documents: int, words: int):
    """For each document that has terms of this owner: their hashes, and what each adds for a unit of weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = batch.column("terms").to_pylist()
            size = np.array([len(x) // 8 for x in each], np.int64)
            row = np.repeat(np.arange(len(each)), size)
            terms = np.frombuffer(b"".join(each), np.int64)
            tf = np.frombuffer(b"".join(batch.column("tfs").to_pylist()), np.int64)
            own = np.zeros(len(terms), bool)
            for table, owners in _files(root, "term", "owner"):
                at, hit = _places(table, terms)
                own |= hit & (owners[at] == owner)
            row, terms, tf = row[own], terms[own], tf[own]
            m = 75 + (25 * batch.column("n").to_numpy().astype(np.int64) * documents) // max(words, 1)
            unit = (1_000_000_000 * tf) // (1000 * tf + 12 * m[row])
            bounds = np.searchsorted(row, np.arange(len(each) + 1))
            has = np.flatnonzero(np.diff(bounds))
            pick = [slice(bounds[i], bounds[i + 1]) for i in has]
            at = pa.array(has)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row").take(at), batch.column("doc").take(at), pa.array([terms[s].tobytes() for s in pick], pa.binary()), pa.array([unit[s].tobytes() for s in pick], pa.binary())], ["row", "doc", "terms", "units"]
            )

    return run


def _weigh(bands: list[int], documents: int):
    """(term, weight, owner) of (term, df); bands: the least band of each owner but the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights = [weight(documents, df) for df in batch.column("df").to_pylist()]
            owner = np.searchsorted(np.array(bands, np.int64), batch.column("band").to_numpy(), "right")
            yield pa.RecordBatch.from_arrays([batch.column("term"), pa.array(weights, pa.int64()), pa.array(owner.astype(np.int64))], ["term", "weight", "owner"])

    return run


def _addressed(root: str):
    """Slices of bundles with what each pair adds for a unit, and the term's owner; terms that no document has drop out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.array([len(x) // 8 for x in batch.column("terms").to_pylist()], np.int64)
            terms, places, repeats = (_joined(batch.column(c).to_pylist()) for c in ("terms", "places", "repeats"))
            amounts, owners = np.zeros(len(terms), np.int64), np.full(len(terms), -1)
            for table, weights, owned in _files(root, "term", "weight", "owner"):
                at, hit = _places(table, terms)
                amounts[hit], owners[hit] = weights[at[hit]] * repeats[hit], owned[at[hit]]
            known = [slice(b - n, b) for b, n in zip(np.cumsum(size), size)]
            out = [[x[s][owners[s] >= 0].tobytes() for s in known] for x in (terms, places, amounts, owners)]
            yield pa.RecordBatch.from_arrays([batch.column("bundle"), *(pa.array(x, pa.binary()) for x in out)], ["bundle", *_PAIRS])

    return run


def _stage(owner: int, last: bool, k: int):
    """Adds one owner's contributions to the accumulators of a bundle at a shard; the bundle's terms of this owner have done their part and go."""

    def add(bundles: pd.DataFrame, postings: pd.DataFrame) -> pd.DataFrame:
        if bundles.empty:
            return pd.DataFrame()  # no item was dealt to this bundle
        shard, bundle = bundles["shard"].iloc[0], bundles["bundle"].iloc[0]
        terms, places, amounts, owners = (_joined(bundles[c]) for c in _PAIRS)
        held_item, held_row, held_doc, held_score = (_joined(bundles[c]) for c in _SCORES)
        new_row, new_doc = postings["row"].to_numpy(np.int64), postings["doc"].to_numpy(np.int64)
        rows, at = np.unique(np.concatenate([held_row, new_row]), return_index=True)
        docs = np.concatenate([held_doc, new_doc])[at]
        score = np.zeros((int(max(places.max(initial=-1), held_item.max(initial=-1))) + 1, len(rows)), np.int64)
        score[held_item, np.searchsorted(rows, held_row)] = held_score
        term, unit = _joined(postings["terms"]), _joined(postings["units"])
        column = np.searchsorted(rows, np.repeat(new_row, postings["terms"].map(len).to_numpy(np.int64) // 8))
        order = np.argsort(term, kind="stable")
        term, unit, column = term[order], unit[order], column[order]
        mine = np.flatnonzero(owners == owner)
        mine = mine[np.argsort(terms[mine], kind="stable")]
        for pairs in np.split(mine, np.flatnonzero(np.diff(terms[mine])) + 1) if len(mine) else ():
            hits = slice(np.searchsorted(term, terms[pairs[0]], "left"), np.searchsorted(term, terms[pairs[0]], "right"))
            # neither an item nor a document is twice in a term's list
            score[places[pairs][:, None], column[hits]] += amounts[pairs][:, None] * unit[hits]
        rest, later = np.zeros(len(score), np.int64), owners > owner
        np.add.at(rest, places[later], amounts[later] * _UNIT)
        keep = score > 0
        if len(rows) > k:
            best = np.partition(score, len(rows) - k, axis=1)[:, len(rows) - k]
            keep &= score + rest[:, None] >= best[:, None]
        item, doc = np.nonzero(keep)
        found = score[item, doc]
        if not last:
            pairs, scores = _rows([x[later] for x in (terms, places, amounts, owners)]), _rows([item, rows[doc], docs[doc], found])
            slices = [x + [b""] * len(scores[0]) for x in pairs] + [[b""] * len(pairs[0]) + x for x in scores]
            return pd.DataFrame({"shard": shard, "bundle": bundle} | dict(zip((*_PAIRS, *_SCORES), slices)))
        order = np.lexsort((docs[doc], -found, item))
        item, doc, found = item[order], doc[order], found[order]
        top = np.arange(len(item)) - np.searchsorted(item, item) < k
        item, doc, found = item[top], doc[top], found[top]
        return pd.DataFrame({"bundle": np.full(len(item), bundle), "place": item, "doc": docs[doc], "score": found})

    return add


def _bands(df: DataFrame, owners: int) -> list[int]:
    """Least band of each owner but the first: bands of like frequency, dealt so that owners have about as many postings each."""
    sizes = sorted((r["band"], r["n"]) for r in df.groupBy("band").agg(F.sum("df").alias("n")).collect())
    total, before, out = sum(n for _, n in sizes), 0, []
    for band, n in sizes:
        while len(out) < owners - 1 and before >= total * (len(out) + 1) / owners:
            out.append(band)
        before += n
    return out + [1 << 30] * (owners - 1 - len(out))


def top_documents(docs: DataFrame, items: DataFrame, k: int = 20, key: str = "doc_id", item: str = "item_id", owners: int = OWNERS, bundle_items: int = BUNDLE_ITEMS, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """(item, rank, key, score): the k documents of highest score above 0 for each row of items, equal scores by ascending key, null keys last.

    Null and empty texts have no terms: such documents are never found, such
    items find none. Each row of docs is a document of its own and each row of
    items an item, so repeated rows repeat their results. Keys have to be whole
    numbers. Other columns are ignored; empty tables give no rows. Terms are
    compared by 64-bit hashes.
    """
    spark = docs.sparkSession
    kinds = {c: df.schema[c].dataType.simpleString() for df, c in ((docs, key), (items, item))}
    asked = materialize(items.select(F.col(item).cast("string").alias("item"), "text", F.monotonically_increasing_id().alias("row")), "items")
    n_bundles = max(1, -(-asked.count() // bundle_items))
    dealt = asked.withColumn("bundle", F.pmod(F.xxhash64("row"), F.lit(n_bundles)).cast("int"))
    sorted_ = dealt.repartition(n_bundles, "bundle").sortWithinPartitions("bundle", "row")
    bundles = materialize(sorted_.select("bundle", "text").mapInArrow(_bundles, "bundle int, terms binary, places binary, repeats binary"), "bundles")
    terms = materialize(bundles.select("terms").mapInArrow(_terms, "term long").distinct(), "terms")
    asked_root = _written(terms, terms.count(), "asked-terms")

    texts = docs.select(F.col(key).cast("long").alias("doc"), "text").withColumn("doc", F.coalesce("doc", F.lit(_NO_KEY)))
    held = materialize(texts.mapInArrow(_match(asked_root), "doc long, n long, terms binary, tfs binary").where("n > 0").withColumn("row", F.monotonically_increasing_id()), "matches")
    n_docs, n_words = held.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = materialize(held.select("terms").mapInArrow(_holding, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).withColumn("band", F.floor(4 * F.log2("df")).cast("long")), "holding")
    root = _written(df.mapInArrow(_weigh(_bands(df, owners), n_docs), "term long, weight long, owner long"), df.count(), "weights")

    n_shards = max(1, -(-n_docs // shard_docs))
    every = lambda n, kind: F.explode(F.sequence(F.lit(0).cast(kind), F.lit(n - 1).cast(kind)))
    empty = [F.lit(b"").alias(c) for c in _SCORES]
    state = bundles.mapInArrow(_addressed(root), _BUNDLE).select(every(n_shards, "long").alias("shard"), "*", *empty)
    written = []
    for owner in range(owners):
        last = owner == owners - 1
        postings = held.where("length(terms) > 0").mapInArrow(_postings(root, owner, n_docs, n_words), "row long, doc long, terms binary, units binary")
        postings = postings.select(F.pmod(F.xxhash64("row"), F.lit(n_shards)).alias("shard"), every(n_bundles, "int").alias("bundle"), "row", "doc", "terms", "units")
        met = state.groupBy("shard", "bundle").cogroup(postings.groupBy("shard", "bundle")).applyInPandas(_stage(owner, last, k), _FOUND if last else _STATE)
        state = materialize(met, "found" if last else "accumulators")
        written.append(state)
    best = Window.partitionBy("bundle", "place").orderBy(F.desc("score"), "doc")
    ranked = state.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    names = dealt.select("bundle", (F.row_number().over(Window.partitionBy("bundle").orderBy("row")) - 1).alias("place"), "item")
    out = ranked.join(names, ["bundle", "place"]).select(F.col("item").cast(kinds[item]).alias(item), "rank", F.when(F.col("doc") != _NO_KEY, F.col("doc")).cast(kinds[key]).alias(key), "score")
    remove(spark, bundles, terms, held, df, *written[:-1])
    return out


ORACLE_SQL = r"""
WITH b AS (SELECT row_number() OVER () AS r, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS t FROM benchmark),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ts FROM documents),
one AS (SELECT count(*)::BIGINT AS nd, sum(len(ts))::BIGINT AS nw FROM d WHERE len(ts) > 0),
tf AS (SELECT r, doc_id, n, t, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, len(ts)::BIGINT AS n, unnest(ts) AS t FROM d) WHERE t IN (SELECT t FROM b) GROUP BY ALL),
w AS (SELECT t, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, one GROUP BY t, nd),
p AS (SELECT r, doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nd) // nw))) AS s FROM tf JOIN w USING (t), one),
s AS (SELECT b.r AS i, item_id, p.r AS r, doc_id, sum(s)::BIGINT AS score FROM b JOIN p USING (t) GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 20
"""
