"""Spelling variants of words, by asymmetric q-chunks.

Of two words that differ by one edit, the shorter (or either, if they are as
long) contributes two disjoint chunks, its first half and the rest. The edit
touches one of them at most, so the other one stands in the other word: the
first chunk at its place, the second shifted by the difference of the lengths,
0 or 1. The other word contributes its grams at these places, words meet where
a gram equals a chunk, and a pair that met is verified by its edit distance.

Short chunks are shared by many words. A word pair with one chunk in common has
its edit in the other one, of which again one half stays, so a chunk whose
words and grams are many gets longer keys: the chunk and a half of the rest.
That is exact at any size of a group; MAX_PAIRS only says where it begins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.shared import materialize, remove

#: Code points of a run of letters, after A-Z became lower case.
RUN = "[a-z\\u00C0-\\u00FF]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A run loses a letter if this divides its check sum.
SPOILED = 199
MIN_LENGTH, MIN_COUNT, RATIO = 6, 5, 5
#: Chunks times grams of a key from which on its rows get longer keys.
MAX_PAIRS = 100_000


def word_counts(docs: DataFrame, key: str = "doc_id", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the words of all texts, some of them spoiled by a rule that depends on document and word.

    Counted in partial sums by word, so frequent words are no hot keys. A null
    text has no words; a null key counts as an empty one.
    """
    runs = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_key"), F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(RUN), F.lit(0))).alias("run")).where(F.length("run") >= min_length)
    h = F.crc32(F.concat_ws(":", "_key", "run"))
    at = (F.col("h") % F.col("length")).cast("int")
    spoiled = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.col("length")))
    words = runs.withColumns({"h": h, "length": F.length("run")}).select(F.when(F.col("h") % SPOILED == 0, spoiled).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def _part(word: Column, first: Column, size: Column) -> Column:
    """Code points first to first + size - 1 of a word, counted from 0."""
    return F.substring(word, first + 1, size)


def _halves(first: Column, size: Column) -> tuple[tuple[Column, Column], tuple[Column, Column]]:
    half = F.floor(size / 2).cast("int")
    return (first, half), (first + half, size - half)


def _keys(word: Column, size: Column, shift: int) -> list[Column]:
    """(part, piece, left, right) for both chunks of a word of size code points, or for the grams of one of size + shift at their places.

    left and right are the halves of what the chunk leaves, each at its place
    if the edit is in the other one. What stands behind the edit is shifted.
    """
    first, second = _halves(F.lit(0), size)
    out = []
    for part, (chunk, rest) in enumerate(((first, second), (second, first))):
        left, right = _halves(*rest)
        pieces = _part(word, chunk[0] + part * shift, chunk[1]), _part(word, *left), _part(word, right[0] + shift, right[1])
        out.append(F.struct(F.lit(part).alias("part"), (size + 0).alias("size"), *(c.alias(name) for c, name in zip(pieces, ("piece", "left", "right")))))
    return out


def _contributions(words: DataFrame, side: str) -> DataFrame:
    """(size, part, piece, left, right, word): the two chunks of each word; or its grams, as the longer word of a pair by 0 or 1; size: length of the chunks' word."""
    kinds = [k for shift in ((0,) if side == "chunks" else (0, 1)) for k in _keys(F.col("word"), F.length("word") - shift, shift)]
    return words.select("word", F.explode(F.array(*kinds)).alias("k")).select("k.*", "word")


def near_pairs(words: DataFrame, max_pairs: int = MAX_PAIRS) -> DataFrame:
    """(a, b): all pairs of distinct words of two code points or more that differ by one inserted, deleted or replaced code point; each pair once, a the shorter, or the smaller of two as long."""
    spark = words.sparkSession
    key = ["size", "part", "piece"]
    chunks = materialize(_contributions(words, "chunks"), "chunks")
    grams = materialize(_contributions(words, "grams"), "grams")
    sizes = chunks.groupBy(*key).agg(F.count("*").alias("c")).join(grams.groupBy(*key).agg(F.count("*").alias("g")), key)
    met = materialize(sizes.select(*key, (F.col("c") * F.col("g") > max_pairs).alias("hot")), "chunk-keys")
    c, g = chunks.join(met, key), grams.join(met, key)

    def longer(side: DataFrame) -> DataFrame:
        # the edit leaves the left half of the rest, or else the right one
        halves = F.array(*(F.struct(F.lit(i).alias("half"), F.col(name).alias("more")) for i, name in enumerate(("left", "right"))))
        return side.where("hot").select(*key, "word", F.explode(halves).alias("h")).select(*key, "word", "h.half", "h.more")

    def pair(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
        return left.withColumnRenamed("word", "a").join(right.withColumnRenamed("word", "b"), on)

    common = pair(c.where("not hot").select(*key, "word"), g.where("not hot").select(*key, "word"), key).select("a", "b")
    hot = pair(longer(c), longer(g), [*key, "half", "more"]).select("a", "b")
    both = common.unionByName(hot).where("(length(a) < length(b) or a < b) and levenshtein(a, b, 1) = 1")
    # an edit at a border leaves both parts, so a pair may meet in several keys
    found = materialize(both.select("a", "b").distinct(), "near-pairs")
    remove(spark, chunks, grams, met)
    return found


def variant_forms(words: DataFrame, ratio: int = RATIO, max_pairs: int = MAX_PAIRS) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of words (word, n).

    A word's form is its most frequent near word, the smallest of several, if
    that has at least ratio times its occurrences; root is the end of the chain
    of forms. Counts grow by ratio with each step, so chains have no cycles and
    their lengths grow with the logarithm of the counts. Null words are left
    out; no words give no rows.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 at least")
    spark = words.sparkSession
    words = materialize(words.where("word is not null").select("word", "n"), "words")
    pairs = near_pairs(words.select("word"), max_pairs)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near")))
    counted = both.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = counted.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    joined = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(-F.col("best.less") >= F.col("n") * ratio, F.struct(F.col("best.near").alias("form"), (-F.col("best.less")).alias("form_n"))).alias("f"))
    formed = materialize(joined.select("word", "n", "n_near", "f.form", "f.form_n"), "forms")
    roots = materialize(formed.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:  # each round doubles the steps
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = materialize(roots.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        remove(spark, roots)
        roots = step.select("word", "root")
        if not step.where("moved").limit(1).count():
            break
    out = materialize(formed.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root")), "variants")
    remove(spark, words, pairs, formed, step)
    return out


def spelling_variants(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """Forms and roots of the words of docs, see word_counts and variant_forms. Repeated rows count again; other columns are ignored; no rows give no rows."""
    return variant_forms(word_counts(docs, key), **options)


ORACLE_SQL = r"""
WITH RECURSIVE crc(i, k, c) AS (
  SELECT i, 0, i FROM (SELECT unnest(range(256)) AS i)
  UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM crc WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM crc WHERE k = 8),
d AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS s FROM documents),
runs AS (SELECT id, run, count(*) AS n FROM (SELECT id, unnest(regexp_extract_all(s, '[a-z\x{00C0}-\x{00FF}]+')) AS run FROM d) WHERE length(run) >= 6 GROUP BY ALL),
bytes AS (SELECT id, run, n, hex(encode(id || ':' || run)) AS x FROM runs),
summed AS (SELECT id, run, n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(length(x) // 2), lambda j: ((instr('0123456789ABCDEF', substr(x, 2 * j + 1, 1)) - 1) * 16 + instr('0123456789ABCDEF', substr(x, 2 * j + 2, 1)) - 1)::BIGINT)),
    lambda a, b: xor(a // 256, t[1 + xor(a % 256, b)]))) AS h FROM bytes, tab),
words AS (SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM summed) WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
less AS (SELECT DISTINCT word, left(word, i - 1) || substr(word, i + 1) AS s FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
holes AS (SELECT word, i, left(word, i - 1) || '?' || substr(word, i + 1) AS s FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (SELECT a.word, b.word AS near FROM holes a JOIN holes b USING (i, s) WHERE a.word <> b.word
  UNION SELECT word, s FROM less WHERE s IN (SELECT word FROM words) UNION SELECT s, word FROM less WHERE s IN (SELECT word FROM words)),
best AS (SELECT near.word, count(*) AS n_near, max(w.n) AS most FROM near JOIN words w ON w.word = near.near GROUP BY near.word),
named AS (SELECT best.word, n_near, most, min(w.word) AS near FROM best JOIN near ON near.word = best.word JOIN words w ON w.word = near.near AND w.n = most GROUP BY ALL),
forms AS (SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN most >= 5 * n THEN near END AS form, CASE WHEN most >= 5 * n THEN most END::BIGINT AS form_n FROM words LEFT JOIN named USING (word)),
chain(word, root) AS (SELECT word, word FROM forms UNION ALL SELECT chain.word, form FROM chain JOIN forms ON forms.word = chain.root WHERE form IS NOT NULL),
ends AS (SELECT chain.word, chain.root FROM chain JOIN forms ON forms.word = chain.root WHERE form IS NULL)
SELECT word, n, n_near, form, form_n, root FROM forms JOIN ends USING (word)
"""
