"""Quality rules by cross-document line frequency, in DataFrame functions only.

Base rules look at one text. The cross-document rule hashes normalised lines,
counts for each host in how many distinct documents a line stands, takes lines
above the limit out, and rejects documents that are left depleted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.shared import materialize, remove

#: So many frequent lines at most are sent to all tasks.
BROADCAST_LINES = 100_000
WHITE = "[\\x20\\x09-\\x0D]+"
INK = "[^\\x20\\x09-\\x0D]"
SYMBOLS = "[#*$%&|<>]"


@dataclass(frozen=True)
class LineLimits:
    """A line of a host goes if it stands in more than max(min_docs, min_share of the host's documents) documents.

    A document goes if lines that stay hold less than keep_share of its words.
    """

    min_docs: int = 20
    min_share: float = 0.002
    keep_share: float = 0.25


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, WHITE), lambda w: w != "")


def _line_hash(words: Column) -> Column:
    """60 bits of MD5 of a line's lower-cased words, joined by single spaces."""
    return F.conv(F.substring(F.md5(F.lower(F.array_join(words, " ")).cast("binary")), 1, 15), 16, 10).cast("long")


def _windows(words: Column) -> Column:
    """Hashes of the 3-word windows."""
    places = F.when(F.size(words) >= 3, F.sequence(F.lit(0), F.size(words) - 3)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))


def quality_signals(docs: DataFrame) -> DataFrame:
    """The rows of docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed added.

    Null texts have no words and fail the base rules; so do texts of white
    space. n_repeat_words: sorted window hashes show whether any window
    repeats. Only then (hash, position) pairs are sorted, and the union of
    [p, p + 2] over the repeated positions p is measured: n log n steps for
    any text. Columns of docs with the names of the added ones give way to them;
    all others pass.
    """
    out = docs.withColumn("_text", F.coalesce("text", F.lit("")))
    out = out.withColumn("_words", words_of(F.col("_text"))).withColumn("_lines", F.filter(F.split("_text", "\n"), lambda s: s.rlike(INK)))
    out = out.withColumn("_sorted", F.sort_array(_windows(F.col("_words"))))
    repeated = F.size("_sorted") > F.size(F.array_distinct("_sorted"))
    n = F.size("_words")
    pairs = F.sort_array(
        F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)).alias("h"), i.alias("p")))
    )
    out = out.withColumn("_pairs", F.when(repeated, pairs))
    same = lambda i, j: F.coalesce(F.get("_pairs", i)["h"] == F.get("_pairs", j)["h"], F.lit(False))
    hits = F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), n - 3), lambda i: same(i, i - 1) | same(i, i + 1)), lambda i: F.get("_pairs", i)["p"]))
    out = out.withColumn("_hits", F.when(F.col("_pairs").isNotNull(), hits))
    cover = F.aggregate(
        "_hits", F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), lambda s, p: F.struct((s["n"] + F.least(F.lit(3), p - s["last"])).alias("n"), p.alias("last")), lambda s: s["n"]
    )
    out = (
        out.withColumn("n_words", n.cast("long"))
        .withColumn("word_chars", F.length(F.array_join("_words", "")).cast("long"))
        .withColumn("n_symbols", F.regexp_count("_text", F.lit(SYMBOLS)).cast("long"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("n_repeat_words", F.coalesce(cover, F.lit(0)).cast("long"))
    )
    out = out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return out.drop("_text", "_words", "_lines", "_sorted", "_pairs", "_hits")


def _host(host: str) -> Column:
    return F.coalesce(F.col(host).cast("string"), F.lit(""))


def line_table(docs: DataFrame, host: str = "source") -> DataFrame:
    """(host, mark, face, pos, line, words, total): each line with words, hashed.

    A row is known by its host and mark, a hash of its text: what is decided
    about it depends on nothing else, so keys may be null or repeated. total:
    words of the text. face is a 64-bit hash of all line hashes of the document
    in their order. Only texts with the same normalised lines share it, so that
    a document and its copies count once for a line, and any two other
    documents count twice.
    """
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), words_of)
    items = F.transform(F.filter("lines", lambda w: F.size(w) > 0), lambda w, i: F.struct(_line_hash(w).alias("line"), F.size(w).cast("long").alias("words"), i.alias("pos")))
    rows = docs.select(_host(host).alias("host"), F.xxhash64("text").alias("mark"), lines.alias("lines")).select("host", "mark", items.alias("items"))
    rows = rows.withColumn("face", F.xxhash64(F.transform("items", lambda x: x["line"]))).withColumn("total", F.aggregate("items", F.lit(0).cast("long"), lambda n, x: n + x["words"]))
    return rows.select("host", "mark", "face", "total", F.explode("items").alias("x")).select("host", "mark", "face", "x.*", "total")


def frequent_lines(lines: DataFrame, limits: LineLimits = LineLimits()) -> DataFrame:
    """(host, line, n_docs) of the lines above the limit.

    Documents are counted by their faces; the distinct rows and both counts are
    partially aggregated before their shuffles, so no line or host is hot.
    """
    counts = lines.select("host", "line", "face").distinct().groupBy("host", "line").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") > limits.min_docs)
    hosts = lines.select("host", "face").distinct().groupBy("host").agg(F.count("*").alias("host_docs"))
    return counts.join(hosts, "host").where(F.col("n_docs") > limits.min_share * F.col("host_docs")).select("host", "line", "n_docs")


def _lines_and_frequent(docs: DataFrame, host: str, limits: LineLimits) -> tuple[DataFrame, DataFrame]:
    lines = materialize(line_table(docs, host), "lines")
    return lines, materialize(frequent_lines(lines, limits), "frequent")


def _hits(lines: DataFrame, frequent: DataFrame) -> DataFrame:
    return lines.drop("face").join(frequent.select("host", "line"), ["host", "line"])


def flagged_lines(docs: DataFrame, host: str = "source", limits: LineLimits = LineLimits()) -> DataFrame:
    """(host, line, mark, pos, words, total) of the lines of documents that are above the limit."""
    return _hits(*_lines_and_frequent(docs, host, limits))


def _words_of_lines(hit: DataFrame) -> DataFrame:
    each = hit.groupBy("host", "mark", "pos", "line").agg(F.max("words").alias("words"), F.max("total").alias("total"))
    return each.groupBy("host", "mark").agg(F.sum("words").alias("n_removed"), F.max("total").alias("total"))


def removed_words(docs: DataFrame, host: str = "source", limits: LineLimits = LineLimits()) -> DataFrame:
    """(host, mark, n_removed, total): words of each text in frequent lines, for texts that have any."""
    return _words_of_lines(flagged_lines(docs, host, limits))


def depleted(n_words: Column, n_removed: Column, limits: LineLimits = LineLimits()) -> Column:
    return (n_words - n_removed) < limits.keep_share * n_words


def quality_verdicts(docs: DataFrame, key: str = "doc_id", host: str = "source", limits: LineLimits = LineLimits()) -> DataFrame:
    """One row for each row of docs: key, signals, base_failed, n_removed and kept.

    Each row is judged by its own text and host, whatever its key, so rows of
    null or repeated keys get their own verdicts, and equal rows equal ones.
    Null hosts form one host. No rows give no rows; other columns are ignored.
    """
    docs = docs.select(F.col(key).alias("_key"), "text", _host(host).alias("host"))
    signals = quality_signals(docs.withColumn("mark", F.xxhash64("text"))).drop("text")
    removed = removed_words(docs, "host", limits).drop("total")
    out = signals.join(removed, ["host", "mark"], "left").withColumn("n_removed", F.coalesce("n_removed", F.lit(0)).cast("long")).drop("host", "mark")
    out = out.withColumn("kept", ~F.col("base_failed") & ~depleted(F.col("n_words"), F.col("n_removed"), limits))
    return out.select(F.col("_key").alias(key), *[c for c in out.columns if c != "_key"])


def _by_host(frequent: DataFrame) -> DataFrame:
    """(_host, _gone): the frequent lines of a host, dealt by hash into lists of about 16, so that a line is looked for in one of them."""
    sizes = frequent.groupBy("host").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / 16)).cast("int").alias("lists"))
    dealt = frequent.select("host", "line").distinct().join(sizes, "host").select("host", F.pmod("line", F.col("lists").cast("long")).cast("int").alias("at"), "line")
    every = sizes.select("host", F.explode(F.sequence(F.lit(0), F.col("lists") - 1)).alias("at"))
    filled = every.join(dealt.groupBy("host", "at").agg(F.collect_list("line").alias("lines")), ["host", "at"], "left")
    return filled.groupBy(F.col("host").alias("_host")).agg(F.sort_array(F.collect_list(F.struct("at", F.coalesce("lines", F.array().cast("array<bigint>")).alias("lines")))).alias("_gone"))


def _without(docs: DataFrame, hit: DataFrame, frequent: DataFrame, host: str) -> DataFrame:
    """docs without their frequent lines, all other lines as they are; n_chars follows.

    Up to BROADCAST_LINES frequent lines go to all tasks, by host, so that no
    text is shuffled; of more, those of each text reach it by a join.
    """
    mark = F.xxhash64("text")
    if frequent.count() <= BROADCAST_LINES:
        out = docs.join(F.broadcast(_by_host(frequent)), _host(host) == F.col("_host"), "left")
        gone = lambda line: F.array_contains(F.get("_gone", F.pmod(line, F.size("_gone").cast("long")).cast("int"))["lines"], line)
    else:
        own = materialize(hit.groupBy("host", "mark").agg(F.collect_set("line").alias("_gone")), "flagged").toDF("_host", "_mark", "_gone")
        out = docs.join(own, (_host(host) == F.col("_host")) & (mark == F.col("_mark")), "left")
        gone = lambda line: F.array_contains("_gone", line)
    lines = F.split("text", "\n")
    kept = F.filter(lines, lambda s: ~gone(_line_hash(words_of(s))))
    out = out.withColumn("_kept", F.when(F.col("_gone").isNotNull() & F.col("text").isNotNull(), kept))
    out = out.withColumn("_new", F.when(F.size("_kept") < F.size(lines), F.array_join("_kept", "\n")))
    new = {"text": F.coalesce("_new", "text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("_new").isNotNull(), F.length("_new").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.select([new[c].alias(c) if c in new else c for c in docs.columns])


def strip_frequent_lines(docs: DataFrame, host: str = "source", limits: LineLimits = LineLimits()) -> DataFrame:
    """docs with frequent lines taken out of the texts; texts without any stay as they are."""
    lines, frequent = _lines_and_frequent(docs, host, limits)
    return _without(docs, _hits(lines, frequent), frequent, host)


def drop_low_quality(docs: DataFrame, host: str = "source", limits: LineLimits = LineLimits(), strip: bool = False) -> DataFrame:
    """The rows of docs that quality_verdicts() keeps, unchanged, or without their frequent lines (strip).

    Base rules filter in place. Only hosts and hashes of depleted texts are
    joined against, from a written table, so that Spark knows its size when it
    picks the join.
    """
    lines, frequent = _lines_and_frequent(docs, host, limits)
    hit = materialize(_hits(lines, frequent), "hits")
    gone = materialize(_words_of_lines(hit).where(depleted(F.col("total"), F.col("n_removed"), limits)).select(F.col("host").alias("_host"), F.col("mark").alias("_mark")), "depleted")
    remove(docs.sparkSession, lines)
    whole = docs.select(F.struct("*").alias("_row"), "text")
    # a filter on an id as well isn't pushed below the projections; pushed down, it would repeat their array expressions for every element
    judged = quality_signals(whole).select("_row", "base_failed", F.monotonically_increasing_id().alias("_id"))
    fine = judged.where(~F.col("base_failed") & (F.col("_id") >= 0)).select("_row.*")
    kept = fine.join(gone, (_host(host) == F.col("_host")) & (F.xxhash64("text") == F.col("_mark")), "left_anti")
    return _without(kept, hit, frequent, host) if strip else kept


ORACLE_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, coalesce(source, '') AS host FROM documents),
w AS (SELECT r, doc_id, host, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: translate(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') <> '') AS ls FROM d),
win AS (SELECT r, unnest(range(1, len(ws) - 1)) AS p, unnest(list_transform(range(1, len(ws) - 1), lambda i: [ws[i], ws[i + 1], ws[i + 2]])) AS g FROM w),
rep AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT r, sum(least(3, p - coalesce(last, -9))) AS n_rep FROM (SELECT r, p, lag(p) OVER (PARTITION BY r ORDER BY p) AS last FROM rep) GROUP BY r),
s AS (SELECT w.r, doc_id, host, len(ws) AS n_words,
             length(translate(t, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS word_chars,
             length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
             len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_rep, 0) AS n_repeat_words FROM w LEFT JOIN cov USING (r)),
l0 AS (SELECT r, host, unnest(ls) AS l, unnest(range(len(ls))) AS pos FROM w),
l1 AS (SELECT r, host, pos, len(list_filter(regexp_split_to_array(l, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS words,
              lower(trim(regexp_replace(l, '[\\x20\\x09-\\x0D]+', ' ', 'g'))) AS line FROM l0),
same AS (SELECT r, md5(string_agg(line, chr(10) ORDER BY pos)) AS face FROM l1 GROUP BY r),
l2 AS (SELECT * FROM l1 JOIN same USING (r)),
hosts AS (SELECT host, count(DISTINCT face) AS host_docs FROM l2 GROUP BY host),
freq AS (SELECT host, line FROM (SELECT host, line, count(DISTINCT face) AS n_docs FROM l2 GROUP BY host, line) JOIN hosts USING (host)
         WHERE n_docs > 20 AND n_docs > 0.002 * host_docs),
rem AS (SELECT r, sum(words) AS n_removed FROM l2 JOIN freq USING (host, line) GROUP BY r)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       coalesce(n_removed, 0)::BIGINT AS n_removed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT (n_words - coalesce(n_removed, 0) < 0.25 * n_words) AS kept
FROM s LEFT JOIN rem USING (r)
"""
