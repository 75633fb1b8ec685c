"""Deterministic sharded WARC writer and its reader.

Records are range-sorted by key, so that the shards follow one order. A task
rolls its archive when the compressed size passes a limit, and writes under a
temporary name of its own. The table of files that Spark committed then decides
which temporary files get their final names; files of lost attempts are never
in it. Headers and digests are made anew from the payloads. Of equal payloads
one record holds the bytes and the others revisit it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm.shared import fresh_path, materialize, remove

ROLL_BYTES = 32 << 20
#: Input bytes that one shard's task takes on; with the roll limit it bounds what a task does.
SHARD_BYTES = 64 << 20
WARC_DATE = "2000-01-01T00:00:00Z"


_UNSAFE = re.compile(r"[\x00-\x20\x7f-\x9f\u2028\u2029]")


def _field(name: str, value: str | None) -> list[tuple[str, str]]:
    """A header for a value. One that could break a line, or is empty, is percent-encoded there, and a second header holds its exact bytes; null has only a mark."""
    if value is None:
        return [(name, "urn:none"), (f"{name}-Null", "1")]
    if value and not _UNSAFE.search(value):
        return [(name, value)]
    return [(name, _UNSAFE.sub(lambda m: quote(m[0]), value) or "urn:none"), (f"{name}-Base64", base64.b64encode(value.encode()).decode())]


def _value(headers: dict[str, str], name: str) -> str | None:
    """What _field() wrote."""
    if headers.get(f"{name}-Null") == "1":
        return None
    exact = headers.get(f"{name}-Base64")
    return headers.get(name) if exact is None else base64.b64decode(exact).decode()


def record_id(key: str, digest: str, nth: int) -> str:
    """A name that follows from the record alone, so that a second attempt writes the same bytes."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{key} {digest} {nth}')}>"


def _member(headers: list[tuple[str, str]], body: bytes) -> bytes:
    """One record as a gzip member of its own, without a time stamp."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(body)))]) + "\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(head.encode() + body + b"\r\n\r\n") + z.flush()


def _base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


class _Roller:
    """The archives of one shard: opens a temporary file, rolls it by compressed size, tells what it wrote."""

    def __init__(self, root: str, shard: int, roll_bytes: int):
        self.fs, self.path = pafs.FileSystem.from_uri(root)
        self.shard, self.roll_bytes, self.seq, self.out, self.done = shard, roll_bytes, 0, None, []
        self.attempt = uuid.uuid4().hex

    def add(self, member: bytes) -> None:
        if self.out is None:
            self.temp = f"_temporary/{self.shard:06d}-{self.seq:05d}-{self.attempt}"
            self.fs.create_dir(f"{self.path}/_temporary", recursive=True)
            self.out, self.bytes, self.records, self.sha = self.fs.open_output_stream(f"{self.path}/{self.temp}", compression=None), 0, 0, hashlib.sha1()
        self.out.write(member)
        self.sha.update(member)
        self.bytes, self.records = self.bytes + len(member), self.records + 1
        if self.bytes >= self.roll_bytes:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((f"part-{self.shard:06d}-{self.seq:05d}.warc.gz", self.temp, self.records, self.bytes, self.sha.hexdigest()))
            self.out, self.seq = None, self.seq + 1


MANIFEST = "file string, temp string, records long, bytes long, sha1 string"


def _writer(root: str, roll_bytes: int):
    """Takes rows sorted by (key, digest, kind): first, if its payload has copies, a row that names the chosen record, then the pages."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller = _Roller(root, TaskContext.get().partitionId(), roll_bytes)
        at, chosen, nth = None, None, 0
        for batch in batches:
            for key, digest, kind, refers, url, html in zip(*(batch.column(c).to_pylist() for c in ("k", "digest", "kind", "refers", "url", "html"))):
                if (key, digest) != at:
                    at, chosen, nth = (key, digest), None, 0
                if kind == 0:
                    chosen = refers
                    continue
                revisit = chosen is not None and (chosen != key or nth > 0)
                body, sha = (html or "").encode(), _base32(digest)
                name = "null" if key is None else f"key {key}"
                headers = [
                    ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(name, digest, nth)), ("WARC-Date", WARC_DATE), *_field("WARC-Target-URI", url),
                    ("WARC-Payload-Digest", f"sha1:{sha}"), *_field("WARC-Page-ID", key), ("WARC-Payload-Length", str(len(body))),
                ]
                if revisit:
                    headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(f"key {chosen}", digest, 0)), *_field("WARC-Refers-To-Page-ID", chosen)]
                    body = b""
                http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
                headers += [("WARC-Block-Digest", "sha1:" + base64.b32encode(hashlib.sha1(http + body).digest()).decode()), ("Content-Type", "application/http;msgtype=response")]
                roller.add(_member(headers, http + body))
                nth += 1
        roller.close()
        if roller.done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*roller.done)], [x.split()[0] for x in MANIFEST.split(", ")])

    return write


def _commit(root: str):
    """Gives the files of a manifest their final names; a file that already has its name was moved by an earlier attempt."""

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(root)
        for batch in batches:
            for file, temp in zip(batch.column("file").to_pylist(), batch.column("temp").to_pylist()):
                if fs.get_file_info(f"{path}/{temp}").type == pafs.FileType.File:
                    fs.move(f"{path}/{temp}", f"{path}/{file}")
            yield batch

    return move


def payload_digest(html: Column) -> Column:
    return F.sha1(F.coalesce(html, F.lit("")).cast("binary"))


def write_warc(pages: DataFrame, root: str, key: str = "page_id", shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Writes a record for each row of pages (key, url, html) below root and returns the manifest (file, temp, records, bytes, sha1).

    Of rows with equal payloads the one with the largest key is the response;
    the others, repeats of its own row too, revisit it. A null html is an empty
    payload, a null key sorts first and is never chosen over another; the text
    "null" is a key like any other. Line breaks and other control signs in keys
    and urls are kept exactly. No pages give an empty manifest; other columns
    are ignored. Pages
    cross the network once: the small table of chosen records travels in the
    same range-partitioned exchange. Copies are counted by a partial
    aggregation, and each page learns its own record's choice, so groups of
    copies of any size stay spread over the shards.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(key).alias("k0"), F.col(key).cast("string").alias("k"), payload_digest(F.col("html")).alias("digest"), "url", "html")
    thin = rows.select("k0", "k", "digest")
    many = thin.groupBy("digest").agg(F.max("k0").cast("string").alias("refers"), F.count("*").alias("n")).where("n > 1 and refers is not null").drop("n")
    chosen = thin.join(many, "digest").groupBy("k0", "digest").agg(F.first("k").alias("k"), F.first("refers").alias("refers"))
    chosen = chosen.select("k0", "k", "digest", F.lit(0).alias("kind"), "refers", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"))
    every = rows.select("k0", "k", "digest", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("refers"), "url", "html").unionByName(chosen)
    total = pages.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // (1 << 20))))
    ordered = every.repartitionByRange(shards, "k0", "digest").sortWithinPartitions("k0", "digest", "kind", "url").drop("k0")
    manifest = materialize(ordered.mapInArrow(_writer(root, roll_bytes), MANIFEST), "warc-manifest")
    done = f"{root}/_manifest"
    manifest.repartition(max(1, min(shards, 64))).mapInArrow(_commit(root), MANIFEST).write.mode("overwrite").parquet(done)
    remove(spark, manifest)
    return spark.read.schema(manifest.schema).parquet(done)


def _members(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a stream, one at a time."""
    z, parts, left = zlib.decompressobj(31), [], b""
    while data := left or stream.read(chunk):
        parts.append(z.decompress(data))
        left = b""
        if z.eof:
            left = z.unused_data
            yield b"".join(parts)
            z, parts = zlib.decompressobj(31), []
    if any(parts):
        raise ValueError("an archive ends inside a record")


RECORDS = "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, html string, file string"


def _reader(root: str, payloads: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(root)
        names = [x.split()[0] for x in RECORDS.split(", ")]
        schema = pa.schema([(n, pa.int64() if n == "payload_bytes" else pa.string()) for n in names])
        for batch in batches:
            for file, expected in zip(batch.column("file").to_pylist(), batch.column("records").to_pylist()):
                out, size, n = [], 0, 0
                with fs.open_input_stream(f"{path}/{file}", compression=None) as stream:
                    for raw in _members(stream):
                        head, _, rest = raw.partition(b"\r\n\r\n")
                        h = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
                        body = rest[: int(h["Content-Length"])].partition(b"\r\n\r\n")[2]
                        digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                        if h["WARC-Type"] == "response" and base64.b32encode(hashlib.sha1(body).digest()).decode() != digest:
                            raise ValueError(f"payload of {h['WARC-Record-ID']} in {file} does not have its digest")
                        out.append((_value(h, "WARC-Page-ID"), _value(h, "WARC-Target-URI"), int(h["WARC-Payload-Length"]), digest, h["WARC-Type"], _value(h, "WARC-Refers-To-Page-ID"), body.decode() if payloads and h["WARC-Type"] == "response" else None, file))
                        size, n = size + len(body) * payloads, n + 1
                        if len(out) >= 5000 or size > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), schema.types)], schema=schema)
                            out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), schema.types)], schema=schema)
                if n != expected:
                    raise ValueError(f"{file} has {n} records, its manifest says {expected}")

    return read


def read_warc(spark: SparkSession, root: str, payloads: bool = True) -> DataFrame:
    """The records of the archives that the manifest below root names, streamed from the files; digests and counts are checked."""
    manifest = spark.read.parquet(f"{root}/_manifest")
    return manifest.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "file").mapInArrow(_reader(root, payloads), RECORDS)


def warc_round_trip(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Writes the pages below the shared folder, reads the archives back and returns one row for each record, without its payload."""
    spark = pages.sparkSession
    root = fresh_path(spark, "warc")
    write_warc(pages, root, key)
    kind = pages.schema[key].dataType
    out = read_warc(spark, root, payloads=False)
    return out.select(F.col("page_id").cast(kind).alias(key), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


ORACLE_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT h, max(page_id) AS top FROM p GROUP BY h),
q AS (SELECT page_id, n, h, top, row_number() OVER (PARTITION BY page_id, h ORDER BY page_id) AS nth FROM p JOIN m USING (h)),
a AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567' AS abc)
SELECT page_id, n::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: abc[((('0x' || substr(h, ((i // 4) * 5 + 1)::INT, 5))::BIGINT // (32 ** (3 - i % 4))::BIGINT) % 32 + 1)::INT]), '') AS payload_digest,
       CASE WHEN page_id = top AND nth = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = top AND nth = 1 THEN NULL ELSE top END AS refers_to
FROM q, a
"""
