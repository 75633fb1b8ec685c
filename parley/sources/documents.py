"""Run, scenario, span and knowledge files as tables."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from itertools import islice

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley import schemas
from parley.constants import MAX_PAYLOAD_BYTES
from parley.functions.tables import materialize, sliced
from parley.functions.text import canonical_json
from parley.operators.traces import clean_tool_calls

TEXT_TYPES, PAGE_TYPES = ["md", "txt", "json"], ["html", "htm"]


REJECTS = "file string, offset long, reason string"


def _json_fault(column: str) -> Column:
    """(offset, reason): where a text stops being JSON, and why; called for broken texts only."""

    @F.pandas_udf("offset long, reason string")
    def fault(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            try:
                found = json.loads(text or "")
                out.append((None, "not an object" if not isinstance(found, dict) else "fields of other types"))
            except json.JSONDecodeError as e:
                out.append((e.pos, e.msg))
            except RecursionError:
                out.append((None, "nested too deeply"))
        return pd.DataFrame({"offset": pd.array([x[0] for x in out], "Int64"), "reason": pd.Series([x[1] for x in out], dtype=object)})

    return fault(column)


def _envelopes(spark: SparkSession, path: str, schema: str, needed: list[str], items: str) -> tuple[DataFrame, DataFrame]:
    """(envelopes, rejects) of the JSON files in path: the fields, with a row for each of the items and its place. A file is rejected if it is no JSON or lacks one of the needed fields; offset tells where a broken one stops being JSON.

    The files are parsed once, into a table that is written.
    """
    rows = spark.read.schema(schema).option("multiLine", True).json(path).withColumn("file", F.col("_metadata.file_path"))
    lacks = F.coalesce(*[F.when(F.col(c).isNull(), F.lit(f"no {c}")) for c in needed])
    others = [c for c in rows.columns if c != items]
    rows = materialize(rows.withColumn("lacks", F.when(F.col("_corrupt_record").isNull(), lacks)).select(*others, "lacks", F.posexplode_outer(items).alias("at", "item")), "files")
    broken = rows.where("_corrupt_record is not null").select("file", _json_fault("_corrupt_record").alias("f")).select("file", "f.*")
    poor = rows.where("lacks is not null and coalesce(at, 0) = 0").select("file", F.lit(None).cast("long").alias("offset"), F.col("lacks").alias("reason"))
    good = rows.where("_corrupt_record is null and lacks is null and at is not null").drop("_corrupt_record", "lacks")
    return good, broken.unionByName(poor)


def _empty_files(spark: SparkSession, path: str) -> DataFrame:
    """The empty files in a folder as rejects: Spark's readers pass over them."""
    return list_files(spark, path, deep=False).where("size = 0").select(F.col("path").alias("file"), F.lit(0).cast("long").alias("offset"), F.lit("empty file").alias("reason"))


def scenario_files(spark: SparkSession, path: str, empty_files: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scenarios, older records, rejects) of the scenario files in a folder. A record with user_attributes but without a profile is of an older form and rejected; missing lists are empty. rejects: (file, offset, reason) of the files that can't be read, with empty_files also of empty ones, which takes a listing, and of the older records."""
    rows, broken = _envelopes(spark, path, schemas.SCENARIOS, ["scenarios"], "scenarios")
    is_old = F.col("user_attributes").isNotNull() & (F.coalesce("user_profile", F.lit("")) == "")
    each = rows.select("schema_version", "item.*")
    good = each.where(~is_old).drop("user_attributes")
    empty = {c: F.coalesce(c, F.array().cast(good.schema[c].dataType)) for c in ("knowledge", "assertions")}
    old = rows.where("item.user_attributes is not null and coalesce(item.user_profile, '') = ''")
    old = old.select("file", F.lit(None).cast("long").alias("offset"), F.concat(F.lit("scenario "), F.col("at").cast("string"), F.lit(": user_attributes without user_profile")).alias("reason"))
    broken = broken.unionByName(_empty_files(spark, path)) if empty_files else broken
    return good.withColumns(empty), each.where(is_old), broken.unionByName(old)


def read_scenarios(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(scenarios, older records), see scenario_files()."""
    return scenario_files(spark, path, False)[:2]


def scenario_rejects(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset, reason) of the scenario files that read_scenarios() leaves out, and of the single records."""
    return scenario_files(spark, path)[2]


def simulation_files(spark: SparkSession, path: str, empty_files: bool = True) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(conversations, messages, tool_calls, rejects) of all run files below path, the first three with run_id. rejects: (file, offset, reason) of the files that can't be read, with empty_files also of empty ones."""
    runs, broken = _envelopes(spark, path, schemas.SIMULATION, ["simulation_id", "conversations"], "conversations")
    each = runs.select(F.col("simulation_id").alias("run_id"), F.col("item").alias("c"))
    v = "c.simulated_user_prompt.variables"
    conversations = each.select(
        "run_id", "c.conversation_id", "c.scenario_id", F.coalesce(f"{v}.`scenario.goal`", F.lit("")).alias("goal"), F.coalesce(f"{v}.`scenario.agent_context`", F.lit("")).alias("agent_context"),
        F.coalesce(f"{v}.`scenario.user_profile`", F.lit("")).alias("profile"), F.coalesce(f"{v}.`scenario.knowledge`", F.array().cast("array<string>")).alias("knowledge"),
    )
    said = each.select("run_id", "c.conversation_id", F.posexplode("c.conversation_history").alias("msg_pos", "m"))
    messages = said.select("run_id", "conversation_id", "msg_pos", "m.role", "m.content", "m.turn_id")
    calls = said.select("run_id", "conversation_id", F.col("m.turn_id").alias("turn_id"), F.posexplode("m.tool_calls").alias("call_pos", "t"))
    calls = clean_tool_calls(calls.select("run_id", "conversation_id", "turn_id", "call_pos", "t.*"))
    return conversations, messages, calls, broken.unionByName(_empty_files(spark, path)) if empty_files else broken


def read_simulations(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(conversations, messages, tool_calls), see simulation_files()."""
    return simulation_files(spark, path, False)[:3]


def simulation_rejects(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset, reason) of the run files that read_simulations() leaves out."""
    return simulation_files(spark, path)[3]


def otlp_rejects(payloads: DataFrame, column: str = "payload", max_bytes: int = MAX_PAYLOAD_BYTES) -> DataFrame:
    """The payloads that parse_otlp() leaves out: their other columns, offset, reason."""
    others = [c for c in payloads.columns if c != column]
    size = F.octet_length(column)
    large = payloads.where(size > max_bytes).select(*others, F.lit(max_bytes).cast("long").alias("offset"), F.concat(F.lit("too large: "), size.cast("string"), F.lit(" bytes")).alias("reason"))
    small = payloads.where((size <= max_bytes) | F.col(column).isNull())
    parsed = F.try_parse_json(column)
    broken = small.where(parsed.isNull()).select(*others, _json_fault(column).alias("f")).select(*others, "f.*")
    other = small.where(parsed.isNotNull() & ~F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False)))
    return large.unionByName(broken).unionByName(other.select(*others, F.lit(None).cast("long").alias("offset"), F.lit("not an object").alias("reason")))


def parse_otlp(payloads: DataFrame, column: str = "payload", max_bytes: int = MAX_PAYLOAD_BYTES) -> DataFrame:
    """One row for each span: the payload's other columns, resource_attributes, name, span_id, attributes, status, span_pos.

    Payloads that are too large or don't parse are left out whole. Both
    spellings of every key are read. Works on streams.
    """
    others = [c for c in payloads.columns if c != column]
    parsed = payloads.where((F.octet_length(column) <= max_bytes) & F.try_parse_json(column).isNotNull()).withColumn("_p", F.from_json(column, schemas.OTLP))
    resources = parsed.select(*others, F.posexplode(F.coalesce("_p.resourceSpans", "_p.resource_spans")).alias("_i", "_r"))
    scopes = resources.select(*others, "_i", F.col("_r.resource.attributes").alias("resource_attributes"), F.posexplode(F.coalesce("_r.scopeSpans", "_r.scope_spans")).alias("_j", "_s"))
    spans = scopes.select(*others, "_i", "_j", "resource_attributes", F.posexplode("_s.spans").alias("_k", "_x"))
    return spans.select(
        *others, "resource_attributes", F.coalesce("_x.name", F.lit("")).alias("name"), F.coalesce("_x.spanId", "_x.span_id").alias("span_id"), F.col("_x.attributes").alias("attributes"), F.col("_x.status").alias("status"),
        F.format_string("%06d.%06d.%06d", "_i", "_j", "_k").alias("span_pos"),
    )


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """(payload, payload_id) of the span files below path."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("payload"), F.col("_metadata.file_path").alias("payload_id"))


def read_otlp(spark: SparkSession, path: str) -> DataFrame:
    return parse_otlp(read_payloads(spark, path))


def normalize_response(raw: Column) -> tuple[Column, Column]:
    """(text, error) of a provider's raw reply: choices, else content blocks, else candidates. Exactly one is null."""
    v = F.try_parse_json(raw)
    kind = lambda p: F.schema_of_variant(F.try_variant_get(v, F.lit(p), "variant"))
    text = lambda p: F.try_variant_get(v, F.lit(p), "string")
    has = lambda p: F.coalesce(kind(p).startswith("ARRAY"), F.lit(False))
    full = lambda p: F.try_variant_get(v, F.lit(f"{p}[0]"), "variant").isNotNull()
    said = lambda p: F.when(kind(p) == "STRING", text(p)).otherwise("")
    choice = F.when(kind("$.choices[0].message").startswith("OBJECT"), said("$.choices[0].message.content")).otherwise(said("$.choices[0].delta.content"))
    blocks = F.from_json(F.to_json(F.try_variant_get(v, F.lit("$.content"), "variant")), "array<struct<type:string,text:string>>")
    block_text = F.array_join(F.transform(F.filter(blocks, lambda b: (b["type"] == "text") & b["text"].isNotNull()), lambda b: b["text"]), "")
    parts = F.from_json(F.to_json(F.try_variant_get(v, F.lit("$.candidates[0].content.parts"), "variant")), "array<struct<text:string>>")
    part_text = F.array_join(F.transform(F.filter(parts, lambda b: b["text"].isNotNull()), lambda b: b["text"]), "")
    found = (
        F.when(has("$.choices"), F.when(full("$.choices"), choice))
        .when(has("$.content"), F.coalesce(block_text, F.lit("")))
        .when(has("$.candidates"), F.when(full("$.candidates"), F.coalesce(part_text, F.lit(""))))
    )
    error = F.when(has("$.choices") & ~full("$.choices"), "empty choices").when(~has("$.choices") & ~has("$.content") & has("$.candidates") & ~full("$.candidates"), "empty candidates")
    return found, F.coalesce(error, F.when(found.isNull(), "unknown response format"))


def normalize_responses(df: DataFrame, column: str = "raw") -> DataFrame:
    text, error = normalize_response(F.col(column))
    return df.withColumn("text", text).withColumn("error", error)


def _entries(fs: pafs.FileSystem, folder: str) -> Iterator[tuple[str, str, int, bool]]:
    """(path, name, size, whether a folder) in a folder; on local file systems one by one, others give the list of a folder as a whole."""
    if isinstance(fs, pafs.LocalFileSystem):
        try:
            with os.scandir(folder) as found:
                for x in found:
                    try:
                        yield x.path, x.name, 0 if x.is_dir() else x.stat().st_size, x.is_dir()
                    except FileNotFoundError:  # a link to nothing
                        yield x.path, x.name, 0, False
        except FileNotFoundError:
            return
    else:
        for x in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True)):
            yield x.path, x.base_name, x.size or 0, x.type == pafs.FileType.Directory


def list_files(spark: SparkSession, root: str, deep: bool = True) -> DataFrame:
    """(path, name, size) of all files below root, or with deep False in it, but those whose names, or whose folders' names, begin with a dot; of root itself if it is a file.

    Spark's own listing hides names that begin with an underscore too, so the
    folders of each level are listed by tasks, through the file systems of
    pyarrow. Only their number passes the driver. A task lists a folder.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(root)
        for folder in (f.as_py() for b in batches for f in b.column("path")):
            own = fs.get_file_info(folder)
            found = iter([(own.path, own.base_name, own.size or 0, False)]) if own.is_file else (x for x in _entries(fs, folder) if not x[1].startswith("."))
            while part := list(islice(found, 10_000)):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), (pa.string(), pa.string(), pa.int64(), pa.bool_()))], ["path", "name", "size", "folder"])

    level = spark.createDataFrame([(pafs.FileSystem.from_uri(root)[1],)], "path string")
    out, n = None, 1
    while n:
        tasks = min(n, int(spark.conf.get("spark.sql.shuffle.partitions")))
        listed = materialize(level.repartition(tasks).mapInArrow(run, "path string, name string, size long, folder boolean"), "listing")
        files = listed.where("not folder").drop("folder")
        out = files if out is None else out.unionByName(files)
        level = listed.where("folder").select("path")
        n = level.count() if deep else 0
    return out


#: Bytes of files that a task reads, and that it gives back at once.
TASK_BYTES, BATCH_BYTES = 32 << 20, 1 << 20


def read_knowledge_files(spark: SparkSession, path: str) -> DataFrame:
    """(id, source, content, title, is_page, is_chunk, is_error, error_message) of the files below path but hidden and empty ones; an unsupported type, or a file that can't be read, is an error row.

    Hidden are names that begin with a dot. Texts are UTF-8; other bytes become
    the replacement character. Tasks are as many as the files' sizes ask for:
    their names alone are few bytes, by which Spark would put all into one.
    """
    kind = F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1))
    known = kind.isin(TEXT_TYPES + PAGE_TYPES)
    scheme = path.partition(":")[0] + "://" if ":" in path else "file://"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(path)
        for batch in sliced(batches, 256):
            first, size, held = 0, 0, []
            for i in range(batch.num_rows):  # any of them may be large, so what is held is counted
                content, fault = None, None
                if batch.column("known")[i].as_py():
                    try:
                        with fs.open_input_stream(batch.column("path")[i].as_py(), compression=None) as stream:
                            content = stream.read().decode("utf-8", "replace")
                    except OSError as e:
                        fault = f"can't be read: {e}"
                held.append((content, fault))
                size += len(content or "")
                if size >= BATCH_BYTES or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(first, len(held)) for c in ("path", "name", "kind", "known")), pa.array([x for x, _ in held], pa.string()), pa.array([x for _, x in held], pa.string())], ["path", "name", "kind", "known", "content", "fault"])
                    first, size, held = i + 1, 0, []

    listed = list_files(spark, path).where("size > 0")
    n, size = listed.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    tasks = max(1, min(n, max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // TASK_BYTES)))
    found = listed.select("path", "name", kind.alias("kind"), known.alias("known"))
    files = found.repartition(tasks, "path").mapInArrow(run, "path string, name string, kind string, known boolean, content string, fault string").withColumn("source", F.concat(F.lit(scheme), "path"))
    fault = F.coalesce("fault", F.when(~F.col("known"), F.concat(F.lit("unsupported file type: "), "kind")))
    return files.select(
        F.substring(F.sha2("source", 256), 1, 16).alias("id"), "source", "content", F.col("name").alias("title"), F.col("kind").isin(PAGE_TYPES).alias("is_page"), F.lit(False).alias("is_chunk"), fault.isNotNull().alias("is_error"), fault.alias("error_message"),
    )


def canonical_arguments(df: DataFrame, column: str = "arguments") -> DataFrame:
    return df.withColumn(column, F.coalesce(canonical_json(F.col(column)), F.lit("{}")))
