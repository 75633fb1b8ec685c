"""Structured Streaming over span payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions.snapshots import Snapshots
from parley.functions.tables import materialize, remove
from parley.operators.traces import route_spans, spans_to_tool_calls
from parley.sources.documents import parse_otlp


def read_payload_stream(spark: SparkSession, path: str, **options) -> DataFrame:
    """(payload, payload_id) of new files below path, one payload each."""
    return spark.readStream.options(**({"wholetext": True} | options)).schema("value string").text(path).select(F.col("value").alias("payload"), F.col("_metadata.file_path").alias("payload_id"))


def stream_tool_calls(payloads: DataFrame) -> DataFrame:
    """Tool calls of a stream or table of payloads; no state."""
    return spans_to_tool_calls(route_spans(parse_otlp(payloads)))


class TurnCalls:
    """A table of all calls of each turn, filled batch by batch of a stream, each batch once.

    Turns are dealt into buckets by the hash of their conversation. A batch
    reads the buckets it touches, adds its calls to their turns, and commits
    the new buckets with its number as one snapshot; a batch that was committed
    before changes nothing, so a replay after a failure is harmless. Calls of a
    turn stand in the order of batches and, within one, of columns (payload,
    place in it); equal calls of several payloads all count.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.table, self.buckets = Snapshots(spark, root, "bucket"), buckets

    def upsert(self, calls: DataFrame, batch: int) -> None:
        """Adds calls (conversation_id, turn_id, id, name, arguments, payload_id, span_pos, ...) of a batch."""
        done = self.table.state()["label"]
        if done is not None and batch <= done:
            return
        bucket = F.pmod(F.xxhash64("conversation_id"), F.lit(self.buckets)).cast("string")
        call = F.struct(F.lit(batch).cast("long").alias("batch"), *(c for c in ("payload_id", "span_pos", "id", "name", "arguments", "result", "error") if c in calls.columns))
        new = materialize(calls.select(bucket.alias("bucket"), "conversation_id", "turn_id", call.alias("call")), "batch-calls")
        touched = new.select("bucket").distinct()
        rows = new
        if "turn_calls" in self.table.state()["tables"]:
            old = self.table.read("turn_calls").join(touched, "bucket", "left_semi")
            rows = rows.unionByName(old.select("bucket", "conversation_id", "turn_id", F.explode("calls").alias("call")))
        turns = rows.groupBy("bucket", "conversation_id", "turn_id").agg(F.sort_array(F.collect_list("call")).alias("calls"))
        self.table.commit({"turn_calls": turns}, touched, batch)
        remove(calls.sparkSession, new)

    def read(self) -> DataFrame:
        """(conversation_id, turn_id, calls)."""
        return self.table.read("turn_calls").drop("bucket")

    def run(self, payloads: DataFrame, checkpoint: str, **trigger):
        """Starts the query that upserts the tool calls of a stream of payloads."""
        writer = stream_tool_calls(payloads).writeStream.foreachBatch(lambda df, batch: self.upsert(df, batch)).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"availableNow": True})).start()
