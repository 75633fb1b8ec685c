"""Tables written to the folder that all executors share, small files beside them, and numbers for rows in order."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows of texts that a task turns into Python values, or gives back, at once.
SLICE = 64


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share.

    Where the setting is absent, a folder of the warehouse is taken on a local
    master (tests); a cluster has to name one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (found or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared").rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: lost executors cost no more than a read."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    # nothing reads the shuffles of this write again, so their files may go at its end
    was = spark.conf.get(_CLEAN, None)
    try:
        spark.conf.set(_CLEAN, "true")
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEAN, was) if was is not None else spark.conf.unset(_CLEAN)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes tables that materialize() made."""
    jvm = spark.sparkContext._jvm
    for at in {file.rpartition("/")[0] for t in tables for file in t.inputFiles()}:
        folder = jvm.org.apache.hadoop.fs.Path(at)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def numbered(rows: DataFrame, order: list[Column], name: str, within: list[str] | None = None, partitions: int | None = None) -> DataFrame:
    """rows with their numbers from 1 in this order, or from 1 for each value of the columns within, by which they are ordered first.

    A range sort that is written once, a count for each range, and the offsets
    of the ranges: no task sees all rows, and a lost task reads the same ranges
    again.
    """
    within = within or []
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [*(F.col(c).asc() for c in within), *order]
    ranged = materialize(rows.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    placed = ranged.withColumn("_rank", F.row_number().over(Window.partitionBy("_part").orderBy(*order))).join(F.broadcast(starts), "_part")
    placed = placed.withColumn(name, F.col("_rank") + F.col("_ahead")).drop("_part", "_rank", "_ahead")
    if not within:
        return placed
    first = placed.groupBy(*within).agg(F.min(name).alias("_first"))
    return placed.join(first, within).withColumn(name, F.col(name) - F.col("_first") + 1).drop("_first")


def sliced(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Batches in slices of a few rows, so that texts are never Python values for a whole batch."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def write_files(rows: DataFrame, root: str) -> int:
    """Writes a file below root for each row (name, content), the content as UTF-8; how many. A name may have folders. A repeated attempt writes the same bytes again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(root)
        fs.create_dir(path, recursive=True)
        made, n = None, 0
        for batch in sliced(batches):
            for name, content in zip(batch.column("name"), batch.column("content")):  # values are made one at a time
                name, content = name.as_py(), content.as_py()
                folder = name.rpartition("/")[0]
                if folder and folder != made:
                    fs.create_dir(f"{path}/{folder}", recursive=True)
                    made = folder
                with fs.open_output_stream(f"{path}/{name}", compression=None) as out:
                    out.write((content or "").encode())
            n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([n])], ["n"])

    return rows.select("name", "content").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0
